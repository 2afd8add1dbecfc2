"""Stored flow models: XML rows shredded into tables with built-in XPath."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procweave.functions.text import null_if_blank, or_blank, strip
from procweave.operators.graph import union_all
from procweave.operators.ordered import first_per_key

# Element names of a stored model and what they are.
EVENT_TAGS = ["startEvent", "endEvent", "intermediateCatchEvent", "intermediateThrowEvent"]
TASK_TAGS = ["userTask", "serviceTask", "task", "manualTask"]
GATEWAY_TAGS = ["exclusiveGateway", "parallelGateway", "inclusiveGateway", "eventBasedGateway"]
EXTENSION = "tool string, instruction string, description string, duration int, role string, inputData array<string>, outputData array<string>, checkpoints array<string>"


def _local(xml: Column) -> Column:
    """Text without name-space prefixes and declarations, so paths can use plain names."""
    plain = F.regexp_replace(xml, r"(</?)[A-Za-z0-9_]+:", "$1")
    return F.regexp_replace(plain, r"\s(?:xmlns(?::\w+)?|xsi:\w+)\s*=\s*(?:\"[^\"]*\"|'[^']*')", "")


def _elements(models: DataFrame, tag: str) -> DataFrame:
    """Outer text of each element ``tag`` directly under a process, with its position."""
    body = F.regexp_extract_all("xml", F.lit(rf"(?s)<{tag}(?:\s[^>]*?)?(?:/>|>.*?</{tag}>)"), F.lit(0))
    return models.select("proc_id", F.posexplode(body).alias("pos", "node"))


def _attr(name: str) -> Column:
    return F.coalesce(F.xpath_string("node", F.lit(f"/*/@{name}")), F.lit(""))


def ingest_models(rows: DataFrame) -> dict[str, DataFrame]:
    """Roles, events, activities, gateways, sequences, variables and participants of (proc_id, xml) rows."""
    models = rows.select("proc_id", _local(or_blank("xml")).alias("xml"))
    lanes = _elements(models, "lane").withColumn("name", F.coalesce(null_if_blank(_attr("name")), F.lit("Unknown")))
    endpoint = F.get_json_object(F.xpath_string("node", F.lit("/lane/extensionElements/properties/json")), "$.roleResolutionContext.endpoint")
    endpoint = F.coalesce(F.get_json_object(endpoint, "$[0]"), endpoint, F.lit(""))
    is_uuid = endpoint.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
    roles = lanes.select("proc_id", "pos", "name", F.when(is_uuid, endpoint).otherwise(F.lit("")).alias("endpoint"), F.lower("name").alias("__key"))
    roles = first_per_key(roles, ["proc_id", "__key"], ["pos"]).drop("__key")
    member = lanes.select("proc_id", "pos", F.col("name").alias("lane"), F.explode(F.xpath("node", F.lit("/lane/flowNodeRef/text()"))).alias("id"))
    member = member.groupBy("proc_id", strip("id").alias("id")).agg(F.max_by("lane", "pos").alias("lane"))

    def tagged(tags: list[str]) -> DataFrame:
        found = union_all([_elements(models, t).select("proc_id", F.lit(i).alias("rank"), "pos", F.lit(t).alias("type"), "node") for i, t in enumerate(tags)])
        named = found.withColumn("id", _attr("id")).withColumn("name", _attr("name"))
        return named.join(member, ["proc_id", "id"], "left").withColumn("role", or_blank("lane"))

    tasks = tagged(TASK_TAGS).withColumn("__x", F.from_json(F.xpath_string("node", F.lit("/*/extensionElements/properties/json")), EXTENSION))
    x = lambda c: F.col(f"__x.{c}")
    texts = F.array().cast("array<string>")
    activities = tasks.select(
        "proc_id", "id", "name", "type", F.coalesce(null_if_blank(x("role")), "role").alias("role"), F.coalesce(null_if_blank(x("tool")), F.lit("formHandler:defaultform")).alias("tool"),
        or_blank(x("instruction")).alias("instruction"), or_blank(x("description")).alias("description"), F.coalesce(F.nullif(x("duration"), F.lit(0)), F.lit(5)).alias("duration"),
        *[F.coalesce(x(c), texts).alias(c) for c in ("inputData", "outputData", "checkpoints")],
    )
    plain = ["proc_id", "id", "name", "type", "role"]
    flows = _elements(models, "sequenceFlow")
    condition = strip(F.coalesce(F.xpath_string("node", F.lit("/sequenceFlow/conditionExpression")), F.lit("")))
    variables = _elements(models, "variable").select("proc_id", _attr("name").alias("name"), _attr("description").alias("description"), F.coalesce(null_if_blank(_attr("type")), F.lit("string")).alias("type"))
    return {
        "roles": roles,
        "events": tagged(EVENT_TAGS).select(*plain),
        "activities": activities,
        "gateways": tagged(GATEWAY_TAGS).select(*plain),
        "sequences": flows.select(
            "proc_id", "pos", _attr("id").alias("id"), _attr("name").alias("name"), _attr("sourceRef").alias("source"), _attr("targetRef").alias("target"),
            F.coalesce(null_if_blank(condition), _attr("name")).alias("condition"),
        ),
        "variables": variables.where("name <> ''").withColumn("description", F.coalesce(null_if_blank("description"), F.concat("name", F.lit(" description")))),
        "participants": _elements(models, "participant").select("proc_id", _attr("id").alias("id"), _attr("name").alias("name"), _attr("processRef").alias("process_ref")),
    }
