"""Candidate payloads to typed entities.

A section row carries one JSON payload of twelve arrays. Each array becomes a table of rows keyed by
(section_id, pos); names are resolved by joins on the section first, so no name is ever compared with
those of other sections, and lookups of earlier sections are ordered scans.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procweave.functions import fixed
from procweave.functions.text import (
    blank,
    clean_condition,
    compact,
    entity_id,
    null_if_blank,
    or_blank,
    reusable_skill,
    strip,
    with_branch_conditions,
    with_gateway_name,
)
from procweave.operators.graph import union_all
from procweave.operators.ordered import first_per_key, scan
from procweave.session import settle

PAYLOAD = (
    "processes array<struct<name:string,description:string>>,"
    "tasks array<struct<name:string,task_type:string,description:string,instruction:string,order:string,"
    "performer_role:string,parent_process:string,next_task:string,previous_task:string>>,"
    "roles array<struct<name:string,org_unit:string,persona_hint:string,description:string>>,"
    "gateways array<struct<name:string,gateway_type:string,description:string,condition:string,parent_process:string>>,"
    "events array<struct<name:string,event_type:string,trigger:string,parent_process:string>>,"
    "decisions array<struct<name:string,description:string,input_data:array<string>,output_data:array<string>,related_role:string>>,"
    "rules array<struct<decision_id:string,decision_name:string,decision:string,when:string,condition:string,then:string,result:string,confidence:double>>,"
    "skills array<struct<name:string,summary:string,description:string,purpose:string,procedure:array<string>,inputs:map<string,string>,"
    "outputs:map<string,string>,preconditions:array<string>,exceptions:array<string>,tools:array<string>,related_tasks:array<string>,"
    "related_role:string,decision_name:string,decision:string>>,"
    "task_role_mappings array<struct<task_name:string,role_name:string>>,"
    "task_process_mappings array<struct<task_name:string,process_name:string>>,"
    "role_skill_mappings array<struct<role_name:string,skill_name:string>>,"
    "sequence_flows array<struct<from_task:string,to_task:string,condition:string>>"
)
ARRAYS = [p.split(" ", 1)[0].strip() for p in PAYLOAD.split(">>,")]
SECTION = ["section_id", "scope", "section_no"]


def clean_json_column(text: Column | str) -> Column:
    """First reading of the text that is JSON: as it is, a fenced block, or the outermost braces;
    each is also tried with white space collapsed. Null when none parses."""
    t = or_blank(text)
    # An unmatched pattern gives an empty text, which is not JSON.
    readings = [strip(t), strip(F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1)), F.regexp_extract(t, r"(?s)(\{.*\})", 1)]
    tried = []
    for r in readings:
        for shape in (r, F.regexp_replace(r, r"\s+", " ")):
            tried.append(F.when(F.try_parse_json(F.when(shape != "", shape)).isNotNull(), shape))
    return F.coalesce(*tried)


def parse_candidates(sections: DataFrame, payload: str = "payload") -> DataFrame:
    """Payload arrays as columns; unreadable payloads and missing arrays give empty ones."""
    parsed = sections.withColumn("__p", F.from_json(payload, PAYLOAD))
    kinds = dict(f.strip().split(" ", 1) for f in PAYLOAD.replace(">>,", ">>\n").split("\n"))
    return parsed.select(
        *[c for c in sections.columns if c != payload],
        *[F.coalesce(F.col(f"__p.{a}"), F.array().cast(kinds[a])).alias(a) for a in ARRAYS],
    )


def rows_of(parsed: DataFrame, array: str) -> DataFrame:
    """Rows of one payload array with their position."""
    out = parsed.select(*SECTION, F.posexplode(array).alias("pos", "__r"))
    return out.select(*SECTION, "pos", "__r.*")


def _first_words(value: Column | str) -> Column:
    return F.lower(or_blank(value))


# Wording that marks a line as a candidate, with the confidence of each kind.
LINE_PATTERNS: list[tuple[str, str, float]] = [
    ("process", "절차|업무 흐름|처리 단계|프로세스 개요|업무 절차", 0.7),
    ("task", "한다|점검|승인|검토|접수|등록|통보|보고", 0.6),
    ("role", "담당|승인권자|검토자|부서명|직책|시스템|대행|외부기관", 0.6),
    ("gateway", "인 경우|아닌 경우|다만|예외적으로|필요 시", 0.8),
    ("event", "요청 접수 시|제출 후|정기적으로|종료", 0.7),
]
STEP_PATTERN = r"(?:Step\s*(\d+))|(?:(\d+)\s*단계)"


def pattern_candidates(sections: DataFrame, patterns: Sequence[tuple[str, str, float]] = LINE_PATTERNS) -> DataFrame:
    """Lines of (section_id, content) marked by kind; a step number gives the order."""
    lines = sections.select(
        "section_id", F.posexplode(F.filter(F.transform(F.split("content", "\n"), strip), lambda x: x != "")).alias("pos", "line")
    )
    # The patterns are a fixed list, so each line is tested in place and nothing is joined.
    marks = F.array(
        *[F.when(F.col("line").rlike(p), F.struct(F.lit(k).alias("kind"), F.lit(w).alias("confidence"))) for k, p, w in patterns]
    )
    step = F.coalesce(
        F.expr("try_cast(nullif(regexp_extract(line, 'Step\\\\s*(\\\\d+)', 1), '') AS INT)"),
        F.expr("try_cast(nullif(regexp_extract(line, '(\\\\d+)\\\\s*단계', 1), '') AS INT)"),
    )
    found = lines.select("section_id", "pos", "line", step.alias("step"), F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("m"))
    return found.select("section_id", "pos", "m.kind", "line", "step", "m.confidence")


def default_payload(candidates: DataFrame) -> DataFrame:
    """Payload JSON per section from pattern candidates: the default in place of a model."""
    of = lambda kind: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "line", "step")))), lambda x: x
    )
    # A section is one payload row by definition, so this groups lines of a single section only.
    grouped = candidates.groupBy("section_id").agg(*[of(k).alias(k) for k in ("process", "task", "role", "gateway", "event")])
    name = lambda arr: F.transform(arr, lambda x: F.struct(x["line"].alias("name")))
    body = F.struct(
        name("process").alias("processes"),
        F.transform("task", lambda x: F.struct(x["line"].alias("name"), x["step"].cast("string").alias("order"))).alias("tasks"),
        name("role").alias("roles"),
        F.transform("gateway", lambda x: F.struct(x["line"].alias("description"))).alias("gateways"),
        name("event").alias("events"),
    )
    return grouped.select("section_id", F.to_json(body).alias("payload"))


def payload_with(sections: DataFrame, fn, columns: Sequence[str] = ("content",)) -> DataFrame:
    """Payloads by a caller's function from lists of section texts (one list per column) to a list of JSON strings, called
    once per Arrow batch."""
    schema = f"section_id {sections.schema['section_id'].dataType.simpleString()}, payload string"

    def apply(batches):
        for pdf in batches:
            yield pdf[["section_id"]].assign(payload=list(fn(*[pdf[c].tolist() for c in columns])))

    return sections.select("section_id", *columns).mapInPandas(apply, schema)


# Names known at a section ---------------------------------------------------------------------------


def known_at(lookups: DataFrame, names: DataFrame) -> DataFrame:
    """Id of each looked-up name as of its section: own section first, else the latest earlier one.

    ``names`` is (scope, key, section_no, pos, id), ``lookups`` is (scope, key, section_no, row_id);
    the result is (row_id, id). Both run through one ordered scan per (scope, key), which also holds
    for a name that a third of all rows refer to.
    """
    sides = union_all(
        [
            names.select("scope", "key", "section_no", F.lit(0).alias("side"), F.col("pos").cast("string").alias("at"), F.lpad(F.col("pos").cast("string"), 10, "0").alias("tie"), F.col("id")),
            lookups.select("scope", "key", "section_no", F.lit(1).alias("side"), F.col("row_id").alias("at"), F.col("row_id").alias("tie"), F.lit(None).cast("string").alias("id")),
        ]
    ).where("key <> ''")
    seen = scan(sides, ["scope", "key"], ["section_no", "side", "tie"], last_seen={"known": F.col("id")})
    return seen.where("side = 1 AND known IS NOT NULL").select(F.col("at").alias("row_id"), F.col("known").alias("id"))


def _row_id(*parts: Column | str) -> Column:
    return F.concat_ws("/", *parts)


def _resolve(rows: DataFrame, key: Column, names: DataFrame, out: str) -> DataFrame:
    """Add ``out``: id of ``key`` as known at the row's section."""
    keyed = rows.withColumn("__row", _row_id("section_id", "pos")).withColumn("__key", key)
    hits = known_at(keyed.select("scope", F.col("__key").alias("key"), "section_no", F.col("__row").alias("row_id")), names)
    return keyed.join(hits.select(F.col("row_id").alias("__row"), F.col("id").alias(out)), "__row", "left").drop("__row", "__key")


def _names(entities: DataFrame, key: str) -> DataFrame:
    return entities.select("scope", _first_words("name").alias("key"), "section_no", "pos", F.col(key).alias("id"))


def name_id_map(entities: DataFrame, key: str) -> DataFrame:
    """(scope, lower name) to id; the last occurrence wins."""
    at = F.struct("section_no", "pos")
    return entities.groupBy("scope", _first_words("name").alias("key")).agg(F.max_by(key, at).alias("id"))


# Entities -------------------------------------------------------------------------------------------


def to_processes(parsed: DataFrame) -> DataFrame:
    rows = rows_of(parsed, "processes")
    name = F.coalesce("name", F.lit("Unknown Process"))
    return rows.select(
        *SECTION, "pos", entity_id("section_id", "process", name, F.col("pos").cast("string")).alias("proc_id"), name.alias("name"),
        or_blank("description").alias("purpose"), or_blank("description").alias("description"),
    )


def to_roles(parsed: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Roles new to their scope: the first occurrence of each lower-case name, less those ``known``
    as (scope, key)."""
    rows = rows_of(parsed, "roles").withColumn("name", F.coalesce("name", F.lit("Unknown Role"))).withColumn("key", F.lower("name"))
    if known is not None:
        rows = rows.join(known.select("scope", "key"), ["scope", "key"], "left_anti")
    first = first_per_key(rows, ["scope", "key"], ["section_no", "pos"])
    return first.select(
        *SECTION, "pos", entity_id("scope", "role", "name").alias("role_id"), "name", or_blank("org_unit").alias("org_unit"),
        F.coalesce("persona_hint", "description", F.lit("")).alias("persona_hint"),
    )


def _coded(value: str, allowed: Sequence[str], default: str) -> Column:
    v = F.lower(F.coalesce(null_if_blank(value), F.lit(default)))
    return F.when(v.isin(list(allowed)), v).otherwise(F.lit(default))


def _first_process(processes: DataFrame) -> DataFrame:
    return processes.groupBy("section_id").agg(F.min_by("proc_id", "pos").alias("__first_proc"))


def _with_process(rows: DataFrame, processes: DataFrame) -> DataFrame:
    """Parent process by name as known at the section, else the section's first process."""
    named = _resolve(rows, _first_words("parent_process"), _names(processes, "proc_id"), "__proc")
    joined = named.join(_first_process(processes), "section_id", "left")
    return joined.withColumn("process_id", F.coalesce("__proc", "__first_proc", F.lit(""))).drop("__proc", "__first_proc")


def to_tasks(parsed: DataFrame, processes: DataFrame) -> DataFrame:
    rows = rows_of(parsed, "tasks")
    number = F.expr("try_cast(`order` AS DOUBLE)")
    shaped = rows.select(
        *SECTION, "pos", F.coalesce("name", F.concat(F.lit("Task "), (F.col("pos") + 1).cast("string"))).alias("name"),
        _coded("task_type", ["agent", "system"], "human").alias("task_type"), or_blank("description").alias("description"),
        or_blank("instruction").alias("instruction"), F.coalesce(number.cast("int"), F.col("pos")).alias("order"),
        "performer_role", "parent_process", "next_task",
    )
    tasks = _with_process(shaped, processes)
    return tasks.withColumn("task_id", entity_id("section_id", "task", "name", F.col("pos").cast("string"))).drop("parent_process")


def link_performer(tasks: DataFrame, roles: DataFrame) -> DataFrame:
    """(task_id, role_id) where the performer's name is known at the section."""
    found = _resolve(tasks, _first_words("performer_role"), _names(roles, "role_id"), "role_id")
    return found.where("role_id IS NOT NULL").select("task_id", "role_id")


def _first_named(pairs: DataFrame, tasks: DataFrame, term: str, both_ways: bool = False) -> DataFrame:
    """First task of the section, by position, whose name equals or contains the term (or, when
    ``both_ways``, is contained in it): (section_id, term, task_pos, task_id).

    Equal names stand for one another, so each distinct name and term is compared once.
    """
    terms = pairs.select("section_id", F.col(term).alias("term")).where("term <> ''").distinct()
    names = tasks.groupBy("section_id", F.lower("name").alias("__name")).agg(F.min(F.struct("pos", "task_id")).alias("__t"))
    fits = F.contains("__name", "term")
    if both_ways:
        fits = fits | F.contains("term", "__name")
    hit = terms.join(names, "section_id").where((F.col("__name") != "") & fits)
    best = hit.groupBy("section_id", "term").agg(F.min("__t").alias("t"))
    return best.select("section_id", "term", F.col("t.pos").alias("task_pos"), F.col("t.task_id").alias("task_id"))


def _apply_mappings(rows: DataFrame, tasks: DataFrame, names: DataFrame, target: str, out: str) -> DataFrame:
    keyed = rows.withColumn("term", _first_words("task_name"))
    known = _resolve(keyed, _first_words(target), names, "__id").where("__id IS NOT NULL")
    hits = known.join(_first_named(known, tasks, "term"), ["section_id", "term"])
    return hits.groupBy("task_id").agg(F.max_by("__id", "pos").alias(out))


def apply_task_role_mappings(parsed: DataFrame, tasks: DataFrame, roles: DataFrame, task_role: DataFrame) -> DataFrame:
    """Explicit pairs override the performers; later pairs override earlier ones."""
    explicit = _apply_mappings(rows_of(parsed, "task_role_mappings"), tasks, _names(roles, "role_id"), "role_name", "role_id")
    return task_role.join(explicit, "task_id", "left_anti").unionByName(explicit)


def apply_task_process_mappings(parsed: DataFrame, tasks: DataFrame, processes: DataFrame) -> DataFrame:
    """Tasks with the process of their explicit pair, where there is one."""
    explicit = _apply_mappings(rows_of(parsed, "task_process_mappings"), tasks, _names(processes, "proc_id"), "process_name", "__mapped")
    return tasks.join(explicit, "task_id", "left").withColumn("process_id", F.coalesce("__mapped", "process_id")).drop("__mapped")


def to_gateways(parsed: DataFrame, processes: DataFrame) -> DataFrame:
    rows = _with_process(rows_of(parsed, "gateways"), processes)
    rows = with_gateway_name(rows, "name", F.col("name"), F.col("description"), F.col("pos") + 1)
    return rows.select(
        *SECTION, "pos", entity_id("section_id", "gateway", "name", F.col("pos").cast("string")).alias("gateway_id"), "process_id",
        "name", _coded("gateway_type", ["parallel", "inclusive"], "exclusive").alias("gateway_type"),
        or_blank("condition").alias("condition"), or_blank("description").alias("description"),
    )


def to_events(parsed: DataFrame, processes: DataFrame) -> DataFrame:
    rows = _with_process(rows_of(parsed, "events"), processes)
    name = F.coalesce("name", F.lit("Event"))
    return rows.select(
        *SECTION, "pos", entity_id("section_id", "event", name, F.col("pos").cast("string")).alias("event_id"), "process_id",
        _coded("event_type", ["end", "intermediate"], "start").alias("event_type"), name.alias("name"), or_blank("trigger").alias("trigger"),
    )


def to_decisions(parsed: DataFrame, roles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decision rows and (role_id, decision_id) links."""
    rows = rows_of(parsed, "decisions").withColumn("name", F.coalesce("name", F.lit("Decision")))
    rows = rows.withColumn("decision_id", entity_id("section_id", "decision", "name", F.col("pos").cast("string")))
    empty = F.array().cast("array<string>")
    decisions = rows.select(
        *SECTION, "pos", "decision_id", "name", or_blank("description").alias("description"),
        F.coalesce("input_data", empty).alias("input_data"), F.coalesce("output_data", empty).alias("output_data"),
    )
    made = _resolve(rows, _first_words("related_role"), _names(roles, "role_id"), "role_id").where("role_id IS NOT NULL")
    return decisions, made.select("role_id", "decision_id").distinct()


def to_rules(parsed: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rules with their decision by id, else by name, else the section's first decision."""
    rows = rows_of(parsed, "rules").withColumn(
        "__key", F.lower(strip(F.coalesce(null_if_blank("decision_name"), null_if_blank("decision"), F.lit(""))))
    )
    by_name = decisions.groupBy("section_id", F.lower(strip("name")).alias("__key")).agg(F.max_by("decision_id", "pos").alias("__named"))
    first = decisions.groupBy("section_id").agg(F.min_by("decision_id", "pos").alias("__first"))
    joined = rows.join(by_name, ["section_id", "__key"], "left").join(first, "section_id", "left")
    chosen = F.coalesce(null_if_blank(strip("decision_id")), F.when(F.col("__key") != "", F.col("__named")), "__first", F.lit(""))
    return joined.select(
        *SECTION, "pos", F.substring(F.sha2(F.concat_ws(":", "section_id", F.lit("rule"), F.col("pos").cast("string")), 256), 1, 32).alias("rule_id"),
        chosen.alias("decision_id"), F.coalesce("when", "condition", F.lit("")).alias("when"), F.coalesce("then", "result", F.lit("")).alias("then"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
    )


def _knowhow(parsed: DataFrame) -> DataFrame:
    rows = rows_of(parsed, "skills")
    lines = F.concat(
        F.array(strip(F.coalesce(null_if_blank("summary"), "description", F.lit(""))), strip(or_blank("purpose"))),
        F.transform(F.coalesce("procedure", F.array().cast("array<string>")), lambda x: strip(or_blank(x))),
    )
    text = F.array_join(F.filter(lines, lambda x: x != ""), "\n")
    return rows.withColumn("knowhow", text).where("knowhow <> ''")


def fold_knowhow_into_tasks(parsed: DataFrame, tasks: DataFrame) -> DataFrame:
    """Tasks with skill-like text appended to the instruction of the related tasks, unless it is in it."""
    related = _knowhow(parsed).select("section_id", "pos", "knowhow", F.posexplode_outer("related_tasks").alias("rpos", "related"))
    related = related.withColumn("term", F.lower(strip(or_blank("related")))).where("term <> ''")
    trimmed = tasks.withColumn("name", strip("name"))
    hits = related.join(_first_named(related, trimmed, "term", both_ways=True), ["section_id", "term"])
    # Texts are few per task; the fold keeps their order and skips what the instruction holds by then.
    folded = hits.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("pos", "rpos", "knowhow"))).alias("__adds"))
    text = F.aggregate(
        F.coalesce("__adds", F.array().cast("array<struct<pos:int,rpos:int,knowhow:string>>")),
        strip(or_blank("instruction")),
        lambda acc, x: F.when(F.contains(acc, x["knowhow"]), acc).when(acc == "", x["knowhow"]).otherwise(F.concat(acc, F.lit("\n"), x["knowhow"])),
    )
    joined = tasks.join(folded, "task_id", "left")
    return joined.withColumn("instruction", F.when(F.col("__adds").isNull(), F.col("instruction")).otherwise(text)).drop("__adds")


def fold_knowhow_into_rules(parsed: DataFrame, decisions: DataFrame, roles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rules of the know-how, decisions created for them, and links of their roles.

    The decision is the one named, else one for the related role, else the general one; it is
    created once per section when the section has none of that name.
    """
    rows = _knowhow(parsed)
    role = strip(or_blank("related_role"))
    general = F.when(role != "", F.concat(role, F.lit(fixed.KNOWHOW_DECISION_SUFFIX))).otherwise(F.lit(fixed.KNOWHOW_DECISION))
    rows = rows.withColumn("dname", F.coalesce(null_if_blank(strip(F.coalesce(null_if_blank("decision_name"), "decision", F.lit("")))), general))
    rows = rows.withColumn("dkey", F.lower(strip("dname")))
    own = decisions.groupBy("section_id", F.lower(strip("name")).alias("dkey")).agg(F.max_by("decision_id", "pos").alias("__own"))
    fresh = first_per_key(rows.join(own, ["section_id", "dkey"], "left_anti"), ["section_id", "dkey"], ["pos"])
    created = fresh.select(
        *SECTION, "pos", entity_id("section_id", "knowhow", "dkey").alias("decision_id"), F.col("dname").alias("name"),
        F.lit(fixed.KNOWHOW_DESCRIPTION).alias("description"), F.array().cast("array<string>").alias("input_data"),
        F.array(F.lit(fixed.KNOWHOW_OUTPUT)).alias("output_data"), "related_role", "dkey",
    )
    all_ids = own.select("section_id", "dkey", F.col("__own").alias("decision_id")).unionByName(created.select("section_id", "dkey", "decision_id"))
    rules = rows.join(all_ids, ["section_id", "dkey"]).select(
        *SECTION, "pos", entity_id("section_id", "knowhow_rule", F.col("pos").cast("string")).alias("rule_id"), "decision_id",
        F.lit(fixed.KNOWHOW_WHEN).alias("when"), F.col("knowhow").alias("then"), F.lit(fixed.KNOWHOW_CONFIDENCE).alias("confidence"),
    )
    made = _resolve(created, F.lower(strip(or_blank("related_role"))), _names(roles, "role_id"), "role_id").where("role_id IS NOT NULL")
    return rules, created.drop("related_role", "dkey"), made.select("role_id", "decision_id").distinct()


def to_skills(parsed: DataFrame, roles: DataFrame, reusable_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """Skill rows and (role_id, skill_id) links from payload and mapping pairs. Optional: the default
    pipeline folds skills into tasks and rules instead."""
    rows = rows_of(parsed, "skills").withColumn("name", F.coalesce("name", F.lit("Skill")))
    if reusable_only:
        rows = rows.where(reusable_skill("name", "summary", "purpose"))
    rows = rows.withColumn("skill_id", entity_id("section_id", "skill", "name", F.col("pos").cast("string")))
    texts = F.array().cast("array<string>")
    skills = rows.select(
        *SECTION, "pos", "skill_id", "name", F.coalesce("summary", "description", F.lit("")).alias("summary"),
        F.coalesce("purpose", "summary", F.lit("")).alias("purpose"),
        F.coalesce("inputs", F.create_map().cast("map<string,string>")).alias("inputs"),
        F.coalesce("outputs", F.create_map().cast("map<string,string>")).alias("outputs"),
        F.coalesce("preconditions", texts).alias("preconditions"),
        F.filter(F.transform(F.coalesce("procedure", texts), lambda x: strip(or_blank(x))), lambda x: x != "").alias("procedure"),
        F.coalesce("exceptions", texts).alias("exceptions"), F.coalesce("tools", texts).alias("tools"), F.lit("").alias("md_path"),
    )
    direct = _resolve(rows, F.lower(strip(or_blank("related_role"))), _names(roles, "role_id"), "role_id").select("role_id", "skill_id")
    pairs = rows_of(parsed, "role_skill_mappings").withColumn("__skill", F.lower(strip(or_blank("skill_name"))))
    named = rows.groupBy("section_id", F.lower(strip("name")).alias("__skill")).agg(F.max_by("skill_id", "pos").alias("skill_id"))
    mapped = _resolve(pairs.where("__skill <> ''"), F.lower(strip(or_blank("role_name"))), _names(roles, "role_id"), "role_id").join(named, ["section_id", "__skill"])
    links = direct.unionByName(mapped.select("role_id", "skill_id")).where("role_id IS NOT NULL").distinct()
    return skills, links


# Flows ----------------------------------------------------------------------------------------------


def resolve_flow_ends(parsed: DataFrame, tasks: DataFrame, gateways: DataFrame) -> DataFrame:
    """Flows with both ends found: a task first, else a gateway, whose name equals, contains or is
    contained in the given one; placeholders among the conditions become blank."""
    rows = rows_of(parsed, "sequence_flows").select(
        *SECTION, "pos", _first_words("from_task").alias("from_name"), _first_words("to_task").alias("to_name"), clean_condition("condition").alias("condition")
    )
    nodes = tasks.select("section_id", "name", "pos", "task_id").withColumn("rank", F.lit(0))
    gates = gateways.where(~blank("name")).groupBy("section_id", F.lower(strip("name")).alias("name")).agg(
        F.min("pos").alias("pos"), F.max_by("gateway_id", "pos").alias("task_id")
    ).withColumn("rank", F.lit(1))
    both = nodes.unionByName(gates.select("section_id", "name", "pos", "task_id", "rank"))
    # Tasks sort before gateways when the rank leads the position.
    ranked = both.withColumn("pos", F.struct("rank", "pos"))
    ends = union_all([rows.select("section_id", F.col(c).alias("term")) for c in ("from_name", "to_name")])
    # Both ends are looked up in it: names are compared once.
    found = settle(_first_named(ends, ranked, "term", both_ways=True).select(
        "section_id", "term", F.when(F.col("task_pos.rank") == 0, "task").otherwise("gateway").alias("type"), F.col("task_id").alias("id")
    ))
    src = found.select("section_id", F.col("term").alias("from_name"), F.col("type").alias("from_type"), F.col("id").alias("from_id"))
    dst = found.select("section_id", F.col("term").alias("to_name"), F.col("type").alias("to_type"), F.col("id").alias("to_id"))
    return rows.join(src, ["section_id", "from_name"]).join(dst, ["section_id", "to_name"]).select(
        *SECTION, "pos", "from_type", "from_id", "to_type", "to_id", "condition"
    )


def synthesize_gateways(parsed: DataFrame, tasks: DataFrame, gateways: DataFrame, flows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New gateways and the rewritten flows of sections that have none.

    A task whose conditional flows go to two or more targets gets an exclusive gateway: its
    conditional flows to tasks give way to task to gateway and gateway to target.
    """
    rows = rows_of(parsed, "sequence_flows").select(
        *SECTION, "pos", F.lower(strip(or_blank("from_task"))).alias("from_name"), F.lower(strip(or_blank("to_task"))).alias("to_name"), strip(or_blank("condition")).alias("condition")
    )
    bare = rows.join(gateways.select("section_id"), "section_id", "left_anti").where("from_name <> '' AND to_name <> '' AND condition <> ''")
    by_name = tasks.groupBy("section_id", F.lower(strip("name")).alias("name")).agg(
        F.max_by(F.struct("task_id", "process_id"), "pos").alias("t")
    )
    forks = bare.groupBy(*SECTION, "from_name").agg(F.count_distinct("to_name").alias("n"), F.min("pos").alias("pos")).where("n >= 2")
    forks = forks.join(by_name.withColumnRenamed("name", "from_name"), ["section_id", "from_name"])
    question = F.concat(F.col("from_name"), F.lit("인지 여부를 판단한다."))
    forks = with_gateway_name(forks, "name", F.concat(F.col("from_name"), F.lit(" " + fixed.BRANCH_WORD)), question, F.lit(1))
    # Gateways, removed flows and both kinds of new flows are read from it.
    forks = settle(forks.select(
        *SECTION, "pos", "from_name", F.col("t.task_id").alias("src_id"), entity_id("section_id", "gateway", "from_name", F.lit("fork")).alias("gateway_id"),
        F.col("t.process_id").alias("process_id"), "name",
    ))
    made = forks.select(
        *SECTION, "pos", "gateway_id", "process_id", "name", F.lit("exclusive").alias("gateway_type"), F.lit("").alias("condition"),
        F.lit(fixed.SYNTHETIC_GATEWAY_DESCRIPTION).alias("description"),
    )
    gone = (F.col("to_type") == "task") & (F.col("condition") != "")
    sources = forks.select(F.col("src_id").alias("from_id")).distinct().withColumn("__fork", F.lit(True))
    # One join over all flows, which are read once: a flow goes if it is conditional, ends in a task and leaves a fork.
    kept = flows.where(gone.isNotNull()).join(sources, "from_id", "left").where(~gone | F.col("__fork").isNull()).select(*flows.columns)
    into = forks.select(
        *SECTION, "pos", F.lit("task").alias("from_type"), F.col("src_id").alias("from_id"), F.lit("gateway").alias("to_type"),
        F.col("gateway_id").alias("to_id"), F.lit("").alias("condition"),
    )
    targets = by_name.select("section_id", F.col("name").alias("to_name"), F.col("t.task_id").alias("to_id"))
    out = (
        bare.drop("section_no", "scope").join(forks.drop("pos"), ["section_id", "from_name"]).join(targets, ["section_id", "to_name"])
        .groupBy(*SECTION, "gateway_id", "to_id", "condition").agg(F.min("pos").alias("pos"))
        .select(*SECTION, "pos", F.lit("gateway").alias("from_type"), F.col("gateway_id").alias("from_id"), F.lit("task").alias("to_type"), "to_id", "condition")
    )
    return made, union_all([kept.select(*flows.columns), into.select(*flows.columns), out.select(*flows.columns)])


def binary_branch_conditions(flows: DataFrame, gateways: DataFrame, order: Sequence[str] = ("pos", "to_id")) -> DataFrame:
    """Clean the conditions behind exclusive gateways that branch; a two-way branch with blanks gets
    the yes and no text of the gateway's subject."""
    # Counted and filled: worked out once.
    flows = settle(flows)
    named = gateways.where("gateway_type = 'exclusive'").select(F.col("gateway_id").alias("from_id"), "name", "description")
    named = with_branch_conditions(named, "__yes", "__no", F.col("name"), F.col("description")).drop("name", "description")
    size = flows.where("from_type = 'gateway'").groupBy("from_id").agg(
        F.count(F.lit(1)).alias("__n"), F.min(F.struct(*order)).alias("__first")
    )
    joined = flows.join(size.where("__n >= 2").join(named, "from_id"), "from_id", "left")
    cleaned = F.when(F.col("__n").isNotNull() & compact("condition").isin(fixed.PLACEHOLDER_CONDITIONS), F.lit("")).otherwise(F.col("condition"))
    first = F.struct(*[F.col(o) for o in order]) == F.col("__first")
    filled = F.when((F.col("__n") == 2) & (cleaned == ""), F.when(first, F.col("__yes")).otherwise(F.col("__no"))).otherwise(cleaned)
    return joined.withColumn("condition", filled).select(*flows.columns)


def hint_flows(tasks: DataFrame) -> DataFrame:
    """Flows to the first task of the section whose name equals or contains the next-task hint."""
    hints = tasks.select(*SECTION, "pos", F.col("task_id").alias("from_id"), _first_words("next_task").alias("term")).where("term <> ''")
    found = hints.join(_first_named(hints, tasks, "term").select("section_id", "term", F.col("task_id").alias("to_id")), ["section_id", "term"])
    return found.select(
        *SECTION, "pos", F.lit("task").alias("from_type"), "from_id", F.lit("task").alias("to_type"), "to_id", F.lit("").alias("condition")
    )


def default_flows(tasks: DataFrame, flows: DataFrame) -> DataFrame:
    """Flows between consecutive tasks of a process within a section, unless that pair has one."""
    own = tasks.withColumn("__proc", F.coalesce(null_if_blank("process_id"), F.lit("default")))
    chained = scan(own, ["section_id", "__proc"], ["order", "pos"], lead={"to_id": "task_id"}).where("to_id IS NOT NULL")
    fresh = chained.withColumnRenamed("task_id", "from_id").join(flows.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti")
    return fresh.select(
        *SECTION, "pos", F.lit("task").alias("from_type"), "from_id", F.lit("task").alias("to_type"), "to_id", F.lit("").alias("condition")
    )


def entity_evidence_map(entities: Mapping[str, tuple[DataFrame, str]], section_chunk: DataFrame) -> DataFrame:
    """(entity_type, entity_id, chunk_id) for every entity whose section has a source chunk."""
    rows = union_all([df.select(F.lit(kind).alias("entity_type"), F.col(key).alias("entity_id"), "section_id") for kind, (df, key) in entities.items()])
    return rows.join(section_chunk.where("chunk_id IS NOT NULL").select("section_id", "chunk_id"), "section_id").drop("section_id")


def convert(sections: DataFrame, section_chunk: DataFrame | None = None) -> dict[str, DataFrame]:
    """All entity and relation tables of the sections' payloads, flows included."""
    # Every table below reads one or two of the arrays; parsed once, they are columns of a table.
    parsed = settle(parse_candidates(sections))
    processes = to_processes(parsed)
    roles = to_roles(parsed)
    # Tasks, gateways and flows are each read by several of the steps below.
    tasks = settle(apply_task_process_mappings(parsed, settle(to_tasks(parsed, processes)), processes))
    task_role = apply_task_role_mappings(parsed, tasks, roles, link_performer(tasks, roles))
    gateways, events = settle(to_gateways(parsed, processes)), to_events(parsed, processes)
    decisions, makes = to_decisions(parsed, roles)
    rules = to_rules(parsed, decisions)
    extra_rules, extra_decisions, extra_makes = fold_knowhow_into_rules(parsed, decisions, roles)
    flows = resolve_flow_ends(parsed, tasks, gateways)
    made, flows = synthesize_gateways(parsed, tasks, gateways, flows)
    gateways = gateways.unionByName(made)
    flows = settle(binary_branch_conditions(flows, gateways).unionByName(hint_flows(tasks)))
    flows = flows.unionByName(default_flows(tasks, flows))
    out = {
        "process": processes, "role": roles, "task": fold_knowhow_into_tasks(parsed, tasks), "gateway": gateways, "event": events,
        "decision": decisions.unionByName(extra_decisions), "rule": rules.unionByName(extra_rules), "task_role": task_role,
        "role_decision": makes.unionByName(extra_makes).distinct(), "flow": flows,
    }
    if section_chunk is not None:
        keys = {"process": "proc_id", "role": "role_id", "task": "task_id", "gateway": "gateway_id", "event": "event_id", "decision": "decision_id", "rule": "rule_id"}
        out["evidence"] = entity_evidence_map({k: (out[k], v) for k, v in keys.items()}, section_chunk)
    return out
