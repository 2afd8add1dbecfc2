"""Tables of the process graph: columns, keys, allowed values and edge types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AUDIT = "version int, created_by string, approved_by string, approved_at timestamp, created_at timestamp"

TABLES: dict[str, str] = {
    "document": "doc_id string, title string, source string, page_count int, uploaded_at timestamp",
    "section": "section_id string, doc_id string, heading string, level int, page_from int, page_to int, content string",
    "chunk": "chunk_id string, doc_id string, page int, span_start int, span_end int, text string, hash string, embedding array<float>",
    "process": "proc_id string, name string, purpose string, triggers array<string>, outcomes array<string>, description string",
    "task": "task_id string, process_id string, name string, task_type string, description string, instruction string, order int",
    "role": "role_id string, name string, org_unit string, persona_hint string",
    "gateway": "gateway_id string, process_id string, name string, gateway_type string, condition string, description string",
    "event": "event_id string, process_id string, event_type string, name string, trigger string",
    "skill": "skill_id string, name string, summary string, purpose string, inputs map<string,string>, outputs map<string,string>,"
    " preconditions array<string>, procedure array<string>, exceptions array<string>, tools array<string>, md_path string",
    "decision": "decision_id string, name string, description string, input_data array<string>, output_data array<string>",
    "rule": "rule_id string, decision_id string, when string, then string, confidence double",
    "ambiguity": "amb_id string, entity_type string, entity_id string, question string, options array<string>, status string,"
    " answer string, created_at timestamp, resolved_at timestamp",
    "agent": "agent_id string, name string, role string, tenant_id string",
    "alias": "alias_id string, entity_type string, entity_id string, text string, normalized string",
    "conflict": "conflict_id string, entity_type string, left_id string, right_id string, description string, status string",
    "evidence": "evidence_id string, entity_type string, entity_id string, chunk_id string, confidence double",
    "fragment": "fragment_id string, proc_id string, fragment_type string, text string, confidence double",
}
EDGES = "src_type string, src_id string, rel string, dst_type string, dst_id string, condition string"

KEYS: dict[str, str] = {name: ddl.split(" ", 1)[0] for name, ddl in TABLES.items()}

ENUMS: dict[tuple[str, str], list[str]] = {
    ("task", "task_type"): ["human", "agent", "system"],
    ("gateway", "gateway_type"): ["exclusive", "parallel", "inclusive"],
    ("event", "event_type"): ["start", "end", "intermediate"],
    ("ambiguity", "status"): ["open", "resolved", "pending"],
    ("fragment", "fragment_type"): ["overview", "detail", "exception", "note"],
}

# Edge types with the label pairs they join.
RELATIONS: dict[str, list[tuple[str, str]]] = {
    "HAS_SECTION": [("document", "section")],
    "FROM_DOCUMENT": [("chunk", "document")],
    "HAS_TASK": [("process", "task")],
    "HAS_GATEWAY": [("process", "gateway")],
    "HAS_EVENT": [("process", "event")],
    "PERFORMED_BY": [("task", "role")],
    "USES_SKILL": [("task", "skill"), ("agent", "skill")],
    "HAS_SKILL": [("role", "skill"), ("process", "skill")],
    "USES_DECISION": [("process", "decision"), ("skill", "decision")],
    "MAKES_DECISION": [("role", "decision")],
    "HAS_RULE": [("decision", "rule")],
    "SUPPORTED_BY": [(t, "chunk") for t in ("process", "task", "role", "gateway", "event", "skill", "decision", "rule")],
    "NEXT": [(a, b) for a in ("task", "gateway", "event") for b in ("task", "gateway", "event")],
    "ASSIGNED_AGENT": [("role", "agent")],
    "HAS_SNAPSHOT": [("run", "snapshot")],
    "HAS_INSTRUCTION": [("task", "instruction")],
}
FLOW_LABELS = ["task", "gateway", "event"]
EVIDENCE_LABELS = [a for a, _ in RELATIONS["SUPPORTED_BY"]]
CORE_LABELS = ["process", "task", "role", "agent", "gateway", "event", "skill", "decision", "rule"]

ELEMENTS = (
    "proc_id string, pos long, element_type string, id string, name string, type string, role string, source string,"
    " target string, condition string, description string, instruction string"
)
JOB_EVENTS = "job_id string, ts timestamp, status string, step string, progress int, message string"


def struct_of(name: str) -> T.StructType:
    return T._parse_datatype_string(TABLES[name] if name in TABLES else name)


def empty(spark: SparkSession, name: str) -> DataFrame:
    ddl = {"edges": EDGES, "elements": ELEMENTS, "job_events": JOB_EVENTS}.get(name) or TABLES[name]
    return spark.createDataFrame([], ddl)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Declared columns in order; missing ones become typed nulls."""
    fields = T._parse_datatype_string({"edges": EDGES, "elements": ELEMENTS}.get(name) or TABLES[name]).fields
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in fields
        ]
    )


def enum_violations(df: DataFrame, name: str) -> DataFrame:
    """Rows whose coded columns hold a value that is not allowed."""
    bad: Column = F.lit(False)
    for (table, column), allowed in ENUMS.items():
        if table == name:
            bad = bad | (F.col(column).isNotNull() & ~F.col(column).isin(allowed))
    return df.where(bad)


def edge(rel: str, src_type: str, src: Column | str, dst_type: str, dst: Column | str, condition: Column | None = None) -> list[Column]:
    """Columns of an edge row for a select."""
    c = lambda v: (F.col(v) if isinstance(v, str) else v).cast("string")
    return [
        F.lit(src_type).alias("src_type"),
        c(src).alias("src_id"),
        F.lit(rel).alias("rel"),
        F.lit(dst_type).alias("dst_type"),
        c(dst).alias("dst_id"),
        (condition if condition is not None else F.lit(None)).cast("string").alias("condition"),
    ]
