"""The whole run: documents to sections, candidates, resolved entities and graph edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procweave import schemas
from procweave.functions.text import or_blank, strip
from procweave.operators import artifacts, candidates, graph, resolve, segment
from procweave.session import settle


def document_graph(
    documents: DataFrame,
    payloads: Callable[[DataFrame], DataFrame] | None = None,
    scope: str = "document",
    chain: str = "always",
) -> dict[str, DataFrame]:
    """Node tables, edges and checks of (doc_id, pages) rows.

    ``payloads`` turns (section_id, content) into (section_id, payload); the default marks lines by
    patterns. ``scope`` is the document or the run, as far as names are known across sections. Processes, roles and
    tasks that are the same become one, tasks without a process join the first one, and tasks without a role get the one
    their text names.
    """
    found = segment.eligible_sections(segment.split_sections(documents))
    sections = settle(
        found.select(
            F.concat_ws("/", "doc_id", "section_no").alias("section_id"), (F.col("doc_id").cast("string") if scope == "document" else F.lit("run")).alias("scope"),
            F.col("section_no").cast("long").alias("section_no"), "doc_id", "page_from", "content",
        )
    )
    text = sections.select("section_id", "content")
    made = payloads(text) if payloads else candidates.default_payload(candidates.pattern_candidates(text))
    # A chunk's id holds its place, so equal texts of two documents stay two chunks.
    place = F.concat_ws("/", "doc_id", F.col("page").cast("string"), F.col("chunk_no").cast("string"), "hash")
    chunks = settle(segment.chunk_fixed(documents).withColumn("hash", F.md5(place)))
    first = segment.section_evidence_chunk(sections.select("section_id", "doc_id", "page_from"), chunks)
    section_chunk = first.select("section_id", F.col("evidence_hash").alias("chunk_id"))
    payload_rows = sections.select("section_id", "scope", "section_no").join(made, "section_id", "left")
    g = {k: settle(v) for k, v in candidates.convert(payload_rows, section_chunk).items()}
    g = merge_entities(g)
    node_tables = {k: g[k] for k in ("process", "task", "role", "gateway", "event", "decision", "rule")}
    chunk_rows = chunks.select(F.col("hash").alias("chunk_id"), "doc_id", "page", "text")
    nodes = graph.node_rows({**node_tables, "chunk": chunk_rows})
    membership = g["task"].where("process_id <> ''").select("task_id", "process_id")
    raw = graph.materialize_relations(g["task_role"], membership, g["role_decision"], g["evidence"].select("entity_id", "chunk_id"), nodes)
    flows = graph.explicit_flow_edges(g["flow"].select("from_id", "from_type", "to_id", "to_type", "condition", F.struct("section_no", "pos").alias("pos")))
    chained = graph.order_chain_edges(g["task"].where("process_id <> ''"), flows, mode=chain)
    for kind, rel in (("gateway", "HAS_GATEWAY"), ("event", "HAS_EVENT")):
        raw = raw.unionByName(graph.link_edges(g[kind].where("process_id <> ''"), rel, "process", "process_id", kind, f"{kind}_id"))
    raw = raw.unionByName(graph.link_edges(g["rule"].where("decision_id <> ''"), "HAS_RULE", "decision", "decision_id", "rule", "rule_id"))
    edges = graph.upsert_edges(schemas.empty(documents.sparkSession, "edges"), raw.unionByName(flows).unionByName(chained), nodes)
    return {
        **node_tables, "chunk": chunk_rows, "edges": settle(edges), "alias": g["alias"], "skill": artifacts.skill_rows(g["task"]),
        "decision_row": artifacts.decision_rows(g["decision"], g["rule"]), "coverage": artifacts.role_coverage(g["task"], g["task_role"], g["role"]),
        "question": artifacts.orphan_checks(g["task"], g["task_role"], g["flow"], F.current_timestamp()),
    }


def merge_entities(g: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Duplicates of a run as one: processes by similarity, roles by name, tasks greedily within process and role; all
    tables that refer to them follow."""
    g = dict(resolve.merge_processes(g))
    first = g["role"].groupBy(F.lower(strip(or_blank("name"))).alias("key")).agg(F.min("role_id").alias("new_id"))
    roles = settle(g["role"].withColumn("key", F.lower(strip(or_blank("name")))).join(first, "key").select(F.col("role_id").alias("old_id"), "new_id"))
    g["role"] = resolve.dedupe_by_name(g["role"], "role_id", [])
    for name in ("task_role", "role_decision"):
        g[name] = resolve.remap_ids(g[name], roles, "role_id").distinct()
    g["task"] = settle(graph.default_process(g["task"], g["process"]))
    named = g["task_role"].where("role_id IS NOT NULL").select("task_id", "role_id")
    guessed = graph.infer_task_roles(g["task"], named, g["role"].withColumn("org_unit", F.lit("")), "role_id")
    g["task_role"] = settle(named.unionByName(guessed).distinct())
    classes = settle(resolve.task_classes(g["task"], g["task_role"]))
    leaders = settle(resolve.merge_tasks_greedy(classes))
    merged, tasks = resolve.merge_task_content(g["task"], leaders)
    tasks = settle(tasks)
    g["task"], g["task_role"] = settle(merged), settle(resolve.carry_task_roles(g["task_role"], tasks))
    flow = resolve.remap_ids(resolve.remap_ids(g["flow"], tasks, "from_id"), tasks, "to_id")
    # A flow between tasks that became one is none.
    g["flow"] = settle(flow.where("from_id <> to_id"))
    g["evidence"] = resolve.remap_ids(resolve.remap_ids(g["evidence"], tasks, "entity_id"), roles, "entity_id").distinct()
    return g
