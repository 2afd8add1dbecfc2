"""Graph query registrations (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from procweave.operators import queries as q
from procweave.operators.graph import union_all
from procweave.plans.base import query
from procweave.plans.readings import SQL_FLOW, SQL_GRAPH, flow_graph, flow_next_edges, property_graph, table

_DETAIL = """
d_role AS (SELECT DISTINCT process_id AS proc_id, role_id AS id FROM performed),
d_agent AS (SELECT DISTINCT proc_id, agent_id AS id FROM d_role JOIN assigned ON role_id = id),
d_skill AS (SELECT proc_id, skill_id AS id FROM has_skill UNION SELECT proc_id, skill_id FROM d_agent JOIN uses ON agent_id = id),
detail AS (
  SELECT process_id AS proc_id, 'task' AS kind, task_id AS id, name FROM task
  UNION ALL SELECT process_id, 'gateway', gateway_id, name FROM gateway
  UNION ALL SELECT process_id, 'event', event_id, name FROM event
  UNION ALL SELECT proc_id, 'role', id, name FROM d_role JOIN role ON role_id = id
  UNION ALL SELECT proc_id, 'agent', id, name FROM d_agent JOIN agent ON agent_id = id
  UNION ALL SELECT proc_id, 'skill', id, name FROM d_skill JOIN skill ON skill_id = id)
"""


@query(
    "g1_list_processes",
    f"""WITH {SQL_GRAPH} SELECT proc_id, name, coalesce(purpose, '') AS purpose, '' AS description, coalesce(n, 0) AS n_tasks
        FROM process LEFT JOIN (SELECT process_id, count(DISTINCT task_id) AS n FROM task GROUP BY 1) t ON process_id = proc_id""",
)
def g1(spark, sf_dir):
    return q.list_processes(property_graph(spark, sf_dir))


def stored_graph(spark, sf_dir):
    """The property graph with its edges as a stored table, for queries that read them many times."""
    return q.store(property_graph(spark, sf_dir))


@query("g2_process_detail", f"WITH {SQL_GRAPH}, {_DETAIL} SELECT * FROM detail")
def g2(spark, sf_dir):
    return q.process_detail(stored_graph(spark, sf_dir))


@query(
    "g3_process_entities",
    f"""WITH {SQL_GRAPH}, {_DETAIL}
        SELECT proc_id, kind, id, d.name, CASE kind WHEN 'task' THEN task_type WHEN 'gateway' THEN 'exclusive' WHEN 'event' THEN 'start' END AS subtype,
               coalesce("order", 0) AS position, role_id
        FROM detail d LEFT JOIN (SELECT task_id, max(task_type) AS task_type, max("order") AS "order" FROM task GROUP BY 1) t ON kind = 'task' AND t.task_id = id
        LEFT JOIN (SELECT DISTINCT task_id, role_id FROM performed) p ON kind = 'task' AND p.task_id = id
        WHERE kind IN ('task', 'gateway', 'event', 'role')""",
)
def g3(spark, sf_dir):
    return q.process_entities(property_graph(spark, sf_dir))


_NEIGHBOURS = """
nb AS (SELECT DISTINCT src_id AS task_id, 'next' AS direction, t.name AS neighbour FROM nxt JOIN task t ON t.task_id = dst_id WHERE src_type = 'task' AND dst_type = 'task'
       UNION SELECT DISTINCT dst_id, 'prev', t.name FROM nxt JOIN task t ON t.task_id = src_id WHERE src_type = 'task' AND dst_type = 'task')
"""


@query(
    "g4_list_tasks",
    f"""WITH {SQL_FLOW}, {_NEIGHBOURS},
        c AS (SELECT task_id, count(*) FILTER (direction = 'next') AS n_next, count(*) FILTER (direction = 'prev') AS n_prev FROM nb GROUP BY 1)
        SELECT t.task_id, t.name, t."order", role_id, role_id AS role_name, process_id AS proc_id, p.name AS process_name,
               CASE WHEN k.chunk_id IS NOT NULL THEN 1 END AS evidence_page, left(k.text, 200) AS evidence_text,
               coalesce(n_next, 0) AS n_next, coalesce(n_prev, 0) AS n_prev
        FROM task t JOIN role_of r ON r.name = t.name JOIN process p ON p.proc_id = t.process_id
        LEFT JOIN proof USING (task_id) LEFT JOIN chunk k ON k.chunk_id = proof.chunk_id LEFT JOIN c USING (task_id)""",
)
def g4(spark, sf_dir):
    return q.list_tasks(flow_graph(spark, sf_dir))


@query("g4_task_neighbours", f"WITH {SQL_FLOW}, {_NEIGHBOURS} SELECT * FROM nb")
def g4_neighbours(spark, sf_dir):
    return q.task_neighbours(flow_graph(spark, sf_dir))


_TASK_KEYS = "keys AS (SELECT DISTINCT event_type AS key FROM events UNION SELECT DISTINCT 'u' || user_id || ':' FROM events UNION SELECT task_id FROM task WHERE name = 'view')"


def _task_keys(g):
    names = g["task"].select(F.col("name").alias("key"))
    prefixes = g["process"].select(F.concat("proc_id", F.lit(":")).alias("key"))
    return union_all([names, prefixes, g["task"].where("name = 'view'").select(F.col("task_id").alias("key"))]).distinct()


@query(
    "g5_task_detail",
    f"""WITH {SQL_FLOW}, {_TASK_KEYS},
        m AS (SELECT key, task_id, CASE WHEN key = task_id THEN 0 ELSE 1 END AS rank FROM keys JOIN task ON contains(task_id, key) OR contains(name, key)),
        f AS (SELECT key, task_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank, task_id) AS rn FROM m) WHERE rn = 1)
        SELECT key, f.task_id, 'task' AS kind, f.task_id AS item_id, name AS item_name FROM f JOIN task USING (task_id)
        UNION ALL SELECT key, f.task_id, 'role', role_id, role_id FROM f JOIN task USING (task_id) JOIN role_of r ON r.name = task.name
        UNION ALL SELECT key, f.task_id, 'process', proc_id, p.name FROM f JOIN task USING (task_id) JOIN process p ON proc_id = process_id
        UNION ALL SELECT key, f.task_id, 'evidence', chunk_id, text FROM f JOIN proof USING (task_id) JOIN chunk USING (chunk_id)
        UNION ALL SELECT key, f.task_id, 'next', dst_id, t.name FROM f JOIN nxt ON src_id = f.task_id AND dst_type = 'task' JOIN task t ON t.task_id = dst_id
        UNION ALL SELECT key, f.task_id, 'prev', src_id, t.name FROM f JOIN nxt ON dst_id = f.task_id AND src_type = 'task' JOIN task t ON t.task_id = src_id""",
)
def g5(spark, sf_dir):
    g = flow_graph(spark, sf_dir)
    return q.task_detail(g, _task_keys(g))


@query(
    "g6_element_lookup",
    f"""WITH {SQL_FLOW},
        keys AS (SELECT DISTINCT unnest(['Activity_u' || user_id || ':c', 'Gateway_branch_u' || user_id, 'Event_begin_u' || user_id, 'StartEvent_begin_u' || user_id]) AS key FROM events),
        terms AS (SELECT key, replace(replace(key, 'Activity_', ''), '_', ' ') AS t0, replace(replace(key, 'Gateway_', ''), '_', ' ') AS t1,
                  replace(replace(replace(replace(key, 'Event_', ''), 'StartEvent_', ''), 'EndEvent_', ''), '_', ' ') AS t2 FROM keys),
        h AS (SELECT key, 'task' AS element_type, task_id AS element_id, 0 AS rank, process_id, role_id FROM terms JOIN task ON contains(task_id, t0) OR contains(name, t0) JOIN role_of r ON r.name = task.name
              UNION ALL SELECT key, 'gateway', gateway_id, 1, process_id, NULL FROM terms JOIN gateway ON contains(gateway_id, t1) OR contains(name, t1)
              UNION ALL SELECT key, 'event', event_id, 2, process_id, NULL FROM terms JOIN event ON contains(event_id, t2) OR contains(name, t2)),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank, element_id) AS rn FROM h) WHERE rn = 1)
        SELECT key, element_id IS NOT NULL AS found, element_type, element_id, process_id AS proc_id, role_id,
               CASE WHEN chunk_id IS NOT NULL THEN 1 END AS evidence_page
        FROM keys LEFT JOIN b USING (key) LEFT JOIN proof ON element_type = 'task' AND task_id = element_id""",
)
def g6(spark, sf_dir):
    g = flow_graph(spark, sf_dir)
    p = F.col("proc_id")
    keys = g["process"].select(
        F.explode(
            F.array(
                F.concat(F.lit("Activity_"), p, F.lit(":c")), F.concat(F.lit("Gateway_branch_"), p),
                F.concat(F.lit("Event_begin_"), p), F.concat(F.lit("StartEvent_begin_"), p),
            )
        ).alias("key")
    )
    return q.element_lookup(g, keys)


@query(
    "g7_list_roles",
    f"""WITH {SQL_GRAPH} SELECT r.role_id, r.name, coalesce(t.n, 0) AS n_tasks, coalesce(d.n, 0) AS n_decisions,
          CASE WHEN k.chunk_id IS NOT NULL THEN 1 END AS evidence_page, left(k.text, 200) AS evidence_text
        FROM role r LEFT JOIN (SELECT role_id, count(DISTINCT task_id) AS n FROM performed GROUP BY 1) t USING (role_id)
        LEFT JOIN (SELECT role_id, count(*) AS n FROM makes GROUP BY 1) d USING (role_id)
        LEFT JOIN chunk k ON k.chunk_id = r.role_id""",
)
def g7(spark, sf_dir):
    return q.list_roles(property_graph(spark, sf_dir))


@query(
    "g8_list_decisions",
    f"""WITH {SQL_GRAPH} SELECT d.decision_id, d.name, coalesce(r.n, 0) AS n_rules, coalesce(m.n, 0) AS n_roles,
          CAST(NULL AS INTEGER) AS evidence_page, CAST(NULL AS VARCHAR) AS evidence_text
        FROM decision d LEFT JOIN (SELECT decision_id, count(*) AS n FROM rule GROUP BY 1) r USING (decision_id)
        LEFT JOIN (SELECT decision_id, count(*) AS n FROM makes GROUP BY 1) m USING (decision_id)""",
)
def g8(spark, sf_dir):
    return q.list_decisions(property_graph(spark, sf_dir))


@query(
    "g8_decision_roles",
    f"WITH {SQL_GRAPH} SELECT DISTINCT decision_id, name AS role_name FROM makes JOIN role USING (role_id)",
)
def g8_roles(spark, sf_dir):
    return q.decision_roles(property_graph(spark, sf_dir))


@query(
    "g9_list_flows",
    f"""WITH {SQL_FLOW} SELECT p.name AS process_name, a."order" AS from_order, src_id AS from_task_id, a.name AS from_task,
          dst_id AS to_task_id, b.name AS to_task, condition
        FROM nxt JOIN task a ON a.task_id = src_id JOIN task b ON b.task_id = dst_id JOIN process p ON p.proc_id = a.process_id
        WHERE src_type = 'task' AND dst_type = 'task'""",
)
def g9(spark, sf_dir):
    return q.list_flows(flow_graph(spark, sf_dir))


_FLOW_NODES = """
fn AS (SELECT 'task' AS t, task_id AS id, name, process_id FROM task UNION ALL SELECT 'gateway', gateway_id, name, process_id FROM gateway
       UNION ALL SELECT 'event', event_id, name, process_id FROM event),
fl AS (SELECT a.process_id AS proc_id, src_type AS from_type, src_id AS from_id, a.name AS from_name, dst_type AS to_type, dst_id AS to_id, b.name AS to_name, condition
       FROM nxt JOIN fn a ON a.t = src_type AND a.id = src_id JOIN fn b ON b.t = dst_type AND b.id = dst_id AND b.process_id = a.process_id)
"""


@query("g10_flows", f"WITH {SQL_FLOW}, {_FLOW_NODES} SELECT * FROM fl")
def g10(spark, sf_dir):
    return q.flows(flow_graph(spark, sf_dir))


@query("g10_all_flows", f"WITH {SQL_FLOW}, {_FLOW_NODES} SELECT * EXCLUDE (proc_id) FROM fl")
def g10_all(spark, sf_dir):
    return q.flows(flow_graph(spark, sf_dir), within_process=False)


@query(
    "g11_graph_stats",
    f"""WITH {SQL_GRAPH} SELECT 'process' AS name, count(*) AS n FROM process UNION ALL SELECT 'task', count(*) FROM task
        UNION ALL SELECT 'role', count(*) FROM role UNION ALL SELECT 'gateway', count(*) FROM gateway UNION ALL SELECT 'event', count(*) FROM event
        UNION ALL SELECT 'decision', count(*) FROM decision UNION ALL SELECT 'rule', count(*) FROM rule UNION ALL SELECT 'skill', count(*) FROM skill
        UNION ALL SELECT 'document', 0 UNION ALL SELECT 'chunk', count(*) FROM chunk
        UNION ALL SELECT 'has_task', count(*) FROM task UNION ALL SELECT 'performed_by', count(*) FROM performed UNION ALL SELECT 'next', count(*) FROM nxt
        UNION ALL SELECT 'supported_by', count(*) FROM role_proof UNION ALL SELECT 'makes_decision', count(*) FROM makes""",
)
def g11(spark, sf_dir):
    return q.graph_stats(property_graph(spark, sf_dir))


_ELEMENTS = f"""
{_DETAIL},
told AS (SELECT process_id, task_id, instruction FROM task WHERE instruction IS NOT NULL),
pf AS (SELECT DISTINCT process_id, task_id, role_id FROM performed),
pa AS (SELECT DISTINCT process_id, role_id, agent_id FROM pf JOIN assigned USING (role_id)),
ps AS (SELECT DISTINCT process_id, agent_id, skill_id FROM pa JOIN uses USING (agent_id)),
el AS (
  SELECT proc_id AS graph_id, 'Process:' || proc_id AS elem_id, 'node' AS kind, 'Process' AS type, name AS label, NULL AS source, NULL AS target, NULL AS condition FROM process
  UNION ALL SELECT proc_id, upper(kind[1]) || kind[2:] || ':' || id, 'node', upper(kind[1]) || kind[2:], name, NULL, NULL, NULL FROM detail
  UNION ALL SELECT process_id, 'Instruction:' || task_id || ':instruction', 'node', 'Instruction', split_part(instruction, chr(10), 1), NULL, NULL, NULL FROM told
  UNION ALL SELECT process_id, 'HAS_TASK:' || process_id || '->' || task_id, 'edge', 'HAS_TASK', 'HAS_TASK', 'Process:' || process_id, 'Task:' || task_id, NULL FROM task
  UNION ALL SELECT process_id, 'HAS_GATEWAY:' || process_id || '->' || gateway_id, 'edge', 'HAS_GATEWAY', 'HAS_GATEWAY', 'Process:' || process_id, 'Gateway:' || gateway_id, NULL FROM gateway
  UNION ALL SELECT process_id, 'HAS_EVENT:' || process_id || '->' || event_id, 'edge', 'HAS_EVENT', 'HAS_EVENT', 'Process:' || process_id, 'Event:' || event_id, NULL FROM event
  UNION ALL SELECT process_id, 'PERFORMED_BY:' || task_id || '->' || role_id, 'edge', 'PERFORMED_BY', 'PERFORMED_BY', 'Task:' || task_id, 'Role:' || role_id, NULL FROM pf
  UNION ALL SELECT process_id, 'HAS_INSTRUCTION:Task:' || task_id, 'edge', 'HAS_INSTRUCTION', 'HAS_INSTRUCTION', 'Task:' || task_id, 'Instruction:' || task_id || ':instruction', NULL FROM told
  UNION ALL SELECT process_id, 'ASSIGNED_AGENT:' || role_id || '->' || agent_id, 'edge', 'ASSIGNED_AGENT', 'ASSIGNED_AGENT', 'Role:' || role_id, 'Agent:' || agent_id, NULL FROM pa
  UNION ALL SELECT process_id, 'USES_SKILL:Agent:' || agent_id || '->Skill:' || skill_id, 'edge', 'USES_SKILL', 'USES_SKILL', 'Agent:' || agent_id, 'Skill:' || skill_id, NULL FROM ps
  UNION ALL SELECT proc_id, 'HAS_SKILL:Process:' || proc_id || '->Skill:' || skill_id, 'edge', 'HAS_SKILL', 'HAS_SKILL', 'Process:' || proc_id, 'Skill:' || skill_id, NULL FROM has_skill
  UNION ALL SELECT process_id, 'NEXT:Task:' || src_id || '->Task:' || dst_id, 'edge', 'NEXT', '', 'Task:' || src_id, 'Task:' || dst_id, '' FROM chain WHERE dst_id IS NOT NULL)
"""


@query("g12_process_graph", f"WITH {SQL_GRAPH}, {_ELEMENTS} SELECT * FROM el")
def g12(spark, sf_dir):
    return q.process_graph(stored_graph(spark, sf_dir))


@query(
    "g12_graph_counts",
    f"WITH {SQL_GRAPH}, {_ELEMENTS} SELECT graph_id, count(*) FILTER (kind = 'node') AS n_nodes, count(*) FILTER (kind = 'edge') AS n_edges FROM el GROUP BY 1",
)
def g12_counts(spark, sf_dir):
    return q.graph_counts(q.process_graph(stored_graph(spark, sf_dir)))


@query(
    "g13_full_graph",
    f"""WITH {SQL_FLOW},
        n0 AS (SELECT 'process' AS type, proc_id AS id, name FROM process UNION ALL SELECT 'task', task_id, name FROM task
               UNION ALL SELECT DISTINCT 'role', role_id, role_id FROM role_of UNION ALL SELECT 'gateway', gateway_id, name FROM gateway
               UNION ALL SELECT 'event', event_id, name FROM event),
        n AS (SELECT * FROM n0 ORDER BY type, id LIMIT 600),
        e AS (SELECT 'HAS_TASK' AS rel, 'process' AS st, process_id AS s, 'task' AS dt, task_id AS d FROM task
              UNION ALL SELECT 'HAS_GATEWAY', 'process', process_id, 'gateway', gateway_id FROM gateway
              UNION ALL SELECT 'HAS_EVENT', 'process', process_id, 'event', event_id FROM event
              UNION ALL SELECT 'PERFORMED_BY', 'task', task_id, 'role', role_id FROM task JOIN role_of USING (name)
              UNION ALL SELECT 'NEXT', src_type, src_id, dst_type, dst_id FROM nxt)
        SELECT type || ':' || id AS elem_id, 'node' AS kind, type, name AS label, NULL AS source, NULL AS target FROM n
        UNION ALL SELECT rel || ':' || st || ':' || s || '->' || dt || ':' || d, 'edge', rel, rel, st || ':' || s, dt || ':' || d
        FROM e JOIN n a ON a.type = st AND a.id = s JOIN n b ON b.type = dt AND b.id = d""",
)
def g13(spark, sf_dir):
    return q.full_graph(flow_graph(spark, sf_dir), 600)


def _questions(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    open_ = F.col("quality") == 0
    return labels.select(
        F.concat(F.lit("q"), F.col("doc_id")).alias("amb_id"), F.lit("document").alias("entity_type"), F.col("doc_id").cast("string").alias("entity_id"),
        F.when(F.col("toxic") == 1, "toxic?").otherwise("usable?").alias("question"),
        F.when(open_, "open").otherwise("resolved").alias("status"), F.when(~open_, "yes").alias("answer"),
        F.timestamp_seconds(F.col("doc_id")).alias("created_at"), F.lit(None).cast("timestamp").alias("resolved_at"),
    )


@query(
    "g16_open_ambiguities",
    "SELECT 'q' || doc_id AS amb_id, CAST(doc_id AS VARCHAR) AS entity_id, CASE WHEN toxic = 1 THEN 'toxic?' ELSE 'usable?' END AS question FROM labels WHERE quality = 0",
)
def g16(spark, sf_dir):
    return q.open_ambiguities(_questions(spark, sf_dir)).select("amb_id", "entity_id", "question")


@query(
    "g16_resolve_ambiguity",
    """SELECT 'q' || doc_id AS amb_id, CASE WHEN quality = 0 AND toxic = 0 THEN 'open' ELSE 'resolved' END AS status,
              CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 1 THEN 'yes' END AS answer FROM labels""",
)
def g16_resolve(spark, sf_dir):
    questions = _questions(spark, sf_dir)
    answers = questions.where("question = 'toxic?'").select("amb_id", F.lit("reject").alias("answer"))
    return q.resolve_ambiguity(questions, answers, F.current_timestamp()).select("amb_id", "status", "answer")


@query("g17_review_progress", "SELECT count(*) FILTER (quality <> 0) AS n_resolved, count(*) AS n_total FROM labels")
def g17(spark, sf_dir):
    return q.review_progress(_questions(spark, sf_dir))


_CLOSURE = """
r AS (SELECT proc_id, source, target FROM ce UNION SELECT r.proc_id, r.source, ce.target FROM r JOIN ce ON ce.proc_id = r.proc_id AND ce.source = r.target)
"""
_ALL_EDGES = """
ce AS (SELECT DISTINCT a.process_id AS proc_id, src_id AS source, dst_id AS target FROM nxt JOIN task a ON a.task_id = src_id
       WHERE src_type = 'task' AND dst_type = 'task' AND src_id <> dst_id)
"""


_ACYCLIC = """
part AS (SELECT a.proc_id, a.source AS id, least(min(a.target), a.source) AS part FROM r a
         JOIN r b ON a.proc_id = b.proc_id AND a.source = b.target AND a.target = b.source WHERE a.source <> a.target GROUP BY a.proc_id, a.source),
e AS (SELECT ce.*, s.part AS sp, t.part AS tp, coalesce(s.part = t.part, false) AS inside FROM ce
      LEFT JOIN part s ON s.proc_id = ce.proc_id AND s.id = source LEFT JOIN part t ON t.proc_id = ce.proc_id AND t.id = target),
entry AS (SELECT DISTINCT proc_id, target AS id, tp AS part FROM e WHERE tp IS NOT NULL AND NOT inside),
d AS (SELECT proc_id, id, 0 AS far FROM entry
      UNION ALL SELECT DISTINCT proc_id, part, 0 FROM part WHERE (proc_id, part) NOT IN (SELECT proc_id, part FROM entry)),
w AS (SELECT * FROM d UNION SELECT w.proc_id, target, far + 1 FROM w JOIN e ON inside AND e.proc_id = w.proc_id AND source = w.id
      WHERE far < (SELECT max(n) FROM (SELECT count(*) AS n FROM part GROUP BY proc_id, part))),
place AS (SELECT proc_id, id, min(far) AS far FROM w GROUP BY ALL),
fe AS (SELECT e.proc_id, source, target FROM e LEFT JOIN place a ON a.proc_id = e.proc_id AND a.id = source LEFT JOIN place b ON b.proc_id = e.proc_id AND b.id = target
       WHERE NOT inside OR a.far < b.far OR (a.far = b.far AND source < target))
"""


def _log_edges(spark, sf_dir):
    e = flow_next_edges(spark, sf_dir).select(F.col("src_id").alias("source"), F.col("dst_id").alias("target")).distinct()
    return e.select(F.substring_index("source", ":", 1).alias("proc_id"), "source", "target")


@query(
    "g18_flow_chains",
    f"""WITH RECURSIVE {SQL_FLOW}, {_ALL_EDGES}, {_CLOSURE}, {_ACYCLIC},
        p AS (SELECT DISTINCT proc_id, source AS node, [source] AS path FROM fe WHERE (proc_id, source) NOT IN (SELECT proc_id, target FROM fe)
              UNION ALL SELECT p.proc_id, target, list_append(path, target) FROM p JOIN fe ON fe.proc_id = p.proc_id AND fe.source = p.node)
        SELECT proc_id, array_to_string(path, ' -> ') AS chain, CAST(len(path) - 1 AS INTEGER) AS length FROM p WHERE len(path) > 1
        ORDER BY length DESC, proc_id, path LIMIT 5""",
)
def g18(spark, sf_dir):
    return q.flow_chains(q.without_loops(_log_edges(spark, sf_dir).where("source <> target").distinct()), 5)


@query(
    "g19_predecessors",
    f"WITH RECURSIVE {SQL_FLOW}, {_ALL_EDGES}, {_CLOSURE} SELECT proc_id, target AS id, source AS predecessor FROM r WHERE source <> target",
)
def g19(spark, sf_dir):
    tasks = flow_graph(spark, sf_dir)["task"].select(F.col("process_id").alias("proc_id"), F.col("task_id").alias("id"), F.col("order").alias("pos"))
    return q.predecessors(tasks, _log_edges(spark, sf_dir))[0]


@query(
    "g19_list_order_fallback",
    """SELECT conv_id AS proc_id, conv_id || ':' || turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n_before FROM conversations""",
)
def g19_fallback(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("proc_id"), F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("turn").alias("pos"))
    none = spark.createDataFrame([], "proc_id long, source string, target string")
    return q.predecessors(turns, none)[1]


@query(
    "g20_flow_layers",
    f"""WITH RECURSIVE {SQL_FLOW}, {_ALL_EDGES}, {_CLOSURE},
        {_ACYCLIC},
        l AS (SELECT DISTINCT proc_id, source AS id, 0 AS layer FROM ce WHERE (proc_id, source) NOT IN (SELECT proc_id, target FROM fe)
              UNION SELECT l.proc_id, fe.target, l.layer + 1 FROM l JOIN fe ON fe.proc_id = l.proc_id AND fe.source = l.id)
        SELECT proc_id, id, max(layer) AS layer FROM l GROUP BY ALL""",
)
def g20(spark, sf_dir):
    return q.flow_layers(_log_edges(spark, sf_dir))


@query(
    "g21_model_listing",
    """SELECT CAST(o_orderkey AS VARCHAR) AS proc_id, o_orderpriority AS name,
              row_number() OVER (ORDER BY o_orderpriority, CAST(o_orderkey AS VARCHAR)) = 1 AS is_default FROM orders""",
)
def g21(spark, sf_dir):
    models = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("proc_id"), F.col("o_orderpriority").alias("name"))
    return q.model_listing(models)
