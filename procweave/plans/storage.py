"""Store, source and edge construction queries (A, F, G14, G15)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from procweave import schemas
from procweave.operators import graph as gr
from procweave.operators import queries as q
from procweave.plans.base import query
from procweave.plans.readings import SQL_FLOW, SQL_GRAPH, flow_graph, flow_next_edges, flow_tasks, property_graph, table
from procweave.session import shared_dir
from procweave.sources import documents, exports, snapshots


def _requests(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    item = F.struct(F.col("url").alias("fileUrl"), F.concat(F.lit("p"), F.col("page_id")).alias("fileName"))
    body = F.struct(F.struct(F.lit(" ").alias("url"), F.col("url").alias("path")).alias("file"), F.array(item, F.struct(F.concat("url", F.lit("#2")).alias("fileUrl"), F.lit("n2").alias("fileName"))).alias("files"), F.col("url").alias("pdf_url"))
    return pages.select(F.col("page_id").alias("request_id"), F.to_json(body).alias("payload"))


@query("a2_normalize_file_list", """SELECT page_id AS request_id, url, '' AS name FROM pages UNION ALL SELECT page_id, url || '#2', 'n2' FROM pages""")
def a2(spark, sf_dir):
    return documents.normalize_file_list(_requests(spark, sf_dir)).select("request_id", "url", "name")


@query(
    "a3_upsert_nodes",
    """SELECT c_custkey AS id, 'store' AS origin, c_acctbal AS amount FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
       UNION ALL SELECT o_custkey, 'order', arg_max(o_totalprice, o_orderkey) FROM orders GROUP BY o_custkey""",
)
def a3(spark, sf_dir):
    store = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("store").alias("origin"), F.col("c_acctbal").alias("amount"))
    incoming = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.lit("order").alias("origin"), F.col("o_totalprice").alias("amount"), F.col("o_orderkey").alias("seq"))
    return gr.upsert_nodes(store, incoming, "id", "seq")


@query("a4_upsert_edges", f"WITH {SQL_FLOW} SELECT src_id, dst_id, condition FROM nxt WHERE src_type = 'task' AND dst_type = 'task'")
def a4(spark, sf_dir):
    nodes = gr.node_rows({"task": flow_tasks(spark, sf_dir)})
    edges = gr.upsert_edges(schemas.empty(spark, "edges"), flow_next_edges(spark, sf_dir), nodes, "seq")
    return edges.select("src_id", "dst_id", "condition")


@query(
    "a5_upsert_by_composite_key",
    """WITH s AS (SELECT c_nationkey AS tenant, c_mktsegment AS activity, min(c_custkey) AS uid FROM customer GROUP BY ALL), i AS (SELECT s_nationkey AS tenant, 'MACHINERY' AS activity, min(s_suppkey) + 1000000 AS uid FROM supplier GROUP BY ALL)
       SELECT tenant, activity, uid, 'old' AS origin FROM s WHERE (tenant, activity) NOT IN (SELECT (tenant, activity) FROM i)
       UNION ALL SELECT tenant, activity, coalesce(s.uid, i.uid), 'new' FROM i LEFT JOIN s USING (tenant, activity)""",
)
def a5(spark, sf_dir):
    store = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("tenant"), F.col("c_mktsegment").alias("activity")).agg(F.min("c_custkey").alias("uid")).withColumn("origin", F.lit("old"))
    incoming = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("tenant")).agg((F.min("s_suppkey") + 1000000).alias("uid")).withColumn("activity", F.lit("MACHINERY")).withColumn("origin", F.lit("new"))
    return gr.upsert_by_composite_key(store, incoming, ["tenant", "activity"], "uid")


_LABELS = ["decision", "rule", "gateway"]


@query("a6_delete_by_label", f"WITH {SQL_GRAPH} SELECT 'decision' AS type, count(*) AS deleted FROM decision UNION ALL SELECT 'rule', count(*) FROM rule UNION ALL SELECT 'gateway', count(*) FROM gateway")
def a6(spark, sf_dir):
    g = property_graph(spark, sf_dir)
    return gr.delete_by_label(gr.node_rows({k: v for k, v in g.items() if k != "edges"}), g["edges"], _LABELS)[2]


@query(
    "a6_remaining_edges",
    f"""WITH {SQL_GRAPH} SELECT 'HAS_TASK' AS rel, count(*) AS n FROM task UNION ALL SELECT 'PERFORMED_BY', count(*) FROM performed UNION ALL SELECT 'HAS_EVENT', count(*) FROM event
        UNION ALL SELECT 'ASSIGNED_AGENT', count(*) FROM assigned UNION ALL SELECT 'USES_SKILL', count(*) FROM uses UNION ALL SELECT 'HAS_SKILL', count(*) FROM has_skill
        UNION ALL SELECT 'SUPPORTED_BY', count(*) FROM role_proof UNION ALL SELECT 'NEXT', count(*) FROM nxt""",
)
def a6_edges(spark, sf_dir):
    g = property_graph(spark, sf_dir)
    left = gr.delete_by_label(gr.node_rows({k: v for k, v in g.items() if k != "edges"}), g["edges"], _LABELS)[1]
    return left.groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


@query("a8_check_unique", """SELECT 'lineitem' AS label, l_orderkey || '-' || l_linenumber AS key_value, count(*) AS n_rows FROM lineitem GROUP BY 2 HAVING count(*) > 1""")
def a8(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("k"))
    return gr.check_unique({"lineitem": (lines, "k"), "orders": (table(spark, sf_dir, "orders"), "o_orderkey"), "customer": (table(spark, sf_dir, "customer"), "c_custkey")})


# Snapshots: an order is a run of its customer; its line items are processes, the order date is the time.


def _runs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    run = F.concat_ws("-", F.concat(F.lit("t"), F.col("o_custkey")), "o_orderkey")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    runs = orders.select(
        run.alias("run_id"), F.when(urgent, F.concat(F.lit("t"), F.col("o_custkey"))).alias("task_id"),
        F.concat(F.lit("{\"for\": \"s"), F.col("o_custkey"), F.lit("\"}")).alias("metadata"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"),
    )
    whole = orders.select(run.alias("run_id"), F.lit("integrated").alias("snapshot_type"), F.lit("").alias("proc_id"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").cast("long").alias("n_elements"))
    lines = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    parts = lines.groupBy(run.alias("run_id"), F.concat(F.lit("p"), F.col("l_partkey")).alias("proc_id")).agg(F.max("l_shipdate").alias("created_at"), F.sum("l_quantity").cast("long").alias("n_elements"))
    return runs, whole.unionByName(parts.withColumn("snapshot_type", F.lit("process")))


_SNAP = """
run AS (SELECT 't' || o_custkey || '-' || o_orderkey AS run_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 't' || o_custkey END AS task_id, o_custkey, o_orderkey, o_orderdate, CAST(trunc(o_totalprice) AS BIGINT) AS n_elements FROM orders),
ps AS (SELECT run_id, 'p' || l_partkey AS proc_id, max(l_shipdate) AS created_at, CAST(sum(l_quantity) AS BIGINT) AS n_elements FROM lineitem JOIN run ON l_orderkey = o_orderkey GROUP BY 1, 2)
"""


@query(
    "a9_save_snapshot",
    f"""WITH {_SNAP} SELECT run_id, 'integrated' AS snapshot_type, '' AS proc_id, n_elements FROM run
        UNION ALL SELECT run_id, 'process', proc_id, CASE WHEN run_id IN (SELECT run_id FROM run WHERE task_id IS NOT NULL) THEN -1 ELSE n_elements END FROM ps""",
)
def a9(spark, sf_dir):
    runs, snaps = _runs(spark, sf_dir)
    again = snaps.where("snapshot_type = 'process'").join(runs.where("task_id IS NOT NULL").select("run_id"), "run_id", "left_semi").withColumn("n_elements", F.lit(-1).cast("long"))
    return snapshots.save_snapshots(snaps, again).select("run_id", "snapshot_type", "proc_id", "n_elements")


_ELEMENT_ROWS = """
old AS (SELECT 'r' || l_suppkey AS run_id, 'process' AS snapshot_type, 'p' || l_partkey AS proc_id, l_orderkey || '-' || l_linenumber AS elem_id, 'old' AS label FROM lineitem),
new AS (SELECT run_id, snapshot_type, proc_id, elem_id, 'new' AS label FROM old WHERE elem_id LIKE '%-1')
"""


@query(
    "a9_snapshot_elements",
    f"""WITH {_ELEMENT_ROWS} SELECT run_id, proc_id, elem_id, label FROM new
        UNION ALL SELECT run_id, proc_id, elem_id, label FROM old WHERE (run_id, proc_id) NOT IN (SELECT run_id, proc_id FROM new)""",
)
def a9_elements(spark, sf_dir):
    """All line items as elements of process snapshots; the snapshots that hold a first line are saved again with those lines only."""
    path = f"{shared_dir(spark).rstrip('/')}/elements-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("r"), "l_suppkey").alias("run_id"), F.lit("process").alias("snapshot_type"), F.concat(F.lit("p"), "l_partkey").alias("proc_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("elem_id"), F.lit("old").alias("label"),
    )
    snapshots.write_elements(rows, path)
    snapshots.write_elements(rows.where(F.col("elem_id").endswith("-1")).withColumn("label", F.lit("new")), path)
    return snapshots.read_elements(spark, path).select("run_id", "proc_id", "elem_id", "label")


@query("a10_load_snapshot", f"WITH {_SNAP} SELECT run_id, proc_id, n_elements FROM ps UNION ALL SELECT run_id, '', n_elements FROM run")
def a10(spark, sf_dir):
    _, snaps = _runs(spark, sf_dir)
    return snapshots.load_process(snaps).unionByName(snapshots.load_integrated(snaps)).select("run_id", "proc_id", "n_elements")


@query(
    "a11_latest_snapshot",
    f"""WITH {_SNAP}, l AS (SELECT *, row_number() OVER (PARTITION BY proc_id ORDER BY created_at DESC, run_id DESC) AS rn FROM ps)
        SELECT proc_id, l.run_id, task_id, l.n_elements FROM l JOIN run USING (run_id) WHERE rn = 1
        UNION ALL (SELECT '', run_id, task_id, n_elements FROM run ORDER BY o_orderdate DESC, run_id DESC LIMIT 1)""",
)
def a11(spark, sf_dir):
    runs, snaps = _runs(spark, sf_dir)
    columns = ["proc_id", "run_id", "task_id", "n_elements"]
    return snapshots.latest_by_process(snaps, runs).select(*columns).unionByName(snapshots.latest_integrated(snaps, runs).select(*columns))


@query(
    "a12_integrated_snapshot_of_process",
    f"""WITH {_SNAP} SELECT source_proc_id, run_id, n_elements FROM (SELECT ps.proc_id AS source_proc_id, run.run_id, run.n_elements,
          row_number() OVER (PARTITION BY ps.proc_id ORDER BY o_orderdate DESC, run.run_id DESC) AS rn FROM ps JOIN run USING (run_id)) WHERE rn = 1""",
)
def a12(spark, sf_dir):
    _, snaps = _runs(spark, sf_dir)
    return snapshots.integrated_of_process(snaps).select("source_proc_id", "run_id", "n_elements")


@query(
    "a13_integrated_snapshot_of_task",
    f"""WITH {_SNAP}, asked AS (SELECT DISTINCT 't' || o_custkey AS task_id FROM orders UNION SELECT DISTINCT 's' || o_custkey || '"' FROM orders),
        h AS (SELECT a.task_id, run_id, 1 AS rank FROM asked a JOIN run USING (task_id)
              UNION ALL SELECT 't' || o_custkey, run_id, 2 FROM run UNION ALL SELECT 's' || o_custkey || '"', run_id, 3 FROM run)
        SELECT task_id, run_id, CAST(rank AS INTEGER) AS rank FROM (SELECT h.*, row_number() OVER (PARTITION BY h.task_id ORDER BY rank, o_orderdate DESC, h.run_id DESC) AS rn FROM h JOIN run USING (run_id)) WHERE rn = 1""",
)
def a13(spark, sf_dir):
    runs, snaps = _runs(spark, sf_dir)
    who = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    asked = who.select(F.explode(F.array(F.concat(F.lit("t"), F.col("o_custkey")), F.concat(F.lit("s"), F.col("o_custkey"), F.lit("\"")))).alias("task_id"))
    return snapshots.integrated_of_task(snaps, runs, asked).select("task_id", "run_id", "rank")


@query("a14_merge_by_id", "SELECT c_custkey AS id, 'c' AS origin FROM customer UNION ALL SELECT s_suppkey + 1450, 's' FROM supplier WHERE s_suppkey + 1450 NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT NULL, 'n' FROM nation")
def a14(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("c").alias("origin"))
    new = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1450).alias("id"), F.lit("s").alias("origin"))
    blanks = table(spark, sf_dir, "nation").select(F.lit(None).cast("long").alias("id"), F.lit("n").alias("origin"))
    return gr.merge_by_id(base, new.unionByName(blanks), "id")


@query("a15_export_rows", """SELECT page_id, substr(regexp_replace(url, '[^\\p{L}\\p{N}._-]', '_', 'g'), 1, 40) || '.txt' AS file_name FROM pages""")
def a15(spark, sf_dir):
    return exports.export_listing(table(spark, sf_dir, "pages").select("page_id", "url"), F.col("url"), ".txt", 40).select("page_id", "file_name")


@query(
    "a17_catalogue_append",
    """SELECT 'unclassified' AS mega_id, CAST(n_nationkey AS VARCHAR) AS proc_id, false AS is_new FROM nation
       UNION ALL SELECT 'unclassified', CAST(s_suppkey AS VARCHAR), true FROM supplier WHERE s_suppkey NOT IN (SELECT n_nationkey FROM nation)""",
)
def a17(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    held = nation.select(
        F.lit("unclassified").alias("mega_id"), F.lit("미분류").alias("mega_name"), F.lit("unclassified_major").alias("major_id"), F.lit("미분류").alias("major_name"),
        F.col("n_nationkey").cast("string").alias("proc_id"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("path"), F.lit(False).alias("is_new"),
    )
    new = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("proc_id"), F.col("s_name").alias("name"))
    return gr.catalogue_append(held, new).select("mega_id", "proc_id", "is_new")


@query("a18_org_add_member", "SELECT 'n' || c_nationkey AS parent_id, 'c' || c_custkey AS node_id FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation")
def a18(spark, sf_dir):
    tag = lambda p, c: F.concat(F.lit(p), F.col(c))
    teams = table(spark, sf_dir, "nation").select(tag("n", "n_nationkey").alias("node_id"), tag("r", "n_regionkey").alias("parent_id"), F.lit(True).alias("is_team"))
    held = table(spark, sf_dir, "customer").select(tag("c", "c_custkey").alias("node_id"), tag("n", "c_nationkey").alias("parent_id"), F.lit(False).alias("is_team"))
    new = table(spark, sf_dir, "supplier").select(tag("s", "s_suppkey").alias("node_id"), tag("n", "s_nationkey").alias("parent_id"), F.lit(False).alias("is_team"))
    again = held.unionByName(new).unionByName(new.withColumn("parent_id", F.lit("nowhere")))
    return gr.org_add_member(teams.unionByName(held), again).select("parent_id", "node_id")


@query("a19_has_data", "SELECT (SELECT count(*) FROM orders) AS n_process, (SELECT count(*) FROM lineitem) AS n_task, (SELECT count(*) FROM customer) AS n_role, true AS has_data")
def a19(spark, sf_dir):
    return gr.has_data(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "customer"))


@query("a20_load_people", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment = 'MACHINERY' AS is_agent FROM customer WHERE c_nationkey = 3")
def a20(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_nationkey").cast("string").alias("tenant_id"), (F.col("c_mktsegment") == "MACHINERY").alias("is_agent"))
    conf = table(spark, sf_dir, "nation").select(F.lit("organization").alias("key"), F.col("n_nationkey").cast("string").alias("tenant_id"), F.to_json(F.struct(F.struct("n_name").alias("chart"))).alias("value"))
    return documents.load_people(users, conf, "3")[0].select("id", "is_agent")


@query("a21_lineage_columns", f"WITH {_SNAP} SELECT proc_id, run_id, run_id || '/integrated' AS integrated_snapshot FROM ps")
def a21(spark, sf_dir):
    _, snaps = _runs(spark, sf_dir)
    defs = snaps.where("snapshot_type = 'process'")
    whole = F.concat(F.col("run_id"), F.lit("/integrated"))
    out = gr.lineage_columns(defs, F.col("run_id"), F.col("proc_id"), whole, F.concat_ws("/", "run_id", "proc_id"))
    return out.select("proc_id", "lineage.run_id", "lineage.integrated_snapshot")


@query(
    "f1_explicit_flow_edges",
    """SELECT 'task' AS src_type, CAST(l_suppkey AS VARCHAR) AS src_id, CASE WHEN arg_min(l_linestatus, k) = 'O' THEN 'gateway' ELSE 'task' END AS dst_type, CAST(l_partkey AS VARCHAR) AS dst_id, arg_min(l_returnflag, k) AS condition
       FROM (SELECT *, l_orderkey * 10 + l_linenumber AS k FROM lineitem) GROUP BY l_suppkey, l_partkey""",
)
def f1(spark, sf_dir):
    s = lambda c: F.col(c).cast("string")
    old = F.col("l_linestatus") == "F"
    flows = table(spark, sf_dir, "lineitem").select(
        F.when(~old, s("l_suppkey")).alias("from_id"), F.when(old, s("l_suppkey")).alias("from_task_id"), s("l_partkey").alias("to_id"),
        F.when(~old, "gateway").alias("to_type"), F.col("l_returnflag").alias("condition"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
    )
    return gr.explicit_flow_edges(flows).select("src_type", "src_id", "dst_type", "dst_id", "condition")


@query("f2_order_chain_edges", f"WITH {SQL_GRAPH} SELECT src_id, dst_id FROM nxt")
def f2(spark, sf_dir):
    tasks = property_graph(spark, sf_dir)["task"]
    return gr.order_chain_edges(tasks, schemas.empty(spark, "edges")).select("src_id", "dst_id")


@query("f3_event_edges", """SELECT CASE WHEN event_type = 'signup' THEN 'event' ELSE 'task' END AS src_type, CASE WHEN event_type = 'signup' THEN event_id ELSE user_id END AS src, CASE WHEN event_type = 'signup' THEN user_id ELSE event_id END AS dst FROM events""")
def f3(spark, sf_dir):
    links = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("task_id"), (F.col("event_type") == "signup").alias("is_start"))
    return gr.event_edges(links).select("src_type", F.col("src_id").cast("long").alias("src"), F.col("dst_id").cast("long").alias("dst"))


def _relations(spark, sf_dir, mode="full"):
    g = property_graph(spark, sf_dir)
    e = g["edges"]
    pick = lambda rel, a, b: e.where(F.col("rel") == rel).select(F.col("src_id").alias(a), F.col("dst_id").alias(b))
    proof = g["chunk"].select(F.col("chunk_id").alias("entity_id"), "chunk_id")
    nodes = gr.node_rows({"role": g["role"], "process": g["process"]})
    return gr.materialize_relations(pick("PERFORMED_BY", "task_id", "role_id"), pick("HAS_TASK", "process_id", "task_id"), pick("MAKES_DECISION", "role_id", "decision_id"), proof, nodes, mode)


@query(
    "f4_materialize_relations",
    f"""WITH {SQL_GRAPH} SELECT 'PERFORMED_BY' AS rel, count(*) AS n FROM performed UNION ALL SELECT 'HAS_TASK', count(*) FROM task UNION ALL SELECT 'MAKES_DECISION', count(*) FROM makes
        UNION ALL SELECT 'SUPPORTED_BY', (SELECT count(*) FROM role_proof) + (SELECT count(*) FROM process JOIN chunk ON chunk_id = proc_id)""",
)
def f4(spark, sf_dir):
    return _relations(spark, sf_dir).groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


@query("f5_evidence_edges", f"WITH {SQL_GRAPH} SELECT 'role' AS src_type, role_id AS src_id, chunk_id AS dst_id FROM role_proof UNION ALL SELECT 'process', proc_id, chunk_id FROM process JOIN chunk ON chunk_id = proc_id")
def f5(spark, sf_dir):
    return _relations(spark, sf_dir).where("rel = 'SUPPORTED_BY'").select("src_type", "src_id", "dst_id")


@query(
    "f6_process_skill_edges",
    f"""WITH {SQL_GRAPH}, rs AS (SELECT agent_id AS role_id, skill_id FROM uses) SELECT DISTINCT process_id AS src_id, skill_id AS dst_id FROM performed JOIN rs USING (role_id)""",
)
def f6(spark, sf_dir):
    g = property_graph(spark, sf_dir)
    own = g["edges"].where("rel = 'USES_SKILL'").withColumn("rel", F.lit("HAS_SKILL")).withColumn("src_type", F.lit("role"))
    return gr.process_skill_edges(g["edges"].where("rel IN ('HAS_TASK', 'PERFORMED_BY')").unionByName(own)).select("src_id", "dst_id")


@query(
    "f7_infer_task_roles",
    """WITH r AS (SELECT DISTINCT p_name, split_part(p_name, ' ', 2) AS unit FROM part WHERE p_name <> ''), x AS (SELECT item_id, lower(text) AS t FROM benchmark UNION ALL SELECT 100000 + doc_id, lower(text) FROM documents),
       o AS (SELECT DISTINCT substr(event_type, 1, 3) AS role_id, substr(event_type, 1, 3) AS keyword FROM events UNION SELECT lang, lang FROM documents UNION SELECT 'x' || lang, lang || 'e' FROM documents)
       SELECT CAST(item_id AS VARCHAR) AS task_id, min(role_id) AS role_id FROM x JOIN o ON length(keyword) > 2 AND contains(t, keyword) GROUP BY 1""",
)
def f7(spark, sf_dir):
    text = lambda t, i: table(spark, sf_dir, t).select(i.cast("string").alias("task_id"), F.col("text").alias("name"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("instruction"))
    tasks = text("benchmark", F.col("item_id")).unionByName(text("documents", F.col("doc_id") + 100000))
    kinds = table(spark, sf_dir, "events").select(F.substring("event_type", 1, 3).alias("role_id")).distinct().withColumn("name", F.col("role_id"))
    langs = table(spark, sf_dir, "documents").select("lang").distinct()
    named = langs.select(F.col("lang").alias("role_id"), F.col("lang").alias("name")).unionByName(langs.select(F.concat(F.lit("x"), "lang").alias("role_id"), F.concat("lang", F.lit("E")).alias("name")))
    roles = kinds.unionByName(named).withColumn("org_unit", F.lit(None).cast("string"))
    none = spark.createDataFrame([], "task_id string, role_id string")
    return gr.infer_task_roles(tasks, none, roles, "role_id")


@query("f8_default_process", "SELECT event_id, CASE WHEN event_type = 'error' THEN (SELECT min(user_id) FROM events) ELSE user_id END AS process_id FROM events")
def f8(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    tasks = events.select("event_id", F.when(F.col("event_type") != "error", F.col("user_id").cast("string")).alias("process_id"))
    procs = events.select(F.col("user_id").cast("string").alias("proc_id"), "user_id").distinct()
    return gr.default_process(tasks, procs, "user_id").select("event_id", F.col("process_id").cast("long").alias("process_id"))


@query("f9_role_agent_edges", f"WITH {SQL_GRAPH} SELECT role_id, agent_id FROM assigned WHERE role_id IN (SELECT role_id FROM performed)")
def f9(spark, sf_dir):
    g = property_graph(spark, sf_dir)
    return gr.role_agent_edges(g["edges"], g["role"], g["agent"]).select(F.col("src_id").alias("role_id"), F.col("dst_id").alias("agent_id"))


@query("f10_agent_skill_edges", "SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS agent_id, CAST(q.p_partkey AS VARCHAR) AS skill_id FROM lineitem JOIN part p ON p.p_partkey = l_partkey JOIN part q ON q.p_name = p.p_name")
def f10(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    asked = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").cast("string").alias("agent_id"), F.upper("p_name").alias("skill_name")).distinct()
    skills = part.select(F.col("p_partkey").cast("string").alias("skill_id"), F.concat(F.lit(" "), "p_name").alias("name"))
    edges = gr.agent_skill_edges(asked.select("agent_id"), skills, asked)
    return edges.select(F.col("src_id").alias("agent_id"), F.col("dst_id").alias("skill_id"))


@query("f11_static_link_edges", "SELECT DISTINCT 'USES_DECISION' AS rel, CAST(l_orderkey AS VARCHAR) AS src_id, p_brand AS dst_id FROM lineitem JOIN part ON p_partkey = l_partkey UNION ALL SELECT DISTINCT 'FROM_DOCUMENT', CAST(doc_id AS VARCHAR), source FROM documents")
def f11(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    used = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(part, "l_partkey")
    edges = gr.link_edges(used, "USES_DECISION", "process", "l_orderkey", "decision", "p_brand").unionByName(
        gr.link_edges(table(spark, sf_dir, "documents"), "FROM_DOCUMENT", "chunk", "doc_id", "document", "source")
    )
    return edges.select("rel", "src_id", "dst_id")


@query("g14_graph_by_source", f"WITH {_SNAP} SELECT run_id, n_elements FROM run ORDER BY o_orderdate DESC, run_id DESC LIMIT 1")
def g14(spark, sf_dir):
    runs, snaps = _runs(spark, sf_dir)
    return snapshots.graph_by_source(snaps, runs).select("run_id", "n_elements")


@query("g15_process_graph_or_snapshot", f"WITH {SQL_FLOW} SELECT process_id AS proc_id, count(*) AS n, 'live' AS origin FROM task GROUP BY 1 UNION ALL SELECT 'u' || (10000000 + user_id), count(*), 'stored' FROM events GROUP BY 1")
def g15(spark, sf_dir):
    live = flow_tasks(spark, sf_dir).groupBy(F.col("process_id").alias("proc_id")).agg(F.count(F.lit(1)).alias("n")).withColumn("origin", F.lit("live"))
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).withColumn("origin", F.lit("stored"))
    both = users.select(F.concat(F.lit("u"), F.col("user_id")).alias("proc_id"), "n", "origin").unionByName(users.select(F.concat(F.lit("u"), F.col("user_id") + 10000000).alias("proc_id"), "n", "origin"))
    return snapshots.process_graph_or_snapshot(live, both)
