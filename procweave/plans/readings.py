"""How the driver tables are read as documents, dialogue, flow logs and property graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan that gives fewer tasks than there are cores, dealt out over all of them.

    Tables of many files or row groups have more tasks than cores and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: one row per document with its pages; form feeds separate pages."""
    from procweave.operators.segment import with_pages

    return with_pages(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text")


def dialogue_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogue as documents: a conversation is a document, a turn is a page."""
    from procweave.operators.segment import gather_pages

    turns = table(spark, sf_dir, "conversations")
    return gather_pages(
        turns.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), "text")
    )


# Flow log: a user is a process, an event type is a task of it, time gives the order ---------------

ROLE_OF_EVENT = {"click": "visitor", "view": "visitor", "purchase": "buyer", "signup": "member", "error": "system"}


def flow_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the next event type of the same user and a condition from their properties."""
    from procweave.operators.ordered import scan

    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    parity = F.get_json_object("props", "$.k").cast("int") % 2
    rows = events.select(
        "event_id", "ts", "user_id", "event_type", F.when(parity == 0, "even").otherwise("odd").alias("condition")
    )
    return scan(rows, ["user_id"], ["ts", "event_id"], lead={"next_type": "event_type"})


def _task_id(user, kind):
    return F.concat(F.lit("u"), F.col(user).cast("string"), F.lit(":"), F.col(kind))


def flow_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from procweave.operators.ordered import scan

    events = table(spark, sf_dir, "events")
    first = events.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("at")).select(
        "user_id", "event_type", "at.ts", "at.event_id"
    )
    numbered = scan(first, ["user_id"], ["ts", "event_id"], number="n")
    return numbered.select(
        _task_id("user_id", "event_type").alias("task_id"),
        F.concat(F.lit("u"), F.col("user_id")).alias("process_id"),
        F.col("event_type").alias("name"),
        F.when(F.col("event_type") == "error", "system").otherwise("human").alias("task_type"),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("string").alias("instruction"),
        F.col("n").cast("int").alias("order"),
        "user_id",
    )


def flow_next_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw NEXT rows of the log, one per step, with the event id as sequence."""
    steps = flow_steps(spark, sf_dir).where("next_type IS NOT NULL")
    from procweave import schemas

    return steps.select(
        *schemas.edge("NEXT", "task", _task_id("user_id", "event_type"), "task", _task_id("user_id", "next_type"), F.col("condition")),
        F.col("event_id").alias("seq"),
    )


def flow_graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    from procweave import schemas
    from procweave.operators.graph import event_edges, union_all, upsert_edges, node_rows

    tasks = flow_tasks(spark, sf_dir)
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    tag = F.concat(F.lit("u"), F.col("user_id"))
    process = users.select(tag.alias("proc_id"), F.concat(F.lit("user "), F.col("user_id")).alias("name"), F.lit("").alias("description"))
    role = spark.createDataFrame([(r, r) for r in sorted(set(ROLE_OF_EVENT.values()))], "role_id string, name string")
    branching = tasks.where("name = 'error'").select("user_id")
    gateway = branching.select(
        F.concat(F.lit("gw u"), F.col("user_id")).alias("gateway_id"), F.concat(F.lit("u"), F.col("user_id")).alias("process_id"),
        F.concat(F.lit("branch u"), F.col("user_id")).alias("name"), F.lit("exclusive").alias("gateway_type"),
    )
    event = users.select(
        F.concat(F.lit("ev u"), F.col("user_id")).alias("event_id"), tag.alias("process_id"), F.lit("start").alias("event_type"),
        F.concat(F.lit("begin u"), F.col("user_id")).alias("name"),
    )
    chunk = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.lit(1).alias("page"), "text")
    to_role = F.create_map(*[F.lit(x) for pair in ROLE_OF_EVENT.items() for x in pair])
    raw = union_all(
        [
            tasks.select(*schemas.edge("HAS_TASK", "process", "process_id", "task", "task_id")),
            tasks.select(*schemas.edge("PERFORMED_BY", "task", "task_id", "role", to_role[F.col("name")])),
            gateway.select(*schemas.edge("HAS_GATEWAY", "process", "process_id", "gateway", "gateway_id")),
            event.select(*schemas.edge("HAS_EVENT", "process", "process_id", "event", "event_id")),
            tasks.select(*schemas.edge("SUPPORTED_BY", "task", "task_id", "chunk", F.col("user_id").cast("string"))),
            event_edges(tasks.where("order = 1").select(F.concat(F.lit("ev u"), F.col("user_id")).alias("event_id"), "task_id", F.lit(True).alias("is_start"))),
            tasks.where("name = 'error'").select(*schemas.edge("NEXT", "task", "task_id", "gateway", F.concat(F.lit("gw u"), F.col("user_id")))),
            tasks.where("name <> 'error'").select(*schemas.edge("NEXT", "gateway", F.concat(F.lit("gw u"), F.col("user_id")), "task", "task_id", F.concat(F.lit("to "), F.col("name")))),
        ]
    ).withColumn("seq", F.lit(0).cast("long")).unionByName(flow_next_edges(spark, sf_dir))
    tables = {"process": process, "task": tasks, "role": role, "gateway": gateway, "event": event, "chunk": chunk}
    nodes = node_rows({k: v for k, v in tables.items()})
    edges = upsert_edges(schemas.empty(spark, "edges"), raw, nodes, "seq")
    return {**tables, "edges": edges}


SQL_FLOW = """
st AS (SELECT user_id, event_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0 THEN 'even' ELSE 'odd' END AS condition FROM events),
ft AS (SELECT user_id, event_type, min(ts) AS ts, arg_min(event_id, ts) AS event_id FROM events GROUP BY ALL),
task AS (SELECT 'u' || user_id || ':' || event_type AS task_id, 'u' || user_id AS process_id, event_type AS name,
         CASE WHEN event_type = 'error' THEN 'system' ELSE 'human' END AS task_type,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS "order", user_id FROM ft),
process AS (SELECT DISTINCT 'u' || user_id AS proc_id, 'user ' || user_id AS name FROM events),
role_of AS (SELECT * FROM (VALUES ('click','visitor'),('view','visitor'),('purchase','buyer'),('signup','member'),('error','system')) t(name, role_id)),
gateway AS (SELECT 'gw u' || user_id AS gateway_id, process_id, 'branch u' || user_id AS name FROM task WHERE name = 'error'),
event AS (SELECT DISTINCT 'ev u' || user_id AS event_id, 'u' || user_id AS process_id, 'begin u' || user_id AS name FROM events),
chunk AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, text FROM documents),
nxt AS (SELECT 'task' AS src_type, 'u' || user_id || ':' || event_type AS src_id, 'task' AS dst_type, 'u' || user_id || ':' || next_type AS dst_id,
               max_by(condition, event_id) AS condition FROM st WHERE next_type IS NOT NULL GROUP BY ALL
        UNION ALL SELECT 'event', 'ev u' || user_id, 'task', task_id, NULL FROM task WHERE "order" = 1
        UNION ALL SELECT 'task', task_id, 'gateway', 'gw u' || user_id, NULL FROM task WHERE name = 'error'
        UNION ALL SELECT 'gateway', 'gw u' || t.user_id, 'task', task_id, 'to ' || t.name FROM task t
          WHERE name <> 'error' AND user_id IN (SELECT user_id FROM task WHERE name = 'error')),
proof AS (SELECT task_id, chunk_id FROM task JOIN chunk ON chunk_id = CAST(user_id AS VARCHAR))
"""


# Property graph: orders are processes, line items their tasks, customers roles, suppliers agents ---


def property_graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    from procweave import schemas
    from procweave.operators.graph import order_chain_edges, union_all

    s = lambda c: F.col(c).cast("string")
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    customer, supplier, part = (table(spark, sf_dir, n) for n in ("customer", "supplier", "part"))
    process = orders.select(
        s("o_orderkey").alias("proc_id"), F.concat_ws(" ", F.lit("order"), "o_orderpriority", s("o_orderkey")).alias("name"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("purpose"), F.lit(None).cast("string").alias("description"),
    )
    tasks = lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("task_id"),
        s("l_orderkey").alias("process_id"),
        F.concat_ws(" ", F.lit("line"), "l_linenumber", "l_returnflag").alias("name"),
        F.when(F.col("l_linestatus") == "O", "agent").otherwise("human").alias("task_type"),
        F.lit(None).cast("string").alias("description"),
        F.when(F.col("l_returnflag") != "N", F.concat(F.lit("handle part "), s("l_partkey"), F.lit("\nfrom "), s("l_suppkey"))).alias("instruction"),
        F.col("l_linenumber").alias("order"),
    )
    role = customer.select(s("c_custkey").alias("role_id"), F.replace("c_name", F.lit("Customer"), F.lit("Party")).alias("name"), F.col("c_mktsegment").alias("org_unit"))
    agent = supplier.select(
        s("s_suppkey").alias("agent_id"), F.concat(F.lit(" "), F.upper(F.replace("s_name", F.lit("Supplier"), F.lit("party")))).alias("name")
    )
    skill = part.select(s("p_partkey").alias("skill_id"), F.concat_ws(" ", "p_name", s("p_partkey")).alias("name"), F.col("p_type").alias("summary"))
    decision = part.select(F.col("p_brand").alias("decision_id"), F.col("p_brand").alias("name")).distinct()
    rule = part.select(F.concat_ws(":", "p_brand", "p_type").alias("rule_id"), F.col("p_brand").alias("decision_id"), F.col("p_type").alias("when")).distinct()
    gateway = orders.where("o_orderpriority = '1-URGENT'").select(
        F.concat(F.lit("g"), s("o_orderkey")).alias("gateway_id"), s("o_orderkey").alias("process_id"), F.lit("urgent").alias("name"),
        F.lit("exclusive").alias("gateway_type"),
    )
    event = orders.select(F.concat(F.lit("s"), s("o_orderkey")).alias("event_id"), s("o_orderkey").alias("process_id"), F.lit("start").alias("event_type"), F.lit("begin").alias("name"))
    chunk = table(spark, sf_dir, "documents").select(s("doc_id").alias("chunk_id"), F.lit(1).alias("page"), "text")
    performed = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = union_all(
        [
            tasks.select(*schemas.edge("HAS_TASK", "process", "process_id", "task", "task_id")),
            performed.select(*schemas.edge("PERFORMED_BY", "task", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "role", "o_custkey")),
            gateway.select(*schemas.edge("HAS_GATEWAY", "process", "process_id", "gateway", "gateway_id")),
            event.select(*schemas.edge("HAS_EVENT", "process", "process_id", "event", "event_id")),
            customer.select(*schemas.edge("MAKES_DECISION", "role", "c_custkey", "decision", F.concat(F.lit("Brand#"), (F.col("c_nationkey") + 1).cast("string")))),
            rule.select(*schemas.edge("HAS_RULE", "decision", "decision_id", "rule", "rule_id")),
            supplier.join(customer, F.col("s_suppkey") == F.col("c_custkey")).select(*schemas.edge("ASSIGNED_AGENT", "role", "c_custkey", "agent", "s_suppkey")),
            lines.select("l_suppkey", "l_partkey").distinct().select(*schemas.edge("USES_SKILL", "agent", "l_suppkey", "skill", "l_partkey")),
            lines.select("l_orderkey", "l_partkey").distinct().select(*schemas.edge("HAS_SKILL", "process", "l_orderkey", "skill", "l_partkey")),
            customer.join(chunk, s("c_custkey") == F.col("chunk_id"), "left_semi").select(*schemas.edge("SUPPORTED_BY", "role", "c_custkey", "chunk", "c_custkey")),
            order_chain_edges(tasks, schemas.empty(spark, "edges")),
        ]
    )
    return {
        "process": process, "task": tasks, "role": role, "agent": agent, "skill": skill, "decision": decision, "rule": rule,
        "gateway": gateway, "event": event, "chunk": chunk, "edges": edges,
    }


SQL_GRAPH = """
process AS (SELECT CAST(o_orderkey AS VARCHAR) AS proc_id, 'order ' || o_orderpriority || ' ' || o_orderkey AS name,
              CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS purpose FROM orders),
task AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS task_id, CAST(l_orderkey AS VARCHAR) AS process_id,
           'line ' || l_linenumber || ' ' || l_returnflag AS name, CASE WHEN l_linestatus = 'O' THEN 'agent' ELSE 'human' END AS task_type,
           CASE WHEN l_returnflag <> 'N' THEN 'handle part ' || l_partkey || chr(10) || 'from ' || l_suppkey END AS instruction,
           l_linenumber AS "order", l_orderkey, l_partkey, l_suppkey FROM lineitem),
role AS (SELECT CAST(c_custkey AS VARCHAR) AS role_id, replace(c_name, 'Customer', 'Party') AS name, c_mktsegment AS org_unit FROM customer),
agent AS (SELECT CAST(s_suppkey AS VARCHAR) AS agent_id, ' ' || upper(replace(s_name, 'Supplier', 'party')) AS name FROM supplier),
skill AS (SELECT CAST(p_partkey AS VARCHAR) AS skill_id, p_name || ' ' || p_partkey AS name FROM part),
decision AS (SELECT DISTINCT p_brand AS decision_id, p_brand AS name FROM part),
rule AS (SELECT DISTINCT p_brand || ':' || p_type AS rule_id, p_brand AS decision_id, p_type AS when_ FROM part),
gateway AS (SELECT 'g' || o_orderkey AS gateway_id, CAST(o_orderkey AS VARCHAR) AS process_id, 'urgent' AS name FROM orders WHERE o_orderpriority = '1-URGENT'),
event AS (SELECT 's' || o_orderkey AS event_id, CAST(o_orderkey AS VARCHAR) AS process_id, 'begin' AS name FROM orders),
chunk AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, text FROM documents),
performed AS (SELECT task_id, CAST(o_custkey AS VARCHAR) AS role_id, process_id FROM task JOIN orders ON o_orderkey = l_orderkey),
makes AS (SELECT CAST(c_custkey AS VARCHAR) AS role_id, 'Brand#' || (c_nationkey + 1) AS decision_id FROM customer),
assigned AS (SELECT CAST(c_custkey AS VARCHAR) AS role_id, CAST(s_suppkey AS VARCHAR) AS agent_id FROM customer JOIN supplier ON c_custkey = s_suppkey),
uses AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS agent_id, CAST(l_partkey AS VARCHAR) AS skill_id FROM lineitem),
has_skill AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS proc_id, CAST(l_partkey AS VARCHAR) AS skill_id FROM lineitem),
role_proof AS (SELECT role_id, chunk_id FROM role JOIN chunk ON chunk_id = role_id),
chain AS (SELECT process_id, task_id AS src_id, lead(task_id) OVER (PARTITION BY process_id ORDER BY "order", task_id) AS dst_id FROM task),
nxt AS (SELECT DISTINCT src_id, dst_id FROM chain WHERE dst_id IS NOT NULL)
"""
