"""Artifact, check and stream queries (A16, K, L, M, U3)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from procweave.operators import artifacts as k
from procweave.operators.graph import union_all
from procweave.plans.base import query
from procweave.plans.pipeline import document_graph
from procweave.plans.readings import SQL_FLOW, SQL_GRAPH, corpus, flow_graph, property_graph, table
from procweave.session import shared_dir
from procweave.sources.models import ingest_models
from procweave.streaming import jobs


def _stored_models(spark, sf_dir):
    """A stored model per conversation: lanes by speaker, a task per turn with its details for answers."""
    turns = table(spark, sf_dir, "conversations")
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    tid = F.concat(F.lit("T"), F.col("turn"))
    details = F.concat(F.lit("<bpmn:extensionElements><ext:properties><ext:json>"), F.to_json(F.struct(F.lit("formHandler:x").alias("tool"), F.col("role").alias("description"))), F.lit("</ext:json></ext:properties></bpmn:extensionElements>"))
    task = F.concat(F.lit('<bpmn:userTask id="'), tid, F.lit('" name="'), esc(F.substring_index("text", "\n", 1)), F.lit('">'), F.when(F.col("role") == "assistant", details).otherwise(""), F.lit("</bpmn:userTask>"))
    flow = F.concat(F.lit('<bpmn:sequenceFlow id="F'), F.col("turn"), F.lit('" sourceRef="'), tid, F.lit('" targetRef="T'), F.col("turn") + 1, F.lit('"/>'))
    lane = F.concat(F.lit('<bpmn:lane name="'), F.col("role"), F.lit('"><bpmn:flowNodeRef>'), tid, F.lit("</bpmn:flowNodeRef></bpmn:lane>"))
    parts = turns.groupBy(F.col("conv_id").alias("proc_id")).agg(*[F.array_join(F.array_sort(F.collect_list(c)), "").alias(n) for n, c in (("l", lane), ("t", task), ("f", flow))])
    xml = F.concat(
        F.lit('<bpmn:definitions xmlns:bpmn="http://m" xmlns:ext="http://u"><bpmn:process id="P"><bpmn:laneSet>'), "l", F.lit('</bpmn:laneSet><bpmn:startEvent id="S"/>'), "t",
        F.lit('<bpmn:exclusiveGateway id="G" name="g"/>'), "f", F.lit("</bpmn:process></bpmn:definitions>"),
    )
    return parts.select("proc_id", xml.alias("xml"))


@query(
    "a16_ingest_flow_xml",
    """SELECT conv_id AS proc_id, 'T' || turn AS id, role, CASE WHEN role = 'assistant' THEN 'formHandler:x' ELSE 'formHandler:defaultform' END AS tool, CASE WHEN role = 'assistant' THEN role ELSE '' END AS description FROM conversations""",
)
def a16(spark, sf_dir):
    return ingest_models(_stored_models(spark, sf_dir))["activities"].select("proc_id", "id", "role", "tool", "description")


@query("a16_sequences", """SELECT conv_id AS proc_id, 'F' || turn AS id, 'T' || turn AS source, 'T' || (turn + 1) AS target FROM conversations""")
def a16_sequences(spark, sf_dir):
    return ingest_models(_stored_models(spark, sf_dir))["sequences"].select("proc_id", "id", "source", "target")


@query("a16_roles", """SELECT DISTINCT conv_id AS proc_id, role AS name, '' AS endpoint FROM conversations""")
def a16_roles(spark, sf_dir):
    return ingest_models(_stored_models(spark, sf_dir))["roles"].select("proc_id", "name", "endpoint")


@query("k1_procedure_steps")
def k1(spark, sf_dir):
    from procweave.functions.text import procedure_steps

    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(procedure_steps("text")).alias("step_no", "step"))


@query(
    "k2_skill_rows",
    f"""WITH {SQL_GRAPH}, a AS (SELECT task_id, name, coalesce(instruction, '') AS i, CASE WHEN instruction IS NULL THEN '작업을 수행합니다.' ELSE 'from ' || l_suppkey END AS step FROM task WHERE task_type = 'agent')
        SELECT task_id, name || ' Skill' AS skill_name, i AS summary, step AS steps,
          md5('# Skill: ' || name || ' Skill' || chr(10) || chr(10) || i || chr(10) || chr(10) || '## Purpose' || chr(10) || name || ' 태스크를 수행합니다.' || chr(10) || chr(10) || '## Procedure' || chr(10) || '1. ' || step
          || chr(10) || chr(10) || '## Exceptions' || chr(10) || '- 오류 발생 시 재시도' || chr(10) || '- 실패 시 상위 보고' || chr(10)) AS markdown_hash FROM a""",
)
def k2(spark, sf_dir):
    rows = k.skill_rows(property_graph(spark, sf_dir)["task"])
    return rows.select("task_id", "skill_name", "summary", F.array_join("procedure", "|").alias("steps"), F.md5("markdown").alias("markdown_hash"))


@query("k3_decision_table", f"WITH {SQL_GRAPH} SELECT decision_id, rule_id, row_number() OVER (PARTITION BY decision_id ORDER BY rule_id) AS rule_no, when_ AS \"when\" FROM rule")
def k3(spark, sf_dir):
    g = property_graph(spark, sf_dir)
    rules = g["rule"].withColumn("then", F.lit("use")).withColumn("confidence", F.lit(1.0))
    return k.decision_rows(g["decision"], rules).select("decision_id", "rule_id", "rule_no", "when")


@query("k3_decision_inputs", "SELECT p_type AS input, row_number() OVER (ORDER BY p_type) AS column_no FROM (SELECT DISTINCT p_type FROM part)")
def k3_inputs(spark, sf_dir):
    return k.decision_inputs(table(spark, sf_dir, "part").select(F.array("p_type", F.lit("")).alias("input_data")))


def _turn_nodes(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        F.col("conv_id").alias("proc_id"), F.col("turn").alias("pos"), F.concat(F.lit("T"), F.col("turn")).alias("id"), F.substring_index("text", "\n", 1).alias("name"),
        F.when(F.col("role") != "system", F.col("role")).alias("role"), F.lit("UserTask").alias("type"),
    )


_LANES = """
n AS (SELECT conv_id AS proc_id, turn, CASE WHEN role = 'system' THEN '' ELSE role END AS lane FROM conversations),
l AS (SELECT proc_id, dense_rank() OVER (PARTITION BY proc_id ORDER BY lane = '', lane) AS lane_no, lane, row_number() OVER (PARTITION BY proc_id, lane ORDER BY turn) AS node_no, 'T' || turn AS id FROM n)
"""


@query("k4_lane_membership", f"WITH {_LANES} SELECT * FROM l")
def k4(spark, sf_dir):
    return k.lane_membership(_turn_nodes(spark, sf_dir))


@query(
    "k5_flow_document",
    f"""WITH {_LANES}, e AS (SELECT conv_id, turn, replace(replace(replace(split_part(text, chr(10), 1), '&', '&amp;'), '<', '&lt;'), '"', '&quot;') AS name FROM conversations)
        SELECT DISTINCT conv_id AS proc_id, 0 AS part, '<process id="' || conv_id || '" name="talk &amp; ' || conv_id || '">' AS value FROM e
        UNION ALL SELECT proc_id, 1, '<lane name="' || lane || '" node="' || id || '"/>' FROM l
        UNION ALL SELECT conv_id, 2, '<userTask id="T' || turn || '" name="' || name || '"/>' FROM e
        UNION ALL SELECT conv_id, 3, '<sequenceFlow id="F' || turn || '" sourceRef="T' || turn || '" targetRef="end" name=""/>' FROM e
        UNION ALL SELECT DISTINCT conv_id, 9, '</process>' FROM e""",
)
def k5(spark, sf_dir):
    nodes = _turn_nodes(spark, sf_dir)
    processes = nodes.select("proc_id").distinct().withColumn("name", F.concat(F.lit("talk & "), F.col("proc_id")))
    seqs = nodes.select("proc_id", "pos", F.concat(F.lit("F"), F.col("pos")).alias("id"), F.col("id").alias("source"), F.lit("end").alias("target"), F.lit("").alias("condition"))
    return k.flow_document_lines(processes, nodes, seqs).select("proc_id", "part", "value")


@query("k6_variables_rows", "SELECT l_orderkey AS proc_id, 'v' || l_partkey AS name, CASE WHEN l_returnflag = 'R' THEN 'string' ELSE l_returnflag END AS type, l_linestatus AS \"default\" FROM lineitem")
def k6(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return k.variables_rows(lines.select(F.col("l_orderkey").alias("proc_id"), F.concat(F.lit(" v"), F.col("l_partkey")).alias("name"), F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("type"), F.col("l_linestatus").alias("default")))


@query("k7_run_summary", f"WITH {SQL_GRAPH} SELECT 'process' AS name, count(*) AS n FROM process UNION ALL SELECT 'task', count(*) FROM task UNION ALL SELECT 'skill', count(*) FROM skill")
def k7(spark, sf_dir):
    g = property_graph(spark, sf_dir)
    return k.run_summary({n: g[n] for n in ("process", "task", "skill")})


@query("k7_document_run")
def k7_run(spark, sf_dir):
    """Whole pipeline over the corpus with patterns for its invented words."""
    from procweave.operators import candidates

    patterns = [("process", r"^[A-Z]\w+ and ", 0.7), ("task", r"^(The|De|El|Der|Le)\b", 0.6), ("role", r"\b(der|ent)\b", 0.6), ("event", r"\d", 0.7)]
    make = lambda text: candidates.default_payload(candidates.pattern_candidates(text, patterns))
    return k.run_summary(document_graph(corpus(spark, sf_dir), make))


@query(
    "k8_step_timings",
    """WITH r AS (SELECT CAST(left(o_orderpriority, 1) AS INTEGER) AS config_no, o_orderstatus AS step, round(sum(o_totalprice), 2) AS seconds FROM orders GROUP BY 1, 2),
       t AS (SELECT config_no, sum(seconds) AS total FROM r GROUP BY 1), b AS (SELECT arg_min(total, config_no) AS base FROM t)
       SELECT config_no, step, round(seconds / total * 100, 4) AS share, round((base - total) / base * 100, 4) AS improvement FROM r JOIN t USING (config_no), b""",
)
def k8(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    runs = orders.groupBy(F.substring("o_orderpriority", 1, 1).cast("int").alias("config_no"), F.col("o_orderpriority").alias("config"), F.col("o_orderstatus").alias("step")).agg(F.round(F.sum("o_totalprice"), 2).alias("seconds"))
    return k.step_timings(runs).select("config_no", "step", F.round("share", 4).alias("share"), F.round("improvement", 4).alias("improvement"))


@query("l1_role_coverage", """SELECT count(*) AS n_tasks, count(*) FILTER (l_returnflag = 'R') AS n_with_role, (SELECT count(*) FROM customer) AS n_roles, count(*) FILTER (l_returnflag = 'R') < count(*) * 0.3 AS low_coverage, false AS no_roles
      FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, any_value(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2, 3, 4)""")
def l1(spark, sf_dir):
    g = property_graph(spark, sf_dir)
    performed = g["edges"].where("rel = 'PERFORMED_BY'").select(F.col("src_id").alias("task_id"), F.col("dst_id").alias("role_id"))
    red = g["task"].where(F.col("name").endswith("R")).select("task_id")
    return k.role_coverage(g["task"], performed.join(red, "task_id", "left_semi"), g["role"])


@query(
    "l2_orphan_checks",
    f"""WITH {SQL_FLOW} SELECT 'role?' AS question, task_id AS entity_id FROM task WHERE name = 'error' UNION ALL SELECT 'order?', task_id FROM task WHERE name = 'view'
        UNION ALL SELECT 'condition?', src_id FROM nxt WHERE src_type = 'gateway' GROUP BY src_id HAVING count(*) >= 2 AND count(*) FILTER (condition = 'to view') > 0""",
)
def l2(spark, sf_dir):
    g = flow_graph(spark, sf_dir)
    tasks = g["task"].withColumn("order", F.when(F.col("name") != "view", F.col("order")))
    performed = g["task"].where("name <> 'error'").select("task_id")
    flows = g["edges"].where("rel = 'NEXT'").select(F.col("src_type").alias("from_type"), F.col("src_id").alias("from_id"), F.when(F.col("condition") != "to view", F.col("condition")).alias("condition"))
    return k.orphan_checks(tasks, performed, flows, F.current_timestamp()).select("question", "entity_id")


# Status events: a user is a job, the event type its status; errors end the job.


def _status(events):
    return events.select(
        F.col("user_id").cast("string").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.lit("run").alias("step"), F.lit(0).alias("progress"), F.lit("").alias("message")
    )


_CHANGES = """
x AS (SELECT CAST(user_id AS VARCHAR) AS job_id, event_id AS seq, event_type AS status, lag(event_type) OVER w AS before,
        sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS ended
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT job_id, seq, status FROM x WHERE ended = 0 AND before IS DISTINCT FROM status
"""


@query("m1_latest_job_state", "SELECT CAST(user_id AS VARCHAR) AS job_id, arg_max(event_type, event_id) AS status, 'run' AS step FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS last FROM events) WHERE ts = last GROUP BY user_id")
def m1(spark, sf_dir):
    return jobs.latest_job_state(_status(table(spark, sf_dir, "events"))).select("job_id", "status", "step")


@query("m2_emit_on_change", f"WITH {_CHANGES}")
def m2(spark, sf_dir):
    return jobs.emit_on_change_batch(_status(table(spark, sf_dir, "events"))).select("job_id", "seq", "status")


def _stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return _status(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


@query("m2_emit_on_change_stream", f"WITH {_CHANGES}")
def m2_stream(spark, sf_dir):
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    changes = jobs.emit_on_change(_stream(spark, sf_dir), "400 days").select("job_id", "seq", "status")
    run = changes.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query(
    "m3_replay_then_tail",
    """WITH e AS (SELECT *, CAST(event_type = 'error' AS INTEGER) AS over, sum(CAST(event_type = 'error' AS INTEGER)) OVER (ORDER BY ts, event_id) AS n
                  FROM events WHERE user_id = (SELECT min(user_id) FROM events))
       SELECT CAST(user_id AS VARCHAR) AS job_id, event_id AS seq, event_type AS status, 'run' AS step FROM e WHERE n - over = 0
       UNION ALL SELECT CAST(user_id AS VARCHAR), NULL, 'error', 'final' FROM e WHERE over = 1 GROUP BY user_id""",
)
def m3(spark, sf_dir):
    base = f"{shared_dir(spark).rstrip('/')}/replay-{uuid.uuid4().hex}"
    job = str(table(spark, sf_dir, "events").agg(F.min("user_id")).first()[0])
    sink = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")
    jobs.replay_then_tail(_stream(spark, sf_dir), job, sink, f"{base}/state", available_now=True).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("job_id", "seq", "status", "step")


@query("m4_overall_progress", "SELECT event_id, CAST(35 + floor(CAST(json_extract_string(props, '$.k') AS INTEGER) / 100.0 * 15) AS INTEGER) AS progress FROM events")
def m4(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("event_id", jobs.overall_progress(F.get_json_object("props", "$.k").cast("int"), F.lit(100)).alias("progress"))


@query(
    "m6_job_windows",
    """WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
       s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM g)
       SELECT CAST(user_id AS VARCHAR) AS job_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start_at, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS end_at, count(*) AS n_events FROM s GROUP BY user_id, no""",
)
def m6(spark, sf_dir):
    w = jobs.job_windows(_status(table(spark, sf_dir, "events")), "6 hours")
    show = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return w.select("job_id", F.date_format("start", show).alias("start_at"), F.date_format("end", show).alias("end_at"), "n_events")


@query("u3_progress_rows", "SELECT 'job' AS job_id, 'processing' AS status, CAST(35 + floor(user_id / 1000.0 * 15) AS INTEGER) AS progress, event_type AS message FROM events")
def u3(spark, sf_dir):
    done = table(spark, sf_dir, "events").select(F.col("user_id").alias("current"), F.col("event_type").alias("message"))
    return jobs.progress_rows(done, "job", F.lit(1000), F.current_timestamp()).select("job_id", "status", "progress", "message")
