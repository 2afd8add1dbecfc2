"""Candidate payload queries (D, U2).

Each document of the corpus is a section. Its payload is built from its own lines: every line is a
task and a flow source, source and language give processes and roles. For ``d1`` texts with a table bar
get a payload that is cut short and cannot be read.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from procweave.functions.text import clean_condition, reusable_skill, strip, with_gateway_name
from procweave.operators import candidates as c
from procweave.plans.base import query, sql_norm, sql_squeeze, sql_strip
from procweave.plans.readings import spread, table
from procweave.session import settle


def payload_sections(spark, sf_dir, cut=False):
    return payload_rows(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")), cut)


def payload_rows(docs, cut=False):
    """Sections (section_id, scope, section_no, payload) of documents; with ``cut`` some payloads cannot be read."""
    L = F.filter(F.transform(F.split("text", "\n"), strip), lambda x: x != "")
    # A one-element explode keeps the line list from being worked out anew wherever it is used.
    docs = docs.select("doc_id", "text", "lang", "source", F.explode(F.array(L)).alias("L")).withColumn("n", F.size("L"))
    line = lambda k: F.get(F.col("L"), F.lit(k))
    lang, source, n = F.col("lang"), F.col("source"), F.col("n")
    last = F.get(F.col("L"), n - 1)
    proc = lambda name, desc=None: F.struct(name.alias("name"), (desc if desc is not None else F.lit(None).cast("string")).alias("description"))
    none = F.lit(None).cast("string")

    def task(x, i):
        kind = F.element_at(F.array(F.lit("Human"), F.lit("agent"), F.lit("robot")), (i % 3 + 1).cast("int"))
        order = F.when(i % 4 == 1, F.concat((i * 2).cast("string"), F.lit(".7"))).when(i % 4 == 2, i.cast("string")).when(i % 4 == 3, "junk")
        parent = F.when(i % 3 == 0, F.upper(source)).when(i % 3 == 1, "extra").otherwise("unknown")
        return F.struct(
            x.alias("name"), kind.alias("task_type"), F.when(i % 2 == 1, x).alias("instruction"), order.alias("order"),
            F.when(i % 2 == 0, F.upper(lang)).otherwise("nobody").alias("performer_role"), parent.alias("parent_process"),
            F.substring(F.get(F.col("L"), i + 2), 1, 15).alias("next_task"),
        )

    def flow(a, b, cond):
        return F.struct(a.alias("from_task"), b.alias("to_task"), cond.alias("condition"))

    steps = F.when(
        n >= 2,
        F.transform(
            F.sequence(F.lit(0), n - 2),
            lambda i: flow(
                F.get(F.col("L"), i), F.substring(F.get(F.col("L"), i + 1), 1, 20),
                F.when(i % 3 == 0, "조건 1").when(i % 3 == 1, F.concat(F.lit("when "), i.cast("string"))).otherwise(""),
            ),
        ),
    ).otherwise(F.array().cast("array<struct<from_task:string,to_task:string,condition:string>>"))
    jump = F.when(n >= 2, F.array(flow(line(0), last, F.lit("jump")))).otherwise(F.array().cast("array<struct<from_task:string,to_task:string,condition:string>>"))
    gate = F.array(
        F.struct(F.lit("gateway 1").alias("name"), F.lit("Parallel").alias("gateway_type"), none.alias("description"), F.upper(source).alias("parent_process")),
        F.struct(line(1).alias("name"), F.lit("weird").alias("gateway_type"), F.concat(lang, F.lit("인지 여부")).alias("description"), none.alias("parent_process")),
    )
    summary = F.when(lang == "en", "분석 기법").when(lang == "fr", "서류 접수").when(lang == "de", "전문 지식").otherwise("plain")
    body = F.struct(
        F.filter(F.array(proc(source, line(0)), proc(F.concat(lang, F.lit(" flow"))), F.when(lang == "de", proc(F.lit("extra")))), lambda p: p.isNotNull()).alias("processes"),
        F.transform("L", task).alias("tasks"),
        F.array(
            F.struct(lang.alias("name"), source.alias("org_unit"), none.alias("description")),
            F.struct(F.lit("Reviewer").alias("name"), none.alias("org_unit"), F.lit("checks").alias("description")),
        ).alias("roles"),
        F.when((n >= 2) & (n % 2 == 0), gate).alias("gateways"),
        F.array(
            F.struct(F.lit("done").alias("name"), F.lit("END").alias("event_type"), F.concat(lang, F.lit(" Flow")).alias("parent_process")),
            F.struct(none.alias("name"), none.alias("event_type"), none.alias("parent_process")),
        ).alias("events"),
        F.array(
            F.struct(F.concat(lang, F.lit(" rule")).alias("name"), lang.alias("related_role")),
            F.struct(F.lit("Fallback").alias("name"), F.lit("ghost").alias("related_role")),
        ).alias("decisions"),
        F.array(
            F.struct(F.concat(F.upper(lang), F.lit(" RULE")).alias("decision_name"), none.alias("decision_id"), line(0).alias("when"), F.lit("go").alias("then"), F.lit(0.5).alias("confidence")),
            F.struct(none.alias("decision_name"), none.alias("decision_id"), F.lit("w").alias("when"), F.lit("t").alias("then"), F.lit(None).cast("double").alias("confidence")),
            F.struct(none.alias("decision_name"), F.lit("given").alias("decision_id"), F.lit("w").alias("when"), F.lit("t").alias("then"), F.lit(1.0).alias("confidence")),
        ).alias("rules"),
        F.array(
            F.struct(
                F.concat(source, F.lit(" skill")).alias("name"), summary.alias("summary"), F.lit(" use ").alias("purpose"), F.array(line(0), F.lit(" ")).alias("procedure"),
                F.array(F.substring(line(1), 1, 10), F.lit("")).alias("related_tasks"), lang.alias("related_role"),
            )
        ).alias("skills"),
        F.array(
            F.struct(F.substring(line(1), 1, 12).alias("task_name"), F.lit("REVIEWER").alias("role_name")),
            F.struct(F.lit("").alias("task_name"), F.lit("reviewer").alias("role_name")),
            F.struct(line(0).alias("task_name"), lang.alias("role_name")),
        ).alias("task_role_mappings"),
        F.array(
            F.struct(line(2).alias("task_name"), F.concat(lang, F.lit(" FLOW")).alias("process_name")),
            F.struct(F.substring(line(0), 1, 8).alias("task_name"), source.alias("process_name")),
        ).alias("task_process_mappings"),
        F.array(F.struct(F.lit("reviewer").alias("role_name"), F.concat(source, F.lit(" Skill")).alias("skill_name"))).alias("role_skill_mappings"),
        F.concat(steps, jump).alias("sequence_flows"),
    )
    text = F.to_json(body)
    return docs.select(
        F.col("doc_id").cast("string").alias("section_id"), source.alias("scope"), F.col("doc_id").alias("section_no"),
        (F.when(F.contains("text", F.lit("|")), F.substring(text, 1, F.length(text) - 1)).otherwise(text) if cut else text).alias("payload"),
    )


def _sid(scope: str, kind: str, *parts: str) -> str:
    return f"substr(sha256({' || '.join([scope, repr(':' + kind)] + [repr(':') + ' || ' + p for p in parts])}), 1, 32)"


@lru_cache
def _pre() -> str:
    s = "section_id"
    return f"""
d AS (SELECT CAST(doc_id AS VARCHAR) AS section_id, source AS scope, doc_id AS section_no, lang,
        list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '') AS L FROM documents),
dn AS (SELECT *, len(L) AS n FROM d),
ln AS (SELECT section_id, scope, section_no, lang, n, unnest(L) AS line, generate_subscripts(L, 1) - 1 AS i FROM dn),
pr0 AS (SELECT section_id, scope, section_no, 0 AS pos, scope AS name, coalesce(L[1], '') AS description FROM dn
        UNION ALL SELECT section_id, scope, section_no, 1, lang || ' flow', '' FROM dn
        UNION ALL SELECT section_id, scope, section_no, 2, 'extra', '' FROM dn WHERE lang = 'de'),
pr AS (SELECT *, {_sid(s, 'process', sql_norm('name'), 'pos')} AS proc_id FROM pr0),
p1 AS (SELECT section_id, proc_id AS first_proc FROM pr WHERE pos = 0),
ro0 AS (SELECT scope, section_id, section_no, 0 AS pos, lang AS name, scope AS org_unit, '' AS hint FROM dn
        UNION ALL SELECT scope, section_id, section_no, 1, 'Reviewer', '', 'checks' FROM dn),
ro AS (SELECT * EXCLUDE (rn), {_sid('scope', 'role', 'lower(name)')} AS role_id
       FROM (SELECT *, row_number() OVER (PARTITION BY scope, lower(name) ORDER BY section_no, pos) AS rn FROM ro0) WHERE rn = 1),
tk0 AS (SELECT section_id, scope, section_no, i AS pos, line AS name, lang, n,
          CASE WHEN i % 3 = 1 THEN 'agent' ELSE 'human' END AS task_type, CASE WHEN i % 2 = 1 THEN line ELSE '' END AS instruction,
          CASE WHEN i % 4 = 1 THEN i * 2 ELSE i END AS "order",
          CASE WHEN i % 3 = 0 THEN lower(scope) WHEN i % 3 = 1 THEN 'extra' ELSE 'unknown' END AS parent,
          {_sid(s, 'task', sql_norm('line'), 'i')} AS task_id FROM ln),
par AS (SELECT t.task_id, arg_max(p.proc_id, p.section_no * 10 + p.pos) AS proc_id FROM tk0 t JOIN pr p
        ON p.scope = t.scope AND lower(p.name) = t.parent AND p.section_no <= t.section_no GROUP BY 1),
tk1 AS (SELECT tk0.*, coalesce(par.proc_id, first_proc) AS process_id FROM tk0 LEFT JOIN par USING (task_id) JOIN p1 USING (section_id)),
perf AS (SELECT task_id, role_id FROM tk0 JOIN ro ON ro.scope = tk0.scope AND lower(ro.name) = lower(lang) AND ro.section_no <= tk0.section_no WHERE tk0.pos % 2 = 0),
mp AS (SELECT section_id, scope, section_no, 0 AS pos, lower(substr(L[2], 1, 12)) AS term, 'reviewer' AS role FROM dn
       UNION ALL SELECT section_id, scope, section_no, 2, lower(L[1]), lower(lang) FROM dn),
mph AS (SELECT m.section_id, m.pos, role_id, arg_min(t.task_id, t.pos) AS task_id FROM mp m JOIN ro ON ro.scope = m.scope AND lower(ro.name) = m.role AND ro.section_no <= m.section_no
        JOIN tk0 t ON t.section_id = m.section_id AND contains(lower(t.name), m.term) AND m.term <> '' GROUP BY ALL),
mapped AS (SELECT task_id, arg_max(role_id, pos) AS role_id FROM mph GROUP BY 1),
task_role AS (SELECT task_id, role_id FROM mapped UNION ALL SELECT task_id, role_id FROM perf WHERE task_id NOT IN (SELECT task_id FROM mapped)),
mq AS (SELECT section_id, 0 AS pos, lower(L[3]) AS term, {_sid(s, 'process', "lang || ' flow'", '1')} AS proc_id FROM dn
       UNION ALL SELECT section_id, 1, lower(substr(L[1], 1, 8)), {_sid(s, 'process', 'lower(scope)', '0')} FROM dn),
mqh AS (SELECT m.pos, m.proc_id, arg_min(t.task_id, t.pos) AS task_id FROM mq m JOIN tk0 t ON t.section_id = m.section_id AND contains(lower(t.name), m.term) AND m.term <> ''
        GROUP BY m.section_id, m.pos, m.proc_id),
mqm AS (SELECT task_id, arg_max(proc_id, pos) AS mapped FROM mqh GROUP BY 1),
tk AS (SELECT tk1.* EXCLUDE (process_id), coalesce(mapped, process_id) AS process_id FROM tk1 LEFT JOIN mqm USING (task_id)),
gw0 AS (SELECT section_id, scope, section_no, lang, 0 AS pos, 'gateway 1 여부 판단' AS name, 'parallel' AS gateway_type, '' AS description FROM dn WHERE n >= 2 AND n % 2 = 0
        UNION ALL SELECT section_id, scope, section_no, lang, 1, lang || ' 여부 판단', 'exclusive', lang || '인지 여부' FROM dn WHERE n >= 2 AND n % 2 = 0),
gw AS (SELECT *, {_sid(s, 'gateway', 'lower(name)', 'pos')} AS gateway_id FROM gw0),
de AS (SELECT section_id, scope, section_no, 0 AS pos, lang || ' rule' AS name, {_sid(s, 'decision', "lang || ' rule'", '0')} AS decision_id, lang FROM dn
       UNION ALL SELECT section_id, scope, section_no, 1, 'Fallback', {_sid(s, 'decision', "'fallback'", '1')}, lang FROM dn),
makes AS (SELECT role_id, decision_id FROM de JOIN ro ON ro.scope = de.scope AND lower(ro.name) = de.lang WHERE de.pos = 0),
fr AS (SELECT section_id, scope, section_no, i AS pos, L[i + 1] AS f, substr(L[i + 2], 1, 20) AS t,
         CASE i % 3 WHEN 0 THEN '조건 1' WHEN 1 THEN 'when ' || i ELSE '' END AS cond
       FROM (SELECT *, unnest(range(0, n - 1)) AS i FROM dn WHERE n >= 2)
       UNION ALL SELECT section_id, scope, section_no, n - 1, L[1], L[n], 'jump' FROM dn WHERE n >= 2),
nd AS (SELECT section_id, lower(name) AS name, 0 AS rank, pos, task_id AS id FROM tk UNION ALL SELECT section_id, lower(name), 1, pos, gateway_id FROM gw),
ends AS (SELECT DISTINCT section_id, lower(f) AS term FROM fr UNION SELECT DISTINCT section_id, lower(t) FROM fr),
found AS (SELECT e.section_id, term, arg_min(id, rank * 100000 + pos) AS id, min(rank) AS rank FROM ends e JOIN nd ON nd.section_id = e.section_id
          AND (contains(name, term) OR contains(term, name)) AND term <> '' GROUP BY ALL),
rf AS (SELECT fr.section_id, fr.pos, CASE a.rank WHEN 0 THEN 'task' ELSE 'gateway' END AS from_type, a.id AS from_id,
         CASE b.rank WHEN 0 THEN 'task' ELSE 'gateway' END AS to_type, b.id AS to_id, CASE WHEN cond = '조건 1' THEN '' ELSE cond END AS condition
       FROM fr JOIN found a ON a.section_id = fr.section_id AND a.term = lower(f) JOIN found b ON b.section_id = fr.section_id AND b.term = lower(t)),
bare AS (SELECT section_id, section_no, pos, lower({sql_strip('f')}) AS f, lower({sql_strip('t')}) AS t, cond FROM fr
         WHERE section_id NOT IN (SELECT section_id FROM gw) AND cond <> '' AND {sql_strip('t')} <> ''),
byname AS (SELECT section_id, lower({sql_strip('name')}) AS name, arg_max(task_id, pos) AS task_id, arg_max(process_id, pos) AS process_id FROM tk GROUP BY ALL),
fork AS (SELECT b.section_id, f, min(b.pos) AS pos, any_value(task_id) AS src_id, any_value(process_id) AS process_id,
           {_sid('b.section_id', 'gateway', sql_norm('f'), "'fork'")} AS gateway_id FROM bare b
         JOIN byname y ON y.section_id = b.section_id AND y.name = f GROUP BY b.section_id, f HAVING count(DISTINCT t) >= 2),
flows1 AS (SELECT * FROM rf WHERE NOT (to_type = 'task' AND condition <> '' AND from_id IN (SELECT src_id FROM fork))
           UNION ALL SELECT section_id, pos, 'task', src_id, 'gateway', gateway_id, '' FROM fork
           UNION ALL SELECT b.section_id, min(b.pos), 'gateway', gateway_id, 'task', y.task_id, cond FROM bare b JOIN fork k ON k.section_id = b.section_id AND k.f = b.f
                     JOIN byname y ON y.section_id = b.section_id AND y.name = b.t GROUP BY b.section_id, gateway_id, y.task_id, cond),
gwsize AS (SELECT from_id, count(*) AS n FROM flows1 WHERE from_type = 'gateway' GROUP BY 1),
subject AS (SELECT gateway_id, '조건 (자동 보강)' AS s FROM fork),
flows2 AS (SELECT f1.* EXCLUDE (condition), CASE WHEN n = 2 AND c = '' THEN (CASE WHEN rn = 1 THEN s || '인 경우' ELSE s || '이 아닌 경우' END) ELSE c END AS condition
  FROM (SELECT *, CASE WHEN gs.n >= 2 AND condition = '조건 1' THEN '' ELSE condition END AS c, row_number() OVER (PARTITION BY flows1.from_id, from_type ORDER BY pos, to_id) AS rn
        FROM flows1 LEFT JOIN gwsize gs ON gs.from_id = flows1.from_id AND from_type = 'gateway') f1 LEFT JOIN subject ON gateway_id = f1.from_id),
hint AS (SELECT a.section_id, a.pos, a.task_id AS from_id, arg_min(b.task_id, b.pos) AS to_id
         FROM (SELECT tk.*, lower(substr(L[pos + 3], 1, 15)) AS term FROM tk JOIN dn USING (section_id)) a JOIN tk b ON b.section_id = a.section_id AND contains(lower(b.name), term) AND term <> ''
         GROUP BY a.section_id, a.pos, a.task_id),
flows3 AS (SELECT from_id, to_id FROM flows2 UNION ALL SELECT from_id, to_id FROM hint),
chainx AS (SELECT section_id, pos, task_id AS from_id, lead(task_id) OVER (PARTITION BY section_id, process_id ORDER BY "order", pos) AS to_id FROM tk),
dflt AS (SELECT section_id, pos, from_id, to_id FROM chainx x WHERE to_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM flows3 z WHERE z.from_id = x.from_id AND z.to_id = x.to_id)),
kh AS (SELECT section_id, scope, section_no, lang, CASE lang WHEN 'en' THEN '분석 기법' WHEN 'fr' THEN '서류 접수' WHEN 'de' THEN '전문 지식' ELSE 'plain' END
         || chr(10) || 'use' || coalesce(chr(10) || L[1], '') AS knowhow, lower({sql_strip("substr(L[2], 1, 10)")}) AS term FROM dn),
kht AS (SELECT arg_min(t.task_id, t.pos) AS task_id, any_value(knowhow) AS knowhow FROM kh JOIN tk t ON t.section_id = kh.section_id
        AND (contains(lower(t.name), term) OR contains(term, lower(t.name))) WHERE term <> '' GROUP BY kh.section_id)
"""


def _parsed(spark, sf_dir, cut=False):
    return settle(c.parse_candidates(payload_sections(spark, sf_dir, cut)))


@query(
    "d1_parse_candidates",
    f"""WITH {_pre()} SELECT CAST(doc_id AS VARCHAR) AS section_id, coalesce(CAST(n AS INTEGER), 0) AS n_tasks, CASE WHEN n IS NULL THEN 0 WHEN lang_ = 'de' THEN 3 ELSE 2 END AS n_processes,
          CAST(CASE WHEN n >= 2 AND n % 2 = 0 THEN 2 ELSE 0 END AS INTEGER) AS n_gateways, CAST(CASE WHEN n >= 2 THEN n ELSE 0 END AS INTEGER) AS n_flows
        FROM (SELECT doc_id, lang AS lang_, contains(text, '|') AS cut FROM documents) LEFT JOIN dn ON section_id = CAST(doc_id AS VARCHAR) AND NOT cut""",
)
def d1(spark, sf_dir):
    p = _parsed(spark, sf_dir, cut=True)
    return p.select(
        "section_id", F.size("tasks").alias("n_tasks"), F.size("processes").alias("n_processes"),
        F.size("gateways").alias("n_gateways"), F.size("sequence_flows").alias("n_flows"),
    )


@query(
    "d2_clean_json_column",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k FROM events""",
)
def d2(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    kind = F.col("event_type")
    raw = (
        F.when(kind == "click", F.col("props")).when(kind == "view", F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .when(kind == "purchase", F.concat(F.lit("Answer: "), "props", F.lit(" done"))).when(kind == "signup", F.concat(F.lit("\n "), "props", F.lit("\n")))
        .otherwise(F.concat(F.lit("no "), F.replace("props", F.lit("}"), F.lit(""))))
    )
    return events.select("event_id", F.get_json_object(c.clean_json_column(raw), "$.k").cast("int").alias("k"))


_TEST_PATTERNS = [("process", r"^[A-Z]\w+ and ", 0.7), ("task", r"\bthe\b", 0.6), ("role", r"\bder\b", 0.6), ("gateway", r"\?|,", 0.8), ("event", r"\d", 0.7)]


@query(
    "d3_pattern_candidates",
    f"""WITH l AS (SELECT doc_id AS section_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '') AS L FROM documents),
        x AS (SELECT section_id, unnest(L) AS line, CAST(generate_subscripts(L, 1) - 1 AS INTEGER) AS pos FROM l)
        """
    + " UNION ALL ".join(
        f"SELECT section_id, pos, '{k}' AS kind, md5(line) AS line_hash, CAST({w} AS DOUBLE) AS confidence FROM x WHERE regexp_matches(line, '{p}')" for k, p, w in _TEST_PATTERNS
    ),
)
def d3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("section_id"), F.col("text").alias("content"))
    found = c.pattern_candidates(docs, _TEST_PATTERNS)
    return found.select("section_id", "pos", "kind", F.md5("line").alias("line_hash"), "confidence")


def _prefix(text, n_lines):
    """Payload of a text that names its first line as a process and the others as tasks."""
    import json

    lines = [x.strip() for x in (text or "").split("\n") if x.strip()]
    return json.dumps({"processes": [{"name": x} for x in lines[:n_lines]], "tasks": [{"name": x} for x in lines[n_lines:]]})


@query(
    "u2_payload_with_function",
    f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '') AS L FROM documents)
        SELECT CAST(doc_id AS VARCHAR) AS section_id, CAST(least(len(L), 1) AS INTEGER) AS n_processes, CAST(greatest(len(L) - 1, 0) AS INTEGER) AS n_tasks FROM l""",
)
def u2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("section_id"), F.col("text").alias("content"))
    payloads = c.payload_with(docs, lambda texts: [_prefix(text, 1) for text in texts])
    parsed = c.parse_candidates(payloads.select("section_id", F.lit("run").alias("scope"), F.lit(0).alias("section_no"), "payload"))
    return parsed.select("section_id", F.size("processes").alias("n_processes"), F.size("tasks").alias("n_tasks"))


@query("d4_to_processes", f"WITH {_pre()} SELECT section_id, pos, proc_id, name, description AS purpose FROM pr")
def d4(spark, sf_dir):
    return c.to_processes(_parsed(spark, sf_dir)).select("section_id", "pos", "proc_id", "name", "purpose")


@query("d5_to_roles_if_absent", f"WITH {_pre()} SELECT section_id, scope, role_id, name, org_unit, hint AS persona_hint FROM ro")
def d5(spark, sf_dir):
    return c.to_roles(_parsed(spark, sf_dir)).select("section_id", "scope", "role_id", "name", "org_unit", "persona_hint")


def _tasks(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    processes = c.to_processes(parsed)
    return parsed, processes, c.to_tasks(parsed, processes)


@query("d6_to_tasks", f"""WITH {_pre()} SELECT section_id, CAST(pos AS INTEGER) AS pos, task_id, process_id, task_type, CAST("order" AS INTEGER) AS "order" FROM tk1""")
def d6(spark, sf_dir):
    return _tasks(spark, sf_dir)[2].select("section_id", "pos", "task_id", "process_id", "task_type", "order")


@query("d7_link_performer", f"WITH {_pre()} SELECT task_id, role_id FROM perf")
def d7(spark, sf_dir):
    parsed, _, tasks = _tasks(spark, sf_dir)
    return c.link_performer(tasks, c.to_roles(parsed))


@query("d8_apply_task_role_mappings", f"WITH {_pre()} SELECT task_id, role_id FROM task_role")
def d8(spark, sf_dir):
    parsed, _, tasks = _tasks(spark, sf_dir)
    roles = c.to_roles(parsed)
    return c.apply_task_role_mappings(parsed, tasks, roles, c.link_performer(tasks, roles))


@query("d9_apply_task_process_mappings", f"WITH {_pre()} SELECT task_id, process_id FROM tk")
def d9(spark, sf_dir):
    parsed, processes, tasks = _tasks(spark, sf_dir)
    return c.apply_task_process_mappings(parsed, tasks, processes).select("task_id", "process_id")


@query("d10_to_gateways", f"WITH {_pre()} SELECT section_id, gateway_id, first_proc AS process_id, name, gateway_type, description FROM gw JOIN p1 USING (section_id)")
def d10(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    return c.to_gateways(parsed, c.to_processes(parsed)).select("section_id", "gateway_id", "process_id", "name", "gateway_type", "description")


@query(
    "d11_to_events",
    f"""WITH {_pre()} SELECT section_id, {_sid('section_id', 'process', "lang || ' flow'", '1')} AS process_id, 'end' AS event_type, 'done' AS name FROM dn
        UNION ALL SELECT section_id, first_proc, 'start', 'Event' FROM dn JOIN p1 USING (section_id)""",
)
def d11(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    return c.to_events(parsed, c.to_processes(parsed)).select("section_id", "process_id", "event_type", "name")


@query(
    "d12_to_decisions",
    f"WITH {_pre()} SELECT de.decision_id, name, role_id FROM de LEFT JOIN makes USING (decision_id)",
)
def d12(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    decisions, makes = c.to_decisions(parsed, c.to_roles(parsed))
    return decisions.join(makes, "decision_id", "left").select("decision_id", "name", "role_id")


@query(
    "d13_to_rules",
    f"""WITH {_pre()}, f AS (SELECT section_id, decision_id FROM de WHERE pos = 0)
        SELECT section_id, 0 AS pos, decision_id, coalesce(L[1], '') AS "when", 'go' AS "then", CAST(0.5 AS DOUBLE) AS confidence FROM dn JOIN f USING (section_id)
        UNION ALL SELECT section_id, 1, decision_id, 'w', 't', 1.0 FROM dn JOIN f USING (section_id)
        UNION ALL SELECT section_id, 2, 'given', 'w', 't', 1.0 FROM dn""",
)
def d13(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    decisions, _ = c.to_decisions(parsed, c.to_roles(parsed))
    return c.to_rules(parsed, decisions).select("section_id", "pos", "decision_id", "when", "then", "confidence")


@query(
    "d14_fold_knowhow_tasks",
    f"""WITH {_pre()} SELECT tk.task_id, md5(CASE WHEN knowhow IS NULL OR contains({sql_strip('instruction')}, knowhow) THEN instruction
          WHEN {sql_strip('instruction')} = '' THEN knowhow ELSE {sql_strip('instruction')} || chr(10) || knowhow END) AS instruction_hash
        FROM tk LEFT JOIN kht USING (task_id)""",
)
def d14_tasks(spark, sf_dir):
    parsed, _, tasks = _tasks(spark, sf_dir)
    return c.fold_knowhow_into_tasks(parsed, tasks).select("task_id", F.md5("instruction").alias("instruction_hash"))


@query(
    "d14_fold_knowhow_rules",
    f"""WITH {_pre()} SELECT section_id, {_sid('section_id', 'knowhow', "lang || ' 판단 기준'")} AS decision_id, lang || ' 판단 기준' AS decision_name,
          '업무 수행 시' AS "when", knowhow AS "then", CAST(0.8 AS DOUBLE) AS confidence FROM kh""",
)
def d14_rules(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    roles = c.to_roles(parsed)
    decisions, _ = c.to_decisions(parsed, roles)
    rules, created, _ = c.fold_knowhow_into_rules(parsed, decisions, roles)
    names = created.select("decision_id", F.col("name").alias("decision_name"))
    return rules.join(names, "decision_id").select("section_id", "decision_id", "decision_name", "when", "then", "confidence")


@query(
    "d15_reusable_skill_filter",
    f"WITH {_pre()} SELECT section_id, scope || ' skill' AS name, lang IN ('en', 'de') AS reusable FROM dn",
)
def d15(spark, sf_dir):
    rows = c.rows_of(_parsed(spark, sf_dir), "skills")
    return rows.select("section_id", "name", reusable_skill("name", "summary", "purpose").alias("reusable"))


@query(
    "d16_to_skills",
    f"""WITH {_pre()}, s AS (SELECT section_id, scope, lang, {_sid('section_id', 'skill', "lower(scope) || ' skill'", '0')} AS skill_id, L FROM dn WHERE lang IN ('en', 'de'))
        SELECT s.section_id, skill_id, role_id, coalesce(L[1], '') AS steps FROM s JOIN ro ON ro.scope = s.scope AND lower(ro.name) IN (s.lang, 'reviewer')""",
)
def d16(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    skills, made = c.to_skills(parsed, c.to_roles(parsed))
    return skills.join(made, "skill_id").select("section_id", "skill_id", "role_id", F.array_join("procedure", "\n").alias("steps"))


def _flows(spark, sf_dir):
    parsed, processes, tasks = _tasks(spark, sf_dir)
    tasks = settle(c.apply_task_process_mappings(parsed, settle(tasks), processes))
    gateways = settle(c.to_gateways(parsed, processes))
    return parsed, tasks, gateways, c.resolve_flow_ends(parsed, tasks, gateways)


_FLOW_COLUMNS = ["section_id", "from_type", "from_id", "to_type", "to_id", "condition"]


@query("d17_resolve_flow_ends", f"WITH {_pre()} SELECT section_id, from_type, from_id, to_type, to_id, condition FROM rf")
def d17(spark, sf_dir):
    return _flows(spark, sf_dir)[3].select(*_FLOW_COLUMNS)


@query(
    "d18_gateway_name",
    """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN p_brand || ' 여부 판단' WHEN 'PROMO' THEN p_name WHEN 'STANDARD' THEN '의사결정 분기 ' || p_size
              WHEN 'LARGE' THEN p_name || ' 여부 판단' ELSE '의사결정 분기 ' || p_size END AS gateway FROM part""",
)
def d18(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    kind = F.col("p_type")
    name = F.when(kind == "PROMO", F.col("p_name")).when(kind == "STANDARD", " 분기 ").when(kind == "LARGE", F.concat("p_name", F.lit("  여부"))).otherwise("")
    name = F.when(kind == "LARGE", F.lit("분기")).otherwise(name)
    description = F.when(kind == "ECONOMY", F.concat("p_brand", F.lit("인지  여부 확인"))).when(kind == "LARGE", F.concat("p_name", F.lit(" 여부"))).otherwise("")
    return with_gateway_name(part, "gateway", name, description, F.col("p_size")).select("p_partkey", "gateway")


@query(
    "d19_clean_conditions",
    """SELECT event_id, CASE event_type WHEN 'click' THEN '' WHEN 'view' THEN '' WHEN 'error' THEN '' ELSE event_type || ' ' || user_id END AS condition FROM events""",
)
def d19(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    kind = F.col("event_type")
    raw = F.when(kind == "click", "조건 1").when(kind == "view", " Case 2 ").when(kind == "error", "has task").otherwise(F.concat(F.lit(" "), kind, F.lit(" "), F.col("user_id"), F.lit(" ")))
    return events.select("event_id", clean_condition(raw).alias("condition"))


def _synthesized(spark, sf_dir):
    parsed, tasks, gateways, flows = _flows(spark, sf_dir)
    made, rewritten = c.synthesize_gateways(parsed, tasks, gateways, flows)
    return tasks, gateways.unionByName(made), made, rewritten


@query("d20_binary_branch_conditions", f"WITH {_pre()} SELECT section_id, from_type, from_id, to_type, to_id, condition FROM flows2")
def d20(spark, sf_dir):
    _, gateways, _, flows = _synthesized(spark, sf_dir)
    return c.binary_branch_conditions(flows, gateways).select(*_FLOW_COLUMNS)


@query("d21_synthesize_gateways", f"WITH {_pre()} SELECT section_id, from_type, from_id, to_type, to_id, condition FROM flows1")
def d21(spark, sf_dir):
    return _synthesized(spark, sf_dir)[3].select(*_FLOW_COLUMNS)


@query("d21_gateways", f"WITH {_pre()} SELECT section_id, gateway_id, process_id, regexp_replace({sql_squeeze('f')}, '^[ .,_-]+|[ .,_-]+$', '', 'g') || ' 여부 판단' AS name FROM fork")
def d21_gateways(spark, sf_dir):
    return _synthesized(spark, sf_dir)[2].select("section_id", "gateway_id", "process_id", "name")


@query("d22_hint_flows", f"WITH {_pre()} SELECT section_id, from_id, to_id FROM hint")
def d22(spark, sf_dir):
    return c.hint_flows(_tasks(spark, sf_dir)[2]).select("section_id", "from_id", "to_id")


@query("d23_default_flows", f"WITH {_pre()} SELECT section_id, from_id, to_id FROM dflt")
def d23(spark, sf_dir):
    tasks, gateways, _, flows = _synthesized(spark, sf_dir)
    flows = c.binary_branch_conditions(flows, gateways).unionByName(c.hint_flows(tasks))
    return c.default_flows(tasks, flows).select("section_id", "from_id", "to_id")


@query(
    "d24_name_id_map",
    f"WITH {_pre()} SELECT scope, lower(name) AS key, arg_max(proc_id, section_no * 10 + pos) AS id FROM pr GROUP BY ALL",
)
def d24(spark, sf_dir):
    return c.name_id_map(c.to_processes(_parsed(spark, sf_dir)), "proc_id")


@query(
    "d25_entity_evidence_map",
    f"""WITH {_pre()}, k AS (SELECT section_id, md5(L[1]) AS chunk_id FROM dn WHERE n > 0)
        SELECT 'process' AS entity_type, proc_id AS entity_id, chunk_id FROM pr JOIN k USING (section_id)
        UNION ALL SELECT 'role', role_id, chunk_id FROM ro JOIN k USING (section_id)
        UNION ALL SELECT 'task', task_id, chunk_id FROM tk JOIN k USING (section_id)""",
)
def d25(spark, sf_dir):
    parsed, processes, tasks = _tasks(spark, sf_dir)
    docs = table(spark, sf_dir, "documents")
    first = F.get(F.filter(F.transform(F.split("text", "\n"), strip), lambda x: x != ""), F.lit(0))
    chunks = docs.select(F.col("doc_id").cast("string").alias("section_id"), F.md5(first).alias("chunk_id"))
    return c.entity_evidence_map({"process": (processes, "proc_id"), "role": (c.to_roles(parsed), "role_id"), "task": (tasks, "task_id")}, chunks)
