"""Entity resolution queries (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from procweave.functions import fixed
from procweave.functions import text as t
from procweave.operators import resolve as r
from procweave.operators.graph import union_all
from procweave.plans.base import query, sql_compact, sql_grams, sql_norm, sql_strip, sql_tokens
from procweave.plans.readings import spread, table
from procweave.session import settle


def _sql_keys(x: str) -> str:
    return "list_distinct(flatten([" + ", ".join(f"regexp_extract_all(upper({x}), '{p}')" for p in fixed.BUSINESS_KEY_PATTERNS) + "]))"


def _docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def _set_hash(name):
    return F.md5(F.array_join(F.array_sort(name), "\n"))


def _sql_set_hash(x: str) -> str:
    return f"md5(array_to_string(list_sort({x}), chr(10)))"


@query("e1_normalize_text", f"SELECT doc_id, md5({sql_norm('text')}) AS norm_hash, md5({sql_compact('text')}) AS compact_hash FROM documents")
def e1(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(t.normalize("text")).alias("norm_hash"), F.md5(t.compact("text")).alias("compact_hash"))


@query("e2_tokens", f"WITH x AS (SELECT doc_id, {sql_tokens('text')} AS s FROM documents) SELECT doc_id, CAST(len(s) AS INTEGER) AS n, {_sql_set_hash('s')} AS hash FROM x")
def e2(spark, sf_dir):
    x = _docs(spark, sf_dir).select("doc_id", F.explode(F.array(t.tokens("text"))).alias("s"))
    return x.select("doc_id", F.size("s").alias("n"), _set_hash("s").alias("hash"))


@query("e3_char_ngrams", f"WITH x AS (SELECT doc_id, {sql_grams('text')} AS s FROM documents) SELECT doc_id, CAST(len(s) AS INTEGER) AS n, {_sql_set_hash('s')} AS hash FROM x")
def e3(spark, sf_dir):
    x = _docs(spark, sf_dir).select("doc_id", F.explode(F.array(t.char_ngrams("text"))).alias("s"))
    return x.select("doc_id", F.size("s").alias("n"), _set_hash("s").alias("hash"))


@query(
    "e4_business_keys",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'RQ_BP_' || lpad(CAST(user_id AS VARCHAR), 3, '0') WHEN 'view' THEN 'AA_BB_' || (event_id + 1000) WHEN 'signup' THEN 'BP_X1' ELSE '' END AS keys FROM events""",
)
def e4(spark, sf_dir):
    kind, user, eid = F.col("event_type"), F.col("user_id").cast("string"), F.col("event_id")
    said = (
        F.when(kind == "click", F.concat(F.lit("see rq_bp_"), F.lpad(user, 3, "0"), F.lit(", form")))
        .when(kind == "view", F.concat(F.lit("Aa_bb_"), (eid + 1000).cast("string")))
        .when(kind == "signup", F.lit("(bp_x1)")).otherwise(F.concat(F.lit("x_1 "), user))
    )
    return table(spark, sf_dir, "events").select("event_id", F.array_join(t.business_keys(said), ",").alias("keys"))


@query(
    "e5_jaccard",
    f"""WITH x AS (SELECT doc_id, source, {sql_tokens('text')} AS s FROM documents), f AS (SELECT source, min(doc_id) AS ref_id FROM documents GROUP BY 1)
        SELECT x.doc_id, ref_id, round(len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))), 6) AS score
        FROM x JOIN f USING (source) JOIN x y ON y.doc_id = ref_id""",
)
def e5(spark, sf_dir):
    x = _docs(spark, sf_dir).select("doc_id", "source", F.explode(F.array(t.tokens("text"))).alias("s"))
    ref = x.groupBy("source").agg(F.min("doc_id").alias("ref_id"))
    other = x.select(F.col("doc_id").alias("ref_id"), F.col("s").alias("s2"))
    return x.join(ref, "source").join(other, "ref_id").select("doc_id", "ref_id", F.round(t.jaccard("s", "s2"), 6).alias("score"))


# Dialogue: a conversation is a process, its turns are tasks done by the speaker's role.


def dialogue(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    first = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("opening"))
    none = F.lit(None).cast("string")
    processes = first.select(
        F.col("conv_id").alias("proc_id"), F.substring_index("opening", " ", 1).alias("name"), none.alias("description"), none.alias("purpose")
    )
    tid = F.concat_ws(":", "conv_id", "turn")
    tasks = turns.select(
        tid.alias("task_id"), F.col("conv_id").alias("process_id"), F.substring_index("text", "\n", 1).alias("name"), none.alias("description"),
        F.col("text").alias("instruction"), F.col("turn").cast("int").alias("order"),
    )
    role = turns.select(F.col("role").alias("role_id"), F.col("role").alias("name")).distinct()
    task_role = turns.select(tid.alias("task_id"), F.col("role").alias("role_id"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"))
    flows = turns.join(after, ["conv_id", "turn"]).select(
        F.col("turn").alias("pos"), tid.alias("from_id"), F.concat_ws(":", "conv_id", F.col("turn") + 1).alias("to_id"), F.concat_ws(" ", "role", "turn").alias("condition")
    )
    return {"process": processes, "task": tasks, "role": role, "task_role": task_role, "flow": flows}


def _evidence(spark, sf_dir, d, gather=r.evidence_parts):
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.concat(F.lit("c"), F.col("doc_id")).alias("chunk_id"), "doc_id", F.lit(0).alias("chunk_no"), "text")
    # Conversations are backed by the document of the same number.
    proof = d["process"].select(F.col("proc_id").alias("entity_id"), F.concat(F.lit("c"), F.col("proc_id")).alias("chunk_id"))
    return gather(d["process"], d["task"], proof, chunks)


def _signatures(spark, sf_dir):
    d = dialogue(spark, sf_dir)
    return d, settle(r.process_signatures(d["process"], d["task"], d["task_role"], d["role"], d["flow"], _evidence(spark, sf_dir, d)))


_SIG = f"""
evid AS (SELECT doc_id AS proc_id, {sql_strip("text || ' ' || " + sql_strip('text'))} AS evidence FROM documents),
t AS (SELECT conv_id AS proc_id, turn, role, split_part(text, chr(10), 1) AS name, split_part(text, chr(10), 1) || '  ' || text AS told FROM conversations),
fl AS (SELECT a.conv_id AS proc_id, string_agg(a.role || ' ' || a.turn, ' ' ORDER BY a.turn) AS blob
       FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 GROUP BY 1),
p AS (SELECT conv_id AS proc_id, split_part(arg_min(text, turn), ' ', 1) AS name, count(*) AS n_tasks FROM conversations GROUP BY 1),
tt AS (SELECT proc_id, list_distinct(flatten(list({sql_tokens('name')}))) AS task_tokens, list_distinct(flatten(list({sql_tokens('role')}))) AS role_tokens,
              string_agg(told || role, '' ORDER BY turn) AS story, list_distinct(flatten(list({_sql_keys('told')}))) AS tkeys FROM t GROUP BY 1),
s0 AS (SELECT p.proc_id, {sql_norm('p.name')} AS name_norm, n_tasks, task_tokens, role_tokens,
          list_distinct(list_concat({sql_tokens('p.name')}, {sql_tokens("coalesce(blob, '')")})) AS desc_tokens,
          p.name || coalesce(evidence, '') || story || coalesce(blob, '') AS narr,
          list_distinct(list_concat(tkeys, {_sql_keys("coalesce(evidence, '')")}, {_sql_keys("p.name")})) AS keys
       FROM p JOIN tt USING (proc_id) LEFT JOIN fl USING (proc_id) LEFT JOIN evid USING (proc_id)),
s AS (SELECT * EXCLUDE (narr), {sql_grams('narr')} AS narrative FROM s0)
"""


@query("e6_process_evidence_text", f"WITH {_SIG} SELECT p.proc_id, md5(evidence) AS evidence_hash FROM p JOIN evid USING (proc_id)")
def e6(spark, sf_dir):
    return _evidence(spark, sf_dir, dialogue(spark, sf_dir), r.process_evidence_text).select("proc_id", F.md5("evidence").alias("evidence_hash"))


@query(
    "e7_process_signature",
    f"""WITH {_SIG} SELECT proc_id, name_norm, n_tasks, """ + ", ".join(f"{_sql_set_hash(c)} AS {c}" for c in r.SETS) + " FROM s",
)
def e7(spark, sf_dir):
    return _signatures(spark, sf_dir)[1].select("proc_id", "name_norm", "n_tasks", *[_set_hash(c).alias(c) for c in r.SETS])


def _sql_jac(f: str) -> str:
    both = f"len(list_intersect(a.{f}, b.{f}))"
    return (
        f"CASE WHEN len(a.{f}) = 0 AND len(b.{f}) = 0 THEN 1.0::DOUBLE WHEN len(a.{f}) = 0 OR len(b.{f}) = 0 THEN 0.0::DOUBLE "
        f"ELSE {both}::DOUBLE / (len(a.{f}) + len(b.{f}) - {both}) END"
    )


_PAIRS = f"""
{_SIG},
j AS (SELECT a.proc_id AS a_id, b.proc_id AS b_id, {_sql_jac('task_tokens')} AS task_sim, {_sql_jac('role_tokens')} AS role_sim, {_sql_jac('desc_tokens')} AS desc_sim,
        {_sql_jac('narrative')} AS narrative_sim, CASE WHEN a.name_norm <> '' AND a.name_norm = b.name_norm THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS name_sim,
        len(list_intersect(a.keys, b.keys)) > 0 AS key_shared, len(a.keys) > 0 AND len(b.keys) > 0 AND len(list_intersect(a.keys, b.keys)) = 0 AS key_conflict
      FROM s a JOIN s b ON a.proc_id < b.proc_id),
k1 AS (SELECT *, 0.42*task_sim + 0.16*role_sim + 0.12*desc_sim + 0.24*narrative_sim + 0.03*name_sim AS w FROM j),
k2 AS (SELECT *, CASE WHEN task_sim >= 0.62 THEN greatest(w, 0.9) ELSE w END AS w2 FROM k1),
k3 AS (SELECT *, CASE WHEN key_shared THEN greatest(w2, 0.94) ELSE w2 END * CASE WHEN key_conflict THEN 0.75 ELSE 1 END AS w3 FROM k2),
k4 AS (SELECT *, CASE WHEN task_sim < 0.2 AND narrative_sim >= 0.45 AND role_sim >= 0.2 THEN greatest(w3, 0.72) ELSE w3 END AS score FROM k3),
acc AS (SELECT * FROM k4 WHERE score >= CASE WHEN key_shared THEN 0.55 WHEN task_sim < 0.2 AND narrative_sim >= 0.45 THEN 0.64 ELSE 0.68 END)
"""
_NUMS = ["task_sim", "role_sim", "desc_sim", "narrative_sim", "name_sim", "score"]


@query(
    "e8_process_similarity",
    f"WITH {_PAIRS} SELECT a_id, b_id, key_shared, key_conflict, " + ", ".join(f"round(CAST({n} AS DOUBLE), 6) AS {n}" for n in _NUMS) + " FROM k4",
)
def e8(spark, sf_dir):
    _, sigs = _signatures(spark, sf_dir)
    scored = r.score_pairs(None, sigs)
    return scored.select("a_id", "b_id", "key_shared", "key_conflict", *[F.round(n, 6).alias(n) for n in _NUMS])


@query(
    "e10_accept_pair",
    f"WITH {_PAIRS} SELECT a_id, b_id, key_shared, key_conflict, " + ", ".join(f"round(CAST({n} AS DOUBLE), 6) AS {n}" for n in _NUMS) + " FROM acc",
)
def e10(spark, sf_dir):
    _, sigs = _signatures(spark, sf_dir)
    return r.accepted_pairs(sigs).select("a_id", "b_id", "key_shared", "key_conflict", *[F.round(n, 6).alias(n) for n in _NUMS])


_COMPONENTS = """
link AS (SELECT a_id AS x, b_id AS y FROM acc UNION SELECT b_id, a_id FROM acc),
reach AS (SELECT proc_id AS x, proc_id AS y FROM s UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y),
comp AS (SELECT x AS node, min(y) AS component FROM reach GROUP BY 1)
"""


@query("e9_candidate_clusters", f"WITH RECURSIVE {_PAIRS}, {_COMPONENTS} SELECT node, component FROM comp WHERE node IN (SELECT x FROM link)")
def e9(spark, sf_dir):
    _, sigs = _signatures(spark, sf_dir)
    return r.connected_components(r.accepted_edges(sigs))


_LINES = f"""
ll AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '') AS L FROM documents),
k AS (SELECT doc_id, 'f' || L[1] AS k FROM ll WHERE len(L) > 0 UNION SELECT doc_id, 'l' || L[-1] FROM ll WHERE len(L) > 0),
hub AS (SELECT k, min(doc_id) AS hub FROM k GROUP BY 1),
e AS (SELECT DISTINCT hub AS a, doc_id AS b FROM k JOIN hub USING (k) WHERE hub <> doc_id)
"""


def _line_edges(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    L = F.filter(F.transform(F.split("text", "\n"), t.strip), lambda x: x != "")
    k = docs.select("doc_id", F.explode(F.array(L)).alias("L")).where(F.size("L") > 0).select(
        "doc_id", F.explode(F.array(F.concat(F.lit("f"), F.get("L", F.lit(0))), F.concat(F.lit("l"), F.element_at("L", -1)))).alias("k")
    )
    hub = k.groupBy("k").agg(F.min("doc_id").alias("a"))
    return k.join(hub, "k").where("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct()


@query(
    "e11_connected_components",
    f"""WITH RECURSIVE {_LINES}, l AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
        c AS (SELECT x, x AS y FROM l UNION SELECT c.x, l.y FROM c JOIN l ON l.x = c.y) SELECT x AS node, min(y) AS component FROM c GROUP BY 1""",
)
def e11(spark, sf_dir):
    return r.connected_components(_line_edges(spark, sf_dir))


_REP = f"""
{_PAIRS}, {_COMPONENTS},
rep AS (SELECT component, arg_min(node, -n_tasks * 100000 + node) AS new_id FROM comp JOIN s ON proc_id = node GROUP BY 1),
map AS (SELECT node AS old_id, new_id FROM comp JOIN rep USING (component))
"""


def _merged(spark, sf_dir):
    d, sigs = _signatures(spark, sf_dir)
    merged, mapping = r.representatives(d["process"], r.connected_components(r.accepted_edges(sigs)), sigs)
    return d, merged, mapping


@query("e12_representative", f"WITH RECURSIVE {_REP} SELECT p.proc_id, p.name FROM p WHERE proc_id IN (SELECT new_id FROM map)")
def e12(spark, sf_dir):
    return _merged(spark, sf_dir)[1].select("proc_id", "name")


@query("e13_remap_ids", f"WITH RECURSIVE {_REP} SELECT conv_id || ':' || turn AS task_id, new_id AS process_id FROM conversations JOIN map ON old_id = conv_id")
def e13(spark, sf_dir):
    d, _, mapping = _merged(spark, sf_dir)
    return r.remap_ids(d["task"], mapping, "process_id").select("task_id", "process_id")


# Tasks of one supplier and return flag: the part names of its line items, by line number.


def _part_tasks(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    tid = F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 8, "0"), "l_linenumber", "l_partkey", "l_suppkey")
    tasks = lines.select(
        tid.alias("task_id"), F.col("l_suppkey").cast("string").alias("process_id"), F.col("p_name").alias("name"),
        F.col("l_returnflag").alias("description"), F.concat_ws("\n", "p_name", "l_linestatus").alias("instruction"), F.col("l_linenumber").alias("order"),
    )
    return tasks, lines.select(tid.alias("task_id"), F.col("l_returnflag").alias("role_id"))


_CLASSES = """
pt AS (SELECT lpad(CAST(l_orderkey AS VARCHAR), 8, '0') || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS task_id, CAST(l_suppkey AS VARCHAR) AS process_id,
         l_returnflag AS role_id, lower(p_name) AS key, l_linenumber AS "order", l_linestatus, p_name FROM lineitem JOIN part ON p_partkey = l_partkey),
cl AS (SELECT process_id, role_id, key, "order", min(task_id) AS class_id FROM pt GROUP BY ALL)
"""
_CHARS = "list_distinct(string_split({x}, ''))"


@query(
    "e14_task_pairs",
    f"""WITH {_CLASSES},
        j AS (SELECT a.process_id, a.role_id, a.class_id AS a_id, b.class_id AS b_id, a.key AS ak, b.key AS bk, a."order" AS ao, b."order" AS bo
              FROM cl a JOIN cl b ON a.process_id = b.process_id AND a.role_id = b.role_id AND (a."order" < b."order" OR (a."order" = b."order" AND a.class_id < b.class_id))),
        w AS (SELECT *, list_distinct(string_split(ak, '')) AS ca, list_distinct(string_split(bk, '')) AS cb FROM j)
        SELECT process_id, role_id, a_id, b_id FROM w WHERE contains(bk, ak) OR contains(ak, bk) OR replace(ak, ' ', '') = replace(bk, ' ', '')
          OR (bo - ao <= 1 AND len(list_intersect(ca, cb))::DOUBLE / (len(ca) + len(cb) - len(list_intersect(ca, cb))) > 0.6)""",
)
def e14(spark, sf_dir):
    classes = settle(r.task_classes(*_part_tasks(spark, sf_dir)))
    return r.task_pairs(classes).select("process_id", "role_id", "a_id", "b_id")


def _leaders(spark, sf_dir):
    tasks, task_role = _part_tasks(spark, sf_dir)
    classes = settle(r.task_classes(tasks, task_role))
    return tasks, task_role, settle(r.merge_tasks_greedy(classes))


# In order, each class joins the first leader that is the same task, or leads.
_LEADERS = f"""
{_CLASSES},
o AS (SELECT *, row_number() OVER (PARTITION BY process_id, role_id ORDER BY "order", class_id) AS n FROM cl),
led AS (
  SELECT process_id, role_id, n, class_id, class_id AS leader_id, [{{'id': class_id, 'k': key, 'o': "order"}}] AS heads FROM o WHERE n = 1
  UNION ALL
  SELECT process_id, role_id, n, class_id, CASE WHEN len(hit) > 0 THEN hit[1].id ELSE class_id END,
    CASE WHEN len(hit) > 0 THEN heads ELSE list_append(heads, {{'id': class_id, 'k': key, 'o': ord}}) END
  FROM (
    SELECT o.process_id, o.role_id, o.n, o.class_id, o.key, o."order" AS ord, heads,
      list_filter(heads, lambda x: contains(o.key, x.k) OR contains(x.k, o.key) OR replace(o.key, ' ', '') = replace(x.k, ' ', '')
        OR (o."order" - x.o <= 1 AND len(list_intersect({_CHARS.format(x='o.key')}, {_CHARS.format(x='x.k')}))::DOUBLE
          / len(list_distinct(list_concat({_CHARS.format(x='o.key')}, {_CHARS.format(x='x.k')}))) > 0.6)) AS hit
    FROM led JOIN o ON o.process_id = led.process_id AND o.role_id = led.role_id AND o.n = led.n + 1
  )
),
lt AS (SELECT pt.*, leader_id, CAST(task_id <> leader_id AS INTEGER) AS f FROM pt JOIN cl USING (process_id, role_id, key, "order") JOIN led USING (class_id)),
best AS (SELECT leader_id, task_id, process_id, role_id, p_name, "order" FROM lt QUALIFY row_number() OVER (PARTITION BY leader_id ORDER BY length(p_name) DESC, f, "order", task_id) = 1)
"""


@query("e15_merge_tasks_greedy", f"WITH RECURSIVE {_LEADERS} SELECT task_id, leader_id FROM lt")
def e15(spark, sf_dir):
    return _leaders(spark, sf_dir)[2]


@query(
    "e16_merge_task_content",
    f"""WITH RECURSIVE {_LEADERS},
        line AS (SELECT leader_id, f, "order", task_id, 0 AS n, trim(p_name) AS line FROM lt UNION ALL SELECT leader_id, f, "order", task_id, 1, trim(l_linestatus) FROM lt),
        fresh AS (SELECT * FROM line WHERE line <> '' QUALIFY row_number() OVER (PARTITION BY leader_id, line ORDER BY f, "order", task_id, n) = 1),
        inst AS (SELECT leader_id, string_agg(line, chr(10) ORDER BY f, "order", task_id, n) AS instruction FROM fresh GROUP BY 1)
        SELECT task_id, process_id, p_name AS name, role_id AS description, instruction, "order" FROM best JOIN inst USING (leader_id)""",
)
def e16(spark, sf_dir):
    tasks, _, leaders = _leaders(spark, sf_dir)
    return r.merge_task_content(tasks, leaders)[0]


@query("e17_carry_task_roles", f"WITH RECURSIVE {_LEADERS} SELECT task_id, role_id FROM best")
def e17(spark, sf_dir):
    tasks, task_role, leaders = _leaders(spark, sf_dir)
    return r.carry_task_roles(task_role, r.merge_task_content(tasks, leaders)[1])


def _named_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("name"), F.col("source").alias("description"))


@query(
    "e18_dedupe_by_name",
    f"""SELECT min(doc_id) AS doc_id, arg_min(split_part(text, chr(10), 1), doc_id) AS name FROM documents GROUP BY lower({sql_strip('split_part(text, chr(10), 1)')})""",
)
def e18(spark, sf_dir):
    return r.dedupe_by_name(_named_docs(spark, sf_dir), "doc_id", ["doc_id"]).select("doc_id", "name")


_SAME = f"""
n AS (SELECT doc_id, split_part(text, chr(10), 1) AS name, text AS description FROM documents),
g AS (SELECT *, CASE WHEN {sql_norm('name')} = '' THEN '__' || doc_id ELSE {sql_norm('name')} END AS key FROM n),
m AS (SELECT key, min(doc_id) AS new_id, arg_min(doc_id, -length(description) * 10000000 + doc_id) AS best_id, count(*) AS n_sources FROM g GROUP BY 1)
"""


def _doc_processes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("proc_id"), F.substring_index("text", "\n", 1).alias("name"), F.col("text").alias("description"))


@query("e19_merge_same_name_processes", f"WITH {_SAME} SELECT new_id AS proc_id, md5(n.name) AS name_hash, md5(n.description) AS description_hash, n_sources FROM m JOIN n ON doc_id = best_id")
def e19(spark, sf_dir):
    merged, _ = r.merge_same_name_processes(_doc_processes(spark, sf_dir), "proc_id")
    return merged.select("proc_id", F.md5("name").alias("name_hash"), F.md5("description").alias("description_hash"), "n_sources")


@query("e19_dedupe_members", """SELECT l_suppkey, l_partkey, min(l_orderkey) AS first_order FROM lineitem GROUP BY ALL""")
def e19_members(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey")
    kept = r.dedupe_members(lines, "l_suppkey", ["l_partkey"], ["l_orderkey"])
    return kept.select("l_suppkey", "l_partkey", F.col("l_orderkey").alias("first_order"))


@query(
    "e19_merge_flows",
    """SELECT user_id, event_type AS source, next_type AS target, condition, min(event_id) AS first_event FROM (
         SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type, CASE WHEN value > 10 THEN 'high' ELSE '' END AS condition FROM events)
       WHERE next_type IS NOT NULL GROUP BY ALL""",
)
def e19_flows(spark, sf_dir):
    from procweave.operators.ordered import scan

    steps = scan(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], lead={"target": "event_type"}).where("target IS NOT NULL")
    flows = steps.select("user_id", F.col("event_type").alias("source"), "target", F.when(F.col("value") > 10, "high").otherwise("").alias("condition"), "event_id")
    return r.merge_flows(flows, "user_id", ["event_id"]).withColumnRenamed("event_id", "first_event")


@query(
    "e20_merge_graph_elements",
    """WITH a AS (SELECT l_orderkey AS graph_id, 'Skill:' || l_partkey AS elem_id FROM lineitem WHERE l_returnflag <> 'N'), b AS (SELECT l_orderkey, 'Skill:' || l_partkey FROM lineitem WHERE l_returnflag <> 'R'),
       u AS (SELECT * FROM a UNION SELECT * FROM b) SELECT graph_id, count(*) AS n_elements FROM u GROUP BY 1""",
)
def e20(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("graph_id"), F.concat(F.lit("Skill:"), F.col("l_partkey")).alias("elem_id"), "l_returnflag")
    return r.merge_graph_elements(lines.where("l_returnflag <> 'N'"), lines.where("l_returnflag <> 'R'"))[1]


@query(
    "e21_merge_exact_names",
    """WITH n AS (SELECT doc_id, split_part(text, chr(10), 1) AS name, source FROM documents), d AS (SELECT name, source, min(doc_id) AS seen FROM n GROUP BY ALL),
       f AS (SELECT d.*, EXISTS (SELECT 1 FROM d x WHERE x.name = d.name AND x.seen < d.seen AND contains(x.source, d.source)) AS held FROM d)
       SELECT md5(name) AS name_hash, min(seen) AS doc_id, string_agg(source, chr(10) ORDER BY seen) FILTER (WHERE NOT held) AS description FROM f GROUP BY name""",
)
def e21(spark, sf_dir):
    merged = r.merge_exact_names(_named_docs(spark, sf_dir), "doc_id", "doc_id")
    return merged.select(F.md5("name").alias("name_hash"), "doc_id", "description")


@query(
    "e22_alias_output",
    f"""WITH {_SAME}, moved AS (SELECT new_id AS entity_id, {sql_norm('name')} AS normalized, name FROM g JOIN m USING (key) WHERE doc_id <> new_id AND {sql_strip('name')} <> '')
        SELECT CAST(entity_id AS VARCHAR) AS entity_id, md5(normalized) AS normalized_hash, md5(min(name)) AS text_hash FROM moved GROUP BY entity_id, normalized""",
)
def e22(spark, sf_dir):
    processes = _doc_processes(spark, sf_dir)
    _, mapping = r.merge_same_name_processes(processes, "proc_id")
    found = r.aliases(processes, mapping, "proc_id", "process")
    return found.select(F.col("entity_id").cast("string").alias("entity_id"), F.md5("normalized").alias("normalized_hash"), F.md5("text").alias("text_hash"))
