"""Matching and form queries (I, J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from procweave.functions.text import human_required, skill_key, skill_name_from_markdown
from procweave.operators import match as m
from procweave.plans.base import query, sql_norm
from procweave.plans.readings import spread, table

# Regions, nations and their suppliers and customers are an organisation; suppliers are agents.


def _org(spark, sf_dir):
    tag = lambda p, c: F.concat(F.lit(p), F.col(c))
    region = table(spark, sf_dir, "region").select(tag("r", "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(True).alias("is_team"), F.col("r_name").alias("name"))
    nation = table(spark, sf_dir, "nation").select(tag("n", "n_nationkey").alias("node_id"), tag("r", "n_regionkey").alias("parent_id"), F.col("n_nationkey").isin(1, 2, 3).alias("is_team"), F.col("n_name").alias("name"))
    supplier = table(spark, sf_dir, "supplier").select(tag("s", "s_suppkey").alias("node_id"), tag("n", "s_nationkey").alias("parent_id"), F.lit(False).alias("is_team"), F.col("s_name").alias("name"))
    return region.unionByName(nation).unionByName(supplier)


@query(
    "i1_flatten_org",
    """SELECT CASE WHEN n_nationkey IN (1, 2, 3) THEN 'n' || n_nationkey ELSE 'r' || n_regionkey END AS team_id, 's' || s_suppkey AS member_id FROM supplier JOIN nation ON s_nationkey = n_nationkey
       UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation WHERE n_nationkey NOT IN (1, 2, 3)""",
)
def i1(spark, sf_dir):
    return m.flatten_org(_org(spark, sf_dir))[1]


def _users(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_custkey").alias("pos"), F.concat(F.lit("User "), F.col("c_custkey")).alias("username"), F.col("c_mktsegment").alias("role"),
        F.concat(F.lit("N"), F.col("c_nationkey"), F.lit(" desk")).alias("alias"), (F.col("c_acctbal") < 0).alias("is_agent"),
    )


def _roles(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("role_id"),
        F.when(F.col("s_acctbal") < 2000, F.concat(F.lit("user"), F.col("s_suppkey"))).when(F.col("s_acctbal") < 4000, F.concat(F.lit("n"), F.col("s_nationkey"), F.lit(" Desk lead")))
        .when(F.col("s_acctbal") < 6000, "build").otherwise(F.concat(F.lit("nobody "), F.col("s_suppkey"))).alias("name"),
    )


_PEOPLE = """
u0 AS (SELECT c_custkey AS id, c_acctbal < 0 AS is_agent, unnest(['user' || c_custkey, lower(c_mktsegment), 'n' || c_nationkey || 'desk']) AS nm FROM customer),
r AS (SELECT s_suppkey AS role_id, CASE WHEN s_acctbal < 2000 THEN 'user' || s_suppkey WHEN s_acctbal < 4000 THEN 'n' || s_nationkey || 'desklead' WHEN s_acctbal < 6000 THEN 'build' ELSE 'nobody' || s_suppkey END AS key FROM supplier),
hit AS (SELECT role_id, id, is_agent, nm = key AS exact FROM r JOIN u0 ON nm = key OR contains(key, nm) OR contains(nm, key)),
best AS (SELECT role_id, id AS user_id, is_agent, exact FROM (SELECT *, row_number() OVER (PARTITION BY role_id ORDER BY is_agent DESC, exact DESC, id) AS rn FROM hit) WHERE rn = 1)
"""


@query("i2_match_role", f"WITH {_PEOPLE} SELECT * FROM best")
def i2(spark, sf_dir):
    return m.match_roles(_roles(spark, sf_dir), _users(spark, sf_dir))


def _teams(spark, sf_dir):
    from procweave.functions.text import compact

    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("team_id"), compact(F.concat(F.lit("n"), F.col("n_nationkey"), F.lit(" desk"))).alias("key"))


@query("i3_team_candidates", f"WITH {_PEOPLE} SELECT role_id, n_nationkey AS team_id FROM r JOIN nation ON contains(key, 'n' || n_nationkey || 'desk') OR contains('n' || n_nationkey || 'desk', key)")
def i3(spark, sf_dir):
    return m.team_candidates(_roles(spark, sf_dir), _teams(spark, sf_dir)).select("role_id", "team_id")


@query(
    "i4_agent_candidates",
    f"""WITH {_PEOPLE}, a AS (SELECT * FROM u0 WHERE is_agent),
        s AS (SELECT role_id, id, max(CASE WHEN nm = key THEN 1.0 WHEN contains(key, nm) OR contains(nm, key) THEN 0.8 ELSE 0.5 END) AS score FROM r JOIN a
              ON nm = key OR contains(key, nm) OR contains(nm, key) OR (length(key) >= 3 AND (contains(nm, left(key, 3)) OR contains(nm, right(key, 3)))) GROUP BY ALL),
        t AS (SELECT *, row_number() OVER (PARTITION BY role_id ORDER BY score DESC, id) AS rank FROM s),
        f AS (SELECT role_id, c_custkey AS id, 0.0 AS score, rk AS rank FROM r, (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS rk FROM customer WHERE c_acctbal < 0) WHERE rk <= 20 AND role_id NOT IN (SELECT role_id FROM s))
        SELECT role_id, id AS agent_id, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM t UNION ALL SELECT role_id, id, score, rank FROM f""",
)
def i4(spark, sf_dir):
    return m.agent_candidates(_roles(spark, sf_dir), _users(spark, sf_dir).where("is_agent"))


@query(
    "i5_assignment_hints",
    f"""WITH {_PEOPLE}, ag AS (SELECT * FROM best WHERE role_id >= 0)
        SELECT r.role_id, CASE WHEN user_id IS NOT NULL THEN 'user' WHEN n_nationkey IS NOT NULL THEN 'team' ELSE 'open' END AS kind, coalesce(user_id, n_nationkey) AS target_id, coalesce(is_agent, false) AS is_agent
        FROM r LEFT JOIN ag USING (role_id) LEFT JOIN nation ON key = 'n' || n_nationkey || 'desk'""",
)
def i5(spark, sf_dir):
    return m.assignment_hints(_roles(spark, sf_dir), _users(spark, sf_dir), _teams(spark, sf_dir))


@query(
    "i6_human_required",
    """SELECT event_id, event_type IN ('click', 'view') AS human FROM events""",
)
def i6(spark, sf_dir):
    kind = F.col("event_type")
    text = F.when(kind == "click", "신청서 제 출").when(kind == "view", "계약 승인").when(kind == "purchase", "신청 자동 처리").otherwise("plain")
    return table(spark, sf_dir, "events").select("event_id", human_required(text).alias("human"))


def _activities(spark, sf_dir):
    roles = _roles(spark, sf_dir).select("role_id", F.col("name").alias("role"))
    words = F.when(F.col("role_id") % 3 == 0, "승인 machinery").when(F.col("role_id") % 3 == 1, "look at furniture").otherwise("zz")
    return roles.select(
        F.col("role_id").alias("activity_id"), words.alias("name"), "role", F.lit("").alias("instruction"), F.lit("").alias("description"),
        F.when(F.col("role_id") % 5 == 0, F.col("role_id")).alias("agent"),
    )


@query(
    "i7_pick_agent",
    f"""WITH {_PEOPLE}, act AS (SELECT role_id AS activity_id, CASE role_id % 3 WHEN 0 THEN '승인machinery' WHEN 1 THEN 'lookatfurniture' ELSE 'zz' END AS t, CASE WHEN role_id % 5 = 0 THEN role_id END AS agent FROM r),
        kept AS (SELECT activity_id, agent AS agent_id, 0 AS rank FROM act JOIN customer ON c_custkey = agent AND c_acctbal < 0),
        byr AS (SELECT activity_id, user_id AS agent_id, 1 AS rank FROM act JOIN best ON role_id = activity_id WHERE is_agent AND activity_id % 3 <> 0),
        byt AS (SELECT activity_id, min(id) AS agent_id, 2 AS rank FROM act JOIN u0 ON is_agent AND (contains(t, nm) OR contains(nm, t)) GROUP BY 1),
        x AS (SELECT *, row_number() OVER (PARTITION BY activity_id ORDER BY rank) AS rn FROM (SELECT * FROM kept UNION ALL SELECT * FROM byr UNION ALL SELECT * FROM byt))
        SELECT activity_id, agent_id, CAST(rank AS INTEGER) AS rank FROM act LEFT JOIN (SELECT * FROM x WHERE rn = 1) USING (activity_id)""",
)
def i7(spark, sf_dir):
    return m.pick_agents(_activities(spark, sf_dir), _users(spark, sf_dir))


@query(
    "i8_apply_plan",
    """SELECT l_suppkey AS proc_id, k AS activity_id, CASE WHEN k < 20 AND a < 1000 THEN a END AS agent_id, NOT coalesce(k < 20 AND a < 1000, false) AS unresolved
       FROM (SELECT l_suppkey, l_partkey AS k, max(CASE WHEN l_partkey < 20 AND c_custkey IS NOT NULL THEN l_partkey END) AS a FROM lineitem LEFT JOIN customer ON c_custkey = l_partkey AND c_acctbal < 0 GROUP BY ALL)""",
)
def i8(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("proc_id"), F.col("l_partkey").alias("activity_id")).distinct()
    acts = lines.withColumn("name", F.concat(F.lit("Part "), F.col("activity_id")))
    some = lines.where("activity_id < 20")
    plan = some.where("activity_id < 10").select("proc_id", "activity_id", F.lit(None).cast("string").alias("activity_name"), F.col("activity_id").alias("agent_id")).unionByName(
        some.where("activity_id >= 10").select("proc_id", F.lit(None).cast("long").alias("activity_id"), F.concat(F.lit("PART"), F.col("activity_id")).alias("activity_name"), F.col("activity_id").alias("agent_id"))
    )
    return m.apply_plan(acts, plan, _users(spark, sf_dir).where("is_agent"))


_SKILL_SETS = f"""
a AS (SELECT item_id AS left_id, {sql_norm('text')} AS lt FROM benchmark), s AS (SELECT doc_id AS skill, {sql_norm('text')} AS st FROM documents),
aw AS (SELECT left_id, lt, list_distinct(list_filter(string_split(lt, ' '), lambda x: length(x) >= 2)) AS lw FROM a), sw AS (SELECT skill, st, list_distinct(list_filter(string_split(st, ' '), lambda x: length(x) >= 2)) AS sw FROM s),
j AS (SELECT left_id, skill, contains(st, lt) OR contains(lt, st) AS held, len(list_intersect(lw, sw)) AS common, len(lw) AS nl, len(sw) AS ns FROM aw, sw)
"""


def _texts(spark, sf_dir):
    left = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("left_id"), "text")
    return left, spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("skill"), "text"))


@query("i9_skill_score_activity", f"WITH {_SKILL_SETS} SELECT left_id, skill, round(CASE WHEN held THEN 0.95 ELSE least(0.9, common::DOUBLE / nl) END, 6) AS score FROM j WHERE held OR common > 0")
def i9(spark, sf_dir):
    return m.skill_scores_for_activities(*_texts(spark, sf_dir)).withColumn("score", F.round("score", 6))


_AGENT_SCORE = "CASE WHEN held THEN 0.95 ELSE least(0.98, common::DOUBLE / (nl + ns - common) * 0.55 + common::DOUBLE / ns * 0.45) END"


@query("i10_skill_score_agent", f"WITH {_SKILL_SETS} SELECT left_id, skill, round({_AGENT_SCORE}, 6) AS score FROM j WHERE held OR common > 0")
def i10(spark, sf_dir):
    return m.skill_scores_for_agents(*_texts(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(
    "i11_assign_skills",
    f"""WITH {_SKILL_SETS}, x AS (SELECT left_id, skill, round(CASE WHEN held THEN 0.95 ELSE least(0.9, common::DOUBLE / nl) END, 9) AS s1, round({_AGENT_SCORE}, 9) AS s2 FROM j WHERE held OR common > 0),
        t1 AS (SELECT left_id, skill, row_number() OVER (PARTITION BY left_id ORDER BY s1 DESC, skill) AS rn FROM x WHERE s1 >= 0.35), t2 AS (SELECT left_id, skill, row_number() OVER (PARTITION BY left_id ORDER BY s2 DESC, skill) AS rn FROM x WHERE s2 >= 0.22)
        SELECT left_id + 1000 AS agent_id, skill FROM t1 WHERE rn <= 5 UNION SELECT left_id, skill FROM t2 WHERE rn <= 5""",
)
def i11(spark, sf_dir):
    left, skills = _texts(spark, sf_dir)
    rounded = lambda d: d.withColumn("score", F.round("score", 9))
    owner = left.select(F.col("left_id").alias("activity_id"), (F.col("left_id") + 1000).alias("agent_id"))
    return m.assign_skills(rounded(m.skill_scores_for_activities(left, skills)), owner, rounded(m.skill_scores_for_agents(left, skills)))


@query("i12_merge_skill_lists", "SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' THEN 'Brand#1,' || p_type ELSE 'Brand#1,' || p_brand || ',' || p_type END AS skills FROM part")
def i12(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", m.merge_skill_lists(F.concat(F.lit(" Brand#1, ,"), "p_brand"), F.array("p_type", F.lit(" "), F.concat(F.lit(" "), "p_brand"))).alias("skills"))


@query("i13_clean_skill_key", "SELECT page_id, substr(replace(replace(url, '/', '_'), '..', '_'), 1, 160) AS skill_key, 'page ' || page_id AS name FROM pages")
def i13(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    body = F.when(F.length("url") % 2 == 0, F.concat(F.lit("---\nname: 'page "), F.col("page_id"), F.lit("'\n---\ntext"))).otherwise(F.concat(F.lit("intro\n# Skill: page  "), F.col("page_id"), F.lit("\nx")))
    return pages.select("page_id", skill_key("url").alias("skill_key"), skill_name_from_markdown(body).alias("name"))


_ANCHORS = """
t AS (SELECT page_id, regexp_extract_all(html, '(?is)<((?:a|li|h1)(?:\\s(?:[^>"'']|"[^"]*"|''[^'']*'')*)?)/?>', 1) AS ts FROM pages),
f AS (SELECT page_id, unnest(ts) AS tag, generate_subscripts(ts, 1) - 1 AS pos FROM t)
"""


@query("j1_extract_fields", f"WITH {_ANCHORS} SELECT page_id, CAST(pos AS INTEGER) AS pos, lower(regexp_extract(tag, '^([^\\s/>]+)', 1)) AS tag_name FROM f")
def j1(spark, sf_dir):
    return m.extract_fields(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id", tags=["a", "li", "h1"]).select("page_id", "pos", "tag_name")


@query(
    "j2_form_id",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'f#' || user_id WHEN 'view' THEN user_id || '_a' || event_id || '_form' ELSE user_id || '_a' || event_id || '_form' END AS form_id FROM events""",
)
def j2(spark, sf_dir):
    kind = F.col("event_type")
    acts = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("proc_id"), F.concat(F.lit("a"), F.col("event_id")).alias("id"),
        F.when(kind == "click", F.concat(F.lit("formHandler: f/"), F.col("user_id"))).when(kind == "view", "formHandler:defaultform").otherwise("other").alias("tool"),
    )
    return m.with_form_ids(acts).select("event_id", "form_id")


def _fields(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_orderkey").cast("string").alias("form_id"), F.col("l_partkey").cast("string").alias("key"), F.col("l_returnflag").alias("text"), F.lit("text").alias("type"), (F.col("l_linenumber") * 100000 + F.col("l_suppkey")).alias("pos"))


@query("j3_field_refs", "SELECT CAST(l_orderkey AS VARCHAR) AS form_id, l_orderkey || '.' || l_partkey AS ref, min(l_linenumber * 100000 + l_suppkey) AS pos FROM lineitem GROUP BY ALL")
def j3(spark, sf_dir):
    return m.field_refs(_fields(spark, sf_dir)).select("form_id", "ref", "pos")


# Orders of a customer precede the later ones of the same day or after; their line items are the fields.
_INPUTS = """
o AS (SELECT o_custkey AS proc_id, o_orderkey AS id, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders),
c AS (SELECT DISTINCT proc_id, nxt AS id, l_orderkey || '.' || l_partkey AS ref, o.id AS at FROM o JOIN lineitem ON l_orderkey = o.id WHERE nxt IS NOT NULL)
"""


def _inputs(spark, sf_dir):
    from procweave.operators.ordered import scan

    orders = scan(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], lead={"nxt": "o_orderkey"})
    pairs = orders.where("nxt IS NOT NULL").select(F.col("o_custkey").alias("proc_id"), F.col("nxt").alias("id"), F.col("o_orderkey").alias("predecessor"))
    forms = orders.select(F.col("o_custkey").alias("proc_id"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("form_id"), F.col("o_orderkey").alias("at"))
    return m.input_candidates(pairs, forms, m.field_refs(_fields(spark, sf_dir)))


@query("j4_input_candidates", f"WITH {_INPUTS} SELECT proc_id, id, ref FROM c")
def j4(spark, sf_dir):
    return _inputs(spark, sf_dir).select("proc_id", "id", "ref")


@query(
    "j5_restrict_inputs",
    f"""WITH {_INPUTS}, g AS (SELECT l_orderkey || '.' || l_partkey AS ref FROM lineitem WHERE l_returnflag = 'R'), ok AS (SELECT * FROM c WHERE ref IN (SELECT ref FROM g))
        SELECT proc_id, id, ref FROM ok UNION ALL SELECT proc_id, id, ref FROM c WHERE (proc_id, id) NOT IN (SELECT (proc_id, id) FROM ok)""",
)
def j5(spark, sf_dir):
    candidates = _inputs(spark, sf_dir)
    red = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.concat_ws(".", "l_orderkey", "l_partkey").alias("ref")).distinct()
    return m.restrict_inputs(candidates, candidates.join(red, "ref", "left_semi")).select("proc_id", "id", "ref")
