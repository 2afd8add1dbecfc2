"""Matching of roles, people, agents and skills, and form inputs.

Containment in either direction is two filed lookups (names in keys, keys in names), never a
comparison of every role with every person.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procweave.functions import fixed
from procweave.functions.text import blank, compact, form_id, human_required, normalize, null_if_blank, or_blank, skill_key, strip
from procweave.operators.contain import contained_in
from procweave.operators.graph import paired_by_name, union_all
from procweave.operators.ordered import first_per_key, top_per_key
from procweave.session import settle

NAME_FIELDS = ["username", "role", "alias"]
PROFILE_FIELDS = ["username", "role", "alias", "description", "goal", "persona"]


def flatten_org(org: DataFrame, max_depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Teams by normalised name, and distinct (team_id, member_id) of members under their nearest team.

    ``org`` is the adjacency (node_id, parent_id, is_team, name). Each round settles the nodes one
    level further down, until none is left. A loop is an error, as is a ``max_depth`` that is not enough.
    """
    teams = org.where("is_team").select(compact("name").alias("key"), F.col("node_id").alias("team_id"), "name")
    named = first_per_key(teams.where("key <> ''"), ["key"], ["team_id"])
    o = settle(org.select("node_id", "parent_id", "is_team"))
    parents = o.select(F.col("node_id").alias("parent_id"))
    roots = o.join(parents, "parent_id", "left_anti")
    frontier = settle(roots.select("node_id", F.when(F.col("is_team"), F.col("node_id")).alias("team_id"), "is_team"))
    found = [frontier]
    bound = max_depth or o.count() + 1
    for _ in range(bound):
        down = o.join(frontier.select(F.col("node_id").alias("parent_id"), F.col("team_id").alias("__above")), "parent_id")
        frontier = settle(down.select("node_id", F.when(F.col("is_team"), F.col("node_id")).otherwise(F.col("__above")).alias("team_id"), "is_team"))
        if frontier.isEmpty():
            break
        found.append(frontier)
    else:
        raise RuntimeError(f"the organisation goes deeper than {bound} levels or holds a loop")
    if not o.join(union_all(found).select("node_id"), "node_id", "left_anti").isEmpty():
        raise RuntimeError("the organisation holds a loop that no root leads to")
    members = union_all(found).where("NOT is_team AND team_id IS NOT NULL").select("team_id", F.col("node_id").alias("member_id")).distinct()
    return named, members


def _either_way(keys: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs (key_id, name_id) of texts where one contains the other; inputs (key_id, key), (name_id, name)."""
    k, n = keys.where("key <> ''"), names.where("name <> ''")
    inside = contained_in(k.select(F.col("key_id").alias("text_id"), F.col("key").alias("text")), n.select("name_id", F.col("name").alias("keyword")))
    around = contained_in(n.select(F.col("name_id").alias("text_id"), F.col("name").alias("text")), k.select(F.col("key_id").alias("name_id"), F.col("key").alias("keyword")))
    return inside.select(F.col("text_id").alias("key_id"), "name_id").union(around.select(F.col("name_id").alias("key_id"), F.col("text_id").alias("name_id"))).distinct()


def match_roles(roles: DataFrame, users: DataFrame, agents_only: bool = False) -> DataFrame:
    """Best user of each role key: agents before others, equal before contained, then list order.

    ``roles`` is (role_id, name), ``users`` is (id, pos, username, role, alias, is_agent).
    """
    keys = roles.select("role_id", compact("name").alias("key")).where("key <> ''")
    distinct = keys.select(F.col("key").alias("key_id"), "key").distinct()
    who = F.struct(F.when(F.col("is_agent"), 0).otherwise(1).alias("pool"), "pos", "id")
    pool = users.where("is_agent") if agents_only else users
    # Of the users of one name only the first can be the best, so each name is compared once.
    names = union_all([pool.select(who.alias("who"), compact(f).alias("name")) for f in NAME_FIELDS]).where("name <> ''")
    names = names.groupBy("name").agg(F.min("who").alias("who"))
    exact = distinct.join(names, F.col("key") == F.col("name")).select("key_id", "who", F.lit(0).alias("kind"))
    near = _either_way(distinct, names.select(F.col("name").alias("name_id"), "name")).withColumnRenamed("name_id", "name").join(names, "name").select("key_id", "who", F.lit(1).alias("kind"))
    hits = exact.unionByName(near)
    best = hits.groupBy("key_id").agg(F.min(F.struct(F.col("who.pool").alias("pool"), "kind", F.col("who.pos").alias("pos"), F.col("who.id").alias("id"))).alias("b"))
    return keys.join(best, keys.key == best.key_id).select("role_id", F.col("b.id").alias("user_id"), (F.col("b.pool") == 0).alias("is_agent"), (F.col("b.kind") == 0).alias("exact"))


def team_candidates(roles: DataFrame, teams: DataFrame, limit: int | None = None) -> DataFrame:
    """The teams (the first ``limit`` if given) of each role whose name contains the role's or is contained in it."""
    keys = roles.select(F.col("role_id").alias("key_id"), compact("name").alias("key"))
    pairs = _either_way(keys, teams.select(F.col("team_id").alias("name_id"), F.col("key").alias("name")))
    return top_per_key(pairs.select(F.col("key_id").alias("role_id"), F.col("name_id").alias("team_id")), ["role_id"], ["team_id"], limit, "rank")


#: Keys of one end that meet its agents in one part.
KEYS_PER_PART = 200


def agent_candidates(roles: DataFrame, agents: DataFrame, limit: int | None = None, fallback: int = 20) -> DataFrame:
    """The agents (the best ``limit`` if given) of each role by score: 1.0 equal, 0.8 contained either way, 0.5 when the
    first or last three characters of the role occur; roles without any get the first ``fallback`` agents."""
    keys = roles.select("role_id", compact("name").alias("key")).where("key <> ''")
    distinct = keys.select(F.col("key").alias("key_id"), "key").distinct()
    who = F.struct("pos", "id")
    names = union_all([agents.select(who.alias("who"), compact(f).alias("name")) for f in PROFILE_FIELDS if f in agents.columns]).where("name <> ''").distinct()
    # Names that many agents share are compared once; the agents come in when the names' scores stand.
    texts = names.select("name").distinct()
    exact = distinct.join(texts, F.col("key") == F.col("name")).select("key_id", "name", F.lit(1.0).alias("score"))
    near = _either_way(distinct, texts.select(F.col("name").alias("name_id"), "name")).select("key_id", F.col("name_id").alias("name"), F.lit(0.8).alias("score"))
    ends = distinct.where(F.length("key") >= 3).select("key_id", F.explode(F.array_distinct(F.array(F.substring("key", 1, 3), F.right("key", F.lit(3))))).alias("keyword"))
    by_name = exact.unionByName(near).groupBy("key_id", "name").agg(F.max("score").alias("score")).join(names, "name").select("key_id", "who", "score")
    # Very many keys and agents share three characters: agents are found for each such end, and keys come last.
    held = contained_in(texts.select(F.col("name").alias("text_id"), F.col("name").alias("text")), ends.select(F.col("keyword").alias("name_id"), "keyword").distinct(), shortest=3)
    held = held.select(F.col("text_id").alias("name"), F.col("keyword").alias("k")).join(names, "name").select(F.col("who").alias("skill_id"), "k").distinct()
    part = paired_by_name(ends.select(F.col("key_id").alias("agent_id"), F.col("keyword").alias("k")), held, KEYS_PER_PART)
    part = part.select(F.col("agent_id").alias("key_id"), F.col("skill_id").alias("who"), F.lit(0.5).alias("score"))
    # Dealt by key once, for the scores, the ranks and the roles.
    scored = by_name.unionByName(part).repartition("key_id").groupBy("key_id", "who").agg(F.max("score").alias("score"))
    top = top_per_key(scored, ["key_id"], [F.desc("score"), "who"], limit, "rank").select("key_id", F.col("who.id").alias("agent_id"), "score", "rank")
    # The fallback list is a fixed, small number of agents.
    first = agents.orderBy("pos", "id").limit(fallback).select(F.col("id").alias("agent_id"), "pos").withColumn("__one", F.lit(1))
    hit = by_name.select("key_id").unionByName(ends.join(held.select(F.col("k").alias("keyword")).distinct(), "keyword", "left_semi").select("key_id"))
    bare = distinct.select("key_id").join(hit, "key_id", "left_anti").withColumn("__one", F.lit(1))
    listed = bare.join(F.broadcast(first), "__one").select("key_id", "agent_id", F.lit(0.0).alias("score"), "pos")
    listed = top_per_key(listed, ["key_id"], ["pos", "agent_id"], fallback, "rank").select("key_id", "agent_id", "score", "rank")
    with_roles = lambda found: found.join(keys.hint("merge"), F.col("key") == F.col("key_id")).select("role_id", "agent_id", "score", "rank")
    return with_roles(top).unionByName(with_roles(listed))


def shortened(agents: DataFrame) -> DataFrame:
    """Agent profiles with long texts cut, as they are handed to a planner."""
    cut = lambda c, n: F.when(F.length(strip(or_blank(c))) > n, F.concat(F.substring(strip(c), 1, n), F.lit("…"))).otherwise(strip(or_blank(c)))
    out = agents
    for c, n in (("description", 220), ("goal", 180), ("persona", 220)):
        if c in agents.columns:
            out = out.withColumn(c, cut(c, n))
    return out


def assignment_hints(roles: DataFrame, users: DataFrame, teams: DataFrame) -> DataFrame:
    """Role to user, else to the team of the same name, else open: (role_id, kind, target_id, is_agent)."""
    picked = match_roles(roles, users).select("role_id", F.col("user_id").alias("__u"), "is_agent")
    team = roles.select("role_id", compact("name").alias("key")).join(teams.select("key", F.col("team_id").alias("__t")), "key").select("role_id", "__t")
    j = roles.select("role_id").join(picked, "role_id", "left").join(team, "role_id", "left")
    kind = F.when(F.col("__u").isNotNull(), "user").when(F.col("__t").isNotNull(), "team").otherwise("open")
    return j.select("role_id", kind.alias("kind"), F.coalesce("__u", "__t").alias("target_id"), F.coalesce("is_agent", F.lit(False)).alias("is_agent"))


def activity_agents(tasks: DataFrame, hints: DataFrame) -> DataFrame:
    """Activities with the agent their role resolves to: (task_id, role_id, agent_id)."""
    agent = hints.where("kind = 'user' AND is_agent").select("role_id", F.col("target_id").alias("agent_id"))
    return tasks.select("task_id", "role_id").join(agent, "role_id", "left")


def pick_agents(activities: DataFrame, users: DataFrame, allow_human: bool = True) -> DataFrame:
    """Agent of each activity: a valid assignment stays, else the match of its role unless a person is
    needed, else the first agent whose name occurs in the activity's text or holds it.

    ``activities`` is (activity_id, name, role, instruction, description, agent).
    """
    text = F.concat_ws(" ", or_blank("name"), or_blank("instruction"), or_blank("description"))
    a = activities.withColumn("__human", human_required("name", "instruction", "description")).withColumn("__key", compact(text))
    agents = users.where("is_agent")
    kept = a.join(agents.select(F.col("id").alias("agent")), "agent", "left_semi").select("activity_id", F.col("agent").alias("agent_id"), F.lit(0).alias("rank"))
    by_role = match_roles(a.where("NOT __human").select(F.col("activity_id").alias("role_id"), F.col("role").alias("name")), users).where("is_agent")
    by_role = by_role.select(F.col("role_id").alias("activity_id"), F.col("user_id").alias("agent_id"), F.lit(1).alias("rank"))
    open_text = a if allow_human else a.where("NOT __human")
    # Equal texts and equal names are compared once; the first agent of a name stands for all.
    names = union_all([agents.select(F.struct("pos", "id").alias("who"), compact(f).alias("name")) for f in NAME_FIELDS]).where("name <> ''")
    names = names.groupBy("name").agg(F.min("who").alias("who"))
    told = open_text.select("activity_id", "__key").where("__key <> ''")
    near = _either_way(told.select(F.col("__key").alias("key_id"), F.col("__key").alias("key")).distinct(), names.select(F.col("name").alias("name_id"), "name"))
    of_text = near.withColumnRenamed("name_id", "name").join(names, "name").groupBy(F.col("key_id").alias("__key")).agg(F.min("who").alias("n"))
    by_text = told.join(of_text, "__key").groupBy("activity_id").agg(F.min("n").alias("n")).select("activity_id", F.col("n.id").alias("agent_id"), F.lit(2).alias("rank"))
    best = first_per_key(union_all([kept, by_role, by_text]), ["activity_id"], ["rank", "agent_id"])
    return activities.select("activity_id").join(best, "activity_id", "left")


def apply_plan(activities: DataFrame, decisions: DataFrame, agents: DataFrame) -> DataFrame:
    """Supplied decisions (proc_id, activity_id, activity_name, agent_id) by id, else by name; targets
    that are no agent become none. ``unresolved`` marks activities for ``pick_agents``."""
    known = decisions.join(agents.select(F.col("id").alias("agent_id")).withColumn("__ok", F.lit(True)), "agent_id", "left")
    known = known.withColumn("agent_id", F.when(F.col("__ok"), F.col("agent_id")))
    one = lambda rows, key: rows.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).groupBy("proc_id", key).agg(F.max("agent_id").alias(f"__{key}"), F.lit(True).alias(f"__has_{key}"))
    by_id = one(known, "activity_id")
    by_name = one(known.where(blank("activity_id")).withColumn("__name", compact("activity_name")), "__name")
    j = activities.withColumn("__name", compact("name")).join(by_id, ["proc_id", "activity_id"], "left").join(by_name, ["proc_id", "__name"], "left")
    chosen = F.coalesce("__activity_id", "____name")
    return j.select("proc_id", "activity_id", chosen.alias("agent_id"), chosen.isNull().alias("unresolved"))


# Skills ---------------------------------------------------------------------------------------------


#: Characters of left texts that a cell holds, and of skills that it reads; rows that it gives at once.
HELD_CHARS, READ_CHARS, CELL_ROWS = 4_000_000, 32_000_000, 100_000


def _words(text: str) -> set[str]:
    return {t for t in text.split(" ") if len(t) >= 2}


def _cells(batches):
    """Pairs of the cells' left texts and skills; see ``_met``."""
    cell, left, post = None, None, {}
    for batch in batches:
        kinds = [batch.schema.field(c).type for c in ("left_id", "skill")]
        out, count = [], 0
        for r in batch.to_pylist():
            if r["cell"] != cell:
                if out:
                    yield _pairs(out, left, kinds)
                    out, count = [], 0
                cell, left, post = r["cell"], {"id": [], "text": [], "unit": [], "n": []}, {}
            if r["side"] == 0:
                unit = left["unit"][-1] + 1 if left["unit"] else 0
                for text in r["texts"]:
                    words = _words(text)
                    for w in words if r["left_id"] is not None else ():
                        post.setdefault(w, []).append(unit)
                    for c, v in (("id", r["left_id"]), ("text", text), ("unit", unit), ("n", len(words))):
                        left[c].append(v)
                continue
            if not left["id"]:
                continue
            if isinstance(left["n"], list):
                left["unit"], left["n"] = np.array(left["unit"]), np.array(left["n"])
                post = {w: np.array(u) for w, u in post.items()}
            skill, at, size = r["skill"], left["unit"], left["n"]
            words = [_words(t) for t in r["texts"]]
            met = [post[w] for ws in words for w in ws if w in post]
            common = np.bincount(np.concatenate(met), minlength=at[-1] + 1) if met else np.zeros(at[-1] + 1, np.int64)
            # A text within another shares all words with it but the first and the last, which may be parts of words.
            near, held = common[at], np.zeros(len(common), bool)
            for i in np.flatnonzero((near >= size - 2) | (near >= min(map(len, words)) - 2)):
                text = left["text"][i]
                held[at[i]] |= any((skill is not None and text in t) or (left["id"][i] is not None and t in text) for t in r["texts"])
            # Containment decides alone, whatever the words give.
            strong = np.searchsorted(at, np.flatnonzero(held))
            rows = np.flatnonzero((near > 0) & ~held[at]) if skill is not None else strong[:0]
            out.append((strong, np.zeros_like(strong), skill, 0, True))
            out += [(rows, near[rows], skill, len(ws), False) for ws in words]
            count += len(strong) + len(rows) * len(words)
            if count >= CELL_ROWS:
                yield _pairs(out, left, kinds)
                out, count = [], 0
        if out:
            yield _pairs(out, left, kinds)


def _pairs(out: list[tuple], left: dict, kinds: list[pa.DataType]) -> pa.RecordBatch:
    """Rows of the left texts at the given places, each list of them met by one skill."""
    at, sizes = np.concatenate([o[0] for o in out]), [len(o[0]) for o in out]
    each = lambda values: np.repeat(values, sizes)
    columns = [
        pa.array(left["id"], kinds[0]).take(pa.array(at)), pa.array([o[2] for o in out], kinds[1]).take(pa.array(each(np.arange(len(out))))),
        pa.array(np.concatenate([o[1] for o in out])), pa.array(left["n"][at]), pa.array(each([o[3] for o in out])), pa.array(each([o[4] for o in out])),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["left_id", "skill", "common", "nl", "ns", "held"])


def _met(left: DataFrame, skills: DataFrame) -> DataFrame:
    """Pairs (left_id, skill, common, nl, ns, held) that share a word or contain one another.

    Both sides are dealt into a grid of cells. A cell holds its left texts under their words and reads its skills one by one, so neither
    words nor windows of texts are rows. Texts of one id are one unit that shares the words of all.
    """
    # A one-element explode keeps the text from being worked out anew wherever it is used.
    text = F.explode(F.array(normalize("text")))
    l, s = (settle(t.select(c, text.alias("t")).where("t <> ''").groupBy(c).agg(F.collect_list("t").alias("texts"))) for t, c in ((left, "left_id"), (skills, "skill")))
    chars = lambda d: d.agg(F.sum(F.aggregate("texts", F.lit(0).cast("long"), lambda n, t: n + F.length(t)))).first()[0] or 0
    rows, columns = math.ceil(chars(l) / HELD_CHARS) or 1, max(3 * left.sparkSession.sparkContext.defaultParallelism, math.ceil(chars(s) / READ_CHARS))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    none = lambda d, c: F.lit(None).cast(d.schema[c].dataType).alias(c)
    a = l.withColumn("x", deal("left_id", rows)).withColumn("y", all_of(columns)).select((F.col("x") * columns + F.col("y")).alias("cell"), F.lit(0).alias("side"), "left_id", none(s, "skill"), "texts")
    b = s.withColumn("y", deal("skill", columns)).withColumn("x", all_of(rows)).select((F.col("x") * columns + F.col("y")).alias("cell"), F.lit(1).alias("side"), none(l, "left_id"), "skill", "texts")
    dealt = a.unionByName(b).repartition("cell").sortWithinPartitions("cell", "side")
    kinds = [(c, d.schema[c].dataType) for d, c in ((l, "left_id"), (s, "skill"))] + [("common", T.LongType()), ("nl", T.LongType()), ("ns", T.LongType()), ("held", T.BooleanType())]
    return dealt.mapInArrow(_cells, T.StructType([T.StructField(c, k) for c, k in kinds]))


def _scored(left: DataFrame, skills: DataFrame, score) -> DataFrame:
    """Pairs that share a word or contain one another, with ``score`` over sizes; others score 0."""
    by_words = score(F.col("common"), F.col("nl"), F.col("ns"))
    return _met(left, skills).select("left_id", "skill", F.when(F.col("held"), F.lit(0.95)).otherwise(by_words).alias("score"))


def skill_scores_for_activities(activities: DataFrame, skills: DataFrame) -> DataFrame:
    """(left_id, skill, score): 0.95 on containment, else shared words over the activity's, at most 0.9."""
    return _scored(activities, skills, lambda c, nl, ns: F.least(F.lit(0.9), c / nl))


def skill_scores_for_agents(profiles: DataFrame, skills: DataFrame) -> DataFrame:
    """(left_id, skill, score): 0.95 on containment, else 0.55 of the Jaccard and 0.45 of the share of
    the skill's words, at most 0.98."""
    return _scored(profiles, skills, lambda c, nl, ns: F.least(F.lit(0.98), c / (nl + ns - c) * 0.55 + c / ns * 0.45))


def assign_skills(activity_scores: DataFrame, activity_agent: DataFrame, agent_scores: DataFrame) -> DataFrame:
    """(agent_id, skill): the best five per activity from 0.35 on and per agent from 0.22 on."""
    top = lambda d, at: top_per_key(d.where(F.col("score") >= at), ["left_id"], [F.desc("score"), "skill"], fixed.SKILLS_PER_MATCH)
    of_activity = top(activity_scores, fixed.ACTIVITY_SKILL_AT).join(activity_agent.select(F.col("activity_id").alias("left_id"), "agent_id"), "left_id").select("agent_id", "skill")
    of_agent = top(agent_scores, fixed.AGENT_SKILL_AT).select(F.col("left_id").alias("agent_id"), "skill")
    return of_activity.unionByName(of_agent).distinct()


def agent_profiles(agents: DataFrame, roles: DataFrame, activities: DataFrame, max_texts: int | None = None) -> DataFrame:
    """(left_id, text) of agents: own fields, the distinct roles they fill and the texts of their activities (the first ``max_texts`` if given)."""
    told = top_per_key(activities.select("agent_id", "activity_id", "text"), ["agent_id"], ["activity_id"], max_texts, "n")
    told = told.groupBy("agent_id").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("t")).select("agent_id", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("__told"))
    hints = roles.select("agent_id", "role").distinct().groupBy("agent_id").agg(F.array_join(F.array_sort(F.collect_list("role")), " ").alias("__roles"))
    j = agents.join(hints, "agent_id", "left").join(told, "agent_id", "left")
    fields = [c for c in ("username", "role", "goal", "persona", "tools") if c in agents.columns]
    return j.select(F.col("agent_id").alias("left_id"), F.concat_ws(" ", *[or_blank(c) for c in fields], or_blank("__roles"), or_blank("__told")).alias("text"))


def merge_skill_lists(current: Column | str, new: Column | str) -> Column:
    """Ordered distinct union of a comma-separated list and an array of new names."""
    have = F.filter(F.transform(F.split(or_blank(current), ","), strip), lambda s: s != "")
    fresh = F.filter(F.transform(new if isinstance(new, Column) else F.col(new), skill_key), lambda s: s != "")
    return F.array_join(F.array_distinct(F.concat(have, fresh)), ",")


# Forms and inputs -----------------------------------------------------------------------------------


def extract_fields(html_rows: DataFrame, key: str, html: str = "html", tags: Sequence[str] = tuple(fixed.FORM_TAGS)) -> DataFrame:
    """Fields of the given tags in order: text, key (bracketed binding, else name), type, disabled, readonly."""
    names = "|".join(tags)
    starts = F.regexp_extract_all(or_blank(html), F.lit(rf"(?is)<((?:{names})(?:\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*)?)/?>"), F.lit(1))
    rows = html_rows.select(key, F.posexplode(starts).alias("pos", "tag"))

    def attr(name: str) -> Column:
        double = F.regexp_extract("tag", rf"(?is)\s{name}\s*=\s*\"([^\"]*)\"", 1)
        single = F.regexp_extract("tag", rf"(?is)\s{name}\s*=\s*'([^']*)'", 1)
        return F.when(double != "", double).otherwise(single)

    tag = F.lower(F.regexp_extract("tag", r"^([^\s/>]+)", 1))
    bound = F.regexp_extract(attr("v-model"), r"\[['\"](.+?)['\"]\]", 1)
    has = lambda name: F.col("tag").rlike(rf"(?is)\s{name}(\s|=|/|$)")
    return rows.select(
        key, "pos", tag.alias("tag_name"), attr("alias").alias("text"), F.when(bound != "", bound).otherwise(attr("name")).alias("key"),
        F.coalesce(F.nullif(attr("type"), F.lit("")), F.replace(tag, F.lit("-field"), F.lit(""))).alias("type"),
        has("disabled").alias("disabled"), has("readonly").alias("readonly"),
    )


def field_refs(fields: DataFrame, form: str = "form_id") -> DataFrame:
    """First ``form.key`` reference per form and key."""
    named = fields.where(~blank(form) & ~blank("key")).withColumn("ref", F.concat_ws(".", F.col(form), strip("key")))
    return first_per_key(named, [form, "ref"], ["pos"]).select(form, "ref", F.col("text").alias("label"), "type", "pos")


def input_candidates(pairs: DataFrame, forms: DataFrame, refs: DataFrame) -> DataFrame:
    """References of the forms of an activity's predecessors: (proc_id, id, ref), first occurrence.

    ``pairs`` is (proc_id, id, predecessor), ``forms`` is (proc_id, id, form_id, at).
    """
    f = forms.select("proc_id", F.col("id").alias("predecessor"), "form_id", "at")
    rows = pairs.join(f, ["proc_id", "predecessor"]).join(refs.select("form_id", "ref", "pos"), "form_id")
    return rows.groupBy("proc_id", "id", "ref").agg(F.min(F.struct("at", "pos")).alias("seen"))


def restrict_inputs(candidates: DataFrame, given: DataFrame, limit: int | None = None) -> DataFrame:
    """Inputs of each activity: the given ones that are allowed, or all candidates when none is; the
    first ``limit`` of them if given."""
    allowed = candidates.join(given.select("proc_id", "id", "ref"), ["proc_id", "id", "ref"], "left_semi")
    rest = candidates.join(allowed.select("proc_id", "id"), ["proc_id", "id"], "left_anti")
    return top_per_key(allowed.unionByName(rest), ["proc_id", "id"], ["seen", "ref"], limit, "rank").drop("seen")


def with_form_ids(activities: DataFrame) -> DataFrame:
    return activities.withColumn("form_id", form_id(F.col("proc_id").cast("string"), "id", "tool"))
