"""Graph store operations and edge construction.

Node tables are typed DataFrames keyed as in ``schemas.KEYS``; edges are one table
(src_type, src_id, rel, dst_type, dst_id, condition).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procweave import schemas
from procweave.functions.text import normalize, null_if_blank, or_blank
from procweave.operators.contain import contained_in
from procweave.operators.ordered import first_per_key, scan

EDGE_KEY = ["src_type", "src_id", "rel", "dst_type", "dst_id"]


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


# Nodes -----------------------------------------------------------------------------------------


def upsert_nodes(store: DataFrame, incoming: DataFrame, key: str | Sequence[str], order: str | None = None) -> DataFrame:
    """Store with incoming rows inserted or overwritten by key; the last incoming row wins."""
    keys = [key] if isinstance(key, str) else list(key)
    if order:
        incoming = first_per_key(incoming, keys, [F.desc(order)]).drop(order)
    kept = store.join(incoming.select(*keys), keys, "left_anti")
    return kept.unionByName(incoming.select(*store.columns))


def upsert_by_composite_key(store: DataFrame, incoming: DataFrame, keys: Sequence[str], surrogate: str) -> DataFrame:
    """Upsert where a stored row keeps its surrogate id; new rows bring their own."""
    known = store.select(*keys, F.col(surrogate).alias("__known"))
    settled = incoming.join(known, list(keys), "left").withColumn(surrogate, F.coalesce("__known", surrogate)).drop("__known")
    return upsert_nodes(store, settled.select(*store.columns), keys)


def merge_by_id(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Append rows whose id is unseen; rows without an id always append."""
    with_id = new.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    without = new.where(F.col(key).isNull() | (F.col(key).cast("string") == ""))
    return existing.unionByName(with_id.join(existing.select(key), key, "left_anti")).unionByName(without)


def delete_by_label(nodes: DataFrame, edges: DataFrame, labels: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remaining nodes, remaining edges and a (label, deleted) report."""
    doomed = F.col("type").isin(list(labels))
    report = nodes.where(doomed).groupBy("type").agg(F.count(F.lit(1)).alias("deleted"))
    gone = nodes.where(doomed).select("type", "id")
    left = edges.join(gone.select(F.col("type").alias("src_type"), F.col("id").alias("src_id")), ["src_type", "src_id"], "left_anti")
    left = left.join(gone.select(F.col("type").alias("dst_type"), F.col("id").alias("dst_id")), ["dst_type", "dst_id"], "left_anti")
    return nodes.where(~doomed), left.select(*edges.columns), report


def clear_all(spark) -> dict[str, DataFrame]:
    return {name: schemas.empty(spark, name) for name in [*schemas.TABLES, "edges"]}


def check_unique(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Key values that occur more than once, over all tables in one job."""
    counted = union_all([df.select(F.lit(name).alias("label"), F.col(key).cast("string").alias("key_value")) for name, (df, key) in tables.items()])
    return counted.groupBy("label", "key_value").agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def node_rows(tables: Mapping[str, DataFrame], extra: Sequence[str] = ()) -> DataFrame:
    """Typed tables as (type, id, name, ...) rows."""
    rows = []
    for name, df in tables.items():
        label = F.col("name") if "name" in df.columns else F.lit(None)
        more = [(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in extra]
        rows.append(df.select(F.lit(name).alias("type"), F.col(schemas.KEYS[name]).cast("string").alias("id"), label.cast("string").alias("name"), *more))
    return union_all(rows)


# Edges -----------------------------------------------------------------------------------------


def upsert_edges(store: DataFrame, incoming: DataFrame, nodes: DataFrame, seq: str | None = None) -> DataFrame:
    """Each edge once, only between existing nodes; the last condition wins.

    Repeats are folded before the end-node joins, so a pair linked very often costs one row there.
    """
    latest = F.max_by("condition", seq) if seq else F.max("condition")
    folded = incoming.groupBy(*EDGE_KEY).agg(latest.alias("condition"))
    src = nodes.select(F.col("type").alias("src_type"), F.col("id").alias("src_id"))
    dst = nodes.select(F.col("type").alias("dst_type"), F.col("id").alias("dst_id"))
    valid = folded.join(src, ["src_type", "src_id"], "left_semi").join(dst, ["dst_type", "dst_id"], "left_semi")
    kept = store.join(valid.select(*EDGE_KEY), EDGE_KEY, "left_anti")
    return kept.select(*EDGE_KEY, "condition").unionByName(valid.select(*EDGE_KEY, "condition"))


def explicit_flow_edges(flows: DataFrame, order: str = "pos") -> DataFrame:
    """NEXT edges of extracted flows in either field format; the first per pair counts."""
    have = lambda *names: F.coalesce(*[null_if_blank(n) for n in names if n in flows.columns])
    typed = lambda n: F.coalesce(null_if_blank(n), F.lit("task")) if n in flows.columns else F.lit("task")
    unified = flows.select(
        typed("from_type").alias("src_type"),
        have("from_id", "from_task_id").alias("src_id"),
        F.lit("NEXT").alias("rel"),
        typed("to_type").alias("dst_type"),
        have("to_id", "to_task_id").alias("dst_id"),
        or_blank("condition").alias("condition"),
        F.col(order).alias("__order"),
    ).where(F.col("src_id").isNotNull() & F.col("dst_id").isNotNull())
    return first_per_key(unified, ["src_id", "dst_id"], ["__order"]).drop("__order")


def order_chain_edges(tasks: DataFrame, existing: DataFrame, order: Sequence[str] = ("order", "task_id"), mode: str = "always") -> DataFrame:
    """NEXT between consecutive tasks of a process where that pair has no edge.

    ``mode='gaps'`` adds a link only where the first task leads nowhere yet.
    """
    chained = scan(tasks, ["process_id"], list(order), lead={"next_id": "task_id"}).where("next_id IS NOT NULL")
    edges = chained.select(*schemas.edge("NEXT", "task", "task_id", "task", "next_id", F.lit("")))
    fresh = edges.join(existing.where("rel = 'NEXT'").select("src_id", "dst_id"), ["src_id", "dst_id"], "left_anti")
    if mode == "gaps":
        fresh = fresh.join(existing.where("rel = 'NEXT'").select("src_id"), "src_id", "left_anti")
    return fresh.select(*EDGE_KEY, "condition")


def event_edges(links: DataFrame) -> DataFrame:
    """Start events lead to their task, other events follow it; input (event_id, task_id, is_start)."""
    start = F.col("is_start")
    return links.select(
        F.when(start, "event").otherwise("task").alias("src_type"),
        F.when(start, F.col("event_id")).otherwise(F.col("task_id")).cast("string").alias("src_id"),
        F.lit("NEXT").alias("rel"),
        F.when(start, "task").otherwise("event").alias("dst_type"),
        F.when(start, F.col("task_id")).otherwise(F.col("event_id")).cast("string").alias("dst_id"),
        F.lit(None).cast("string").alias("condition"),
    )


def evidence_edges(links: DataFrame, nodes: DataFrame, mode: str = "full") -> DataFrame | None:
    """SUPPORTED_BY for ids of unknown type: the type is looked up; ``mode='off'`` plans nothing."""
    if mode == "off":
        return None
    known = nodes.where(F.col("type").isin(schemas.EVIDENCE_LABELS)).select(F.col("type").alias("src_type"), F.col("id").alias("entity_id"))
    return links.join(known, "entity_id").select(
        "src_type", F.col("entity_id").alias("src_id"), F.lit("SUPPORTED_BY").alias("rel"),
        F.lit("chunk").alias("dst_type"), F.col("chunk_id").cast("string").alias("dst_id"), F.lit(None).cast("string").alias("condition"),
    )


def materialize_relations(
    task_role: DataFrame, task_process: DataFrame, role_decision: DataFrame, evidence: DataFrame, nodes: DataFrame, mode: str = "full"
) -> DataFrame:
    """Edge rows of the relation tables: performer, membership, decision maker and evidence."""
    parts = [
        task_role.select(*schemas.edge("PERFORMED_BY", "task", "task_id", "role", "role_id")),
        task_process.select(*schemas.edge("HAS_TASK", "process", "process_id", "task", "task_id")),
        role_decision.select(*schemas.edge("MAKES_DECISION", "role", "role_id", "decision", "decision_id")),
    ]
    supported = evidence_edges(evidence, nodes, mode)
    return union_all(parts + ([supported] if supported is not None else []))


def process_skill_edges(edges: DataFrame) -> DataFrame:
    """Skills of the roles that perform a process's tasks."""
    of = lambda rel, src, a, b: edges.where((F.col("rel") == rel) & (F.col("src_type") == src)).select(F.col("src_id").alias(a), F.col("dst_id").alias(b))
    # Process and role are reduced to distinct pairs before skills fan them out.
    pairs = of("HAS_TASK", "process", "proc_id", "task_id").join(of("PERFORMED_BY", "task", "task_id", "role_id"), "task_id").select("proc_id", "role_id").distinct()
    skills = of("HAS_SKILL", "role", "role_id", "skill_id").distinct()
    pairs = pairs.join(skills.select("role_id").hint("merge"), "role_id", "left_semi")
    # The skills of a process's only role are distinct as they are; those of several roles are made so.
    per = pairs.groupBy("proc_id").agg(F.count(F.lit(1)).alias("n"), F.min("role_id").alias("role_id"))
    several = per.where("n > 1").select(F.col("proc_id").alias("__id"))
    mixed = pairs.join(several.hint("merge"), F.col("proc_id").eqNullSafe(F.col("__id")), "left_semi")
    fan = lambda rows: rows.join(skills.hint("merge"), "role_id").select("proc_id", "skill_id")
    linked = fan(per.where("n = 1").select("proc_id", "role_id")).unionByName(fan(mixed).distinct())
    return linked.select(*schemas.edge("HAS_SKILL", "process", "proc_id", "skill", "skill_id"))


def infer_task_roles(tasks: DataFrame, task_role: DataFrame, roles: DataFrame, order: str) -> DataFrame:
    """Role of each unassigned task: the first whose name or unit, longer than two characters, occurs
    in the task's text. Returns (task_id, role_id)."""
    open_tasks = tasks.join(task_role.select("task_id"), "task_id", "left_anti")
    text = F.lower(F.concat_ws(" ", or_blank("name"), or_blank("description"), or_blank("instruction")))
    texts = open_tasks.select(F.col("task_id").alias("text_id"), text.alias("text"))
    names = roles.select(
        F.struct(F.col(order).alias("at"), "role_id").alias("name_id"),
        F.explode(F.array(F.lower(or_blank("name")), F.lower(or_blank("org_unit")))).alias("keyword"),
    )
    hits = contained_in(texts, names, shortest=3)
    return hits.groupBy("text_id").agg(F.min("name_id").alias("r")).select(F.col("text_id").alias("task_id"), F.col("r.role_id").alias("role_id"))


def default_process(tasks: DataFrame, processes: DataFrame, order: str = "proc_id") -> DataFrame:
    """Tasks without a process join the first process."""
    first = processes.agg(F.min_by("proc_id", order).alias("__first")).withColumn("__one", F.lit(1))
    # A global aggregate is one row, so it can always be broadcast.
    joined = tasks.withColumn("__one", F.lit(1)).join(F.broadcast(first), "__one", "left")
    return joined.withColumn("process_id", F.coalesce(null_if_blank("process_id"), "__first")).drop("__one", "__first")


def role_agent_edges(edges: DataFrame, roles: DataFrame, agents: DataFrame) -> DataFrame:
    """Roles that perform a process's tasks, to agents of the same trimmed lower-case name."""
    in_use = edges.where("rel = 'PERFORMED_BY'").select(F.col("src_id").alias("task_id"), F.col("dst_id").alias("role_id"))
    owned = edges.where("rel = 'HAS_TASK'").select(F.col("dst_id").alias("task_id"))
    used = in_use.join(owned, "task_id", "left_semi").select("role_id").distinct()
    named = roles.join(used, "role_id", "left_semi").select("role_id", normalize("name").alias("k")).where("k <> ''")
    return named.join(agents.select("agent_id", normalize("name").alias("k")), "k").select(*schemas.edge("ASSIGNED_AGENT", "role", "role_id", "agent", "agent_id")).distinct()


#: Agents of one name that meet its skills in one part, and skills of a list.
AGENTS_PER_PART, LIST_ROWS = 2_000, 1_000


def agent_skill_edges(agents: DataFrame, skills: DataFrame, assigned: DataFrame | None = None, part_rows: int = AGENTS_PER_PART) -> DataFrame:
    """USES_SKILL by name: ``assigned`` (agent_id, skill_name) rows, or agents named like the skill."""
    asked = assigned if assigned is not None else agents.select("agent_id", F.col("name").alias("skill_name"))
    left = asked.select("agent_id", normalize("skill_name").alias("k")).where("k <> ''").distinct()
    named = skills.select("skill_id", normalize("name").alias("k")).where("k <> ''").distinct()
    # A skill of one name meets an agent once, so those pairs, which may be very many, need not be made distinct.
    per = named.groupBy("skill_id").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("k"))
    once = paired_by_name(left, per.where("n = 1").select("skill_id", "k"), part_rows)
    several = per.where("n > 1").select(F.col("skill_id").alias("__id"))
    again = paired_by_name(left, named.join(several.hint("merge"), F.col("skill_id").eqNullSafe(F.col("__id")), "left_semi"), part_rows).distinct()
    return once.unionByName(again).select(*schemas.edge("USES_SKILL", "agent", "agent_id", "skill", "skill_id"))


def paired_by_name(agents: DataFrame, skills: DataFrame, part_rows: int) -> DataFrame:
    """Pairs (agent_id, skill_id) of equal ``k``. A name's agents are dealt in parts of about ``part_rows`` and its skills go to each part,
    in lists of bounded length, so no task makes all pairs of a name."""
    parts = agents.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / F.lit(part_rows)).cast("int").alias("parts"))
    dealt = agents.join(parts.hint("merge"), "k").select("agent_id", "k", F.pmod(F.xxhash64("agent_id"), "parts").cast("int").alias("part"))
    sizes = skills.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / F.lit(LIST_ROWS)).cast("int").alias("lists"))
    listed = skills.join(sizes.hint("merge"), "k").groupBy("k", F.pmod(F.xxhash64("skill_id"), "lists").alias("list")).agg(F.collect_list(F.struct("skill_id")).alias("ids"))
    spread = listed.join(parts.hint("merge"), "k").select("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "ids")
    return dealt.join(spread.hint("merge"), ["k", "part"]).select("agent_id", F.explode("ids").alias("s")).select("agent_id", "s.skill_id")


def link_edges(links: DataFrame, rel: str, src_type: str, src: str, dst_type: str, dst: str) -> DataFrame:
    """Edges of one declared type from a table of id pairs; pairs with a null end are dropped."""
    if (src_type, dst_type) not in schemas.RELATIONS.get(rel, []):
        raise ValueError(f"{rel} does not join {src_type} and {dst_type}")
    whole = links.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    return whole.select(*schemas.edge(rel, src_type, src, dst_type, dst)).distinct()


# Small tables kept beside the graph --------------------------------------------------------------


def has_data(processes: DataFrame, tasks: DataFrame, roles: DataFrame) -> DataFrame:
    counted = union_all(
        [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("k"), "n") for k, df in (("p", processes), ("t", tasks), ("r", roles))]
    )
    of = lambda k: F.max(F.when(F.col("k") == k, F.col("n")))
    out = counted.agg(of("p").alias("n_process"), of("t").alias("n_task"), of("r").alias("n_role"))
    return out.withColumn("has_data", F.greatest("n_process", "n_task", "n_role") > 0)


def catalogue_append(catalogue: DataFrame, processes: DataFrame) -> DataFrame:
    """Add processes that the unclassified group does not hold yet; input (proc_id, name)."""
    from procweave.functions.fixed import UNCLASSIFIED

    held = catalogue.where((F.col("mega_id") == "unclassified") | (F.col("mega_name") == UNCLASSIFIED)).select("proc_id")
    fresh = processes.dropDuplicates(["proc_id"]).join(held, "proc_id", "left_anti").select(
        F.lit("unclassified").alias("mega_id"), F.lit(UNCLASSIFIED).alias("mega_name"),
        F.lit("unclassified_major").alias("major_id"), F.lit(UNCLASSIFIED).alias("major_name"),
        "proc_id", "name", F.col("proc_id").alias("path"), F.lit(True).alias("is_new"),
    )
    return catalogue.unionByName(fresh)


def org_add_member(org: DataFrame, members: DataFrame) -> DataFrame:
    """Add (parent_id, node_id, ...) rows under existing teams unless they are there already."""
    teams = org.where("is_team").select(F.col("node_id").alias("parent_id"))
    fresh = members.dropDuplicates(["parent_id", "node_id"]).join(teams, "parent_id", "left_semi").join(org.select("parent_id", "node_id"), ["parent_id", "node_id"], "left_anti")
    return org.unionByName(fresh.select(*org.columns))


def lineage_columns(definitions: DataFrame, run_id: Column, source_proc_id: Column, integrated_ref: Column, process_ref: Column) -> DataFrame:
    """Attach where a derived definition came from."""
    return definitions.withColumn(
        "lineage",
        F.struct(
            run_id.cast("string").alias("run_id"), source_proc_id.cast("string").alias("source_proc_id"),
            integrated_ref.cast("string").alias("integrated_snapshot"), process_ref.cast("string").alias("process_snapshot"),
        ),
    )
