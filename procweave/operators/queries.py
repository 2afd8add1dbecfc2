"""Graph queries: lists, details, element views, statistics, paths, closure and layers.

Neighbours are rows, not arrays: a node linked to a third of the graph stays a set of rows spread
over the cluster. Every list query works on all entities at once; pass a filtered table for one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procweave import schemas
from procweave.functions.text import blank, null_if_blank, or_blank, strip
from procweave.operators.graph import node_rows, union_all
from procweave.operators.ordered import first_per_key, scan, top_per_key
from procweave.session import settle

Graph = Mapping[str, DataFrame]


PAIR = ["rel", "src_type", "src_id", "dst_type", "dst_id"]


def store(g: Graph) -> dict[str, DataFrame]:
    """The graph with its edges as one stored table for readers of many edge types: a folder per type, and every pair of ends
    once, with its last condition (see ``upsert_edges``)."""
    once = g["edges"].groupBy(*PAIR).agg(F.max("condition").alias("condition"))
    edges = settle(once.select(*g["edges"].columns), "rel")
    return {**g, "edges": edges, "pairs": edges.select(*PAIR)}


def links(g: Graph, rel: str, src: str, dst: str, src_name: str, dst_name: str) -> DataFrame:
    """Id pairs of one edge type, each once."""
    e = g["pairs" if "pairs" in g else "edges"].where((F.col("rel") == rel) & (F.col("src_type") == src) & (F.col("dst_type") == dst))
    e = e.select(F.col("src_id").alias(src_name), F.col("dst_id").alias(dst_name))
    return e if "pairs" in g else e.distinct()


def performers(g: Graph) -> DataFrame:
    """(proc_id, task_id, role_id) of the roles that perform the tasks of each process."""
    tasks = links(g, "HAS_TASK", "process", "task", "proc_id", "task_id")
    return tasks.join(links(g, "PERFORMED_BY", "task", "role", "task_id", "role_id"), "task_id").select("proc_id", "task_id", "role_id")


def first_evidence(g: Graph, kind: str, key: str) -> DataFrame:
    """Page and opening 200 characters of the supporting chunk with the smallest id."""
    pairs = links(g, "SUPPORTED_BY", kind, "chunk", key, "chunk_id")
    chosen = pairs.groupBy(key).agg(F.min("chunk_id").alias("chunk_id"))
    text = g["chunk"].select("chunk_id", F.col("page").alias("evidence_page"), F.substring("text", 1, 200).alias("evidence_text"))
    return chosen.join(text, "chunk_id").select(key, "evidence_page", "evidence_text")


def _counts(pairs: DataFrame, key: str, name: str) -> DataFrame:
    # ``links`` gives distinct pairs, so a plain count is a distinct count.
    return pairs.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def list_processes(g: Graph) -> DataFrame:
    counts = _counts(links(g, "HAS_TASK", "process", "task", "proc_id", "task_id"), "proc_id", "n_tasks")
    have = [c for c in ("purpose", "description") if c in g["process"].columns]
    rows = g["process"].where(~blank("proc_id") & ~blank("name")).join(counts, "proc_id", "left")
    return rows.select(
        "proc_id", "name", *[or_blank(c).alias(c) for c in have], F.coalesce("n_tasks", F.lit(0)).alias("n_tasks")
    ).orderBy("name", "proc_id")


def _skills_of(g: Graph, agents: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct skills of each process with their names: its own and those of its agents (proc_id, id).

    Skills are named before agents fan them out. The skills of a process with one agent are distinct as they are, and its own ones are looked
    up among that agent's; only processes with several agents have their pairs made distinct.
    """
    uses = settle(links(g, "USES_SKILL", "agent", "skill", "agent_id", "id"))
    own = links(g, "HAS_SKILL", "process", "skill", "proc_id", "id")
    served = settle(agents.groupBy("proc_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("agent_id")))
    one, several = served.where("n = 1").select("proc_id", "agent_id"), served.where("n > 1").select("proc_id")
    of_one = one.join(uses.join(names, "id"), "agent_id").select("proc_id", "id", "name")
    # Own skills that no single agent brings.
    rest = own.join(several, "proc_id", "left_anti").join(one, "proc_id", "left").join(uses, ["agent_id", "id"], "left_anti").select("proc_id", "id")
    shared = agents.join(several, "proc_id", "left_semi").withColumnRenamed("id", "agent_id").join(uses, "agent_id").select("proc_id", "id")
    mixed = shared.unionByName(own.join(several, "proc_id", "left_semi")).distinct()
    return of_one.unionByName(rest.unionByName(mixed).join(names, "id").select("proc_id", "id", "name"))


MEMBERS = ("task", "gateway", "event", "role", "agent", "skill")


def _members(g: Graph, performed: DataFrame | None = None, kinds: Sequence[str] = MEMBERS) -> dict[str, DataFrame]:
    """Members (proc_id, kind, id, name) of each process by kind."""
    roles = settle((performers(g) if performed is None else performed).select("proc_id", F.col("role_id").alias("id")).distinct())
    names = lambda kind: node_rows({kind: g[kind]}).select("id", "name")
    found = {kind: links(g, f"HAS_{kind.upper()}", "process", kind, "proc_id", "id") for kind in schemas.FLOW_LABELS if kind in kinds}
    found |= {"role": roles} if "role" in kinds else {}
    named = {kind: d.join(names(kind), "id") for kind, d in found.items()}
    if "agent" in kinds or "skill" in kinds:
        by_role = roles.withColumnRenamed("id", "role_id").join(links(g, "ASSIGNED_AGENT", "role", "agent", "role_id", "id"), "role_id")
        agents = settle(by_role.select("proc_id", "id").distinct())
        named |= {"agent": agents.join(names("agent"), "id")} if "agent" in kinds else {}
        named |= {"skill": _skills_of(g, agents, names("skill"))} if "skill" in kinds else {}
    return {kind: d.select("proc_id", F.lit(kind).alias("kind"), "id", "name") for kind, d in named.items()}


def process_detail(g: Graph, performed: DataFrame | None = None) -> DataFrame:
    """Tasks, gateways, events, roles, agents and skills of each process as (proc_id, kind, id, name).

    Each branch is joined, reduced and named on its own, so branches never multiply one another. ``performed`` is the result of
    ``performers`` where it is at hand.
    """
    return union_all(list(_members(g, performed).values()))


def process_entities(g: Graph) -> DataFrame:
    """Typed members of each process with defaults, and the performer of each task."""
    detail = union_all(list(_members(g, kinds=("task", "gateway", "event", "role")).values()))
    typed = union_all(
        [
            g["task"].select(F.lit("task").alias("kind"), F.col("task_id").alias("id"), F.coalesce("task_type", F.lit("human")).alias("subtype"), F.coalesce("order", F.lit(0)).alias("position")),
            g["gateway"].select(F.lit("gateway").alias("kind"), F.col("gateway_id").alias("id"), F.coalesce("gateway_type", F.lit("exclusive")).alias("subtype"), F.lit(0).alias("position")),
            g["event"].select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.coalesce("event_type", F.lit("start")).alias("subtype"), F.lit(0).alias("position")),
        ]
    )
    performer = links(g, "PERFORMED_BY", "task", "role", "id", "role_id").groupBy("id").agg(F.max("role_id").alias("role_id")).withColumn("kind", F.lit("task"))
    return (
        detail.join(typed, ["kind", "id"], "left").join(performer, ["kind", "id"], "left")
        .select("proc_id", "kind", "id", or_blank("name").alias("name"), "subtype", F.coalesce("position", F.lit(0)).alias("position"), "role_id")
    )


def task_neighbours(g: Graph) -> DataFrame:
    """Distinct names of the tasks after and before each task: (task_id, direction, neighbour)."""
    pairs = links(g, "NEXT", "task", "task", "a", "b")
    named = g["task"].select("task_id", F.col("name").alias("neighbour")).where(~blank("neighbour"))
    after = pairs.join(named.withColumnRenamed("task_id", "b"), "b").select(F.col("a").alias("task_id"), F.lit("next").alias("direction"), "neighbour")
    before = pairs.join(named.withColumnRenamed("task_id", "a"), "a").select(F.col("b").alias("task_id"), F.lit("prev").alias("direction"), "neighbour")
    return after.unionByName(before).distinct()


def _task_context(g: Graph) -> DataFrame:
    role = links(g, "PERFORMED_BY", "task", "role", "task_id", "role_id").join(g["role"].select("role_id", F.col("name").alias("role_name")), "role_id")
    process = links(g, "HAS_TASK", "process", "task", "proc_id", "task_id").join(g["process"].select("proc_id", F.col("name").alias("process_name")), "proc_id")
    return g["task"].select("task_id", "name", "order").join(role, "task_id", "left").join(process, "task_id", "left")


def list_tasks(g: Graph) -> DataFrame:
    """Tasks with role, process, first evidence and neighbour counts, by order; see ``task_neighbours``."""
    around = task_neighbours(g).groupBy("task_id").agg(
        F.count_if(F.col("direction") == "next").alias("n_next"), F.count_if(F.col("direction") == "prev").alias("n_prev")
    )
    return (
        _task_context(g).join(first_evidence(g, "task", "task_id"), "task_id", "left").join(around, "task_id", "left")
        .na.fill(0, ["n_next", "n_prev"]).orderBy("order", "task_id")
    )


def find_tasks(g: Graph, keys: DataFrame) -> DataFrame:
    """Task of each (key): id equal to the key first, else the smallest id whose id or name holds it."""
    from procweave.operators.contain import contained_in

    distinct = keys.select("key").where("key <> ''").distinct()
    exact = distinct.join(g["task"].select(F.col("task_id").alias("key")), "key").select("key", F.col("key").alias("task_id"), F.lit(0).alias("rank"))
    texts = union_all([g["task"].select(F.col("task_id").alias("text_id"), F.col(c).alias("text")) for c in ("task_id", "name")])
    near = contained_in(texts, distinct.select(F.col("key").alias("name_id"), F.col("key").alias("keyword"))).select(
        F.col("name_id").alias("key"), F.col("text_id").alias("task_id"), F.lit(1).alias("rank")
    )
    return first_per_key(exact.unionByName(near), ["key"], ["rank", "task_id"])


def task_detail(g: Graph, keys: DataFrame) -> DataFrame:
    """The found task of each key with context, and every evidence and neighbour as further rows.

    Columns (key, task_id, kind, item_id, item_name); empty entries are left out.
    """
    found = find_tasks(g, keys).select("key", "task_id")
    context = found.join(_task_context(g), "task_id")
    parts = [
        context.select("key", "task_id", F.lit("task").alias("kind"), F.col("task_id").alias("item_id"), F.col("name").alias("item_name")),
        context.where("role_id IS NOT NULL").select("key", "task_id", F.lit("role").alias("kind"), F.col("role_id").alias("item_id"), F.col("role_name").alias("item_name")),
        context.where("proc_id IS NOT NULL").select("key", "task_id", F.lit("process").alias("kind"), F.col("proc_id").alias("item_id"), F.col("process_name").alias("item_name")),
    ]
    proof = links(g, "SUPPORTED_BY", "task", "chunk", "task_id", "chunk_id").join(g["chunk"].select("chunk_id", "text"), "chunk_id")
    parts.append(found.join(proof, "task_id").select("key", "task_id", F.lit("evidence").alias("kind"), F.col("chunk_id").alias("item_id"), F.col("text").alias("item_name")))
    pairs = links(g, "NEXT", "task", "task", "a", "b")
    names = g["task"].select(F.col("task_id").alias("item_id"), F.col("name").alias("item_name")).where(~blank("item_name"))
    for kind, here, there in (("next", "a", "b"), ("prev", "b", "a")):
        side = pairs.select(F.col(here).alias("task_id"), F.col(there).alias("item_id"))
        parts.append(found.join(side, "task_id").join(names, "item_id").select("key", "task_id", F.lit(kind).alias("kind"), "item_id", "item_name"))
    return union_all(parts)


# Prefixes of model element ids.
_ELEMENT_PREFIXES = {
    "task": ["Activity_"],
    "gateway": ["Gateway_"],
    "event": ["Event_", "StartEvent_", "EndEvent_"],
}


def element_lookup(g: Graph, keys: DataFrame) -> DataFrame:
    """Element behind a model element id: a task whose name or id holds the stripped key, else a
    gateway, else an event; with its role, process and first evidence."""
    from procweave.operators.contain import contained_in

    distinct = keys.select("key").distinct()
    hits = []
    for rank, kind in enumerate(schemas.FLOW_LABELS):
        term = F.col("key")
        for prefix in _ELEMENT_PREFIXES[kind]:
            term = F.replace(term, F.lit(prefix), F.lit(""))
        term = F.replace(term, F.lit("_"), F.lit(" "))
        id_col = schemas.KEYS[kind]
        texts = union_all([g[kind].select(F.col(id_col).alias("text_id"), F.col(c).alias("text")) for c in (id_col, "name")])
        found = contained_in(texts.where("text IS NOT NULL"), distinct.select(F.col("key").alias("name_id"), term.alias("keyword")))
        hits.append(found.select(F.col("name_id").alias("key"), F.lit(kind).alias("element_type"), F.col("text_id").alias("element_id"), F.lit(rank).alias("rank")))
    best = first_per_key(union_all(hits), ["key"], ["rank", "element_id"]).drop("rank")
    owner = union_all(
        [links(g, rel, "process", kind, "proc_id", "element_id").withColumn("element_type", F.lit(kind)) for kind, rel in (("task", "HAS_TASK"), ("gateway", "HAS_GATEWAY"), ("event", "HAS_EVENT"))]
    ).groupBy("element_type", "element_id").agg(F.min("proc_id").alias("proc_id"))
    role = links(g, "PERFORMED_BY", "task", "role", "element_id", "role_id").groupBy("element_id").agg(F.min("role_id").alias("role_id")).withColumn("element_type", F.lit("task"))
    proof = union_all([first_evidence(g, kind, "element_id").withColumn("element_type", F.lit(kind)) for kind in schemas.FLOW_LABELS])
    on = ["element_type", "element_id"]
    return (
        distinct.join(best, "key", "left").join(owner, on, "left").join(role, on, "left").join(proof, on, "left")
        .select("key", F.col("element_id").isNotNull().alias("found"), "element_type", "element_id", "proc_id", "role_id", "evidence_page")
    )


def list_roles(g: Graph) -> DataFrame:
    tasks = _counts(links(g, "PERFORMED_BY", "task", "role", "task_id", "role_id"), "role_id", "n_tasks")
    decisions = _counts(links(g, "MAKES_DECISION", "role", "decision", "role_id", "decision_id"), "role_id", "n_decisions")
    rows = g["role"].select("role_id", "name").join(tasks, "role_id", "left").join(decisions, "role_id", "left")
    return rows.na.fill(0, ["n_tasks", "n_decisions"]).join(first_evidence(g, "role", "role_id"), "role_id", "left").orderBy("name", "role_id")


def list_decisions(g: Graph) -> DataFrame:
    rules = _counts(links(g, "HAS_RULE", "decision", "rule", "decision_id", "rule_id"), "decision_id", "n_rules")
    makers = _counts(links(g, "MAKES_DECISION", "role", "decision", "role_id", "decision_id"), "decision_id", "n_roles")
    rows = g["decision"].select("decision_id", "name").join(rules, "decision_id", "left").join(makers, "decision_id", "left")
    return rows.na.fill(0, ["n_rules", "n_roles"]).join(first_evidence(g, "decision", "decision_id"), "decision_id", "left").orderBy("name", "decision_id")


def decision_roles(g: Graph) -> DataFrame:
    """Names of the roles that make each decision, as rows."""
    makers = links(g, "MAKES_DECISION", "role", "decision", "role_id", "decision_id")
    return makers.join(g["role"].select("role_id", F.col("name").alias("role_name")), "role_id").where(~blank("role_name")).select("decision_id", "role_name").distinct()


def list_flows(g: Graph) -> DataFrame:
    """Task to task flows with names, condition and the process of the source, by process and order."""
    flows = g["edges"].where("rel = 'NEXT' AND src_type = 'task' AND dst_type = 'task'").select(
        F.col("src_id").alias("from_task_id"), F.col("dst_id").alias("to_task_id"), "condition"
    )
    src = g["task"].select(F.col("task_id").alias("from_task_id"), F.col("name").alias("from_task"), F.col("order").alias("from_order"))
    dst = g["task"].select(F.col("task_id").alias("to_task_id"), F.col("name").alias("to_task"))
    owner = links(g, "HAS_TASK", "process", "task", "proc_id", "from_task_id").join(g["process"].select("proc_id", F.col("name").alias("process_name")), "proc_id").drop("proc_id")
    return (
        flows.join(src, "from_task_id").join(dst, "to_task_id").join(owner, "from_task_id", "left")
        .select("process_name", "from_order", "from_task_id", "from_task", "to_task_id", "to_task", "condition")
        .orderBy("process_name", "from_order", "to_task_id")
    )


def process_members(g: Graph) -> DataFrame:
    """(proc_id, type, id) of the flow nodes of each process."""
    rel = {"task": "HAS_TASK", "gateway": "HAS_GATEWAY", "event": "HAS_EVENT"}
    return union_all([links(g, r, "process", kind, "proc_id", "id").withColumn("type", F.lit(kind)) for kind, r in rel.items()])


def flows(g: Graph, within_process: bool = True) -> DataFrame:
    """NEXT edges between tasks, gateways and events with typed ids and names.

    Within a process both ends must belong to it; otherwise all edges are given, without process.
    """
    nodes = node_rows({k: g[k] for k in schemas.FLOW_LABELS})
    e = g["edges"].where("rel = 'NEXT'").select(F.col("src_type").alias("from_type"), F.col("src_id").alias("from_id"), F.col("dst_type").alias("to_type"), F.col("dst_id").alias("to_id"), "condition")
    a = nodes.select(F.col("type").alias("from_type"), F.col("id").alias("from_id"), F.col("name").alias("from_name"))
    b = nodes.select(F.col("type").alias("to_type"), F.col("id").alias("to_id"), F.col("name").alias("to_name"))
    out = e.join(a, ["from_type", "from_id"]).join(b, ["to_type", "to_id"])
    columns = ["from_type", "from_id", "from_name", "to_type", "to_id", "to_name", "condition"]
    if not within_process:
        return out.select(*columns)
    member = process_members(g)
    left = member.select("proc_id", F.col("type").alias("from_type"), F.col("id").alias("from_id"))
    right = member.select("proc_id", F.col("type").alias("to_type"), F.col("id").alias("to_id"))
    return out.join(left, ["from_type", "from_id"]).join(right, ["proc_id", "to_type", "to_id"]).select("proc_id", *columns)


def graph_stats(g: Graph) -> DataFrame:
    """Row counts of ten labels and five edge types, as (name, n)."""
    labels = ["process", "task", "role", "gateway", "event", "decision", "rule", "skill", "document", "chunk"]
    rels = ["HAS_TASK", "PERFORMED_BY", "NEXT", "SUPPORTED_BY", "MAKES_DECISION"]
    # Each table is reduced to one row before the union, so only counts move.
    rows = [g[x].agg(F.count(F.lit(1)).alias("n")).select(F.lit(x).alias("name"), "n") for x in labels if x in g]
    counted = g["edges"].where(F.col("rel").isin(rels)).groupBy("rel").agg(F.count(F.lit(1)).alias("n")).select(F.lower("rel").alias("name"), "n")
    zero = g["edges"].sparkSession.createDataFrame([(r.lower(), 0) for r in rels] + [(x, 0) for x in labels], "name string, n long")
    return union_all([*rows, counted, zero]).groupBy("name").agg(F.sum("n").alias("n"))


def _first_line_label(instruction: Column) -> Column:
    first = F.substring_index(strip(instruction), "\n", 1)
    return F.concat(F.substring(first, 1, 120), F.when(F.length(first) > 120, F.lit("...")).otherwise(F.lit("")))


def process_graph(g: Graph) -> DataFrame:
    """Element view of every process: (graph_id, elem_id, kind, type, label, source, target, condition)."""
    of = lambda kind, raw: F.concat(F.lit(f"{kind}:"), raw)
    title = {k: k.capitalize() for k in ("process", "task", "gateway", "event", "role", "agent", "skill")}

    def node(df: DataFrame, kind: str, raw: Column, label: Column) -> DataFrame:
        none = F.lit(None).cast("string")
        return df.select(
            F.col("proc_id").alias("graph_id"), of(kind, raw).alias("elem_id"), F.lit("node").alias("kind"), F.lit(kind).alias("type"),
            label.alias("label"), none.alias("source"), none.alias("target"), none.alias("condition"),
        )

    def line(df: DataFrame, rel: str, elem: Column, source: Column, target: Column, label: Column | None = None, condition: Column | None = None) -> DataFrame:
        return df.select(
            F.col("proc_id").alias("graph_id"), elem.alias("elem_id"), F.lit("edge").alias("kind"), F.lit(rel).alias("type"),
            (label if label is not None else F.lit(rel)).alias("label"), source.alias("source"), target.alias("target"),
            (condition if condition is not None else F.lit(None).cast("string")).alias("condition"),
        )

    roles = settle(performers(g))
    by_kind = {kind: d.where(~blank("id")) for kind, d in _members(g, roles).items()}
    # Lines and member nodes are read from these; roles, agents and skills are members only.
    flow_members = {kind: settle(by_kind[kind]) for kind in schemas.FLOW_LABELS}
    detail = union_all(list({**by_kind, **flow_members}.values()))
    tasks = links(g, "HAS_TASK", "process", "task", "proc_id", "task_id")
    agents = roles.select("proc_id", "role_id").distinct().join(links(g, "ASSIGNED_AGENT", "role", "agent", "role_id", "agent_id"), "role_id")
    # Distinct pairs on both sides, so what they make is distinct.
    skills = agents.select("proc_id", "agent_id").distinct().join(links(g, "USES_SKILL", "agent", "skill", "agent_id", "skill_id"), "agent_id")
    told = tasks.join(g["task"].where(~blank("instruction")).select("task_id", "instruction"), "task_id")
    kinds = F.create_map(*[F.lit(x) for pair in title.items() for x in pair])
    inst = F.concat(F.col("task_id"), F.lit(":instruction"))
    arrow = lambda rel, a, b: F.concat(F.lit(f"{rel}:"), a, F.lit("->"), b)
    c = F.col
    members = detail.select(
        c("proc_id").alias("graph_id"), F.concat(kinds[c("kind")], F.lit(":"), c("id")).alias("elem_id"), F.lit("node").alias("kind"),
        kinds[c("kind")].alias("type"), F.coalesce(null_if_blank("name"), c("id")).alias("label"),
        *[F.lit(None).cast("string").alias(x) for x in ("source", "target", "condition")],
    )
    parts = [
        node(g["process"], "Process", c("proc_id"), F.coalesce(null_if_blank("name"), F.lit("Process"))),
        members,
        node(told, "Instruction", inst, F.coalesce(null_if_blank(_first_line_label(c("instruction"))), F.lit("Instruction"))),
    ]
    for kind, rel in (("task", "HAS_TASK"), ("gateway", "HAS_GATEWAY"), ("event", "HAS_EVENT")):
        parts.append(line(flow_members[kind], rel, arrow(rel, c("proc_id"), c("id")), of("Process", c("proc_id")), of(title[kind], c("id"))))
    parts += [
        line(roles, "PERFORMED_BY", arrow("PERFORMED_BY", c("task_id"), c("role_id")), of("Task", c("task_id")), of("Role", c("role_id"))),
        line(told, "HAS_INSTRUCTION", F.concat(F.lit("HAS_INSTRUCTION:Task:"), c("task_id")), of("Task", c("task_id")), of("Instruction", inst)),
        line(agents, "ASSIGNED_AGENT", arrow("ASSIGNED_AGENT", c("role_id"), c("agent_id")), of("Role", c("role_id")), of("Agent", c("agent_id"))),
        line(skills.select("proc_id", "agent_id", "skill_id"), "USES_SKILL", F.concat(F.lit("USES_SKILL:Agent:"), c("agent_id"), F.lit("->Skill:"), c("skill_id")), of("Agent", c("agent_id")), of("Skill", c("skill_id"))),
        line(links(g, "HAS_SKILL", "process", "skill", "proc_id", "skill_id"), "HAS_SKILL", F.concat(F.lit("HAS_SKILL:Process:"), c("proc_id"), F.lit("->Skill:"), c("skill_id")), of("Process", c("proc_id")), of("Skill", c("skill_id"))),
    ]
    f = flows(g)
    a, b = F.concat(F.initcap("from_type"), F.lit(":"), c("from_id")), F.concat(F.initcap("to_type"), F.lit(":"), c("to_id"))
    parts.append(line(f, "NEXT", F.concat(F.lit("NEXT:"), a, F.lit("->"), b), a, b, strip(or_blank("condition")), strip(or_blank("condition"))))
    return union_all(parts)


def graph_counts(elements: DataFrame) -> DataFrame:
    return elements.groupBy("graph_id").agg(
        F.count_if(F.col("kind") == "node").alias("n_nodes"), F.count_if(F.col("kind") == "edge").alias("n_edges")
    )


def full_graph(g: Graph, max_nodes: int = 3000) -> DataFrame:
    """The first nodes by (type, id), at most ``max_nodes`` held between 100 and 10,000, with all
    edges among them. The limit is the feature: it is a picture for a screen."""
    bound = max(100, min(int(max_nodes or 3000), 10_000))
    nodes = node_rows({k: g[k] for k in schemas.CORE_LABELS if k in g}).orderBy("type", "id").limit(bound)
    named = nodes.select(
        F.concat_ws(":", "type", "id").alias("elem_id"), F.lit("node").alias("kind"), "type",
        F.coalesce(null_if_blank("name"), null_if_blank("id"), F.col("type")).alias("label"),
        F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("target"),
    )
    keep = nodes.select("type", "id")
    e = g["edges"].join(keep.select(F.col("type").alias("src_type"), F.col("id").alias("src_id")), ["src_type", "src_id"], "left_semi")
    e = e.join(keep.select(F.col("type").alias("dst_type"), F.col("id").alias("dst_id")), ["dst_type", "dst_id"], "left_semi")
    a, b = F.concat_ws(":", "src_type", "src_id"), F.concat_ws(":", "dst_type", "dst_id")
    drawn = e.select(
        F.concat(F.col("rel"), F.lit(":"), a, F.lit("->"), b).alias("elem_id"), F.lit("edge").alias("kind"), F.col("rel").alias("type"),
        F.col("rel").alias("label"), a.alias("source"), b.alias("target"),
    )
    return named.unionByName(drawn)


def open_ambiguities(ambiguity: DataFrame) -> DataFrame:
    return ambiguity.where("status = 'open'").orderBy("created_at", "amb_id")


def resolve_ambiguity(ambiguity: DataFrame, answers: DataFrame, now: Column) -> DataFrame:
    """Set answer, status and time of the questions in (amb_id, answer)."""
    given = answers.groupBy("amb_id").agg(F.max("answer").alias("__answer")).withColumn("__given", F.lit(True))
    hit = F.col("__given").isNotNull()
    joined = ambiguity.join(given, "amb_id", "left")
    return (
        joined.withColumn("status", F.when(hit, F.lit("resolved")).otherwise(F.col("status")))
        .withColumn("answer", F.when(hit, F.col("__answer")).otherwise(F.col("answer")))
        .withColumn("resolved_at", F.when(hit, now).otherwise(F.col("resolved_at")))
        .select(*ambiguity.columns)
    )


def review_progress(ambiguity: DataFrame) -> DataFrame:
    return ambiguity.agg(F.count_if(F.col("status") == "resolved").alias("n_resolved"), F.count(F.lit(1)).alias("n_total"))


def model_listing(models: DataFrame) -> DataFrame:
    """Stored models (proc_id, name, ...) with the first marked as default."""
    first = models.agg(F.min(F.struct("name", "proc_id")).alias("__first")).withColumn("__one", F.lit(1))
    # A global aggregate is one row, so it can always be broadcast.
    joined = models.withColumn("__one", F.lit(1)).join(F.broadcast(first), "__one", "left")
    is_first = (F.col("__first.proc_id") == F.col("proc_id")) & (F.col("__first.name") == F.col("name"))
    return joined.withColumn("is_default", is_first).drop("__one", "__first")


# Paths -------------------------------------------------------------------------------------------


def flow_chains(edges: DataFrame, limit: int = 5, max_length: int | None = None) -> DataFrame:
    """Longest paths along (proc_id, source, target) edges that close no loop (see ``without_loops``), from nodes nothing leads to.

    A dynamic program: of the chains of one length that end in a node only the first ``limit`` can be part of the report,
    since what extends one extends the others alike. A chain is its last node and a pointer to the chain before it; chains of one
    length are numbered in the order of their nodes, so pointers compare as whole paths do. Ties go to the smaller process, then to
    the smaller path. Edges with a loop raise, as does a ``max_length`` that is not enough. ``limit`` is the report size.
    """
    e = settle(edges.select("proc_id", "source", "target").distinct())
    starts = e.select("proc_id", F.col("source").alias("node")).distinct().join(
        e.select("proc_id", F.col("target").alias("node")), ["proc_id", "node"], "left_anti"
    )
    sizes = e.select("proc_id", F.explode(F.array("source", "target")).alias("node")).distinct().groupBy("proc_id").count()
    largest = sizes.agg(F.max("count")).first()[0] or 0
    chains = [settle(scan(starts.withColumn("before", F.lit(0).cast("long")), ["proc_id"], ["node"], number="at"))]
    for length in count(1):
        last = chains[-1].select("proc_id", F.col("node").alias("source"), F.col("at").alias("before"))
        grown = last.join(e, ["proc_id", "source"]).select("proc_id", F.col("target").alias("node"), "before")
        best = top_per_key(grown, ["proc_id", "node"], ["before"], limit)
        step = settle(scan(best, ["proc_id"], ["before", "node"], number="at"))
        if step.isEmpty():
            break
        if max_length and length > max_length:
            raise RuntimeError(f"there are paths of more than {max_length} steps")
        if length >= largest:
            raise RuntimeError("the edges close a loop")
        chains.append(step)
    return _chain_report(chains, limit, edges)


def _chain_report(chains: list[DataFrame], limit: int, edges: DataFrame) -> DataFrame:
    """The ``limit`` first of the longest chains, read back along their pointers; only these reach the driver."""
    found: list[dict] = []
    for length in range(len(chains) - 1, 0, -1):
        wanted = {(f["proc_id"], f["at"]) for f in found}
        if wanted:
            keys = edges.sparkSession.createDataFrame(sorted(wanted), f"proc_id {edges.schema['proc_id'].dataType.simpleString()}, at long")
            rows = {(r["proc_id"], r["at"]): r for r in chains[length].join(F.broadcast(keys), ["proc_id", "at"]).collect()}
            for f in found:
                row = rows[f["proc_id"], f["at"]]
                f["path"].append(row["node"])
                f["at"] = row["before"]
        if len(found) < limit:
            for r in chains[length].orderBy("proc_id", "at").limit(limit - len(found)).collect():
                found.append({"proc_id": r["proc_id"], "at": r["before"], "path": [r["node"]], "length": length})
    if found:
        keys = edges.sparkSession.createDataFrame(sorted({(f["proc_id"], f["at"]) for f in found}), f"proc_id {edges.schema['proc_id'].dataType.simpleString()}, at long")
        rows = {(r["proc_id"], r["at"]): r["node"] for r in chains[0].join(F.broadcast(keys), ["proc_id", "at"]).collect()}
        for f in found:
            f["path"].append(rows[f["proc_id"], f["at"]])
    report = [(f["proc_id"], " -> ".join(map(str, reversed(f["path"]))), f["length"]) for f in found]
    return edges.sparkSession.createDataFrame(report, f"proc_id {edges.schema['proc_id'].dataType.simpleString()}, chain string, length int")


def reachable(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Transitive closure of (proc_id, source, target) edges, self-loops left out: (proc_id, source, target).

    Paths double: each round joins the pairs found in the round before with all known ones on both sides, so rounds
    grow with the logarithm of the longest path. Rounds are kept as separate tables. A ``max_rounds`` that is not enough raises.
    """
    pair = ["proc_id", "source", "target"]
    fresh = settle(edges.where("source <> target").select(*pair).distinct())
    rounds = [fresh]

    def meet(a: DataFrame, b: DataFrame) -> DataFrame:
        step = b.select("proc_id", F.col("source").alias("target"), F.col("target").alias("__next"))
        return a.join(step, ["proc_id", "target"]).select("proc_id", "source", F.col("__next").alias("target"))

    for number in count(1):
        known = union_all(rounds)
        grown = meet(fresh, known).unionByName(meet(known, fresh)).distinct()
        fresh = settle(grown.join(known, pair, "left_anti"))
        if fresh.isEmpty():
            return known
        if max_rounds and number >= max_rounds:
            raise RuntimeError(f"the closure is not complete after {max_rounds} rounds")
        rounds.append(fresh)


def predecessors(activities: DataFrame, sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Activities that can reach each activity through any nodes.

    Input (proc_id, id, pos) and (proc_id, source, target). The first result holds pairs
    (proc_id, id, predecessor). A process without flows falls back to list order: every earlier
    activity precedes; those stay in the compact form (proc_id, id, n_before), since writing them
    out would be quadratic.
    """
    usable = sequences.where(~blank("source") & ~blank("target") & (F.col("source") != F.col("target")))
    acts = activities.select("proc_id", "id", "pos")
    pairs = (
        reachable(usable).where("source <> target")
        .join(acts.select("proc_id", F.col("id").alias("source")), ["proc_id", "source"], "left_semi")
        .join(acts.select("proc_id", F.col("id").alias("target")), ["proc_id", "target"], "left_semi")
        .select("proc_id", F.col("target").alias("id"), F.col("source").alias("predecessor"))
    )
    listed = acts.join(usable.select("proc_id"), "proc_id", "left_anti")
    fallback = scan(listed, ["proc_id"], ["pos", "id"], number="n").select("proc_id", "id", (F.col("n") - 1).alias("n_before"))
    return pairs, fallback


def without_loops(e: DataFrame) -> DataFrame:
    """Edges (proc_id, source, target) that close no loop.

    Inside a strongly connected part nodes stand in order of their distance from where the part is entered (from its smallest
    node if nothing enters it), then of id; edges that go back in that order are left out.
    """
    pair = ["proc_id", "source", "target"]
    closure = settle(reachable(e))
    mutual = settle(closure.join(closure.select("proc_id", F.col("target").alias("source"), F.col("source").alias("target")), pair, "left_semi").where("source <> target"))
    part = settle(mutual.groupBy("proc_id", F.col("source").alias("id")).agg(F.least(F.min("target"), F.first("source")).alias("part")))
    of = lambda name: part.select("proc_id", F.col("id").alias(name), F.col("part").alias(f"{name}_part"))
    marked = settle(e.join(of("source"), ["proc_id", "source"], "left").join(of("target"), ["proc_id", "target"], "left"))
    inner = F.coalesce(F.col("source_part") == F.col("target_part"), F.lit(False))
    entered = marked.where(F.col("target_part").isNotNull() & ~inner).select("proc_id", F.col("target").alias("id"), F.col("target_part").alias("part")).distinct()
    closed = part.select("proc_id", "part").distinct().join(entered, ["proc_id", "part"], "left_anti").select("proc_id", F.col("part").alias("id"), "part")
    inside = settle(marked.where(inner).select(*pair))
    frontier = settle(entered.unionByName(closed).select("proc_id", "id", F.lit(0).alias("far")))
    reached = [frontier]
    for far in count(1):
        step = frontier.select("proc_id", F.col("id").alias("source")).join(inside, ["proc_id", "source"]).select("proc_id", F.col("target").alias("id")).distinct()
        frontier = settle(step.join(union_all(reached).select("proc_id", "id"), ["proc_id", "id"], "left_anti").withColumn("far", F.lit(far)))
        if frontier.isEmpty():
            break
        reached.append(frontier)
    place = settle(union_all(reached))
    at = lambda name: place.select("proc_id", F.col("id").alias(name), F.col("far").alias(f"{name}_far"))
    forward = inside.join(at("source"), ["proc_id", "source"]).join(at("target"), ["proc_id", "target"]).where(F.struct("source_far", "source") < F.struct("target_far", "target"))
    return marked.where(~inner).select(*pair).unionByName(forward.select(*pair))


def flow_layers(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Layer of each node: 0 without predecessors, else one more than its highest predecessor.

    Edges that close a loop are left out first (``without_loops``), so the rest has a longest path. A ``max_rounds`` that is not
    enough raises.
    """
    e = settle(edges.where("source <> target").select("proc_id", "source", "target").distinct())
    nodes = e.select("proc_id", F.col("source").alias("id")).unionByName(e.select("proc_id", F.col("target").alias("id"))).distinct()
    acyclic = settle(without_loops(e))
    # Nodes leave level by level: those that no remaining edge leads to are one layer.
    layers = None
    frontier = settle(nodes.join(acyclic.select("proc_id", F.col("target").alias("id")), ["proc_id", "id"], "left_anti").withColumn("layer", F.lit(0)))
    layers = frontier
    for number in count(1):
        if max_rounds and number > max_rounds:
            raise RuntimeError(f"there are more than {max_rounds} layers")
        reached = frontier.select("proc_id", F.col("id").alias("source"), "layer").join(acyclic, ["proc_id", "source"])
        raised = settle(reached.groupBy("proc_id", F.col("target").alias("id")).agg((F.max("layer") + 1).cast("int").alias("layer")))
        if raised.isEmpty():
            break
        layers = settle(layers.unionByName(raised).groupBy("proc_id", "id").agg(F.max("layer").alias("layer")))
        frontier = raised
    return layers
