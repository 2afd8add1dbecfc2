"""Flow model repair and derivation.

A model is two tables keyed by ``proc_id``: nodes (pos, element_type, id, name, type, role, source,
description, instruction) and sequences (pos, id, name, source, target, condition). Every step works on all
processes at once.

Joins are sorted merges: a settled table takes up to a hundred times its file's size in memory, so one that looks small
enough to be held by every task is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procweave.functions import fixed
from procweave.functions.text import (
    blank,
    compact,
    null_if_blank,
    or_blank,
    snake_id,
    squeeze,
    strip,
    with_branch_conditions,
    with_gateway_name,
)
from procweave.operators.contain import contained_in
from procweave.operators.graph import union_all
from procweave.operators.ordered import first_per_key, scan
from procweave.session import settle

NODE = ["proc_id", "pos", "element_type", "id", "name", "type", "role", "source", "description", "instruction"]
SEQ = ["proc_id", "pos", "id", "name", "source", "target", "condition"]
#: Positions of the kinds of nodes lie this far apart, and derived flows come after all stored ones.
GROUP_SPAN, LATE = 1 << 44, 1 << 60


def _none() -> Column:
    return F.lit(None).cast("string")


def split_elements(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and sequences of one element list, with element types in canonical case."""
    kind = F.lower(strip(or_blank("element_type")))
    named = F.when(kind.isin("event", "sequence", "activity", "gateway"), F.initcap(kind)).otherwise(or_blank("element_type"))
    e = elements.withColumn("element_type", named)
    fill = lambda cols: [F.col(c) if c in e.columns else _none().alias(c) for c in cols]
    return e.where("element_type <> 'Sequence'").select(*fill(NODE)), e.where("element_type = 'Sequence'").select(*fill(SEQ))


def join_elements(nodes: DataFrame, seqs: DataFrame) -> DataFrame:
    columns = [*NODE, "target", "condition"]
    a = nodes.select(*NODE, _none().alias("target"), _none().alias("condition"))
    s = seqs.withColumn("element_type", F.lit("Sequence"))
    b = s.select(*[F.col(c) if c in s.columns else _none().alias(c) for c in columns])
    return a.unionByName(b)


def runtime_types(nodes: DataFrame) -> DataFrame:
    """Nodes with the type names of the runtime form: first letter in lower case, activities as user tasks."""
    lower_first = F.concat(F.lower(F.substring("type", 1, 1)), F.expr("substring(type, 2)"))
    return nodes.withColumn("type", F.when(F.col("element_type") == "Activity", "userTask").otherwise(lower_first))


def normalize_ids(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Snake-case unique ids, made from type and position when missing, and the (proc_id, old_id, id) map.

    A repeated id gets its number as suffix; of nodes that shared an old id the last one is its target.
    """
    base = F.when(F.col("element_type") == "Event", "event").when(F.col("element_type") == "Gateway", "gateway").otherwise("activity")
    place = F.col("pos").cast("string")
    old = F.coalesce(null_if_blank(strip("id")), F.concat(base, F.lit("_"), place))
    n = nodes.withColumn("__old", old)
    n = n.withColumn("__new", F.coalesce(F.nullif(snake_id("__old"), F.lit("")), F.concat(F.lit("node_"), place)))
    n = scan(n, ["proc_id", "__new"], ["pos"], number="__n")
    n = n.withColumn("id", F.when(F.col("__n") == 1, F.col("__new")).otherwise(F.concat("__new", F.lit("_"), F.col("__n").cast("string"))))
    mapping = n.groupBy("proc_id", F.col("__old").alias("old_id")).agg(F.max_by("id", "pos").alias("id"))
    pointed = n.withColumn("source", null_if_blank(strip("source")))
    out = map_ids(pointed, mapping, "source")
    return out.select(*NODE), mapping


def map_ids(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Old ids of a column under their new names; unknown ones in snake case."""
    m = mapping.select("proc_id", F.col("old_id").alias("__key"), F.col("id").alias("__to"))
    keyed = rows.withColumn("__key", strip(column))
    return keyed.join(m.hint("merge"), ["proc_id", "__key"], "left").withColumn(column, F.coalesce("__to", F.nullif(snake_id("__key"), F.lit("")))).drop("__key", "__to")


def normalize_types(nodes: DataFrame) -> DataFrame:
    """Canonical types, and the defaults every activity needs: name, output, tool and duration."""
    t, low = strip(or_blank("type")), F.lower(strip(or_blank("type")))
    event = (
        F.when(low.isin("startevent", "start_event", "start"), "StartEvent").when(low.isin("endevent", "end_event", "end"), "EndEvent")
        .when(t.rlike(r"^\p{Lu}"), t).otherwise("IntermediateCatchEvent")
    )
    gate = (
        F.when(low.isin("exclusivegateway", "exclusive_gateway"), "ExclusiveGateway").when(low.isin("parallelgateway", "parallel_gateway"), "ParallelGateway")
        .when(low.isin("inclusivegateway", "inclusive_gateway"), "InclusiveGateway").when(t == "", "ExclusiveGateway").otherwise(t)
    )
    kind = F.col("element_type")
    activity = kind == "Activity"
    name = F.when(activity, F.coalesce("name", F.concat(F.lit(fixed.ACTIVITY_DEFAULT), F.col("pos").cast("string")))).otherwise(F.col("name"))
    n = nodes.withColumn("type", F.when(kind == "Event", event).when(activity, "UserActivity").when(kind == "Gateway", gate).otherwise(t)).withColumn("name", name)
    tool = F.concat(F.lit("formHandler:"), snake_id(F.col("proc_id").cast("string")), F.lit("_"), snake_id("id"), F.lit("_form"))
    return (
        n.withColumn("output", F.when(activity, F.when(blank("name"), fixed.OUTPUT_DEFAULT).otherwise(F.concat(strip("name"), F.lit(fixed.OUTPUT_SUFFIX)))))
        .withColumn("tool", F.when(activity, tool)).withColumn("duration", F.when(activity, F.lit(fixed.DEFAULT_DURATION)))
    )


def _valid(seqs: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("proc_id", "id").hint("merge")
    kept = seqs.where(~blank("source") & ~blank("target") & (F.col("source") != F.col("target")))
    kept = kept.join(ids.withColumnRenamed("id", "source"), ["proc_id", "source"], "left_semi")
    return kept.join(ids.withColumnRenamed("id", "target"), ["proc_id", "target"], "left_semi")


def infer_sequence_ends(nodes: DataFrame, seqs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Sequences under new ids; a missing end is the nearest node before or after in list order.
    Self-loops and unknown ends are dropped."""
    mapped = map_ids(map_ids(seqs, mapping, "source"), mapping, "target")
    listed = union_all(
        [
            nodes.select("proc_id", "pos", F.col("id").alias("node"), *[_none().alias(c) for c in ("sid", "name", "source", "target", "condition")]),
            mapped.select("proc_id", "pos", _none().alias("node"), F.coalesce(null_if_blank("id"), F.lit("")).alias("sid"), "name", "source", "target", "condition"),
        ]
    )
    near = scan(listed, ["proc_id"], ["pos"], last_seen={"prev_node": F.col("node")}, next_seen={"next_node": F.col("node")}).where("node IS NULL")
    out = near.select(
        "proc_id", "pos", F.col("sid").alias("id"), or_blank("name").alias("name"), F.coalesce(null_if_blank("source"), "prev_node").alias("source"),
        F.coalesce(null_if_blank("target"), "next_node").alias("target"), or_blank("condition").alias("condition"),
    )
    ided = F.coalesce(F.nullif(snake_id("id"), F.lit("")), F.concat_ws("_", F.lit("seq"), "source", "target"))
    return _valid(out, nodes).withColumn("id", ided).select(*SEQ)


def _edge_rows(df: DataFrame, source: str, target: str, pos: Column, condition: Column | None = None) -> DataFrame:
    cond = condition if condition is not None else F.lit("")
    return df.select(
        "proc_id", pos.cast("long").alias("pos"), F.concat_ws("_", F.lit("seq"), source, target).alias("id"), cond.alias("name"),
        F.col(source).alias("source"), F.col(target).alias("target"), cond.alias("condition"),
    )


def _absent(rows: DataFrame, seqs: DataFrame) -> DataFrame:
    return rows.join(seqs.select("proc_id", "source", "target").hint("merge"), ["proc_id", "source", "target"], "left_anti").select(*SEQ)


def source_pointer_edges(nodes: DataFrame, seqs: DataFrame) -> DataFrame:
    """Sequences from the ``source`` field of nodes where no such edge is there yet."""
    rows = _edge_rows(nodes.withColumn("__src", F.col("source")), "__src", "id", F.col("pos"))
    return _absent(_valid(rows.select(*SEQ), nodes), seqs)


def ensure_start_end(nodes: DataFrame) -> DataFrame:
    """Nodes with a start event before and an end event after everything where a process has none."""
    per = nodes.groupBy("proc_id").agg(
        F.min("pos").alias("lo"), F.max("pos").alias("hi"),
        F.bool_or((F.col("element_type") == "Event") & (F.col("type") == "StartEvent")).alias("has_start"),
        F.bool_or((F.col("element_type") == "Event") & (F.col("type") == "EndEvent")).alias("has_end"),
    )

    def extra(df: DataFrame, pos: Column, node_id: str, name: str, kind: str) -> DataFrame:
        return df.select(
            "proc_id", pos.cast("long").alias("pos"), F.lit("Event").alias("element_type"), F.lit(node_id).alias("id"), F.lit(name).alias("name"),
            F.lit(kind).alias("type"), F.lit("").alias("role"), _none().alias("source"), F.lit("").alias("description"), _none().alias("instruction"),
        )

    start = extra(per.where("NOT has_start"), F.col("lo") - 1, "start_event", fixed.START_NAME, "StartEvent")
    end = extra(per.where("NOT has_end"), F.col("hi") + 1, "end_event", fixed.END_NAME, "EndEvent")
    return union_all([nodes.select(*NODE), start, end])


def connect_consecutive(nodes: DataFrame, seqs: DataFrame) -> DataFrame:
    """Sequences between neighbours in list order that have none."""
    rows = scan(nodes.select("proc_id", "pos", "id"), ["proc_id"], ["pos"], lead={"next_id": "id"}).where("next_id IS NOT NULL AND next_id <> id")
    return _absent(_edge_rows(rows, "id", "next_id", F.col("pos")).select(*SEQ), seqs)


def _out_counts(seqs: DataFrame) -> DataFrame:
    return seqs.groupBy("proc_id", F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("n_out"))


def insert_branch_gateways(nodes: DataFrame, seqs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A node other than a gateway that leads to several gets an exclusive gateway behind it."""
    forks = nodes.where("element_type <> 'Gateway'").join(_out_counts(seqs).where("n_out > 1").hint("merge"), ["proc_id", "id"])
    label = F.coalesce(null_if_blank(strip("name")), F.col("id"))
    told = null_if_blank(strip("description"))
    named = with_gateway_name(
        forks.withColumn("__label", label).withColumn("__told", told), "gw_name", F.concat(F.col("__label"), F.lit(" " + fixed.BRANCH_WORD)),
        F.coalesce("__told", F.concat("__label", F.lit(" 여부 판단"))), F.lit(1),
    ).withColumn("gw_id", snake_id(F.concat("id", F.lit("_gateway"))))
    gates = named.select(
        "proc_id", "pos", F.lit("Gateway").alias("element_type"), F.col("gw_id").alias("id"), F.col("gw_name").alias("name"), F.lit("ExclusiveGateway").alias("type"),
        or_blank("role").alias("role"), F.col("id").alias("source"), F.coalesce("__told", F.concat("__label", F.lit(" 분기 판단"))).alias("description"), _none().alias("instruction"),
    )
    moved = seqs.join(named.select("proc_id", F.col("id").alias("source"), "gw_id").hint("merge"), ["proc_id", "source"], "left")
    kept = moved.where("gw_id IS NULL").select(*SEQ)
    out = _edge_rows(moved.where("gw_id IS NOT NULL"), "gw_id", "target", F.col("pos"), strip(or_blank("condition")))
    into = _edge_rows(named.withColumn("__src", F.col("id")), "__src", "gw_id", F.col("pos"))
    return nodes.select(*NODE).unionByName(gates), union_all([kept, out.select(*SEQ), into.select(*SEQ)])


def collapse_single_branch_gateways(nodes: DataFrame, seqs: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Gateways with one way out or none give way to links from their predecessors to the target.

    ``known`` holds pairs (proc_id, source, target) that count as linked already.
    """
    sized = nodes.where("element_type = 'Gateway'").select("proc_id", "id").join(_out_counts(seqs).hint("merge"), ["proc_id", "id"], "left")
    gone = sized.where(F.coalesce("n_out", F.lit(0)) <= 1).select("proc_id", "id")
    outs = seqs.join(gone.withColumnRenamed("id", "source").hint("merge"), ["proc_id", "source"], "left_semi").select("proc_id", F.col("source").alias("__g"), F.col("target").alias("__to"))
    ins = seqs.join(gone.withColumnRenamed("id", "target").hint("merge"), ["proc_id", "target"], "left_semi").select("proc_id", F.col("target").alias("__g"), F.col("source").alias("__from"), "pos")
    through = ins.join(outs.hint("merge"), ["proc_id", "__g"]).where(F.col("__from") != F.col("__to"))
    bridges = first_per_key(_edge_rows(through, "__from", "__to", F.col("pos")), ["proc_id", "source", "target"], ["pos"])
    pairs = known if known is not None else seqs
    kept = seqs.unionByName(_absent(bridges.select(*SEQ), pairs))
    for end in ("source", "target"):
        kept = kept.join(gone.withColumnRenamed("id", end).hint("merge"), ["proc_id", end], "left_anti")
    return nodes.join(gone.hint("merge"), ["proc_id", "id"], "left_anti").select(*NODE), kept.select(*SEQ)


def fill_branch_conditions(nodes: DataFrame, seqs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conditions behind gateways with several ways out: placeholders go, two ways get the yes and no
    text, more get the target's name; a blank name copies the condition."""
    gates = nodes.where("element_type = 'Gateway'").join(_out_counts(seqs).where("n_out >= 2").hint("merge"), ["proc_id", "id"])
    named = with_gateway_name(gates, "__derived", F.col("name"), F.col("description"), F.lit(1))
    key = compact("name")
    placeholder = (key == "") | key.rlike(rf"^({'|'.join(fixed.GATEWAY_PLACEHOLDERS)})[_-]?\d*$")
    named = named.withColumn("__gname", F.when(placeholder, F.col("__derived")).otherwise(strip("name")))
    named = with_branch_conditions(named, "__yes", "__no", F.col("__gname"), F.col("description"))
    side = named.select("proc_id", F.col("id").alias("source"), "n_out", "__gname", "__yes", "__no")
    target = nodes.select("proc_id", F.col("id").alias("target"), squeeze(F.coalesce(null_if_blank("name"), "description", F.lit(""))).alias("__hint"))
    first = seqs.groupBy("proc_id", "source").agg(F.min(F.struct("pos", "id")).alias("__first"))
    j = seqs.join(side.hint("merge"), ["proc_id", "source"], "left").join(target.hint("merge"), ["proc_id", "target"], "left").join(first.hint("merge"), ["proc_id", "source"])
    hint = F.when(F.length("__hint") > 60, F.concat(F.rtrim(F.substring("__hint", 1, 60)), F.lit("..."))).otherwise(or_blank("__hint"))
    hint = F.when(compact("__hint").isin(fixed.RELATION_CONDITIONS), F.lit("")).otherwise(hint)
    low = compact("condition")
    cleaned = F.when(low.isin(fixed.RELATION_CONDITIONS) | low.rlike(fixed.PLACEHOLDER_CONDITION_PATTERN), F.lit("")).otherwise(strip(or_blank("condition")))
    two_way = F.when(F.struct("pos", "id") == F.col("__first"), F.col("__yes")).otherwise(F.col("__no"))
    by_name = F.when(hint != "", F.concat(hint, F.lit(fixed.TRUE_SUFFIX))).otherwise(F.concat(F.coalesce(null_if_blank("__gname"), F.lit(fixed.GATEWAY_DEFAULT_SUBJECT)), F.lit(fixed.SATISFIED_SUFFIX)))
    j = j.withColumn("__c", cleaned)
    filled = F.when(F.col("n_out").isNull(), F.col("condition")).when(F.col("__c") != "", F.col("__c")).when(F.col("n_out") == 2, two_way).otherwise(by_name)
    j = j.withColumn("condition", filled).withColumn("name", F.when(F.col("n_out").isNotNull(), F.coalesce(null_if_blank("name"), "condition")).otherwise(F.col("name")))
    renamed = nodes.join(named.select("proc_id", "id", "__gname").hint("merge"), ["proc_id", "id"], "left").withColumn("name", F.coalesce("__gname", "name"))
    return renamed.select(*NODE), j.select(*SEQ)


def connect_end_events(nodes: DataFrame, seqs: DataFrame, terminal_only: bool = False) -> DataFrame:
    """Sequences to end events that nothing leads to.

    From the last activity without a way out, else the last activity, else the last terminal node,
    else the last node; with ``terminal_only`` from the highest id among terminal nodes that are
    neither start nor end.
    """
    low = F.lower(strip(or_blank("type")))
    n = nodes.withColumn("__end", (F.col("element_type") == "Event") & (low == "endevent")).withColumn("__start", (F.col("element_type") == "Event") & (low == "startevent"))
    n = n.join(_out_counts(seqs).hint("merge"), ["proc_id", "id"], "left").withColumn("__open", F.col("n_out").isNull() & ~F.col("__end"))
    reached = seqs.select("proc_id", F.col("target").alias("id"))
    ends = n.where("__end").join(reached.hint("merge"), ["proc_id", "id"], "left_anti").select("proc_id", F.col("id").alias("end_id"), "pos")
    group = F.when(F.col("element_type") == "Activity", 0).when(F.col("element_type") == "Gateway", 1).otherwise(2)
    n = n.withColumn("__at", F.struct(group.alias("g"), "pos"))
    act = F.col("element_type") == "Activity"
    pick = lambda cond: F.max_by("id", F.when(cond, F.col("__at")))
    if terminal_only:
        chosen = F.max(F.when(F.col("__open") & ~F.col("__start"), F.col("id")))
    else:
        chosen = F.coalesce(pick(act & F.col("__open")), pick(act), pick(F.col("__open")), pick(~F.col("__end")))
    source = n.groupBy("proc_id").agg(chosen.alias("src")).where("src IS NOT NULL")
    return _absent(_edge_rows(ends.join(source.hint("merge"), "proc_id"), "src", "end_id", F.col("pos")).select(*SEQ), seqs)


def repair(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All repair steps in order; intermediate models are settled because each is read several times."""
    nodes, seqs = split_elements(elements)
    nodes, mapping = normalize_ids(nodes)
    nodes = settle(normalize_types(nodes).select(*NODE))
    seqs = settle(infer_sequence_ends(nodes, seqs, mapping))
    seqs = seqs.unionByName(source_pointer_edges(nodes, seqs))
    nodes = ensure_start_end(nodes)
    seqs = settle(seqs.unionByName(connect_consecutive(nodes, seqs)))
    known = seqs
    nodes, seqs = insert_branch_gateways(nodes, seqs)
    nodes, seqs = settle(nodes), settle(seqs)
    nodes, seqs = collapse_single_branch_gateways(nodes, seqs, known)
    nodes, seqs = fill_branch_conditions(settle(nodes), settle(seqs))
    return nodes, seqs.unionByName(connect_end_events(nodes, seqs))


# Models from entities -------------------------------------------------------------------------------


def elements_from_entities(processes: DataFrame, tasks: DataFrame, roles: DataFrame, gateways: DataFrame, flows: DataFrame) -> DataFrame:
    """Element list of each process: activities by order and name, gateways, a start and an end, the
    flows by name or id once each; a straight chain when there is at most one flow.

    ``tasks`` carry ``role`` names, ``flows`` carry (proc_id, pos, source, target, condition).
    """
    p = processes.select("proc_id")
    own_role = roles.where(~blank("name")).groupBy("proc_id").agg(F.min_by(strip("name"), "pos").alias("r1"))
    by_task = tasks.where(~blank("role")).groupBy("proc_id").agg(F.min_by(strip("role"), "pos").alias("r2"))
    default = p.join(own_role.hint("merge"), "proc_id", "left").join(by_task.hint("merge"), "proc_id", "left").select("proc_id", F.coalesce("r1", "r2", F.lit(fixed.DEFAULT_ROLE)).alias("default_role"))
    t = scan(tasks.withColumn("__o", F.coalesce("order", F.lit(10**9))).withColumn("__nm", or_blank("name")), ["proc_id"], ["__o", "__nm", "pos"], number="n").join(default.hint("merge"), "proc_id")
    name = F.coalesce(null_if_blank(strip("name")), F.concat(F.lit(fixed.ACTIVITY_DEFAULT), F.col("n").cast("string")))
    activity = t.select(
        "proc_id", F.struct(F.lit(1).alias("g"), F.col("n").alias("n")).alias("at"), F.lit("Activity").alias("element_type"), snake_id("task_id").alias("id"), name.alias("name"),
        F.lit("UserActivity").alias("type"), F.coalesce(null_if_blank(strip("role")), "default_role").alias("role"), strip(or_blank("description")).alias("description"), strip(or_blank("instruction")).alias("instruction"),
    )
    g = scan(gateways, ["proc_id"], ["pos"], number="n").join(default.hint("merge"), "proc_id")
    g = with_gateway_name(g, "gname", F.col("name"), F.col("description"), F.col("n"))
    low = F.lower(or_blank("gateway_type"))
    gate = g.select(
        "proc_id", F.struct(F.lit(2).alias("g"), F.col("n").alias("n")).alias("at"), F.lit("Gateway").alias("element_type"), snake_id("gateway_id").alias("id"), F.col("gname").alias("name"),
        F.when(F.contains(low, F.lit("parallel")), "ParallelGateway").when(F.contains(low, F.lit("inclusive")), "InclusiveGateway").otherwise("ExclusiveGateway").alias("type"),
        F.col("default_role").alias("role"), strip(or_blank("description")).alias("description"), F.lit("").alias("instruction"),
    )

    def event(rank: int, node_id: str, label: str, kind: str) -> DataFrame:
        return default.select(
            "proc_id", F.struct(F.lit(rank).alias("g"), F.lit(0).cast("long").alias("n")).alias("at"), F.lit("Event").alias("element_type"), F.lit(node_id).alias("id"), F.lit(label).alias("name"),
            F.lit(kind).alias("type"), F.col("default_role").alias("role"), F.lit("").alias("description"), F.lit("").alias("instruction"),
        )

    nodes = union_all([event(0, "start_event", fixed.START_NAME, "StartEvent"), activity, gate, event(3, "end_event", fixed.END_NAME, "EndEvent")])
    # Of nodes with the same name, the later one in the list is meant.
    by_name = nodes.where("element_type <> 'Event'").groupBy("proc_id", F.lower(strip("name")).alias("key")).agg(F.max_by("id", "at").alias("node"))
    by_id = nodes.select("proc_id", F.col("id").alias("key"), F.col("id").alias("node")).distinct()

    def end(rows: DataFrame, column: str) -> DataFrame:
        named = by_name.select("proc_id", F.col("key").alias("__nk"), F.col("node").alias("__named"))
        known = by_id.select("proc_id", F.col("key").alias("__ik"), F.col("node").alias("__known"))
        keyed = rows.withColumn("__nk", F.lower(strip(column))).withColumn("__ik", snake_id(column))
        return keyed.join(named.hint("merge"), ["proc_id", "__nk"], "left").join(known.hint("merge"), ["proc_id", "__ik"], "left").withColumn(column, F.coalesce("__named", "__known")).drop("__nk", "__ik", "__named", "__known")

    f = end(end(flows.where(~blank("source") & ~blank("target")), "source"), "target").where("source IS NOT NULL AND target IS NOT NULL AND source <> target")
    f = first_per_key(f.withColumn("condition", strip(or_blank("condition"))), ["proc_id", "source", "target", "condition"], ["pos"])
    few = p.join(f.groupBy("proc_id").agg(F.count(F.lit(1)).alias("n")).hint("merge"), "proc_id", "left").where(F.coalesce("n", F.lit(0)) <= 1).select("proc_id")
    chain = scan(nodes.select("proc_id", "id", "at", F.col("at.g").alias("g"), F.col("at.n").alias("n")), ["proc_id"], ["g", "n"], lead={"next_id": "id"}).where("next_id IS NOT NULL")
    chain = chain.join(few.hint("merge"), "proc_id", "left_semi").select("proc_id", F.lit(LATE) + F.col("g") * GROUP_SPAN + F.col("n").cast("long"), F.col("id").alias("source"), F.col("next_id").alias("target"), F.lit("").alias("condition")).toDF("proc_id", "pos", "source", "target", "condition")
    chain = chain.join(f.select("proc_id", "source", "target", "condition").hint("merge"), ["proc_id", "source", "target", "condition"], "left_anti")
    s = f.select("proc_id", F.col("pos").cast("long").alias("pos"), "source", "target", "condition").unionByName(chain.select("proc_id", "pos", "source", "target", "condition"))
    seqs = s.select("proc_id", "pos", F.concat_ws("_", F.lit("seq"), "source", "target").alias("id"), F.col("condition").alias("name"), "source", "target", "condition")
    flat = nodes.select("proc_id", (F.col("at.g") * GROUP_SPAN + F.col("at.n")).cast("long").alias("pos"), "element_type", "id", "name", "type", "role", F.lit("").alias("source"), "description", "instruction")
    return join_elements(flat, seqs)


def element_counts(elements: DataFrame) -> DataFrame:
    kind = lambda k: F.count_if(F.lower(strip("element_type")) == k)
    return elements.groupBy("proc_id").agg(
        kind("event").alias("n_events"), kind("activity").alias("n_activities"), kind("gateway").alias("n_gateways"), kind("sequence").alias("n_sequences")
    )


def needs_fallback(model: DataFrame, entities: DataFrame) -> DataFrame:
    """Reason to distrust a supplied model, by counts: ``model`` from ``element_counts``, ``entities``
    with (proc_id, x_tasks, x_gateways, x_flows, x_events)."""
    j = entities.join(model.hint("merge"), "proc_id", "full").withColumn("__missing", F.col("n_activities").isNull()).na.fill(0)
    c = F.col
    reason = (
        F.when(c("__missing"), "elements_missing_or_not_list")
        .when((c("x_tasks") > 0) & (c("n_activities") == 0), "no_activities_while_extracted_has_tasks")
        .when((c("x_gateways") >= 2) & (c("n_gateways") == 0), "no_gateways_while_extracted_has_gateways")
        .when((c("x_flows") > 2) & (c("n_sequences") <= 1), "no_sequences_while_extracted_has_flows")
        .when((c("x_events") >= 4) & (c("n_events") <= 2) & (c("n_activities") <= 1), "event_count_collapsed_to_start_end_only")
        .otherwise("ok")
    )
    return j.select("proc_id", (reason != "ok").alias("fallback"), reason.alias("reason"))


def enrich_tasks_from_graph(tasks: DataFrame, elements: DataFrame) -> DataFrame:
    """Role name from the performer edges of graph elements, blank texts from task and instruction elements.

    ``elements`` is the view of ``queries.process_graph`` with ``instruction`` and ``description``.
    """
    roles = elements.where("kind = 'node' AND type = 'Role'").groupBy(F.col("elem_id").alias("target")).agg(F.min("label").alias("__role"))
    performed = elements.where("kind = 'edge' AND type = 'PERFORMED_BY'").select("source", "target").distinct().join(roles, "target")
    performed = performed.groupBy(F.substring_index("source", "Task:", -1).alias("task_id")).agg(F.min("__role").alias("__role"))
    told = elements.where("kind = 'node' AND type = 'Instruction'").groupBy(F.regexp_extract("elem_id", r"^Instruction:(.*):instruction$", 1).alias("task_id")).agg(F.max("instruction").alias("__told"))
    node = elements.where("kind = 'node' AND type = 'Task'").groupBy(F.regexp_extract("elem_id", r"^Task:(.*)$", 1).alias("task_id")).agg(F.max("description").alias("__desc"))
    j = tasks.join(performed, "task_id", "left").join(told, "task_id", "left").join(node, "task_id", "left")
    for column, found in (("role", "__role"), ("instruction", "__told"), ("description", "__desc")):
        j = j.withColumn(column, F.coalesce(null_if_blank(column), found, F.lit("")))
    return j.select(*tasks.columns)


def backfill_activities(activities: DataFrame, entities: DataFrame) -> DataFrame:
    """Blank role, description and instruction from the entity of the same process matched by id, else
    by name, else by containment of names, else by ordinal place. Activities are never added."""
    a = scan(activities, ["proc_id"], ["pos"], number="__n").withColumn("__key", compact("name"))
    e = scan(entities.withColumn("__o", F.coalesce("order", F.lit(10**9))).withColumn("__nm", or_blank("name")), ["proc_id"], ["__o", "__nm", "task_id"], number="__n")
    e = e.withColumn("__ekey", compact("name"))
    # Sorted merges: the compressed texts look small enough for a table on the driver and are not.
    by_id = a.join(e.select("proc_id", F.col("task_id").alias("id"), F.col("task_id").alias("__m")).hint("merge"), ["proc_id", "id"]).select("proc_id", "pos", "__m", F.lit(0).alias("__r"), F.lit(0).cast("long").alias("__at"))
    named = e.where("__ekey <> ''").groupBy("proc_id", F.col("__ekey").alias("__key")).agg(F.max_by("task_id", "__n").alias("__m"))
    by_name = a.join(named.hint("merge"), ["proc_id", "__key"]).select("proc_id", "pos", "__m", F.lit(1).alias("__r"), F.lit(0).cast("long").alias("__at"))
    rest = a.join(by_id.unionByName(by_name).select("proc_id", "pos").hint("merge"), ["proc_id", "pos"], "left_anti")
    # Distinct names only: of equal names the first entity is the first hit.
    first = e.where("__ekey <> ''").groupBy("proc_id", "__ekey").agg(F.min(F.struct("__n", "task_id")).alias("f"))
    open_ = rest.where("__key <> ''")
    inside = contained_in(open_.select("proc_id", F.col("pos").alias("text_id"), F.col("__key").alias("text")), first.select("proc_id", F.col("__ekey").alias("name_id"), F.col("__ekey").alias("keyword")), by=["proc_id"])
    around = contained_in(first.select("proc_id", F.col("__ekey").alias("text_id"), F.col("__ekey").alias("text")), open_.select("proc_id", F.col("pos").alias("name_id"), F.col("__key").alias("keyword")), by=["proc_id"])
    held = inside.select("proc_id", F.col("text_id").alias("pos"), F.col("name_id").alias("__ekey")).unionByName(around.select("proc_id", F.col("name_id").alias("pos"), F.col("text_id").alias("__ekey")))
    near = held.join(first.hint("merge"), ["proc_id", "__ekey"])
    by_part = near.groupBy("proc_id", "pos").agg(F.min("f").alias("f")).select("proc_id", "pos", F.col("f.task_id").alias("__m"), F.lit(2).alias("__r"), F.lit(0).cast("long").alias("__at"))
    by_place = rest.join(e.select("proc_id", "__n", F.col("task_id").alias("__m")).hint("merge"), ["proc_id", "__n"]).select("proc_id", "pos", "__m", F.lit(3).alias("__r"), F.lit(0).cast("long").alias("__at"))
    match = first_per_key(union_all([by_id, by_name, by_part, by_place]), ["proc_id", "pos"], ["__r", "__m"]).select("proc_id", "pos", "__m")
    src = e.select("proc_id", F.col("task_id").alias("__m"), *[F.col(c).alias(f"__{c}") for c in ("role", "description", "instruction")])
    j = a.join(match.hint("merge"), ["proc_id", "pos"], "left").join(src.hint("merge"), ["proc_id", "__m"], "left")
    for c in ("role", "description", "instruction"):
        j = j.withColumn(c, F.coalesce(null_if_blank(c), null_if_blank(strip(f"__{c}")), F.lit("")))
    return j.select(*activities.columns)


def gateway_decisions(nodes: DataFrame, seqs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A decision per exclusive gateway with several ways out and a rule per condition."""
    gates = nodes.where((F.col("element_type") == "Gateway") & F.contains(F.lower("type"), F.lit("exclusive"))).join(_out_counts(seqs).where("n_out >= 2").hint("merge"), ["proc_id", "id"])
    label = F.coalesce(null_if_blank(strip("name")), F.col("id"))
    key = F.coalesce(F.nullif(snake_id("id"), F.lit("")), F.col("id"))
    decisions = gates.select(
        "proc_id", F.concat(F.lit("dmn_decision_"), key).alias("decision_id"), F.coalesce(null_if_blank(strip("name")), F.lit(fixed.DECISION_DEFAULT_NAME)).alias("name"),
        F.coalesce(null_if_blank(strip("description")), F.concat(label, F.lit(fixed.DECISION_DESC_SUFFIX))).alias("description"), F.col("id").alias("gateway_id"),
    )
    numbered = scan(seqs, ["proc_id", "source"], ["pos", "id"], number="n").withColumnRenamed("source", "gateway_id").where(~blank("condition"))
    target = nodes.select("proc_id", F.col("id").alias("target"), F.col("name").alias("__tname"))
    rules = numbered.join(decisions.select("proc_id", "gateway_id", "decision_id").hint("merge"), ["proc_id", "gateway_id"]).join(target.hint("merge"), ["proc_id", "target"], "left").select(
        "proc_id", F.concat(F.lit("dmn_rule_"), F.expr("substring(decision_id, 14)"), F.lit("_"), F.col("n").cast("string")).alias("rule_id"), "decision_id",
        strip("condition").alias("when"), F.concat(F.coalesce(null_if_blank(strip("__tname")), "target"), F.lit(fixed.RULE_THEN_SUFFIX)).alias("then"), "target",
    )
    return decisions, rules


def union_first(existing: DataFrame, derived: DataFrame, key: list[str]) -> DataFrame:
    """Existing rows, then derived ones of unseen ids."""
    both = existing.withColumn("__src", F.lit(0)).unionByName(derived.withColumn("__src", F.lit(1)), allowMissingColumns=True)
    return first_per_key(both, key, ["__src"]).drop("__src")


def remap_roles(activities: DataFrame, pairs: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Activity roles from explicit (proc_id, pos, task_name, role) pairs, else from tasks, by name; and
    the roles then in use in order of first use."""
    ranked = union_all(
        [
            pairs.select("proc_id", compact("task_name").alias("__key"), strip("role").alias("__role"), F.lit(0).alias("__src"), (-F.col("pos")).cast("long").alias("__at")),
            tasks.select("proc_id", compact("name").alias("__key"), strip("role").alias("__role"), F.lit(1).alias("__src"), F.col("pos").cast("long").alias("__at")),
        ]
    ).where("__key <> '' AND __role <> ''")
    chosen = first_per_key(ranked, ["proc_id", "__key"], ["__src", "__at"]).select("proc_id", "__key", "__role")
    out = activities.withColumn("__key", compact("name")).join(chosen.hint("merge"), ["proc_id", "__key"], "left").withColumn("role", F.coalesce("__role", "role"))
    out = out.select(*activities.columns)
    used = out.where(~blank("role")).groupBy("proc_id", F.col("role").alias("name")).agg(F.min("pos").alias("first_pos"))
    endpoint = F.concat(F.lit("role_"), F.coalesce(F.nullif(snake_id("name"), F.lit("")), F.lit("owner")))
    return out, used.select("proc_id", "name", endpoint.alias("endpoint"), "first_pos")


def enrich_defaults(nodes: DataFrame, seqs: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Defaults for missing fields, escaped line breaks restored, conditions from names when blank;
    unless ``strict``, start and end events are added as well."""
    unescape = lambda c: F.replace(or_blank(c), F.lit("\\n"), F.lit("\n"))
    n = nodes.withColumn("description", unescape("description")).withColumn("instruction", unescape("instruction"))
    n = n.withColumn("name", or_blank("name")).withColumn("role", or_blank("role"))
    s = seqs.withColumn("condition", F.coalesce(null_if_blank("condition"), "name", F.lit(""))).withColumn("name", or_blank("name"))
    return (n if strict else ensure_start_end(n)), s


def ordered_flow_list(tasks: DataFrame, flows: DataFrame, start_id: str = "start", end_id: str = "end") -> DataFrame:
    """Flows of each process as drawn: start to first task, stored flows, gaps in task order, last task
    to the end unless it leads to an event. The first flow of each source and target counts; ids are stable."""
    t = scan(tasks.select("proc_id", "task_id", "order"), ["proc_id"], ["order", "task_id"], number="n", lead={"next_id": "task_id"})
    first = t.where("n = 1").select("proc_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("at"), F.lit(start_id).alias("source"), F.col("task_id").alias("target"), _none().alias("condition"))
    stored = flows.select("proc_id", F.lit(1).alias("rank"), F.col("pos").cast("long").alias("at"), F.col("from_id").alias("source"), F.col("to_id").alias("target"), F.col("condition"))
    pairs = flows.select("proc_id", F.col("from_id").alias("task_id"), F.col("to_id").alias("next_id"))
    gaps = t.where("next_id IS NOT NULL").join(pairs.hint("merge"), ["proc_id", "task_id", "next_id"], "left_anti").select(
        "proc_id", F.lit(2).alias("rank"), F.col("n").alias("at"), F.col("task_id").alias("source"), F.col("next_id").alias("target"), _none().alias("condition")
    )
    to_event = flows.where("to_type = 'event'").select("proc_id", F.col("from_id").alias("task_id"))
    last = t.where("next_id IS NULL").join(to_event.hint("merge"), ["proc_id", "task_id"], "left_anti").select(
        "proc_id", F.lit(3).alias("rank"), F.lit(0).cast("long").alias("at"), F.col("task_id").alias("source"), F.lit(end_id).alias("target"), _none().alias("condition")
    )
    rows = union_all([first, stored, gaps, last])
    fid = F.regexp_replace(F.concat_ws("_", F.lit("SequenceFlow"), "source", "target"), r"[^0-9A-Za-z_-]", "_")
    return first_per_key(rows.withColumn("flow_id", fid), ["proc_id", "source", "target"], ["rank", "at"])


def incoming_outgoing(flows: DataFrame) -> DataFrame:
    """(proc_id, node, direction, flow_id) rows: the flows that enter and leave each node."""
    return flows.select(
        "proc_id", "flow_id",
        F.inline(F.array(F.struct(F.col("source").alias("node"), F.lit("outgoing").alias("direction")), F.struct(F.col("target").alias("node"), F.lit("incoming").alias("direction")))),
    )


def sync_elements(elements: DataFrame, activities: DataFrame) -> DataFrame:
    """Final name, description, role and instruction of activities copied back to their elements by id."""
    fields = ["name", "description", "role", "instruction"]
    final = activities.select("proc_id", "id", *[F.col(c).alias(f"__{c}") for c in fields]).withColumn("element_type", F.lit("Activity"))
    j = elements.join(final.hint("merge"), ["proc_id", "id", "element_type"], "left")
    for c in fields:
        j = j.withColumn(c, F.coalesce(f"__{c}", c))
    return j.select(*elements.columns)
