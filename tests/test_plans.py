"""Joins of large tables build no table on the driver."""

from procweave.llm import near_dedup as nd
from procweave.operators import flows, graph
from procweave.operators.contain import contained_in
from procweave.sources.snapshots import integrated_of_task


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_names_in_texts_meet_in_sorted_merges(spark):
    texts = spark.createDataFrame([(1, "a red bolt"), (2, "plate")], "text_id int, text string")
    names = spark.createDataFrame([(7, "red"), (8, "plate")], "name_id int, keyword string")
    found = contained_in(texts, names)
    assert "Broadcast" not in _plan(found)
    assert sorted((x.text_id, x.name_id) for x in found.collect()) == [(1, 7), (2, 8)]


def test_snapshots_of_tasks_meet_in_sorted_merges(spark):
    runs = spark.createDataFrame([("t1-5", "t1", None), ("t2-6", None, '{"for": "s3"}')], "run_id string, task_id string, metadata string")
    snaps = spark.createDataFrame([("t1-5", "integrated", "", 1), ("t2-6", "integrated", "", 2)], "run_id string, snapshot_type string, proc_id string, created_at int")
    found = integrated_of_task(snaps, runs, spark.createDataFrame([("t1",), ("t2",), ("s3",)], "task_id string"))
    assert "Broadcast" not in _plan(found)
    assert sorted((x.task_id, x.run_id, x["rank"]) for x in found.collect()) == [("s3", "t2-6", 3), ("t1", "t1-5", 1), ("t2", "t2-6", 2)]


def test_activities_are_filled_in_sorted_merges(spark):
    schema = "proc_id int, pos int, id string, name string, role string, description string, instruction string"
    acts = spark.createDataFrame([(1, 1, "x", "?", "", "", ""), (1, 2, "?", "Bolt", "", "", ""), (1, 3, "?", "??", "", "", "")], schema)
    told = spark.createDataFrame([("x", 1, "rod", 1, "r1", "", "i1"), ("y", 1, "red bolt", 2, "r2", "", "i2"), ("z", 1, "nut", 3, "r3", "", "i3")],
                                 "task_id string, proc_id int, name string, order int, role string, description string, instruction string")
    found = flows.backfill_activities(acts, told)
    assert "Broadcast" not in _plan(found)
    assert [x.role for x in found.orderBy("pos").collect()] == ["r1", "r2", "r3"]


def test_dense_regions_are_counted_over_prefixes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(nd, "settle", lambda df: seen.append(df) or df)
    rests = [(a << 32) + (b << 16) + c for a in (1, 2) for b in (1, 2) for c in range(3) for _ in range(4)]
    rows = spark.createDataFrame([(5, r, i, 9, len(rests)) for i, r in enumerate(rests)], "head long, rest long, node long, n int, c long")
    nd.candidates(rows)
    dense = seen[0]
    joins = [line for line in dense._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line]
    # Rows meet the counts once, by their full prefix.
    assert "rest" in joins[0] and "q6" not in joins[0]
    got = {(x.c4, x.c5, x.c6) for x in dense.collect()}
    assert dense.count() == len(rests) and got == {(24, 12, 4)}


def test_flow_models_are_joined_by_sorted_merges(spark):
    """Settled nodes and flows look small as files: no task may hold one of them whole."""
    kinds = [("event", "Start", "", "start", ""), ("activity", "A", "a", "", ""), ("sequence", "", "", "", "A"), ("activity", "B", "b", "", "A"), ("gateway", "G", "g", "", "B"), ("activity", "C", "c", "", "G"), ("event", "End", "", "end", "")]
    rows = [(p, i, kind, node, name, form, "r", source, "", "", "", "") for p in ("p", "q") for i, (kind, node, name, form, source) in enumerate(kinds)]
    elements = spark.createDataFrame(rows, "proc_id string, pos long, element_type string, id string, name string, type string, role string, source string, target string, condition string, description string, instruction string")
    nodes, seqs = flows.split_elements(elements)
    nodes, mapping = flows.normalize_ids(nodes)
    nodes = flows.normalize_types(nodes).select(*flows.NODE)
    ends = flows.infer_sequence_ends(nodes, seqs, mapping)
    assert [(r.source, r.target) for r in ends.where("proc_id = 'p'").collect()] == [("a", "b")]
    for found in (ends, flows.source_pointer_edges(nodes, ends), flows.connect_consecutive(nodes, ends), flows.connect_end_events(nodes, ends), flows.sync_elements(nodes, nodes)):
        assert "Broadcast" not in _plan(found)
    gates, split = flows.insert_branch_gateways(nodes, ends)
    for found in (split, *flows.collapse_single_branch_gateways(gates, split), *flows.fill_branch_conditions(gates, split), *flows.gateway_decisions(gates, split)):
        assert "Broadcast" not in _plan(found)


def test_agents_meet_skills_of_their_name_in_parts(spark):
    asked = [(a, n) for a in ("a", "b", "c", None) for n in ("Red", "blue ", "", None)] + [("a", "red"), ("d", "green")]
    skills = [("s1", "red"), ("s2", " RED"), ("s2", "red"), ("s3", "red"), ("s3", "blue"), ("s4", "blue"), (None, "blue"), (None, "red"), ("s5", ""), ("s6", "black")]
    agents = spark.createDataFrame(asked, "agent_id string, skill_name string")
    found = graph.agent_skill_edges(agents, spark.createDataFrame(skills, "skill_id string, name string"), agents)
    key = lambda n: (n or "").strip().lower()
    want = {(a, s) for a, n in asked for s, m in skills if key(n) and key(n) == key(m)}
    got = [(r.src_id, r.dst_id) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    # Only pairs of skills with several names are made distinct; all others go out as they meet.
    top = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert top[0].startswith("Union") and "Aggregate" not in top[1]


def test_skills_of_an_only_role_are_not_made_distinct(spark):
    has_task = [("p", "t1"), ("p", "t2"), ("q", "t3"), ("q", "t4"), (None, "t5"), (None, "t6"), ("r", "t7")]
    does = [("t1", "a"), ("t2", "a"), ("t3", "a"), ("t4", "b"), ("t5", "a"), ("t6", "b"), ("t7", "c"), ("t7", "b"), ("t7", None)]
    can = [("a", "s1"), ("a", "s2"), ("a", "s2"), ("b", "s2"), ("b", None)]
    rows = [("process", a, "HAS_TASK", "task", b, None) for a, b in has_task] + [("task", a, "PERFORMED_BY", "role", b, None) for a, b in does] + [("role", a, "HAS_SKILL", "skill", b, None) for a, b in can]
    found = graph.process_skill_edges(spark.createDataFrame(rows, "src_type string, src_id string, rel string, dst_type string, dst_id string, condition string"))
    want = {(p, s) for p, t in has_task for u, role in does if u == t for q, s in can if q == role}
    got = [(x.src_id, x.dst_id) for x in found.collect()]
    assert len(got) == len(want) and set(got) == want
    top = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert top[0].startswith("Union") and "Aggregate" not in top[1]
