import pytest
from pyspark.sql import functions as F

from procweave import schemas
from procweave.operators import flows, graph, match
from procweave.operators import queries as q


def test_upserts_are_idempotent(spark):
    store = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, seq int")
    once = graph.upsert_nodes(store, new, "id", "seq")
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted(map(tuple, graph.upsert_nodes(once, new, "id", "seq").collect())) == sorted(map(tuple, once.collect()))
    nodes = spark.createDataFrame([("task", "x"), ("task", "y")], "type string, id string")
    raw = spark.createDataFrame([("task", "x", "NEXT", "task", "y", "old", 1), ("task", "x", "NEXT", "task", "y", "new", 2), ("task", "x", "NEXT", "task", "gone", "", 1)], schemas.EDGES + ", seq int")
    edges = graph.upsert_edges(schemas.empty(spark, "edges"), raw, nodes, "seq")
    again = graph.upsert_edges(edges, raw, nodes, "seq")
    assert [r.condition for r in edges.collect()] == ["new"] and again.count() == 1


def test_layers_skip_cycles_and_closure_is_transitive(spark):
    e = spark.createDataFrame([("p", a, b) for a, b in ["ab", "bc", "cb", "cd", "ad", "ed"]], "proc_id string, source string, target string")
    closure = {(r.source, r.target) for r in q.reachable(e).collect()}
    assert all((a, d) in closure for a, b in closure for c, d in closure if b == c)
    layers = {r.id: r.layer for r in q.flow_layers(e).collect()}
    assert layers == {"a": 0, "e": 0, "b": 1, "c": 2, "d": 3}
    loop = spark.createDataFrame([("p", a, b) for a, b in [("start", "A"), ("A", "B"), ("B", "A"), ("B", "end")]] + [("q", "y", "x"), ("q", "x", "y"), ("q", "y", "z")], "proc_id string, source string, target string")
    assert {(r.proc_id, r.id): r.layer for r in q.flow_layers(loop).collect()} == {("p", "start"): 0, ("p", "A"): 1, ("p", "B"): 2, ("p", "end"): 3, ("q", "x"): 0, ("q", "y"): 1, ("q", "z"): 2}
    chains = [r.chain for r in q.flow_chains(q.without_loops(e), 2).collect()]
    assert chains[0] == "a -> b -> c -> d"
    with pytest.raises(RuntimeError):
        q.flow_chains(e, 2)


def test_longest_chains_equal_brute_force_and_do_not_hold_all_paths(spark):
    import random

    rng = random.Random(8)
    rows = sorted({(p, f"n{a:02d}", f"n{b:02d}") for p in ("p", "q") for a, b in [sorted(rng.sample(range(9), 2)) for _ in range(14)]})
    after = {}
    for p, a, b in rows:
        after.setdefault((p, a), []).append(b)
    paths = []

    def walk(p, path):
        if len(path) > 1:
            paths.append((1 - len(path), p, path))
        for b in after.get((p, path[-1]), ()):
            walk(p, [*path, b])

    targets = {(p, b) for p, _, b in rows}
    for p, a in sorted(after.keys() - targets):
        walk(p, [a])
    want = [(p, " -> ".join(path), -n) for n, p, path in sorted(paths)[:7]]
    assert [tuple(r) for r in q.flow_chains(spark.createDataFrame(rows, "proc_id string, source string, target string"), 7).collect()] == want
    # Thirty levels of two nodes, each leading to both of the next: 2 ** 30 paths.
    ladder = [("p", f"{i:02d}{a}", f"{i + 1:02d}{b}") for i in range(29) for a in "ab" for b in "ab"]
    got = [r.chain.split(" -> ") for r in q.flow_chains(spark.createDataFrame(ladder, "proc_id string, source string, target string"), 3).collect()]
    assert [[n[-1] for n in c[-2:]] for c in got] == [["a", "a"], ["a", "b"], ["b", "a"]] and all(len(c) == 30 and {n[-1] for n in c[:-2]} == {"a"} for c in got)


def test_rounds_go_to_the_end_or_raise(spark):
    n = 130
    e = spark.createDataFrame([("p", f"n{i:03d}", f"n{i + 1:03d}") for i in range(n)], "proc_id string, source string, target string")
    assert q.reachable(e).count() == n * (n + 1) // 2
    assert q.flow_chains(e, 1).first().length == n
    short = e.where("source < 'n012'")
    assert q.flow_layers(short).agg(F.max("layer")).first()[0] == 12
    org = spark.createDataFrame([("t", None, True, "T")] + [(f"d{i}", f"d{i - 1}" if i else "t", False, "x") for i in range(8)], "node_id string, parent_id string, is_team boolean, name string")
    assert match.flatten_org(org)[1].count() == 8
    for call in (lambda: q.reachable(e, 2), lambda: q.flow_chains(e, 1, 3), lambda: q.flow_layers(short, 3), lambda: match.flatten_org(org, 2)):
        with pytest.raises(RuntimeError):
            call()
    for extra in ([("x", "y", False, ""), ("y", "x", False, "")], [("d0", "d7", False, "")]):
        with pytest.raises(RuntimeError):
            match.flatten_org(org.union(spark.createDataFrame(extra, org.schema)))


def test_long_ids_stay_apart(spark):
    a, b, c = "a" * 300, "b" * 300, "c" * 300
    tasks = spark.createDataFrame([("p", a, 1)], "proc_id string, task_id string, order int")
    stored = spark.createDataFrame([("p", 1, a, b, "event", ""), ("p", 2, a, c, "event", "")], "proc_id string, pos long, from_id string, to_id string, to_type string, condition string")
    listed = flows.ordered_flow_list(tasks, stored)
    assert {(r.source, r.target) for r in listed.collect()} == {("start", a), (a, b), (a, c)} and listed.select("flow_id").distinct().count() == 3


def test_predecessors_fall_back_to_list_order(spark):
    acts = spark.createDataFrame([("p", "a", 0), ("p", "b", 1), ("q", "x", 0), ("q", "y", 1)], "proc_id string, id string, pos int")
    seqs = spark.createDataFrame([("p", "a", "gw"), ("p", "gw", "b")], "proc_id string, source string, target string")
    pairs, listed = q.predecessors(acts, seqs)
    assert [(r.id, r.predecessor) for r in pairs.collect()] == [("b", "a")]
    assert {(r.id, r.n_before) for r in listed.collect()} == {("x", 0), ("y", 1)}


def test_repair_gives_connected_models(spark):
    rows = [
        ("p", 1, "activity", "A 1", "Ask", "", None, None, None), ("p", 2, "sequence", None, None, "", "A 1", "B", "yes"), ("p", 3, "sequence", None, None, "", "A 1", "C", ""),
        ("p", 4, "activity", "B", "Buy", "", None, None, None), ("p", 5, "Activity", "C", "Check", "", "b", None, None), ("p", 6, "sequence", None, None, "", "x", "x", ""),
    ]
    elements = spark.createDataFrame(rows, "proc_id string, pos long, element_type string, id string, name string, type string, source string, target string, condition string")
    nodes, seqs = flows.repair(elements)
    ids = {r.id for r in nodes.collect()}
    assert {"a_1", "b", "c", "start_event", "end_event", "a_1_gateway"} <= ids
    pairs = {(r.source, r.target): r.condition for r in seqs.collect()}
    assert all(a in ids and b in ids for a, b in pairs)
    assert pairs[("a_1_gateway", "b")] == "yes" and pairs[("a_1_gateway", "c")] != ""
    assert all(n == "start_event" or any(b == n for _, b in pairs) for n in ids)


def test_end_event_is_linked_from_the_last_activity(spark):
    nodes = spark.createDataFrame([("p", 1, "Activity", "a", "UserActivity"), ("p", 2, "Activity", "b", "UserActivity"), ("p", 3, "Event", "end", "EndEvent")], "proc_id string, pos long, element_type string, id string, type string")
    seqs = spark.createDataFrame([("p", 1, "s", "", "a", "b", ""), ("p", 2, "t", "", "b", "a", "")], "proc_id string, pos long, id string, name string, source string, target string, condition string")
    assert [(r.source, r.target) for r in flows.connect_end_events(nodes, seqs).collect()] == [("b", "end")]


def test_skills_of_processes_with_none_one_and_several_agents(spark):
    """Own and agents' skills of a process once each, named by every node row; unnamed skills are left out."""
    own = [("p0", "s1"), ("p1", "s1"), ("p1", "s4"), ("p2", "s1"), ("p2", "gone")]
    uses = [("a", "s1"), ("a", "s2"), ("b", "s2"), ("b", "s3"), ("b", "gone")]
    agents = [("p1", "a"), ("p2", "a"), ("p2", "b")]
    rows = [("agent", a, "USES_SKILL", "skill", s) for a, s in uses * 2] + [("process", p, "HAS_SKILL", "skill", s) for p, s in own * 2]
    edges = spark.createDataFrame([(*x, "") for x in rows], schemas.EDGES)
    names = [(f"s{i}", f"skill {i}") for i in range(1, 5)] + [("s2", "again")]
    got = sorted(map(tuple, q._skills_of({"edges": edges}, spark.createDataFrame(agents, "proc_id string, id string"), spark.createDataFrame(names, "id string, name string")).collect()))
    held = set(own) | {(p, s) for p, a in agents for b, s in uses if a == b}
    assert got == sorted((p, s, n) for p, s in held for k, n in names if k == s)


def test_equal_names_are_compared_once(spark, monkeypatch):
    """Names that many agents share and texts that many activities share come to the containment once each."""
    seen = []
    plain = match._either_way

    def counted(keys, names):
        seen.extend((d.count(), d.select(c).distinct().count()) for d, c in ((keys, "key"), (names, "name")))
        return plain(keys, names)

    monkeypatch.setattr(match, "_either_way", counted)
    users = spark.createDataFrame([(i, i, f"user {i}", "buyer" if i % 2 else "clerk", "desk", i > 3) for i in range(12)], "id int, pos int, username string, role string, alias string, is_agent boolean")
    roles = spark.createDataFrame([(i, n) for i, n in enumerate(["buyer", "chief clerk", "user 1", "none", "desk"])], "role_id int, name string")
    assert {(x.role_id, x.user_id, x.exact) for x in match.match_roles(roles, users).collect()} == {(0, 5, True), (1, 4, False), (2, 10, False), (4, 4, True)}
    scores = {(x.role_id, x.agent_id): x.score for x in match.agent_candidates(roles, users.where("is_agent")).collect()}
    assert {a for r, a in scores if r == 0} == {5, 7, 9, 11} and {scores[4, a] for a in range(4, 12)} == {1.0} and scores[2, 10] == 0.8 and scores[2, 4] == 0.5
    acts = spark.createDataFrame([(i, "ask the clerk", "", "", "", None) for i in range(6)], "activity_id int, name string, role string, instruction string, description string, agent int")
    assert {(x.activity_id, x.agent_id, x.rank) for x in match.pick_agents(acts, users).collect()} == {(i, 4, 2) for i in range(6)}
    assert len(seen) == 8 and all(n == distinct for n, distinct in seen)


def test_agents_are_found_for_each_end_of_a_name_once(spark, monkeypatch):
    """Keys that share their first or last three characters do not multiply the texts they are looked for in; candidates equal plain Python's."""
    seen = []
    plain = match.contained_in

    def counted(texts, names, **more):
        if "shortest" in more:
            seen.append((names.count(), names.select("keyword").distinct().count()))
        return plain(texts, names, **more)

    monkeypatch.setattr(match, "contained_in", counted)
    monkeypatch.setattr(match, "KEYS_PER_PART", 7, raising=False)
    users = [(i, i % 5, f"user {i}", ("buyer", "clerk", None)[i % 3], "desk lead") for i in range(40)]
    roles = [(i, f"user {i}") for i in range(30)] + [(30, "User 3"), (31, "buy"), (32, "lead"), (33, "zz"), (34, ""), (35, "qqqqq"), (36, "clerks of all")]
    key = lambda x: x.lower().replace(" ", "")
    want = []
    for role, name in roles:
        k, best = key(name), {}
        for a, pos, *texts in users:
            for t in (key(x) for x in texts if x):
                score = 1.0 if t == k else 0.8 if t in k or k in t else 0.5 if len(k) >= 3 and (k[:3] in t or k[-3:] in t) else 0
                if k and score > best.get((pos, a), 0):
                    best[pos, a] = score
        if k and not best:
            best = {(pos, a): 0.0 for pos, a in sorted((u[1], u[0]) for u in users)[:20]}
        want += [(role, at[1], score, n) for n, (at, score) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0])), 1)]
    r = spark.createDataFrame(roles, "role_id int, name string")
    u = spark.createDataFrame(users, "id int, pos int, username string, role string, alias string")
    assert sorted(map(tuple, match.agent_candidates(r, u).collect())) == sorted(want)
    assert len(seen) == 1 and all(n == distinct for n, distinct in seen)


def test_unknown_relations_are_refused(spark):
    links = spark.createDataFrame([(1, 2)], "a int, b int")
    try:
        graph.link_edges(links, "HAS_RULE", "task", "a", "rule", "b")
    except ValueError:
        return
    raise AssertionError("an undeclared edge type was accepted")


def test_full_graph_holds_its_bounds(spark):
    tasks = spark.range(150).select(F.col("id").cast("string").alias("task_id"), F.lit("t").alias("name"))
    g = {"task": tasks, "edges": schemas.empty(spark, "edges")}
    assert q.full_graph(g, 5).count() == 100
