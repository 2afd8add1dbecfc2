"""Operators that callers combine by themselves, on small tables worked out by hand."""

import datetime as dt

from pyspark.sql import functions as F

from procweave import schemas
from procweave.operators import artifacts, flows, graph, match, segment, vectors
from procweave.sources import documents, exports, snapshots


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_text_files_become_documents(spark, tmp_path):
    (tmp_path / "First plan+.v2.txt").write_text("page one\n\fpage two\f")
    (tmp_path / "b").write_text("one")
    (tmp_path / "empty").write_text("")
    got = {r.title: r for r in documents.read_text_documents(spark, str(tmp_path)).collect()}
    assert set(got) == {"First plan+.v2", "b"} and got["First plan+.v2"].source.endswith("v2.txt")
    assert got["First plan+.v2"].page_count == len(got["First plan+.v2"].pages) >= 2 and len(got["b"].doc_id) == 32


def test_clear_all_and_declared_tables(spark):
    empty = graph.clear_all(spark)
    assert set(empty) == {*schemas.TABLES, "edges"} and all(d.isEmpty() for d in empty.values())
    assert empty["task"].columns == schemas.struct_of("task").fieldNames()
    loose = spark.createDataFrame([("7", "t1", "robot", 1.0), ("8", "t2", "human", None)], "order string, task_id string, task_type string, other double")
    tight = schemas.conform(loose, "task")
    assert tight.schema == schemas.struct_of("task") and rows(tight, "task_id", "order", "name") == [("t1", 7, None), ("t2", 8, None)]
    assert rows(schemas.enum_violations(tight, "task"), "task_id") == [("t1",)] and schemas.enum_violations(tight, "role").isEmpty()


def test_runs_keep_their_first_time(spark):
    schema = "run_id string, task_id string, metadata string, created_at timestamp, updated_at timestamp"
    early, late = dt.datetime(2020, 1, 1), dt.datetime(2021, 1, 1)
    stored = spark.createDataFrame([("a", "t", "old", early, early), ("b", "t", "stays", early, early)], schema)
    new = spark.createDataFrame([("a", "t", "new"), ("c", "t", "first")], "run_id string, task_id string, metadata string")
    saved = snapshots.save_runs(stored, new, F.lit(late))
    assert rows(saved, "run_id", "metadata", "created_at", "updated_at") == [("a", "new", early, late), ("b", "stays", early, early), ("c", "first", late, late)]
    assert rows(snapshots.save_runs(saved, new, F.lit(late))) == rows(saved)


def test_exported_rows(spark, tmp_path):
    listed = spark.createDataFrame([("p", 2, "B/1"), ("p", 1, "A"), ("q", 1, "C")], "grp string, pos int, name string")
    marked = exports.default_of(exports.export_listing(listed, F.col("name"), ".md"), "grp", ["pos"])
    assert rows(marked, "grp", "pos", "is_default") == [("p", 1, True), ("p", 2, False), ("q", 1, True)]
    assert all("/" not in r.file_name and r.file_name.endswith(".md") for r in marked.collect())
    exports.write_rows(marked, str(tmp_path / "json"), "json", ["grp"])
    exports.write_rows(marked, str(tmp_path / "json"), "json", ["grp"])
    assert rows(spark.read.json(str(tmp_path / "json")), "grp", "name") == [("p", "A"), ("p", "B/1"), ("q", "C")]


def test_sections_of_the_chosen_strategy(spark):
    pages = "doc_id int, pages array<struct<page:int,text:string>>"
    docs = spark.createDataFrame([(i, [(n + 1, "t") for n in range(p)]) for i, p in ((1, 3), (2, 6), (3, 4), (4, 2))], pages)
    shape = "doc_id int, heading string, level int, page_from int, page_to int, content string"
    headings = spark.createDataFrame([(1, "h1", 1, 1, 3, "x"), (2, "h2", 1, 1, 2, "x"), (2, "h3", 1, 3, 6, "x"), (3, "h4", 1, 1, 4, "x")], shape)
    bounds = spark.createDataFrame([(2, "b", 1, 1, 6, "y"), (3, "b1", 1, 1, 2, "y"), (3, "b2", 1, 3, 4, "y"), (4, "b3", 1, 1, 2, "y")], shape)
    # No boundary: headings. One boundary over all of a document with two headings: headings. Else boundaries.
    assert rows(segment.choose_sections(docs, headings, bounds), "doc_id", "heading") == [(1, "h1"), (2, "h2"), (2, "h3"), (3, "b1"), (3, "b2"), (4, "b3")]


def test_review_questions_and_search_fields(spark):
    resolved = spark.createDataFrame([(1, 7, 0.85, "review"), (2, 8, 0.95, "merge"), (3, None, None, "create")], "new_id int, match_id int, score double, action string")
    asked = vectors.review_questions(resolved, "task", F.lit(dt.datetime(2020, 1, 1)))
    assert rows(asked, "entity_id", "question", "status") == [("1", "same as 7?", "open")] and asked.first().options == ["merge", "create"]
    named = spark.createDataFrame([("n", " ", "i", "o")], "name string, description string, instruction string, org_unit string")
    kinds = {k: vectors.type_text(k, {}) for k in ("task", "role", "process")}
    assert named.select(*[c.alias(k) for k, c in kinds.items()]).first().asDict() == {"task": "n i", "role": "n o", "process": "n"}


def test_runtime_form_and_first_of_two_sources(spark):
    nodes = spark.createDataFrame([("Activity", "Task"), ("Gateway", "ExclusiveGateway"), ("Event", "EndEvent")], "element_type string, type string")
    assert rows(flows.runtime_types(nodes), "type") == [("endEvent",), ("exclusiveGateway",), ("userTask",)]
    have = spark.createDataFrame([("p", "a", "kept")], "proc_id string, id string, name string")
    more = spark.createDataFrame([("p", "a", "derived"), ("p", "b", "derived")], "proc_id string, id string, name string")
    assert rows(flows.union_first(have, more, ["proc_id", "id"])) == [("p", "a", "kept"), ("p", "b", "derived")]


def test_agents_profiles_and_activities(spark):
    agents = spark.createDataFrame([("a1", "Ann", "x" * 300), ("a2", "Bob", None)], "agent_id string, username string, goal string")
    short = {r.agent_id: r.goal for r in match.shortened(agents).collect()}
    assert short == {"a1": "x" * 180 + "…", "a2": ""}
    roles = spark.createDataFrame([("a1", "Clerk"), ("a1", "Clerk"), ("a1", "Buyer")], "agent_id string, role string")
    told = spark.createDataFrame([("a1", f"t{i:02d}", f"text{i}") for i in range(25)], "agent_id string, activity_id string, text string")
    text = {r.left_id: r.text for r in match.agent_profiles(agents, roles, told).collect()}
    assert text["a1"].startswith("Ann xxx") and "Buyer Clerk text0" in text["a1"] and text["a1"].endswith("text24")
    assert match.agent_profiles(agents, roles, told, 20).where("left_id = 'a1'").first().text.endswith("text19")
    hints = spark.createDataFrame([("r1", "user", "a1", True), ("r2", "user", "u", False), ("r3", "team", "t", False)], "role_id string, kind string, target_id string, is_agent boolean")
    tasks = spark.createDataFrame([("t1", "r1"), ("t2", "r2"), ("t3", None)], "task_id string, role_id string")
    assert {r.task_id: r.agent_id for r in match.activity_agents(tasks, hints).collect()} == {"t1": "a1", "t2": None, "t3": None}


def test_decision_lines_and_merges_without_content(spark):
    table = spark.createDataFrame([("d", 1, "name", "w", "t", 0.5)], "decision_id string, rule_no int, name string, when string, then string, confidence double")
    assert artifacts.decision_json(table).first().value == '{"name":"name","when":"w","then":"t","confidence":0.5}'
    mapping = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a")], "old_id string, new_id string")
    sigs = spark.createDataFrame([("a", [], []), ("b", [], []), ("c", ["x"], [])], "proc_id string, task_tokens array<string>, role_tokens array<string>")
    assert rows(artifacts.bare_merges(mapping, sigs)) == [("b", "a")]
