import json

from procweave.functions import text
from procweave.operators import candidates as c


def _parsed(spark, *payloads):
    rows = [(f"s{i}", "doc", i, p if isinstance(p, str) else json.dumps(p, ensure_ascii=False)) for i, p in enumerate(payloads)]
    return c.parse_candidates(spark.createDataFrame(rows, "section_id string, scope string, section_no long, payload string"))


FIRST = {
    "processes": [{"name": "Buying", "description": "how to buy"}],
    "roles": [{"name": "Buyer"}, {"name": "buyer"}, {"name": "Chief", "description": "signs"}],
    "tasks": [
        {"name": "Ask", "order": 2, "performer_role": "BUYER", "task_type": "robot"},
        {"name": "Ask twice", "order": "1.9", "performer_role": "ghost", "next_task": "pay"},
        {"name": "Pay", "order": "junk", "task_type": "AGENT", "parent_process": "nowhere"},
        {"order": None},
    ],
    "task_role_mappings": [{"task_name": "", "role_name": "chief"}, {"task_name": "pay", "role_name": "Chief"}],
    "decisions": [{"name": "Limit"}, {"name": "Other"}],
    "rules": [{"decision": "OTHER", "condition": "c", "result": "r"}, {"when": "w", "then": "t"}, {"decision_id": "given", "when": "w", "confidence": 0.2}],
    "sequence_flows": [
        {"from_task": "ask", "to_task": "pay", "condition": "조건 1"}, {"from_task": "Ask", "to_task": "Ask twice", "condition": "twice"},
        {"from_task": "nobody knows", "to_task": "pay"},
    ],
}


def test_tables_of_a_payload(spark):
    parsed = _parsed(spark, FIRST, "{ broken", {"tasks": [{"name": "Late", "parent_process": "buying", "performer_role": "chief"}]})
    processes, roles = c.to_processes(parsed), c.to_roles(parsed)
    assert sorted(r.name for r in roles.collect()) == ["Buyer", "Chief"]
    tasks = {r.name: r for r in c.to_tasks(parsed, processes).collect()}
    assert [(tasks[n].order, tasks[n].task_type) for n in ("Ask", "Ask twice", "Pay", "Task 4")] == [(2, "human"), (1, "human"), (2, "agent"), (3, "human")]
    proc = processes.first().proc_id
    assert {t.process_id for t in tasks.values()} == {proc}  # own section, first of section, and by name from a later one
    all_tasks = c.to_tasks(parsed, processes)
    performers = c.apply_task_role_mappings(parsed, all_tasks, roles, c.link_performer(all_tasks, roles))
    names = {r.role_id: r.name for r in roles.collect()}
    got = {r.task_id: names[r.role_id] for r in performers.collect()}
    assert got == {tasks["Ask"].task_id: "Buyer", tasks["Pay"].task_id: "Chief", tasks["Late"].task_id: "Chief"}


def test_rules_find_their_decision(spark):
    parsed = _parsed(spark, FIRST)
    decisions, _ = c.to_decisions(parsed, c.to_roles(parsed))
    ids = {r.name: r.decision_id for r in decisions.collect()}
    rules = c.to_rules(parsed, decisions).orderBy("pos").collect()
    assert [(r.decision_id, r.when, r.then, r.confidence) for r in rules] == [(ids["Other"], "c", "r", 1.0), (ids["Limit"], "w", "t", 1.0), ("given", "w", "", 0.2)]


def test_flows_and_synthetic_gateway(spark):
    out = c.convert(spark.createDataFrame([("s", "d", 0, json.dumps(FIRST, ensure_ascii=False))], "section_id string, scope string, section_no long, payload string"))
    names = {r.task_id: r.name for r in out["task"].collect()}
    gates = {r.gateway_id: r.name for r in out["gateway"].collect()}
    assert list(gates.values()) == ["ask 여부 판단"]
    label = {**names, **gates}
    flows = {(label[r.from_id], label[r.to_id], r.condition) for r in out["flow"].collect()}
    # The placeholder was blank before the rewrite, so that flow stays and the gateway carries its own text.
    assert ("Ask", "ask 여부 판단", "") in flows and ("ask 여부 판단", "Ask twice", "twice") in flows
    assert ("ask 여부 판단", "Pay", "조건 (자동 보강)인 경우") in flows and ("Ask twice", "Pay", "") in flows


def test_names_of_a_section_are_compared_once(spark):
    """Both ends of the flows read one table of found names; only conditional flows of a fork to tasks give way."""
    parsed = _parsed(spark, FIRST)
    tasks, gateways = c.to_tasks(parsed, c.to_processes(parsed)), c.to_gateways(parsed, c.to_processes(parsed))
    flows = c.resolve_flow_ends(parsed, tasks, gateways)
    assert "contains(" not in flows._jdf.queryExecution().optimizedPlan().toString().lower()
    marked = spark.createDataFrame([("s0", "doc", 0, i, "task", f, k, t, x) for i, (f, k, t, x) in enumerate([("a", "task", "b", "x"), ("a", "task", "c", ""), ("b", "gateway", "g", "y")])], flows.schema)
    rewritten = c.synthesize_gateways(parsed, tasks, gateways, marked)[1]
    assert {("a", "b"), ("a", "c"), ("b", "g")} <= {(x.from_id, x.to_id) for x in rewritten.collect()}


def test_json_column_readings(spark):
    raw = ['{"a": 1}', "text ```json\n{\"a\": 1}\n``` more", "so {\"a\":\n 1} done", "none", None]
    df = spark.createDataFrame([(x,) for x in raw], "t string")
    got = [r[0] for r in df.select(c.clean_json_column("t")).collect()]
    assert [json.loads(x)["a"] if x else None for x in got] == [1, 1, 1, None, None]


def test_gateway_names(spark):
    rows = [("gateway 2", "금액이 큰지 확인", 1), ("분기", "", 3), ("Real name", "", 1), ("", "승인인지 여부를 본다", 1)]
    df = spark.createDataFrame(rows, "name string, description string, n int")
    named = text.with_gateway_name(df, "out", df.name, df.description, df.n)
    assert [r.out for r in named.collect()] == ["금액이 큰지 여부 판단", "의사결정 분기 3", "Real name", "승인 여부 판단"]


def test_procedure_steps_equal_plain_python(spark):
    import re

    def plain(t, most=None, cut=None):
        if not t:
            return ["작업을 수행합니다."]
        for pattern in (r"\d+[.)\s]+(.+?)(?=\d+[.)\s]|$)", r"[-•]\s*(.+?)(?=[-•]|$)"):
            found = re.findall(pattern, t)
            if found:
                return [s.strip() for s in found if s.strip()]
        steps = [s.strip() for s in re.split(r"[.。]\s*", t) if s.strip() and len(s) > 5]
        return steps[:most] or [t[:cut] + "..." if cut and len(t) > cut else t]

    texts = ["1. open it 2) close it", "- one thing - other", "First thing here. Second。 Third thing too", "short", "", ". " * 150, "One sentence. " * 25]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(text.procedure_steps("t")).collect()] == [plain(t) for t in texts]
    assert [r[0] for r in df.select(text.procedure_steps("t", 10, 200)).collect()] == [plain(t, 10, 200) for t in texts]


def test_whole_run_keeps_equal_chunks_apart_and_merges_entities(spark):
    """Two documents with the same text: two chunks, one process, one role, one task, all referred to by their kept ids."""
    from procweave.operators import candidates as c
    from procweave.plans.pipeline import document_graph

    text = "Process of claims\nTask check the claim by Role clerk\nRole clerk\n" + "filler line of text\n" * 10
    docs = spark.createDataFrame([("a", [(1, text)]), ("b", [(1, text)])], "doc_id string, pages array<struct<page:int,text:string>>")
    patterns = [("process", r"^Process", 0.9), ("task", r"^Task", 0.9), ("role", r"^Role", 0.9)]
    g = document_graph(docs, lambda t: c.default_payload(c.pattern_candidates(t, patterns)))
    assert g["chunk"].count() == 2 and g["chunk"].select("chunk_id").distinct().count() == 2
    assert [g[k].count() for k in ("process", "role", "task")] == [1, 1, 1]
    ids = {r[0] for k, key in (("process", "proc_id"), ("role", "role_id"), ("task", "task_id")) for r in g[k].select(key).collect()}
    edges = g["edges"].collect()
    assert {(e.rel, e.src_id in ids) for e in edges if e.rel == "SUPPORTED_BY"} == {("SUPPORTED_BY", True)}
    assert {e.dst_id for e in edges if e.rel == "SUPPORTED_BY"} == {r.chunk_id for r in g["chunk"].collect()}
    assert {e.rel for e in edges} >= {"HAS_TASK", "PERFORMED_BY"} and g["coverage"].first().n_with_role == 1
