import hashlib
import re

import pytest

from procweave.llm import decontaminate
from procweave.llm.common import identified

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, n=10):
    wins = {}
    for item, text in items:
        ws = split(text)
        for i in range(max(1, len(ws) - n + 1) if ws else 0):
            wins.setdefault(tuple(ws[i : i + n]), set()).add(item)
    out = []
    for t in docs:
        ws, hit, found = split(t), set(), set()
        for size in {len(w) for w in wins}:
            for i in range(len(ws) - size + 1):
                if w := wins.get(tuple(ws[i : i + size])):
                    hit.update(range(i, i + size))
                    found |= w
        out.append((len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return out


@pytest.fixture(scope="module")
def bench(spark, odd, tmp_path_factory):
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    items = [(1, texts[12]), (2, " ".join(texts[7].split()[20:45])), (3, "one two THREE"), (4, None), (5, ""), (6, "w1"), (7, texts[12]), (12, "Ünïcödé"), (13, "ünïcödé"), (14, " ".join(texts[17].split()[-30:]))]
    path = str(tmp_path_factory.mktemp("bench") / "benchmark.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(path)
    return spark.read.parquet(path), items


@pytest.mark.parametrize("options", [{}, {"max_set": 2}, {"max_broadcast": 1}])
@pytest.mark.parametrize("table", ["odd", "repeated"])
def test_equal_to_brute_force(request, table, bench, options):
    docs = request.getfixturevalue(table)
    rows = {r["__r"]: r["text"] for r in identified(docs, "__r").select("__r", "text").collect()}
    want = dict(zip(rows, brute(rows.values(), bench[1])))
    got = {r["rid"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.report(docs, bench[0], **options).collect()}
    assert got == want


def test_documents_and_spans(odd, bench):
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    dirty = {i for i, r in zip(texts, brute(texts.values(), bench[1])) if r[4]}
    kept = decontaminate.drop_contaminated(odd, bench[0])
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == set(texts) - dirty
    cut = {r["doc_id"]: r["text"] for r in decontaminate.cut_spans(odd, bench[0]).collect()}
    assert cut[12] == "" and cut[0] is None and all(cut[i] == texts[i] for i in set(texts) - dirty)


def test_empty(odd, empty, bench):
    assert decontaminate.report(empty, bench[0]).count() == 0
    none = bench[0].filter("item_id < 0")
    assert not decontaminate.report(odd, none).filter("contaminated OR n_items > 0").count()


def test_plan_has_no_python(odd, bench):
    plan = decontaminate.report(odd, bench[0])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
