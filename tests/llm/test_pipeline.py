import random

import corpus_pipeline
from procweave.llm.common import settle
from tests.llm.conftest import words
from tests.llm.test_decontaminate import brute as find_leaks
from tests.llm.test_near_dedup import brute as group
from tests.llm.test_repeats import by_bytes


def planted(seed=4):
    rng = random.Random(seed)
    passage, item = words(rng, 70), words(rng, 25)
    texts = [words(rng, rng.randrange(20, 200)) for _ in range(40)]
    near = texts[3].split()
    near[2] = "other"
    texts += [texts[3], " ".join(near), texts[5] + " " + passage, passage + " " + texts[6], words(rng, 30) + " " + item + " " + words(rng, 30), "12 34 --", "", None, words(rng, 9000, 10**6)]
    rows = [(i, t, "en" if i % 4 else None, f"s{i % 3}") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows, [(7, item), (8, words(rng, 12, 3000))]


def test_stages_equal_brute_force(spark, write, tmp_path):
    rows, items = planted()
    docs = write(rows)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = {i: t for i, t, *_ in rows}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = settle(stage(spark, docs, str(tmp_path)))
        if name == "packing":
            break
        assert out.columns == columns
        got = {r["doc_id"]: r for r in out.collect()}
        if name == "language":
            now = {i: t for i, t in now.items() if t and any(c.isalpha() for c in t)}
            assert all(r["lang"] == "en" for r in got.values())
        elif name == "near_duplicates":
            ordered = sorted(now.items())
            _, heads = group([(i, i, t) for i, t in ordered])
            now = {i: t for n, (i, t) in enumerate(ordered) if heads[n] == n}
            assert 40 not in now and 41 not in now
        elif name == "repeats":
            ordered = sorted(now.items())
            want = dict(zip([i for i, _ in ordered], by_bytes([t.encode() for _, t in ordered], 200, True)))
            assert {i: len(now[i].encode()) - len(r["text"].encode()) >= want[i][1] for i, r in got.items()} == dict.fromkeys(now, True)
            assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and want[43][1] > 0
            now = {i: r["text"] for i, r in got.items()}
        elif name == "decontamination":
            dirty = {i for i, leak in zip(now, find_leaks(now.values(), items)) if leak[4]}
            now = {i: t for i, t in now.items() if i not in dirty}
            assert dirty == {44}
        assert {i: r["text"] for i, r in got.items()} == now
        docs = out
    pieces = {}
    for r in out.collect():
        pieces[r["doc_id"]] = pieces.get(r["doc_id"], 0) + r["n_words"]
    assert pieces == {i: len(t.encode().split()) for i, t in now.items()}


def test_run_applies_the_stages(spark, write, tmp_path):
    rows, items = planted(5)
    write(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i for i, *_ in rows} - got == {40, 41, 44, 45, 46, 47}


def test_empty_tables(spark, empty, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
