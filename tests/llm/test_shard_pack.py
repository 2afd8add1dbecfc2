import math
import random
import zlib

import numpy as np
import pytest

from procweave.llm import pack, shard
from procweave.llm.common import identified


def test_matrix_has_exact_sums():
    sizes, columns = [7, 0, 13, 1, 30, 9], shard.even_sizes(60, 7)
    rows = [shard.matrix_row(sizes, columns, p, seed=5) for p in range(len(sizes))]
    assert [sum(r) for r in rows] == sizes and [sum(c) for c in zip(*rows)] == columns
    assert rows != [shard.matrix_row(sizes, columns, p, seed=6) for p in range(len(sizes))]


def test_matrix_entries_are_hypergeometric():
    draws = np.array([shard.matrix_row([40, 60], [30, 70], 0, s)[0] for s in range(4000)])
    assert abs(draws.mean() - 12) < 0.2 and abs(draws.std() - math.sqrt(40 * 0.3 * 0.7 * 60 / 99)) < 0.1


def test_large_populations_follow_the_same_law(monkeypatch):
    rng = np.random.default_rng(1)
    want = rng.hypergeometric(300, 700, 100, 40_000)
    monkeypatch.setattr(shard, "NUMPY_LIMIT", 0)
    got = np.array([shard.hypergeometric(rng, 300, 700, 100) for _ in range(40_000)])
    assert abs(got.mean() - want.mean()) < 0.12 and abs(got.std() - want.std()) < 0.08
    big = [shard.hypergeometric(rng, 6 * 10**11, 4 * 10**11, 10**9) for _ in range(200)]
    assert abs(np.mean(big) - 6e8) < 6 * math.sqrt(2.4e8 / 200)


@pytest.mark.parametrize("block_rows", [3, 100_000])
@pytest.mark.parametrize("table", ["odd", "repeated"])
def test_shards_hold_every_row_once(request, table, block_rows):
    docs = request.getfixturevalue(table)
    got = shard.shard(docs, 4, seed=2, block_rows=block_rows).collect()
    slots = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(4)}
    assert all(v == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["text"] or "")
    assert sorted(map(key, got)) == sorted(map(key, docs.collect()))


def test_order_is_uniform(write):
    """Over many seeds each row is equally often in each place."""
    docs = write([(i, "x", "en", "s") for i in range(6)], 2)
    seen = np.zeros((6, 6))
    for seed in range(60):
        for r in shard.shard(docs.select("doc_id"), 2, seed).collect():
            seen[r["doc_id"], r["shard"] * 3 + r["slot"]] += 1
    assert ((seen - 10) ** 2 / 10).sum() < 60


def test_empty_shards(empty, write):
    assert shard.shard(empty).count() == 0
    one = shard.shard(write([(1, None, None, None)], 1), 40).collect()
    assert len(one) == 1 and one[0]["slot"] == 0


def test_query_columns(spark, tmp_path):
    docs = [(1, "é"), (2, None), (3, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in shard.op1_hypergeometric_sharding(spark, str(tmp_path)).collect()}
    assert {i: (r["size"], r["text_crc32"]) for i, r in got.items()} == {1: (18, zlib.crc32("é".encode())), 2: (16, 0), 3: (16, 0)}


def slow_best_fit(sizes, sources, clusters, capacity):
    """Try every bin: the fullest with room and without conflict, the earliest among equals."""
    free, held, bins, offsets = [], [], [], []
    for size, s, c in zip(sizes, sources, clusters):
        fit = [b for b in range(len(free)) if free[b] >= size and (s is None or s not in held[b][0]) and (c is None or c not in held[b][1])]
        b = min(fit, key=lambda b: (free[b], b), default=None)
        if b is None:
            b = len(free)
            free.append(capacity)
            held.append((set(), set()))
        bins.append(b)
        offsets.append(capacity - free[b])
        free[b] -= size
        held[b][0].add(s)
        held[b][1].add(c)
    return bins, offsets


def test_best_fit_equals_brute_force():
    rng = random.Random(0)
    for _ in range(60):
        n = rng.randrange(0, 80)
        sizes = sorted((rng.randrange(1, 50) for _ in range(n)), reverse=True)
        sources = [rng.choice([None, "hot", "hot", *"abcdefgh"]) for _ in range(n)]
        clusters = [rng.choice([None, *range(20)]) for _ in range(n)]
        assert pack.best_fit(sizes, sources, clusters, 50) == slow_best_fit(sizes, sources, clusters, 50)


@pytest.mark.parametrize("group_rows", [5, 4096])
@pytest.mark.parametrize("table", ["odd", "repeated"])
def test_packing_is_whole_and_free_of_conflicts(request, table, group_rows):
    docs = request.getfixturevalue(table)
    facts = {r["__r"]: r for r in identified(docs, "__r").select("__r", "doc_id", "text", "source").collect()}
    got = pack.pack(docs, capacity=64, group_rows=group_rows).collect()
    bins, pieces = {}, {}
    for r in got:
        pieces.setdefault(r["rid"], []).append(r)
        if r["bin_id"] is not None:
            bins.setdefault(r["bin_id"], []).append(r)
    assert set(pieces) == set(facts)
    for rid, rows in pieces.items():
        rows.sort(key=lambda r: r["piece"])
        n = len((facts[rid]["text"] or "").encode().split())
        assert [r["first_word"] for r in rows] == [64 * i for i in range(len(rows))] and sum(r["n_words"] for r in rows) == n
        assert (n == 0) == (rows[0]["bin_id"] is None)
    for rows in bins.values():
        rows.sort(key=lambda r: r["place"])
        assert [r["place"] for r in rows] == [sum(x["n_words"] for x in rows[:i]) for i in range(len(rows))] and sum(r["n_words"] for r in rows) <= 64
        for what in ("source", "text"):
            values = [facts[r["rid"]][what] for r in rows if facts[r["rid"]][what] is not None]
            assert len(values) == len(set(values))


def test_bin_texts(odd):
    packed = pack.pack(odd, capacity=64)
    texts = {r["bin_id"]: r["text"].encode().split() for r in pack.bin_texts(odd, packed).collect()}
    sizes = {r[0]: r[1] for r in packed.filter("bin_id IS NOT NULL").groupBy("bin_id").sum("n_words").collect()}
    assert {b: len(t) for b, t in texts.items()} == sizes


def test_empty_packing(empty):
    assert pack.pack(empty).count() == 0
