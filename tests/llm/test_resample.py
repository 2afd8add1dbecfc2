import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from procweave.llm import resample
from tests.llm.conftest import words as make

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    ws = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return len(ws), [zlib.crc32(" ".join(ws[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(ws) - n + 1)]


def brute(rows, target, least=20, percent=5):
    """rows: (place, id, text) in order; per place the contract's columns."""
    s, t = np.zeros(10_000), np.zeros(10_000)
    found = [features(text) for _, _, text in rows]
    for _, f in found:
        np.add.at(s, f, 1)
    for text in target:
        np.add.at(t, features(text)[1], 1)
    S, T = s.sum(), t.sum()
    gain = [math.floor(1000 * math.log((b + 1) * (S + 10_000) / ((a + 1) * (T + 10_000)))) for a, b in zip(s, t)]
    out, eligible = {}, []
    for (place, i, _), (n, f) in zip(rows, found):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[place] = [i, n, len(f), weight, score, None]
        if n >= least:
            eligible.append((-score, i is None, i or 0, place))
    for rank, (*_, place) in enumerate(sorted(eligible)[: percent * len(eligible) // 100], 1):
        out[place][-1] = rank
    return out


def rows_of(docs):
    from procweave.llm.common import identified

    return sorted(((r["r_"], r["doc_id"], r["text"]) for r in identified(docs, "r_").select("r_", "doc_id", "text").collect()))


@pytest.fixture(scope="module")
def target(spark, odd, tmp_path_factory):
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    return [texts[12], None, "", "one two THREE", texts[20], "Ünïcödé und SO"]


def frame(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


@pytest.mark.parametrize("table", ["odd", "repeated"])
def test_equal_to_brute_force(request, spark, table, target):
    docs = request.getfixturevalue(table)
    want = brute(rows_of(docs), target, percent=30)
    got = {r["rid"]: [r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]] for r in resample.resample(docs, frame(spark, target), percent=30).collect()}
    assert got == want


def test_head_changes_no_bucket():
    """The same buckets with an empty head and with one of frequent words and pairs, long words and bytes outside ASCII."""
    rng = random.Random(4)
    texts = [make(rng, 300, 50).encode(), ("ab" * 40 + " x " + "q" * 200 + " é ß").encode(), b"", b"-- !!", b"one", "Ärger UND Maß".encode()]
    words = resample.Words(texts, [len(t) for t in texts])
    each = [words.word(i) for i in range(len(words))]
    pairs = sorted({(a, b) for a, b in zip(each, each[1:]) if len(a) <= 16 and len(b) <= 16})
    with_head = resample.Head(sorted({w for w in each if len(w) <= 16}), pairs, 10_000)
    assert (with_head.pairs >= 0).sum() > 100
    for (a, x), (b, y) in zip(resample.Head([], [], 10_000).features(words), with_head.features(words)):
        assert (a == b).all() and (x == y).all()
    found = np.concatenate([x for _, x in with_head.features(words)])
    assert sorted(found) == sorted(b for t in texts for b in features(t.decode())[1])


def test_long_texts_are_cut_without_loss(monkeypatch):
    monkeypatch.setattr(resample, "STEP", 64)
    rng = random.Random(2)
    texts = [make(rng, 400).encode(), b"x" * 500, b"y" * 500 + b" a b c", b" " * 300 + b"tail"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["text"])
    head = resample.Head([], [], 10_000)
    found = [b for _, _, words in resample.parts(iter([batch])) for _, buckets in head.features(words) for b in buckets]
    assert sorted(found) == sorted(b for t in texts for b in features(t.decode())[1])


def test_ties_draw_and_empty(spark, write, empty, target):
    docs = write([(i // 2, "same words " * 15, "en", "s") for i in range(40)])
    got = sorted((r["rank"], r["doc_id"]) for r in resample.resample(docs, frame(spark, target), percent=50).filter("rank IS NOT NULL").collect())
    want = sorted((v[-1], v[0]) for v in brute(rows_of(docs), target, percent=50).values() if v[-1])
    assert got == want and [r for r, _ in got] == list(range(1, 21))
    drawn = resample.draw(docs, frame(spark, target), percent=50)
    assert drawn.columns == docs.columns and drawn.count() == 20
    assert resample.resample(empty, frame(spark, target)).count() == 0
    assert resample.resample(docs, frame(spark, [])).count() == 40
    frames = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    assert resample.draw(frames, frame(spark, []), percent=100, least_words=0).count() == 2
