"""Row numbers that hold while the cluster changes, and fingerprints on words made to collide."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from procweave.llm import common, conversations, decontaminate, fingerprints, language_model, near_dedup, pack, resample, substring_dedup, suffix_dedup, windows
from procweave.llm.common import identified, numbered, stable


@pytest.fixture
def parallel(spark):
    """Sets how many tasks a scan is split for, as executors that come and go do."""

    def put(n):
        spark.conf.set("spark.sql.files.minPartitionNum", str(n))
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1" if n > 1 else "4m")

    yield put
    for name in ("spark.sql.files.minPartitionNum", "spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(name)


def numbers(df):
    return sorted(((r["n_"], r["doc_id"], r["text"]) for r in identified(df, "n_").select("n_", "doc_id", "text").collect()), key=repr)


def test_numbers_do_not_follow_the_splits(spark, odd, parallel):
    parallel(1)
    before = numbers(odd)
    plain = [r[0] for r in odd.select(F.monotonically_increasing_id(), "doc_id").sort("doc_id").collect()]
    parallel(64)
    assert numbers(odd) == before and len({n for n, _, _ in before}) == len(before)
    assert [r[0] for r in odd.select(F.monotonically_increasing_id(), "doc_id").sort("doc_id").collect()] != plain
    # A filter keeps the numbers; rows that are no scan are written once.
    some = numbers(odd.filter("doc_id % 2 = 0"))
    assert some == [r for r in before if r[1] % 2 == 0]
    shuffled = stable(odd.repartition(7))
    assert numbers(shuffled) == numbers(shuffled)
    hidden = odd.withColumn("_metadata", F.lit(1)).withColumn("path", F.lit("x"))
    assert len(numbers(hidden)) == len(before) and numbered(hidden, "doc_id").columns == ["rid", "doc_id"]


OPERATORS = {
    "op3": lambda d, b: language_model.fit_and_score(d, F.col("doc_id") % 10 == 0).select("doc_id", "held_out", "n_tokens", "n_known"),
    "op4": lambda d, b: suffix_dedup.dedup_bytes(d).drop("rid"),
    "op4 texts": lambda d, b: suffix_dedup.dedup_texts(d).select("doc_id", "text"),
    "op6": lambda d, b: decontaminate.report(d, b).drop("rid"),
    "op6 drop": lambda d, b: decontaminate.drop_contaminated(d, b).select("doc_id"),
    "op8": lambda d, b: substring_dedup.dedup_words(d).drop("rid"),
    "op10": lambda d, b: near_dedup.near_duplicates(d).drop("rid"),
    "op10 drop": lambda d, b: near_dedup.drop_near_duplicates(d).select("doc_id"),
    "op11": lambda d, b: resample.resample(d, b, percent=50).drop("rid"),
    "op13": lambda d, b: fingerprints.edit_test(d),
    "bins": lambda d, b: pack.bin_texts(d, pack.pack(d, group_rows=10**6)).select("text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_results_do_not_follow_the_splits(spark, odd, parallel, monkeypatch, name):
    """The parallelism changes at every table that is written, as on a cluster that grows and shrinks under the query."""
    bench = odd.filter("doc_id IN (12, 14)").select(F.col("doc_id").alias("item_id"), "text")
    rows = lambda: sorted(map(repr, OPERATORS[name](odd, bench).collect()))
    parallel(1)
    want = rows()
    settle, turn = common.settle, iter(range(10**6))

    def changing(df):
        out = settle(df)
        parallel((1, 16, 64)[next(turn) % 3])
        return out

    for module in (common, windows, near_dedup, language_model, decontaminate, resample, fingerprints, pack, conversations, substring_dedup, suffix_dedup):
        if hasattr(module, "settle"):
            monkeypatch.setattr(module, "settle", changing)
    parallel(64)
    assert rows() == want


def thue_morse(n, flip=False):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


A, B = thue_morse(1024), thue_morse(1024, True)


def test_words_and_runs_made_to_collide_in_sums_of_powers():
    values, _ = windows.symbols([f"{A} {B}".encode()], words=True)
    assert values[0] != values[1]
    data = np.frombuffer((A + B).encode(), np.uint8)
    prints = windows.grams(data, 1024)
    assert prints[0] != prints[1024] and len(np.unique(prints)) == len(prints)
    assert (windows.grams(np.frombuffer((A + A).encode(), np.uint8), 1024)[[0, 1024]] == prints[0]).all()
    # Words that differ in a zero byte or behind the part that is hashed for all at once.
    odd = [b"a", b"a\0", b"x" * 300 + b"a", b"x" * 300 + b"b", b"x" * 8, b"x" * 16]
    values, _ = windows.symbols([b" ".join(odd)], words=True)
    assert len(set(values.tolist())) == len(odd)


def test_operators_tell_such_words_apart(spark, write):
    rest = " ".join(f"w{i}" for i in range(12))
    rest2 = " ".join(f"v{i}" for i in range(10))
    docs = write([(1, f"{rest} {A} {rest2}", "en", "s"), (2, f"{rest} {B} {rest2}", "en", "s"), (3, A, "en", "s"), (4, B, "en", "s"), (5, A, "en", "s")])
    gone = {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup_words(docs).collect()}
    assert gone == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0}
    groups = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert groups[3] == groups[5] == 3 and groups[4] == 4
    kept = {r["doc_id"]: r["kept_sha256"] for r in suffix_dedup.dedup_bytes(docs, 1000).collect()}
    assert kept[4] == hashlib.sha256(b"").hexdigest() == kept[3]
    known = {r["doc_id"]: r["n_known"] for r in language_model.fit_and_score(docs.filter("doc_id IN (3, 4)"), F.col("doc_id") == 4).collect()}
    assert known == {3: 2, 4: 1}
