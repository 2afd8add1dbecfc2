import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from procweave.operators.contain import anchors, contained_in
from procweave.operators.ordered import scan


def test_sliced_scan_equals_plain_scan(spark):
    """A key with most of the rows is cut into slices; every value must stay the same."""
    rng = random.Random(3)
    rows = []
    for key, n in (("hot", 400), ("warm", 40), ("one", 1), (None, 60)):
        for i in range(n):
            rows.append((key, rng.randrange(50), i, rng.choice([None, "a", "b", "c"]), rng.randrange(5)))
    df = spark.createDataFrame(rows, "k string, t int, i int, v string, x int")
    args = dict(
        number="n", lead={"nv": "v"}, lag={"pv": "v"}, running={"s": F.col("x")}, last_seen={"ls": F.col("v")}, next_seen={"ns": F.col("v")}
    )
    plain = scan(df, ["k"], ["t", "i"], **args)
    sliced = scan(df, ["k"], ["t", "i"], slice_rows=30, **args)
    assert plain.columns == sliced.columns
    assert sorted(map(str, plain.collect())) == sorted(map(str, sliced.collect()))


def test_containment_join_equals_brute_force(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abc 가") for _ in range(n))
    texts = [(i, word(rng.randrange(0, 30))) for i in range(60)]
    names = [(i, word(rng.randrange(0, 6))) for i in range(60)]
    t, n = spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame(names, "name_id int, keyword string")
    want = {(a, b) for a, x in texts for b, y in names if y and y in x}
    assert {(r.text_id, r.name_id) for r in contained_in(t, n).collect()} == want
    by = lambda d, c: d.withColumn("g", F.col(c) % 3)
    got = {(r.text_id, r.name_id) for r in contained_in(by(t, "text_id"), by(n, "name_id"), by=["g"]).collect()}
    assert got == {(a, b) for a, b in want if a % 3 == b % 3}
    assert contained_in(t, n.where("name_id < 0")).count() == 0


def test_names_that_begin_alike_are_filed_apart(spark):
    names = spark.range(1, 20_001).select(F.concat(F.lit("user "), F.col("id").cast("string")).alias("keyword"))
    filed = anchors(names).groupBy("window").count()
    # One and two digits have short windows; all others stand alone.
    assert filed.agg(F.max("count")).first()[0] <= 3 and filed.count() > 19_000
    long = spark.createDataFrame([("the same long beginning of a name " + c,) for c in "abcdef"], "keyword string")
    assert anchors(long).groupBy("window").count().agg(F.max("count")).first()[0] == 1


def test_short_names_are_filed_as_wholes(spark):
    """Names of like digits share no window, and only windows of texts that a name may have are rows."""
    from procweave.operators import contain

    names = spark.range(5_000).select(F.format_string("t%06d", "id").alias("keyword"))
    assert anchors(names).groupBy("window").count().agg(F.max("count")).first()[0] == 1
    bitmap = contain._bitmap(contain._filed(names.where("keyword = 't000042'"), []))
    texts = pa.array(["x" * 50 + "t000042" + "y" * 50, None, "t00004", "가t000042가t000042"])
    row, _ = contain._hits(texts, np.zeros(4, np.uint64), [7], bitmap)
    assert sorted(row.tolist()) == [0, 3]


def test_containment_join_reads_long_names_and_texts(spark, monkeypatch):
    """Long names, texts larger than what is rolled at once, and null texts, against plain Python."""
    from procweave.operators import contain

    monkeypatch.setattr(contain, "BYTES", 64)
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("ab가") for _ in range(n))
    texts = [(f"t{i}", word(rng.randrange(0, 300))) for i in range(40)] + [("none", None)]
    names = [(i, word(rng.randrange(1, 30))) for i in range(40)] + [(100 + i, texts[i][1][20 : 20 + 13 * i]) for i in range(20)] + [(200, None), (201, "")]
    got = contained_in(spark.createDataFrame(texts, "text_id string, text string"), spark.createDataFrame(names, "name_id int, keyword string"), shortest=3)
    want = {(a, b) for a, x in texts for b, y in names if x and y and len(y) >= 3 and y in x}
    assert {(r.text_id, r.name_id) for r in got.collect()} == want and len(want) > 20 and got.count() == len(want)
