import random

import pytest
from pyspark.sql import types as T

#: Columns whose names operators use inside.
CLASHING = ["rid", "ord", "id", "key", "m", "k", "p", "n", "shard", "slot", "text_crc32", "lang_pred", "score", "bin_id", "spans", "near", "block", "place", "row", "cut", "kept", "copy", "hit", "bytes", "letters"]
DOCUMENT = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASHING]
)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}é" if rng.random() < 0.1 else f"w{rng.randrange(size)}" for _ in range(n))


def odd_rows(seed=0):
    """Ids with texts: nulls, empties, blanks, repeated rows, ties, a very long text, shared passages, near copies, periods."""
    rng = random.Random(seed)
    passage = words(rng, 60)
    base = words(rng, 120)
    near = base.split()
    near[5] = "CHANGED"
    long = words(rng, 30_000, 10**6)
    texts = [
        None, "", "   \t\n ", "123 456 !!", "one", "One two three", "one TWO three", base, base, " ".join(near), base.upper(),
        words(rng, 30) + " " + passage + " " + words(rng, 30), passage, words(rng, 10) + "\n" + passage, "ab " * 400, "ab " * 300, "x" * 3000, long,
        words(rng, 50) + long[-3000:], "Ünïcödé " + passage[:250] + "ß", *[words(rng, rng.randrange(1, 80)) for _ in range(30)],
    ]
    rows = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else f"s{i % 2}") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def write(spark, tmp_path_factory):
    """Rows (doc_id, text, lang, source) as a stored table with clashing extra columns."""

    def put(rows, parts=3):
        path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
        full = [(*r, None if r[1] is None else len(r[1]), *["clash"] * len(CLASHING)) for r in rows]
        spark.createDataFrame(full, DOCUMENT).repartition(parts).write.parquet(path)
        return spark.read.parquet(path)

    return put


@pytest.fixture(scope="session")
def odd(write):
    return write(odd_rows())


@pytest.fixture(scope="session")
def repeated(write):
    """The same with every row twice and some ids null."""
    rows = [r for r in odd_rows() if r[1] is None or len(r[1]) < 50_000]
    return write(rows + rows + [(None, r[1], r[2], r[3]) for r in rows[:6]])


@pytest.fixture(scope="session")
def empty(write):
    return write([], 1)
