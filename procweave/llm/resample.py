"""Importance resampling of documents towards a target corpus, over hashed word n-grams.

Every run of one to three words is a feature, filed in a bucket by the CRC of its bytes. A CRC can be continued: the state after "a"
carries over to "a b" and "a b c". So the frequent words' exact states and the frequent pairs' buckets and states (the head) are
broadcast and looked up; every other feature (the tail) has its bytes run through the CRC. Which features are in the head costs or
saves time only: both give the same buckets. Counts of all features of both corpora give each bucket a gain, a document's
weight is the sum of the gains of its features, and documents are drawn without replacement by weight plus Gumbel noise.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procweave.llm.common import LOWER, UPPER, bounded, fresh, identified, numbered, settle, table
from procweave.llm.windows import BASE, mix

BUCKETS, LONGEST = 10_000, 3
#: Slots (as powers of two) of the frequent words and pairs; both tables have a few megabytes at every size of the input.
WORD_BITS, PAIR_BITS = 16, 17
#: A word or pair that makes up this share of a corpus does so in at least one part of it, where it is noticed.
SHARE = 1 / (1 << PAIR_BITS)
#: Bytes of text handled at once, and bytes of a word that the head can hold.
STEP, SHORT = 1 << 21, 16
#: Bytes of a feature that are run through the CRC for all features at once; the rest of longer ones is done one by one.
TOGETHER = 64
SPACE, FULL = 0x20, np.uint32(0xFFFFFFFF)

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
LOWERED = np.frombuffer(bytes(range(256)).lower(), np.uint8)
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def crc_table() -> np.ndarray:
    """What eight steps of the CRC-32 of zlib do to each value of the lowest byte."""
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0)) ^ (state >> np.uint32(1))
    return state


TABLE = crc_table()


def carry_on(state: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC states after the bytes ``begin`` to ``end`` of ``data`` have followed on ``state``."""
    sizes = end - begin
    order = np.argsort(-np.minimum(sizes, TOGETHER + 1).astype(np.int16), kind="stable")
    out, at, left = state[order], begin[order], sizes[order]
    falling = -np.minimum(left, TOGETHER + 1)
    for j in range(int(min(left[0], TOGETHER)) if len(left) else 0):
        n = int(np.searchsorted(falling, -j))
        out[:n] = TABLE[(out[:n] ^ data[at[:n] + j]) & np.uint32(0xFF)] ^ (out[:n] >> np.uint32(8))
    for i in range(int(np.searchsorted(falling, -TOGETHER))):
        rest = data[at[i] + TOGETHER : at[i] + left[i]].tobytes()
        out[i] = zlib.crc32(rest, int(out[i] ^ FULL)) ^ 0xFFFFFFFF
    back = np.empty_like(out)
    back[order] = out
    return back


class Words:
    """The lower-cased words of a list of texts, one space after each: ``data``, where words begin and end, their text.

    ``own`` bounds the bytes of each text whose words count; words behind that only complete features.
    """

    def __init__(self, texts: list[bytes], own: list[int]) -> None:
        raw = LOWERED[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
        inside = IN_WORD[raw]
        edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        inside[end] = True
        raw[end] = SPACE
        starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        self.text = np.searchsorted(starts, begin, "right") - 1
        self.own = begin - starts[self.text] < np.array(own, np.int64)[self.text]
        sizes = end - begin
        self.data = np.concatenate((raw[inside], np.zeros(SHORT, np.uint8)))
        self.end = np.cumsum(sizes + 1) - 1
        self.begin = self.end - sizes

    def __len__(self) -> int:
        return len(self.begin)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The first 16 bytes of each word as two numbers; 0 and 0 for longer words."""
        eight = np.ndarray(len(self.data) - 7, "<u8", self.data, strides=(1,))
        size = self.end - self.begin
        first = eight[self.begin] & MASKS[np.minimum(size, 8)]
        second = eight[np.minimum(self.begin + 8, len(eight) - 1)] & MASKS[np.clip(size - 8, 0, 8)]
        short = size <= SHORT
        return np.where(short, first, np.uint64(0)), np.where(short, second, np.uint64(0))

    def word(self, i: int) -> bytes:
        return self.data[self.begin[i] : self.end[i]].tobytes()

    def runs(self, n: int) -> np.ndarray:
        """Words, of those that count, at which a run of ``n`` words of one text begins."""
        at = np.flatnonzero(self.own)
        at = at[at + n <= len(self)]
        return at[self.text[at] == self.text[at + n - 1]]


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, Words]]:
    """Words of parts of bounded size: the batch, the row in it of each text, the words. A long text is cut between words,
    each piece with the words that complete its last features."""
    for batch in bounded(batches, size=STEP):
        rows, texts, own = [], [], []
        for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
            text = text or b""
            at = 0
            while len(text) - at > 2 * STEP:
                gap = re.compile(rb"[^0-9A-Za-z\x80-\xff]").search(text, at + STEP)
                cut = gap.start() if gap else len(text)
                reach = cut
                for m, _ in zip(WORD.finditer(text, cut), range(LONGEST - 1)):
                    reach = m.end()
                yield batch, np.array([i]), Words([text[at:reach]], [cut - at])
                at = cut
            rows.append(i)
            texts.append(text[at:])
            own.append(len(text) - at)
        if texts:
            yield batch, np.array(rows), Words(texts, own)


class Head:
    """Frequent words with their CRC states, frequent pairs with their states and buckets, both in hash slots.

    A slot holds one word (all its bytes, so a match is exact) or one pair of slots; what finds no slot is in the tail.
    """

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]], buckets: int) -> None:
        self.buckets = buckets
        self.first, self.second = (np.zeros(1 << WORD_BITS, np.uint64) for _ in range(2))
        self.states = np.zeros(1 << WORD_BITS, np.uint32)
        self.pairs = np.full(1 << PAIR_BITS, -1, np.int64)
        self.pair_states, self.pair_buckets = np.zeros(1 << PAIR_BITS, np.uint32), np.zeros(1 << PAIR_BITS, np.int32)
        slots = {}
        for word in words:
            keys = [np.array([int.from_bytes(word[i : i + 8], "little")], np.uint64) for i in (0, 8)]
            slot = int(self.slots(*keys)[0])
            if not self.first[slot]:
                self.first[slot], self.second[slot] = keys[0][0], keys[1][0]
                self.states[slot] = zlib.crc32(word) ^ 0xFFFFFFFF
                slots[word] = slot
        for a, b in pairs:
            if a in slots and b in slots:
                key = slots[a] << WORD_BITS | slots[b]
                slot = int(self.pair_slots(np.array([key]))[0])
                if self.pairs[slot] < 0:
                    crc = zlib.crc32(a + b" " + b)
                    self.pairs[slot], self.pair_states[slot], self.pair_buckets[slot] = key, crc ^ 0xFFFFFFFF, crc % buckets

    @staticmethod
    def slots(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return (mix(first ^ mix(second + np.uint64(BASE))) >> np.uint64(64 - WORD_BITS)).astype(np.int64)

    @staticmethod
    def pair_slots(key: np.ndarray) -> np.ndarray:
        return (mix(key.astype(np.uint64)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)

    def features(self, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of one, two and three words: the words they begin at and their buckets."""
        first, second = words.keys()
        slot = self.slots(first, second)
        known = (first != 0) & (self.first[slot] == first) & (self.second[slot] == second)
        state = self.states[slot]
        rest = np.flatnonzero(~known)
        state[rest] = carry_on(np.full(len(rest), FULL), words.data, words.begin[rest], words.end[rest])
        one = words.runs(1)
        yield one, self.bucket(state[one])
        two = words.runs(2)
        key = slot[two] << WORD_BITS | slot[two + 1]
        place = self.pair_slots(key)
        known = known[two] & known[two + 1] & (self.pairs[place] == key)
        after, found = self.pair_states[place], self.pair_buckets[place]
        rest = np.flatnonzero(~known)
        # From the space before the second word to its end.
        after[rest] = carry_on(state[two[rest]], words.data, words.end[two[rest]], words.end[two[rest] + 1])
        found[rest] = self.bucket(after[rest])
        yield two, found
        three = words.runs(3)
        longer = carry_on(after[np.searchsorted(two, three)], words.data, words.end[three + 1], words.end[three + 2])
        yield three, self.bucket(longer)

    def bucket(self, state: np.ndarray) -> np.ndarray:
        return ((state ^ FULL) % np.uint32(self.buckets)).astype(np.int32)


def frequent(docs: DataFrame) -> tuple[list[bytes], list[tuple[bytes, bytes]]]:
    """The words and pairs that fill the head, most frequent first; every part of every text is read.

    A part reports those of its words and pairs that make up at least ``SHARE`` of it, so what it sends is bounded.
    """

    def scan(batches):
        for _, _, words in parts(batches):
            first, second = words.keys()
            mark = mix(first ^ mix(second + np.uint64(BASE)))
            two = words.runs(2)
            two = two[(first[two] != 0) & (first[two + 1] != 0)]
            out = ([], [], [])
            for at, value in ((np.flatnonzero(words.own & (first != 0)), mark), (two, mark[two] * np.uint64(BASE) + mark[two + 1])):
                _, where, count = np.unique(value if at is two else value[at], return_index=True, return_counts=True)
                chosen = np.flatnonzero(count >= max(2, SHARE * len(words)))
                for i, n in zip(at[where[chosen]].tolist(), count[chosen].tolist()):
                    out[0].append(words.word(i))
                    out[1].append(words.word(i + 1) if at is two else None)
                    out[2].append(n)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], names=["a", "b", "n"])

    seen = docs.select("text").mapInArrow(scan, "a binary, b binary, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    best = lambda rows, bits: rows.orderBy(F.desc("n"), "a", "b").limit(1 << bits)
    seen = settle(best(seen.filter("b IS NULL"), WORD_BITS).unionAll(best(seen.filter("b IS NOT NULL"), PAIR_BITS)))
    # Bounded by the slots of the head.
    rows = seen.orderBy(F.desc("n"), "a", "b").toPandas()
    words = [bytes(a) for a, b in zip(rows["a"], rows["b"]) if b is None]
    return words, [(bytes(a), bytes(b)) for a, b in zip(rows["a"], rows["b"]) if b is not None]


def totals(docs: DataFrame, head) -> DataFrame:
    """How many features of ``docs`` (text) each bucket holds: ``bucket, n``; empty buckets are left out."""

    def scan(batches):
        count = np.zeros(head.value.buckets, np.int64)
        for _, _, words in parts(batches):
            for _, found in head.value.features(words):
                count += np.bincount(found, minlength=len(count))
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], names=["bucket", "n"])

    return docs.select("text").mapInArrow(scan, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, head) -> np.ndarray:
    """Per bucket ``floor(1000 * ln(share in the target / share in the source))``, smoothed by one feature a bucket."""
    buckets = head.value.buckets
    every = source.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    each = totals(source, head).select("bucket", F.col("n").alias("s")), totals(target, head).select("bucket", F.col("n").alias("t"))
    rows = every.join(each[0], "bucket", "left").join(each[1], "bucket", "left").fillna(0, ["s", "t"])
    d = lambda c: F.col(c).cast("double")
    # One row a bucket, so this is bounded.
    rows = settle(rows)
    whole = rows.agg(F.sum("s").cast("double").alias("S"), F.sum("t").cast("double").alias("T")).first()
    ratio = (d("t") + 1) * (F.lit(whole["S"]) + buckets) / ((d("s") + 1) * (F.lit(whole["T"]) + buckets))
    found = rows.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"]] = found["gain"]
    return out


def weigh(docs: DataFrame, head, gain: np.ndarray) -> DataFrame:
    """Per row of ``docs`` (rid, id, text): ``rid, id, n_words, n_features, weight``."""
    kind = docs.schema["id"].dataType.simpleString()

    def scan(batches):
        last, held = None, []

        def done():
            batch, counts = held
            return pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("id"), *(pa.array(c) for c in counts)], names=["rid", "id", "n_words", "n_features", "weight"])

        for batch, rows, words in parts(batches):
            if batch is not last:
                if held:
                    yield done()
                last, held = batch, [batch, [np.zeros(batch.num_rows, np.int64) for _ in range(3)]]
            n_words, n_features, weight = held[1]
            for size, (at, found) in enumerate(head.value.features(words)):
                # Features follow the texts, so those of a text are one range.
                edges = np.searchsorted(words.text[at], np.arange(len(rows) + 1))
                n_features[rows] += np.diff(edges)
                if size == 0:
                    n_words[rows] += np.diff(edges)
                sums = np.concatenate(([0], np.cumsum(gain[found])))
                weight[rows] += np.diff(sums[edges])
        if held:
            yield done()

    return docs.select("rid", "id", "text").mapInArrow(scan, f"rid long, id {kind}, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, keys: list) -> DataFrame:
    """``rid`` and 1-based ``rank`` of rows by unique ``keys`` over all rows, without bringing them to one task, and the ``total``.

    Ranges of the order are sorted by themselves; a row a range carries the counts on.
    """
    place = F.monotonically_increasing_id()
    inside = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("rid", place.alias("m"))
    inside = settle(inside.select("rid", F.shiftright("m", 33).alias("part"), F.col("m").bitwiseAND((1 << 33) - 1).alias("place")))
    counts = inside.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range, bounded by the number of shuffle partitions.
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return inside.join(F.broadcast(starts), "part").select("rid", (F.col("start") + F.col("place") + 1).alias("rank"), "total")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS, id_col: str = "doc_id",
    text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """Per row of ``docs``: ``rid``, the id, ``n_words, n_features, weight, score, rank`` (null where it is not drawn).

    Of the N rows with ``least_words`` words or more the ``floor(percent * N / 100)`` highest scores are drawn, ties to the smaller id (null
    ids last), then to the row that comes first. The noise follows from ``seed`` and the id (a null id counts as an empty one), so repeated
    ids have equal noise; they stay separate rows. Null, empty and wordless texts have no features and weight 0. Without target
    texts every gain compares with an even spread. Very long texts are read in pieces. Other columns are not read, whatever their names; an empty
    table gives no rows.
    """
    source = numbered(docs, F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return _resample(source, target, percent, least_words, seed, buckets, id_col, target_col)


def _resample(source: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS, id_col: str = "doc_id", target_col: str = "text") -> DataFrame:
    wanted = target.select(F.col(target_col).alias("text"))
    head = source.sparkSession.sparkContext.broadcast(Head(*frequent(source), buckets))
    weights = weigh(source, head, gains(source, wanted, head))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    scored = settle(weights.withColumn("score", F.col("weight") + noise))
    order = ranked(scored.filter(F.col("n_words") >= least_words), [F.desc("score"), F.asc_nulls_last("id"), F.asc("rid")])
    drawn = order.filter(F.col("rank") <= F.floor(percent * F.col("total") / 100)).select("rid", "rank")
    return scored.join(drawn, "rid", "left").select("rid", F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The drawn rows of ``docs``, all columns (see ``resample``)."""
    row = fresh(docs, "row")
    rows = identified(docs, row)
    source = rows.select(F.col(row).alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = _resample(source, target, id_col=id_col, **options).filter("rank IS NOT NULL").select(F.col("rid").alias(row))
    return rows.join(chosen, row, "left_semi").select(docs.columns)


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("rid", "n_words")


#: CRC-32 of the column ``h`` (hexadecimal bytes) with the table ``t``.
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h), 2), lambda i: ('0x' || h[i:i + 1])::BIGINT)),
    lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295)"""
CRC_TABLE = """SELECT list(v ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n::BIGINT, list_transform(range(8), lambda z: 0::BIGINT)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM range(256) AS r(n))"""

SQL = f"""
WITH crc AS ({CRC_TABLE}),
txt AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
words AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM txt),
feature AS (
  SELECT kind, id, array_to_string(ws[s:s + k - 1], ' ') AS f
  FROM words, unnest(range(1, 4)) AS n(k), unnest(range(1, len(ws) - k + 2)) AS p(s)
),
known AS (SELECT f, {CRC} % 10000 AS bucket FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM feature)), crc),
held AS (SELECT kind, id, bucket, count(*) AS n FROM feature JOIN known USING (f) GROUP BY ALL),
total AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 'b'), 0)::DOUBLE AS t FROM held GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM total),
weight AS (SELECT id AS doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM held JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY id),
scored AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM (SELECT id AS doc_id, ws FROM words WHERE kind = 'd') LEFT JOIN weight USING (doc_id)
),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS total FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * total // 100 THEN rank END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""
