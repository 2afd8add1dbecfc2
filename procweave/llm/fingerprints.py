"""Context-triggered piecewise hashing of documents.

A hash of the last seven bytes decides where a piece ends, so cuts follow the content and an edit moves only those beside it. A piece
ends where the hash has ``level`` trailing ones; every level's cuts are among those of the level below. The block size of a text is
the largest power of two that still cuts it in at least PIECES pieces, and its fingerprint holds one character a piece at that block size and
at the next larger one. Two fingerprints are compared at the block sizes that both have, by edit distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procweave.llm.common import bounded, numbered, settle, table
from procweave.llm.windows import BASE, mix

WINDOW, PIECES, COMMON = 7, 32, 4
#: Characters of a signature; behind them the rest of a text is one last piece. Only very even texts have so many pieces.
LONGEST = 128
#: Bytes of a text that are hashed at once.
STEP = 1 << 20
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+-", np.uint8)
SEVEN = np.uint64((1 << 8 * WINDOW) - 1)
LEVELS = 48


def rolling(data: bytes) -> np.ndarray:
    """Hash of the seven bytes that end at each place from the seventh on."""
    padded = np.frombuffer(data + b"\0", np.uint8)
    return mix((np.ndarray(len(data) - WINDOW + 1, "<u8", padded, strides=(1,)) & SEVEN) * np.uint64(BASE))


def _windows(data: bytes) -> Iterator[np.ndarray]:
    """The hashes of all places, in parts; before the text stand zero bytes."""
    for at in range(0, len(data), STEP):
        yield rolling((b"\0" * (WINDOW - 1) if at == 0 else data[at - WINDOW + 1 : at]) + data[at : at + STEP])


def _levels(hashes: np.ndarray) -> np.ndarray:
    """Trailing ones of each hash: the logarithm of the lowest bit that is not set."""
    low = ~hashes & (hashes + np.uint64(1))
    return np.where(low == 0, LEVELS, np.minimum(np.frexp(low.astype(np.float64))[1] - 1, LEVELS))


def _signature(hashes_of, level: int) -> str:
    """One character a piece: the mixed sum of the hashes of its places."""
    sums, open_sum, pending = [], np.uint64(0), False
    for hashes, levels in hashes_of():
        ends = np.flatnonzero(levels >= level) + 1
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes)))
        edges = total[np.concatenate(([0], ends))]
        parts = np.diff(edges)
        if len(parts):
            parts[0] += open_sum
            open_sum = np.uint64(0)
            sums.append(parts)
        open_sum = open_sum + (total[-1] - edges[-1])
        pending = len(hashes) > (ends[-1] if len(ends) else 0)
    if pending:
        sums.append(np.array([open_sum], np.uint64))
    every = np.concatenate(sums) if sums else np.zeros(0, np.uint64)
    if len(every) > LONGEST:
        every = np.append(every[: LONGEST - 1], every[LONGEST - 1 :].sum(dtype=np.uint64))
    return ALPHABET[(mix(every) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(data: bytes) -> str:
    """``level:signature:signature at the next level`` of a text; an empty text gives ``0::``."""
    with np.errstate(over="ignore"):
        if len(data) <= STEP:
            held = [(h, _levels(h)) for h in _windows(data)]
            hashes_of = lambda: held
        else:
            hashes_of = lambda: ((h, _levels(h)) for h in _windows(data))
        counts = np.zeros(LEVELS + 1, np.int64)
        for _, levels in hashes_of():
            counts += np.bincount(levels, minlength=LEVELS + 1)
        # Pieces a level cuts, less the open one at the end.
        enough = np.flatnonzero(np.cumsum(counts[::-1])[::-1] >= PIECES)
        level = int(enough[-1]) if len(enough) else 0
        return f"{level}:{_signature(hashes_of, level)}:{_signature(hashes_of, level + 1)}"


def squeezed(signature: str) -> str:
    """Runs of one character cut to three: they tell little."""
    return "".join(c for i, c in enumerate(signature) if i < 3 or not c == signature[i - 1] == signature[i - 2] == signature[i - 3])


def common_length(a: str, b: str) -> int:
    """Longest common subsequence, with one bit a character of ``a``."""
    places = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full
    for c in b:
        hit = open_ & places.get(c, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(a) - open_.bit_count()


def signature_likeness(a: str, b: str) -> float:
    """1 less the share of characters to insert and delete; 0 unless COMMON characters in a row are common (all of a shorter one)."""
    a, b = squeezed(a), squeezed(b)
    run = min(COMMON, len(a), len(b))
    if not run or {a[i : i + run] for i in range(len(a) - run + 1)}.isdisjoint(b[i : i + run] for i in range(len(b) - run + 1)):
        return 0.0
    return 2 * common_length(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1, at the block sizes that both have; 1 for equal ones, 0 where there is no such size."""
    if a == b:
        return 1.0
    (p, *one), (q, *two) = a.split(":"), b.split(":")
    left, right = ({int(level) + i: s for i, s in enumerate(sides)} for level, sides in ((p, one), (q, two)))
    return max((signature_likeness(left[level], right[level]) for level in left.keys() & right.keys()), default=0.0)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``rid``, the id, ``n_chars`` and ``fingerprint``. A null text counts as empty; other columns are not read."""
    source = numbered(docs, F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def scan(batches):
        for batch in bounded(batches):
            marks = [fingerprint(t.as_py()) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("id"), batch.column("n_chars"), pa.array(marks, pa.string())], names=["rid", "id", "n_chars", "fingerprint"])

    rows = source.select("rid", "id", F.length("text").cast("long").alias("n_chars"), "text").mapInArrow(scan, f"rid long, id {kind}, n_chars long, fingerprint string")
    return rows.withColumnRenamed("id", id_col)


FOUND = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
FOUND_TYPES = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the following text's first, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def judged(text: str, own: str, following: str, its: str) -> tuple:
    changed = edited(text, following).encode()
    mark = fingerprint(changed)
    return len(text), hashlib.sha256(changed).hexdigest(), own, mark, likeness(own, mark), likeness(own, its)


def edit_test(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the id and ``n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The next document is the one with the next smaller id (rows of one id stand in the order of the table, null ids last), after the
    last one the first; a single document is its own next. A null text counts as empty. Texts are sorted in ranges of ids; each range is read as a stream that
    holds two texts, and only the first and last text of a range are met by a join. Columns other than id and text are not read. An empty table gives no rows.
    """
    source = numbered(docs, F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    order = [F.desc_nulls_last("id"), F.asc("rid")]

    def walk(batches):
        part = TaskContext.get().partitionId()
        before = ids = None
        out = []

        def cut():
            rows = list(zip(*out))
            types = (pa.int64(), ids, pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=["part", "id", "place", *FOUND, "text"])

        for batch in bounded(batches):
            ids = batch.schema.field("id").type
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                now = (i, text, fingerprint(text.encode()))
                if before is None:
                    out.append((part, None, "head", None, None, now[2], None, None, None, text))
                else:
                    out.append((part, before[0], "done", *judged(before[1], before[2], text, now[2]), None))
                before = now
            yield cut()
            out = []
        if before is not None:
            out.append((part, before[0], "tail", None, None, before[2], None, None, None, before[1]))
            yield cut()

    ranges = source.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    rows = settle(ranges.mapInArrow(walk, f"part long, id {kind}, place string, {FOUND_TYPES}, text string"))
    heads = rows.filter("place = 'head'").select("part", F.col("text").alias("following"), F.col("fingerprint").alias("its"))
    # One row a range: bounded by the number of partitions. The last one's next is the first.
    parts = heads.select("part")
    every = Window.orderBy("part")
    nexts = parts.select("part", F.coalesce(F.lead("part").over(every), F.min("part").over(Window.partitionBy())).alias("next"))
    tails = rows.filter("place = 'tail'").select("part", "id", "text", "fingerprint")
    met = tails.join(nexts, "part").drop("part").join(heads, F.col("next") == F.col("part")).select("id", "text", "fingerprint", "following", "its")

    def finish(batches):
        for batch in bounded(batches, size=1 << 20):
            rows = [judged(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("text", "fingerprint", "following", "its")))]
            types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=["id", *FOUND])

    done = rows.filter("place = 'done'").select("id", *FOUND).union(met.mapInArrow(finish, f"id {kind}, {FOUND_TYPES}"))
    return done.withColumnRenamed("id", id_col)


def op13_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edit_test(table(spark, sf_dir, "documents"))
