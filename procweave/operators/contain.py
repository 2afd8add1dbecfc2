"""Exact "name occurs in text" joins without comparing every name with every text.

A name of up to 16 bytes is filed under itself, a longer one under the one of its windows of 16 bytes that the fewest names share, so names
that begin alike still stand apart. Texts are rolled once for each length; a text can only contain a name whose window it holds, so both meet
on an equi join of hashes, and only those pairs are tested. A bitmap of the names' hashes, of bounded size, tells which windows of a text are worth a row.
With ``by`` they meet within a group only, such as a section or a process.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procweave.session import settle

#: Bytes of a window; bits of the bitmap at most and those of one of its rows; bytes of texts that are rolled at once.
WINDOW, BITS, ROW_BITS, BYTES = 16, 1 << 27, 1 << 15, 1 << 20
#: Of a name longer than twice this, windows of the first and of the last characters are looked at.
ENDS = 40


def _rolled(data: np.ndarray, sizes: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Each of ``sizes`` with the hashes of all its windows of ``data``."""
    code = data.astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(data) + 1, np.uint64)[: len(data)]
    for size in range(1, min(max(sizes, default=0), len(data)) + 1):
        h = h[: len(data) - size + 1] * np.uint64(0x9E3779B97F4A7C15) + code[size - 1 :]
        if size in sizes:
            x = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(size)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            yield size, x ^ (x >> np.uint64(32))


def _hits(texts: pa.Array, groups: np.ndarray, sizes: Sequence[int], bitmap: np.ndarray | None, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the windows of ``texts``, each once a row; with a ``bitmap`` only those whose bits are set, with ``whole`` only those that are the text.
    ``groups`` is mixed into the hashes."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    rows, hashes, low = [], [], 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(at, at[low] + BYTES, side="right")) - 1)
        owner = np.repeat(np.arange(low, high), np.diff(at[low : high + 1]))
        for size, h in _rolled(data[at[low] : at[high]], sizes):
            first, last = owner[: len(h)], owner[size - 1 :]
            h = h ^ groups[first]
            kept = first == last
            if whole:
                kept &= (at[1:] - at[:-1])[first] == size
            if bitmap is not None:
                for shift in (0, 32):
                    kept = np.flatnonzero(kept) if kept.dtype == bool else kept
                    place = (h[kept] >> np.uint64(shift)) & np.uint64(len(bitmap) * 8 - 1)
                    kept = kept[(bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0]
            kept = np.flatnonzero(kept) if kept.dtype == bool else kept
            rows.append(first[kept])
            hashes.append(h[kept])
        low = high
    row, h = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((rows, np.int64), (hashes, np.uint64)))
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), bool)
    new[1:] = (np.diff(row) != 0) | (np.diff(h) != 0)
    return row[new], h[new].view(np.int64)


def _windows(df: DataFrame, text: str, keep: Sequence[str], sizes: Sequence[int], by: Sequence[str], bitmap: np.ndarray | None = None, whole: bool = False) -> DataFrame:
    """Rows (keep, window) of the hashed windows of ``text`` (see ``_hits``)."""
    group = F.xxhash64(*by) if by else F.lit(0).cast("long")
    kind = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in keep), T.StructField("window", T.LongType())])
    held = df.sparkSession.sparkContext.broadcast(bitmap) if bitmap is not None else None

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, h = _hits(batch.column("__text"), batch.column("__group").to_numpy().view(np.uint64), sizes, held.value if held else None, whole)
            for k in range(0, len(row), 1 << 17):
                part = batch.take(pa.array(row[k : k + (1 << 17)])).select(list(keep))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(h[k : k + (1 << 17)])], names=[*keep, "window"])

    return df.select(*keep, F.col(text).alias("__text"), group.alias("__group")).mapInArrow(roll, kind)


def _filed(names: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, digest, size, window): see ``anchors``; ``size`` is that of the window in bytes."""
    whole = F.octet_length("keyword") <= WINDOW
    kw = names.where("keyword <> ''").select(*by, "keyword", F.md5("keyword").alias("digest"), F.least(F.octet_length("keyword"), F.lit(WINDOW)).alias("size")).dropDuplicates([*by, "digest"])
    kw = settle(kw)
    keep = [*by, "digest", "size"]
    short = _windows(kw.where(whole), "keyword", keep, range(1, WINDOW + 1), by, whole=True)
    ends = F.when(F.length("keyword") <= 2 * ENDS, F.array("keyword")).otherwise(F.array(F.substring("keyword", 1, ENDS), F.right("keyword", F.lit(ENDS))))
    held = settle(_windows(kw.where(~whole).select(*keep, F.explode(ends).alias("end")), "end", keep, [WINDOW], by).distinct())
    spread = held.groupBy(*by, "window").agg(F.count(F.lit(1)).alias("n"))
    best = held.join(spread.hint("merge"), [*by, "window"]).groupBy(*keep).agg(F.min(F.struct("n", "window")).alias("b"))
    return short.unionByName(best.select(*keep, F.col("b.window").alias("window")))


def anchors(names: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, window, digest): of each distinct non-empty keyword its own hash or, of a longer one, that of the window that the fewest keywords hold, with the
    keyword's digest.

    Any window of a keyword would do, so it does not matter that the middle of a long one is not looked at.
    """
    return _filed(names, by).select(*by, "window", "digest")


def _bitmap(filed: DataFrame) -> np.ndarray:
    """Two bits set for each window: as many bits as ``BITS`` at most, whatever the number of names."""
    bits = ROW_BITS
    wanted = min(BITS, 64 * filed.count())
    while bits < wanted:
        bits *= 2
    places = F.array(*[F.shiftrightunsigned("window", n).bitwiseAND(F.lit(bits - 1)) for n in (0, 32)])
    set_bits = filed.select(F.explode(places).alias("place")).groupBy(F.floor(F.col("place") / ROW_BITS).cast("int").alias("row"))
    out = np.zeros(bits // 8, np.uint8)
    for r in set_bits.agg(F.bitmap_construct_agg(F.col("place") % ROW_BITS).alias("bits")).collect():
        out[r["row"] * ROW_BITS // 8 : (r["row"] + 1) * ROW_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def contained_in(texts: DataFrame, names: DataFrame, shortest: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Pairs (by, text_id, name_id, keyword) where the keyword of the name occurs in the text.

    ``texts`` is (by, text_id, text), ``names`` is (by, name_id, keyword); keywords shorter than ``shortest``
    never match. Case is left to the caller. ``text_id`` is unique within its group.
    """
    named = names.where(F.length("keyword") >= shortest)
    filed = settle(_filed(named, by))
    # Which lengths there are decides how often texts are rolled.
    sizes = [r[0] for r in filed.select("size").distinct().collect()]
    windows = _windows(texts.where("text IS NOT NULL"), "text", [*by, "text_id"], sizes, by, _bitmap(filed))
    # Sorted merges, split where skewed: texts and names are small as files and large as tables, too large for the driver.
    met = windows.join(filed.select(*by, "window", "digest").hint("merge"), [*by, "window"]).select(*by, "text_id", "digest")
    # Texts and names stay out of the join on windows and come back for the pairs that met.
    told = named.select(*by, "name_id", "keyword", F.md5("keyword").alias("digest"))
    pairs = met.join(told.hint("merge"), [*by, "digest"]).join(texts.select(*by, "text_id", "text").hint("merge"), [*by, "text_id"])
    return pairs.where(F.contains("text", "keyword")).select(*by, "text_id", "name_id", "keyword")
