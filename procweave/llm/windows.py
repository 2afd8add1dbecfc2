"""Fixed-length windows of symbols (bytes or words) that start in more than one place, found exactly.

A window's key is the smallest hash among its grams, so equal windows have equal keys. A maximal run of
window starts with one key is a segment. Per segment only its key, a fingerprint of its content and its
place are shuffled. Keys that occur once in the corpus are done with; of equal segments one speaks for all;
only the text of segments whose key meets different content goes on to be compared suffix by suffix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procweave.llm.common import bounded, settle

#: Fixed: odd multipliers of the mixing steps.
BASE, MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
#: Symbols handled at once; a longer text is cut into overlapping slices.
CHUNK = 1 << 19
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(MIX)
    x ^= x >> np.uint64(29)
    x *= np.uint64(BASE)
    x ^= x >> np.uint64(32)
    return x


MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes of a word that are hashed for all words at once; longer words are hashed one by one.
TOGETHER = 256


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; behind the data stand zeros."""
    return np.ndarray(len(data), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))


def grams(values: np.ndarray, k: int, seed: int = MIX) -> np.ndarray:
    """Fingerprints of all runs of ``k`` values (bytes, or 64-bit numbers), doubled up from short runs.

    Every doubling mixes, so that no regular content meets as it does in sums of powers: bytes start as groups of eight,
    which are told apart exactly.
    """
    if len(values) < k:
        return np.zeros(0, np.uint64)
    size = 1
    if values.dtype == np.uint8 and k >= 8:
        run, size = eights(values)[: len(values) - 7], 8
    else:
        run = values.astype(np.uint64)
    run = mix(run + np.uint64(seed))
    while size * 2 <= k:
        run = mix(run[:-size] * np.uint64(BASE) + run[size:])
        size *= 2
    return mix(run[: len(run) - (k - size)] * np.uint64(BASE) + run[k - size :]) if size < k else run


def word_print(values: np.ndarray) -> np.ndarray:
    """Fingerprint of a short sequence as a whole."""
    out = mix(np.array([len(values)], np.uint64))
    for v in values:
        out = mix(out * np.uint64(BASE) + v)
    return out


def word_values(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of words by their length and their bytes, eight at a time; words of up to eight bytes are told apart exactly."""
    size = end - begin
    out = mix(mix(size.astype(np.uint64)) * np.uint64(BASE) + (eights(data)[begin] & MASKS[np.minimum(size, 8)])) if len(data) else np.zeros(0, np.uint64)
    every, live = eights(data), np.flatnonzero(size > 8)
    for at in range(8, TOGETHER, 8):
        live = live[size[live] > at]
        if not len(live):
            break
        out[live] = mix(out[live] * np.uint64(BASE) + (every[begin[live] + at] & MASKS[np.minimum(size[live] - at, 8)]))
    for i in live[size[live] > TOGETHER]:
        rest = hashlib.blake2b(data[begin[i] + TOGETHER : end[i]].tobytes(), digest_size=8).digest()
        out[i] ^= np.uint64(int.from_bytes(rest, "little"))
    return out


def covered(runs_of: np.ndarray, k: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of ranges of ``k`` symbols or more, from the fingerprints of the runs of ``k`` that lie side by side in them."""
    size = end - begin
    out, live = mix(size.astype(np.uint64)), np.arange(len(begin))
    at = 0
    while len(live):
        out[live] = mix(out[live] * np.uint64(BASE) + runs_of[np.minimum(begin[live] + at, end[live] - k)])
        at += k
        live = live[size[live] > at]
    return out


def sliding(op, values: np.ndarray, width: int) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        values = op(values[:-size], values[size:])
        size *= 2
    return op(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the words of a byte array (words hold no space and no bytes 9 to 13)."""
    edge = np.diff(np.concatenate(([False], ~BLANK[data], [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def symbols(texts: list[bytes], words: bool) -> tuple[np.ndarray, np.ndarray]:
    """All symbols of the texts (bytes, or fingerprints of words), and where each text begins (one bound more than texts)."""
    if not words:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum(lengths)))
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    begin, end = word_bounds(data)
    at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)))
    return word_values(data, begin, end), np.searchsorted(begin, at)


def segments(values: np.ndarray, bounds: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of window starts with one key: text number, key, fingerprint, first start, starts, repeats.

    ``repeats`` marks keys whose gram is a smallest one at two places of one text.
    """
    n = len(values)
    if n < width:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, bool))
    reach = width - gram + 1
    hashes = grams(values, gram)
    low = sliding(np.minimum, hashes, reach)
    whole = np.ones(len(low), bool)
    for b in bounds[1:-1]:
        whole[max(0, b - width + 1) : b] = False
    fresh = whole.copy()
    fresh[1:] &= ~whole[:-1] | (low[1:] != low[:-1])
    last = whole.copy()
    last[:-1] &= ~whole[1:] | (low[1:] != low[:-1])
    first, end = np.flatnonzero(fresh), np.flatnonzero(last)
    key, text = low[first], np.searchsorted(bounds, first, "right") - 1
    low[~whole] = 0
    pad = np.zeros(reach - 1, np.uint64)
    spots = np.flatnonzero(sliding(np.maximum, np.concatenate((pad, low, pad)), reach) == hashes)
    owner = (np.searchsorted(bounds, spots, "right") - 1).astype(np.uint64)
    marks, counts = np.unique(hashes[spots] ^ (owner * np.uint64(MIX)), return_counts=True)
    repeats = np.isin(key ^ (text.astype(np.uint64) * np.uint64(MIX)), marks[counts > 1])
    return text, key, covered(hashes, gram, first, end + width), first - bounds[text], end - first + 1, repeats


def slices(rows: Iterator[tuple], words: bool, width: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Gather ``(tag, text)`` rows into chunks: the tags with the offset of each part, values and bounds."""
    tags, texts, size = [], [], 0

    def cut():
        values, bounds = symbols(texts, words)
        if len(texts) > 1 or len(values) <= 2 * CHUNK:
            yield [(t, 0) for t in tags], values, bounds
            return
        for at in range(0, max(1, len(values) - width + 1), CHUNK):
            part = values[at : at + CHUNK + width - 1]
            yield [(tags[0], at)], part, np.array([0, len(part)])

    for tag, text in rows:
        if size and size + len(text) > CHUNK:
            yield from cut()
            tags, texts, size = [], [], 0
        tags.append(tag)
        texts.append(text)
        size += len(text) + 1
    if texts:
        yield from cut()


SEGMENT = "m long, k long, rid long, ord long, p int, n int, twice boolean"


def find_segments(docs: DataFrame, words: bool, width: int, gram: int) -> DataFrame:
    """``docs``: rid, ord, text. One row per segment."""

    def scan(batches):
        for batch in bounded(batches):
            rids, orders = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "ord"))
            texts = batch.column("text").cast(pa.binary())
            rows = ((i, t.as_py() or b"") for i, t in enumerate(texts))
            for tags, values, bounds in slices(rows, words, width):
                text, key, mark, first, count, twice = segments(values, bounds, width, gram)
                row, offset = np.array(tags).T
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key.view(np.int64)), pa.array(mark.view(np.int64)), pa.array(rids[row[text]].astype(np.int64)),
                        pa.array(orders[row[text]].astype(np.int64)), pa.array((first + offset[text]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(twice),
                    ],
                    names=["m", "k", "rid", "ord", "p", "n", "twice"],
                )

    return docs.select("rid", "ord", "text").mapInArrow(scan, SEGMENT)


def grow_ranks(values: np.ndarray, width: int, packed: int = 1) -> np.ndarray:
    """Ranks of the windows of ``width`` symbols in suffix order, from 1; 0 where a window is unique.

    Prefix doubling on dense ranks; a suffix that no other equals up to some depth is left out from there.
    ``packed``: symbols that one value stands for.
    """

    def dense(size: int, where: np.ndarray, key: np.ndarray) -> np.ndarray:
        out = np.zeros(size, np.int64)
        _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
        back = back.reshape(-1)
        shared = counts > 1
        out[where] = np.where(shared[back], np.cumsum(shared)[back], 0)
        return out

    ranks, depth = dense(len(values), np.arange(len(values)), values), packed
    while depth < width:
        step = min(depth, width - depth)
        if len(ranks) <= step:
            return np.zeros(0, np.int64)
        alive = np.flatnonzero((ranks[:-step] > 0) & (ranks[step:] > 0))
        ranks = dense(len(ranks) - step, alive, ranks[alive] * (len(values) + 1) + ranks[alive + step])
        depth += step
    return ranks


def whole_windows(bounds: np.ndarray, count: int, width: int) -> np.ndarray:
    """Which of ``count`` window starts lie within one text."""
    owner = np.searchsorted(bounds, np.arange(count), "right") - 1
    return np.arange(count) + width <= bounds[owner + 1]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs that the half-open spans cover; spans that touch become one."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    begin = np.flatnonzero(np.concatenate(([True], spans[1:, 0] > reach[:-1])))
    return np.stack((spans[begin, 0], reach[np.concatenate((begin[1:] - 1, [len(spans) - 1]))]), axis=1)


Judge = Callable[[list[bytes]], list[np.ndarray]]


def suspects(docs: DataFrame, words: bool, width: int, gram: int, keep_first: bool, hot: int) -> DataFrame:
    """Texts that may hold repeated windows: ``rid, ord, text, spans, open``.

    ``spans`` are window starts sure to be repeated (first, count); ``open`` are segments to compare (key,
    first start, starts, whether the contents of the key have more than ``hot`` symbols).
    """
    found = find_segments(docs, words, width, gram)
    repeated = found.groupBy("m").agg(F.count("*").alias("c"), F.max("twice").alias("t")).filter("c > 1 OR t").select("m")
    live = settle(found.join(repeated, "m"))
    spot = F.struct("ord", "rid", "p")
    same = live.groupBy("m", "k").agg(F.count("*").alias("c"), F.min(spot).alias("first"), F.max("n").alias("n"), F.max("twice").alias("twice"))
    same = settle(same)
    contested = same.groupBy("m").agg(F.count("*").alias("contents"), F.sum(F.col("n") + width).alias("size"), F.max("twice").alias("t")).filter("contents > 1 OR t")
    opened = same.join(contested, "m").select(
        "first.rid", F.lit(1).alias("kind"), "m", "first.p", "n", (F.col("size") > hot).alias("hot")
    )
    copies = live.join(same.filter("c > 1").select("m", "k", "first"), ["m", "k"])
    if keep_first:
        copies = copies.filter(F.struct("ord", "rid", "p") != F.col("first"))
    copies = copies.select("rid", F.lit(0).alias("kind"), "m", "p", "n", F.lit(False).alias("hot"))
    facts = copies.union(opened).groupBy("rid").agg(F.collect_list(F.struct("kind", "m", "p", "n", "hot")).alias("facts"))
    joined = docs.select("rid", "ord", "text").join(facts, "rid").select(
        "rid", "ord", "text", F.expr("transform(filter(facts, f -> f.kind = 0), f -> struct(f.p, f.n))").alias("spans"),
        F.expr("transform(filter(facts, f -> f.kind = 1), f -> struct(f.m, f.p, f.n, f.hot))").alias("open"),
    )
    return settle(joined)


#: Symbols in the different contents of one key beyond which its windows are compared by fingerprint, spread
#: over all tasks.
HOT = 4 << 20
PIECE = "m long, hot boolean, rid long, ord long, p int, piece binary"


def pieces(texts: DataFrame, words: bool, width: int) -> DataFrame:
    """The text of each open segment."""

    def cut(batches):
        for batch in bounded(batches):
            out = {name: [] for name in ("m", "hot", "rid", "ord", "p", "piece")}
            for rid, order, text, opened in zip(*(batch.column(c).to_pylist() for c in ("rid", "ord", "text", "open"))):
                data = text.split() if words else text
                for f in opened:
                    part = data[f["p"] : f["p"] + f["n"] + width - 1]
                    for name, v in zip(out, (f["m"], f["hot"], rid, order, f["p"], b" ".join(part) if words else part)):
                        out[name].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=list(out))

    return texts.filter(F.size("open") > 0).select("rid", "ord", F.col("text").cast("binary").alias("text"), "open").mapInArrow(cut, PIECE)


FOUND = "rid long, p int, n int"


def compare(cut: DataFrame, judge: Judge) -> DataFrame:
    """Runs of repeated window starts in the pieces, judged key by key in chunks of bounded size.

    ``judge`` gets pieces in (ord, rid, place) order and marks the repeated window starts of each.
    """

    def work(batches):
        held, size = [], 0

        def done():
            held.sort(key=lambda r: (r[1], r[0], r[2]))
            out = ([], [], [])
            for (rid, _, p, _), flags in zip(held, judge([r[3] for r in held])):
                begin, end = runs(flags)
                out[0].extend([rid] * len(begin))
                out[1].extend((begin + p).tolist())
                out[2].extend((end - begin).tolist())
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], names=["rid", "p", "n"])

        key = None
        for batch in bounded(batches, "piece"):
            for m, rid, order, p, piece in zip(*(batch.column(c).to_pylist() for c in ("m", "rid", "ord", "p", "piece"))):
                if m != key and size > CHUNK:
                    yield done()
                    held, size = [], 0
                key = m
                held.append((rid, order, p, piece))
                size += len(piece)
        if held:
            yield done()

    dealt = cut.filter("NOT hot").drop("hot").repartition("m").sortWithinPartitions("m")
    return dealt.mapInArrow(work, FOUND)


def compare_hot(cut: DataFrame, words: bool, width: int, keep_first: bool) -> DataFrame:
    """The same for keys with very many contents: each window's fingerprints meet in an aggregation."""

    def expand(batches):
        for batch in bounded(batches, "piece"):
            rows = ((i, t) for i, t in enumerate(batch.column("piece").to_pylist()))
            rids, orders, ps = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "ord", "p"))
            for tags, values, bounds in slices(rows, words, width):
                at = np.flatnonzero(whole_windows(bounds, max(0, len(values) - width + 1), width))
                if not len(at):
                    continue
                text = np.searchsorted(bounds, at, "right") - 1
                row, offset = np.array(tags).T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams(values, width, seed)[at].view(np.int64)) for seed in (MIX, BASE)]
                    + [pa.array(x[row[text]].astype(np.int64)) for x in (rids, orders)] + [pa.array((at - bounds[text] + offset[text] + ps[row[text]]).astype(np.int32))],
                    names=["a", "b", "rid", "ord", "p"],
                )

    every = cut.filter("hot").drop("hot", "m").mapInArrow(expand, "a long, b long, rid long, ord long, p int")
    spot = F.struct("ord", "rid", "p")
    shared = every.groupBy("a", "b").agg(F.count("*").alias("c"), F.min(spot).alias("first")).filter("c > 1")
    hits = every.join(shared, ["a", "b"])
    if keep_first:
        hits = hits.filter(F.struct("ord", "rid", "p") != F.col("first"))
    return hits.select("rid", "p", F.lit(1).alias("n"))


def repeated_spans(texts: DataFrame, words: bool, width: int, judge: Judge, keep_first: bool) -> DataFrame:
    """All window starts found among the open segments, gathered per text: ``rid, more``."""
    cut = pieces(texts, words, width)
    found = compare(cut, judge).union(compare_hot(cut, words, width, keep_first))
    return found.groupBy("rid").agg(F.collect_list(F.struct("p", "n")).alias("more"))


CLEANED = "rid long, removed long, runs long, sha string, kept string"


def clean(texts: DataFrame, found: DataFrame, words: bool, width: int, keep_text: bool) -> DataFrame:
    """Texts without the symbols that repeated windows cover: counts, digest and, if asked for, what is kept."""

    def cut(batches):
        for batch in bounded(batches):
            out = {name: [] for name in ("rid", "removed", "runs", "sha", "kept")}
            for rid, text, spans, more in zip(*(batch.column(c).to_pylist() for c in ("rid", "text", "spans", "more"))):
                starts = np.array([(s["p"], s["p"] + s["n"] + width - 1) for s in [*spans, *(more or ())]], np.int64).reshape(-1, 2)
                gone = merged(starts)
                data = text.split() if words else text
                edges = [0, *gone.reshape(-1).tolist(), len(data)]
                parts = [data[a:b] for a, b in zip(edges[::2], edges[1::2])]
                kept = b" ".join(w for part in parts for w in part) if words else b"".join(parts)
                for name, v in zip(out, (rid, int((gone[:, 1] - gone[:, 0]).sum()), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if keep_text else None)):
                    out[name].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=list(out))

    rows = texts.select("rid", F.col("text").cast("binary").alias("text"), "spans").join(found, "rid", "left")
    return rows.mapInArrow(cut, CLEANED)


def remove_repeats(docs: DataFrame, words: bool, width: int, gram: int, judge: Judge, keep_first: bool, keep_text: bool = False, hot: int = HOT) -> DataFrame:
    """``docs`` (rid, ord, text): per text with anything removed ``rid, removed, runs, sha, kept``."""
    texts = suspects(docs, words, width, gram, keep_first, hot)
    return clean(texts, repeated_spans(texts, words, width, judge, keep_first), words, width, keep_text).filter("removed > 0")
