"""Hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class). The class softmax has hashed features of the word before, the skipped word
two before, and the classes of both; it is trained by gradient updates in all partitions, whose weights are averaged by their
tokens. Words of a bounded vocabulary have classes found by clustering what stands before them; all other words share one class, in
which they have their relative frequency. Counts are taken over the whole training text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procweave.llm.common import bounded, numbered, settle, table
from procweave.llm.windows import BASE, mix, symbols

VOCABULARY, CLUSTERED, CONTEXTS, CLASSES = 200_000, 40_000, 24, 32
TAIL, RARE, END = CLASSES - 3, CLASSES - 2, CLASSES - 1
#: Rows of the weight matrix: the word before, the word two before, both classes, and one for the bias.
BEFORE, SKIP, PAIR = 1 << 14, 1 << 13, CLASSES * CLASSES
ROWS = BEFORE + SKIP + PAIR + 1
#: The end of a text as a token; it stands apart from the fingerprint of any word.
END_MARK = np.uint64(BASE)
STEP, BATCH = 1 << 20, 8192


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the lower-cased words of each text with an end after each, and where each text begins."""
    values, bounds = symbols([t.lower() for t in texts], words=True)
    out = np.full(len(values) + len(texts), END_MARK, np.uint64)
    ends = bounds[1:] + np.arange(len(texts))
    words = np.ones(len(out), bool)
    words[ends] = False
    out[words] = values
    return out, np.concatenate(([0], ends + 1))


def chunks(batches, columns: tuple[str, ...]):
    """Parts of bounded size of batches with a text column: the other columns as arrays and the texts."""
    for batch in bounded(batches, size=STEP):
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield [batch.column(c).to_numpy(zero_copy_only=False) for c in columns], texts


@dataclass
class Model:
    """``words``: fingerprints of the vocabulary by rank; ``counts``; ``classes``; ``weights``."""

    words: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int
    classes: np.ndarray | None = None
    weights: np.ndarray | None = None
    _index: list = field(default_factory=list, repr=False)

    def ids(self, values: np.ndarray) -> np.ndarray:
        """Rank of each word, -1 outside the vocabulary; words that meet in a table's slot go on to the next table."""
        if not self._index:
            left, shift = np.arange(len(self.words)), 0
            while len(left):
                size = 1 << max(4, int(2 * len(left) - 1).bit_length())
                slots = np.full(size, -1, np.int32)
                spot = (mix(self.words[left] + np.uint64(shift)) & np.uint64(size - 1)).astype(np.int64)
                slots[spot] = left
                self._index.append((shift, size, slots))
                left, shift = left[slots[spot] != left], shift + 1
        out, todo = np.full(len(values), -1, np.int64), np.arange(len(values))
        for shift, size, slots in self._index:
            spot = (mix(values[todo] + np.uint64(shift)) & np.uint64(size - 1)).astype(np.int64)
            got = slots[spot]
            hit = (got >= 0) & (self.words[got] == values[todo])
            out[todo[hit]] = got[hit]
            todo = todo[~hit & (got >= 0)]
        return out

    def features(self, values: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each token and the weight rows of its three features."""
        kinds = np.where(ids >= 0, self.classes[ids] if len(self.classes) else RARE, RARE)
        half_before, half_skip = BEFORE // 2, SKIP // 2
        hashed = mix(values)
        before = np.where((ids >= 0) & (ids < half_before), ids, half_before + (hashed & np.uint64(half_before - 1)).astype(np.int64))
        skip = np.where((ids >= 0) & (ids < half_skip), ids, half_skip + (hashed & np.uint64(half_skip - 1)).astype(np.int64))
        starts = bounds[:-1]
        back = lambda x, n, blank: np.concatenate((np.full(n, blank, x.dtype), x[:-n]))[: len(x)]
        prior, older, kind1, kind2 = back(before, 1, BEFORE - 1), back(skip, 2, SKIP - 1), back(kinds, 1, END), back(kinds, 2, END)
        # A text's first tokens have no history beyond its begin.
        prior[starts], older[starts], kind1[starts], kind2[starts] = BEFORE - 1, SKIP - 1, END, END
        second = starts + 1
        second = second[second < bounds[1:]]
        older[second], kind2[second] = SKIP - 1, END
        return kinds, np.stack((prior, BEFORE + older, BEFORE + SKIP + kind2 * CLASSES + kind1))

    def chances(self, rows: np.ndarray) -> np.ndarray:
        """Softmax over classes for the columns of ``rows``."""
        w = self.weights
        logits = w[rows[0]] + w[rows[1]]
        logits += w[rows[2]]
        logits += w[ROWS - 1]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits


def count_tokens(docs: DataFrame) -> DataFrame:
    """``h, c``: training tokens and their counts."""

    def scan(batches):
        for _, texts in chunks(batches, ()):
            values, n = np.unique(tokens(texts)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], names=["h", "n"])

    return docs.select("text").mapInArrow(scan, "h long, n long").groupBy("h").agg(F.sum("n").alias("c"))


def vocabulary(counts: DataFrame) -> Model:
    """All words from the smallest count on above which there are at most VOCABULARY words; counts are told apart by eighths of an
    octave, so the few hundred classes of counts say where the bound lies, and words are neither sorted nor gathered to find it."""
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    level = F.floor(F.log2("c") * 8).cast("int")
    bar, room = None, VOCABULARY
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if r["count"] > room:
            break
        bar, room = r["level"], room - r["count"]
    top = (counts.filter(level >= bar) if bar is not None else counts.limit(0)).select("h", "c").toArrow().sort_by([("c", "descending"), ("h", "ascending")])
    return Model(top.column("h").to_numpy().astype(np.int64).view(np.uint64), top.column("c").to_numpy().astype(np.int64), totals["n"] or 0, totals["v"])


def neighbours(docs: DataFrame, model: Model) -> np.ndarray:
    """How often each of the CLUSTERED first words stands right after or before each of the CONTEXTS first ones."""

    def scan(batches):
        sums = np.zeros(CLUSTERED * CONTEXTS, np.int64)
        for _, texts in chunks(batches, ()):
            values, bounds = tokens(texts)
            ids = model.ids(values)
            ids[values == END_MARK] = -1
            for a, b in ((ids[1:], ids[:-1]), (ids[:-1], ids[1:])):
                both = (a >= 0) & (a < CLUSTERED) & (b >= 0) & (b < CONTEXTS)
                sums += np.bincount(a[both] * CONTEXTS + b[both], minlength=len(sums))
        cell = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(sums[cell])], names=["cell", "n"])

    rows = docs.select("text").mapInArrow(scan, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CLUSTERED * CONTEXTS)
    out[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(CLUSTERED, CONTEXTS)


def cluster(model: Model, beside: np.ndarray, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Class of every vocabulary word: k-means on the square roots of neighbour shares; the end and the tail apart."""
    k, count = TAIL, min(CLUSTERED, len(model.words))
    points = beside[:count] + 0.02
    points = np.sqrt(points / points.sum(axis=1, keepdims=True))
    weight = model.counts[:count].astype(float)
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(count, k, replace=count < k, p=weight / weight.sum())] if count else np.zeros((k, CONTEXTS))
    for _ in range(rounds if count else 0):
        near = (points @ centres.T).argmax(axis=1)
        sums = np.stack([np.bincount(near, weight * points[:, j], k) for j in range(CONTEXTS)], axis=1)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-12), centres)
    classes = np.full(len(model.words), TAIL, np.int16)
    if count:
        classes[:count] = (points @ centres.T).argmax(axis=1)
    classes[model.words == END_MARK] = END
    return classes


def descend(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, kinds: np.ndarray, chances: np.ndarray, rate: float) -> None:
    """One gradient update (AdaGrad by row) of the log-likelihood of a batch, in place."""
    error = chances
    error[np.arange(len(kinds)), kinds] -= 1
    for f in rows:
        order = np.argsort(f.astype(np.uint16), kind="stable")
        hit = f[order]
        begin = np.flatnonzero(np.concatenate(([True], hit[1:] != hit[:-1])))
        row, gradient = hit[begin], np.add.reduceat(error[order], begin)
        squares[row] += (gradient * gradient).mean(axis=1)
        weights[row] -= (rate / np.sqrt(squares[row] + 1))[:, None] * gradient
    gradient = error.sum(axis=0)
    squares[ROWS - 1] += (gradient * gradient).mean()
    weights[ROWS - 1] -= rate / np.sqrt(squares[ROWS - 1] + 1) * gradient


def train(docs: DataFrame, model: Model, rate: float = 0.3, block: int = 800, fan_in: int = 16) -> np.ndarray:
    """Every partition updates its own weights over all its tokens; they are averaged by tokens in a tree of bounded fan-in."""
    shares = np.bincount(model.classes, model.counts, CLASSES) if len(model.words) else np.zeros(CLASSES)
    shares[RARE] = model.total - shares.sum()
    start = np.zeros((ROWS, CLASSES), np.float32)
    start[ROWS - 1] = np.log((np.maximum(shares, 0) + 1) / (shares.sum() + CLASSES))

    def scan(batches):
        own = Model(model.words, model.counts, model.total, model.distinct, model.classes, start.copy())
        squares, seen = np.zeros(ROWS, np.float32), 0
        for _, texts in chunks(batches, ()):
            values, bounds = tokens(texts)
            kinds, rows = own.features(values, own.ids(values), bounds)
            seen += len(values)
            for at in range(0, len(values), BATCH):
                part = rows[:, at : at + BATCH]
                descend(own.weights, squares, part, kinds[at : at + BATCH], own.chances(part), rate)
        if seen:
            place = TaskContext.get().partitionId()
            for b in range(0, ROWS, block):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b // block], pa.int32()), pa.array([place]), pa.array([seen]), pa.array([(own.weights[b : b + block] * np.float32(seen)).tobytes()], pa.binary())],
                    names=["block", "place", "seen", "w"],
                )

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(w, np.float32).astype(np.float64) for w in rows.column("w").to_pylist()).astype(np.float32)
        return pa.table({"block": rows.column("block").slice(0, 1), "place": pa.array([rows.column("place")[0].as_py() // fan_in]), "seen": pa.array([sum(rows.column("seen").to_pylist())]), "w": pa.array([total.tobytes()], pa.binary())})

    kind = "block int, place long, seen long, w binary"
    sums = settle(docs.select("text").mapInArrow(scan, kind))
    places = (sums.agg(F.max("place")).first()[0] or 0) + 1
    while places > 1:
        sums = sums.groupBy("block", F.floor(F.col("place") / fan_in).alias("to")).applyInArrow(add, kind)
        places = -(-places // fan_in)
    out = start.copy()
    for r in sums.toArrow().to_pylist():
        out[r["block"] * block : r["block"] * block + block] = (np.frombuffer(r["w"], np.float32) / np.float32(r["seen"])).reshape(-1, CLASSES)
    return out


def score(docs: DataFrame, model: Model, counts: DataFrame, smooth: float = 0.1) -> DataFrame:
    """``docs`` (rid, id, text): ``rid, id, n_tokens, n_known, base_score, score`` in log10."""
    inside = np.bincount(model.classes, model.counts, CLASSES) if len(model.words) else np.zeros(CLASSES)
    left, left_words = model.total - int(model.counts.sum()), model.distinct - len(model.words)
    below = np.log10(model.total + smooth * (model.distinct + 1))
    below_rare = np.log10(left + smooth * (left_words + 1))
    base = np.log10(model.counts + smooth) - below
    own = np.log10(model.counts / np.maximum(inside[model.classes], 1)) if len(model.words) else np.zeros(0)

    def scan(batches):
        for (rids,), texts in chunks(batches, ("rid",)):
            values, bounds = tokens(texts)
            ids = model.ids(values)
            kinds, rows = model.features(values, ids, bounds)
            chance = np.empty(len(values))
            for at in range(0, len(values), BATCH):
                p = model.chances(rows[:, at : at + BATCH])
                chance[at : at + BATCH] = np.log10(np.maximum(p[np.arange(len(p)), kinds[at : at + BATCH]].astype(np.float64), 1e-30))
            known = ids >= 0
            flat = np.where(known, base[ids], 0) if len(base) else np.zeros(len(ids))
            inner = np.where(known, own[ids], 0) if len(base) else flat
            begin = bounds[:-1]
            rare = [np.unique(values[a:b][~known[a:b]], return_counts=True) for a, b in zip(bounds[:-1], bounds[1:])]
            ends = np.concatenate(([0], np.cumsum([len(r[0]) for r in rare]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(np.concatenate([r[0] for r in rare]).view(np.int64)), pa.array(np.concatenate([r[1] for r in rare]).astype(np.int64))], names=["h", "n"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rids), pa.array(np.diff(bounds)), pa.array(np.add.reduceat(known.astype(np.int64), begin)), pa.array(np.add.reduceat(flat, begin)), pa.array(np.add.reduceat(chance + inner, begin)), lists],
                names=["rid", "n_tokens", "known", "base", "model", "rare"],
            )

    scored = settle(docs.select("rid", "text").mapInArrow(scan, "rid long, n_tokens long, known long, base double, model double, rare array<struct<h: long, n: long>>"))
    rare = scored.select("rid", F.explode("rare").alias("r")).select("rid", "r.h", "r.n").join(counts, "h", "left")
    rare = rare.groupBy("rid").agg(
        F.sum("n").alias("rare_n"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(smooth))).alias("weight"),
    )
    some = lambda c: F.coalesce(c, F.lit(0))
    return docs.select("rid", "id").join(scored.drop("rare"), "rid").join(rare, "rid", "left").select(
        "rid", "id", "n_tokens", (F.col("known") + some("rare_known")).alias("n_known"),
        (F.col("base") + some("weight") - some("rare_n") * F.lit(float(below))).alias("base_score"),
        (F.col("model") + some("weight") - some("rare_n") * F.lit(float(below_rare))).alias("score"),
    )


def fit_and_score(docs: DataFrame, is_held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on rows without ``is_held_out``, score every row: ``rid``, the id, ``held_out, n_tokens, n_known, train_tokens, base_score, score``.

    A null text counts as empty and has its end as only token. Rows with equal ids are separate. Without any training row all words are unknown
    and the model's score uses its even start. Words are told apart by 64-bit fingerprints, those of up to eight bytes exactly. A very long text is
    one part of its own; other columns are not read, whatever their names; an empty table gives no rows.
    """
    source = numbered(docs, F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(is_held_out, F.lit(False)).alias("held"))
    learn = source.filter("NOT held")
    counts = settle(count_tokens(learn))
    model = vocabulary(counts)
    model.classes = cluster(model, neighbours(learn, model))
    model.weights = train(learn, model)
    flags = source.select(F.col("rid").alias("flag_rid"), F.col("held").alias("held_out"))
    return score(source, model, counts).join(flags, F.col("rid") == F.col("flag_rid")).select(
        "rid", F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op3_maxent_lm_scoring(spark, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    return fit_and_score(table(spark, sf_dir, "documents"), held).drop("rid")
