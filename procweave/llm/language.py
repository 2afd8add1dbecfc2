"""Language identification by a small byte convolutional network, in numpy.

Bytes are folded to 64 symbols (A-Z as a-z, digits, blanks, punctuation, bytes of other letters). Filters of several widths
run over windows of fixed length; each filter's largest answer in a window goes to a softmax over the languages. A text is cut
into windows as a whole and its windows vote, weighted by the letters they hold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procweave.llm.common import bounded, fresh, table

WINDOW, WIDTHS, FILTERS = 128, (2, 3, 4), 16
LETTER = np.zeros(256, bool)
SYMBOL = np.full(256, 29, np.uint8)
for _b in range(256):
    if chr(_b).isascii() and chr(_b).isalpha():
        SYMBOL[_b], LETTER[_b] = ord(chr(_b).lower()) - 96, True
    elif _b >= 128:
        SYMBOL[_b], LETTER[_b] = 32 + (_b & 31), True
    elif 48 <= _b < 58:
        SYMBOL[_b] = 27
    elif _b in b" \t\n\r\x0b\x0c":
        SYMBOL[_b] = 28
SYMBOL[0] = 0


@dataclass
class Model:
    """Filter weights by width (width, 64, FILTERS), their biases, and the softmax layer."""

    languages: list[str]
    filters: list[np.ndarray]
    biases: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, symbols: np.ndarray) -> np.ndarray:
        """Largest answer of every filter in each row of ``symbols`` (windows, WINDOW)."""
        pairs = (symbols[:, :-1].astype(np.int32) << 6) | symbols[:, 1:]
        best = []
        for width, w in zip(WIDTHS, self.filters):
            # Two symbols are looked up at once: a table of their summed weights.
            tables = [(w[j][:, None, :] + w[j + 1][None, :, :]).reshape(4096, -1) for j in range(0, width - 1, 2)]
            count = WINDOW - width + 1
            answer = np.take(tables[0], pairs[:, :count], axis=0)
            for i, t in enumerate(tables[1:], 1):
                answer += np.take(t, pairs[:, 2 * i : 2 * i + count], axis=0)
            if width % 2:
                answer += np.take(w[width - 1], symbols[:, width - 1 :], axis=0)
            best.append(answer.max(axis=1))
        return np.maximum(np.concatenate(best, axis=1) + self.biases, 0)

    def probabilities(self, symbols: np.ndarray) -> np.ndarray:
        return softmax(self.pooled(symbols) @ self.out + self.out_bias)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all windows, the letters in each, and the number of windows of each text (the last is filled up)."""
    counts = [-(-len(t) // WINDOW) for t in texts]
    data = np.frombuffer(b"".join(t.ljust(n * WINDOW, b"\0") for t, n in zip(texts, counts)), np.uint8).reshape(-1, WINDOW)
    return SYMBOL[data], LETTER[data].sum(axis=1), np.array(counts, np.int64)


def fit(samples: list[bytes], labels: list[str], epochs: int = 4, batch: int = 256, rate: float = 0.01, seed: int = 0) -> Model | None:
    """Train on text samples, each read as one window; ``None`` without samples."""
    if not samples:
        return None
    languages = sorted(set(labels))
    target = np.searchsorted(languages, labels)
    symbols = SYMBOL[np.frombuffer(b"".join(s[:WINDOW].ljust(WINDOW, b"\0") for s in samples), np.uint8).reshape(-1, WINDOW)]
    rng = np.random.default_rng(seed)
    total = FILTERS * len(WIDTHS)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    model = Model(languages, [draw(w, 64, FILTERS) for w in WIDTHS], np.zeros(total, np.float32), draw(total, len(languages)), np.zeros(len(languages), np.float32))
    values = [*model.filters, model.biases, model.out, model.out_bias]
    means, squares, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for _ in range(epochs):
        order = rng.permutation(len(samples))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x, y, n = symbols[rows], target[rows], len(rows)
            peaks, tops = [], []
            for width, w in zip(WIDTHS, model.filters):
                count = WINDOW - width + 1
                answer = sum(w[j][x[:, j : j + count]] for j in range(width))
                peaks.append(answer.argmax(axis=1))
                tops.append(np.take_along_axis(answer, peaks[-1][:, None, :], 1)[:, 0])
            raw = np.concatenate(tops, axis=1) + model.biases
            hidden = np.maximum(raw, 0)
            error = softmax(hidden @ model.out + model.out_bias)
            error[np.arange(n), y] -= 1
            error /= n
            back = (error @ model.out.T) * (raw > 0)
            gradients = []
            for i, width in enumerate(WIDTHS):
                part, grad = back[:, i * FILTERS : (i + 1) * FILTERS], np.zeros_like(model.filters[i])
                lane = np.broadcast_to(np.arange(FILTERS), part.shape)
                for j in range(width):
                    np.add.at(grad[j], (x[np.arange(n)[:, None], peaks[i] + j], lane), part)
                gradients.append(grad)
            gradients += [back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]
            step += 1
            # Adam.
            for v, g, m, s in zip(values, gradients, means, squares):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return model


def has_letter(text_col: str):
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order_col: str = "doc_id", per_language: int = 800, parts: int = 4, max_documents: int = 20_000, max_languages: int = 1000) -> Model | None:
    """A model from a bounded sample: of each of the ``max_languages`` most frequent languages ``per_language`` documents at
    most (``max_documents`` in all), the first by a hash, and of each ``parts`` windows spread over the whole text. Rows without
    text, letters or language are not used."""
    places = F.array(*[F.expr(f"substring(text, CAST(1 + greatest(0, length(text) - {WINDOW}) * {k / max(1, parts - 1)} AS INT), {WINDOW})") for k in range(parts)])
    usable = docs.filter(F.col(lang_col).isNotNull() & has_letter(text_col)).select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(order_col).cast("string"), text_col).alias("h"), F.col(text_col).alias("text"))
    # Only hashes below a bound that about three times the wanted number pass are ranked, so what is gathered does not grow.
    share = F.least(F.lit(1.0), F.lit(3.0 * per_language) / F.col("n"))
    counts = docs.filter(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n"))
    drawn = usable.join(F.broadcast(counts.orderBy(F.desc("n"), "lang").limit(max_languages)), "lang").filter(F.col("h") / F.lit(2.0**64) + 0.5 <= share).select("lang", "h", F.array_distinct(places).alias("samples"))
    best = drawn.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("h", "samples"))).filter(F.col("i") <= per_language)
    rows = best.orderBy("h", "lang", "samples").limit(max_documents).select("lang", "samples").collect()
    rows.sort()
    pairs = [(s.encode(), r["lang"]) for r in rows for s in r["samples"]]
    return fit([p[0] for p in pairs], [p[1] for p in pairs])


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", rows_at_once: int = 2000) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1): ``und`` and 0 for texts that are null or hold no letter, or without a model.

    Columns of ``docs`` with these names are replaced; every other column is kept. Of equal scores the first language in order wins.
    Repeated rows and null ids are judged row by row; very long texts in windows, all of them; an empty table stays empty.
    """
    docs = docs.drop("lang_pred", "score")
    bytes_name, letters_name = fresh(docs, "bytes"), fresh(docs, "letters")

    def scan(batches):
        for batch in bounded(batches, bytes_name):
            texts = batch.column(batch.schema.get_field_index(bytes_name))
            lettered = batch.column(batch.schema.get_field_index(letters_name)).to_numpy(zero_copy_only=False)
            names, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            todo = np.flatnonzero(lettered) if model else []
            held, size = [], 0
            for i in todo:
                held.append(i)
                size += len(texts[int(i)].as_py())
                if size > rows_at_once * WINDOW or i == todo[-1]:
                    data = [texts[int(j)].as_py() for j in held]
                    symbols, letters, counts = windows(data)
                    chances = np.concatenate([model.probabilities(symbols[k : k + rows_at_once]) for k in range(0, len(symbols), rows_at_once)])
                    weight = letters + 1e-6
                    begin = np.concatenate(([0], np.cumsum(counts)[:-1]))
                    mean = np.add.reduceat(chances * weight[:, None], begin) / np.add.reduceat(weight, begin)[:, None]
                    top = mean.argmax(axis=1)
                    for j, k, p in zip(held, top, mean[np.arange(len(top)), top]):
                        names[j], scores[j] = model.languages[k], min(1.0, float(p))
                    held, size = [], 0
            keep = [i for i, n in enumerate(batch.schema.names) if n not in (bytes_name, letters_name)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(names), pa.array(scores)], names=[*(batch.schema.names[i] for i in keep), "lang_pred", "score"])

    ready = docs.withColumn(bytes_name, F.col(text_col).cast("binary")).withColumn(letters_name, has_letter(text_col))
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return ready.mapInArrow(scan, schema)


def held_out(id_col: str, folds: int = 4, fold: int = 2):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(F.col("doc_id").isNotNull() & ~held_out("doc_id")))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
