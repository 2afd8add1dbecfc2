"""Embeddings, exact and approximate nearest neighbours, name search and entity resolution."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from procweave.functions import fixed
from procweave.functions.text import col, null_if_blank, or_blank
from procweave.operators.grid import cells, meet_each_other
from procweave.operators.ordered import first_per_key, top_per_key
from procweave.session import settle

SCORE_DIGITS = 9


def embed(df: DataFrame, text: str, dim: int = 1536, out: str = "embedding") -> DataFrame:
    """Deterministic default embedding: hashed word counts of unit length, computed in the JVM."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = F.filter(F.split(F.lower(or_blank(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    counted = HashingTF(numFeatures=dim, inputCol="__words", outputCol="__tf").transform(df.withColumn("__words", words))
    unit = Normalizer(p=2.0, inputCol="__tf", outputCol="__unit").transform(counted)
    return unit.withColumn(out, vector_to_array("__unit", "float32")).drop("__words", "__tf", "__unit")


def embed_with(
    df: DataFrame,
    text: str,
    fn: Callable[[list[str]], Sequence[Sequence[float]]],
    batch: int = 50,
    out: str = "embedding",
) -> DataFrame:
    """Embedding by a caller's function over lists of at most ``batch`` texts."""

    @F.pandas_udf("array<double>")
    def apply(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            vectors: list[Sequence[float]] = []
            for at in range(0, len(texts), batch):
                vectors.extend(fn(texts.iloc[at : at + batch].fillna("").tolist()))
            yield pd.Series([list(map(float, v)) for v in vectors], index=texts.index)

    return df.withColumn(out, apply(F.col(text)))


def dot(left: Column | str, right: Column | str) -> Column:
    products = F.zip_with(col(left), col(right), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column | str) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine(left: Column | str, right: Column | str, left_norm: Column | None = None, right_norm: Column | None = None) -> Column:
    """Dot product over norms, 0 for a zero vector; stored norms are used when given."""
    size = (left_norm if left_norm is not None else norm(left)) * (right_norm if right_norm is not None else norm(right))
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(left, right) / size)


#: Components of the vectors of a block, rows that meet a block at once, and pairs whose cosines are summed at once.
BLOCK_VALUES, TILE, PAIRS = 1 << 22, 512, 1 << 16


def _blocks(vectors: DataFrame, block_rows: int | None) -> int:
    """Blocks of about ``block_rows`` vectors, or of ``BLOCK_VALUES`` components; small inputs give more than one task as well."""
    rows, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    return max(1, -(-rows // (block_rows or max(256, BLOCK_VALUES // max(1, width or 1)))), min(8, rows // 1024))


class _Vectors:
    """Vectors of a column in full and, for bounds, in single precision and of unit length."""

    def __init__(self, column: pa.ChunkedArray) -> None:
        self.full = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
        self.sizes = np.sqrt(self._summed(self.full, self.full))
        with np.errstate(all="ignore"):
            self.unit = np.divide(self.full, self.sizes[:, None], out=np.zeros_like(self.full), where=self.sizes[:, None] != 0).astype(np.float32)
        #: What rounding in single precision may take from a cosine.
        self.slack = (self.full.shape[1] + 8) * 2.0**-22 + 10.0**-SCORE_DIGITS

    @staticmethod
    def _summed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Dot products, summed in the order of the components as ``dot`` does."""
        out = np.zeros(len(x))
        for d in range(x.shape[1]):
            out += x[:, d] * y[:, d]
        return out

    def cosines(self, i: np.ndarray, other: _Vectors, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i))
        for k in range(0, len(i), PAIRS):
            a, b = i[k : k + PAIRS], j[k : k + PAIRS]
            size = self.sizes[a] * other.sizes[b]
            np.divide(self._summed(self.full[a], other.full[b]), size, out=out[k : k + PAIRS], where=size != 0)
        return out

    def near(self, other: _Vectors, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the pairs that may reach ``threshold``."""
        for at in range(0, len(self.unit), TILE):
            for to in range(0, len(other.unit), 8 * TILE):
                i, j = np.nonzero(self.unit[at : at + TILE] @ other.unit[to : to + 8 * TILE].T >= threshold - self.slack)
                yield i + at, j + to


class _Slice(_Vectors):
    """Rows of ``vectors`` from ``begin`` to ``end``."""

    def __init__(self, vectors: _Vectors, begin: int, end: int) -> None:
        self.full, self.sizes, self.unit, self.slack = vectors.full[begin:end], vectors.sizes[begin:end], vectors.unit[begin:end], vectors.slack


def _meet(left: DataFrame, right: DataFrame, block_rows: int | None) -> DataFrame:
    """Rows (``cell, side, id, embedding``) of every block of ``left`` (side 0) with every block of ``right`` (side 1), both (id, embedding), sorted by cell."""
    left, right = (d.where("embedding IS NOT NULL") for d in (left, right))
    l_blocks, r_blocks = _blocks(left, block_rows), _blocks(right, block_rows)
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    sides = (
        left.select(deal(l_blocks).alias("row"), every(r_blocks).alias("col"), F.lit(0).alias("side"), "id", "embedding"),
        right.select(every(l_blocks).alias("row"), deal(r_blocks).alias("col"), F.lit(1).alias("side"), "id", "embedding"),
    )
    dealt = sides[0].unionByName(sides[1]).select((F.col("row") * r_blocks + F.col("col")).alias("cell"), "side", "id", "embedding")
    return dealt.repartition(l_blocks * r_blocks, "cell").sortWithinPartitions("cell")


def _sides(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    return tuple(table.filter(pc.equal(table.column("side"), n)) for n in (0, 1))


def _best_near(table: pa.Table, k: int, skip_same_id: bool) -> Iterator[pa.RecordBatch]:
    """Best ``k`` rows of side 1 of each row of side 0."""
    q, c = _sides(table)
    if not len(q) or not len(c):
        return
    # Rows of side 1 are in id order, so a stable sort leaves ties to the smaller id.
    c = c.take(pc.sort_indices(c.column("id"), null_placement="at_start"))
    asked, known = _Vectors(q.column("embedding")), _Vectors(c.column("embedding"))
    q_id, c_id = (t.column("id").combine_chunks() for t in (q, c))
    q_ids, c_ids = (x.to_numpy(zero_copy_only=False) for x in (q_id, c_id))
    odd = ~np.isfinite(known.unit).all(axis=1)
    for at in range(0, len(q), TILE // 2):
        scores = asked.unit[at : at + TILE // 2] @ known.unit.T
        scores[:, odd] = -np.inf
        if skip_same_id:
            scores[q_ids[at : at + TILE // 2, None] == c_ids[None, :]] = -np.inf
        # The k-th best of the groups' best ones is a score that k rows reach.
        most = np.maximum.reduceat(scores, np.arange(0, len(c), 32), axis=1) if len(c) > 64 * k else scores
        bar = np.partition(most, most.shape[1] - k, axis=1)[:, most.shape[1] - k] if most.shape[1] > k else np.full(len(scores), -np.inf)
        i, j = np.nonzero((scores >= bar[:, None] - 2 * asked.slack) & (scores > -np.inf))
        found = np.round(asked.cosines(i + at, known, j), SCORE_DIGITS)
        order = np.lexsort((j, -found, i))
        i, j, found = i[order], j[order], found[order]
        first = np.searchsorted(i, i)
        kept = (np.arange(len(i)) - first < k) & np.isfinite(found)
        yield pa.RecordBatch.from_arrays([q_id.take(pa.array(i[kept] + at)), c_id.take(pa.array(j[kept])), pa.array(found[kept])], names=["query_id", "chunk_id", "score"])


def top_k_similar(
    queries: DataFrame, chunks: DataFrame, k: int = 5, block_rows: int | None = None, skip_same_id: bool = False
) -> DataFrame:
    """Exact ``k`` nearest chunks of every query by cosine, for any number of both.

    Inputs are (query_id, embedding) and (chunk_id, embedding); rows without an embedding are near to none. Both sides are dealt by hash
    into blocks of about ``block_rows`` rows; a grid cell multiplies one block of queries with one block
    of chunks and keeps its best ``k`` per query, so no list of all pairs is ever formed. Products in single precision tell which pairs are
    worth an exact cosine. Only the cells' best rows are shuffled for the final ranking. Ties go to the smaller chunk id.
    """
    q_type, c_type = queries.schema["query_id"].dataType, chunks.schema["chunk_id"].dataType
    # Ids of both sides share a column.
    wide = F.col("query_id") if q_type == c_type else F.col("query_id").cast(c_type)
    met = _meet(queries.select(wide.alias("id"), "embedding"), chunks.select(F.col("chunk_id").alias("id"), "embedding"), block_rows)

    def best(batches):
        for table in cells(batches):
            yield from _best_near(table, k, skip_same_id)

    kind = c_type.simpleString()
    found = met.mapInArrow(best, f"query_id {kind}, chunk_id {kind}, score double").withColumn("query_id", F.col("query_id").cast(q_type))
    return top_per_key(found, ["query_id"], [F.desc("score"), "chunk_id"], k, "rank")


def vector_copies(vectors: DataFrame) -> DataFrame:
    """Each id with the smallest id that has the same vector: (id, rep_id)."""
    keyed = vectors.select("id", F.xxhash64("embedding").alias("__h1"), F.md5(F.col("embedding").cast("string")).alias("__h2"))
    reps = keyed.groupBy("__h1", "__h2").agg(F.min("id").alias("rep_id"))
    return keyed.join(reps, ["__h1", "__h2"]).select("id", "rep_id")


def bands_for(threshold: float, recall: float, bits: int) -> int:
    """Bands after which a pair at the threshold has met with probability ``recall``: a plane parts two vectors with the share of their angle."""
    meet = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** bits
    return max(1, int(np.ceil(np.log1p(-recall) / np.log1p(-meet)))) if meet < 1 else 1


#: Vectors of a bucket that meet as one block.
BUCKET_ROWS = 4_096


def _alike(table: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs of a cell's rows (``side, id, embedding``) near ``threshold`` or above it: ``left_id, right_id, raw``. Rows with ``band`` and ``keys`` count
    in the first band in which they meet.

    Rows of side 0 meet one another, those of side 1 meet side 2. The cosine of a pair is summed in the order of the components, as ``cosine`` does.
    """
    side = table.column("side").to_numpy()
    table = table.take(np.argsort(side, kind="stable"))
    vectors, ids, kind = _Vectors(table.column("embedding")), table.column("id").to_numpy(), table.schema.field("id").type
    if "keys" in table.column_names:
        band, keys = table.column("band")[0].as_py(), table.column("keys").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    near, alone = int((side < 2).sum()), not side.any()
    part = lambda a, b: _Slice(vectors, a, b)
    for at in range(0, near, TILE):
        first = at if alone else near
        for i, j in part(at, min(at + TILE, near)).near(part(first, len(ids)), threshold):
            i, j = i + at, j + first
            keep = (i < j) & (ids[i] != ids[j])
            i, j = i[keep], j[keep]
            for k in range(0, len(i), PAIRS):
                a, b = i[k : k + PAIRS], j[k : k + PAIRS]
                if "keys" in table.column_names:
                    new = (keys[a] == keys[b]).argmax(axis=1) == band
                    a, b = a[new], b[new]
                swap = ids[a] > ids[b]
                ends = [pa.array(ids[np.where(swap, x, y)], kind) for x, y in ((b, a), (a, b))]
                yield pa.RecordBatch.from_arrays([*ends, pa.array(vectors.cosines(a, vectors, b))], names=["left_id", "right_id", "raw"])


def ann_join(
    vectors: DataFrame, threshold: float, bands: int | None = None, bits: int = 10, seed: int = 7, recall: float = 1.0, bucket_rows: int | None = None
) -> DataFrame:
    """Pairs of (id, embedding) rows of different ids with cosine of at least ``threshold``: all of them, or with ``bands`` or a lower ``recall`` those
    that share a key.

    All pairs are found in a grid of blocks that meet two by two. For keys, signs of random projections are cut into keys of ``bits`` bits, in as many ``bands``
    as ``recall`` needs at the threshold unless given; vectors that share a key are compared exactly, where they meet, and a pair counts in the first
    band in which it meets. Large buckets are dealt in blocks of about ``bucket_rows`` that meet two by two. Where buckets would compare more
    pairs than there are, the grid is taken. A pair that is not alike is never a row. ``recall_of`` measures what is found.
    """
    vectors = vectors.where("id IS NOT NULL AND embedding IS NOT NULL").select("id", "embedding")
    if bands is None:
        bands = bands_for(threshold, recall, bits) if recall < 1 else 1 << bits
    kind = vectors.schema["id"].dataType.simpleString()
    found = (_all_alike if bands >= 1 << bits else _alike_by_keys)(vectors, threshold, bands, bits, seed, bucket_rows, f"left_id {kind}, right_id {kind}, raw double")
    return found.select("left_id", "right_id", F.round("raw", SCORE_DIGITS).alias("score")).where(F.col("score") >= threshold)


def _all_alike(vectors: DataFrame, threshold: float, bands: int, bits: int, seed: int, block_rows: int | None, out: str) -> DataFrame:
    blocks = _blocks(vectors, block_rows)
    met = meet_each_other(vectors, "id", blocks)

    def compare(batches):
        for table in cells(batches):
            yield from _alike(table, threshold)

    return met.mapInArrow(compare, out)


def _alike_by_keys(vectors: DataFrame, threshold: float, bands: int, bits: int, seed: int, bucket_rows: int | None, out: str) -> DataFrame:
    bucket_rows = bucket_rows or BUCKET_ROWS
    weights = (1 << np.arange(bits)).astype(np.int64)

    @F.pandas_udf("array<short>" if bits < 16 else "array<long>")
    def band_keys(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        planes = None
        for batch in parts:
            if not len(batch):
                yield pd.Series([], dtype=object)
                continue
            m = np.stack([np.asarray(v, dtype=np.float64) for v in batch])
            if planes is None:
                planes = np.random.default_rng(seed).standard_normal((m.shape[1], bands * bits))
            signs = (m @ planes > 0).reshape(len(m), bands, bits)
            yield pd.Series(list((signs @ weights).astype(np.int16 if bits < 16 else np.int64)))

    keyed = settle(vectors.select("id", "embedding", band_keys("embedding").alias("keys")))
    met = keyed.select("id", "embedding", "keys", F.posexplode("keys").alias("band", "key"))
    sizes = keyed.select(F.posexplode("keys").alias("band", "key")).groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows)
    # Large buckets only: at most the number of bands for every ``bucket_rows`` vectors.
    large = F.broadcast(sizes.select("band", "key", F.ceil(F.col("n") / bucket_rows).alias("blocks")))
    dealt = met.join(large, ["band", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    buckets = dealt.select("band", "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), side.alias("side"), "id", "embedding", "keys")
    ends = pa.schema([("left_id", to_arrow_type(vectors.schema["id"].dataType)), ("right_id", to_arrow_type(vectors.schema["id"].dataType)), ("raw", pa.float64())])
    alike = lambda table: pa.Table.from_batches(_alike(table, threshold), ends)
    return buckets.groupBy("band", "key", "lo", "hi").applyInArrow(alike, out)


def exact_links(queries: DataFrame, vectors: DataFrame, threshold: float, block_rows: int | None = None) -> DataFrame:
    """All (id, partner_id, score) of the vectors in ``queries`` with others at ``threshold`` or more, both (id, embedding).

    Blocks of queries meet blocks of vectors, and a block's comparisons with the whole table are one product per cell.
    """

    def linked(batches):
        for table in cells(batches):
            q, c = _sides(table)
            if not len(q) or not len(c):
                continue
            a, b = (_Vectors(t.column("embedding")) for t in (q, c))
            ids, partners = (t.column("id").to_numpy() for t in (q, c))
            for i, j in a.near(b, threshold):
                score = np.round(a.cosines(i, b, j), SCORE_DIGITS)
                kept = (score >= threshold) & (ids[i] != partners[j])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, table.schema.field("id").type) for x in (ids[i[kept]], partners[j[kept]])] + [pa.array(score[kept])], names=["id", "partner_id", "score"]
                )

    kind = vectors.schema["id"].dataType.simpleString()
    return _meet(queries.select("id", "embedding"), vectors.select("id", "embedding"), block_rows).mapInArrow(linked, f"id {kind}, partner_id {kind}, score double")


def recall_of(found: DataFrame, vectors: DataFrame, threshold: float, drawn: Column) -> DataFrame:
    """What an approximate join found of the links of the ``drawn`` vectors: ``id, n_exact, n_found`` per drawn vector.

    ``found`` is the result of ``ann_join`` on ``vectors``. Both sides are counted among distinct vectors.
    """
    copies = vector_copies(vectors)
    distinct = settle(vectors.join(copies.where("id = rep_id").select("id"), "id", "left_semi"))
    queries = distinct.where(drawn)
    exact = settle(exact_links(queries, distinct, threshold))
    pair = F.array(F.struct(F.col("left_id").alias("id"), F.col("right_id").alias("partner_id")), F.struct(F.col("right_id").alias("id"), F.col("left_id").alias("partner_id")))
    both = found.select(F.explode(pair).alias("p")).select("p.id", "p.partner_id").withColumn("hit", F.lit(1)).distinct()
    counted = exact.join(both, ["id", "partner_id"], "left").groupBy("id").agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return queries.select("id").join(counted, "id", "left").select("id", zero("n_exact"), zero("n_found"))


def _words(text: Column | str) -> Column:
    return F.filter(F.split(F.lower(or_blank(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def name_index(entities: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Token table (token, entity_id, tf, df, n) of (entity_id, text): the index behind name search, or its part for the words of
    ``queries`` (text), which are sorted out before anything is counted."""
    said = entities.select("entity_id", F.explode(_words("text")).alias("token"))
    if queries is not None:
        said = said.join(queries.select(F.explode(_words("text")).alias("token")).distinct(), "token", "left_semi")
    # Read for the frequencies and for the postings themselves: texts are taken apart once.
    postings = settle(said.groupBy("token", "entity_id").agg(F.count(F.lit(1)).alias("tf")))
    frequency = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    # A global aggregate is one row, so it can always be broadcast.
    total = entities.agg(F.count(F.lit(1)).alias("n")).withColumn("__one", F.lit(1))
    return postings.join(frequency.withColumn("__one", F.lit(1)).join(F.broadcast(total), "__one").drop("__one"), "token")


#: Postings of a cell, and words of the queries that meet them there.
POSTINGS_PER_PART, TERMS_PER_BLOCK = 400_000, 50_000
#: What rounding of sums may take from a bound.
SLACK = 1e-6


def term_bounds(terms: DataFrame, postings: DataFrame, limit: int) -> DataFrame:
    """Query terms with what they can add: ``top`` (largest impact of the word), ``bar`` (a score that ``limit`` entities reach by one
    word alone, so the query's last hit reaches it too), ``rest`` (what the words from this one on, in falling order of ``top``, add at
    most) and ``leads`` (entities that hold only words without it stay below the bar)."""
    best = top_per_key(postings, ["token"], [F.desc("impact"), "entity_id"], limit, "rank")
    each = best.groupBy("token").agg(F.max("impact").alias("top"), F.when(F.count(F.lit(1)) >= limit, F.min("impact")).otherwise(0.0).alias("kth"), F.first("df").alias("df"))
    down = Window.partitionBy("query_id").orderBy(F.desc("top"), "token")
    known = terms.join(each, "token").select(
        "query_id", "token", "df", "top", F.max("kth").over(Window.partitionBy("query_id")).alias("bar"),
        F.sum("top").over(down.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
    )
    return known.withColumn("leads", F.col("rest") >= F.col("bar") - SLACK)


def _best_in_cell(terms: pa.Table, postings: pa.Table, limit: int) -> pa.Table:
    """Sums of impacts ``query_id, entity_id, s`` that may be among a query's best ``limit``: its best ones of the cell, with what rounding could raise to them.

    Of entities with one and the same sum the smallest ids are enough.
    """
    words = pa.concat_arrays([terms.column("token").combine_chunks(), postings.column("token").combine_chunks()]).dictionary_encode()
    word, width = words.indices.to_numpy(), len(words.dictionary)
    queries = terms.column("query_id").combine_chunks().dictionary_encode()
    entities = postings.column("entity_id").combine_chunks().dictionary_encode(null_encoding="encode")
    place = np.empty(len(entities.dictionary), np.int64)
    place[pc.sort_indices(entities.dictionary, null_placement="at_start").to_numpy()] = np.arange(len(place))
    order = np.argsort(word[len(terms) :], kind="stable")
    at = np.concatenate(([0], np.cumsum(np.bincount(word[len(terms) :], minlength=width))))
    entity, impact = entities.indices.to_numpy()[order], postings.column("impact").to_numpy()[order]
    asked, bars = queries.indices.to_numpy(), terms.column("bar").to_numpy()
    by_query = np.lexsort((word[: len(terms)], asked))
    ends = np.concatenate(([0], np.cumsum(np.bincount(asked, minlength=len(queries.dictionary)))))
    found_q, found_e, sums = [], [], []
    for q in range(len(queries.dictionary)):
        mine = by_query[ends[q] : ends[q + 1]]
        parts = [slice(at[w], at[w + 1]) for w in word[mine]]
        hit, add = np.concatenate([entity[x] for x in parts]), np.concatenate([impact[x] for x in parts])
        if not len(hit):
            continue
        if len(hit) * 8 < len(place):
            those, hit = np.unique(hit, return_inverse=True)
            total = np.bincount(hit, weights=add)
        else:
            total = np.bincount(hit, weights=add, minlength=len(place))
            those = np.nonzero(total)[0]
            total = total[those]
        low = bars[mine[0]]
        if len(total) > limit:
            low = max(low, np.partition(total, len(total) - limit)[len(total) - limit])
        near = total >= low - 2 * SLACK
        those, total = those[near], total[near]
        best = np.lexsort((place[those], -total))
        those, total = those[best], total[best]
        first = np.concatenate(([0], np.nonzero(np.diff(total))[0] + 1))
        kept = np.arange(len(total)) - np.repeat(first, np.diff(np.append(first, len(total)))) < limit
        found_q.append(np.full(int(kept.sum()), q))
        found_e.append(those[kept])
        sums.append(total[kept])
    pick = lambda parts: pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64), pa.int64())
    return pa.table({
        "query_id": queries.dictionary.take(pick(found_q)), "entity_id": entities.dictionary.take(pick(found_e)),
        "s": pa.array(np.concatenate(sums) if sums else np.empty(0), pa.float64()),
    })


def search_names(queries: DataFrame, index: DataFrame, limit: int = fixed.NAME_CANDIDATES, part_rows: int = POSTINGS_PER_PART) -> DataFrame:
    """Best ``limit`` entities of each (query_id, text) by summed tf-idf of the shared words.

    Entities are dealt in cells of about ``part_rows`` postings, which meet the queries in blocks. A cell sums the impacts of all its
    entities and gives the best of each query only, above the query's bar (see ``term_bounds``), so pairs of queries and entities are no
    rows and no task holds all of a frequent word. No hit is missed: scores are full sums.
    """
    terms = settle(queries.where("query_id IS NOT NULL").select("query_id", F.explode(F.array_distinct(_words("text"))).alias("token")))
    # Words of the queries only; the index may be many times larger.
    asked = index.join(terms.select("token").distinct(), "token", "left_semi")
    postings = settle(asked.select("token", "entity_id", (F.col("tf") * F.log1p(F.col("n") / F.col("df"))).alias("impact"), "df"))
    bounded = settle(term_bounds(terms, postings, limit).select("query_id", "token", "bar"))
    cells, blocks = (max(1, -(-d.count() // n)) for d, n in ((postings, part_rows), (bounded, TERMS_PER_BLOCK)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = bounded.select("query_id", "token", "bar", deal("query_id", blocks).alias("block"), every(cells).alias("cell"))
    right = postings.select("token", "entity_id", "impact", deal("entity_id", cells).alias("cell"), every(blocks).alias("block"))

    def cell(t: pa.Table, p: pa.Table) -> pa.Table:
        return _best_in_cell(t, p, limit)

    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, entity_id {index.schema['entity_id'].dataType.simpleString()}, s double"
    # As many partitions as cells: a cell is worth a task, small as its rows are when compressed.
    dealt = (d.repartition(cells * blocks, "cell", "block") for d in (left, right))
    met = (d.groupBy("cell", "block") for d in dealt)
    found = next(met).cogroup(next(met)).applyInArrow(cell, kinds)
    scored = found.select("query_id", "entity_id", F.round("s", 6).alias("score"))
    return top_per_key(scored, ["query_id"], [F.desc("score"), "entity_id"], limit, "rank")


def resolve(
    entities: DataFrame,
    store: DataFrame,
    merge_at: float = fixed.MERGE_AT,
    review_at: float = fixed.REVIEW_AT,
    candidates: int = fixed.NAME_CANDIDATES,
) -> DataFrame:
    """Match each new entity to the store: name search finds candidates, cosine picks the best.

    Inputs are (entity_id, text, embedding). The action is merge, review or create; an entity
    without candidates is created.
    """
    found = settle(search_names(
        entities.select(F.col("entity_id").alias("query_id"), "text"), name_index(store.select("entity_id", "text"), entities), candidates
    ).select(F.col("query_id").alias("new_id"), F.col("entity_id").alias("match_id")))
    new = entities.select(F.col("entity_id").alias("new_id"), F.col("embedding").alias("__a"))
    # An embedding that is an expression is worked out for candidates only.
    met = store.join(found.select(F.col("match_id").alias("entity_id")).distinct(), "entity_id", "left_semi")
    old = met.select(F.col("entity_id").alias("match_id"), F.col("embedding").alias("__b"))
    scored = (
        found.join(new, "new_id").join(old, "match_id")
        .select("new_id", "match_id", F.round(cosine("__a", "__b"), 6).alias("score"))
    )
    best = first_per_key(scored, ["new_id"], [F.desc("score"), "match_id"])
    joined = entities.select(F.col("entity_id").alias("new_id")).join(best, "new_id", "left")
    action = (
        F.when(F.col("score") >= merge_at, "merge").when(F.col("score") >= review_at, "review").otherwise("create")
    )
    return joined.select("new_id", "match_id", "score", action.alias("action"))


def resolve_or_create(resolved: DataFrame) -> DataFrame:
    """Merge gives the existing id; review and create give none, review is marked pending."""
    return resolved.select(
        "new_id",
        F.when(F.col("action") == "merge", F.col("match_id")).alias("existing_id"),
        (F.col("action") == "review").alias("pending"),
    )


def review_questions(resolved: DataFrame, entity_type: str, created_at: Column) -> DataFrame:
    """Open question rows for the matches that need a person."""
    return resolved.where("action = 'review'").select(
        F.concat(F.lit("review:"), F.col("new_id").cast("string")).alias("amb_id"),
        F.lit(entity_type).alias("entity_type"),
        F.col("new_id").cast("string").alias("entity_id"),
        F.concat(F.lit("same as "), F.col("match_id").cast("string"), F.lit("?")).alias("question"),
        F.array(F.lit("merge"), F.lit("create")).alias("options"),
        F.lit("open").alias("status"),
        F.lit(None).cast("string").alias("answer"),
        created_at.alias("created_at"),
    )


def semantic_search(queries: DataFrame, chunks: DataFrame, supported_by: DataFrame, k: int = 10, types: Sequence[str] | None = None) -> DataFrame:
    """Top ``k`` entities per query through the ``2k`` nearest chunks that support them.

    ``supported_by`` holds (entity_type, entity_id, chunk_id).
    """
    near = top_k_similar(queries, chunks, 2 * k).drop("rank")
    links = supported_by if types is None else supported_by.where(F.col("entity_type").isin(list(types)))
    best = near.join(links, "chunk_id").groupBy("query_id", "entity_type", "entity_id").agg(F.max("score").alias("score"))
    return top_per_key(best, ["query_id"], [F.desc("score"), "entity_type", "entity_id"], k, "rank")


def type_text(kind: str, row: dict[str, str]) -> Column:
    """Searched text of an entity type: name and description, or the fields that stand for them."""
    fields = {
        "task": ["name", "description", "instruction"],
        "role": ["name", "org_unit"],
        "agent": ["name", "role"],
        "skill": ["name", "summary"],
    }.get(kind, ["name", "description"])
    return F.concat_ws(" ", *[null_if_blank(row.get(f, f)) for f in fields])
