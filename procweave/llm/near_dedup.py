"""MinHash near-duplicate detection with an LSH forest, and exact confirmation on the full shingle sets.

Equal sets collapse to one node first. Each of ``TREES`` trees orders the nodes by ``DEPTH`` min-hashes. Nodes that
share a prefix are a region; a region with many nodes is read at a greater depth, so depth adapts to density, and where
one region ends and the next begins in the sorted order, neighbours by longest common prefix are candidates too. Where even the full depth leaves many nodes
together, its most central node (in the most such regions) is compared with all of them.

Depth makes regions small but parts pairs. So nodes of regions with many nodes are also joined on the full sets: two sets
that are similar enough share one of their first shingles in any order that is the same for all, here rarest first. Only
pairs between components that the trees have left apart are proposed, so a group of copies gives no pairs of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procweave.llm.common import bounded, fresh, identified, numbered, settle, stable, table
from procweave.llm.components import components, extended
from procweave.llm.windows import BASE, MIX, grams, mix, symbols, word_print

TREES, DEPTH, LEAST = 32, 6, 3
#: Nodes of a region that are compared with one another; neighbours taken in larger ones; rows ordered in one block.
REGION, NEAR, BLOCK = 16, 4, 5_000
#: Counters of shingles, and postings of a shingle in one part.
COUNTERS, PART = 1 << 20, 1_024
LAST = 2**63 - 1
FACTORS = mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)
#: Words handled at once: small enough for the hash passes to stay in the processor's cache.
STEP = 1 << 16


def shingle_sets(texts: list[bytes], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and where each text begins."""
    values, bounds = symbols([t.lower() for t in texts], words=True)
    found = grams(values, k)
    sets = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= k:
            sets.append(np.unique(found[a : b - k + 1]))
        else:
            # Fewer words than a shingle: the whole sequence is the only one.
            sets.append(word_print(values[a:b]) if b > a else np.zeros(0, np.uint64))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)


def signatures(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """16 bits of every min-hash of each set; sets are not empty."""
    out, buffer = np.empty((len(bounds) - 1, len(FACTORS)), np.uint16), np.empty_like(shingles)
    for j, factor in enumerate(FACTORS):
        np.multiply(shingles, factor, out=buffer)
        out[:, j] = (mix(np.minimum.reduceat(buffer, bounds[:-1])) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """Per row of ``docs`` (rid, ord, text): set size, fingerprints of the set and its signature."""

    def scan(batches):
        for batch in bounded(batches, size=6 * STEP):
            shingles, bounds = shingle_sets(_texts(batch), k)
            sizes = np.diff(bounds)
            full = np.flatnonzero(sizes)
            a, b = (np.zeros(len(sizes), np.uint64) for _ in range(2))
            signs = [None] * len(sizes)
            if len(full):
                begin = bounds[:-1][full]
                a[full], b[full] = (np.add.reduceat(mix(shingles ^ np.uint64(c)), begin) for c in (BASE, MIX))
                for i, row in zip(full, signatures(shingles, np.append(begin, bounds[-1]))):
                    signs[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("ord"), pa.array(sizes.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(signs, pa.binary())],
                names=["rid", "ord", "n", "a", "b", "sig"],
            )

    return docs.select("rid", "ord", "text").mapInArrow(scan, "rid long, ord long, n int, a long, b long, sig binary")


def forest(nodes: DataFrame) -> DataFrame:
    """``nodes`` (node, n, sig) in every tree: ``head`` (tree and first hashes), ``rest`` (the other hashes)."""

    def grow(batches):
        for batch in batches:
            count = batch.num_rows
            if not count:
                continue
            signs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(count, TREES, DEPTH).astype(np.int64)
            head = (np.arange(TREES) << 48)[None, :] | signs[:, :, 0] << 32 | signs[:, :, 1] << 16 | signs[:, :, 2]
            rest = signs[:, :, 3] << 32 | signs[:, :, 4] << 16 | signs[:, :, 5]
            node, n = (np.repeat(batch.column(c).to_numpy(), TREES) for c in ("node", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (head.reshape(-1), rest.reshape(-1), node, n)], names=["head", "rest", "node", "n"])

    return nodes.mapInArrow(grow, "head long, rest long, node long, n int")


def _within(rows: DataFrame) -> DataFrame:
    """Pairs within regions (``head``, ``cut``) of at most REGION nodes."""
    region = rows.groupBy("head", "cut").agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("r")).filter(F.size("r") > 1)
    pairs = "flatten(transform(sequence(1, size(r) - 1), i -> transform(slice(r, i + 1, size(r)), y -> struct(r[i - 1] AS x, y AS y))))"
    return region.select(F.explode(F.expr(pairs)).alias("p")).select(F.col("p.x.node").alias("a"), F.col("p.y.node").alias("b"), F.col("p.x.n").alias("na"), F.col("p.y.n").alias("nb"))


def met(rows: DataFrame) -> DataFrame:
    """``rows`` of the trees that share their first hashes with others, with the size ``c`` of that region."""
    shared = rows.groupBy("head").agg(F.count("*").alias("c")).filter("c > 1")
    return rows.join(shared.hint("merge"), "head")


def candidates(rows: DataFrame) -> DataFrame:
    """Candidate pairs ``a < b`` of ``rows`` (see ``met``, settled) with the number of trees (and ways) that propose them."""
    few = _within(rows.filter(F.col("c") <= REGION).withColumn("cut", F.lit(0).cast("long")))
    dense = rows.filter(F.col("c") > REGION)
    # Regions are counted over their full prefixes, which copies share, and come back to the rows in one join.
    full = dense.groupBy("head", "rest").agg(F.count("*").alias(f"c{DEPTH}")).withColumn(f"q{DEPTH}", F.col("rest"))
    for depth in range(LEAST + 1, DEPTH):
        full = full.withColumn(f"q{depth}", F.shiftright("rest", 16 * (DEPTH - depth)))
        counts = full.groupBy("head", f"q{depth}").agg(F.sum(f"c{DEPTH}").alias(f"c{depth}"))
        full = full.join(counts.hint("merge"), ["head", f"q{depth}"])
    dense = dense.join(full.hint("merge"), ["head", "rest"])
    dense = settle(dense)
    deeper = range(LEAST + 1, DEPTH + 1)
    # The depth at which a row's region is small enough; none where even full depth is not.
    depth = F.coalesce(*[F.when(F.col(f"c{d}") <= REGION, F.lit(d)) for d in deeper])
    cut = F.coalesce(*[F.when(depth == d, F.col(f"q{d}")) for d in deeper])
    split = _within(dense.filter(depth.isNotNull()).withColumn("d", depth).withColumn("cut", F.when(F.col("d").isNotNull(), cut) * 8 + F.col("d")))
    # Neighbours in sorted order, within blocks of a prefix that holds a bounded number of rows.
    block = F.when(F.col("c") <= BLOCK, F.lit(0).cast("long"))
    for d in deeper:
        block = block.when(F.col(f"c{d}") <= BLOCK, F.col(f"q{d}") * 8 + d)
    block = block.otherwise(F.col("rest") * 8 + 7)
    salt = F.when(F.col(f"c{DEPTH}") > BLOCK, F.pmod(F.xxhash64("node"), F.ceil(F.col(f"c{DEPTH}") / BLOCK))).otherwise(F.lit(0).cast("long"))
    order = Window.partitionBy("head", "block", "salt").orderBy("rest", "node")
    # Nodes of one region meet in full or through its central node, so only the first one of a region looks back.
    region = F.coalesce(*[F.when(depth == d, F.col(f"q{d}") * 8 + d) for d in deeper], F.col("rest") * 8 + 7)
    near = dense.select("head", block.alias("block"), salt.alias("salt"), "rest", "node", "n", region.alias("region")).select(
        "node", "n", "region", F.lag("region").over(order).alias("last"), F.array(*[F.lag(F.struct("node", "n"), i).over(order) for i in range(1, NEAR + 1)]).alias("before")
    ).filter("region <> last").select("node", "n", F.explode("before").alias("o")).filter("o IS NOT NULL").select(F.col("o.node").alias("a"), F.col("node").alias("b"), F.col("o.n").alias("na"), F.col("n").alias("nb"))
    hot = dense.filter(F.col(f"c{DEPTH}") > REGION).select("head", "rest", "node", "n", F.col(f"c{DEPTH}").alias("size"))
    central = hot.groupBy("node").agg(F.sum("size").alias("weight"))
    pivots = hot.join(central.hint("merge"), "node").groupBy("head", "rest").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"), F.col("n").alias("na"))).alias("p"))
    stars = hot.join(pivots.hint("merge"), ["head", "rest"]).select((-F.col("p.minus")).alias("a"), F.col("node").alias("b"), F.col("p.na").alias("na"), F.col("n").alias("nb"))
    every = few.union(split).union(near).union(stars).filter("a <> b AND 4 * least(na, nb) >= 3 * greatest(na, nb)")
    return every.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("votes"))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` whose full sets (node, s) have a similarity of 0.75 or more."""
    # Sets are large and pairs may be few: one plan at every size, whose hot keys adaptive execution splits.
    left, right = (sets.select(F.col("node").alias(c), F.col("s").alias(f"s{c}")).hint("merge") for c in ("a", "b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * shared >= 75 * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def full_sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    def scan(batches):
        for batch in bounded(batches, size=6 * STEP):
            shingles, bounds = shingle_sets(_texts(batch), k)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(shingles.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("rid"), lists], names=["node", "s"])

    return docs.select("rid", "text").join(nodes.select(F.col("node").alias("rid")).hint("merge"), "rid").mapInArrow(scan, "node long, s array<long>")


def frequencies(sets: DataFrame) -> np.ndarray:
    """Counters of the shingles of all ``sets`` (node, s); a shingle's counter is given by its lowest bits."""

    def tally(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            values = batch.column("s").flatten().to_numpy(zero_copy_only=False)
            total += np.bincount(values & (COUNTERS - 1), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "c"])

    counted = sets.select("s").mapInArrow(tally, "at long, c long").groupBy("at").agg(F.sum("c").alias("c")).toPandas()
    out = np.zeros(COUNTERS, np.int32)
    out[counted["at"]] = np.minimum(counted["c"], 2**31 - 1)
    return out


def prefixes(sets: DataFrame) -> DataFrame:
    """The first shingles of each of ``sets`` (node, s, component), rarest first: ``g, at, node, n, component, short``.

    A set of n shingles meets each longer one it is similar to within its first n - 6n/7 + 1 shingles (``short``), and each shorter
    one within n - 3n/4 + 1. That holds for any order common to all sets; counters that mix shingles only cost time.
    """
    counters = sets.sparkSession.sparkContext.broadcast(frequencies(sets))

    def first(batches):
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                lists = part.column("s")
                values, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                owner = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((values, counters.value[values & (COUNTERS - 1)], owner))
                at = np.arange(len(values)) - begin[owner]
                n = sizes[owner]
                keep = at <= n - (3 * n + 3) // 4
                at, n, owner = at[keep], n[keep], owner[keep]
                columns = [values[order][keep], at.astype(np.int32), part.column("node").to_numpy()[owner], n.astype(np.int32), part.column("component").to_numpy()[owner], at <= n - (6 * n + 6) // 7]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["g", "at", "node", "n", "component", "short"])

    return sets.select("node", "s", "component").mapInArrow(first, "g long, at int, node long, n int, component long, short boolean")


def apart(sets: DataFrame) -> DataFrame:
    """All pairs ``(a, b)`` of ``sets`` (node, s, component) in different components that can be similar enough, and others."""
    rows = settle(prefixes(sets))
    # A shingle within one component proposes nothing; a frequent one is dealt in parts.
    shared = rows.groupBy("g").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.sum(F.col("short").cast("long")).alias("c"))
    shared = shared.filter("lo <> hi AND c > 0").select("g", F.ceil(F.col("c") / PART).alias("parts"))
    rows = settle(rows.join(shared.hint("merge"), "g"))
    left = rows.filter("short").select("g", F.pmod(F.xxhash64("node"), "parts").alias("part"), *[F.col(c).alias(f"x_{c}") for c in ("at", "node", "n", "component")])
    right = rows.select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), *[F.col(c).alias(f"y_{c}") for c in ("at", "node", "n", "component")])
    fits = "x_component <> y_component AND (x_n < y_n OR x_n = y_n AND x_node < y_node) AND 4L * x_n >= 3L * y_n AND 7L * least(x_n - x_at, y_n - y_at) >= 3L * (x_n + y_n)"
    return left.join(right.hint("merge"), ["g", "part"]).filter(fits).select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def links(docs: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """``node, component`` for those of ``nodes`` (node, n, sig) that have a confirmed link.

    Each node is first compared with its most proposed partner. Of the other pairs only those whose ends are still in
    different components need a comparison. Nodes of dense regions are then compared across components by ``apart``. Links found
    later join components that are already known, so each pass follows its own links only.
    """
    rows = settle(met(forest(nodes)))
    pairs = settle(candidates(rows))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = settle(full_sets(docs, ends, k))
    ways = pairs.select("votes", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("o")), F.struct(F.col("b").alias("node"), F.col("a").alias("o")))).alias("w"))
    best = ways.groupBy("w.node").agg(F.max(F.struct("votes", (-F.col("w.o")).alias("minus"))).alias("m")).select(
        F.least("node", -F.col("m.minus")).alias("a"), F.greatest("node", -F.col("m.minus")).alias("b")
    ).distinct()
    best = settle(best)
    known = components(confirmed(best, sets))
    label = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"{c}c")).hint("merge")
    open_pairs = pairs.join(best.hint("merge"), ["a", "b"], "left_anti").join(label("a"), "a", "left").join(label("b"), "b", "left")
    open_pairs = open_pairs.filter("NOT (ac <=> bc) OR ac IS NULL")
    known = extended(known, confirmed(open_pairs, sets))
    dense = settle(rows.filter(F.col("c") > REGION).select("node").distinct())
    if dense.isEmpty():
        return known
    whole = full_sets(docs, dense, k).join(known.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    whole = settle(whole.select("node", "s", "component"))
    return extended(known, confirmed(apart(whole), whole.select("node", "s")))


def near_duplicates(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``rid``, the id, ``n_shingles, component_id, kept`` and ``first`` (whether the row stays in a clean corpus).

    Two documents are linked if 100 * intersection >= 75 * union of their sets of ``k`` lower-cased words; components follow
    links. Texts that are null or without words have an empty set and link with nothing. ``component_id`` is the smallest id in the component
    (null ids count last and give null only among themselves). Rows with equal ids are separate documents; ``kept`` holds for all that
    carry the smallest id, ``first`` for one of them. A very long text is hashed as a whole, alone in its part; ties in the forest go to the smaller
    row number. Other columns are not read, whatever their names; an empty table gives no rows.
    """
    source = numbered(docs, F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("ord"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("id"))
    known = settle(sketch(source, k))
    groups = known.filter("n > 0").groupBy("n", "a", "b").agg(F.min(F.struct("ord", "rid")).alias("g"))
    groups = settle(groups.select("n", "a", "b", F.col("g.rid").alias("node"), F.col("g.ord").alias("node_ord")))
    nodes = known.select("rid", "sig").join(groups.select("node", "n").hint("merge"), F.col("rid") == F.col("node")).select("node", "n", "sig")
    component = links(source, settle(nodes), k)
    classes = groups.join(component.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = classes.groupBy("component").agg(F.min(F.struct("node_ord", "node")).alias("h"))
    classes = classes.join(heads.hint("merge"), "component").select("n", "a", "b", F.col("h.node_ord").alias("head_ord"), F.col("h.node").alias("head"))
    return (
        known.drop("sig").join(classes.hint("merge"), ["n", "a", "b"], "left")
        .join(source.select(F.col("rid").alias("source_rid"), F.col("id").alias(id_col)).hint("merge"), F.col("rid") == F.col("source_rid"))
        .select(
            "rid", id_col, F.col("n").cast("long").alias("n_shingles"),
            F.nullif(F.coalesce("head_ord", "ord"), F.lit(LAST)).alias("component_id"),
            (F.coalesce("head_ord", "ord") == F.col("ord")).alias("kept"), (F.coalesce("head", "rid") == F.col("rid")).alias("first"),
        )
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs``, all columns, that are the first of their group; documents without words all stay."""
    docs = stable(docs)
    row, copy = fresh(docs, "row"), fresh(docs, "copy")
    gone = near_duplicates(docs, **options).filter("NOT first").select(F.col("rid").alias(copy))
    return identified(docs, row).join(gone.hint("merge"), F.col(row) == F.col(copy), "left_anti").select(docs.columns)


def op10_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("rid", "first")


SQL = f"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents
),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(ws[s:s + 4], ' ') AS g
  FROM doc, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS t(s) WHERE len(ws) > 0
),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
meet AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM shingle a JOIN shingle b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
edge AS (
  SELECT x, y FROM meet JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * i >= 75 * (p.n + q.n - i)
),
way AS (SELECT x, y FROM edge UNION ALL SELECT y, x FROM edge),
reach AS (SELECT doc_id AS x, doc_id AS y FROM doc UNION SELECT r.x, w.y FROM reach r JOIN way w ON w.x = r.y)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept
FROM doc LEFT JOIN size USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x) USING (doc_id)
"""
