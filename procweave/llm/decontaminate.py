"""Benchmark decontamination: windows of benchmark words found in documents, with SQL functions only.

Every benchmark window is filed under its rarest word (by exact counts over all documents). One scan of
the documents looks each word up in the hash set of these anchor words and keeps a few words around each
anchor; the windows of that anchor are then compared word by word. Document texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procweave.llm.common import LOWER, UPPER, fresh, identified, numbered, settle, stable

#: Fixed: what separates words, for texts in which A-Z are not yet lower-cased, and for those in which they are.
RAW_SEPARATORS = r"[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str) -> str:
    return f"array_remove(split(coalesce(`{text}`, ''), '{RAW_SEPARATORS}'), '')"


def _lowered(words: str) -> str:
    return f"transform({words}, w -> translate(w, '{UPPER}', '{LOWER}'))"


def benchmark_windows(bench: DataFrame, item_col: str = "item_id", text_col: str = "text", n: int = 10) -> DataFrame:
    """Distinct windows of the items: ``win`` (words), ``size`` and the ``items`` that hold them.

    An item with fewer words than ``n`` is one window; one without words, or null, has none. Items without
    an id count as one item with an empty id.
    """
    words = bench.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.expr(_lowered(_words(text_col))).alias("ws"))
    starts = f"CASE WHEN size(ws) = 0 THEN array() ELSE sequence(1, greatest(1, size(ws) - {n - 1})) END"
    return (
        words.select("item", F.explode(F.expr(f"transform({starts}, s -> slice(ws, s, {n}))")).alias("win"))
        .groupBy("win")
        .agg(F.collect_set("item").alias("items"))
        .withColumn("size", F.size("win"))
    )


def _filed(docs: DataFrame, wins: DataFrame, text_col: str, few: bool) -> DataFrame:
    """Windows with the anchor word (the rarest in all documents) and its place in the window.

    ``few``: the vocabulary is small enough to broadcast; else words are counted before they are joined.
    """
    vocabulary = wins.select(F.explode(F.array_distinct(F.expr("transform(win, w -> lower(w))"))).alias("word")).distinct()
    seen = docs.select(F.explode(F.expr(_words(text_col))).alias("raw")).select(F.lower("raw").alias("word"))
    counted = lambda words: words.groupBy("word").agg(F.count("*").alias("n"))
    counts = counted(seen.join(F.broadcast(vocabulary), "word", "left_semi")) if few else counted(seen).join(vocabulary, "word", "left_semi")
    ranked = (
        numbered(wins, "win", "size", "items", rid="win_id")
        .select("*", F.posexplode("win").alias("off", "w"))
        .withColumn("word", F.lower("w"))
        .join(counts, "word", "left")
        # Windows with a word that no document has cannot occur.
        .withColumn("n", F.coalesce("n", F.lit(0)))
    )
    best = ranked.groupBy("win_id").agg(F.min(F.struct("n", "off", "word")).alias("a"), F.first("win").alias("win"), F.first("size").alias("size"), F.first("items").alias("items"))
    return best.filter("a.n > 0").select("win_id", "win", "size", "items", F.col("a.off").alias("off"), F.col("a.word").alias("anchor"))


def find_hits(
    docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    bench_text_col: str = "text", n: int = 10, max_set: int = 20_000, max_broadcast: int = 200_000,
) -> tuple[DataFrame, DataFrame]:
    """Documents ``(rid, id, n_words)`` and hits ``(rid, start, size, items)``, one per window occurrence.

    ``start`` counts words from 0. Texts that are null or without words have no hits; an empty benchmark
    gives no hits. Up to ``max_set`` anchor words the set is part of the scan's filter, beyond that anchors
    are found by a join; up to ``max_broadcast`` windows are broadcast, more are joined by a shuffle.
    """
    source = numbered(docs, F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    wins = settle(benchmark_windows(bench, item_col, bench_text_col, n))
    few = len(wins.select("size").limit(max_broadcast + 1).collect()) <= max_broadcast
    filed = settle(_filed(source, wins, "text", few))
    anchors = [r[0] for r in filed.select("anchor").distinct().limit(max_set + 1).collect()]
    reach = n - 1
    around = f"""struct(i AS pos, greatest(i - {reach}, 0) AS first,
        {_lowered(f'slice(ws, greatest(i - {reach}, 0) + 1, least(i, {reach}) + {n})')} AS ctx)"""
    every = "CASE WHEN size(ws) = 0 THEN array() ELSE sequence(0, size(ws) - 1) END"
    split = source.select("rid", "id", F.expr(_words("text")).alias("ws")).withColumn("n_words", F.size("ws").cast("long"))
    if len(anchors) <= max_set:
        chosen = ", ".join(f"'{a}'" for a in anchors) or "''"
        kept = f"filter({every}, i -> lower(ws[i]) IN ({chosen}))"
        scanned = settle(split.select("rid", "id", "n_words", F.expr(f"transform({kept}, i -> {around})").alias("near")))
        base = scanned.select("rid", "id", "n_words")
        near = scanned.filter(F.size("near") > 0).select("rid", F.explode("near").alias("c")).select("rid", "c.*")
    else:
        base = split.select("rid", "id", "n_words")
        near = split.select("rid", F.explode(F.expr(f"transform({every}, i -> {around})")).alias("c")).select("rid", "c.*")
    near = near.withColumn("anchor", F.lower(F.expr("ctx[pos - first]")))
    hits = near.join(F.broadcast(filed) if few else filed, "anchor").filter(
        "pos >= off AND slice(ctx, pos - first - off + 1, size) = win"
    )
    return base, hits.select("rid", (F.col("pos") - F.col("off")).alias("start"), "size", "items")


def report(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` and ``rid``.

    A repeated id gives one row per input row; a null text gives zero counts. A very long text is read as one row. Other columns are not read,
    whatever their names; an empty table gives no rows.
    """
    base, hits = find_hits(docs, bench, id_col, **options)
    hits = settle(hits)
    runs = hits.groupBy("rid", "start").agg((F.col("start") + F.max("size")).alias("end"))
    before = Window.partitionBy("rid").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        runs.withColumn("done", F.coalesce(F.max("end").over(before), F.col("start")))
        .groupBy("rid").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "done"))).alias("n_hit"))
    )
    items = (
        hits.select("rid", F.explode("items").alias("item")).distinct()
        .groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    return (
        base.join(covered, "rid", "left").join(items, "rid", "left")
        .select(
            "rid", F.col("id").alias(id_col), "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def drop_contaminated(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """Rows of ``docs``, all columns, that no benchmark window occurs in."""
    docs = stable(docs)
    _, hits = find_hits(docs, bench, **options)
    row, hit = fresh(docs, "row"), fresh(docs, "hit")
    bad = hits.select(F.col("rid").alias(hit)).distinct()
    return identified(docs, row).join(bad, F.col(row) == F.col(hit), "left_anti").drop(row)


def cut_spans(docs: DataFrame, bench: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` whose hit words are taken out; words of a touched text are joined by one space."""
    docs = stable(docs)
    _, hits = find_hits(docs, bench, text_col=text_col, **options)
    row, hit, cut = fresh(docs, "row"), fresh(docs, "hit"), fresh(docs, "cut")
    spans = hits.groupBy(F.col("rid").alias(hit)).agg(F.collect_set(F.struct("start", "size")).alias(cut))
    words = _words(text_col)
    kept = f"array_join(filter({words}, (w, i) -> NOT exists(`{cut}`, s -> i >= s.start AND i < s.start + s.size)), ' ')"
    out = identified(docs, row).join(spans, F.col(row) == F.col(hit), "left")
    return out.withColumn(text_col, F.expr(f"CASE WHEN `{cut}` IS NULL THEN `{text_col}` ELSE {kept} END")).select(docs.columns)


SQL = f"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD_PATTERN}') AS ws FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD_PATTERN}') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, array_to_string(ws[s:s + 9], ' ') AS w, least(len(ws), 10) AS size
  FROM item, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS t(s) WHERE len(ws) > 0
),
sizes AS (SELECT DISTINCT size FROM win),
spot AS (
  SELECT doc_id, s, size, array_to_string(ws[s:s + size - 1], ' ') AS w
  FROM doc, sizes, unnest(range(1, len(ws) - size + 2)) AS t(s)
),
hit AS (SELECT doc_id, s, spot.size, item_id FROM spot JOIN win USING (w)),
place AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(s, s + size)) AS t(p) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN place USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op6_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    from procweave.llm.common import table

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("rid")
