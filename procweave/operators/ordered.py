"""Ordered scans over groups of any size.

``lead``, ``lag``, row numbers, running sums and last-seen values over ``PARTITION BY key`` put a
whole key in one task. Here a key with more rows than ``slice_rows`` is cut into slices of its own
order first; windows then run per (key, slice) and a small table of slice totals carries values
from one slice to the next. Results are the same as the plain window, row for row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from procweave.session import settle

SLICE_ROWS = 5_000_000
# Below this size no key can hold more than a few slices' worth of rows, so the count is not worth a job.
COUNT_FROM_BYTES = 64 * 1024 * 1024
_SAMPLE_PER_SLICE = 20


def estimated_bytes(df: DataFrame) -> int:
    """Optimizer's size estimate, from file sizes up; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row of each key. Spark limits each map task to one row per key before the shuffle."""
    return top_per_key(df, keys, order, 1)


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int | None, rank: str | None = None
) -> DataFrame:
    """First ``k`` rows of each key (all without ``k``), with the rank kept under ``rank`` when named."""
    if k is None and not rank:
        return df
    name = rank or "__rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked if k is None else ranked.where(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def _split_points(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_rows: int) -> DataFrame | None:
    """Slice bounds of the keys with more than ``slice_rows`` rows, or None when there is none.

    What reaches the driver is at most ``rows / slice_rows`` keys and about twenty order values per
    slice. Rows are picked by their hash, so the bounds do not depend on task order; they only place
    the cuts and never decide a result.
    """
    spark = df.sparkSession
    hot = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > slice_rows)
    ).collect()
    if not hot:
        return None
    key_schema = T.StructType([df.schema[k] for k in keys])
    order_schema = T.StructType([df.schema[o] for o in order])
    hot_schema = T.StructType([*key_schema.fields, T.StructField("__n", T.LongType())])
    hot_df = spark.createDataFrame([tuple(r) for r in hot], hot_schema)
    picked = (
        _null_safe_join(df.select(*keys, *order), hot_df, keys, "inner")
        .where(
            F.pmod(F.xxhash64(*[F.col(c) for c in [*keys, *order]]), F.lit(1_000_000))
            < F.lit(1_000_000.0 * _SAMPLE_PER_SLICE) / F.lit(slice_rows)
        )
        .select(*keys, *order)
    ).collect()
    groups: dict[tuple, list[tuple]] = {}
    for row in picked:
        groups.setdefault(tuple(row[: len(keys)]), []).append(tuple(row[len(keys):]))
    rows = []
    for r in hot:
        key = tuple(r[: len(keys)])
        points = sorted(groups.get(key, []), key=lambda p: tuple((v is not None, v) for v in p))
        step = max(1, len(points) // max(1, -(-r["__n"] // slice_rows)))
        rows.append((*key, points[step::step]))
    schema = T.StructType([*key_schema.fields, T.StructField("__cuts", T.ArrayType(order_schema))])
    return spark.createDataFrame(rows, schema)


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi join on ``keys`` that also matches nulls; the right side's key columns are dropped."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    # The right side is one of the bounded slice tables built above.
    return left.join(F.broadcast(renamed), condition, how).drop(*[f"__r_{k}" for k in keys])


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    number: str | None = None,
    lead: Mapping[str, Column | str] | None = None,
    lag: Mapping[str, Column | str] | None = None,
    running: Mapping[str, Column] | None = None,
    last_seen: Mapping[str, Column] | None = None,
    next_seen: Mapping[str, Column] | None = None,
    slice_rows: int | None = None,
) -> DataFrame:
    """Add ordered values per key; ``order`` must be unique within a key.

    ``number``     1-based position.
    ``lead/lag``   value of the next / previous row.
    ``running``    sum up to and including the row.
    ``last_seen``  last non-null value at or before the row.
    ``next_seen``  first non-null value at or after the row.
    """
    limit = slice_rows or SLICE_ROWS
    cuts = None
    if slice_rows or estimated_bytes(df) >= COUNT_FROM_BYTES:
        # It is read for the counts, the cuts, the windows and the totals: worked out once.
        df = settle(df)
        cuts = _split_points(df, keys, order, limit)

    as_col = lambda v: F.col(v) if isinstance(v, str) else v
    lead = {k: as_col(v) for k, v in (lead or {}).items()}
    lag = {k: as_col(v) for k, v in (lag or {}).items()}
    running, last_seen, next_seen = dict(running or {}), dict(last_seen or {}), dict(next_seen or {})

    part = list(keys)
    if cuts is not None:
        at = F.struct(*[F.col(o) for o in order])
        df = _null_safe_join(df, cuts, keys, "left").withColumn(
            "__slice",
            F.when(F.col("__cuts").isNull(), F.lit(0)).otherwise(
                F.size(F.filter("__cuts", lambda c: c <= at))
            ),
        )
        part = [*keys, "__slice"]
    w = Window.partitionBy(*part).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    after = w.rowsBetween(0, Window.unboundedFollowing)

    wanted: dict[str, Column] = {}
    if number:
        wanted[number] = F.row_number().over(w).cast("long")
    # Values travel in one-field structs so that a null value differs from "no row".
    for name, col in lead.items():
        wanted[f"__lead_{name}"] = F.lead(F.struct(col.alias("v"))).over(w)
    for name, col in lag.items():
        wanted[f"__lag_{name}"] = F.lag(F.struct(col.alias("v"))).over(w)
    for name, col in running.items():
        wanted[name] = F.sum(col).over(before)
    for name, col in last_seen.items():
        wanted[name] = F.last(col, ignorenulls=True).over(before)
    for name, col in next_seen.items():
        wanted[name] = F.first(col, ignorenulls=True).over(after)
    out = df.select("*", *[c.alias(n) for n, c in wanted.items()])

    if cuts is not None:
        out = _carry(df, out, keys, order, number, lead, lag, running, last_seen, next_seen)
    for name in lead:
        out = out.withColumn(name, F.col(f"__lead_{name}.v")).drop(f"__lead_{name}")
    for name in lag:
        out = out.withColumn(name, F.col(f"__lag_{name}.v")).drop(f"__lag_{name}")
    return out.drop("__cuts", "__slice")


def _carry(df, out, keys, order, number, lead, lag, running, last_seen, next_seen) -> DataFrame:
    """Bring slice totals of the cut keys over to the following (or preceding) slices."""
    at = F.struct(*[F.col(o) for o in order])
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for n, c in lead.items():
        aggs.append(F.min_by(F.struct(c.alias("v")), at).alias(f"__first_{n}"))
    for n, c in lag.items():
        aggs.append(F.max_by(F.struct(c.alias("v")), at).alias(f"__final_{n}"))
    for n, c in running.items():
        aggs.append(F.sum(c).alias(f"__sum_{n}"))
    for n, c in last_seen.items():
        aggs.append(F.max_by(c, F.when(c.isNotNull(), at)).alias(f"__seen_{n}"))
    for n, c in next_seen.items():
        aggs.append(F.min_by(c, F.when(c.isNotNull(), at)).alias(f"__ahead_{n}"))
    totals = df.where(F.col("__cuts").isNotNull()).groupBy(*keys, "__slice").agg(*aggs)

    w = Window.partitionBy(*keys).orderBy("__slice")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    later = w.rowsBetween(1, Window.unboundedFollowing)
    carried = [F.sum("__rows").over(earlier).alias("__c_rows")]
    carried += [F.lead(f"__first_{n}").over(w).alias(f"__c_lead_{n}") for n in lead]
    carried += [F.lag(f"__final_{n}").over(w).alias(f"__c_lag_{n}") for n in lag]
    carried += [F.sum(f"__sum_{n}").over(earlier).alias(f"__c_sum_{n}") for n in running]
    carried += [F.last(f"__seen_{n}", ignorenulls=True).over(earlier).alias(f"__c_seen_{n}") for n in last_seen]
    carried += [F.first(f"__ahead_{n}", ignorenulls=True).over(later).alias(f"__c_ahead_{n}") for n in next_seen]
    side = totals.select(*keys, "__slice", *carried)
    out = _null_safe_join(out, side, [*keys, "__slice"], "left")

    if number:
        out = out.withColumn(number, F.col(number) + F.coalesce("__c_rows", F.lit(0)))
    for n in lead:
        out = out.withColumn(f"__lead_{n}", F.coalesce(f"__lead_{n}", f"__c_lead_{n}"))
    for n in lag:
        out = out.withColumn(f"__lag_{n}", F.coalesce(f"__lag_{n}", f"__c_lag_{n}"))
    for n in running:
        both = F.coalesce(n, F.lit(0)) + F.coalesce(f"__c_sum_{n}", F.lit(0))
        out = out.withColumn(n, F.when(F.col(n).isNull() & F.col(f"__c_sum_{n}").isNull(), None).otherwise(both))
    for n in last_seen:
        out = out.withColumn(n, F.coalesce(n, f"__c_seen_{n}"))
    for n in next_seen:
        out = out.withColumn(n, F.coalesce(n, f"__c_ahead_{n}"))
    return out.drop(*[c for c in out.columns if c.startswith("__c_")])
