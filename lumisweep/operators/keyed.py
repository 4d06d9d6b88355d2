"""Keyed building blocks that stay balanced when one key holds most rows.

Two patterns are used throughout the operators:

* **rows against per-key values** - ``join_on``, a null-safe join.  Adaptive execution
  splits the partition of a hot key; its per-key row is small and sent to every part.
* **order inside a key** - positions, running sums, exact quantiles and as-of
  lookups.  ``order_splits`` counts the rows.  Up to ``ROWS_PER_BUCKET`` rows in
  all, every key fits one task by that count and a plain window or ``percentile``
  is used.  Beyond, rows are cut into value buckets that each hold a bounded share
  of *all* rows, windows run inside (key, bucket), and the totals of the earlier
  buckets are added from a small per-bucket table.  Both ways give the same rows;
  the registered ``*_cut`` queries compare the second one with SQL.

A NULL key is a key like any other, on every path.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Cut points that one quantile sketch can tell apart; finer cuts divide these evenly.
SKETCH_CUTS = 8192
ROWS_PER_BUCKET = 1_000_000
#: Buckets of a text order, and sampled texts for each of them.
TEXT_BUCKETS, SAMPLE_PER_BUCKET = 512, 16

_ALL = "_all"


def with_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Keys to group by; an empty list becomes one constant key."""
    if keys:
        return df, list(keys)
    return df.withColumn(_ALL, F.lit(0)), [_ALL]


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str],
            how: str = "inner") -> DataFrame:
    """Join on ``keys`` where NULL equals NULL; the keys come from ``left``."""
    names = {k: f"_right_{i}" for i, k in enumerate(keys)}
    other = right.withColumnsRenamed(names)
    same = reduce(lambda x, y: x & y, [
        F.col(k).eqNullSafe(F.col(name)) for k, name in names.items()])
    return left.join(other, same, how).drop(*names.values())


def join_values(rows: DataFrame, values: DataFrame, keys: Sequence[str],
                nulls: bool = True) -> DataFrame:
    """``join_on`` where ``values`` has one row for each of very many keys.

    Hash-joined partition by partition.  Estimates of size do not see the fan-out of rows that
    are made by ``explode``, so the optimizer would take these for the small side and broadcast
    all of them through the driver.  ``rows`` is not sorted, and shuffled once where it meets
    several such tables.  With ``nulls=False``, where it is known that one side has no NULL
    key, the keys are compared as they are: rows that are dealt by key stay where they are.
    """
    if not nulls:
        return rows.join(values.hint("shuffle_hash"), list(keys)).select(
            *rows.columns, *[c for c in values.columns if c not in keys])
    return join_on(rows, values.hint("shuffle_hash"), keys)


def null_key(keys: Sequence[str]) -> Column:
    """Whether any of ``keys`` is NULL."""
    return reduce(lambda x, y: x | y, [F.col(k).isNull() for k in keys], F.lit(False))


def order_number(df: DataFrame, column: str) -> Column:
    """A number that grows with ``column``: its value, or the first bytes of a text."""
    if isinstance(df.schema[column].dataType, StringType):
        head = F.rpad(F.hex(F.substring(F.encode(F.col(column), "UTF-8"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    kind = df.schema[column].dataType.simpleString()
    value = F.col(column).cast("timestamp") if kind == "date" else F.col(column)
    return value.cast("double")


def text_splits(df: DataFrame, text: str, buckets: int = TEXT_BUCKETS) -> list[str]:
    """Texts that cut all rows into about ``buckets`` even parts, by whole texts.

    The sample is the ``SAMPLE_PER_BUCKET`` times ``buckets`` distinct texts of least hash: a
    bounded number comes to the driver, and reruns cut the same.
    """
    hashed = F.xxhash64(text)
    rows = (df.where(F.col(text).isNotNull()).select(text).distinct()
            .orderBy(hashed, text).limit(SAMPLE_PER_BUCKET * buckets).collect())
    sample = sorted((r[0] for r in rows), key=lambda t: t.encode())
    step = max(1, len(sample) // buckets)
    return sample[step::step]


def text_bucket(text: Column, splits: Sequence[str]) -> Column:
    """Number of ``splits`` up to and including each text, by binary search; NULL for NULL."""
    cuts = F.lit(list(splits)) if splits else F.array().cast("array<string>")
    steps = [2 ** i for i in reversed(range(len(splits).bit_length()))] or [1]
    found = F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(
        F.get(cuts, at + step - 1) <= text, at + step).otherwise(at))
    return F.when(text.isNotNull(), found)


def text_positions(df: DataFrame, text: str, out: str = "pos",
                   buckets: int = TEXT_BUCKETS) -> DataFrame:
    """0-based position of each row in the order of the texts (UTF-8 bytes, NULL first).

    Rows are ordered inside buckets of whole texts, however long the start is that all texts
    share, and the rows of the buckets before are added from one row per bucket.  Equal texts
    stay in one bucket; their order among each other is free.
    """
    bucket = F.coalesce(text_bucket(F.col(text), text_splits(df, text, buckets)), F.lit(-1))
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    # At most one row per cut.
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0))
                           .alias("_before"))
    here = F.row_number().over(Window.partitionBy("_bucket").orderBy(text))
    return (rows.withColumn("_here", here).join(before, "_bucket")
            .withColumn(out, (F.col("_before") + F.col("_here") - 1).cast("long"))
            .drop("_bucket", "_here", "_before"))


def order_splits(df: DataFrame, column: str) -> list[float]:
    """Cut points so that each bucket holds about the same share of all rows.

    One job over one column.  The driver receives the row count and at most
    ``SKETCH_CUTS`` numbers; where the rows ask for more buckets, the range between two
    of these is divided evenly.  Up to ``ROWS_PER_BUCKET`` rows there is one bucket and the
    list is empty.  As literals the cuts give every task, also a repeated one, the same
    buckets, and results never depend on where they lie.
    """
    value = order_number(df, column)
    values = df.select(F.when(F.isnan(value), F.lit(None)).otherwise(value).alias("v"))
    rows = values.agg(F.count("v")).first()[0]
    if rows <= ROWS_PER_BUCKET:
        return []
    probs = F.split(F.lit(",".join(str(i / SKETCH_CUTS) for i in range(1, SKETCH_CUTS))),
                    ",").cast("array<double>")
    cuts = values.agg(F.percentile_approx("v", probs, SKETCH_CUTS).alias("cuts")).first()["cuts"]
    buckets = 1 + rows // ROWS_PER_BUCKET
    if buckets <= SKETCH_CUTS:
        step = SKETCH_CUTS / buckets
        return sorted({cuts[int(round(i * step)) - 1] for i in range(1, buckets)})
    parts = math.ceil(buckets / SKETCH_CUTS)
    cuts = sorted(set(cuts))
    finer = {a + (b - a) * i / parts for a, b in zip(cuts, cuts[1:]) for i in range(parts)}
    return sorted(finer | {cuts[-1]})


def with_bucket(df: DataFrame, column: str, splits: Sequence[float],
                out: str = "_bucket") -> DataFrame:
    """Bucket number of ``column`` for the given cut points."""
    cutter = Bucketizer(splits=[float("-inf"), *splits, float("inf")], inputCol="_cut",
                        outputCol="_cut_bucket", handleInvalid="keep")
    cast = df.withColumn("_cut", order_number(df, column))
    # A non-null bucket keeps the optimizer from adding a filter to one branch only,
    # so that branches over the same aggregate share one exchange.
    return (cutter.transform(cast)
            .withColumn(out, F.coalesce(F.col("_cut_bucket").cast("int"), F.lit(-1)))
            .drop("_cut", "_cut_bucket"))


def bucket_offsets(df: DataFrame, keys: Sequence[str], amount: Column) -> DataFrame:
    """Per (key, bucket): sum of ``amount``, sum over earlier buckets, key total.

    The windows see one row per bucket, at most ``buckets`` per key.
    """
    by_key = Window.partitionBy(*keys)
    earlier = by_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return (df.groupBy(*keys, "_bucket").agg(F.sum(amount).alias("_here"))
            .withColumn("_before", F.coalesce(F.sum("_here").over(earlier), F.lit(0)))
            .withColumn("_total", F.sum("_here").over(by_key)))


def dense_positions(df: DataFrame, keys: Sequence[str], order: str,
                    ties: Sequence[str] = (), out: str = "pos",
                    splits: Sequence[float] | None = None) -> DataFrame:
    """0-based position of each row within its key, in the order of ``order``."""
    df, by = with_keys(df, keys)
    if splits is None:
        splits = order_splits(df, order)
    if not splits:
        whole = Window.partitionBy(*by).orderBy(order, *ties)
        return df.withColumn(out, F.row_number().over(whole).cast("long") - 1).drop(_ALL)
    rows = with_bucket(df, order, splits)
    offsets = bucket_offsets(rows, by, F.lit(1)).select(*by, "_bucket", "_before")
    here = Window.partitionBy(*by, "_bucket").orderBy(order, *ties)
    return (join_on(rows, offsets, [*by, "_bucket"])
            .withColumn(out, F.col("_before") + F.row_number().over(here) - 1)
            .drop("_bucket", "_before", _ALL))


def running_total(df: DataFrame, keys: Sequence[str], order: str, amount: str,
                  out: str = "running", total: str = "total",
                  splits: Sequence[float] | None = None) -> DataFrame:
    """Running sum of ``amount`` up to and including each row, and the key total.

    ``order`` must be unique within a key (aggregate first when it is not).
    """
    df, by = with_keys(df, keys)
    if splits is None:
        splits = order_splits(df, order)
    if not splits:
        whole = Window.partitionBy(*by)
        upto = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({out: F.sum(amount).over(upto),
                               total: F.sum(amount).over(whole)}).drop(_ALL)
    rows = with_bucket(df, order, splits)
    offsets = bucket_offsets(rows, by, F.col(amount)).drop("_here")
    here = (Window.partitionBy(*by, "_bucket").orderBy(order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (join_on(rows, offsets, [*by, "_bucket"])
            .withColumn(out, F.col("_before") + F.sum(amount).over(here))
            .withColumnRenamed("_total", total)
            .drop("_bucket", "_before", _ALL))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    out: str = "quantiles", count: str = "n",
                    splits: Sequence[float] | None = None,
                    extra: Sequence[Column] = ()) -> DataFrame:
    """Exact quantiles per key with linear interpolation between ranks (type 7).

    Returns the keys, the number of values and an array in the order of
    ``probs``, and the aggregates ``extra`` over all columns of ``df``.  NULL and NaN
    values are left out; a key without values gives no row.  Equal values are
    counted before the shuffle, then only the buckets that hold a wanted rank are
    sorted, each in its own task.
    """
    df, by = with_keys(df, keys)
    # Missing values are kept and counted as zero: a filter on a derived value would
    # be pushed below, and repeat, the projections that compute it.
    number = F.col(value).cast("double")
    values = df.withColumn("_v", F.when(F.isnan(number), F.lit(None)).otherwise(number))
    if splits is None:
        splits = order_splits(df, value)
    if not splits:
        plain = F.percentile("_v", [float(p) for p in probs])
        return (values.groupBy(*by).agg(F.count("_v").alias(count), plain.alias(out), *extra)
                .where(F.col(count) > 0).drop(_ALL))
    counted = with_bucket(values.groupBy(*by, "_v").agg(F.count("_v").alias("_c")), "_v", splits)

    chances = F.array(*[F.lit(float(p)) for p in probs])

    def place(p: Column) -> Column:
        return (F.col("_total") - 1) * p

    ranks = F.array_distinct(F.concat(
        F.transform(chances, lambda p: F.floor(place(p))),
        F.transform(chances, lambda p: F.ceil(place(p)))))
    wanted = (bucket_offsets(counted, by, F.col("_c"))
              .withColumn("_ranks", F.filter(ranks, lambda r: (r >= F.col("_before")) & (
                  r < F.col("_before") + F.col("_here"))))
              .where(F.size("_ranks") > 0).drop("_here"))

    here = (Window.partitionBy(*by, "_bucket").orderBy("_v")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hits = (join_on(counted, wanted, [*by, "_bucket"])
            .withColumn("_end", F.col("_before") + F.sum("_c").over(here))
            .withColumn("_ranks", F.filter("_ranks", lambda r: (
                r >= F.col("_end") - F.col("_c")) & (r < F.col("_end"))))
            .where(F.size("_ranks") > 0))
    # At most 2 * len(probs) ranks per key are gathered here.
    found = (hits.select(*by, "_total", "_v", F.explode("_ranks").alias("_rank"))
             .groupBy(*by).agg(
                 F.first("_total").alias("_total"),
                 F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at")))

    def mix(p: Column) -> Column:
        low, high = F.floor(place(p)), F.ceil(place(p))
        part = place(p) - low
        below, above = F.element_at("_at", low), F.element_at("_at", high)
        return F.when((low == high) | (below == above), below).otherwise(
            (1 - part) * below + part * above)

    found = found.select(*by, F.col("_total").alias(count), F.transform(chances, mix).alias(out))
    if extra:
        found = join_on(found, df.groupBy(*by).agg(*extra), by)
    return found.drop(_ALL)


def asof_lookup(points: DataFrame, table: DataFrame, keys: Sequence[str], x: str,
                columns: Sequence[str], extend_first: bool = False,
                splits: Sequence[float] | None = None) -> DataFrame:
    """For each point the last table row of its key with ``table.x <= point.x``.

    ``columns`` of that row and its ``x`` (as ``x_at``) are added.  Points before
    the first table row get NULL, or the first row with ``extend_first``.
    """
    points, by = with_keys(points, keys)
    table, _ = with_keys(table, keys)
    payload = F.struct(F.col(x).alias("x_at"), *columns)
    rows = table.select(*by, F.col(x).cast("double").alias(x), payload.alias("_row"))
    extra = [c for c in points.columns if c not in {*by, x}]
    asked = points.select(*by, F.col(x).cast("double").alias(x), F.struct(
        *[F.col(c) for c in extra], F.lit(1).alias("_asked")).alias("_point"))
    if splits is None:
        splits = order_splits(rows.select(x).unionByName(asked.select(x)), x)
    both = (rows.withColumn("_point", F.lit(None).cast(asked.schema["_point"].dataType))
            .unionByName(asked.withColumn(
                "_row", F.lit(None).cast(rows.schema["_row"].dataType))))
    picked = [*[k for k in by if k != _ALL], x,
              *[F.col(f"_point.{c}").alias(c) for c in extra],
              F.col("_found.x_at").alias("x_at"),
              *[F.col(f"_found.{c}").alias(c) for c in columns]]
    in_order = [F.col(x), F.col("_point").isNotNull()]
    by_key = Window.partitionBy(*by)
    if not splits:
        upto = by_key.orderBy(*in_order).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        found = F.coalesce(F.last("_row", ignorenulls=True).over(upto),
                           *([F.min("_row").over(by_key)] if extend_first else []))
        return (both.withColumn("_found", found).where(F.col("_point").isNotNull())
                .select(*picked))

    both = with_bucket(both, x, splits)
    earlier = by_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = (both.groupBy(*by, "_bucket").agg(
                F.max("_row").alias("_last"), F.min("_row").alias("_first"))
             .withColumn("_carry", F.max("_last").over(earlier))
             .withColumn("_first", F.min("_first").over(by_key)))
    here = (Window.partitionBy(*by, "_bucket").orderBy(*in_order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = F.coalesce(F.last("_row", ignorenulls=True).over(here), F.col("_carry"),
                       *([F.col("_first")] if extend_first else []))
    joined = (join_on(both, carry.drop("_last"), [*by, "_bucket"]).withColumn("_found", found)
              .where(F.col("_point").isNotNull()))
    return joined.select(*picked)


def with_next(table: DataFrame, keys: Sequence[str], x: str, columns: Sequence[str],
              suffix: str = "_next", splits: Sequence[float] | None = None) -> DataFrame:
    """Add the next row of the key in the order of ``x``: ``x_next`` and ``<column>_next``."""
    table, by = with_keys(table, keys)
    if splits is None:
        splits = order_splits(table, x)
    if not splits:
        whole = Window.partitionBy(*by).orderBy(x)
        return table.withColumns({f"{c}{suffix}": F.lead(c).over(whole)
                                  for c in [x, *columns]}).drop(_ALL)
    rows = with_bucket(table, x, splits).withColumn("_row", F.struct(x, *columns))
    later = (Window.partitionBy(*by).orderBy("_bucket")
             .rowsBetween(1, Window.unboundedFollowing))
    carry = (rows.groupBy(*by, "_bucket").agg(F.min("_row").alias("_head"))
             .withColumn("_carry", F.min("_head").over(later)).drop("_head"))
    here = Window.partitionBy(*by, "_bucket").orderBy(x)
    found = F.coalesce(F.lead("_row").over(here), F.col("_carry"))
    return (join_on(rows, carry, [*by, "_bucket"]).withColumn("_found", found)
            .withColumns({f"{c}{suffix}": F.col(f"_found.{c}") for c in [x, *columns]})
            .drop("_row", "_carry", "_found", "_bucket", _ALL))
