"""Sampling, ordering and batching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.functions.hashing import mix_hash
from tagweave.operators.spans import _keys
from tagweave.session import cut_lineage, ensure_checkpoint_dir


def _order_cols(order: str | Sequence[str | Column]) -> list:
    return [order] if isinstance(order, (str, Column)) else list(order)


def dense_ids(df: DataFrame, order: str | Sequence[str | Column], id_col: str = "id",
              num_partitions: int | None = None) -> DataFrame:
    """0-based ordinal in ``order`` (which must be a total order), assigned
    distributed: a range repartition on the full order key (splits hot
    leading keys), sorted within partitions, tagged with
    ``monotonically_increasing_id`` (partition id in the upper bits, row
    index in the lower 33 bits) and written once with a reliable checkpoint
    to the shared checkpoint folder.  Per-partition row counts (one row per
    partition -- the only data broadcast) give running offsets.

    The checkpoint matters for correctness: the range partitioner samples
    with a seed derived from the RDD id, so two evaluations of the same sort
    may cut different partition bounds; counting and numbering must read the
    same materialized partitions.  It also cuts the lineage."""
    cols = _order_cols(order)
    n = int(num_partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ensure_checkpoint_dir(df.sparkSession)
    ranged = (df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
              .withColumn("__mid", F.monotonically_increasing_id()))
    sorted_df = ranged.checkpoint(eager=True).withColumn("__pid", F.shiftright(F.col("__mid"), 33))
    counts = sorted_df.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select("__pid", (F.sum("__n").over(Window.orderBy("__pid")) - F.col("__n")).alias("__off"))
    out = sorted_df.join(F.broadcast(offsets), "__pid")
    local = F.col("__mid") - F.shiftleft(F.col("__pid"), 33)
    return out.withColumn(id_col, F.col("__off") + local).drop("__mid", "__pid", "__off")


def prefix_offsets(df: DataFrame, order: str | Sequence[str | Column], weight_col: str,
                   out_col: str = "offset", num_partitions: int | None = None) -> DataFrame:
    """For each row, the sum of ``weight_col`` over all rows before it in
    ``order`` (a total order): a distributed exclusive prefix sum.  Same
    scheme as ``dense_ids``; the in-partition running sum is a window over
    each (already sorted, checkpointed) range partition."""
    cols = _order_cols(order)
    n = int(num_partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ensure_checkpoint_dir(df.sparkSession)
    ranged = (df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
              .withColumn("__mid", F.monotonically_increasing_id()))
    ck = ranged.checkpoint(eager=True).withColumn("__pid", F.shiftright(F.col("__mid"), 33))
    tot = ck.groupBy("__pid").agg(F.sum(weight_col).alias("__s"))
    poff = tot.select("__pid", (F.sum("__s").over(Window.orderBy("__pid")) - F.col("__s")).alias("__poff"))
    w = Window.partitionBy("__pid").orderBy("__mid").rowsBetween(Window.unboundedPreceding, -1)
    out = ck.join(F.broadcast(poff), "__pid")
    return (out.withColumn(out_col, F.col("__poff") + F.coalesce(F.sum(weight_col).over(w), F.lit(0)))
            .drop("__mid", "__pid", "__poff"))


def _ranged_checkpoint(df: DataFrame, cols: list, num_partitions: int | None) -> DataFrame:
    n = int(num_partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ensure_checkpoint_dir(df.sparkSession)
    ranged = (df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
              .withColumn("__mid", F.monotonically_increasing_id()))
    return ranged.checkpoint(eager=True).withColumn("__pid", F.shiftright(F.col("__mid"), 33))


def group_dense_ids(df: DataFrame, group_cols: Sequence[str], order: Sequence[str | Column], id_col: str = "id",
                    num_partitions: int | None = None) -> DataFrame:
    """0-based ordinal inside each group, in ``order`` (a total order within
    the group), without a window per group: a range repartition on
    (group, order) splits a hot group over many partitions; inside a sorted
    partition a group's rows are contiguous, so the position is the row id
    minus the group's first row id there; offsets from earlier partitions
    come from per-(partition, group) counts (a small table, prefix-summed per
    group over partition order)."""
    gs = list(group_cols)
    ck = _ranged_checkpoint(df, [*gs, *_order_cols(order)], num_partitions)
    part = ck.groupBy("__pid", *gs).agg(F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__m0"))
    part = part.withColumn("__off", F.sum("__n").over(Window.partitionBy(*gs).orderBy("__pid")) - F.col("__n"))
    out = ck.join(part.select("__pid", *gs, "__off", "__m0"), ["__pid", *gs])
    return (out.withColumn(id_col, F.col("__off") + F.col("__mid") - F.col("__m0"))
            .drop("__mid", "__pid", "__off", "__m0"))


def group_running_max_before(df: DataFrame, group_cols: Sequence[str], order: Sequence[str], value_col: str,
                             out_col: str, num_partitions: int | None = None) -> DataFrame:
    """Max of ``value_col`` over the earlier rows of the same group (null for
    the first row), skew-safe: per (range partition, group) maxima are
    prefix-maxed across partitions, and the in-partition part is a window
    over one partition's slice of the group."""
    gs = list(group_cols)
    ck = _ranged_checkpoint(df, [*gs, *order], num_partitions)
    part = ck.groupBy("__pid", *gs).agg(F.max(value_col).alias("__pm"))
    wprev = Window.partitionBy(*gs).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("__before", F.max("__pm").over(wprev)).select("__pid", *gs, "__before")
    win = Window.partitionBy("__pid", *gs).orderBy("__mid").rowsBetween(Window.unboundedPreceding, -1)
    out = ck.join(part, ["__pid", *gs]).withColumn("__in", F.max(value_col).over(win))
    best = F.when(F.col("__before").isNull(), F.col("__in")).when(F.col("__in").isNull(), F.col("__before")) \
        .otherwise(F.greatest("__before", "__in"))
    return out.withColumn(out_col, best).drop("__mid", "__pid", "__before", "__in")


MAX_BROADCAST_SPLITS = 250_000


def number_by_split(d: DataFrame, per_split: DataFrame, row_col: str = "__row", file_col: str = "__file", block_col: str = "__blk") -> DataFrame:
    """Adds the place of each row in file order, ``__at`` (in its split) and
    ``__off`` (kept rows of earlier splits).

    ``row_col`` is a ``monotonically_increasing_id`` that was taken at the scan,
    before any join.  ``per_split`` has a row per file split: its first row id
    (``__first``), its rows (``__n``) and those kept (``__kept``), counted by a
    pass over the same scan.  Only that small table is stored, ordered and
    joined (broadcast while it has at most ``MAX_BROADCAST_SPLITS`` rows); the
    rows themselves are neither sorted nor written.  Both passes must cut the
    files alike: if the settings for splits change in between, rows don't fit
    the table and the job raises."""
    split = [file_col, block_col]
    offs = per_split.select(*split, "__first", "__n", "__kept",
                            (F.sum("__kept").over(Window.orderBy(*split)) - F.col("__kept")).alias("__off"))
    offs = cut_lineage(offs)
    offs = F.broadcast(offs) if offs.count() <= MAX_BROADCAST_SPLITS else offs
    at = F.col(row_col) - F.col("__first")
    checked = F.when(F.coalesce((at >= 0) & (at < F.col("__n")), F.lit(False)), at).otherwise(
        F.raise_error(F.lit("the files were cut into other splits than when they were counted")).cast("long"))
    return d.join(offs, split, "left").withColumn("__at", checked).drop("__first", "__n", row_col)


def file_order_ids(df: DataFrame, id_col: str = "id", file_col: str = "__file", block_col: str = "__blk") -> DataFrame:
    """0-based ordinal in file order for rows that come from a file scan by
    narrow steps only, where ``(file, block start)`` names a file split.  A
    split's rows stand together in one partition, so their scan-time ids
    (``monotonically_increasing_id``; deterministic because split planning is)
    are consecutive: id = rows of earlier splits + row id - first row id."""
    d = df.withColumn("__row", F.monotonically_increasing_id())
    per = d.groupBy(file_col, block_col).agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    out = number_by_split(d, per.withColumn("__kept", F.col("__n")), "__row", file_col, block_col)
    return out.withColumn(id_col, F.col("__off") + F.col("__at")).drop("__off", "__at", "__kept")


def sequential_batches(df: DataFrame, order: str | Sequence[str | Column], size: int,
                       batch_col: str = "batch_id") -> DataFrame:
    """Batch id in input order; the last partial batch is kept."""
    d = dense_ids(df, order, "__ord")
    return d.withColumn(batch_col, F.floor(F.col("__ord") / F.lit(int(size))).cast("long")).drop("__ord")


def shuffled_batches(df: DataFrame, key: str, size: int, seed: int = 42,
                     batch_col: str = "batch_id") -> DataFrame:
    """Batch id after a seeded, repeatable shuffle (hash of key, then key)."""
    d = df.withColumn("__h", mix_hash(F.col(key), seed))
    return sequential_batches(d, ["__h", key], size, batch_col).drop("__h")


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n records without replacement, seeded and repeatable: the n smallest
    hash values (a TakeOrdered top-k: each partition keeps only n rows).
    n above the population returns every row."""
    return df.orderBy(mix_hash(F.col(key), seed), F.col(key)).limit(int(n))


def take_first_n(df: DataFrame, order: str | Sequence[str | Column], n: int) -> DataFrame:
    """First min(n, count) rows in order, with the used count as a column."""
    first = df.orderBy(*_order_cols(order)).limit(int(n))
    w = Window.partitionBy()
    return first.withColumn("n_used", F.count(F.lit(1)).over(w))


def pick_nth(df: DataFrame, arr_col: str, n: int, out_col: str = "picked") -> DataFrame:
    """Element n (0-based) of an array column; null when out of range."""
    return df.withColumn(out_col, F.get(F.col(arr_col), int(n)))


__all__ = ["dense_ids", "sequential_batches", "shuffled_batches", "sample_n", "take_first_n", "pick_nth",
           "file_order_ids", "_keys"]
