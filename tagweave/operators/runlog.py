"""Training run logs: step numbering, best-checkpoint selection, windowed
loss means, every-n-th step."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.operators.sampling import group_dense_ids, group_running_max_before


def with_steps(log_df: DataFrame, run_col: str = "run_id", order_cols: Sequence[str] = ("ts", "event_id"),
               step_col: str = "step") -> DataFrame:
    """1-based step in ``order_cols`` order inside each run.  Distributed
    per-run numbering (``group_dense_ids``): a run holding a large share of
    all rows is spread over many range partitions instead of one window
    task."""
    return (group_dense_ids(log_df, [run_col], list(order_cols), "__s")
            .withColumn(step_col, (F.col("__s") + 1).cast("int")).drop("__s"))


def best_checkpoint(log_df: DataFrame, mode: str = "f1", run_col: str = "run_id", step_col: str = "step",
                    value_col: str = "value", eps: float = 1e-5) -> DataFrame:
    """In step order keep a row when it beats the best kept value by more
    than ``eps`` (``f1``: higher, ``loss``: lower); return the last kept row
    per run.

    A kept row is a strict new running best, so only running records matter;
    they come from a skew-safe running max over range partitions.  With m the
    largest value before a row, the best kept value lies in [m - eps, m], so a
    record above m + eps is kept whatever came before: everything before the
    last such record of a run is settled and drops out (a maximum per run and
    partition).  What is left is folded as a stream over (run, step), which
    holds one run's (best, step, value) and nothing else, so a run of any length
    takes constant memory.  With eps = 0 every record is kept and the answer is
    the first row holding the run's best."""
    sign = 1.0 if mode == "f1" else -1.0
    v = F.col(value_col) * F.lit(sign)
    d = log_df.select(run_col, step_col, value_col, v.alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    if eps == 0:
        best = d.groupBy(run_col).agg(F.min_by(F.struct(step_col, value_col),
                                                F.struct((-F.col("__v")).alias("nv"), F.col(step_col).alias("s")))
                                      .alias("b"))
        return best.select(run_col, F.col(f"b.{step_col}").alias(step_col), F.col(f"b.{value_col}").alias(value_col))
    # running-record rows; the running max is skew-safe (range partitions
    # split a hot run; per-partition maxima are prefix-maxed)
    rec = (group_running_max_before(d, [run_col], [step_col], "__v", "__prev_max")
           .where(F.col("__prev_max").isNull() | (F.col("__v") > F.col("__prev_max"))))
    # the same sum as in the fold; a value that rounds to m + eps stays for it
    certain = F.col("__prev_max").isNull() | (F.col("__v") > F.col("__prev_max") + F.lit(eps))
    settled = rec.where(certain).groupBy(F.col(run_col).alias("__run")).agg(F.max(step_col).alias("__from"))
    rest = (rec.join(settled, F.col(run_col).eqNullSafe(F.col("__run"))).where(F.col(step_col) >= F.col("__from"))
            .select(run_col, F.col(step_col).cast("long").alias(step_col), F.col("__v").cast("double").alias("__v"),
                    F.col(value_col).cast("double").alias(value_col)))
    return (_fold_runs(rest.repartition(run_col).sortWithinPartitions(run_col, step_col), eps)
            .toDF(run_col, step_col, value_col))


def _fold_runs(rows: DataFrame, eps: float) -> DataFrame:
    """rows(run, step, v, raw), runs together and in step order -> the last kept
    (run, step, raw) of each run."""
    run_col, step_col, _, value_col = rows.columns
    schema = T.StructType([rows.schema[run_col], rows.schema[step_col], rows.schema[value_col]])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None                                    # run, best, step, raw value
        kind = None
        for b in batches:
            kind = b.column(0).type
            done = []
            for run, step, v, raw in zip(*(b.column(i).to_pylist() for i in range(4))):
                if held is None or held[0] != run:
                    if held is not None:
                        done.append(held)
                    held = (run, v, step, raw)
                elif v > held[1] + eps:
                    held = (run, v, step, raw)
            if done:
                yield _batch(done, kind)
        if held is not None:
            yield _batch([held], kind)

    def _batch(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], kind), pa.array([x[2] for x in done], pa.int64()),
                                           pa.array([x[3] for x in done], pa.float64())], names=schema.names)

    return rows.mapInArrow(fold, schema)


def windowed_mean_loss(log_df: DataFrame, k: int, run_col: str = "run_id", step_col: str = "step",
                       value_col: str = "value") -> DataFrame:
    """Mean of the scaled losses (value / k) in each window of k steps; the
    trailing partial window is dropped.  Output ``(run, window_id,
    mean_loss)``; partial aggregation, no per-run grouping of rows."""
    win = F.floor((F.col(step_col) - 1) / k)
    return (log_df.groupBy(run_col, win.alias("window_id"))
            .agg(F.avg(F.col(value_col) / F.lit(float(k))).alias("mean_loss"), F.count(F.lit(1)).alias("__n"))
            .where(F.col("__n") == k).drop("__n"))


def every_nth_step(log_df: DataFrame, n: int, step_col: str = "step") -> DataFrame:
    """Rows whose step (from 1) is a multiple of n."""
    return log_df.where(F.pmod(F.col(step_col), F.lit(int(n))) == 0)
