"""The commonest entries of a table, as many as a fixed bound allows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def commonest(df: DataFrame, count: str, bound: int) -> DataFrame:
    """Rows with the largest ``count`` (a positive number), at most ``bound``
    of them: whole classes of counts (eight to a doubling) from the top while
    they fit.  One small aggregation finds the threshold; nothing is sorted."""
    classes = df.groupBy(F.floor(F.log2(count) * 8).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min(count).alias("lo")).collect()
    total, least = 0, None
    for r in sorted(classes, key=lambda r: -r.k):
        total += r.n
        if total > bound:
            break
        least = r.lo
    return df.filter(F.lit(False)) if least is None else df.filter(F.col(count) >= least)
