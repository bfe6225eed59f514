"""User functions over batches of rows, skip-on-failure enrichment, and
stored results."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tagweave.session import cut_lineage

ERROR_COL = "__error"


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str) -> DataFrame:
    """Apply ``fn`` to Arrow batches of rows in every partition (the batched,
    multi-process map)."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            yield fn(b)
    return df.mapInPandas(run, schema)


def try_columns(df: DataFrame, required: Mapping[str, Column], status_col: str = "status", error: str = "failed") -> DataFrame:
    """Per-record enrichment by Spark's own ``try_*`` functions: adds every
    column of ``required`` (expressions that are null where they fail, such as
    ``try_parse_json`` or ``try_variant_get``) and ``status_col``: ``ok``, or
    ``error: names`` with the columns that failed.  All JVM, one pass, no record
    is lost; ``where(status = 'ok')`` are the enriched records."""
    out = df.withColumns(dict(required))
    failed = F.concat_ws(",", *[F.when(F.col(f"`{n}`").isNull(), F.lit(n)) for n in required])
    return out.withColumn(status_col, F.when(failed == "", F.lit("ok")).otherwise(F.concat(F.lit(f"{error}: "), failed)))


def try_map(df: DataFrame, fn: Callable[[dict], dict], schema: T.StructType | str
            ) -> tuple[DataFrame, DataFrame]:
    """Per-record enrichment where a failing record is skipped: returns
    ``(ok_df, errors_df)``.  ``fn`` maps a record dict to an output dict;
    ``errors_df`` holds the input columns of every failed record and the whole
    error text (``__error``).  A record also fails when its output does not fit
    the schema.  The function runs once per record: both results read one
    checkpoint.  Records go through Arrow types, so longs stay exact, NaN stays
    NaN and null stays null.  Prefer ``try_columns`` where built-in functions
    express the work; this is the Python fallback."""
    out_schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    names = out_schema.fieldNames()
    columns = df.columns
    kinds = [to_arrow_type(f.dataType) for f in out_schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            outs: list[list] = [[] for _ in names]
            errors: list[str | None] = []
            for rec in b.to_pylist():
                try:
                    r = fn(rec)
                    values = [r.get(n) for n in names]
                    for v, kind in zip(values, kinds):
                        pa.scalar(v, kind)
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 -- the record is skipped, it and its error are kept
                    values = [None] * len(names)
                    errors.append(f"{type(e).__name__}: {e}")
                for out, v in zip(outs, values):
                    out.append(v)
            bad = pa.array([e is not None for e in errors], pa.bool_())
            kept = [pc.if_else(bad, c, pa.scalar(None, c.type)) if not pa.types.is_nested(c.type)
                    else c.take(pa.array([i if x else None for i, x in enumerate(bad.to_pylist())], pa.int64())) for c in b.columns]
            yield pa.RecordBatch.from_arrays([*(pa.array(o, k) for o, k in zip(outs, kinds)), *kept, pa.array(errors, pa.string())],
                                             names=flat_schema.fieldNames())

    flat_schema = T.StructType([T.StructField(f"__out.{f.name}", f.dataType, True) for f in out_schema.fields]
                               + [T.StructField(f"__in.{f.name}", f.dataType, True) for f in df.schema.fields]
                               + [T.StructField(ERROR_COL, T.StringType(), True)])
    mapped = cut_lineage(df.mapInArrow(run, flat_schema))
    ok = mapped.where(F.col(ERROR_COL).isNull()).select(*[F.col(f"`__out.{k}`").alias(k) for k in names])
    errors = mapped.where(F.col(ERROR_COL).isNotNull()).select(*[F.col(f"`__in.{k}`").alias(k) for k in columns], ERROR_COL)
    return ok, errors


def materialize(df: DataFrame, path: str, overwrite: bool = False, fmt: str = "parquet") -> DataFrame:
    """Re-use the stored result at ``path`` unless ``overwrite``; otherwise
    compute, store and read it back (a reliable cut of the lineage).  Only a
    finished write counts (its ``_SUCCESS`` mark): what a broken job left is
    computed anew."""
    spark = df.sparkSession
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    if not overwrite and mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        return spark.read.format(fmt).load(path)
    df.write.mode("overwrite").format(fmt).save(path)
    return spark.read.format(fmt).load(path)
