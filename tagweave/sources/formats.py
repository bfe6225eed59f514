"""Other file formats: BibTeX, JSON (array files and lines), line text,
lexicons, CSV/JSON by extension, split maps, metric records."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.text import py_strip, split_words
from tagweave.operators.sampling import dense_ids, file_order_ids


# ---------------------------------------------------------------------------
# BibTeX
# ---------------------------------------------------------------------------
BIB_FIELDS = ("booktitle", "year", "url")
_SEGMENT = ("__file string, __blk long, __first long, __head boolean, __closed boolean, __fields boolean, "
            "booktitle string, year string, url string")


def _bib_segments(lines: DataFrame) -> DataFrame:
    """Field and closing lines of every file split, in order -> one row per
    segment.  A closing line ends a segment; a split's first one (``__head``) may
    go on with a record of earlier splits, and one without a closing line goes
    on in the next split.  Only the last value of each field is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("__file", pa.string()), ("__blk", pa.int64()), ("__first", pa.int64()), ("__head", pa.bool_()),
                            ("__closed", pa.bool_()), ("__fields", pa.bool_()), *((f, pa.string()) for f in BIB_FIELDS)])
        split = segment = None
        for b in batches:
            out: list[dict] = []
            for file, blk, row, kind, value in zip(*(b.column(i).to_pylist() for i in range(5))):
                if (file, blk) != split:
                    if segment is not None:
                        out.append(segment)
                    split, segment, head = (file, blk), None, True
                if segment is None:
                    segment = {"__file": file, "__blk": blk, "__first": row, "__head": head, "__closed": False, "__fields": False}
                    head = False
                if kind < 0:
                    out.append(segment | {"__closed": True})
                    segment = None
                else:
                    segment["__fields"] = True
                    if kind:
                        segment[BIB_FIELDS[kind - 1]] = value
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if segment is not None:
            yield pa.RecordBatch.from_pylist([segment], schema=schema)

    return lines.mapInArrow(run, _SEGMENT)


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """Multi-line records ending at a line that strips to ``}`` -> ``(venue,
    year, url, src_pos)``; nothing else ends one, whatever a line begins with.  A
    field line is ``key = value``; the value is the last `` = `` part with ``"``
    and ``,`` stripped from both ends; the last occurrence of a key wins.  What
    stands after the last closing line and holds a field is a record too; lines
    without any field are none.  ``year`` is an int (null when missing or not a
    number), ``url`` gets ``.pdf`` appended.  ``src_pos`` orders records in file
    order.

    A line-state scan: every file split is read on its own and reduced to
    records and at most two open ends, which are composed over the splits of a
    file.  Only the open ends (two rows a split) are exchanged."""
    text = py_strip(F.col("value"))
    raw = (spark.read.text(path)
           .select(text.alias("line"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__blk"),
                   F.monotonically_increasing_id().alias("__row"))
           .where((F.col("line") == "}") | F.col("line").contains(" = ")))
    key = F.substring_index("line", " = ", 1)
    kind = F.when(F.col("line") == "}", -1)
    for i, f in enumerate(BIB_FIELDS):
        kind = kind.when(key == f, i + 1)
    raw = raw.select("__file", "__blk", "__row", kind.otherwise(0).alias("kind"), "line")
    segments = _bib_segments(raw.withColumn("line", F.when(F.col("kind") > 0, F.regexp_replace(F.substring_index("line", " = ", -1), r'^[",]+|[",]+$', ""))))
    ends = F.col("__head") | ~F.col("__closed")
    order = F.struct("__blk", "__first")
    # an open end starts a group, which the heads of later splits join; a head that is not closed goes on
    borders = segments.where(ends)
    w = Window.partitionBy("__file").orderBy("__blk", "__first")
    starts = F.when(~F.col("__head"), 1).otherwise(0) + F.when(F.lag("__closed").over(w), 1).otherwise(0)
    grouped = borders.withColumn("__s", starts).withColumn("__g", F.sum("__s").over(w))
    stitched = (grouped.groupBy("__file", "__g")
                .agg(F.min("__blk").alias("__blk"), F.min("__first").alias("__first"), F.max("__fields").alias("__fields"),
                     *[F.max_by(F.when(F.col(f).isNotNull(), F.col(f)), F.when(F.col(f).isNotNull(), order)).alias(f) for f in BIB_FIELDS]))
    columns = ["__file", "__blk", "__first", "__fields", *BIB_FIELDS]
    records = segments.where(~ends).select(*columns).unionByName(stitched.select(*columns)).where("__fields")
    return records.select(
        F.col("booktitle").alias("venue"), F.col("year").try_cast("int").alias("year"), F.concat("url", F.lit(".pdf")).alias("url"),
        F.struct(F.col("__file").alias("file"), F.col("__blk").alias("blk"), F.col("__first").alias("row")).alias("src_pos"))


def write_bibtex(df: DataFrame, path: str, key_col: str, fields: Mapping[str, str], order_col: str | None = None,
                 mode: str = "overwrite") -> None:
    """Render ``@inproceedings{key, field = "value", ...}`` records (null
    fields are left out)."""
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f'    {k} = "'), F.col(c).cast("string"), F.lit('",')))
             for k, c in fields.items()]
    body = F.concat_ws("\n", F.concat(F.lit("@inproceedings{"), F.col(key_col).cast("string"), F.lit(",")), *parts,
                       F.lit("}"))
    out = df.orderBy(order_col or key_col)
    out.select(body.alias("value")).write.mode(mode).text(path)


# ---------------------------------------------------------------------------
# JSON
# ---------------------------------------------------------------------------
def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Whole-file JSON arrays of records (one array per file)."""
    return (spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True)
            .json(path))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines (one record per line; indentation is not kept)."""
    df.write.mode(mode).json(path)


def write_json_array(df: DataFrame, path: str, order: str | list[str], chunk_rows: int = 10_000,
                     mode: str = "overwrite") -> None:
    """Write records as JSON array files of at most ``chunk_rows`` records,
    in ``order`` (one array per file; files numbered by chunk)."""
    cols = df.columns
    d = dense_ids(df, order, "__n").withColumn("__chunk", F.floor(F.col("__n") / chunk_rows))
    arrays = (d.groupBy("__chunk")
              .agg(F.array_sort(F.collect_list(F.struct(F.col("__n"), F.struct(*cols).alias("r")))).alias("xs"))
              .select("__chunk", F.to_json(F.transform("xs", lambda x: x["r"])).alias("value")))
    arrays.write.mode(mode).partitionBy("__chunk").text(path)


def load_by_extension(spark: SparkSession, files: Mapping[str, str], schema: T.StructType | str | None = None
                      ) -> DataFrame:
    """Read each split with the reader its extension names (csv or json
    only; anything else raises) and add a ``split`` column."""
    out = None
    for split, p in files.items():
        ext = p.rstrip("/").split(".")[-1].lower()
        if ext not in ("csv", "json"):
            raise ValueError(f"{split}: extension must be csv or json, got {ext!r}")
        r = spark.read.option("header", True) if ext == "csv" else spark.read
        if schema is not None:
            r = r.schema(schema)
        df = r.format(ext).load(p).withColumn("split", F.lit(split))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def load_splits(spark: SparkSession, files: Mapping[str, str],
                reader: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """Read every split with ``reader`` and tag rows with the split name.
    Two names may point at one file (test = validation)."""
    out = None
    for split, p in files.items():
        df = reader(spark, p).withColumn("split", F.lit(split))
        out = df if out is None else out.unionByName(df)
    return out


def write_metrics(metrics_df: DataFrame, path: str, split_col: str = "split", mode: str = "overwrite") -> None:
    """One JSON metric record set per split (``split=train/``, ``split=eval/``)."""
    metrics_df.write.mode(mode).partitionBy(split_col).json(path)


# ---------------------------------------------------------------------------
# line text and lexicons
# ---------------------------------------------------------------------------
def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in file order as ``(line_id, value)`` (file-order ordinals)."""
    raw = (spark.read.text(path)
           .select("value", F.col("_metadata.file_path").alias("__file"),
                   F.col("_metadata.file_block_start").alias("__blk")))
    return file_order_ids(raw, "line_id").select("line_id", "value")


def read_paragraph_lines(spark: SparkSession, path: str) -> DataFrame:
    """One paragraph/sentence per line: ``(line_id, text, words)`` with text
    stripped and words split on single spaces (empty words kept)."""
    lines = read_lines(spark, path)
    t = py_strip(F.col("value"))
    return lines.select("line_id", t.alias("text"), split_words(t).alias("words"))


def write_lines(df: DataFrame, path: str, text_col: str, order: str | list[str], mode: str = "overwrite") -> None:
    """Rows joined by newlines, in ``order``."""
    o = [order] if isinstance(order, str) else list(order)
    df.orderBy(*o).select(F.col(text_col).alias("value")).write.mode(mode).text(path)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """One name per line, trimmed; blank lines dropped; duplicates kept."""
    names = py_strip(F.col("value"))
    return spark.read.text(path).select(names.alias("name")).where(F.col("name") != "")


def write_lexicon(df: DataFrame, path: str, name_col: str = "name", mode: str = "overwrite") -> None:
    """One name per line (duplicates kept)."""
    df.select(F.col(name_col).alias("value")).write.mode(mode).text(path)
