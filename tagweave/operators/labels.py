"""Label vocabulary operators: list, encode/decode, B-to-I map, reconcile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagweave import constants as C


def labels_table(spark: SparkSession, labels: Sequence[str] = C.LABELS) -> DataFrame:
    """``(id int, tag string)`` with id = list position."""
    return spark.createDataFrame([(i, t) for i, t in enumerate(labels)], "id int, tag string")


def label_list(sent_df: DataFrame, tags_col: str = "tags") -> DataFrame:
    """Distinct labels over all sentences, sorted, id = position from 0.
    The distinct runs distributed (partial aggregation); only the final,
    vocabulary-sized result is ranked in one partition."""
    d = sent_df.select(F.explode(F.array_distinct(tags_col)).alias("tag")).distinct()
    return d.select((F.row_number().over(Window.orderBy("tag")) - 1).cast("int").alias("id"), "tag")


def _map_literal(labels: Sequence[str], inverse: bool = False) -> Column:
    kv = []
    for i, t in enumerate(labels):
        kv += [F.lit(i), F.lit(t)] if inverse else [F.lit(t), F.lit(i)]
    return F.create_map(*kv)


def encode_labels(tokens_df: DataFrame, labels: Sequence[str] | DataFrame = C.LABELS,
                  tag_col: str = "tag", id_col: str = "label_id") -> DataFrame:
    """Tag -> id; an unknown tag raises.  A Python list becomes an in-plan map
    literal (no join); a DataFrame vocabulary is joined (the optimizer picks the
    join by measured size)."""
    if isinstance(labels, DataFrame):
        lab = labels.select(F.col("tag").alias("__t"), F.col("id").alias("__id"))
        out = tokens_df.join(lab, tokens_df[tag_col] == lab["__t"], "left").drop("__t")
        idc = F.col("__id")
    else:
        out = tokens_df
        idc = F.element_at(_map_literal(labels), F.col(tag_col))
    checked = F.when(idc.isNull(), F.raise_error(F.concat(F.lit("unknown tag: "), F.col(tag_col).cast("string")))) \
               .otherwise(idc).cast("int")
    out = out.withColumn(id_col, checked)
    return out.drop("__id") if "__id" in out.columns else out


def decode_labels(df: DataFrame, labels: Sequence[str] | DataFrame = C.LABELS,
                  id_col: str = "label_id", tag_col: str = "tag", unknown: str = "raise") -> DataFrame:
    """Id -> tag; an unknown id raises, or gives null with ``unknown="null"``."""
    if unknown not in ("raise", "null"):
        raise ValueError("unknown must be 'raise' or 'null'")

    def checked(tag: Column) -> Column:
        if unknown == "null":
            return tag
        return F.when(tag.isNull(), F.raise_error(F.concat(F.lit("unknown label id: "), F.coalesce(
            F.col(id_col).cast("string"), F.lit("null")))).cast("string")).otherwise(tag)

    if isinstance(labels, DataFrame):
        lab = labels.select(F.col("id").alias("__id"), F.col("tag").alias("__t"))
        return (df.join(lab, df[id_col] == lab["__id"], "left").drop("__id")
                .withColumn(tag_col, checked(F.col("__t"))).drop("__t"))
    return df.withColumn(tag_col, checked(F.try_element_at(_map_literal(labels, inverse=True), F.col(id_col).cast("int"))))


def begin_to_inside(labels_df: DataFrame) -> DataFrame:
    """For each label id: the id of its ``I-`` form when the label starts
    with ``B-`` and that form exists, else its own id."""
    inside = labels_df.select(F.col("tag").alias("i_tag"), F.col("id").alias("i_id"))
    cand = labels_df.withColumn("want", F.when(F.col("tag").startswith("B-"),
                                               F.replace(F.col("tag"), F.lit("B-"), F.lit("I-"))))
    return (cand.join(inside, F.col("want") == F.col("i_tag"), "left")
            .select("id", "tag", F.coalesce(F.col("i_id"), F.col("id")).cast("int").alias("inside_id")))


def reconcile_labels(data_labels: DataFrame, model_labels: DataFrame) -> DataFrame:
    """Compare a dataset vocabulary with a model's.  Same set of names: the
    dataset adopts the model's ids (status ``reordered``); otherwise the
    dataset order is kept (status ``mismatch``, a warning in the original).
    Output ``(tag, data_id, model_id, id, status)``."""
    d = data_labels.select(F.col("tag"), F.col("id").alias("data_id"))
    m = model_labels.select(F.col("tag"), F.col("id").alias("model_id"))
    j = d.join(m, "tag", "full_outer")
    same = F.min((F.col("data_id").isNotNull() & F.col("model_id").isNotNull()).cast("int")).over(Window.partitionBy())
    j = j.withColumn("__same", same)
    return j.select(
        "tag", F.col("data_id").cast("int").alias("data_id"), F.col("model_id").cast("int").alias("model_id"),
        F.when(F.col("__same") == 1, F.col("model_id")).otherwise(F.col("data_id")).cast("int").alias("id"),
        F.when(F.col("__same") == 1, F.lit("reordered")).otherwise(F.lit("mismatch")).alias("status"),
    )
