"""Projections and filters over papers, bibliography records and label arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave import constants as C

def project_papers(papers_df: DataFrame) -> DataFrame:
    """Keep url and title; wrap the abstract in an array; content = text of
    every section in order."""
    return papers_df.select(
        "url", "title", F.array(F.col("abstract")).alias("abstract"),
        F.transform("sections", lambda s: s["text"]).alias("content"))


def filter_venues(bib_df: DataFrame, venues: Sequence[str] | DataFrame = tuple(C.TARGET_VENUES),
                  venue_col: str = "venue") -> DataFrame:
    """Keep records whose venue is in the list or table; a null venue is
    dropped.  One semi join for both forms; the optimizer picks its kind by
    measured size."""
    if not isinstance(venues, DataFrame):
        venues = bib_df.sparkSession.createDataFrame([(x,) for x in venues], "__v string")
    v = venues.select(F.col(venues.columns[0]).alias("__v")).distinct()
    return bib_df.join(v, bib_df[venue_col] == v["__v"], "left_semi")


def mask_ignored(df: DataFrame, pred_col: str = "preds", label_col: str = "labels",
                 ignore_index: int = C.IGNORE_INDEX_BASELINE, labels: Sequence[str] | None = tuple(C.LABELS),
                 out_pred: str = "pred_tags", out_label: str = "gold_tags") -> DataFrame:
    """Per sequence: keep (pred, label) pairs whose label is not
    ``ignore_index`` and map ids to tags (or keep ids when ``labels`` is
    None).  In-row: zip + filter + transform."""
    pairs = F.filter(F.arrays_zip(F.col(pred_col).alias("p"), F.col(label_col).alias("l")),
                     lambda x: x["l"] != F.lit(ignore_index))
    if labels is None:
        return (df.withColumn(out_pred, F.transform(pairs, lambda x: x["p"]))
                .withColumn(out_label, F.transform(pairs, lambda x: x["l"])))
    lab = F.array(*[F.lit(t) for t in labels])
    tags = F.transform(pairs, lambda x: F.struct(F.get(lab, x["p"]).alias("p"), F.get(lab, x["l"]).alias("l")))
    return (df.withColumn("__tags", tags)
            .withColumn(out_pred, F.transform("__tags", lambda x: x["p"]))
            .withColumn(out_label, F.transform("__tags", lambda x: x["l"]))
            .drop("__tags"))


def resolve_columns(df: DataFrame, text_col: str | None = None, label_col: str | None = None,
                    task: str = "ner", keep: Sequence[str] = ()) -> DataFrame:
    """Pick the text column (explicit, else ``tokens``, else the first) and
    the label column (explicit, else ``{task}_tags``, else the second);
    return them as ``text`` and ``label`` (plus ``keep`` columns).  Only
    column names are read on the driver."""
    cols = df.columns
    t = text_col or ("tokens" if "tokens" in cols else cols[0])
    lab = label_col or (f"{task}_tags" if f"{task}_tags" in cols else cols[1])
    return df.select(*keep, F.col(t).alias("text"), F.col(lab).alias("label"))
