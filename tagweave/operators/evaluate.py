"""Entity-level evaluation, corpus statistics, and per-token losses.

Exact-chunk scoring uses one window pass over the token rows of each
sentence (or batch), or the tag arrays of sentence rows as they are: gold and predicted chunk ends are found together, so a
chunk is correct when both sides end at the same token with the same type
and the same start.  No join of chunk tables is needed, and the only shuffle
is the partitioning of tokens by sentence (reused if the input already has
it).  Per-type totals then use partial (map-side) aggregation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.operators.decode import log_sum_exp_online
from tagweave.operators.spans import _keys, chunk_flags, entity_type
from tagweave.session import cut_lineage


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def _prf(correct: Column, pred: Column, gold: Column):
    p = _safe_div(correct, pred)
    r = _safe_div(correct, gold)
    f = F.when((p + r) == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))
    return p, r, f


def scored_tokens(tokens_df: DataFrame, gold_col: str = "gold", pred_col: str = "pred",
                  part_cols: str | Sequence[str] = "sent_id", order_cols: Sequence[str] = ("pos",)) -> DataFrame:
    """Every token row with ``gold_type`` / ``pred_type`` (set where a gold /
    predicted chunk ends on this token), ``correct`` (both chunks end here
    with the same type and start) and ``equal`` (token tags agree).  Where
    ``gold_col`` and ``pred_col`` are arrays, a row is a whole part in order and
    is scored in its row; token rows are sorted first."""
    ps = _keys(part_cols)
    if isinstance(tokens_df.schema[gold_col].dataType, T.ArrayType):
        return _scored_rows(tokens_df.select(*ps, gold_col, pred_col), ps)
    order = list(order_cols)
    w = Window.partitionBy(*ps).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g, p = F.col(gold_col), F.col(pred_col)
    gs, ge = chunk_flags(g, F.lag(g, 1).over(w), F.lead(g, 1).over(w))
    ps_, pe = chunk_flags(p, F.lag(p, 1).over(w), F.lead(p, 1).over(w))
    idx = F.row_number().over(w)
    step1 = tokens_df.select(*ps, *[c for c in order if c not in ps], g.alias("__g"), p.alias("__p"),
                             gs.alias("__gs"), ge.alias("__ge"), ps_.alias("__ps"), pe.alias("__pe"),
                             idx.alias("__i"))
    step2 = (step1
             .withColumn("__gst", F.max(F.when(F.col("__gs"), F.col("__i"))).over(run))
             .withColumn("__pst", F.max(F.when(F.col("__ps"), F.col("__i"))).over(run)))
    gt = F.when(F.col("__ge"), entity_type(F.col("__g")))
    pt = F.when(F.col("__pe"), entity_type(F.col("__p")))
    correct = F.coalesce(F.col("__ge") & F.col("__pe") & (gt == pt) & (F.col("__gst") == F.col("__pst")), F.lit(False))
    return step2.select(*ps, gt.alias("gold_type"), pt.alias("pred_type"), correct.alias("correct"),
                        F.coalesce(F.col("__g") == F.col("__p"), F.lit(False)).alias("equal"))


SLICE_TOKENS = 262_144


def _chunks(code: np.ndarray, names: list[str | None], types: dict[str, int], first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tag numbers -> (type number, whether a chunk ends, where the last one
    started), by the rule of ``chunk_flags``."""
    def type_of(tag: str | None) -> str:
        return "" if tag is None or tag == "O" or "-" not in tag else tag.split("-", 1)[1]

    kind = np.array([types.setdefault(type_of(t), len(types)) for t in names], dtype=np.int64)[code]
    inside = np.array([t is not None and t != "O" for t in names])[code]
    goes_on = np.array([t is not None and t.startswith("I-") for t in names])[code]
    same = np.zeros(len(code), dtype=bool)
    same[1:] = (kind[1:] == kind[:-1]) & ~first[1:] & goes_on[1:]
    starts = inside.copy()
    starts[1:] &= ~(same[1:] & inside[:-1])
    ends = inside.copy()
    ends[:-1] &= ~(same[1:] & ~last[:-1])
    return kind, ends, np.maximum.accumulate(np.where(starts, np.arange(len(code)), -1))


def _scored_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows(keys, gold, pred), both arrays of one length -> the token rows of
    ``scored_tokens``, in slices of about ``SLICE_TOKENS`` tokens."""
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("gold_type", T.StringType()), T.StructField("pred_type", T.StringType()),
                           T.StructField("correct", T.BooleanType()), T.StructField("equal", T.BooleanType())])
    nk = len(keys)

    def score(b: pa.RecordBatch, size: np.ndarray) -> pa.RecordBatch:
        n = int(size.sum())
        first, last = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        at = (np.cumsum(size) - size)[size > 0]
        first[at] = True
        last[at + size[size > 0] - 1] = True
        codes, tags, types, sides = [], {}, {}, []
        for i in (nk, nk + 1):
            d = b.column(i).flatten().dictionary_encode(null_encoding="encode")
            names = d.dictionary.to_pylist()
            code = d.indices.to_numpy(zero_copy_only=False)
            codes.append(np.array([-1 if t is None else tags.setdefault(t, len(tags)) for t in names], dtype=np.int64)[code])
            sides.append(_chunks(code, names, types, first, last))
        (gk, ge, gs), (pk, pe, ps) = sides
        values = pa.array(list(types), pa.string())
        typed = [pa.DictionaryArray.from_arrays(pa.array(k.astype(np.int32), mask=~e), values).cast(pa.string()) for k, e in ((gk, ge), (pk, pe))]
        row = pa.array(np.repeat(np.arange(b.num_rows), size))
        return pa.RecordBatch.from_arrays([*(b.column(i).take(row) for i in range(nk)), *typed, pa.array(ge & pe & (gk == pk) & (gs == ps)),
                                           pa.array((codes[0] == codes[1]) & (codes[0] >= 0))], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, other = (b.column(i).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for i in (nk, nk + 1))
            if (size != other).any():
                raise ValueError("gold and predicted tags differ in number")
            part = (np.cumsum(size) - size) // SLICE_TOKENS
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
            for a, z in zip(cuts, cuts[1:]):
                if size[a:z].any():
                    yield score(b.slice(a, z - a), size[a:z])

    return rows.mapInArrow(run, schema)


def chunk_matches(tokens_df: DataFrame, gold_col: str = "gold", pred_col: str = "pred",
                  part_cols: str | Sequence[str] = "sent_id", order_cols: Sequence[str] = ("pos",)) -> DataFrame:
    """Per chunk-ending token: ``(gold_type, pred_type, correct)``; either
    type is null when that side has no chunk ending there."""
    s = scored_tokens(tokens_df, gold_col, pred_col, part_cols, order_cols)
    return s.where(F.col("gold_type").isNotNull() | F.col("pred_type").isNotNull()).drop("equal")


def _type_counts(matches: DataFrame) -> DataFrame:
    ev = matches.select(F.explode(F.array(
        F.struct(F.col("gold_type").alias("type"), F.lit(1).alias("g"), F.lit(0).alias("p"),
                 F.col("correct").cast("int").alias("c")),
        F.struct(F.col("pred_type").alias("type"), F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("c")),
    )).alias("e")).where(F.col("e.type").isNotNull())
    return ev.groupBy(F.col("e.type").alias("type")).agg(
        F.sum("e.c").cast("long").alias("n_correct"),
        F.sum("e.p").cast("long").alias("n_pred"),
        F.sum("e.g").cast("long").alias("n_gold"))


def entity_metrics_by_type(tokens_df: DataFrame, gold_col: str = "gold", pred_col: str = "pred",
                           sent_col: str | Sequence[str] = "sent_id", pos_col: str = "pos") -> DataFrame:
    """Exact-chunk precision, recall, f1 and number (gold count) per entity
    type; 0 where a denominator is 0."""
    c = _type_counts(chunk_matches(tokens_df, gold_col, pred_col, sent_col, [pos_col]))
    p, r, f = _prf(F.col("n_correct"), F.col("n_pred"), F.col("n_gold"))
    return c.select("type", "n_correct", "n_pred", "n_gold", p.alias("precision"), r.alias("recall"),
                    f.alias("f1"), F.col("n_gold").alias("number"))


def overall_scores(scored: DataFrame, by: Sequence[str | Column] = ()) -> DataFrame:
    """Micro scores and token accuracy in one aggregation over scored tokens,
    for each group of ``by`` if given."""
    j = scored.groupBy(*by).agg(
        F.coalesce(F.sum(F.col("correct").cast("long")), F.lit(0)).alias("n_correct"),
        F.count(F.col("pred_type")).alias("n_pred"),
        F.count(F.col("gold_type")).alias("n_gold"),
        F.count(F.lit(1)).alias("n_tokens"),
        F.coalesce(F.sum(F.col("equal").cast("long")), F.lit(0)).alias("n_equal"))
    p, r, f = _prf(F.col("n_correct"), F.col("n_pred"), F.col("n_gold"))
    names = [c for c in j.columns if c not in ("n_correct", "n_pred", "n_gold", "n_tokens", "n_equal")]
    return j.select(*names, "n_correct", "n_pred", "n_gold", "n_tokens", p.alias("precision"), r.alias("recall"),
                    f.alias("f1"), _safe_div(F.col("n_equal"), F.col("n_tokens")).alias("accuracy"))


def entity_metrics_overall(tokens_df: DataFrame, gold_col: str = "gold", pred_col: str = "pred",
                           sent_col: str | Sequence[str] = "sent_id", pos_col: str = "pos") -> DataFrame:
    """Micro precision/recall/f1 over all chunks, and token accuracy (one
    window pass, one aggregation)."""
    return overall_scores(scored_tokens(tokens_df, gold_col, pred_col, sent_col, [pos_col]))


def entity_metrics_batched(tokens_df: DataFrame, batch_col: str = "batch_id", gold_col: str = "gold",
                           pred_col: str = "pred", sent_col: str = "sent_id", pos_col: str = "pos") -> DataFrame:
    """Same micro score, but each batch is one sequence (sentences in batch
    order), so chunks may run across sentence ends."""
    return overall_scores(scored_tokens(tokens_df, gold_col, pred_col, batch_col, [sent_col, pos_col]))


def overall_from_type_counts(by_type_df: DataFrame) -> DataFrame:
    """Micro scores from per-type counts (no second pass over tokens)."""
    t = by_type_df.agg(F.sum("n_correct").alias("n_correct"), F.sum("n_pred").alias("n_pred"),
                       F.sum("n_gold").alias("n_gold"))
    p, r, f = _prf(F.col("n_correct"), F.col("n_pred"), F.col("n_gold"))
    return t.select("n_correct", "n_pred", "n_gold", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def flatten_metrics(by_type_df: DataFrame, overall_df: DataFrame | None = None,
                    metrics: Sequence[str] = ("precision", "recall", "f1", "number")) -> DataFrame:
    """Nested per-type record to one wide row of ``{type}_{metric}`` columns
    (plus ``overall_{metric}``).  The pivot keys are computed from the
    (entity-type-sized) metric table."""
    longf = by_type_df.select("type", F.explode(F.array(*[
        F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")) \
        .select(F.concat_ws("_", "type", "x.m").alias("key"), F.col("x.v").alias("value"))
    if overall_df is not None:
        om = [m for m in ("precision", "recall", "f1", "accuracy") if m in overall_df.columns]
        longf = longf.unionByName(overall_df.select(F.explode(F.array(*[
            F.struct(F.lit(f"overall_{m}").alias("key"), F.col(m).cast("double").alias("value")) for m in om]))
            .alias("x")).select("x.key", "x.value"))
    # the long form has (types x metrics) rows: materialize it so the pivot's
    # key-discovery job does not re-run the token pass
    longf = cut_lineage(longf)
    return longf.groupBy().pivot("key").agg(F.first("value"))


def entity_type_counts(tokens_df: DataFrame, tag_col: str = "tag") -> DataFrame:
    """Number of entities per type (count of ``B-`` tags)."""
    return (tokens_df.where(F.col(tag_col).startswith("B-"))
            .groupBy(F.regexp_replace(tag_col, "^B-", "").alias("type"))
            .agg(F.count(F.lit(1)).alias("n_entities")))


def corpus_statistics(tokens_df: DataFrame, split_col: str | None = "split", sent_col: str = "sent_id",
                      token_col: str = "token") -> DataFrame:
    """Per split: sentences, tokens, min/mean/max sentence length, vocabulary."""
    gk = [split_col] if split_col else []
    per_sent = tokens_df.groupBy(*gk, sent_col).agg(F.count(F.lit(1)).alias("len"))
    lens = per_sent.groupBy(*gk).agg(
        F.count(F.lit(1)).alias("n_sentences"), F.sum("len").cast("long").alias("n_tokens"),
        F.min("len").alias("min_len"), F.avg("len").alias("mean_len"), F.max("len").alias("max_len"))
    vocab = tokens_df.groupBy(*gk).agg(F.countDistinct(token_col).alias("vocab_size"))
    return lens.join(vocab, gk, "inner") if gk else lens.crossJoin(vocab)


# ---------------------------------------------------------------------------
# per-token scores
# ---------------------------------------------------------------------------
def argmax_expr(scores: Column) -> Column:
    """0-based index of the largest score (first one on ties)."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def argmax_decode(df: DataFrame, logits_col: str = "logits", out_col: str = "pred_id") -> DataFrame:
    return df.withColumn(out_col, argmax_expr(F.col(logits_col)))


def log_sum_exp(scores: Column) -> Column:
    """Stable log(sum(exp(x))) over an array (one pass; see decode)."""
    return log_sum_exp_online(scores)


def token_cross_entropy(logits: Column, label: Column) -> Column:
    """-log softmax(logits)[label]."""
    return log_sum_exp(logits) - F.get(logits, label)


def masked_cross_entropy(df: DataFrame, logits_col: str = "logits", label_col: str = "label",
                         ignore_index: int = -1, group_cols: Sequence[str] = ()) -> DataFrame:
    """Mean over unmasked tokens of -log softmax(logits)[label]."""
    d = df.where(F.col(label_col) != F.lit(ignore_index))
    loss = token_cross_entropy(F.col(logits_col), F.col(label_col))
    return d.groupBy(*group_cols).agg(F.avg(loss).alias("loss"), F.count(F.lit(1)).alias("n_tokens"))


def mean_of_batch_losses(df: DataFrame, batch_col: str = "batch_id", loss_col: str = "loss") -> DataFrame:
    """Unweighted mean of per-batch mean losses."""
    per = df.groupBy(batch_col).agg(F.avg(loss_col).alias("batch_loss"))
    return per.agg(F.avg("batch_loss").alias("loss"), F.count(F.lit(1)).alias("n_batches"))
