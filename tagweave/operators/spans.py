"""Character spans: regex annotation, token offsets, span <-> BIO conversion,
lexicon matching.

All span offsets are half-open ``[start, end)`` in code points of the text
column they were computed on.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave import constants as C
from tagweave.functions.arrays import exclusive_running_sum, running_sum
from tagweave.functions.text import leading_space, py_strip, split_words
from tagweave.operators.automaton import MAX_LEXICON_BYTES, match_names
from tagweave.operators.sweep import sweep


def _keys(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


# --------------------------------------------------------------------------
# regex spans
# --------------------------------------------------------------------------
def regex_span_items(text: Column, pattern: str, drop_pattern: str | None = None,
                     legacy_offsets: bool = False) -> Column:
    """In-row form: ``array<struct<start,end,text>>`` of all non-overlapping
    matches in scan order, matches containing ``drop_pattern`` removed.

    ``split`` and ``regexp_extract_all`` run the same Java scan, so the gap
    array has one more element than the match array and gaps + matches
    re-assemble the text.  Offsets are a prefix sum over gap and match lengths.
    With ``legacy_offsets`` a dropped match (and the gap before it) is left
    out of the running offset, as the original restart-after-match loop did.
    """
    gaps = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), 0)
    # lambdas below only read lambda variables: a row-level expression inside
    # a lambda body would be re-evaluated once per array element
    glens = F.slice(F.transform(gaps, lambda g: F.length(g)), 1, F.size(matches))

    def keep_of(m: Column) -> Column:
        if drop_pattern is None:
            return F.lit(True)
        return ~m.rlike(drop_pattern)

    items = F.zip_with(
        matches, glens,
        lambda m, gl: F.struct(
            gl.alias("glen"),
            F.length(m).alias("mlen"),
            m.alias("text"),
            keep_of(m).alias("keep"),
        ),
    )
    if legacy_offsets:
        weights = F.transform(items, lambda x: F.when(x["keep"], x["glen"] + x["mlen"]).otherwise(F.lit(0)))
    else:
        weights = F.transform(items, lambda x: x["glen"] + x["mlen"])
    before = exclusive_running_sum(weights)
    placed = F.zip_with(
        items, before,
        lambda x, b: F.struct(
            (b + x["glen"]).cast("int").alias("start"),
            (b + x["glen"] + x["mlen"]).cast("int").alias("end"),
            x["text"].alias("text"),
            x["keep"].alias("keep"),
        ),
    )
    kept = F.filter(placed, lambda x: x["keep"])
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"),
                                                x["text"].alias("text")))


def regex_spans(df: DataFrame, text_col: str, pattern: str, keys: str | Sequence[str] = "doc_id",
                drop_pattern: str | None = None, legacy_offsets: bool = False,
                prefilter: str | None = None) -> DataFrame:
    """All matches of ``pattern`` as rows ``(keys..., ord, start, end, text)``.

    ``prefilter`` is a cheap regex a text must contain before the costly scan
    runs (e.g. ``\\d`` for number patterns).  No shuffle: one row in, its spans
    out.  The definition restarts on the rest of the text after each match, so
    what stands before a match must not matter: a pattern with a lookbehind,
    an anchor or a word boundary raises unless it carries ``\\G`` itself."""
    ks = _keys(keys)
    if "\\G" not in pattern and re.search(r"\(\?<[=!]|(?<!\\)\\[bBA]|(?<![\\\[])\^", pattern):
        raise ValueError("the pattern looks at the text before a match; write it so that it can restart after each match")
    src = df.select(*ks, F.col(text_col).alias("__text"))
    if prefilter is not None:
        src = src.where(F.col("__text").rlike(prefilter))
    items = regex_span_items(F.col("__text"), pattern, drop_pattern, legacy_offsets)
    return (src.select(*ks, F.posexplode(items).alias("ord", "s"))
            .select(*ks, F.col("ord").cast("int").alias("ord"),
                    F.col("s.start").alias("start"), F.col("s.end").alias("end"),
                    F.col("s.text").alias("text")))


def drop_year_like(spans_df: DataFrame, text_col: str = "text",
                   pattern: str = C.YEAR_LIKE_PATTERN) -> DataFrame:
    """Drop spans whose text contains a year-like number anywhere."""
    return spans_df.where(~F.col(text_col).rlike(pattern))


def annotate_metric_values(df: DataFrame, text_col: str = "text", keys: str | Sequence[str] = "doc_id",
                           legacy_offsets: bool = False) -> DataFrame:
    """Number spans labelled ``MetricValue`` (year-like matches dropped)."""
    return (regex_spans(df, text_col, C.METRIC_VALUE_PATTERN, keys, C.YEAR_LIKE_PATTERN,
                        legacy_offsets, prefilter=r"\d")
            .withColumn("label", F.lit(C.METRIC_LABEL)))


def annotate_hyperparameter_values(df: DataFrame, text_col: str = "text",
                                   keys: str | Sequence[str] = "doc_id",
                                   legacy_offsets: bool = False) -> DataFrame:
    """Exponent-like spans (``1e-4``) labelled ``HyperparameterValue``."""
    return (regex_spans(df, text_col, C.HYPERPARAMETER_VALUE_PATTERN, keys, C.YEAR_LIKE_PATTERN,
                        legacy_offsets, prefilter=r"(?i)\de")
            .withColumn("label", F.lit(C.HYPERPARAMETER_LABEL)))


def merge_annotations(metric_df: DataFrame, hyper_df: DataFrame,
                      keys: str | Sequence[str] = "doc_id") -> DataFrame:
    """Merge hyperparameter spans into metric spans.

    A hyperparameter span whose text equals some metric span's text adds its
    label to the *first* (lowest ``ord``) metric span with that text; the
    others are appended after all metric spans, in their own order.
    Output: ``(keys..., ord, start, end, text, labels array<string>)``.

    Each input is evaluated once: the two span tables are unioned with a
    side flag, one window per (keys, text) finds the first metric span and
    the number of equal hyperparameter spans, one window per keys numbers
    the appended spans.  Only span rows move (never document text)."""
    ks = _keys(keys)
    m = metric_df.select(*ks, "ord", "start", "end", "text", F.lit(0).alias("__side"))
    h = hyper_df.select(*ks, "ord", "start", "end", "text", F.lit(1).alias("__side"))
    u = m.unionByName(h)
    is_m, is_h = F.col("__side") == 0, F.col("__side") == 1
    wt = Window.partitionBy(*ks, "text")
    u = (u.withColumn("__first_m", F.min(F.when(is_m, F.col("ord"))).over(wt))
          .withColumn("__n_h", F.sum(is_h.cast("int")).over(wt)))
    wd = Window.partitionBy(*ks)
    wr = Window.partitionBy(*ks).orderBy("__side", "__matched", "ord")
    u = (u.withColumn("__matched", is_h & F.col("__first_m").isNotNull())
          .withColumn("__n_metric", F.sum(is_m.cast("int")).over(wd))
          .withColumn("__rk", F.row_number().over(wr)))
    extra = F.when(is_m & (F.col("ord") == F.col("__first_m")), F.col("__n_h")).otherwise(F.lit(0))
    labels = F.when(is_m, F.concat(F.array(F.lit(C.METRIC_LABEL)),
                                   F.array_repeat(F.lit(C.HYPERPARAMETER_LABEL), extra.cast("int")))) \
              .otherwise(F.array(F.lit(C.HYPERPARAMETER_LABEL)))
    # unmatched hyperparameter spans sort right after the metric spans, so
    # their running rank - 1 is n_metric + their own position
    new_ord = F.when(is_m, F.col("ord")).otherwise(F.col("__rk") - 1)
    return (u.where(~F.col("__matched"))
            .select(*ks, new_ord.cast("int").alias("ord"), "start", "end", "text", labels.alias("labels")))


def annotation_struct(start: Column, end: Column, text: Column, labels: Column) -> Column:
    """The nested annotation record."""
    return F.struct(
        F.struct(start.alias("start"), end.alias("end"), text.alias("text"), labels.alias("labels")).alias("value"),
        F.lit(C.ANNOTATION_FROM_NAME).alias("from_name"),
        F.lit(C.ANNOTATION_TO_NAME).alias("to_name"),
        F.lit(C.ANNOTATION_TYPE).alias("type"),
    )


def to_annotation_struct(spans_df: DataFrame, keys: str | Sequence[str] = "doc_id") -> DataFrame:
    """Spans ``(keys, ord, start, end, text, labels)`` to one row per key with
    ``annotations array<struct<value, from_name, to_name, type>>`` in ord
    order.  The list of one document is bounded by that document's matches."""
    ks = _keys(keys)
    labels = F.col("labels") if "labels" in spans_df.columns else F.array(F.col("label"))
    rows = spans_df.select(*ks, F.struct(F.col("ord").alias("ord"),
                                         annotation_struct(F.col("start"), F.col("end"), F.col("text"), labels)
                                         .alias("a")).alias("x"))
    return (rows.groupBy(*ks).agg(F.array_sort(F.collect_list("x")).alias("xs"))
            .select(*ks, F.transform("xs", lambda x: x["a"]).alias("annotations")))


# --------------------------------------------------------------------------
# tokens with character offsets
# --------------------------------------------------------------------------
def tokenize_whitespace(df: DataFrame, text_col: str = "text", keys: str | Sequence[str] = "doc_id",
                        normalize: bool = False) -> DataFrame:
    """Words of the stripped text split on single spaces (empty words kept),
    with ``pos`` from 0 and half-open char offsets into the original text.

    ``normalize=True`` first collapses whitespace runs to one space (the
    offsets then refer to the normalized text).  Offsets are an in-row prefix
    sum, so no shuffle is needed."""
    ks = _keys(keys)
    t = F.col(text_col)
    if normalize:
        t = F.trim(F.regexp_replace(t, r"\s+", " "))
    stripped = py_strip(t)
    lead = leading_space(t) if not normalize else F.lit(0)
    words = split_words(stripped)
    # starts = running sum of [lead, len(w0)+1, len(w1)+1, ...]: the leading
    # whitespace rides in the array so no lambda touches a row expression
    steps = F.concat(F.array(lead.cast("int")), F.transform(words, lambda w: F.length(w) + F.lit(1)))
    starts = F.slice(running_sum(steps), 1, F.size(words))
    items = F.arrays_zip(words.alias("token"), starts.alias("start"))
    return (df.select(*ks, F.posexplode(items).alias("pos", "x"))
            .select(*ks, F.col("pos").cast("int").alias("pos"), F.col("x.token").alias("token"),
                    F.col("x.start").cast("int").alias("start"),
                    (F.col("x.start") + F.length("x.token")).cast("int").alias("end")))


# --------------------------------------------------------------------------
# spans -> BIO tags (interval join, bucketed)
# --------------------------------------------------------------------------
def spans_to_bio(tokens_df: DataFrame, spans_df: DataFrame, keys: str | Sequence[str] = "doc_id",
                 label_col: str = "label") -> DataFrame:
    """Char spans to token tags.

    The first token overlapping a span gets ``B-X``, later overlapped tokens
    ``I-X``, all others ``O``.  When spans overlap, a token takes the span
    with the earliest start, then the longest, then the smallest label.  Tokens
    of a document must not overlap one another.

    One sweep per document over sorted tokens and spans (``sweep.py``): both
    sides are exchanged once, by document, and no pair of a token and a span is
    ever a row."""
    ks = _keys(keys)
    lab = F.col(label_col) if label_col in spans_df.columns else F.element_at(F.col("labels"), 1)
    sp = spans_df.select(*ks, F.col("start").alias("s_start"), F.col("end").alias("s_end"), lab.alias("s_label"))
    return sweep(tokens_df, sp.dropna(subset=[*ks, "s_start", "s_end"]), ks)


# --------------------------------------------------------------------------
# BIO tags -> chunks
# --------------------------------------------------------------------------
def entity_type(tag: Column) -> Column:
    """``B-X``/``I-X`` -> ``X``; ``O`` -> empty."""
    dash = F.instr(tag, "-")
    return F.when(tag.isNull() | (tag == "O") | (dash == 0), F.lit("")).otherwise(F.substr(tag, dash + 1))


def chunk_flags(tag: Column, prev: Column, nxt: Column) -> tuple[Column, Column]:
    """(is_start, is_end) for the non-strict IOB2 chunk rule: a chunk starts
    at ``B-X``, or at ``I-X`` after ``O``/another type/sentence start; it ends
    where the next tag does not continue it (``I-`` of the same type)."""
    inside = tag.isNotNull() & (tag != "O")
    t = entity_type(tag)
    continues = (inside & tag.startswith("I-") & prev.isNotNull() & (prev != "O")
                 & (entity_type(prev) == t))
    next_continues = (nxt.isNotNull() & nxt.startswith("I-") & (entity_type(nxt) == t))
    return inside & ~continues, inside & ~next_continues


def bio_to_spans(tokens_df: DataFrame, sent_col: str | Sequence[str] = "sent_id", pos_col: str = "pos",
                 tag_col: str = "tag", order_cols: Sequence[str] | None = None) -> DataFrame:
    """Entity chunks ``(sent..., type, start, end)`` with token positions,
    ``end`` exclusive.  One window pass (lag/lead + running max of the chunk
    start) partitioned by sentence: no aggregation, no join."""
    ss = _keys(sent_col)
    order = list(order_cols) if order_cols else [pos_col]
    w = Window.partitionBy(*ss).orderBy(*order)
    tag = F.col(tag_col)
    is_start, is_end = chunk_flags(tag, F.lag(tag_col, 1).over(w), F.lead(tag_col, 1).over(w))
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flagged = tokens_df.select(*ss, *[c for c in order if c not in ss], tag.alias("__tag"),
                               is_start.alias("__s"), is_end.alias("__e"))
    return (flagged
            .withColumn("start", F.max(F.when(F.col("__s"), F.col(order[-1]))).over(run))
            .where(F.col("__e"))
            .select(*ss, entity_type(F.col("__tag")).alias("type"), F.col("start").cast("int").alias("start"),
                    (F.col(order[-1]) + 1).cast("int").alias("end")))


# --------------------------------------------------------------------------
# lexicon match (automaton, longest match wins, left to right)
# --------------------------------------------------------------------------
def lexicon_match(tokens_df: DataFrame, lexicon_df: DataFrame, label: str,
                  keys: str | Sequence[str] = "doc_id", name_col: str = "name", max_words: int | None = None,
                  max_bytes: int = MAX_LEXICON_BYTES) -> DataFrame:
    """Pre-annotate lexicon names as token spans ``(keys, start, end, label)``
    (token positions, ``end`` exclusive), ignoring case: left to right, the
    longest name at a start, no overlaps.

    A token-level automaton of all names (``automaton.py``) reads each
    document's words once, in order, whatever the length of the names.  It is
    shipped after a check of its size; a lexicon beyond ``max_bytes`` is read
    in blocks.  ``max_words``, if given, is the longest name allowed: a longer
    one raises."""
    ks = _keys(keys)
    lex = lexicon_df.select(F.lower(F.col(name_col)).alias("name")).where(F.col("name") != "").distinct()
    if max_words is not None:
        longest = lex.agg(F.max(F.size(F.split("name", " ", -1)))).first()[0] or 0
        if longest > max_words:
            raise ValueError(f"the lexicon has a name of {longest} words; max_words is {max_words}")
    words = tokens_df.select(*ks, "pos", F.lower(F.col("token")).alias("w"))
    return match_names(words, lex, ks, max_bytes).select(*ks, "start", "end", F.lit(label).alias("label"))
