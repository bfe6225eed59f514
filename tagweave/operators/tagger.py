"""Count-based linear-chain tagger (the re-aimed form of the neural tagger):
train from tagged sentences, continue from an earlier model leaving a
component out, tag raw lines with Viterbi.

Model rows: ``(kind, a, b, n, logp)``
  start  ('', tag)      tag opens a sentence
  end    (tag, '')      tag closes a sentence
  trans  (prev, tag)    tag follows prev
  emit   (tag, word)    tag emits the lower-cased word
plus ``*_unk`` rows holding the smoothed score of an unseen event per
condition.  Scores are add-alpha smoothed log probabilities."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.text import py_strip, split_words
from tagweave.operators.decode import block_firsts, block_forward, block_product, block_trace, viterbi_rows
from tagweave.operators.spans import _keys
from tagweave.session import cut_lineage

KINDS = ("start", "end", "trans", "emit")
MAX_TAGS = 1_000


def tag_counts(tokens_df: DataFrame, sent_col: str = "sent_id", pos_col: str = "pos", token_col: str = "token",
               tag_col: str = "tag") -> DataFrame:
    """Event counts ``(kind, a, b, n)``, of token rows or of sentence rows with
    arrays.  Words are counted in their tasks first.  Neighbours are found in a
    sentence's row; of token rows only sentence, position and tag travel to the
    window pass that finds them."""
    if isinstance(tokens_df.schema[tag_col].dataType, T.ArrayType):
        # zipped arrays: exploding positions beside a kept array takes twice as long
        tags = F.col(tag_col)
        before = F.slice(F.concat(F.array(F.lit(None).cast("string")), tags), 1, F.size(tags))
        near = F.arrays_zip(tags.alias("__t"), before.alias("__prev"), F.slice(tags, 2, F.size(tags)).alias("__next"))
        t = tokens_df.select(F.explode(near).alias("x")).select("x.*")
        words = tokens_df.select(F.explode(F.arrays_zip(tags.alias("__t"), F.col(token_col).alias("__w"))).alias("x")).select("x.*")
    else:
        w = Window.partitionBy(sent_col).orderBy(pos_col)
        t = tokens_df.select(F.col(tag_col).alias("__t"), F.lag(tag_col).over(w).alias("__prev"), F.lead(tag_col).over(w).alias("__next"))
        words = tokens_df.select(F.col(tag_col).alias("__t"), F.col(token_col).alias("__w"))
    event = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    none, tag, prev = F.lit(""), F.col("__t"), F.col("__prev")
    # different neighbourhoods are few; each gives its events once
    seen = t.groupBy("__prev", "__t", F.col("__next").isNull().alias("__last")).agg(F.count(F.lit(1)).alias("n"))
    ev = seen.select("n", F.explode(F.array(
        F.when(prev.isNull(), event("start", none, tag)).otherwise(event("trans", prev, tag)),
        F.when(F.col("__last"), event("end", tag, none)),
    )).alias("e")).where(F.col("e").isNotNull())
    emit = words.groupBy(F.lit("emit").alias("kind"), tag.alias("a"), F.lower(F.col("__w")).alias("b"))
    return ev.groupBy("e.kind", "e.a", "e.b").agg(F.sum("n").alias("n")).unionByName(emit.agg(F.count(F.lit(1)).alias("n")))


def normalize_counts(counts: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Add-alpha log probabilities plus ``*_unk`` rows.  Denominators:
    start/end over all sentences (K outcomes), trans per previous tag (K
    outcomes), emit per tag (V outcomes).  K and V are global scalars from
    a one-row aggregate (cross-joined, not collected)."""
    # the count table (model-sized: events x outcomes, not tokens) is read
    # three times below; materialize it once so the token pass runs once
    c = cut_lineage(counts.where(F.col("kind").isin(*KINDS)))
    emit = c.where(F.col("kind") == "emit")
    sizes = cut_lineage(emit.select("a").distinct().agg(F.count("a").alias("__K"))
                        .crossJoin(emit.select("b").distinct().agg(F.count("b").alias("__V"))))
    cond = F.when(F.col("kind").isin("start", "end"), F.lit("")).otherwise(F.col("a"))
    c = c.withColumn("__cond", F.when(F.col("kind") == "end", F.lit("")).otherwise(cond))
    tot = c.groupBy("kind", "__cond").agg(F.sum("n").alias("__tot"))
    j = c.join(tot, ["kind", "__cond"]).crossJoin(sizes)
    outcomes = F.when(F.col("kind") == "emit", F.col("__V")).otherwise(F.col("__K")).cast("double")
    a = F.lit(float(alpha))
    denom = F.col("__tot") + a * outcomes
    seen = j.select("kind", "a", "b", F.col("n").cast("long").alias("n"),
                    F.log((F.col("n") + a) / denom).alias("logp"))
    unk = (tot.crossJoin(sizes)
           .select(F.concat(F.col("kind"), F.lit("_unk")).alias("kind"),
                   F.col("__cond").alias("a"), F.lit("").alias("b"), F.lit(0).cast("long").alias("n"),
                   F.log(a / (F.col("__tot") + a * F.when(F.col("kind") == "emit", F.col("__V"))
                              .otherwise(F.col("__K")).cast("double"))).alias("logp")))
    return seen.unionByName(unk)


def train_tag_model(tokens_df: DataFrame, sent_col: str = "sent_id", pos_col: str = "pos",
                    token_col: str = "token", tag_col: str = "tag", alpha: float = 1.0) -> DataFrame:
    """Learn start/transition/end and word-to-tag scores."""
    return normalize_counts(tag_counts(tokens_df, sent_col, pos_col, token_col, tag_col), alpha)


def merge_tag_models(base_df: DataFrame, new_df: DataFrame, exclude: Sequence[str] = ("emit",),
                     alpha: float = 1.0) -> DataFrame:
    """Continue from ``base``: its counts are added to ``new`` except for the
    excluded kinds, then everything is re-normalized."""
    b = base_df.where(F.col("kind").isin(*KINDS) & ~F.col("kind").isin(*exclude)).select("kind", "a", "b", "n")
    n = new_df.where(F.col("kind").isin(*KINDS)).select("kind", "a", "b", "n")
    merged = b.unionByName(n).groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    return normalize_counts(merged, alpha)


def model_tags(model_df: DataFrame) -> list[str]:
    """The tag vocabulary (sorted), from every kind of row, so a tag that only
    an earlier model saw stays known.  Collected within ``MAX_TAGS``."""
    named = F.when(F.col("kind").isin("emit_unk", "emit", "end", "trans", "trans_unk"), F.array("a")).otherwise(F.array().cast("array<string>"))
    opened = F.when(F.col("kind").isin("start", "trans"), F.array("b")).otherwise(F.array().cast("array<string>"))
    tags = model_df.select(F.explode(F.concat(named, opened)).alias("a")).where(F.col("a") != "").distinct()
    # more than this many tags is not a tag set: its squared transition table would not fit
    found = [r[0] for r in tags.orderBy("a").limit(MAX_TAGS + 1).collect()]
    if len(found) > MAX_TAGS:
        raise ValueError(f"the model has more than {MAX_TAGS} tags")
    return found


def _small_matrices(model_df: DataFrame, tags: list[str]):
    """Start/end vectors and the K x K transition matrix (K^2 numbers)."""
    rows = model_df.where(F.col("kind").isin("start", "end", "trans", "start_unk", "end_unk", "trans_unk")) \
        .select("kind", "a", "b", "logp").collect()
    d = {(r.kind, r.a, r.b): r.logp for r in rows}
    idx = {t: i for i, t in enumerate(tags)}
    K = len(tags)
    su, eu = d.get(("start_unk", "", "")), d.get(("end_unk", "", ""))
    start = [d.get(("start", "", t), su) for t in tags]
    end = [d.get(("end", t, ""), eu) for t in tags]
    trans = [[d.get(("trans", a, b), d.get(("trans_unk", a, ""), min(start))) for b in tags] for a in tags]
    assert len(idx) == K
    return trans, start, end


SCORE_UNIT = 1e-6
MAX_SHIPPED_SCORES = 64 << 20
MAX_TAG_COLUMNS = 64
BLOCK_TOKENS = 32_768
SLICE_TOKENS = 262_144


class Scores:
    """Whole-number scores of words, tags and transitions; a word's row holds
    one score per tag."""

    def __init__(self, words: pa.Array, rows: np.ndarray, unknown: np.ndarray, trans: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.words, self.rows = words, np.concatenate([rows, unknown[None, :]])
        self.trans, self.start, self.end = trans, start, end

    def places(self, words: pa.Array) -> np.ndarray:
        """Row of every word; one look-up table is built for all of them."""
        return pc.fill_null(pc.index_in(words, self.words), len(self.rows) - 1).to_numpy(zero_copy_only=False)

    def of(self, words: pa.Array) -> np.ndarray:
        return self.rows[self.places(words)].astype(np.float64)


def _whole(x: Column) -> Column:
    """Log scores as whole multiples of ``SCORE_UNIT``: sums are then exact in
    any order, and equal scores are equal everywhere."""
    return F.round(x / F.lit(SCORE_UNIT), 0)


def _emission_table(model_df: DataFrame, tags: list[str]) -> tuple[DataFrame, list[float]]:
    """(w, n, em): occurrences and a score per tag for every word the model
    knows; and the scores of an unknown word."""
    unk = {r.a: r.u for r in model_df.where(F.col("kind") == "emit_unk").select("a", _whole(F.col("logp")).alias("u")).collect()}
    floor = min(unk.values(), default=0.0)
    unknown = [unk.get(t, floor) for t in tags]
    seen = model_df.where(F.col("kind") == "emit").select(F.col("a").alias("tag"), F.col("b").alias("w"), "n", _whole(F.col("logp")).alias("s"))
    if len(tags) <= MAX_TAG_COLUMNS:                # a column for each tag is aggregated without objects
        wide = seen.groupBy("w").agg(F.sum("n").alias("n"), *[F.max(F.when(F.col("tag") == t, F.col("s"))).alias(f"s{i}") for i, t in enumerate(tags)])
        of = [F.col(f"s{i}") for i in range(len(tags))]
    else:
        wide = seen.groupBy("w").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("tag", "s"))).alias("m"))
        of = [F.try_element_at("m", F.lit(t)) for t in tags]
    return wide.select("w", "n", F.array(*[F.coalesce(c, F.lit(u)) for c, u in zip(of, unknown)]).cast("array<int>").alias("em")), unknown


def predict_tags(lines_df: DataFrame, model_df: DataFrame, text_col: str = "text",
                 keys: str | Sequence[str] = "sent_id", block_tokens: int = BLOCK_TOKENS,
                 max_shipped: int = MAX_SHIPPED_SCORES) -> DataFrame:
    """Tag raw lines: one tag per given word, by the best path of the model.
    Scores are whole multiples of ``SCORE_UNIT``; of equally good tags the first
    in sorted order is taken, from the last word back.

    Lines stay in their row and travel to Python as texts.  The scores of the
    model's distinct words are
    shipped after a check of their size; of a larger table, the commonest words
    that fit.  Then only lines that hold a rarer word travel: those words are
    joined with the table, never a line's other words.  Lines of more than
    ``block_tokens`` words are cut into blocks that are decoded apart: max-plus
    products of the blocks give the scores at every border, the back-pointers of
    each block its entry, and the chain of entries the path - the same path as
    in one piece."""
    ks = _keys(keys)
    model_df = cut_lineage(model_df)                # read several times below
    tags = model_tags(model_df)
    schema = T.StructType([*(lines_df.schema[k] for k in ks), T.StructField("pos", T.IntegerType()), T.StructField("word", T.StringType()),
                           T.StructField("tag", T.StringType())])
    if not tags:
        return lines_df.sparkSession.createDataFrame([], schema)
    whole = lambda m: np.round(np.array(m, dtype=np.float64) / SCORE_UNIT)
    trans, start, end = (whole(m) for m in _small_matrices(model_df, tags))
    table, unknown = _emission_table(model_df, tags)
    table = cut_lineage(table)
    n_bytes = F.octet_length("w") + 4 * len(tags) + 64
    size = table.agg(F.sum(n_bytes)).first()[0] or 0
    spark = lines_df.sparkSession
    text = py_strip(F.col(text_col))
    # a line's words as one text, as given and lower-cased (no letter's case depends on the words beside its own)
    rows = lines_df.select(*ks, text.alias("words"), F.lower(text).alias("w")).where("words is not null")
    lower = F.transform("words", lambda w: F.lower(w))
    n, n_keys = len(tags), len(ks)
    all_shipped = size <= max_shipped
    common = table
    if not all_shipped:
        # the smallest count whose words, with all commoner ones, fit; one row per different count is ordered
        by_count = table.groupBy("n").agg(F.sum(n_bytes).alias("s"))
        fits = by_count.select("n", F.sum("s").over(Window.orderBy(F.desc("n"))).alias("upto")).where(F.col("upto") <= max_shipped)
        least = fits.agg(F.min("n")).first()[0]
        common = table.where(F.col("n") >= least) if least is not None else table.limit(0)
    got = common.select("w", "em").toArrow()
    matrix = np.asarray(got.column("em").combine_chunks().flatten()).reshape(-1, n) if got.num_rows else np.zeros((0, n), dtype=np.int32)
    shipped = spark.sparkContext.broadcast({"words": got.column("w").combine_chunks(), "rows": matrix})
    fixed = spark.sparkContext.broadcast((np.array(unknown), trans, start, end))

    def scores() -> Scores:
        unk, t, s, e = fixed.value
        return Scores(shipped.value["words"], shipped.value["rows"], unk, t, s, e)

    def rare_words(w: pa.Array) -> pa.Array:
        """The distinct words of each line that were not shipped."""
        size = pc.fill_null(pc.list_value_length(w), 0).to_numpy(zero_copy_only=False)
        flat = w.flatten()
        away = pc.invert(pc.is_in(flat, shipped.value["words"]))
        line = np.repeat(np.arange(len(w)), size)[away.to_numpy(zero_copy_only=False).astype(bool)]
        at = np.concatenate([[0], np.cumsum(np.bincount(line, minlength=len(w)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), flat.filter(away))

    rare = F.array_distinct(F.arrow_udf(rare_words, "array<string>")("w"))

    def with_table(d: DataFrame, row: list[str]) -> DataFrame:
        """Adds ``w`` (lower-cased words) and ``known`` (the scores of a row's
        words that are not shipped, null where there are none)."""
        d = d.withColumn("w", lower)
        none = F.lit(None).cast("array<struct<w:string,em:array<int>>>")
        if all_shipped:
            return d.withColumn("known", none)
        one = d.select(*row, F.explode(rare).alias("w")).join(table.select("w", "em"), "w")
        return d.join(one.groupBy(*row).agg(F.collect_list(F.struct("w", "em")).alias("known")), row, "left")

    def emissions(base: Scores, words: pa.Array, known) -> np.ndarray:
        if known is None:
            return base.of(words)
        at = pa.array([x["w"] for x in known], pa.string())
        mine = np.array([x["em"] for x in known], dtype=np.int32).reshape(-1, n)
        place = pc.fill_null(pc.index_in(words, at), -1).to_numpy(zero_copy_only=False)
        out = base.of(words)
        out[place >= 0] = mine[place[place >= 0]]
        return out

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, pa.Array]]:
        """Lines of about ``SLICE_TOKENS`` words, with their sizes, the number of
        every lower-cased word and these words."""
        for b in batches:
            upto = np.cumsum(pc.count_substring(b.column(n_keys + 1), " ").to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            cuts = [0, *(np.flatnonzero(np.diff(upto // SLICE_TOKENS)) + 1).tolist(), b.num_rows]
            for a, z in zip(cuts, cuts[1:]):
                if z > a:
                    part = b.slice(a, z - a)
                    w = pc.split_pattern(part.column(n_keys + 1), " ")
                    code = w.flatten().dictionary_encode()
                    yield part, pc.list_value_length(w).to_numpy(zero_copy_only=False).astype(np.int64), code.indices.to_numpy(zero_copy_only=False), code.dictionary

    def shipped_rows(words: pa.Array) -> np.ndarray:
        """Row of every word in the shipped table, -1 where it was not shipped;
        a worker builds its look-up table once."""
        held = shipped.value
        if "row" not in held:
            held["row"] = {x: i for i, x in enumerate(held["words"].to_pylist())}
        row = held["row"]
        return np.array([row.get(x, -1) for x in words.to_pylist()], dtype=np.int64)

    def apart(size: np.ndarray, code: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether a line is too long for one piece; whether it is held back for
        its rare words or its length; the line of every word."""
        line = np.repeat(np.arange(len(size)), size)
        long = size > block_tokens
        return long, long | (np.bincount(line[row[code] < 0], minlength=len(size)) > 0 if not all_shipped else False), line

    def find_held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, size, code, words in slices(batches):
            row = shipped_rows(words)
            long, held, line = apart(size, code, row)
            if held.any():
                new = np.cumsum(held) - 1
                mine = (row[code] < 0) & (held & ~long)[line]
                pairs = np.unique(new[line[mine]] * len(words) + code[mine])             # the distinct rare words of each line
                at = np.searchsorted(pairs // max(1, len(words)), np.arange(held.sum() + 1)).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(at), words.take(pa.array(pairs % max(1, len(words)))))
                kept = part.filter(pa.array(held))
                yield pa.RecordBatch.from_arrays([*kept.columns, rare, pa.array(long[held])], names=[*kept.schema.names, "rare", "long"])

    tag_names = list(tags)

    def decode(held_lines: bool):
        """Lines, with the scores of their rare words where these were held back,
        -> a row for each word."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unk, t, s, e = fixed.value
            values = pa.array(tag_names, pa.string())
            for part, size, code, words in slices(batches):
                row = shipped_rows(words)
                scores = np.where((row >= 0)[:, None], shipped.value["rows"][row], unk) if len(shipped.value["words"]) else np.tile(unk, (len(row), 1))
                if held_lines:
                    known = part.column(n_keys + 2).flatten()
                    if len(known):
                        w, em = known.flatten()
                        place = pc.fill_null(pc.index_in(words, w), -1).to_numpy(zero_copy_only=False)
                        em = em.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                        scores[place >= 0] = em[place[place >= 0]]
                else:
                    _, held, line = apart(size, code, row)
                    if held.any():
                        part, size, code = part.filter(pa.array(~held)), size[~held], code[~held[line]]
                if not part.num_rows:
                    continue
                path = viterbi_rows(size, code, scores.astype(np.float64), t, s, e)
                line = pa.array(np.repeat(np.arange(len(size)), size))
                pos = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(line) for i in range(n_keys)), pa.array(pos.astype(np.int32)),
                                                  pc.split_pattern(part.column(n_keys), " ").flatten(),
                                                  pa.DictionaryArray.from_arrays(pa.array(path), values).cast(pa.string())], names=schema.names)
        return run

    names = F.array(*[F.lit(t) for t in tags])

    def tagged(d: DataFrame, offset: Column) -> DataFrame:
        pairs = F.arrays_zip(F.col("words").alias("word"), F.col("path").alias("p"))
        return (d.select(*ks, offset.alias("__off"), F.posexplode(pairs).alias("pos", "x"))
                .select(*ks, (F.col("__off") + F.col("pos")).cast("int").alias("pos"), F.col("x.word").alias("word"), F.get(names, F.col("x.p")).alias("tag")))

    row_id = "__row"
    out = rows.mapInArrow(decode(False), schema)
    if all_shipped:
        spaces = F.length("words") - F.length(F.replace(F.col("words"), F.lit(" "), F.lit("")))
        long_rows = rows.where((F.length("words") >= block_tokens) & (spaces >= block_tokens)).withColumn(row_id, F.monotonically_increasing_id())
    else:
        held_schema = T.StructType([*rows.schema, T.StructField("rare", T.ArrayType(T.StringType())), T.StructField("long", T.BooleanType())])
        held = cut_lineage(rows.mapInArrow(find_held, held_schema).withColumn(row_id, F.monotonically_increasing_id()))
        one = held.select(row_id, F.explode("rare").alias("w")).join(table.select("w", "em"), "w")
        known = one.groupBy(row_id).agg(F.collect_list(F.struct("w", "em")).alias("known"))
        joined = held.where(~F.col("long")).select(*ks, "words", "w", row_id).join(known, row_id, "left").select(*ks, "words", "w", "known")
        out = out.unionByName(joined.mapInArrow(decode(True), schema))
        long_rows = held.where("long")
    if long_rows.isEmpty():
        return out
    long_rows = long_rows.select(*ks, row_id, split_words(F.col("words")).alias("words"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / block_tokens).cast("int")),
                      lambda b: F.struct(b.alias("b"), F.slice(F.col("words"), b * block_tokens + 1, F.lit(block_tokens)).alias("words")))
    long = cut_lineage(long_rows.select(*ks, row_id, F.explode(cut).alias("x")).select(*ks, row_id, "x.b", "x.words").repartition(row_id, "b"))
    blocks = with_table(long, [row_id, "b"])

    def each(fn, kind: str):
        """A function of (emissions, entry, last tag) over block rows."""
        def run(w: pa.Array, known: pa.Array, entry: pa.Array, last: pa.Array) -> pa.Array:
            base = scores()
            made = [fn(base, emissions(base, w[i].values, known[i].as_py()), np.array(entry[i].as_py() or [], dtype=np.float64), last[i].as_py())
                    for i in range(len(w))]
            return pa.array([m.tolist() for m in made], pa.list_(pa.float64() if kind == "double" else pa.int32()))
        return F.arrow_udf(run, f"array<{kind}>")

    no_entry, no_last = F.lit(None).cast("array<double>"), F.lit(None).cast("int")
    product = each(lambda base, em, entry, last: block_product(em, base.trans).ravel(), "double")("w", "known", no_entry, no_last)

    def borders(group: pa.Table) -> pa.Table:
        """Scores before the first word of every block, and at its last word."""
        group = group.sort_by("b")
        _, t, entry, _ = fixed.value
        before, after = [], []
        for p in group.column("product").to_pylist():
            before.append(entry.tolist())
            score = (entry[:, None] + np.array(p).reshape(n, n)).max(axis=0)
            after.append(score.tolist())
            entry = (score[:, None] + t).max(axis=0)
        kind = pa.list_(pa.float64())
        return pa.table({row_id: group.column(row_id), "b": group.column("b"), "before": pa.array(before, kind), "after": pa.array(after, kind)})

    bounds = cut_lineage(blocks.select(row_id, "b", product.alias("product")).groupBy(row_id)
                         .applyInArrow(borders, f"{row_id} long, b int, before array<double>, after array<double>"))
    entered = blocks.join(bounds, [row_id, "b"])
    first = each(lambda base, em, entry, last: block_firsts(block_forward(em, base.trans, entry)[1]), "int")("w", "known", "before", no_last)

    def chain(group: pa.Table) -> pa.Table:
        """The last tag of every block, from the last block back."""
        group = group.sort_by("b")
        _, t, _, e = fixed.value
        after, firsts = group.column("after").to_pylist(), group.column("first").to_pylist()
        last = [int((np.array(after[-1]) + e).argmax())]
        for b in range(len(after) - 1, 0, -1):
            last.append(int((np.array(after[b - 1]) + t[:, firsts[b][last[-1]]]).argmax()))
        return pa.table({row_id: group.column(row_id), "b": group.column("b"), "last": pa.array(last[::-1], pa.int32())})

    lasts = cut_lineage(entered.select(row_id, "b", "after", first.alias("first")).groupBy(row_id)
                        .applyInArrow(chain, f"{row_id} long, b int, last int"))
    path = each(lambda base, em, entry, last: block_trace(block_forward(em, base.trans, entry)[1], last), "int")("w", "known", "before", "last")
    decoded = entered.join(lasts, [row_id, "b"]).withColumn("path", path)
    return out.unionByName(tagged(decoded, F.col("b") * block_tokens))
