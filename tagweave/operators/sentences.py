"""Sentence segmentation and repair, paragraph restore, token alignment.

Merges that follow a global sentence order (file order across paragraphs)
never run as one global window: sentences get distributed dense ordinals
(range sort + per-partition offsets), merge flags are computed per row, and
only rows that take part in a merge are grouped, keyed by the ordinal of the
island's first sentence (found as ordinal minus run length over the sparse
set of flagged rows, also with distributed ordinals)."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave import constants as C
from tagweave.functions.text import py_strip
from tagweave.operators.automaton import _documents
from tagweave.operators.sampling import dense_ids, prefix_offsets
from tagweave.operators.spans import _keys
from tagweave.operators.vocabulary import _ragged
from tagweave.session import cut_lineage
from tagweave.sources.formats import read_lines


def split_sentences(df: DataFrame, text_col: str = "text", keys: str | Sequence[str] = "doc_id") -> DataFrame:
    """Paragraph -> sentences: break after ``.``, ``!`` or ``?`` followed by
    whitespace (the whitespace is dropped).  An empty paragraph gives no
    sentence.  Output ``(keys..., ord, sentence)``; in-row, no shuffle."""
    ks = _keys(keys)
    t = py_strip(F.col(text_col))
    parts = F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"(?<=[.!?])\s+", -1))
    return (df.select(*ks, F.posexplode(parts).alias("ord", "sentence"))
            .withColumn("ord", F.col("ord").cast("int")))


def _merge_flagged(d: DataFrame, gid: str, text_col: str, flag_col: str, sep: str,
                   carry: Sequence[str]) -> DataFrame:
    """Join each flagged row (``flag`` = merge into the previous row in
    ``gid`` order) onto the island it continues.

    Island start of a flagged row = first ordinal of its run of consecutive
    flagged ordinals, minus one.  Runs come from distributed ordinals over the
    flagged rows only.  Unaffected rows pass through without grouping."""
    flagged = d.where(F.col(flag_col)).select(gid)
    fr = dense_ids(flagged, gid, "__r")
    runs = fr.withColumn("__run", F.col(gid) - F.col("__r"))
    starts = runs.groupBy("__run").agg((F.min(gid) - 1).alias("__anchor"))
    anchor_of = runs.join(starts, "__run").select(gid, "__anchor")
    anchors = anchor_of.select(F.col("__anchor").alias(gid)).distinct().withColumn("__is_anchor", F.lit(True))
    tagged = (d.join(anchor_of, gid, "left")
              .join(anchors, gid, "left")
              .withColumn("__anchor", F.coalesce(F.col("__anchor"),
                                                 F.when(F.col("__is_anchor"), F.col(gid)))))
    untouched = tagged.where(F.col("__anchor").isNull()).select(gid, *carry, text_col)
    grouped = (tagged.where(F.col("__anchor").isNotNull())
               .groupBy("__anchor")
               .agg(F.array_sort(F.collect_list(F.struct(F.col(gid).alias("g"), F.col(text_col).alias("t"),
                                                         *[F.col(c).alias(c) for c in carry]))).alias("xs"))
               .select(F.col("__anchor").alias(gid),
                       *[F.col("xs")[0][c].alias(c) for c in carry],
                       F.array_join(F.transform("xs", lambda x: x["t"]), sep).alias(text_col)))
    return untouched.unionByName(grouped)


MAX_SHIPPED_MERGES = 1_000_000


class Islands:
    """Order statistics of a sequence whose elements merge: ``select(j)`` is the
    original ordinal that the j-th current element begins with.  Ordinals that
    were merged into the one before them are kept sorted in blocks, so a step
    costs the number of blocks and one bisection."""

    BLOCK = 1024

    def __init__(self):
        self.blocks: list[list[int]] = [[]]

    def select(self, j: int) -> int:
        before = 0                                    # merged ordinals in earlier blocks
        for block in self.blocks:
            # the t-th merged ordinal m has m - t current elements before it
            if block and block[-1] - (before + len(block) - 1) <= j:
                before += len(block)
                continue
            return j + before + bisect_right(range(len(block)), j, key=lambda t: block[t] - (before + t))
        return j + before

    def merge(self, ordinal: int) -> None:
        for i, block in enumerate(self.blocks):
            if i == len(self.blocks) - 1 or (block and block[-1] >= ordinal):
                insort(block, ordinal)
                if len(block) > self.BLOCK:
                    half = len(block) // 2
                    self.blocks[i:i + 1] = [block[:half], block[half:]]
                return


def merged_ordinals(overrides: DataFrame, n_sentences: int) -> DataFrame:
    """overrides(seq, index) -> (__g): the original ordinals that the merges
    join to the sentence before them.  The steps depend on each other, so one
    task applies them in ``seq`` order, holding one number per merge; only
    indices are read here, never sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        islands, left = Islands(), n_sentences
        for b in batches:
            out = []
            for i in b.column(0).to_pylist():
                if 0 <= i < left - 1:                 # joins i and i + 1; at or past the last sentence there is nothing to join
                    out.append(islands.select(i + 1))
                    islands.merge(out[-1])
                    left -= 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["__g"])

    return (overrides.where("index is not null").repartition(1).sortWithinPartitions("seq", "index")
            .select(F.col("index").cast("long").alias("index")).mapInArrow(run, "__g long"))


def apply_merge_overrides(sentences_df: DataFrame, overrides: Sequence[int] | DataFrame,
                          order: Sequence[str] = ("doc_id", "ord"), text_col: str = "sentence",
                          index_col: str = "index", seq_col: str = "seq") -> DataFrame:
    """At each listed index, join sentence i and i+1 without a space.  Indices
    are applied one after another and count positions after the merges before
    them, in any order; an index at or past the last sentence joins nothing.
    ``overrides`` is a list, or a table of ``index_col`` applied in the order of
    ``seq_col``.  Output ``(line_id, order..., sentence)`` with ``line_id`` the
    0-based position after all merges."""
    spark = sentences_df.sparkSession
    if isinstance(overrides, DataFrame):
        table = overrides.select(F.col(seq_col).alias("seq"), F.col(index_col).alias("index"))
    else:
        table = spark.createDataFrame([(k, int(i)) for k, i in enumerate(overrides)], "seq long, index long")
    d = dense_ids(sentences_df.select(*order, text_col), list(order), "__g")
    merged = cut_lineage(merged_ordinals(table, d.count()))
    if merged.count() <= MAX_SHIPPED_MERGES:
        shipped = spark.sparkContext.broadcast(np.sort(merged.toArrow().column(0).to_numpy()))

        def rank(g: pa.Array) -> pa.Array:
            """Merged ordinals up to each ordinal, twice plus one if it is one of them."""
            m = shipped.value
            at = np.searchsorted(m, g.to_numpy(), side="right")
            return pa.array(2 * at + (np.append(m, -1)[at - 1] == g.to_numpy()) * (at > 0))

        d = d.withColumn("__r", F.arrow_udf(rank, "long")("__g")).withColumn("__flag", F.pmod("__r", F.lit(2)) == 1)
        d = d.withColumn("__line", F.col("__g") - F.floor(F.col("__r") / 2)).drop("__r")
        out = _merge_flagged(d, "__g", text_col, "__flag", "", ["__line", *order])
        return out.select(F.col("__line").cast("long").alias("line_id"), *order, text_col)
    flagged = d.join(merged.withColumn("__flag", F.lit(True)), "__g", "left").withColumn("__flag", F.coalesce("__flag", F.lit(False)))
    out = _merge_flagged(flagged, "__g", text_col, "__flag", "", list(order))
    return dense_ids(out, "__g", "line_id").select("line_id", *order, text_col)


def merge_abbreviation_breaks(sentences_df: DataFrame, order: Sequence[str] = ("doc_id", "ord"),
                              text_col: str = "sentence", exceptions: Sequence[int] = (),
                              within_paragraph: bool = False,
                              suffixes: Sequence[str] = tuple(C.ABBREVIATION_SUFFIXES)) -> DataFrame:
    """Join a sentence to the previous one, with a space, when the previous
    sentence ends with ``et al .``, ``e.g.`` or ``i.e.`` (``i.e.`` not at the
    listed sentence indices).  The first sentence is never merged.  The test
    reads the previous *original* sentence (it differs from the merged text
    only when a sentence is shorter than the suffix).

    ``within_paragraph=False`` (the original behaviour) lets merges cross
    paragraph ends: the previous sentence is found by global ordinal with an
    equi-join on ordinal - 1.  ``True`` restricts merges to the first order
    column (one window per paragraph)."""
    ks = list(order)
    ie = "i.e."

    def ends(c: Column) -> tuple[Column, Column]:
        other = F.lit(False)
        for s in suffixes:
            if s != ie:
                other = other | c.endswith(s)
        return other, (c.endswith(ie) if ie in suffixes else F.lit(False))

    # how a sentence ends is decided before any exchange: two booleans travel, not its text
    other_end, ie_end = ends(F.col(text_col))
    d = dense_ids(sentences_df.select(*ks, text_col, other_end.alias("__o"), ie_end.alias("__i")), ks, "__g")
    exc = F.array(*[F.lit(int(e)) for e in exceptions]) if exceptions else F.array().cast("array<long>")
    if within_paragraph:
        w = Window.partitionBy(ks[0]).orderBy(*ks[1:] or [ks[0]])
        d = d.withColumn("__po", F.lag("__o").over(w)).withColumn("__pi", F.lag("__i").over(w))
    else:
        # only sentences that end so can merge the next one
        prevs = d.where(F.col("__o") | F.col("__i")).select((F.col("__g") + 1).alias("__g"), F.col("__o").alias("__po"),
                                                            F.col("__i").alias("__pi"))
        d = d.join(prevs, "__g", "left")
    flag = F.col("__po") | (F.col("__pi") & ~F.array_contains(exc, F.col("__g")))
    d = d.withColumn("__flag", F.coalesce(flag, F.lit(False))).drop("__po", "__pi", "__o", "__i")
    merged = _merge_flagged(d, "__g", text_col, "__flag", " ", ks)
    return merged.select(F.col("__g").alias("first_index"), *ks, text_col)


def _token_ordinals(df: DataFrame, order: Sequence[str], out_col: str) -> DataFrame:
    """Global token ordinal = tokens in earlier groups + position, where the
    group is every order column but the last and positions run 0..n-1.
    Only the group-level table (one row per sentence/paragraph) is sorted and
    prefix-summed; tokens are never globally sorted."""
    order = list(order)
    if len(order) == 1:
        return dense_ids(df, order, out_col)
    grp, pos = order[:-1], order[-1]
    counts = df.groupBy(*grp).agg(F.count(F.lit(1)).alias("__n"))
    offs = prefix_offsets(counts, grp, "__n", "__off").select(*grp, "__off")
    return df.join(offs, grp).withColumn(out_col, F.col("__off") + F.col(pos)).drop("__off")


SEGMENT_BLOCK = 1 << 16      # ordinals in which the starts of groups are ordered together
POSITION_BLOCK = 64          # positions of a group that meet the segments they may lie in


def _group_offsets(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """(group..., __n, __off, __dense): each group's rows, the rows of earlier
    groups, and whether its positions are as many as 0..n-1 and between them."""
    *grp, pos = order
    p = F.col(pos).cast("long")
    counts = df.groupBy(*grp).agg(F.count(F.lit(1)).alias("__n"), F.min(p).alias("__lo"), F.max(p).alias("__hi"), F.sum(p).alias("__sum"))
    n = F.col("__n")
    dense = (F.col("__lo") == 0) & (F.col("__hi") == n - 1) & (F.col("__sum") == F.floor(n * (n - 1) / 2))
    counts = counts.select(*grp, "__n", F.coalesce(dense, F.lit(False)).alias("__dense"))
    return prefix_offsets(counts, grp, "__n", "__off").select(*grp, "__n", "__off", "__dense")


def _segments(a: DataFrame, b: DataFrame) -> DataFrame:
    """a(x, __off, __n), b(y, __off, __n) -> (x, y, start, end, a_off, b_off): the
    stretches of ordinals that lie in one interval of either table.  Intervals
    of a table don't overlap; they are cut at blocks, so every window is bounded."""
    size = F.lit(SEGMENT_BLOCK)

    def starts(d: DataFrame, name: str, other: str, other_type) -> DataFrame:
        first, last = F.floor(F.col("__off") / size), F.floor((F.col("__off") + F.col("__n") - 1) / size)
        return (d.withColumn("block", F.explode(F.sequence(first, last)))
                .select("block", F.greatest("__off", F.col("block") * size).alias("start"),
                        F.struct(F.col(name).alias("key"), F.col("__off").alias("off"), (F.col("__off") + F.col("__n")).alias("end")).alias(name),
                        F.lit(None).cast(other_type).alias(other)))

    def held(d: DataFrame, key: str):
        return f"struct<key:{d.schema[key].dataType.simpleString()},off:bigint,end:bigint>"

    both = starts(a, "x", "y", held(b, "y")).unionByName(starts(b, "y", "x", held(a, "x")))
    w = Window.partitionBy("block").orderBy("start")
    both = both.select("start", F.last("x", ignorenulls=True).over(w).alias("x"), F.last("y", ignorenulls=True).over(w).alias("y"),
                       F.coalesce(F.lead("start").over(w), (F.col("block") + 1) * size).alias("next"))
    end = F.least("next", "x.end", "y.end")
    return (both.where(F.col("x").isNotNull() & F.col("y").isNotNull()).withColumn("end", end).where("start < end")
            .select(F.col("x.key").alias("x"), F.col("y.key").alias("y"), "start", "end", F.col("x.off").alias("a_off"), F.col("y.off").alias("b_off")))


def restore_paragraphs(pred_tokens_df: DataFrame, template_tokens_df: DataFrame,
                       pred_order: Sequence[str] = ("sent_id", "pos"),
                       template_order: Sequence[str] = ("para_id", "pos"),
                       token_col: str = "token") -> DataFrame:
    """Give predicted tokens (sentence-segmented) the template's paragraph
    ids: the n-th predicted token takes the place of the template's n-th.
    Output: template keys + token + every other predicted column.

    A group is every order column but the last, positions run 0..n-1.  Only the
    groups' sizes are sorted and summed; sentences and paragraphs that share
    ordinals give segments, and each predicted token is exchanged once to meet
    its own (a build by hashing, so tokens aren't sorted).  The template's tokens
    are counted and stay in place.  Where positions have gaps or there is no
    group, both sides are joined on their ordinals."""
    po, to = list(pred_order), list(template_order)
    extra = [c for c in pred_tokens_df.columns if c not in po and c != token_col]
    if len(po) > 1 and len(to) > 1:
        a, b = _group_offsets(pred_tokens_df, po), _group_offsets(template_tokens_df, to)
        irregular = a.select("__dense").unionByName(b.select("__dense")).where("not __dense").limit(1)
        if irregular.isEmpty():
            group = lambda d, cols, name: d.dropna(subset=cols).select(F.struct(*cols).alias(name), "__off", "__n")
            seg = _segments(group(a, po[:-1], "x"), group(b, to[:-1], "y"))
            lo, hi = F.col("start") - F.col("a_off"), F.col("end") - F.col("a_off")
            seg = seg.select(*[F.col(f"x.{c}").alias(f"__g{i}") for i, c in enumerate(po[:-1])], "y", lo.alias("__lo"), hi.alias("__hi"),
                             (F.col("a_off") - F.col("b_off")).alias("__shift"),
                             F.explode(F.sequence(F.floor(lo / POSITION_BLOCK), F.floor((hi - 1) / POSITION_BLOCK))).alias("__sub"))
            p = pred_tokens_df.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(po[:-1])], F.col(po[-1]).cast("long").alias("__pos"),
                                      F.floor(F.col(po[-1]) / POSITION_BLOCK).alias("__sub"), F.col(token_col).alias("__pt"), *extra)
            found = (p.join(seg.hint("shuffle_hash"), [*[f"__g{i}" for i in range(len(po) - 1)], "__sub"])
                     .where("__pos >= __lo and __pos < __hi"))
            at = (F.col("__pos") + F.col("__shift")).cast(template_tokens_df.schema[to[-1]].dataType)
            return found.select(*[F.col("y").getField(c).alias(c) for c in to[:-1]], at.alias(to[-1]), F.col("__pt").alias(token_col), *extra)
    p = _token_ordinals(pred_tokens_df, po, "__n")
    t = _token_ordinals(template_tokens_df.select(*to, F.col(token_col).alias("__tt")), to, "__n")
    return (t.join(p.select("__n", F.col(token_col).alias("__pt"), *extra), "__n", "inner")
            .select(*to, F.col("__pt").alias(token_col), *extra))


BLOCK_LINES = 64
MAX_SHIPPED_BLOCKS = 2_000_000


def differing_lines(a: DataFrame, b: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """a(line, token), b(line, token) -> (line, token_a, token_b) of lines that
    differ or that one side lacks.  Blocks of lines are compared by digests
    first (a count and two sums of hashes of line and token, pre-aggregated in
    every task); tokens meet only for blocks that differ.  Blocks are short, so a
    single different line moves few others; up to ``MAX_SHIPPED_BLOCKS`` block
    numbers are broadcast, so that the lines of equal blocks stay where they are."""
    block = F.floor(F.col("line") / block_lines)

    def digests(d: DataFrame, side: str) -> DataFrame:
        h, k = F.xxhash64("line", "token"), F.crc32(F.concat_ws("\u0001", F.col("line").cast("string"), F.coalesce("token", F.lit("\u0002"))))
        return d.groupBy(block.alias("block")).agg(F.struct(F.count(F.lit(1)), F.bit_xor(h), F.sum(k)).alias(side))

    both = digests(a, "x").join(digests(b, "y"), "block", "full_outer")
    unlike = cut_lineage(both.where(~F.col("x").eqNullSafe(F.col("y"))).select("block"))
    n_unlike = unlike.count()
    if not n_unlike:
        return a.limit(0).select("line", F.col("token").alias("token_a"), F.col("token").alias("token_b"))
    unlike = F.broadcast(unlike) if n_unlike <= MAX_SHIPPED_BLOCKS else unlike
    left, right = (d.withColumn("block", block).join(unlike, "block", "left_semi").select("line", F.col("token").alias(n))
                   for d, n in ((a, "token_a"), (b, "token_b")))
    return left.join(right, "line", "full_outer").where(~F.col("token_a").eqNullSafe(F.col("token_b")))


PACKED_POSITIONS = 512
PACKED_ROWS = 1024           # packed rows that are matched together
_PACKED_KEYS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.DateType)


def _can_pack(a: DataFrame, b: DataFrame, keys: Sequence[str], token_col: str) -> bool:
    kinds = [(a.schema[c].dataType, b.schema[c].dataType) for c in (*keys, token_col)]
    return (all(x == y and isinstance(x, _PACKED_KEYS) for x, y in kinds) and isinstance(kinds[-1][0], T.StringType)
            and isinstance(kinds[-2][0], _PACKED_KEYS[:4]))


def _ranges(data: pa.Buffer | None, bounds: np.ndarray) -> pa.Array:
    """A buffer cut at ``bounds``, without a copy."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype("<i4")), data or pa.py_buffer(b"")])


def _end_to_end(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column's values one after another, and where each begins."""
    at = np.frombuffer(column.buffers()[1], dtype="<i8" if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else "<i4")
    at = at[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[at[0]:at[-1]], at - at[0]


def _packed(df: DataFrame, keys: Sequence[str], token_col: str, side: int) -> DataFrame:
    """(__k0.., __block, __side, __rel, __size, __text): neighbouring rows of one
    block of positions (the last key) as one row, with the places in the block
    (two bytes each, -1 for null), the tokens' sizes (four bytes, -1 for null)
    and their bytes; nothing is sorted or held."""
    ks = [f"__k{i}" for i in range(len(keys) - 1)]
    rows = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, ks)], F.col(f"`{keys[-1]}`").cast("long").alias("__pos"),
                     F.col(f"`{token_col}`").alias("__token"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            pos, token = b.column(len(ks)), b.column(len(ks) + 1)
            no_pos, no_token = (c.is_null().to_numpy(zero_copy_only=False) for c in (pos, token))
            pos = pc.fill_null(pos, 0).to_numpy()
            token = pc.fill_null(token, "") if token.null_count else token
            group = [*(b.column(i) for i in range(len(ks))), pa.array(pos // PACKED_POSITIONS, mask=no_pos)]
            first = np.flatnonzero(_documents(group))
            bounds = np.append(first, b.num_rows)
            _, at = _end_to_end(token)
            start = int(np.frombuffer(token.buffers()[1], dtype="<i8" if pa.types.is_large_string(token.type) else "<i4")[token.offset])
            rel = np.where(no_pos, -1, pos % PACKED_POSITIONS).astype("<i2")
            size = np.where(no_token, -1, np.diff(at)).astype("<i4")
            yield pa.RecordBatch.from_arrays(
                [*(c.take(pa.array(first)) for c in group), pa.array(np.full(len(first), side, dtype=np.int8)),
                 _ranges(pa.py_buffer(rel), bounds * 2), _ranges(pa.py_buffer(size), bounds * 4), _ranges(token.buffers()[2], at[bounds] + start)],
                names=[*ks, "__block", "__side", "__rel", "__size", "__text"])

    schema = T.StructType([*(rows.schema[c] for c in ks), T.StructField("__block", T.LongType()), T.StructField("__side", T.ByteType()),
                           *(T.StructField(c, T.BinaryType()) for c in ("__rel", "__size", "__text"))])
    return rows.mapInArrow(run, schema)


def _join_packed(a: DataFrame, b: DataFrame, keys: Sequence[str], token_col: str) -> DataFrame:
    """The full outer join on ``keys``, without the rows whose tokens agree:
    blocks of neighbouring positions are exchanged and sorted as one row, and
    both sides of a block are matched together.  A null key matches nothing."""
    ks = [f"__k{i}" for i in range(len(keys) - 1)]
    group = [*ks, "__block"]
    rows = _packed(a, keys, token_col, 0).unionByName(_packed(b, keys, token_col, 1)).repartition(*group).sortWithinPartitions(*group)
    schema = T.StructType([*(T.StructField(k, a.schema[k].dataType) for k in keys[:-1]), T.StructField(keys[-1], T.LongType()),
                           T.StructField("token_a", T.StringType()), T.StructField("token_b", T.StringType())])

    def matched(t: pa.Table) -> pa.RecordBatch:
        cols = [t.column(c).combine_chunks() for c in group]
        (rel, rel_at), (size, _), (text, _) = (_end_to_end(t.column(c).combine_chunks()) for c in ("__rel", "__size", "__text"))
        rel, size = rel.copy().view("<i2"), size.copy().view("<i4")
        row = np.repeat(np.arange(t.num_rows), np.diff(rel_at) // 2)
        place = pa.array(rel.astype(np.int64), mask=rel < 0)
        ends = np.concatenate([[0], np.cumsum(np.maximum(size, 0), dtype=np.int64)])
        token = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(text)])
        token = pc.if_else(pa.array(size < 0), pa.scalar(None, pa.large_string()), token) if (size < 0).any() else token
        side = t.column("__side").to_numpy()[row]
        whole = np.ones(t.num_rows, dtype=bool)
        for c in cols:
            whole &= c.is_valid().to_numpy(zero_copy_only=False)
        whole, key = whole[row], (np.cumsum(_documents(cols)) * PACKED_POSITIONS)[row] + rel
        left, right = (np.flatnonzero(whole & (side == n)) for n in (0, 1))
        left, right = left[np.argsort(key[left], kind="stable")], right[np.argsort(key[right], kind="stable")]
        lo, hi = (np.searchsorted(key[right], key[left], side=s) for s in ("left", "right"))
        alone = np.searchsorted(key[left], key[right], side="left") == np.searchsorted(key[left], key[right], side="right")
        none = lambda n: np.full(n, -1, dtype=np.int64)
        odd_a, odd_b = (np.concatenate([own, np.flatnonzero(~whole & (side == n))]) for n, own in ((0, left[lo == hi]), (1, right[alone])))
        x = np.concatenate([np.repeat(left, hi - lo), odd_a, none(len(odd_b))])
        y = np.concatenate([right[_ragged(lo, hi - lo)], none(len(odd_a)), odd_b])
        ta, tb = (token.take(pa.array(i, mask=i < 0)) for i in (x, y))
        same = pc.or_(pc.fill_null(pc.equal(ta, tb), False), pc.and_(ta.is_null(), tb.is_null()))
        keep = np.flatnonzero(~same.to_numpy(zero_copy_only=False).astype(bool))
        at = np.where(x >= 0, x, y)[keep]
        of, which = pa.array(row[at]), pa.array(keep)
        pos = pc.add(pc.multiply(cols[-1].take(of), PACKED_POSITIONS), place.take(pa.array(at)))
        return pa.RecordBatch.from_arrays([*(c.take(of) for c in cols[:-1]), pos, *(c.take(which).cast(pa.string()) for c in (ta, tb))], names=[*keys, "token_a", "token_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            for at in range(0, b.num_rows, PACKED_ROWS):
                piece = pa.Table.from_batches([b.slice(at, PACKED_ROWS)])
                held = (piece if held is None else pa.concat_tables([held, piece])).combine_chunks()
                first = np.flatnonzero(_documents([held.column(c).combine_chunks() for c in group]))
                if len(first) > 1:                    # the last block may go on
                    yield matched(held.slice(0, int(first[-1])))
                    held = held.slice(int(first[-1]))
        if held is not None and held.num_rows:
            yield matched(held)

    out = rows.mapInArrow(run, schema)
    return out.withColumn(keys[-1], F.col(f"`{keys[-1]}`").cast(a.schema[keys[-1]].dataType))


def check_token_alignment(a_df: DataFrame, b_df: DataFrame, keys: Sequence[str] | None = None,
                          a_order: Sequence[str] = ("sent_id", "pos"), b_order: Sequence[str] = ("sent_id", "pos"),
                          token_col: str = "token") -> DataFrame:
    """Mismatching lines between two token tables: ``(line, token_a,
    token_b)`` where a line is missing on one side or the tokens differ.
    With ``keys`` the sides are matched on those columns (in blocks of
    neighbouring positions, if the last key is a whole number); otherwise on global
    line ordinals (sentence counts, prefix-summed; tokens are not sorted) and
    by ``differing_lines``.  An empty result means aligned."""
    if keys and _can_pack(a_df, b_df, keys, token_col):
        return _join_packed(a_df, b_df, list(keys), token_col)
    if keys:
        a = a_df.select(*keys, F.col(token_col).alias("token_a"))
        b = b_df.select(*keys, F.col(token_col).alias("token_b"))
        j = a.join(b, list(keys), "full_outer")
        return j.where(~F.col("token_a").eqNullSafe(F.col("token_b")))
    sides = (_token_ordinals(d.select(*order, F.col(token_col).alias("token")), order, "line").select("line", "token")
             for d, order in ((a_df, a_order), (b_df, b_order)))
    return differing_lines(*sides)


def check_file_alignment(spark: SparkSession, path_a: str, path_b: str, sep: str = "\t", block_lines: int = BLOCK_LINES) -> DataFrame:
    """Line-by-line comparison of two token files of any size: the first field
    of every line (blank lines included) must be the same.  Lines are numbered
    in file order from a table of file splits; no line is sorted or stored."""
    def tokens(path: str) -> DataFrame:
        return read_lines(spark, path).select(F.col("line_id").alias("line"), F.substring_index("value", sep, 1).alias("token"))

    return differing_lines(tokens(path_a), tokens(path_b), block_lines)


def first_section_sentences(papers_df: DataFrame, key: str = "url", sections_col: str = "sections") -> DataFrame:
    """Text of section 0, ``et al.`` replaced by ``et al``, split on the
    literal ``. `` (consumed).  Output ``(key, ord, sentence)``."""
    first = F.get(F.col(sections_col), 0)["text"]
    txt = F.replace(first, F.lit("et al."), F.lit("et al"))
    return (papers_df.where(first.isNotNull())
            .select(key, F.posexplode(F.split(txt, r"\. ", -1)).alias("ord", "sentence"))
            .withColumn("ord", F.col("ord").cast("int")))
