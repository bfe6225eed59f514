"""Greedy longest-match splitting of words on a vocabulary of pieces.

A vocabulary is a table of pieces with ids.  A word's first piece is the
longest entry its text starts with; every further piece is the longest entry
with the continuation prefix that the rest starts with.  A word that cannot be
spelled to its end, an empty word and a null word are one unknown piece.

``VocabularySplitter`` ships the vocabulary as a broadcast trie: each task
splits every distinct word of some sentences once and gathers the pieces by word
number, so sentences stay in their row and nothing is shuffled; what it holds of
pieces is bounded by ``SLICE_WORDS`` (or one sentence), not by Arrow's batch.  A vocabulary
beyond ``max_bytes`` is not shipped: ``split_distinct_words`` then finds the
pieces of the distinct words by joins with the vocabulary, one piece a round,
and the sentences join them back.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions.arrays import row_slices
from tagweave.session import cut_lineage

UNK, CONT = "[UNK]", "##"
MAX_VOCABULARY_BYTES = 64 << 20
REMEMBERED_WORDS = 200_000
SLICE_WORDS = 1 << 18
_TYPE = "struct<pieces:array<string>,ids:array<int>,starts:array<int>,counts:array<int>>"


class Trie:
    """Two prefix trees, for first pieces and for continuations; a node is a
    dict from a character to a node, with the piece's number under ``None``."""

    def __init__(self, pieces: Iterable[tuple[str, int]], unknown: int, cont: str = CONT):
        self.first: dict = {}
        self.rest: dict = {}
        self.unknown = unknown
        for piece, number in pieces:
            node, text = (self.rest, piece[len(cont):]) if piece.startswith(cont) and len(piece) > len(cont) else (self.first, piece)
            if not text:
                continue
            for ch in text:
                node = node.setdefault(ch, {})
            node[None] = number
        self.known: dict[str, list[int]] = {}

    def split(self, word: str | None) -> list[int]:
        """Piece numbers of a word; remembered, as words repeat."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= REMEMBERED_WORDS:
                self.known.clear()
            found = self.known[word] = self._walk(word or "")
        return found

    def _walk(self, word: str) -> list[int]:
        out, at, root = [], 0, self.first
        while at < len(word):
            node, end, number, i = root, at, None, at
            while i < len(word):
                node = node.get(word[i])
                if node is None:
                    break
                i += 1
                if None in node:
                    end, number = i, node[None]
            if number is None:
                return [self.unknown]
            out.append(number)
            at, root = end, self.rest
        return out or [self.unknown]


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places starts[i] .. starts[i] + sizes[i] - 1, one stretch after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class VocabularySplitter:
    """Splitter for ``expand_pieces`` from a table of pieces.

    ``ids`` of the unknown piece and of the two special pieces are those of
    the vocabulary where it lists them, else the given ones."""

    def __init__(self, vocab_df: DataFrame, piece_col: str = "piece", id_col: str = "id", unk: str = UNK, cont: str = CONT,
                 unk_id: int = 100, cls_id: int = 101, sep_id: int = 102, max_bytes: int = MAX_VOCABULARY_BYTES):
        self.unk, self.cont = unk, cont
        self.vocab = (vocab_df.select(F.col(piece_col).cast("string").alias("piece"), F.col(id_col).cast("int").alias("id"))
                      .where("piece is not null and id is not null").groupBy("piece").agg(F.min("id").alias("id")))
        self.special_ids = {unk: unk_id, "[CLS]": cls_id, "[SEP]": sep_id}
        size = self.vocab.agg(F.sum(F.octet_length("piece") + 64)).first()[0] or 0
        self.shipped = None
        for r in self.vocab.where(F.col("piece").isin(list(self.special_ids))).collect():
            self.special_ids[r.piece] = r.id
        if size <= max_bytes:
            rows = [(r.piece, r.id) for r in self.vocab.collect()]
            self.shipped = vocab_df.sparkSession.sparkContext.broadcast(rows)

    def column(self, tokens: Column) -> Column:
        """``pieces, ids, starts, counts`` of a sentence's words."""
        shipped, unk, unk_id, cont = self.shipped, self.unk, self.special_ids[self.unk], self.cont
        state: dict = {}                       # built once per task

        def split(col: pa.ListArray) -> pa.StructArray:
            trie: Trie = state["trie"]
            offsets = np.asarray(col.offsets, dtype=np.int64)
            flat = col.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
            coded = flat.dictionary_encode(null_encoding="encode")
            numbers = [trie.split(w) for w in coded.dictionary.to_pylist()]
            size_of = np.fromiter(map(len, numbers), dtype=np.int64, count=len(numbers))
            all_numbers = np.fromiter((n for ns in numbers for n in ns), dtype=np.int64, count=int(size_of.sum()))
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            counts = size_of[code] if len(code) else np.zeros(0, dtype=np.int64)
            first_of = np.cumsum(size_of) - size_of
            number = all_numbers[_ragged(first_of[code], counts)] if len(code) else np.zeros(0, dtype=np.int64)
            starts = np.zeros(len(number), dtype=np.int32)
            starts[np.cumsum(counts) - counts] = 1
            word_at = offsets - offsets[0]
            piece_at = np.concatenate([[0], np.cumsum(counts)])[word_at].astype(np.int32)
            mask = col.is_null() if col.null_count else None

            def lists(values: pa.Array, at: np.ndarray) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)

            parts = [lists(state["names"].take(pa.array(number)), piece_at), lists(pa.array(state["ids"][number]), piece_at),
                     lists(pa.array(starts), piece_at), lists(pa.array(counts.astype(np.int32)), word_at)]
            return pa.StructArray.from_arrays(parts, names=["pieces", "ids", "starts", "counts"], mask=mask)

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            if not state:
                rows = [(p, i) for p, i in shipped.value if p != unk]
                state["names"] = pa.array([p for p, _ in rows] + [unk], pa.string())
                state["ids"] = np.array([i for _, i in rows] + [unk_id], dtype=np.int32)
                state["trie"] = Trie(((p, n) for n, (p, _) in enumerate(rows)), len(rows), cont)
            for col in batches:
                if isinstance(col, pa.ChunkedArray):
                    col = col.combine_chunks()
                for at, n in row_slices(col, SLICE_WORDS):
                    yield split(col.slice(at, n))

        return F.arrow_udf(run, _TYPE)(tokens)

    def attach(self, sent_df: DataFrame, tokens_col: str, out: str) -> DataFrame:
        """Adds ``out`` (``pieces, ids, starts, counts``) to every sentence."""
        if self.shipped is not None:
            return sent_df.withColumn(out, self.column(F.col(tokens_col)))
        # a vocabulary too large to ship: split the distinct words by joins, then join them back
        rows = cut_lineage(sent_df.withColumn("__row", F.monotonically_increasing_id()))
        tokens = rows.select("__row", F.posexplode(tokens_col).alias("__pos", "__word")).withColumn("__word", F.coalesce("__word", F.lit("")))
        split = split_distinct_words(tokens.select(F.col("__word").alias("word")).distinct(), self.vocab, self.unk,
                                     self.special_ids[self.unk], self.cont)
        whole = (tokens.join(split.withColumnRenamed("word", "__word"), "__word").groupBy("__row")
                 .agg(F.array_sort(F.collect_list(F.struct("__pos", "pieces", "ids"))).alias("__x"))
                 .select("__row", F.struct(
                     F.flatten(F.transform("__x", lambda x: x["pieces"])).alias("pieces"),
                     F.flatten(F.transform("__x", lambda x: x["ids"])).alias("ids"),
                     F.flatten(F.transform("__x", lambda x: F.transform(x["ids"], lambda _, i: (i == 0).cast("int")))).alias("starts"),
                     F.transform("__x", lambda x: F.size(x["ids"])).alias("counts")).alias(out)))
        empty = F.array().cast("array<string>"), *[F.array().cast("array<int>")] * 3
        none = F.struct(*[e.alias(n) for e, n in zip(empty, ("pieces", "ids", "starts", "counts"))])
        return (rows.join(whole, "__row", "left").drop("__row")
                .withColumn(out, F.when(F.col(tokens_col).isNull(), F.lit(None)).otherwise(F.coalesce(out, none))))


def split_distinct_words(words: DataFrame, vocab: DataFrame, unk: str = UNK, unk_id: int = 100, cont: str = CONT) -> DataFrame:
    """words(word) -> (word, pieces, ids) by joins with vocab(piece, id): every
    round gives each open word its longest next piece.  Only lengths that the
    vocabulary has are tried; a round is one join on the piece's text."""
    first = vocab.where(~(F.col("piece").startswith(cont) & (F.length("piece") > len(cont))) & (F.col("piece") != "") & (F.col("piece") != unk))
    rest = vocab.where(F.col("piece").startswith(cont) & (F.length("piece") > len(cont)))
    sizes = {"first": [r[0] for r in first.select(F.length("piece")).distinct().collect()],
             "rest": [r[0] - len(cont) for r in rest.select(F.length("piece")).distinct().collect()]}
    empty = F.array().cast("array<string>").alias("pieces"), F.array().cast("array<int>").alias("ids")
    open_ = words.select("word", F.lit(0).alias("at"), *empty)
    done = open_.where("word = ''")
    open_, part, failed = open_.where("word <> ''"), "first", None
    while True:
        lengths = sorted(sizes[part])
        fits = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("word") - F.col("at"))
        prefix = "" if part == "first" else cont
        tried = (open_.select("word", "at", F.explode(fits).alias("n"))
                 .withColumn("piece", F.concat(F.lit(prefix), F.substring(F.col("word"), F.col("at") + 1, F.col("n")))))
        best = (tried.join(first if part == "first" else rest, "piece").groupBy("word")
                .agg(F.max_by(F.struct("n", "piece", "id"), "n").alias("b")))
        step = cut_lineage(open_.join(best, "word", "left"))
        miss = step.where("b is null").select("word")
        failed = miss if failed is None else failed.unionByName(miss)
        grown = step.where("b is not null").select("word", (F.col("at") + F.col("b.n")).alias("at"),
                                                   F.concat("pieces", F.array("b.piece")).alias("pieces"),
                                                   F.concat("ids", F.array("b.id")).alias("ids"))
        done = done.unionByName(grown.where(F.col("at") >= F.length("word")))
        open_, part = grown.where(F.col("at") < F.length("word")), "rest"
        if open_.isEmpty():
            break
    one = F.array(F.lit(unk)).alias("pieces"), F.array(F.lit(unk_id)).alias("ids")
    spelled = done.where("word <> ''").select("word", "pieces", "ids")
    return spelled.unionByName(failed.select("word", *one)).unionByName(done.where("word = ''").select("word", *one))
