"""Token counts by a SentencePiece BPE model, huge texts in parallel (operator 2).

Proven boundaries.  Merging only ever builds pieces of the vocabulary, so two
neighbouring characters that stand next to each other in no piece are never
joined, whatever surrounds them: the place between them is a token boundary in
every encoding that contains both.  The set of neighbouring pairs is read from
the model; for this family a non-space followed by a space is always such a
place.

Short texts are cut at proven places into units, each counted by the library
once per task and remembered.  Texts over ``chunk_chars`` become overlapping
chunks with offsets, spread over the cluster; every chunk is encoded with
offsets by the library.  Neighbouring chunks are spliced at the first place
inside their overlap that is a token boundary in both encodings and proven.
Where the overlap holds no such place, that document's chunks are cut again
with an overlap 8 times as wide, until the chunk is the whole text.  A text is
cut in one pass from its start to its end.

The total is a plain sum, so it needs no ordered window:
tokens = sum of chunk totals - sum over seams of (left tokens after the splice
+ right tokens before the splice).

Requires an identity normalizer with white space kept (checked on the model).
Edge cases: null counts as empty (0 tokens); repeated rows keep their own
result rows; extra columns are kept whatever their names, but one named like
the output gives way to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.llm.joins import join_measured, numbered, renamed

MAX_MODEL_BYTES = 64 << 20
UNIT_TABLE_ENTRIES = 500_000
PENDING_WORDS = 100_000        # words that wait for one call of the library
CHUNK_CHARS = 65_536
OVERLAP_CHARS = 256
WIDEN = 8

_SPACE = "▁"
_UNIT = re.compile(f"[ {_SPACE}]*[^ {_SPACE}]+|[ {_SPACE}]+")   # the model reads its space mark as a space


def read_model_file(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_MODEL_BYTES + 1)
    if len(data) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MAX_MODEL_BYTES} bytes: not a tokenizer model")
    return data


class Counter:
    """The library's model plus the pairs that its pieces join."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        if norm.remove_extra_whitespaces or norm.precompiled_charsmap or not norm.add_dummy_prefix:
            raise ValueError("only models that keep texts as they are (identity normalizer) can be spliced")
        self.joined = set()
        for p in proto.pieces:
            if p.type in (1, 4, 5):                 # normal, user defined, unused
                s = p.piece.replace(_SPACE, " ")
                self.joined.update(zip(s, s[1:]))
        if any(b == " " and a != " " for a, b in self.joined):
            raise ValueError("a piece joins a character with a space after it: texts can't be cut at spaces")
        self.units: dict[str, int] = {}

    def proven(self, text: str, at: int) -> bool:
        if not 0 < at < len(text):
            return False
        a, b = text[at - 1:at + 1].replace(_SPACE, " ")
        return (a, b) not in self.joined

    def count_batch(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts.  The library puts one space before a text, so
        a word after a single space counts as it does alone."""
        out = [0] * len(texts)
        pending: list[tuple[int, list[str]]] = []
        words: set[str] = set()
        held = 0

        def flush() -> None:
            new = list(words.difference(self.units))
            if len(self.units) + len(new) > UNIT_TABLE_ENTRIES:
                self.units.clear()
                new = list(words)
            self.units.update(zip(new, map(len, self.sp.encode(new, num_threads=1))))
            for at, ws in pending:
                out[at] = sum(map(self.units.__getitem__, ws))
            pending.clear()
            words.clear()

        for at, text in enumerate(texts):
            if not text:
                continue
            if "  " in text or _SPACE in text or text[0] == " " or text[-1] == " ":
                units = _UNIT.findall(text)
                out[at] = len(self.sp.encode(units[0])) + sum(map(self.inner, units[1:]))
                continue
            ws = text.split(" ")
            pending.append((at, ws))
            words.update(ws)
            held += len(ws)
            if held > PENDING_WORDS:
                flush()
                held = 0
        flush()
        return out

    def inner(self, unit: str) -> int:
        """Tokens of a unit inside a text; it begins with a space.  The library
        adds that space itself, except to the empty text, which has none."""
        if len(unit) == 1:
            # "x " = x, then a lone space: count it through a one-letter carrier
            return len(self.sp.encode("a ")) - len(self.sp.encode("a"))
        return len(self.sp.encode(unit[1:]))

    def boundaries(self, chunk: str) -> np.ndarray:
        """Start offset of every token of the chunk, in code points (the
        library gives bytes; a character's byte tokens count at its start)."""
        pieces = self.sp.encode(chunk, return_type="proto").pieces
        begin = np.fromiter((p.begin for p in pieces), dtype=np.int64, count=len(pieces))
        raw = np.frombuffer(chunk.encode("utf-8"), dtype=np.uint8)
        char_starts = np.flatnonzero((raw & 0xC0) != 0x80)
        return np.searchsorted(char_starts, begin, side="right") - 1


_SEAM = T.ArrayType(T.StructType([T.StructField("at", T.LongType()), T.StructField("before", T.LongType())]))
_CHUNK = T.StructType([T.StructField("tokens", T.LongType()),
                       T.StructField("left", _SEAM), T.StructField("right", _SEAM)])


def _seam(counter: Counter, chunk: str, starts: np.ndarray, base: int, lo: int, hi: int) -> list[dict]:
    """Proven token boundaries of the chunk in [lo, hi) (chunk offsets), as
    (place in the text, tokens of the chunk before it)."""
    at = np.unique(starts[(starts > lo) & (starts < hi)])
    before = np.searchsorted(starts, at, side="left")
    return [{"at": base + int(a), "before": int(b)} for a, b in zip(at, before) if counter.proven(chunk, int(a))]


def _chunk_udf(model):
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        counter = Counter(model.value)
        for text, start, overlap in batches:
            out = []
            for t, s, o in zip(text.to_pylist(), start.to_pylist(), overlap.to_pylist()):
                starts = counter.boundaries(t)
                out.append({"tokens": len(starts),
                            "left": _seam(counter, t, starts, s, 0, min(o, len(t))) if s else [],
                            "right": _seam(counter, t, starts, s, max(0, len(t) - o), len(t))})
            yield pa.array(out, pa.struct([("tokens", pa.int64()),
                                           ("left", pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))),
                                           ("right", pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())])))]))
    return F.arrow_udf(run, _CHUNK)


def _spliced(texts: DataFrame, model, chunk_chars: int, overlap: int) -> DataFrame:
    """texts(key, text) -> (key, n_tokens), null where a seam has no common
    proven boundary.  Chunk i covers [i*step, i*step + step + overlap)."""
    step = max(chunk_chars, overlap)
    # pieces of ``step`` characters in one pass; the overlap is never wider, so
    # a chunk is a piece and the start of the next one
    pieces = texts.select("key", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{step}}}+"), F.lit(0)).alias("pieces"))
    n = F.size("pieces")
    covered = (n > 1) & (F.length(F.element_at("pieces", -1)) <= overlap)      # by the chunk before
    last = F.when(covered, n - 2).otherwise(n - 1)
    pairs = F.arrays_zip(F.col("pieces").alias("own"), F.slice("pieces", F.lit(2), n).alias("following"))
    chunks = (pieces.select("key", last.alias("last"), F.posexplode(pairs).alias("no", "p")).filter("no <= last")
              .select("key", "no", "last", (F.col("no").cast("long") * step).alias("start"),
                      F.concat("p.own", F.coalesce(F.left("p.following", F.lit(overlap)), F.lit(""))).alias("chunk"))
              .repartition(F.col("key"), F.col("no")))
    done = chunks.select("key", "no", "last",
                         _chunk_udf(model)(F.col("chunk"), F.col("start"), F.lit(overlap).cast("int")).alias("c"))
    # every chunk gives its total and one half of each seam; a seam has two halves
    half = done.select("key", F.explode(F.array(
        F.struct(F.lit(-1).alias("seam"), F.col("c.tokens").alias("tokens"),
                 F.lit(None).cast(_SEAM).alias("left"), F.lit(None).cast(_SEAM).alias("right")),
        F.struct(F.when(F.col("no") < F.col("last"), F.col("no")).alias("seam"), F.col("c.tokens").alias("tokens"),
                 F.lit(None).cast(_SEAM).alias("left"), F.col("c.right").alias("right")),
        F.struct(F.when(F.col("no") > 0, F.col("no") - 1).alias("seam"), F.lit(0).cast("long").alias("tokens"),
                 F.col("c.left").alias("left"), F.lit(None).cast(_SEAM).alias("right")),
    )).alias("h")).select("key", "h.*").filter("seam is not null")
    totals = half.filter("seam = -1").select("key", "tokens")
    seams = (half.filter("seam >= 0").groupBy("key", "seam")
             .agg(F.max("left").alias("left"), F.max("right").alias("right"), F.max("tokens").alias("of_left")))
    common = F.array_min(F.array_intersect(F.transform("left", lambda x: x["at"]), F.transform("right", lambda x: x["at"])))
    seams = seams.withColumn("p", common)
    tokens_before = lambda side: F.filter(side, lambda x: x["at"] == F.col("p"))[0]["before"]
    cut = seams.select("key", F.when(F.col("p").isNotNull(),
                                     tokens_before("right") - F.col("of_left") - tokens_before("left")).alias("tokens"))
    return (totals.unionByName(cut).groupBy("key")
            .agg(F.when(F.count("tokens") == F.count(F.lit(1)), F.sum("tokens")).alias("n_tokens")))


def count_tokens(docs: DataFrame, model_file: str, text: str = "text", out: str = "n_tokens",
                 chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """Adds ``out`` (long): tokens of each whole text, without begin, end or
    added special tokens."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(read_model_file(model_file))

    def short(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(model.value)
        for batch in batches:
            yield pa.array(counter.count_batch([t or "" for t in batch.to_pylist()]), pa.int64())

    plain, names = numbered(docs)
    body = F.col(f"c{names.index(text)}")
    huge = F.coalesce(F.length(body) > chunk_chars + overlap_chars, F.lit(False))
    count_short = F.arrow_udf(short, T.LongType())
    small = plain.filter(~huge).withColumn("tokens", count_short(body))

    # huge texts are counted once per distinct text, keyed by digest
    rest = plain.filter(huge)
    texts = (rest.select(F.sha2(body, 256).alias("key"), body.alias("text"))
             .groupBy("key").agg(F.first("text").alias("text")))
    counted, overlap = None, overlap_chars
    texts = texts.checkpoint()
    while True:
        tried = _spliced(texts, model, max(chunk_chars, overlap), overlap).checkpoint()
        good = tried.filter("n_tokens is not null")
        counted = good if counted is None else counted.unionByName(good)
        failed = tried.filter("n_tokens is null").select("key")
        if failed.isEmpty():
            break
        texts = texts.join(failed, "key", "left_semi")
        overlap *= WIDEN
    big = join_measured(rest.withColumn("key", F.sha2(body, 256)), counted.withColumnRenamed("n_tokens", "tokens"), ["key"],
                        F.lit(120).cast("long"), "left")
    both = small.unionByName(big.select(*plain.columns, "tokens"))
    return both.select(*renamed(names, (out,)), F.col("tokens").alias(out))
