"""Byte-level BPE encoding and decoding (operator 1).

A tiktoken encoder is built in each task from a rank file that the driver
reads once and ships as a broadcast (a vocabulary file; its size is checked).

Pre-splitting.  The split pattern never joins a non-space character with a
space that follows it, so every position between the two is a match boundary
whatever stands around it.  A place before a space that a
non-space follows is one too: the rest of a white-space run is matched alone.
Texts are cut there; a stretch without white space that is still long is cut
where the character class changes in a way no alternative of the pattern can
span (letter-digit, digit-letter, letter-symbol, digit-symbol, symbol-digit;
symbol-letter is not safe because of the contractions).  Each unit is encoded
by the library once per task and remembered in a bounded table, so the result
equals one call on the whole text.

Edge cases: null text encodes as the empty text (no ids); null ids decode to
empty bytes; repeated rows give repeated results; extra columns are kept.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_RANK_FILE_BYTES = 64 << 20       # a vocabulary, not data: larger files are refused
UNIT_TABLE_ENTRIES = 200_000         # remembered units per task
PENDING_WORDS = 100_000              # words that wait for one call of the library
SLICE_CHARS = 2 << 20                # texts encoded between two output batches
BLOCK_CHARS = 1 << 20                # a huge text is walked in blocks of about this length
LONG_UNIT_CHARS = 2_048              # longer stretches without white space are cut by class

# Unicode White_Space, the meaning of \s in the encoder's regex engine
_W = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_W_BUT_SPACE = f"[{_W.replace(' ', '')}] "
_UNIT = re.compile(f"[{_W}]*[^{_W}]+|[{_W}]+")
# white space before a space: only then may a cut before a space be unsafe
_ODD = re.compile(_W_BUT_SPACE)
_CUT = re.compile(f"[^{_W}](?=[{_W}])")


def read_rank_file(path: str) -> bytes:
    """The rank file's bytes (driver side), refused above the vocabulary bound."""
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_FILE_BYTES + 1)
    if len(data) > MAX_RANK_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_RANK_FILE_BYTES} bytes: not a rank file")
    return data


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def safe_blocks(text: str, block_chars: int = BLOCK_CHARS) -> Iterator[str]:
    """Cut a text at safe boundaries into blocks of at least ``block_chars``."""
    start, n = 0, len(text)
    while n - start > block_chars:
        m = _CUT.search(text, start + block_chars)
        if m is None:
            break
        yield text[start:m.end()]
        start = m.end()
    yield text[start:] if start else text


def split_long_unit(unit: str) -> list[str]:
    """Cut a long stretch where the character class changes safely."""
    import regex
    cuts = regex.finditer(
        r"(?<=\p{L})(?=[^\p{L}\s])|(?<=\p{N})(?=[^\p{N}\s])|(?<=[^\p{L}\p{N}\s])(?=\p{N})", unit)
    at = [0, *(m.start() for m in cuts), len(unit)]
    return [unit[a:b] for a, b in zip(at, at[1:]) if b > a]


class Units:
    """Encodes units through the library and remembers them (bounded).

    The table holds ids as int32 bytes, keyed by the unit without its leading
    space; unknown units of a batch are encoded in one joined call and told
    apart again by their byte lengths, as their edges are match boundaries."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken
        self.encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.token_bytes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for b, i in ranks.items():
            self.token_bytes[i] = len(b)
        self.table: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        new = words.difference(self.table)
        if len(self.table) + len(new) > UNIT_TABLE_ENTRIES:
            self.table.clear()
            new = words
        plain = [w for w in new if w and len(w) <= 256 and not w[0].isspace() and not w[-1].isspace()]
        ids = np.array(self.encoder.encode_ordinary(" " + " ".join(plain)) if plain else [], dtype=np.int32)
        ends = np.cumsum([len(w.encode()) + 1 for w in plain]) if plain else []
        cut = np.searchsorted(np.cumsum(self.token_bytes[ids]), ends) + 1 if plain else []
        start = 0
        for w, end in zip(plain, cut):
            self.table[w] = ids[start:end].tobytes()
            start = end
        for w in new.difference(plain):
            self.table[w] = self.encode(" " + w)

    def encode(self, unit: str) -> bytes:
        parts = split_long_unit(unit) if len(unit) > LONG_UNIT_CHARS else [unit]
        return b"".join(np.array(self.encoder.encode_ordinary(p), dtype=np.int32).tobytes() for p in parts)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as int32 bytes."""
        out: list[bytes | None] = [None] * len(texts)
        pending: list[tuple[int, list[str]]] = []
        words: set[str] = set()
        held = 0

        def flush() -> None:
            self.learn(words)
            for at, ws in pending:
                out[at] = (self.encode(ws[0]) if ws[0] else b"") + b"".join(map(self.table.__getitem__, ws[1:]))
            pending.clear()
            words.clear()

        for at, text in enumerate(texts):
            if len(text) > BLOCK_CHARS or "  " in text or _ODD.search(text):
                out[at] = b"".join(self.encode(u) for b in safe_blocks(text) for u in _UNIT.findall(b))
                continue
            ws = text.split(" ")
            pending.append((at, ws))
            words.update(ws[1:])
            held += len(ws)
            if held > PENDING_WORDS:
                flush()
                held = 0
        flush()
        return out


def _list_array(parts: list[bytes]) -> pa.Array:
    sizes = np.fromiter((len(p) >> 2 for p in parts), dtype=np.int64, count=len(parts))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    flat = np.frombuffer(b"".join(parts), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _id_lists(batch: pa.Array) -> Iterator[list[int]]:
    """One row's ids at a time; a null row has none."""
    for row in range(len(batch)):
        v = batch[row].values
        yield [] if v is None else v.to_numpy(zero_copy_only=False).tolist()


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about SLICE_CHARS bytes of text each."""
    import pyarrow.compute as pc
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + SLICE_CHARS, side="right")))
        yield batch.slice(start, end - start)
        start = end


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, text: str = "text",
                     ids: str = "token_ids", keep_text: bool = True) -> DataFrame:
    """Adds ``ids`` (``array<int>``, replacing a column of that name): the
    token ids of each whole text; null counts as empty."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_rank_file(rank_file))
    kept = [f for f in docs.schema.fields if f.name != ids and (keep_text or f.name != text)]
    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(parse_ranks(ranks.value), pattern)
        for whole in batches:
            for batch in _slices(whole, text):
                out = _list_array(units.encode_batch([t or "" for t in batch.column(text).to_pylist()]))
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), out], names=[*names, ids])

    wanted = [c for c in docs.columns if c != ids]
    return docs.select(*[F.col(f"`{c}`") for c in wanted]).mapInArrow(run, schema)


def decode(ids: Column, spark: SparkSession, rank_file: str) -> Column:
    """Raw bytes (``binary``) of each id list; the bytes need not be valid
    UTF-8 when the ids are a slice.  An id outside the ranks raises."""
    ranks = spark.sparkContext.broadcast(read_rank_file(rank_file))

    token: dict[int, bytes] = {}            # filled once per task

    def run(batch: pa.Array) -> pa.Array:
        if not token:
            token.update((i, b) for b, i in parse_ranks(ranks.value).items())
        return pa.array((b"".join(map(token.__getitem__, ids)) for ids in _id_lists(batch)), pa.binary())

    return F.arrow_udf(run, T.BinaryType())(ids)


def decode_documents(docs: DataFrame, rank_file: str, ids: str = "token_ids",
                     out: str = "decoded") -> DataFrame:
    """Adds ``out`` (``binary``): the bytes the ids stand for."""
    return docs.withColumn(out, decode(docs[ids], docs.sparkSession, rank_file))


class _Decimal(dict):
    def __missing__(self, i: int) -> str:
        self[i] = text = str(i)
        return text


def id_list_digest(ids: Column) -> Column:
    """Lowercase hex SHA-256 of the decimal ids joined by commas."""
    decimal = _Decimal()

    def run(batch: pa.Array) -> pa.Array:
        import hashlib
        return pa.array((hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest()
                         for ids in _id_lists(batch)), pa.string())

    return F.arrow_udf(run, T.StringType())(ids)
