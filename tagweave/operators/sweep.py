"""Span-to-token sweep.

Tokens and spans of a document meet in one sorted stream.  A document's tokens
lie side by side, so the tokens that a span overlaps are a stretch, found by
bisection of the sorted token ends and starts; spans claim the tokens of their
stretch in order of preference.  Work is linear in tokens and in the tokens that
spans cover, whatever the length of either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.operators.automaton import _documents


def claim(t_start: np.ndarray, t_end: np.ndarray, spans: list[tuple[int, int, str | None]]) -> dict[int, str]:
    """token index -> tag, for one document.  ``spans`` are (start, end,
    label); the earliest start goes first, then the longest, then the smallest
    label; a token keeps the first that claims it.  ``B-`` marks the first token
    a span overlaps, whoever claims it."""
    tags: dict[int, str] = {}
    free = np.ones(len(t_start), dtype=bool)
    for s, e, label in sorted(set(spans), key=lambda x: (x[0], -(x[1] - x[0]), x[2] is not None, x[2])):
        first = int(np.searchsorted(t_end, s, side="right"))          # ends behind the span's start
        last = int(np.searchsorted(t_start, e, side="left"))          # starts before its end
        for i in (np.flatnonzero(free[first:last]) + first).tolist():
            tags[i] = "O" if label is None else ("B-" if i == first else "I-") + label
        free[first:last] = False
    return tags


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def sweep(tokens: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """tokens(keys, pos, start, end, ...), spans(keys, s_start, s_end, s_label)
    -> every token column and ``tag``.  One exchange of both sides by document,
    where keys, places and the other token columns travel once; a batch holds its
    documents, and one that a batch cuts waits for its rest.  Rows are sorted by
    document only: a document with spans is put in order where it is swept."""
    columns = [c for c in tokens.columns if c != "tag"]
    kind = {c: tokens.schema[c].dataType for c in columns}
    source = {c: f"__{c}" for c in ("start", "end", "pos") if isinstance(kind[c], _WHOLE)} | {k: f"__k{i}" for i, k in enumerate(keys)}
    others = [c for c in columns if c not in source]
    source |= {c: f"__o{i}" for i, c in enumerate(others)}
    key = [F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)]
    a = tokens.select(*key, F.lit(True).alias("__is_token"), *[F.col(c).cast("long").alias(f"__{c}") for c in ("start", "end", "pos")],
                      F.lit(None).cast("string").alias("__label"), *[F.col(f"`{c}`").alias(source[c]) for c in others])
    b = spans.select(*key, F.lit(False).alias("__is_token"), F.col("s_start").cast("long").alias("__start"), F.col("s_end").cast("long").alias("__end"),
                     F.lit(None).cast("long").alias("__pos"), F.col("s_label").cast("string").alias("__label"),
                     *[F.lit(None).cast(kind[c]).alias(source[c]) for c in others])
    ks = [f"__k{i}" for i in range(len(keys))]
    rows = a.unionByName(b).repartition(*ks).sortWithinPartitions(*ks)
    schema = T.StructType([*(T.StructField(c, rows.schema[source[c]].dataType) for c in columns), T.StructField("tag", T.StringType())])

    def made(t: pa.Table | pa.RecordBatch, tags: pa.Array) -> pa.RecordBatch:
        cols = (t.column(source[c]) for c in columns)
        return pa.RecordBatch.from_arrays([*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols), tags], names=[*columns, "tag"])

    def document(t: pa.Table) -> pa.RecordBatch | None:
        is_token = t.column("__is_token").to_numpy().astype(bool)
        if not is_token.any():
            return None
        if is_token.all():
            return made(t, pa.repeat("O", t.num_rows))
        mine, claims = t.take(pa.array(np.flatnonzero(is_token))), t.take(pa.array(np.flatnonzero(~is_token)))
        start, end, pos = (mine.column(c).to_numpy() for c in ("__start", "__end", "__pos"))
        order = np.lexsort((pos, end, start))
        mine, start, end = mine.take(pa.array(order)), start[order], end[order]
        if (np.diff(end) < 0).any():
            raise ValueError("the tokens of a document overlap one another")
        tags = ["O"] * mine.num_rows
        found = claim(start, end, list(zip(*(claims.column(c).to_pylist() for c in ("__start", "__end", "__label")))))
        for i, tag in found.items():
            tags[i] = tag
        return made(mine, pa.array(tags, pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                whole = document(pa.Table.from_batches(held))
                held.clear()
                if whole is not None:
                    yield whole

        for b in batches:
            cols = [b.column(k) for k in ks]
            starts = np.flatnonzero(_documents(cols)).tolist()
            has_span = np.logical_or.reduceat(~b.column("__is_token").to_numpy(zero_copy_only=False).astype(bool), starts).tolist() if starts else []
            plain: list[tuple[int, int]] = []              # documents without spans inside the batch need no sweep
            for at, end, spanned in zip(starts, [*starts[1:], b.num_rows], has_span):
                key = tuple(c[at].as_py() for c in cols)
                if key != last:
                    yield from flush()
                    last = key
                if end < b.num_rows and not held and not spanned:
                    if plain and plain[-1][1] == at:
                        plain[-1] = plain[-1][0], end
                    else:
                        plain.append((at, end))
                else:
                    held.append(b.slice(at, end - at))
            for at, end in plain:
                yield made(b.slice(at, end - at), pa.repeat("O", end - at))
        yield from flush()

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"`{c}`").cast(kind[c]).alias(c) if schema[c].dataType != kind[c] else F.col(f"`{c}`") for c in columns], "tag")
