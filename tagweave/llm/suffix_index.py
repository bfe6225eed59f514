"""Long repeats by a logarithmic family of suffix arrays (operator 4).

A byte of a text is removed when a ``length``-byte string that covers it starts
anywhere else, in the same or another text.

Suffixes.  Every ``length``-byte window names one anchor (see ``bytehash``), and
equal windows name equal anchors at equal distances, so the suffixes that begin
at anchors are enough: the arrays are sparse.  Neighbouring windows with one
anchor form a run.  A batch's array holds the position of every such suffix
(text, run, distance of the anchor in it), sorted by a hash of the suffix's
first ``GRAM`` bytes, then by a hash of its run; a level holds one position of
each different suffix and its count, in the same order.

Logarithmic family.  ``SuffixIndex.add`` scans a new batch against every level:
a merge on the suffixes' order leaves those that the batch meets again.  The
suffixes found twice, in the batch or between it and a level, are the batch's
matches; an earlier suffix that had no copy until then is reported with them.
The batch then becomes a level, and two levels of one size become one of the
next, so every suffix is rewritten O(log batches) times.

Decision.  Runs that occur twice are repeats as a whole.  Where *different*
runs share an anchor (at the edges of repeats), one text of each is cut out and
its windows are compared by their hashes, in sorted batches of whole anchors.
Anchors with more than ``HOT`` runs are divided first: their windows fall into
ranges of distances from the anchor, and the bytes that all windows of a range
hold tell the runs apart, so only those that share them meet again.  Runs equal
over a whole range are settled together and one of them goes on.  Ranges narrow
until a group has at most ``HOT`` runs; in a range of one window all are equal.
So no task compares a large group, and a run has a few rows, not one a window.

Texts are known by 96 bits of hashes (xxhash64 and crc32), suffixes by 128 bits;
texts themselves are never exchanged unless the intervals to apply exceed
``MAX_BROADCAST_BYTES`` - then both sides are exchanged on the text's key and a
salt.

Edge cases: null text counts as empty; texts shorter than ``length`` keep every
byte; an empty table gives an empty result; repeated rows are repeats of one
another and are removed whole when long enough; extra columns are kept whatever
their names, but for those named like an output, which give way to it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.bytehash import Rolling, finalize, runs
from tagweave.llm.joins import join_measured, numbered, renamed
from tagweave.llm.store import Scratch, remove, stored
from tagweave.session import scratch_path

LENGTH = 200
GRAM = 32
BUFFER = 1 << 18
BATCHES = 4
HOT = 256
FANOUT = 4
MAX_BROADCAST_BYTES = 48 << 20
SLICE = 4 << 20


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    t = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    return docs.select(F.xxhash64(t).alias("k1"), F.crc32(t).alias("k2"), t.alias("t"))


def _segments(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts grouped into buffers: (row, offset in the text, bytes).  A text
    beyond the buffer is cut into segments that overlap by length - 1."""
    rows, offsets, parts, size = [], [], [], 0
    for row, t in enumerate(texts):
        if len(t) < length:
            continue
        for at in range(0, max(1, len(t) - length + 1), BUFFER):
            part = t[at:at + BUFFER + length - 1]
            if size and size + len(part) > BUFFER + length:
                yield rows, offsets, parts
                rows, offsets, parts, size = [], [], [], 0
            rows.append(row)
            offsets.append(at)
            parts.append(part)
            size += len(part)
    if parts:
        yield rows, offsets, parts


def _run_rows(keyed: DataFrame, length: int) -> DataFrame:
    """(akey, h, k1, k2, lo, n, off): every run of every text; ``lo`` its first
    window, ``n`` its windows, ``off`` the anchor's distance from lo."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(2 * BUFFER + 2 * length)
        for whole in batches:
            for cut in range(0, whole.num_rows, 1024):
                batch = whole.slice(cut, 1024)
                k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                for rows, offsets, parts in _segments(batch.column(2).to_pylist(), length):
                    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
                    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
                    first, last, anchor = runs(rolling, data, starts, length, GRAM)
                    if not len(first):
                        continue
                    off = anchor - first
                    akey = rolling.stretch(anchor, anchor + GRAM)
                    with np.errstate(over="ignore"):
                        h = finalize(rolling.stretch(first, last + length) + off.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    part = np.searchsorted(starts, first, side="right") - 1
                    row = np.array(rows)[part]
                    lo = first - starts[part] + np.array(offsets)[part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(akey.view(np.int64)), pa.array(h.view(np.int64)), pa.array(k1[row]), pa.array(k2[row]),
                         pa.array(lo.astype(np.int32)), pa.array((last - first + 1).astype(np.int16)), pa.array(off.astype(np.int16))],
                        names=["akey", "h", "k1", "k2", "lo", "n", "off"])

    return keyed.mapInArrow(run, "akey long, h long, k1 long, k2 long, lo int, n short, off short")


# a suffix's place in one long: lo, then n and off (both below length)
_Q = "shiftleft(cast(lo as bigint), 32) | shiftleft(cast(n as bigint), 16) | cast(off as bigint)"
_PLACE = ("k1", "k2", "q")


def _one(when: str | None = None, names: tuple[str, ...] = _PLACE) -> list[Column]:
    """One place of a group, by the least hash of the place: columns of fixed
    width, which Spark aggregates by hashing (a struct would be sorted)."""
    order = F.xxhash64(*_PLACE) if when is None else F.when(F.expr(when), F.xxhash64(*_PLACE))
    return [F.min_by(c, order).alias(name) for c, name in zip(_PLACE, names)]


def _unpacked(q: str = "q") -> list[Column]:
    """lo, n and off of a packed place."""
    return [F.expr(e).cast("int").alias(name) for name, e in
            (("lo", f"shiftright({q}, 32)"), ("n", f"shiftright({q}, 16) & 65535"), ("off", f"{q} & 65535"))]


class SuffixIndex:
    """A family of levels, at most one of each size, in a shared folder: sorted
    tables of (akey, h, c, k1, k2, q) with one place of each suffix."""

    def __init__(self, spark: SparkSession, path: str | None = None, length: int = LENGTH):
        self.spark, self.length = spark, length
        self.path = path or scratch_path(spark, "suffix-index")
        self.levels: dict[int, str] = {}

    def _write(self, entries: DataFrame) -> str:
        path = f"{self.path}/{uuid.uuid4().hex[:12]}"
        entries.sortWithinPartitions("akey", "h").write.parquet(path)
        return path

    def clear(self) -> None:
        for path in self.levels.values():
            remove(self.spark, path)
        self.levels.clear()

    def entries(self) -> DataFrame:
        """(akey, h, c, k1, k2, q) of every level."""
        return self._union([self.spark.read.parquet(p) for p in self.levels.values()])

    @staticmethod
    def _union(tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    def add(self, suffixes: DataFrame, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
        """Adds a batch of suffixes (akey, h, k1, k2, lo, n, off) and returns what
        it matches, as tables in ``scratch``: (k1, k2, lo, n) of the runs that
        occur again, and (akey, h, k1, k2, q, twice) of the suffixes that share an
        anchor with a different one."""
        scratch = scratch or Scratch(self.spark)
        array = self._write(suffixes.select("akey", "h", "k1", "k2", F.expr(_Q).alias("q")))
        batch = self.spark.read.parquet(array)
        level_path = self._write(batch.groupBy("akey", "h").agg(F.count(F.lit(1)).alias("c"), *_one()))
        new = self.spark.read.parquet(level_path)
        # the scan: suffixes of each level whose anchor the batch holds too
        met = [self.spark.read.parquet(p).join(new.select("akey"), "akey", "left_semi") for p in self.levels.values()]
        seen = self._union([new.withColumn("fresh", F.lit(True)), *[m.withColumn("fresh", F.lit(False)) for m in met]])
        anchors = (seen.groupBy("akey").agg(F.sum("c").alias("t"), (F.min("h") < F.max("h")).alias("shared"))
                   .filter("t > 1").select("akey", "shared"))
        hits = scratch.put(
            seen.join(anchors, "akey").groupBy("akey", "h")
            .agg((F.sum("c") > 1).alias("twice"), F.max("shared").alias("shared"), F.max("fresh").alias("fresh"), *_one(),
                 *_one("not fresh and c = 1", ("lone1", "lone2", "lone"))), "suffix-hits")
        again = hits.filter("twice and fresh")
        here = batch.join(again.select("akey", "h"), ["akey", "h"], "left_semi").select("k1", "k2", *_unpacked()[:2])
        before = again.filter("lone is not null").select(F.col("lone1").alias("k1"), F.col("lone2").alias("k2"), *_unpacked("lone")[:2])
        whole = scratch.put(here.unionByName(before), "suffix-whole")
        remove(self.spark, array)
        self._settle(level_path)
        return whole, hits.filter("shared").select("akey", "h", *_PLACE, "twice")

    def _settle(self, array: str) -> None:
        """Files a level, merging while there is another of its size."""
        level = 0
        while level in self.levels:
            other = self.levels.pop(level)
            both = self.spark.read.parquet(array).unionByName(self.spark.read.parquet(other))
            merged = self._write(both.groupBy("akey", "h").agg(F.sum("c").alias("c"), *_one()))
            remove(self.spark, array)
            remove(self.spark, other)
            array, level = merged, level + 1
        self.levels[level] = array


_PACKED_BYTES = "octet_length(packed) + 40"
_REP = np.dtype([("akey", "<i8"), ("lo", "<i4"), ("n", "<i4"), ("off", "<i4"), ("twice", "<i4")])


def _lists(items: pa.ListArray) -> tuple[list[np.ndarray], np.ndarray]:
    """The fields of a column of lists of structs, and where its lists begin."""
    values = items.flatten()
    ends = np.concatenate([[0], np.cumsum(items.value_lengths().to_numpy())])
    return [f.to_numpy(zero_copy_only=False) for f in values.flatten()], ends


def _pack_runs(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """(k1, k2, packed): the runs to cut out of each text, as records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fields, ends = _lists(b.column(2))
            a = np.zeros(int(ends[-1]), dtype=_REP)
            for name, f in zip(_REP.names, fields):
                a[name] = f
            out = [a[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["k1", "k2", "packed"])

    listed = reps.groupBy("k1", "k2").agg(F.collect_list(F.struct("akey", "lo", "n", "off", "twice")).alias("items"))
    return scratch.put(listed.mapInArrow(run, "k1 long, k2 long, packed binary"), "suffix-packed")


def _cut_runs(keyed: DataFrame, packed: DataFrame, length: int) -> DataFrame:
    """(akey, k1, k2, lo, off, twice, part): the bytes of the runs."""

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                t = b.column(2)[i].as_py()
                a = np.frombuffer(b.column(3)[i].as_py(), dtype=_REP)
                m = len(a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a["akey"].copy()), pa.array(np.full(m, b.column(0)[i].as_py())), pa.array(np.full(m, b.column(1)[i].as_py())),
                     pa.array(a["lo"].copy()), pa.array(a["off"].copy()), pa.array(a["twice"] == 1),
                     pa.array([t[lo:lo + n + length - 1] for lo, n in zip(a["lo"].tolist(), a["n"].tolist())], pa.binary())],
                    names=["akey", "k1", "k2", "lo", "off", "twice", "part"])

    joined = join_measured(keyed, packed, ["k1", "k2"], F.expr(_PACKED_BYTES), max_bytes=MAX_BROADCAST_BYTES).select("k1", "k2", "t", "packed")
    return joined.mapInArrow(bytes_of, "akey long, k1 long, k2 long, lo int, off int, twice boolean, part binary")


def _range_widths(length: int) -> list[int]:
    """Widths of the ranges of a window's distance from its anchor, the last 1."""
    widths, width = [], length - GRAM + 1
    while width > 1:
        width = -(-width // FANOUT)
        widths.append(width)
    return widths or [1]


def _divide(cut: DataFrame, length: int, width: int) -> DataFrame:
    """(akey, h, k1, k2, q, twice): the runs' windows by ranges of ``width``
    distances from the anchor.  ``akey`` is now a hash of the run's own, the
    range and the bytes common to all its windows - runs of different ``akey``
    have no equal window in the range - and ``h`` one of all bytes that the
    run's windows in the range cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(2 * BUFFER)
        for whole in batches:
            for cut_at in range(0, whole.num_rows, 512):
                b = whole.slice(cut_at, 512)
                akey, k1, k2, lo, off = (b.column(i).to_numpy() for i in range(5))
                parts = b.column(6).to_pylist()
                sizes = np.array([len(p) for p in parts])
                rolling.load(np.frombuffer(b"".join(parts), dtype=np.uint8))
                off = off.astype(np.int64)
                least = off - (sizes - length)                # the last window's distance
                many = off // width - least // width + 1
                row = np.repeat(np.arange(len(parts)), many)
                first = (least // width)[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                near, far = first * width, np.minimum(first * width + width - 1, length - GRAM)
                n_near, n_far = np.maximum(near, least[row]), np.minimum(far, off[row])
                anchor = (np.cumsum(sizes) - sizes + off)[row]
                with np.errstate(over="ignore"):
                    core = rolling.stretch(anchor - near, anchor - far + length)
                    group = finalize(core ^ finalize(akey.view(np.uint64)[row] + near.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                    h = finalize(rolling.stretch(anchor - n_far, anchor - n_near + length) + n_far.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                start = lo[row].astype(np.int64) + off[row] - n_far
                q = start << 32 | (n_far - n_near + 1) << 16 | n_far
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group.view(np.int64)), pa.array(h.view(np.int64)), pa.array(k1[row]), pa.array(k2[row]), pa.array(q),
                     b.column(5).take(pa.array(row))], names=["akey", "h", "k1", "k2", "q", "twice"])

    return cut.mapInArrow(run, "akey long, h long, k1 long, k2 long, q long, twice boolean")


def _groups(runs: DataFrame) -> DataFrame:
    """Different runs, each known to occur twice or not, that share an anchor
    with another and of which at least one is still to be decided; ``m`` is the
    number of runs at the anchor."""
    many = (runs.groupBy("akey").agg(F.count(F.lit(1)).alias("m"), F.min("twice").alias("done"))
            .filter("m > 1 and not done").select("akey", "m"))
    return runs.join(many, "akey").select("akey", "k1", "k2", *_unpacked(), "twice", "m")


def _separate(keyed: DataFrame, reps: DataFrame, length: int, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame]]:
    """Divides the anchors with more than ``HOT`` runs until none is left:
    tables of runs to compare, of up to ``HOT`` for an ``akey``, and of
    repeated stretches (k1, k2, start, end) found on the way."""
    small, found = [reps.filter(F.col("m") <= HOT)], []
    for width in _range_widths(length):
        large = reps.filter(F.col("m") > HOT)
        if large.isEmpty():
            break
        ranges = scratch.put(_divide(_cut_runs(keyed, _pack_runs(large, scratch), length), length, width), "suffix-ranges")
        alike = scratch.put(ranges.groupBy("akey", "h").agg(F.count(F.lit(1)).alias("c"), F.max("twice").alias("twice"), *_one()), "suffix-alike")
        equal = ranges.filter("not twice").join(alike.filter("c > 1"), ["akey", "h"], "left_semi").select("k1", "k2", *_unpacked())
        found.append(equal.select("k1", "k2", F.col("lo").alias("start"), (F.col("lo") + F.col("n") - 1 + length).alias("end")))
        reps = scratch.put(_groups(alike.withColumn("twice", F.expr("twice or c > 1"))), "suffix-reps")
        small.append(reps.filter(F.col("m") <= HOT))
    return small, found


def _window_hashes(rolling: Rolling, parts: list[bytes], off: np.ndarray, length: int):
    """For every window of every part: (part, anchor's distance from the
    window's start, hash of the window and that distance)."""
    if not parts:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z.astype(np.uint64)
    sizes = np.array([len(p) for p in parts])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    rolling.load(np.frombuffer(b"".join(parts), dtype=np.uint8))
    n = sizes - length + 1
    row = np.repeat(np.arange(len(parts)), n)
    within = np.arange(int(n.sum())) - np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], n)
    at = starts[row] + within
    j = off[row].astype(np.int64) - within
    with np.errstate(over="ignore"):
        return row, j, finalize(rolling.stretch(at, at + length) + j.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _compare_cold(cut: DataFrame, length: int) -> DataFrame:
    """Windows of runs that share an anchor, compared in sorted batches:
    (k1, k2, start, end) of the repeated stretches of runs that occur once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(4 * BUFFER)
        held = None

        def decide(t: pa.Table) -> pa.RecordBatch:
            akey = t.column(0).to_numpy()
            k1, k2, lo, off = (t.column(i).to_numpy() for i in (1, 2, 3, 4))
            twice = t.column(5).to_numpy(zero_copy_only=False).astype(bool)
            row, j, h = _window_hashes(rolling, t.column(6).to_pylist(), off, length)
            with np.errstate(over="ignore"):
                key = finalize(h ^ finalize(akey.view(np.uint64)[row]))
            _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            again = (count[inverse] > 1) & ~twice[row]
            at = lo[row].astype(np.int64) + off[row] - j
            # neighbouring repeated windows of one run become one stretch
            w = np.flatnonzero(again)
            new = np.concatenate([[True], (row[w][1:] != row[w][:-1]) | (at[w][1:] != at[w][:-1] + 1)]) if len(w) else np.zeros(0, bool)
            first, last = w[new], w[np.concatenate([new[1:], [True]])] if len(w) else w
            return pa.RecordBatch.from_arrays(
                [pa.array(k1[row[first]]), pa.array(k2[row[first]]), pa.array(at[first].astype(np.int32)),
                 pa.array((at[last] + length).astype(np.int32))], names=["k1", "k2", "start", "end"])

        for whole in batches:
            for cut_at in range(0, whole.num_rows, 2048):
                piece = pa.Table.from_batches([whole.slice(cut_at, 2048)])
                held = piece if held is None else pa.concat_tables([held, piece]).combine_chunks()
                akey = held.column(0).to_numpy()
                new = np.flatnonzero(akey[1:] != akey[:-1]) + 1
                if len(new) and held.num_rows >= 2048:        # the last anchor may go on
                    yield decide(held.slice(0, int(new[-1])))
                    held = held.slice(int(new[-1]))
        if held is not None and held.num_rows:
            yield decide(held)

    return (cut.repartition("akey").sortWithinPartitions("akey")
            .mapInArrow(run, "k1 long, k2 long, start int, end int"))


def _merge(stretches: DataFrame) -> DataFrame:
    """(k1, k2, packed): the union of each text's stretches, as int32 pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (start, end), bounds = _lists(b.column(2))
            out = []
            for i, j in zip(bounds[:-1], bounds[1:]):
                order = np.argsort(start[i:j], kind="stable")
                s, reach = start[i:j][order], np.maximum.accumulate(end[i:j][order])
                new = np.concatenate([[True], s[1:] > reach[:-1]])
                last = np.concatenate([new[1:], [True]])
                out.append(np.stack([s[new], reach[last]], axis=1).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["k1", "k2", "packed"])

    listed = stretches.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("items"))
    return stored(listed.mapInArrow(run, "k1 long, k2 long, packed binary"), "suffix-removed")


_CUT = pa.struct([("kept", pa.binary()), ("removed", pa.int64()), ("spans", pa.int64())])


def _cut_texts(data: pa.Array, packed: pa.Array) -> pa.Array:
    """The texts without their stretches.  A batch is cut in slices of at most
    ``SLICE`` bytes (a longer text alone), on the column's own buffer."""
    if not len(data):
        return pa.array([], _CUT)
    offsets = np.frombuffer(data.buffers()[1], dtype="<i8" if pa.types.is_large_binary(data.type) else "<i4")
    offsets = offsets[data.offset:data.offset + len(data) + 1].astype(np.int64)
    raw = np.frombuffer(data.buffers()[2] or b"", dtype=np.uint8)
    out, first = [], 0
    while first < len(data):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, side="right")) - 1)
        base = offsets[first]
        stay = np.ones(int(offsets[last] - base), dtype=bool)
        spans = np.zeros(last - first, dtype=np.int64)
        for i in range(first, last):
            if packed[i].is_valid:
                a = np.frombuffer(packed[i].as_buffer(), dtype="<i4").reshape(-1, 2)
                spans[i - first] = len(a)
                for start, end in (a + (offsets[i] - base)).tolist():
                    stay[start:end] = False
        before = np.concatenate([[0], np.cumsum(stay, dtype=np.int64)])
        at = before[offsets[first:last + 1] - base]
        rest = raw[base:offsets[last]][stay]
        kept = pa.Array.from_buffers(pa.binary(), last - first, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(rest)])
        removed = np.diff(offsets[first:last + 1]) - np.diff(at)
        out.append(pa.StructArray.from_arrays([kept, pa.array(removed), pa.array(spans)], fields=list(_CUT)))
        first = last
    return pa.concat_arrays(out)


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, batches: int = BATCHES,
                   kept: str = "kept") -> DataFrame:
    """Adds ``kept`` (binary: the bytes that stay), ``n_bytes``, ``n_removed``
    and ``n_spans`` (long) to every row."""
    spark = docs.sparkSession
    keyed = _keyed(docs, text)
    index, scratch = SuffixIndex(spark, length=length), Scratch(spark)
    found = [index.add(_run_rows(keyed.filter(F.pmod("k1", F.lit(batches)) == b), length), scratch) for b in range(batches)]
    index.clear()
    whole = (index._union([w for w, _ in found])
             .select("k1", "k2", F.col("lo").alias("start"), (F.col("lo") + F.col("n") - 1 + length).alias("end")))
    # one text of each run whose anchor has other runs
    sharing = index._union([s for _, s in found]).groupBy("akey", "h").agg(F.max("twice").alias("twice"), *_one())
    small, equal = _separate(keyed, scratch.put(_groups(sharing), "suffix-reps"), length, scratch)
    cold = _compare_cold(_cut_runs(keyed, _pack_runs(index._union(small), scratch), length), length)
    merged = _merge(index._union([whole, cold, *equal]))
    scratch.clear()

    rows, names = numbered(docs)
    t = F.coalesce(F.col(f"c{names.index(text)}"), F.lit("")).cast("binary")
    rows = rows.withColumn("k1", F.xxhash64(t)).withColumn("k2", F.crc32(t))
    joined = join_measured(rows, merged, ["k1", "k2"], F.expr(_PACKED_BYTES), "left", MAX_BROADCAST_BYTES)
    cut = F.arrow_udf(_cut_texts, "struct<kept:binary,removed:bigint,spans:bigint>")
    made = joined.withColumn("cut", cut(t, "packed"))
    return made.select(*renamed(names, (kept, "n_bytes", "n_removed", "n_spans")), F.col("cut.kept").alias(kept),
                       F.octet_length(t).cast("long").alias("n_bytes"), F.col("cut.removed").alias("n_removed"),
                       F.col("cut.spans").alias("n_spans"))
