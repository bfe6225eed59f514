"""Hard negatives by a multiway hyperplane tree (operator 13).

Scores are inner products of integer vectors.  With ``M`` the largest norm,
a row gets one more coordinate that fills its norm up to ``M`` and an anchor
gets a zero there: then ``distance^2 = |anchor|^2 + M^2 - 2 * score``, so a
window of scores is an annulus round the anchor.

Tree.  A node has up to ``FANOUT`` split points (rows of a bounded sample,
``SAMPLE`` rows by the smallest hash of the id, each the farthest from those
before); a row goes to the nearest one, which cuts space by hyperplanes.  For
every pair (i, j) the node stores the smallest and largest distance from split
point i to the rows below j, taken over all rows.  A row at distance x from
split point i, which is itself at distance d from the anchor, can lie in the
annulus [r1, r2] only if ``max(d - r2, r1 - d) <= x <= d + r2``; a child whose
range misses that interval for any i is left out.  Nodes split down to leaves of
about ``LEAF`` rows; only the split points come from the sample, all rows are
filed.

Search.  Subtrees of about ``CELL`` rows are the cells that tasks work on; a
cell with more rows is dealt over chunks.  Anchors go to the cells their annulus
reaches, and inside a cell to the leaves it reaches, where every row is scored
exactly.  An anchor first visits its own cell, which narrows the annulus (the
fifth score found is a bound), then the others: once for the positives, and once
for the negatives, whose windows follow from the positives.  A task holds one
chunk of rows and streams the anchors past it, so neither a hot vector nor the
number of anchors fills its memory.

The result is exact; on vectors without clusters (distances all alike) the
triangle inequality excludes few leaves and a search reads most rows.

Edge cases: rows with a null id, label or vector, null or non-finite components,
no components, or another length than most rows take no part; zero vectors do;
rows that share an id count as one (the smallest label, then vector); equal
scores are ordered by id; an anchor without positives, or a positive with a
negative score, has no negatives; an empty table gives an empty result; other
columns are ignored.  Scores that need more than 62 bits raise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.llm.store import Scratch

SAMPLE = 16_384
FANOUT = 16
LEAF = 256
CELL = 4_096
BLOCK = 256
LEAST, MOST = -(1 << 62), 1 << 62


class Tree:
    """Split points, children and distance ranges of every node.  A child is
    the number of a node, or ``-1 - leaf``."""

    def __init__(self, sample: np.ndarray, rows: int, m2: int, leaf: int = LEAF, cell: int = CELL, fanout: int = FANOUT):
        self.m2, self.fanout = float(m2), fanout
        self.points: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.leaves = 0
        self.cell_of_leaf: list[int] = []
        self.cells: list[int] = []              # the child number that a cell stands for
        lifted = self.lift(sample)
        self.root = self._grow(lifted, np.arange(len(lifted)), rows / max(1, len(lifted)), leaf, cell, -1, 0)

    def lift(self, v: np.ndarray) -> np.ndarray:
        x = v.astype(np.float64)
        return np.concatenate([x, np.sqrt(np.maximum(0.0, self.m2 - (x * x).sum(axis=1)))[:, None]], axis=1)

    def distances(self, x: np.ndarray, node: int) -> np.ndarray:
        """From lifted rows to the split points of a node."""
        return np.sqrt(np.maximum(0.0, 2 * self.m2 - 2 * (x @ self.points[node].T)))

    def _grow(self, x: np.ndarray, at: np.ndarray, weight: float, leaf: int, cell: int, in_cell: int, depth: int) -> int:
        opens = in_cell < 0 and len(at) * weight <= cell
        if opens:
            in_cell = len(self.cells)
            self.cells.append(0)
        picked = self._pick(x, at) if len(at) * weight > leaf and len(at) >= 2 * self.fanout and depth < 8 else []
        if len(picked) < 2:
            number = -1 - self.leaves
            self.leaves += 1
            if in_cell < 0:                     # a leaf beyond the cell size is a cell of its own, in chunks
                in_cell = len(self.cells)
                self.cells.append(number)
            self.cell_of_leaf.append(in_cell)
        else:
            number, m = len(self.points), len(picked)
            self.points.append(x[picked])
            self.children.append([])
            self.low.append(np.full((m, m), np.inf))
            self.high.append(np.full((m, m), -np.inf))
            near = self.distances(x[at], number).argmin(axis=1)
            for j in range(m):
                self.children[number].append(self._grow(x, at[near == j], weight, leaf, cell, in_cell, depth + 1))
        if opens:
            self.cells[in_cell] = number
        return number

    def _pick(self, x: np.ndarray, at: np.ndarray) -> list[int]:
        """Rows of the sample, each the farthest from those before."""
        picked, gap = [int(at[0])], None
        while len(picked) < self.fanout:
            d = 2 * self.m2 - 2 * (x[at] @ x[picked[-1]])
            gap = d if gap is None else np.minimum(gap, d)
            far = int(gap.argmax())
            if gap[far] <= 1e-6 * max(1.0, self.m2):
                break
            picked.append(int(at[far]))
        return picked

    def file(self, x: np.ndarray, widen=None) -> np.ndarray:
        """The leaf of every lifted row; ``widen(node, child, distances)`` sees
        the rows that go to each child."""
        out = np.zeros(len(x), dtype=np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            number, at = todo.pop()
            if number < 0:
                out[at] = -1 - number
                continue
            d = self.distances(x[at], number)
            near = d.argmin(axis=1)
            for j, child in enumerate(self.children[number]):
                mine = near == j
                if mine.any():
                    if widen:
                        widen(number, j, d[mine])
                    todo.append((child, at[mine]))
        return out

    def reached(self, anchors: np.ndarray, inner: np.ndarray, outer: np.ndarray, start: int | None = None) -> np.ndarray:
        """anchors x leaves: which leaves the annuli can reach, from a node down."""
        out = np.zeros((len(anchors), self.leaves), dtype=bool)
        slack = 1e-6 * max(1.0, np.sqrt(self.m2))
        norms = (anchors * anchors).sum(axis=1)
        todo = [(self.root if start is None else start, np.arange(len(anchors)))]
        while todo:
            number, at = todo.pop()
            if number < 0:
                out[at, -1 - number] = True
                continue
            points = self.points[number][:, :-1]
            d = np.sqrt(np.maximum(0.0, norms[at, None] + self.m2 - 2 * (anchors[at] @ points.T)))
            least = (np.maximum(d - outer[at, None], inner[at, None] - d) - slack)[:, :, None]
            most = (d + outer[at, None] + slack)[:, :, None]
            open_ = ((least <= self.high[number]) & (most >= self.low[number])).all(axis=1)
            for j, child in enumerate(self.children[number]):
                mine = at[open_[:, j]]
                if len(mine):
                    todo.append((child, mine))
        return out

    def annulus(self, anchors: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Radii for windows of scores."""
        norm = (anchors * anchors).sum(axis=1) + self.m2
        radius = lambda s: np.sqrt(np.maximum(0.0, norm - 2 * s.astype(np.float64)))
        return radius(most), radius(least)


def _matrix(column: pa.Array, dim: int, kind=np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(kind)


def _filed(rows: DataFrame, tree, dim: int, vector: str) -> DataFrame:
    """Rows with their leaf and cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tree.value
        cells = np.array(t.cell_of_leaf, dtype=np.int32)
        for b in batches:
            leaf = t.file(t.lift(_matrix(b.column("v"), dim)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf.astype(np.int32)), pa.array(cells[leaf])],
                                             names=[*b.schema.names, "leaf", "cell"])

    return rows.select("id", "label", "v", "anchor").mapInArrow(run, f"id long, label long, v {vector}, anchor boolean, leaf int, cell int")


def _measure(rows: DataFrame, tree, dim: int) -> DataFrame:
    """(node, low, high): the ranges over all rows, as arrays of doubles."""
    kind = "node int, low binary, high binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tree.value

        def widen(node: int, child: int, d: np.ndarray) -> None:
            t.low[node][:, child] = np.minimum(t.low[node][:, child], d.min(axis=0))
            t.high[node][:, child] = np.maximum(t.high[node][:, child], d.max(axis=0))

        t.low = [np.full_like(a, np.inf) for a in t.low]
        t.high = [np.full_like(a, -np.inf) for a in t.high]
        for b in batches:
            t.file(t.lift(_matrix(b.column("v"), dim)), widen)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(t.low)), pa.int32()), pa.array([a.tobytes() for a in t.low], pa.binary()),
                                          pa.array([a.tobytes() for a in t.high], pa.binary())], names=["node", "low", "high"])

    def merge(group: pa.Table) -> pa.Table:
        low = np.minimum.reduce([np.frombuffer(x) for x in group.column("low").to_pylist()])
        high = np.maximum.reduce([np.frombuffer(x) for x in group.column("high").to_pylist()])
        return pa.table({"node": group.column("node").slice(0, 1), "low": pa.array([low.tobytes()], pa.binary()),
                         "high": pa.array([high.tobytes()], pa.binary())})

    return rows.select("v").mapInArrow(run, kind).groupBy("node").applyInArrow(merge, kind)


def _dealt(asks: DataFrame, tree, chunks: dict[int, int], dim: int, vector: str, own: bool) -> DataFrame:
    """Anchors copied to the chunks they have to visit: their own cell, or the
    others that the annulus of their windows reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tree.value
        cell_of_leaf = np.array(t.cell_of_leaf)
        for whole in batches:
            for cut in range(0, whole.num_rows, BLOCK):
                b = whole.slice(cut, BLOCK)
                home = b.column("cell").to_numpy()
                if own:
                    row, cell = np.arange(len(home)), home
                else:
                    a = _matrix(b.column("v"), dim)
                    w = b.column("windows")
                    ends = np.concatenate([[0], np.cumsum(w.value_lengths().to_numpy(zero_copy_only=False))])
                    flat = w.flatten()
                    lo, hi = (np.asarray(flat.field(i)) for i in (0, 1))
                    inner, outer = t.annulus(a, np.minimum.reduceat(lo, ends[:-1]), np.maximum.reduceat(hi, ends[:-1]))
                    leaves = t.reached(a, inner, outer)
                    open_ = np.zeros((len(a), len(t.cells)), dtype=bool)
                    r, leaf = np.nonzero(leaves)
                    open_[r, cell_of_leaf[leaf]] = True
                    open_[np.arange(len(a)), home] = False
                    row, cell = np.nonzero(open_)
                n = np.array([chunks.get(int(c), 0) for c in cell], dtype=np.int64)
                row, cell = np.repeat(row, n), np.repeat(cell, n)
                chunk = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                pick = b.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), pa.array(chunk.astype(np.int32)),
                     *(pick.column(c) for c in ("id", "label", "v", "windows"))], names=["cell", "chunk", "id", "label", "v", "windows"])

    return asks.select("id", "label", "v", "cell", "windows").mapInArrow(
        run, f"cell int, chunk int, id long, label long, v {vector}, windows array<struct<lo:bigint,hi:bigint>>")


def _searched(asks: DataFrame, cells: DataFrame, tree, dim: int, k: int, same: bool, wide: bool) -> DataFrame:
    """(a, w, id, s): the ``k`` best rows of each chunk for every window ``w``
    of every anchor sent there."""
    windows = asks.schema["windows"].dataType.simpleString()
    a = asks.withColumn("is_ask", F.lit(1)).withColumn("leaf", F.lit(None).cast("int"))
    r = cells.withColumn("is_ask", F.lit(0)).withColumn("windows", F.lit(None).cast(windows))
    columns = ["cell", "chunk", "is_ask", "leaf", "id", "label", "v", "windows"]
    both = (r.select(*columns).unionByName(a.select(*columns)).repartition("cell", "chunk")
            .sortWithinPartitions("cell", "chunk", "is_ask", "leaf", "id"))
    kind = np.int64 if wide else np.float64

    class Chunk:
        def __init__(self, t, table: pa.Table, cell: int):
            self.start = t.cells[cell]
            leaf = table.column("leaf").to_numpy()
            self.ids, self.labels = (table.column(c).to_numpy() for c in ("id", "label"))
            self.v = _matrix(table.column("v").combine_chunks(), dim, kind)
            self.leaf = leaf
            first = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
            self.parts = [(int(leaf[i]), slice(int(i), int(j))) for i, j in zip(first, [*first[1:], len(leaf)])]

        def answer(self, t, b: pa.RecordBatch, out: list) -> None:
            anchors = _matrix(b.column("v"), dim, kind)
            ids, labels = b.column("id").to_numpy(), b.column("label").to_numpy()
            asked = [[(w["lo"], w["hi"]) for w in ws] for ws in b.column("windows").to_pylist()]
            least, most = (np.array([f(w[i] for w in ws) for ws in asked]) for f, i in ((min, 0), (max, 1)))
            x = anchors.astype(np.float64)
            leaves = t.reached(x, *t.annulus(x, least, most), start=self.start)
            parts = [s for leaf, s in self.parts if leaves[:, leaf].any()]
            if not parts:
                return
            take = np.concatenate([np.arange(s.start, s.stop) for s in parts])
            score = anchors @ self.v[take].T
            row_ids, row_labels, row_leaf = self.ids[take], self.labels[take], self.leaf[take]
            for i in range(len(ids)):
                s = score[i]
                fits = leaves[i, row_leaf] & ((row_labels == labels[i]) == same) & (row_ids != ids[i])
                for w, (lo, hi) in enumerate(asked[i]):
                    at = np.flatnonzero(fits & (s >= lo) & (s <= hi))
                    if len(at) > k:
                        at = at[s[at] >= np.partition(s[at], len(at) - k)[len(at) - k]]
                        at = at[np.lexsort((row_ids[at], -s[at]))[:k]]
                    if len(at):
                        out.append((ids[i], w, row_ids[at], s[at].astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tree.value
        at, rows, chunk = None, [], None
        for whole in batches:
            cell, part, ask = (whole.column(c).to_numpy() for c in ("cell", "chunk", "is_ask"))
            new = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (ask[1:] != ask[:-1])]))
            for i, j in zip(new, [*new[1:], len(cell)]):
                if (cell[i], part[i]) != at:
                    at, rows, chunk = (cell[i], part[i]), [], None
                if not ask[i]:
                    rows.append(whole.slice(i, j - i))
                    continue
                if chunk is None:
                    if not rows:
                        continue
                    chunk, rows = Chunk(t, pa.Table.from_batches(rows), int(at[0])), []
                out: list = []
                for cut in range(i, j, BLOCK):
                    chunk.answer(t, whole.slice(cut, min(BLOCK, j - cut)), out)
                if out:
                    n = [len(o[2]) for o in out]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat([o[0] for o in out], n), pa.int64()), pa.array(np.repeat([o[1] for o in out], n), pa.int32()),
                         pa.array(np.concatenate([o[2] for o in out]), pa.int64()), pa.array(np.concatenate([o[3] for o in out]), pa.int64())],
                        names=["a", "w", "id", "s"])

    return both.mapInArrow(run, "a long, w int, id long, s long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("a", "w").orderBy(F.desc("s"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def integer_rows(vectors: DataFrame, is_anchor: Column, scale: int, vec_id: str, vector: str, label: str) -> tuple[DataFrame, int, int]:
    """(id, label, v, anchor) with one row per id, the vectors' length, and the
    largest size of a component; vectors keep the smallest integer type."""
    raw = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"),
                           raw.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
            .filter("id is not null and label is not null and v is not null and size(v) > 0").filter(whole))
    dims = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return rows, 0, 0
    rows = rows.filter(F.size("v") == dims.dim)
    scaled = F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x))
    largest = rows.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(F.lit(float(scale)) * x)))).alias("b")).first().b + 1
    if dims.dim * largest * largest >= 2.0 ** 60:
        raise ValueError("scores of these vectors need more than 62 bits")
    kind = "array<smallint>" if largest < 2 ** 15 else "array<int>" if largest < 2 ** 31 else "array<bigint>"
    one = (rows.select("id", F.struct("label", scaled.cast(kind).alias("v"), "anchor").alias("r"))
           .groupBy("id").agg(F.min("r").alias("r")))
    return one.select("id", "r.*"), dims.dim, int(largest)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
         scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
         sample: int = SAMPLE, leaf: int = LEAF, cell: int = CELL) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): for every anchor and each of its best rows of the same
    label, the best rows of other labels whose score is ``low`` to ``high``
    percent of the positive's."""
    spark = vectors.sparkSession
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    scratch = Scratch(spark)
    rows, dim, largest = integer_rows(vectors, is_anchor, scale, vec_id, vector, label)
    if not dim:
        return spark.createDataFrame([], result)
    kind = rows.schema["v"].dataType.simpleString()
    wide = dim * largest * largest >= 2 ** 53
    rows = scratch.put(rows, "gnat-rows")
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x.cast("long"))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("m2")).first()
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
    grown = Tree(_matrix(picked.column("v").combine_chunks(), dim), facts.n, facts.m2, leaf, cell)

    tree = spark.sparkContext.broadcast(grown)
    for r in _measure(rows, tree, dim).collect():            # one row per node of the tree
        shape = grown.low[r.node].shape
        grown.low[r.node] = np.frombuffer(bytes(r.low)).reshape(shape)
        grown.high[r.node] = np.frombuffer(bytes(r.high)).reshape(shape)
    tree.unpersist()
    tree = spark.sparkContext.broadcast(grown)
    filed = scratch.put(_filed(rows, tree, dim, kind), "gnat-filed")
    counts = filed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()     # one row per cell
    chunks = {r.cell: -(-r.n // cell) for r in counts}
    parts = F.element_at(F.create_map(*[F.lit(x) for c in chunks.items() for x in c]), F.col("cell"))
    cells = filed.withColumn("chunk", F.pmod(F.xxhash64("id"), parts.cast("long")).cast("int"))
    anchors = filed.filter("anchor").select("id", "label", "v", "cell")
    window = "array<struct<lo:bigint,hi:bigint>>"

    def search(asks: DataFrame, own: bool, k: int, same: bool) -> DataFrame:
        return _searched(_dealt(asks, tree, chunks, dim, kind, own), cells, tree, dim, k, same, wide)

    def one(lo: Column, hi: Column) -> Column:
        return F.array(F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))).cast(window)

    # positives: the own cell bounds the search of the others
    near = scratch.put(_best(search(anchors.withColumn("windows", one(F.lit(LEAST), F.lit(MOST))), True, positives, True), positives), "gnat-near")
    bound = near.filter(F.col("rank") == positives).select(F.col("a").alias("id"), F.col("s").alias("least"))
    asks = anchors.join(bound, "id", "left").withColumn("windows", one(F.coalesce("least", F.lit(LEAST)), F.lit(MOST)))
    far = search(asks, False, positives, True)
    best = scratch.put(_best(near.drop("rank").unionByName(far), positives), "gnat-positives")

    # negatives: a window of scores for each positive, narrowed by what the own cell holds
    p = best.select(F.col("a").alias("id"), "rank", F.col("id").alias("positive_id"), F.col("s").alias("ps")).filter("ps >= 0")
    spans = p.select("id", "rank", "positive_id", "ps", F.expr(f"(ps * {low} + 99) div 100").alias("lo"), F.expr(f"ps * {high} div 100").alias("hi"))
    listed = spans.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "lo", "hi"))).alias("spans"))
    asks = anchors.join(listed, "id")
    first = asks.withColumn("windows", F.transform("spans", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"))).cast(window))
    near = scratch.put(_best(search(first, True, negatives, False), negatives), "gnat-near-negatives")
    full = near.filter(F.col("rank") == negatives).groupBy(F.col("a").alias("id")).agg(
        F.map_from_entries(F.collect_list(F.struct("w", "s"))).alias("least"))
    narrowed = F.transform("spans", lambda x, i: F.struct(
        F.greatest(x["lo"], F.coalesce(F.try_element_at(F.col("least"), i), x["lo"])).alias("lo"), x["hi"].alias("hi")))
    far = search(asks.join(full, "id", "left").withColumn("windows", narrowed.cast(window)), False, negatives, False)
    found = _best(near.drop("rank").unionByName(far), negatives)
    out = (found.withColumnRenamed("id", "negative_id").withColumnRenamed("rank", "place")
           .join(spans.select(F.col("id").alias("a"), (F.col("rank") - 1).alias("w"), "positive_id", "ps"), ["a", "w"])
           .select(F.col("a").alias("anchor_id"), "positive_id", F.col("place").cast("int").alias("rank"), "negative_id",
                   F.col("ps").alias("positive_score"), F.col("s").alias("negative_score")))
    kept = Scratch(spark).put(out, "gnat-result")
    scratch.clear()
    return kept
