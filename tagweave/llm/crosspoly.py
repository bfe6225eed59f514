"""Approximate nearest neighbours by cross-polytope hashing (operator 7).

Nearness is the inner product.  Vectors are put on the unit sphere so that the
order of inner products becomes the order of angles: each is divided by the
largest norm and, where norms differ, gets one more coordinate that fills it up
to length one (0 for queries).

Each of ``TABLES`` tables rotates a vector by three rounds of random signs and
a fast Hadamard transform and files it under the nearest signed axis (the
largest coordinate in size, and its sign).  A query probes the ``PROBES`` axes
nearest to it in every table.  All vectors that share a probed bucket are
candidates, scored exactly in double precision on the original vectors.

Equal vectors are one entry with its smallest ids (the list is cut to ``k + 1``,
which loses nothing in a list of ``k``).  Buckets are dealt over cells of at
most about ``CELL`` entries and ``CELL`` queries, so no task gathers a large
bucket.  The result of a cell is the best ``k + 1`` of each query.  Queries
whose buckets hold fewer than ``k`` candidates, though more exist, are compared
with all entries in blocks.

Measured recall of the 20 nearest against brute force is in the README (above
0.9); the tests check it.

Edge cases: null vectors, vectors of another length than most, zero vectors and
those with null or non-finite components take no part; rows repeated with one
id and vector count once; ties go to the smaller id; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TABLES = 8
PROBES = 14
ROUNDS = 3
CELL = 4_096
SEED = 20_240_229


def hadamard(y: np.ndarray) -> np.ndarray:
    """Normalized Walsh-Hadamard transform of the rows (a power of two wide)."""
    n, h = y.shape[1], 1
    while h < n:
        y = y.reshape(len(y), -1, 2, h)
        y = np.concatenate([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(y), n)
        h *= 2
    return y / np.sqrt(n)


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    signs = np.random.default_rng([SEED, table]).choice([-1.0, 1.0], size=(ROUNDS, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


def on_sphere(x: np.ndarray, largest: float, fill: bool, query: bool) -> np.ndarray:
    """Unit vectors of a power-of-two width."""
    if query:
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        extra = np.zeros(len(x))
    else:
        unit = x / largest
        extra = np.sqrt(np.maximum(0.0, 1.0 - (unit * unit).sum(axis=1)))
    if fill:
        unit = np.concatenate([unit, extra[:, None]], axis=1)
    width = 1 << (unit.shape[1] - 1).bit_length()
    return np.pad(unit, ((0, 0), (0, width - unit.shape[1])))


def axes(y: np.ndarray, probes: int) -> np.ndarray:
    """The nearest signed axes of each row, nearest first: 2 * axis + (sign < 0)."""
    z = np.concatenate([y, -y], axis=1)
    order = np.argsort(-z, axis=1, kind="stable")[:, :probes]
    n = y.shape[1]
    return np.where(order < n, 2 * order, 2 * (order - n) + 1)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def _buckets(vector: Column, dim: int, largest: float, fill: bool, query: bool, tables: int, probes: int) -> Column:
    """array<int>: bucket codes table * 2^20 + axis code."""

    def run(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.list_(pa.int32()))
        x = on_sphere(_matrix(column, dim), largest, fill, query)
        codes = np.concatenate([(t << 20) + axes(rotate(x, t), probes if query else 1) for t in range(tables)], axis=1)
        return pa.array(codes.astype(np.int32).tolist(), pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(vector)


def _best(dim: int, k: int):
    """Cell of queries and entries -> the best entries of each query."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_e, out_s = [], [], []
        if left.num_rows and right.num_rows:
            q = _matrix(left.column("qv").combine_chunks(), dim)
            x = _matrix(right.column("v").combine_chunks(), dim)
            qid, eid = left.column("q").to_numpy(), right.column("e").to_numpy()
            low = right.column("low").to_numpy()
            for a in range(0, len(q), 256):
                s = q[a:a + 256] @ x.T
                keep = min(k, s.shape[1])
                cut = -np.partition(-s, keep - 1, axis=1)[:, keep - 1]
                for i in range(len(s)):
                    at = np.flatnonzero(s[i] >= cut[i])
                    at = at[np.lexsort((low[at], -s[i][at]))][:keep]
                    out_q.append(np.full(len(at), qid[a + i]))
                    out_e.append(eid[at])
                    out_s.append(s[i][at])
        cat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
        return pa.table({"q": cat(out_q, pa.int64()), "e": cat(out_e, pa.int64()), "s": cat(out_s, pa.float64())})

    return run


def _cells(queries: DataFrame, entries: DataFrame, dim: int, k: int) -> DataFrame:
    """queries(code, q, qv) and entries(code, e, low, v) -> (q, e, s), dealt so
    that a cell stays near CELL on either side."""
    nq = queries.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("pq"))
    ne = entries.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("pe"))
    # a row per bucket: tables times axes, whatever the data
    parts = F.broadcast(nq.join(ne, "code").checkpoint())
    a = (queries.join(parts, "code").withColumn("qs", F.pmod(F.xxhash64("q"), F.col("pq").cast("long")).cast("int"))
         .withColumn("es", F.explode(F.sequence(F.lit(0), F.col("pe") - 1))).select("code", "qs", "es", "q", "qv"))
    b = (entries.join(parts, "code").withColumn("es", F.pmod(F.xxhash64("e"), F.col("pe").cast("long")).cast("int"))
         .withColumn("qs", F.explode(F.sequence(F.lit(0), F.col("pq") - 1))).select("code", "qs", "es", "e", "low", "v"))
    return a.groupBy("code", "qs", "es").cogroup(b.groupBy("code", "qs", "es")).applyInArrow(_best(dim, k + 1), "q long, e long, s double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
            tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each row
    where ``is_query`` holds, among all other rows."""
    v = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), v.alias("v"), is_query.alias("query"))
            .filter("id is not null and v is not null").filter(F.coalesce(finite, F.lit(False)))
            .filter(F.exists("v", lambda x: x != 0)))
    dims = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dim = dims.dim
    rows = rows.filter(F.size("v") == dim)
    # one entry per distinct vector; its id is a position in the files written here
    entries = _distinct(rows, k).checkpoint().withColumn("e", F.monotonically_increasing_id())
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    spread = entries.agg(F.min(norm).alias("lo"), F.max(norm).alias("hi")).first()
    fill = spread.lo < spread.hi * (1 - 1e-6)
    largest = spread.hi

    queries = rows.filter("query").select(F.col("id").alias("q"), F.col("v").alias("qv")).dropDuplicates(["q"]).checkpoint()
    filed = entries.select("e", "low", "v", F.explode(_buckets(F.col("v"), dim, largest, fill, False, tables, 1)).alias("code"))
    asked = queries.select("q", "qv", F.explode(_buckets(F.col("qv"), dim, largest, fill, True, tables, probes)).alias("code"))
    found = _cells(asked, filed, dim, k).checkpoint()
    ids = entries.select("e", "ids")

    def ranked(scored: DataFrame) -> DataFrame:
        # the best k + 1 entries of a query hold its best k other rows
        top = (scored.groupBy("q", "e").agg(F.max("s").alias("s")).join(ids, "e")
               .select("q", F.explode(F.transform("ids", lambda i: F.struct((-F.col("s")).alias("neg"), i.alias("id")))).alias("c"))
               .filter(F.col("c.id") != F.col("q")))
        best = F.slice(F.array_sort(F.collect_list("c")), 1, k)
        return top.groupBy("q").agg(best.alias("best"))

    first = ranked(found).checkpoint()
    total = rows.select("id").distinct().count()
    short = queries.join(first.filter(F.size("best") >= min(k, max(0, total - 1))).select("q"), "q", "left_anti")
    if not short.isEmpty():
        one = F.lit(0).alias("code")
        rest = ranked(_cells(short.select(one, "q", "qv"), entries.select(one, "e", "low", "v"), dim, k))
        first = first.join(short.select("q"), "q", "left_anti").unionByName(rest)
    return (first.select(F.col("q").alias("query_id"), F.posexplode("best").alias("at", "c"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("c.id").alias("vec_id"), (-F.col("c.neg")).alias("score")))


def _distinct(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids, low): each distinct vector with its k + 1 smallest ids, kept
    short in two steps so that a vector's rows never meet in one group."""
    salted = rows.select("v", "id", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).distinct()
    part = Window.partitionBy("v", "salt").orderBy("id")
    least = salted.withColumn("n", F.row_number().over(part)).filter(F.col("n") <= k + 1)
    return (least.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"))
            .withColumn("low", F.col("ids")[0]))
