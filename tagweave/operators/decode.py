"""Linear-chain decoding and scoring.

``sequence_nll`` runs in the JVM: the forward recursion folds over the
emission rows with a fixed-size accumulator (one log-score per tag), so it
is linear in sentence length.  ``viterbi_decode`` needs back-pointers for
every position; growing arrays inside ``aggregate`` are copied on every step
(quadratic), so the recursion runs as one Arrow-batched UDF with NumPy
(O(T * K^2) per sentence, no per-row Python object conversion)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _lit_matrix(m: Sequence[Sequence[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in m])


def _lit_vector(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def log_sum_exp_online(arr: Column) -> Column:
    """log(sum(exp(x))) in one pass with a running (max, scaled sum) pair;
    the lambda only reads lambda variables."""
    init = F.struct(F.lit(float("-inf")).alias("m"), F.lit(0.0).alias("s"))

    def step(acc: Column, x: Column) -> Column:
        m2 = F.greatest(acc["m"], x)
        s2 = F.when(acc["m"] == F.lit(float("-inf")), F.lit(0.0)).otherwise(acc["s"] * F.exp(acc["m"] - m2)) \
            + F.exp(x - m2)
        return F.struct(m2.alias("m"), s2.alias("s"))

    return F.aggregate(arr, init, step, lambda acc: acc["m"] + F.log(acc["s"]))


def log_partition(emissions: Column, transitions: Sequence[Sequence[float]], start: Sequence[float],
                  end: Sequence[float]) -> Column:
    """log sum over all tag paths of exp(path score), by the forward
    recursion, folded in-row with a K-sized accumulator (O(T * K^2))."""
    trans = _lit_matrix(transitions)
    st = _lit_vector(start)
    en = _lit_vector(end)
    first = F.zip_with(st, F.get(emissions, 0), lambda s_, e: s_ + e)
    rest = F.slice(emissions, 2, F.greatest(F.size(emissions) - 1, F.lit(0)))

    def step(alpha: Column, e: Column) -> Column:
        # new[j] = e[j] + logsumexp_i(alpha[i] + trans[i][j])
        return F.transform(e, lambda ej, j: ej + log_sum_exp_online(
            F.transform(alpha, lambda a, i: a + F.get(F.get(trans, i), j))))

    alpha = F.aggregate(rest, first, step)
    return log_sum_exp_online(F.zip_with(alpha, en, lambda a, b: a + b))


def path_score(emissions: Column, labels: Column, transitions: Sequence[Sequence[float]],
               start: Sequence[float], end: Sequence[float]) -> Column:
    """Score of the given tag path: start + emissions + transitions + end."""
    trans = _lit_matrix(transitions)
    st = _lit_vector(start)
    en = _lit_vector(end)
    emit = F.aggregate(F.zip_with(emissions, labels, lambda e, y: F.get(e, y)), F.lit(0.0), lambda a, x: a + x)
    prev = F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0)))
    nxt = F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0)))
    tr = F.aggregate(F.zip_with(prev, nxt, lambda a, b: F.get(F.get(trans, a), b)), F.lit(0.0), lambda a, x: a + x)
    return F.get(st, F.get(labels, 0)) + emit + tr + F.get(en, F.element_at(labels, -1))


def sequence_nll(df: DataFrame, emissions_col: str, labels_col: str, transitions, start, end,
                 group_cols: Sequence[str] = ()) -> DataFrame:
    """Negative log-likelihood of the label paths (log-partition minus path
    score), summed over the rows of each group (the batch)."""
    nll = log_partition(F.col(emissions_col), transitions, start, end) - \
        path_score(F.col(emissions_col), F.col(labels_col), transitions, start, end)
    return df.groupBy(*group_cols).agg(F.sum(nll).alias("nll"), F.count(F.lit(1)).alias("n_sequences"))


# --------------------------------------------------------------------------
# Viterbi (Arrow UDF)
# --------------------------------------------------------------------------
def _viterbi_one(em: np.ndarray, trans: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Reference single-sequence Viterbi (used by tests)."""
    return _viterbi_batch([em], trans, start, end)[0]


def _viterbi_batch(ems: list[np.ndarray], trans: np.ndarray, start: np.ndarray, end: np.ndarray
                   ) -> list[np.ndarray]:
    """Viterbi for many sequences at once.  Sequences are sorted by length
    (longest first); at step t only the prefix of sequences longer than t is
    advanced, so the work is sum(T_i) * K^2 in vectorized steps of
    max(T_i)."""
    n = len(ems)
    if n == 0:
        return []
    K = len(start)
    lens = np.array([e.shape[0] for e in ems])
    order = np.argsort(-lens, kind="stable")
    T_max = int(lens[order[0]])
    E = np.zeros((n, T_max, K))
    for r, i in enumerate(order):
        E[r, :lens[i]] = ems[i]
    slen = lens[order]
    score = start[None, :] + E[:, 0, :]
    back = np.zeros((n, T_max, K), dtype=np.int32)
    final = np.empty((n, K))
    done = slen == 1
    final[done] = score[done] + end
    for t in range(1, T_max):
        m = int(np.searchsorted(-slen, -t, side="left"))      # rows with length > t
        cand = score[:m, :, None] + trans[None, :, :]           # m x K(from) x K(to)
        bp = np.argmax(cand, axis=1)
        back[:m, t] = bp
        score = np.take_along_axis(cand, bp[:, None, :], axis=1)[:, 0, :] + E[:m, t, :]
        ending = slen[:m] == t + 1
        final[:m][ending] = score[ending] + end
    # trace all rows back together: a row joins at its own last step
    state = np.argmax(final, axis=1)
    path = np.zeros((n, T_max), dtype=np.int32)
    for t in range(T_max - 1, -1, -1):
        m = int(np.searchsorted(-slen, -t, side="left"))
        path[:m, t] = state[:m]
        if t:
            state[:m] = back[np.arange(m), t, state[:m]]
    out: list[np.ndarray] = [None] * n  # type: ignore[list-item]
    for r in range(n):
        out[order[r]] = path[r, :int(slen[r])]
    return out


def viterbi_paths(lengths: Sequence[int], emissions, trans: np.ndarray, start: np.ndarray, end: np.ndarray,
                  max_cells: int = 4_000_000) -> list[np.ndarray]:
    """Best paths of many sequences; ``emissions(i)`` makes the T x K scores of
    the i-th.  Sequences are taken in chunks, so that a padded block and its
    back-pointers stay within ``max_cells``; put like lengths together."""
    out: list[np.ndarray] = []
    i = 0
    while i < len(lengths):
        j, longest = i, 0
        while j < len(lengths) and (j == i or max(longest, lengths[j]) * (j - i + 1) * len(start) <= max_cells):
            longest = max(longest, lengths[j])
            j += 1
        out += _viterbi_batch([emissions(k) for k in range(i, j)], trans, start, end)
        i = j
    return out


FEW_SEQUENCES = 32


def viterbi_rows(size: np.ndarray, place: np.ndarray, scores: np.ndarray, trans: np.ndarray, start: np.ndarray, end: np.ndarray,
                 max_cells: int = 1_000_000) -> np.ndarray:
    """Best paths of many sequences, one after the other: ``size`` has their
    lengths, ``place`` the row of ``scores`` (V x K) for every position.  The
    scores of a chunk of sequences stay within ``max_cells`` (one sequence at
    least); tags are traced from them without back-pointers."""
    K, out, first = len(start), np.zeros(len(place), dtype=np.int32), np.cumsum(size) - size
    some = np.flatnonzero(size)
    order = some[np.argsort(-size[some], kind="stable")]
    into = np.ascontiguousarray(trans.T)                        # of a tag: the scores of all tags before it
    i = 0
    while i < len(order):
        T = int(size[order[i]])
        rows = order[i:i + max(1, max_cells // (T * K))]
        i += len(rows)
        at, lens = first[rows], size[rows]
        longer = np.append(np.searchsorted(-lens, -np.arange(T), side="left"), 0)       # sequences with length > t
        final = np.empty((K, len(rows)))
        score = scores[place[at]].T + start[:, None]
        steps = [score]
        final[:, longer[1]:] = score[:, longer[1]:] + end[:, None]
        for t in range(1, T):
            m, go_on = int(longer[t]), int(longer[t + 1])
            if m <= FEW_SEQUENCES:                              # one step over all pairs of tags costs fewer calls
                best = (score[:, None, :m] + trans[:, :, None]).max(axis=0)
            else:
                best = score[0, :m] + trans[0][:, None]
                cand = np.empty_like(best)
                for p in range(1, K):
                    np.add(score[p, :m], trans[p][:, None], out=cand)
                    np.maximum(best, cand, out=best)
            best += scores[place[at[:m] + t]].T
            score = best
            steps.append(score)
            final[:, go_on:m] = score[:, go_on:] + end[:, None]
        state = final.argmax(axis=0)
        for t in range(T - 1, -1, -1):
            m = int(longer[t])
            out[at[:m] + t] = state[:m]
            if t:
                state[:m] = (steps[t - 1][:, :m] + into[state[:m]].T).argmax(axis=0)
    return out


# --------------------------------------------------------------------------
# one long sequence in blocks: max-plus products
# --------------------------------------------------------------------------
def block_product(em: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """K x K: the best score through a block from its first token's tag (rows)
    to its last token's tag (columns), its own emissions included.  Products of
    neighbouring blocks combine by max-plus, in any grouping."""
    k = em.shape[1]
    score = np.where(np.eye(k, dtype=bool), em[0][None, :], -np.inf)
    for e in em[1:]:
        score = (score[:, :, None] + trans[None]).max(axis=1) + e
    return score


def block_forward(em: np.ndarray, trans: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores at a block's last token and the back-pointers inside it, from the
    scores ``entry`` that its first token's tags have without its emission."""
    score = entry + em[0]
    back = np.zeros(em.shape, dtype=np.int32)
    for t in range(1, len(em)):
        cand = score[:, None] + trans
        back[t] = cand.argmax(axis=0)
        score = cand.max(axis=0) + em[t]
    return score, back


def block_firsts(back: np.ndarray) -> np.ndarray:
    """For every tag of the last token, the first token's tag on its path."""
    at = np.arange(back.shape[1])
    for t in range(len(back) - 1, 0, -1):
        at = back[t, at]
    return at


def block_trace(back: np.ndarray, last: int) -> np.ndarray:
    path = np.empty(len(back), dtype=np.int32)
    for t in range(len(back) - 1, -1, -1):
        path[t] = last
        last = back[t, last]
    return path


def _make_viterbi_udf(transitions, start, end, max_batch_cells: int = 4_000_000):
    trans = np.asarray(transitions, dtype=np.float64)
    st = np.asarray(start, dtype=np.float64)
    en = np.asarray(end, dtype=np.float64)
    K = len(st)

    def run(em_col: pa.Array) -> pa.Array:
        if isinstance(em_col, pa.ChunkedArray):
            em_col = em_col.combine_chunks()
        outer_off = np.asarray(em_col.offsets)
        inner = em_col.values                       # list<double> per token
        inner_off = np.asarray(inner.offsets)
        flat = np.asarray(inner.values.fill_null(0.0), dtype=np.float64) if len(inner.values) else np.zeros(0)
        valid = np.asarray(em_col.is_valid().to_numpy(zero_copy_only=False), dtype=bool)
        rows = [r for r in range(len(em_col)) if valid[r] and outer_off[r + 1] > outer_off[r]]
        # rows of like length together, so a block is padded little
        rows.sort(key=lambda r: int(outer_off[r + 1] - outer_off[r]))
        ems = []
        for r in rows:
            a, b = int(outer_off[r]), int(outer_off[r + 1])
            ems.append(flat[int(inner_off[a]):int(inner_off[b])].reshape(b - a, K))
        paths = dict(zip(rows, viterbi_paths([e.shape[0] for e in ems], lambda i: ems[i], trans, st, en, max_batch_cells)))
        offs, vals = [0], []
        for r in range(len(em_col)):
            p = paths.get(r)
            if p is not None:
                vals.append(p)
            offs.append(offs[-1] + (0 if p is None else len(p)))
        v = np.concatenate(vals) if vals else np.zeros(0, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(np.asarray(offs, dtype=np.int32)), pa.array(v, pa.int32()),
                                        mask=pa.array(~valid) if em_col.null_count else None)

    return F.arrow_udf(run, T.ArrayType(T.IntegerType()))


def viterbi_decode(df: DataFrame, emissions_col: str, transitions, start, end, out_col: str = "path") -> DataFrame:
    """Best tag path per row given per-token scores (``array<array<double>>``,
    T x K), a K x K transition matrix, and start/end scores."""
    udf = _make_viterbi_udf(transitions, start, end)
    return df.withColumn(out_col, udf(F.col(emissions_col)))
