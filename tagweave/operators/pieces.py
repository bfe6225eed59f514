"""Sub-word pieces: expansion, label alignment, padding into batches,
first-piece gathering, and mapping predicted pieces back to words.

In-row work uses nested higher-order functions over the per-word piece
arrays; lambda bodies only read lambda variables, so each row costs time
linear in its length."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave import constants as C
from tagweave.functions.arrays import row_slices
from tagweave.operators.vocabulary import VocabularySplitter, _ragged  # noqa: F401  (a splitter for expand_pieces)

SLICE_PIECES = 1 << 19
CLS, SEP = "[CLS]", "[SEP]"
CONT = "##"


class FixedWidthSplitter:
    """Word -> pieces of at most ``width`` characters; continuation pieces
    carry the ``##`` prefix; an empty word gives one empty piece.

    Besides the per-word form (``__call__``) it has a whole-sentence form:
    the words are joined with a sentinel that marks word starts and one JVM
    regex pass cuts every piece of the sentence, so no per-word lambda runs."""

    MARK = "\u0001"

    def __init__(self, width: int):
        self.width = int(width)

    def __call__(self, word: Column) -> Column:
        w = self.width
        n = F.greatest(F.ceil(F.length(word) / F.lit(w)).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), n),
                           lambda i: F.when(i == 0, F.substring(word, 1, w))
                           .otherwise(F.concat(F.lit(CONT), F.substring(word, i * w + 1, w))))

    def counts(self, tokens: Column) -> Column:
        """Pieces per word."""
        return F.transform(tokens, lambda t: F.greatest(F.ceil(F.length(t) / F.lit(self.width)).cast("int"),
                                                        F.lit(1)))

    def flat(self, tokens: Column) -> tuple[Column, Column]:
        """(pieces, word-start flags) of a whole sentence."""
        m, w = self.MARK, self.width
        joined = F.concat(F.lit(m), F.array_join(tokens, m))
        pat = F.lit(f"{m}[^{m}]{{0,{w}}}|[^{m}]{{1,{w}}}")
        # a word that holds the sentinel itself is cut word by word
        plain = ~F.exists(tokens, lambda t: F.contains(t, F.lit(m)))
        raw = F.when(F.size(tokens) == 0, F.array().cast("array<string>")) \
               .otherwise(F.regexp_extract_all(joined, pat, 0))
        pieces = F.transform(raw, lambda p: F.when(p.startswith(m), F.substring(p, 2, w))
                             .otherwise(F.concat(F.lit(CONT), p)))
        starts = F.transform(raw, lambda p: F.when(p.startswith(m), F.lit(1)).otherwise(F.lit(0)))
        words = F.transform(tokens, lambda t: self(t))
        firsts = F.transform(words, lambda ps: F.transform(ps, lambda p, i: (i == 0).cast("int")))
        return F.when(plain, pieces).otherwise(F.flatten(words)), F.when(plain, starts).otherwise(F.flatten(firsts))


def fixed_width_splitter(width: int) -> FixedWidthSplitter:
    return FixedWidthSplitter(width)


def _label_map(labels: Sequence[str]) -> Column:
    kv = []
    for i, t in enumerate(labels):
        kv += [F.lit(t), F.lit(i)]
    return F.create_map(*kv)


def expand_pieces(sent_df: DataFrame, splitter: Callable[[Column], Column], tokens_col: str = "tokens",
                  tags_col: str = "tags", labels: Sequence[str] = tuple(C.LABELS), cls: str = CLS,
                  sep: str = SEP) -> DataFrame:
    """Per sentence: ``pieces`` (CLS + word pieces + SEP), ``token_starts``
    (1 on a word's first piece, 0 elsewhere, 0 on CLS/SEP),
    ``word_piece_counts`` (pieces per word) and word-axis ``labels`` (tag
    ids).  A splitter with a whole-sentence form is used without per-word
    lambdas; any other ``Column -> array<string>`` splitter runs per word.  A
    ``VocabularySplitter`` also gives ``piece_ids``, the vocabulary's ids."""
    toks = F.col(tokens_col)
    ids: list[Column] = []
    if hasattr(splitter, "attach"):
        sent_df = splitter.attach(sent_df, tokens_col, "__split")
        flat, starts, counts = (F.col(f"__split.{c}") for c in ("pieces", "starts", "counts"))
        ends = (F.array(F.lit(splitter.special_ids.get(p, 0))) for p in (cls, sep))
        ids = [F.concat(next(ends), F.col("__split.ids"), next(ends)).alias("piece_ids")]
    elif hasattr(splitter, "flat"):
        flat, starts = splitter.flat(toks)
        counts = splitter.counts(toks)
    else:
        per_word = F.transform(toks, lambda w: splitter(w))
        flat = F.flatten(per_word)
        starts = F.flatten(F.transform(per_word, lambda ps: F.transform(ps, lambda p, i: F.when(i == 0, F.lit(1))
                                                                              .otherwise(F.lit(0)))))
        counts = F.transform(per_word, lambda ps: F.size(ps))
    lab = _label_map(labels)
    return sent_df.select(
        *[F.col(f"`{c}`") for c in sent_df.columns if c != "__split"],
        F.concat(F.array(F.lit(cls)), flat, F.array(F.lit(sep))).alias("pieces"),
        F.concat(F.array(F.lit(0)), starts, F.array(F.lit(0))).alias("token_starts"),
        counts.alias("word_piece_counts"),
        F.transform(F.col(tags_col), lambda t: F.coalesce(F.try_element_at(lab, t), F.raise_error(
            F.concat(F.lit("unknown tag: "), F.coalesce(t, F.lit("null")))).cast("int"))).alias("labels"),
        *ids,
    )


def piece_ids(pieces: Column, cls: str = CLS, sep: str = SEP) -> Column:
    """Deterministic ids for pieces (101 = CLS, 102 = SEP, 1000 + length
    otherwise); a stand-in for a vocabulary lookup that SQL can repeat."""
    return F.transform(pieces, lambda p: F.when(p == cls, F.lit(101)).when(p == sep, F.lit(102))
                       .otherwise(F.lit(1000) + F.length(p)))


def repeat_per_word(values: Column, counts: Column) -> Column:
    """Word-axis values repeated over each word's pieces (piece axis)."""
    return F.flatten(F.zip_with(values, counts, lambda v, c: F.array_repeat(v, c)))


def align_piece_labels(sent_df: DataFrame, label_all_tokens: bool = False, max_len: int = 512,
                       counts_col: str = "word_piece_counts", labels_col: str = "labels",
                       starts_col: str = "token_starts", b_to_i: dict[int, int] | None = None,
                       ignore_index: int = C.IGNORE_INDEX_ALIGNED, out_col: str = "aligned_labels") -> DataFrame:
    """Piece-axis labels: special pieces get ``ignore_index``; a word's first
    piece gets its label; later pieces get ``ignore_index``, or the label
    mapped B-to-I when ``label_all_tokens``.  Pieces are truncated to
    ``max_len`` including the two special pieces."""
    if b_to_i is None:
        b_to_i = {}
        for i, t in enumerate(C.LABELS):
            inside = t.replace("B-", "I-") if t.startswith("B-") else None
            b_to_i[i] = C.LABELS.index(inside) if inside in C.LABELS else i
    kv = []
    for k, v in b_to_i.items():
        kv += [F.lit(int(k)), F.lit(int(v))]
    bmap = F.create_map(*kv)
    ign = F.lit(int(ignore_index))

    def rest(lab: Column) -> Column:
        return F.coalesce(F.element_at(bmap, lab), lab) if label_all_tokens else ign

    per_piece = repeat_per_word(F.col(labels_col), F.col(counts_col))
    starts = F.slice(F.col(starts_col), 2, F.greatest(F.size(starts_col) - 2, F.lit(0)))
    aligned = F.zip_with(per_piece, starts, lambda lab, st: F.when(st == 1, lab).otherwise(rest(lab)))
    body = F.slice(aligned, 1, max(int(max_len) - 2, 0))
    return sent_df.withColumn(out_col, F.concat(F.array(ign), body, F.array(ign)))


def pad_batches(enc_df: DataFrame, batch_col: str = "batch_id", ids_col: str = "input_ids",
                starts_col: str = "token_starts", labels_col: str = "labels", pad_id: int = 0,
                max_len: int = 512, multiple_of: int | None = None, label_pad: int = C.IGNORE_INDEX_BASELINE
                ) -> DataFrame:
    """Right-pad each row to the longest row of its batch (ids with
    ``pad_id``, starts with 0, word-axis labels with ``label_pad``), mask =
    id != pad; every array is cut to ``max_len`` first, and labels to the words
    whose first piece is kept, so starts and labels stay in step.
    ``multiple_of`` rounds the piece width up (not beyond ``max_len``).  A batch is a handful of rows, so the window
    per batch is small."""
    w = Window.partitionBy(batch_col)
    n_kept = F.aggregate(F.col(starts_col), F.lit(0), lambda a, x: a + x)
    enc_df = (enc_df.withColumn(ids_col, F.slice(ids_col, 1, max_len)).withColumn(starts_col, F.slice(starts_col, 1, max_len)))
    enc_df = enc_df.withColumn("__kept", n_kept)
    enc_df = enc_df.withColumn(labels_col, F.slice(F.col(labels_col), F.lit(1), F.col("__kept"))).drop("__kept")
    width = F.max(F.size(ids_col)).over(w)
    lwidth = F.max(F.size(labels_col)).over(w)
    if multiple_of:
        m = int(multiple_of)
        width = F.least(F.ceil(width / m) * m, F.lit(max_len))
    d = enc_df.withColumn("__w", width.cast("int")).withColumn("__lw", lwidth.cast("int"))

    def pad(c: str, val: int, wcol: str) -> Column:
        return F.concat(F.col(c), F.array_repeat(F.lit(val), F.col(wcol) - F.size(c)))

    ids = pad(ids_col, pad_id, "__w")
    d = d.withColumn("__ids", ids)
    return (d.withColumn(ids_col, F.col("__ids"))
            .withColumn("attention_mask", F.transform("__ids", lambda x: F.when(x != F.lit(pad_id), 1).otherwise(0)))
            .withColumn(starts_col, pad(starts_col, 0, "__w"))
            .withColumn(labels_col, pad(labels_col, label_pad, "__lw"))
            .withColumn("width", F.col("__w"))
            .drop("__ids", "__w", "__lw"))


def gather_first_pieces(df: DataFrame, values_col: str, starts_col: str = "token_starts",
                        out_col: str = "first_values") -> DataFrame:
    """Keep per-piece values only where ``token_starts`` = 1 (one per word)."""
    z = F.arrays_zip(F.col(values_col).alias("v"), F.col(starts_col).alias("s"))
    return df.withColumn(out_col, F.transform(F.filter(z, lambda x: x["s"] == 1), lambda x: x["v"]))


def _same(piece: str, part: str) -> bool:
    """Equal texts, or equal but for case and accents (as an uncased
    vocabulary writes them)."""
    if piece == part:
        return True
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c))
    return plain(piece) == plain(part)


def align_unknown(words: list[str], pieces: list[str | None]) -> list[int]:
    """For every word the place of its first piece, or -1.

    ``pieces`` are the texts of a sentence's pieces in order, ``None`` for an
    unknown piece.  Two pointers go through both lists: a known piece covers its
    own text, an unknown piece covers the rest of the word it stands in.  Where
    the following texts then disagree, the unknown piece covers less of its
    word (several unknown pieces may stand for one word).  Words past the last
    piece, and empty words, have none."""
    first = [-1] * len(words)
    choices: list[tuple[int, int, int, int, list[int]]] = []     # an unknown piece, where it stands, what it covered
    seen: set[tuple[int, int, int]] = set()                      # a state that came up before leads nowhere
    place = word = offset = 0
    while True:
        while word < len(words) and offset == len(words[word]):
            word, offset = word + 1, 0
        if place == len(pieces):
            return first
        state = place, word, offset
        if word < len(words) and state not in seen:
            seen.add(state)
            if offset == 0:
                first[word] = place
            left, piece = len(words[word]) - offset, pieces[place]
            if piece is None:
                choices.append((*state, left, list(first)))
                place, word, offset = place + 1, word + 1, 0
                continue
            if len(piece) <= left and _same(piece, words[word][offset:offset + len(piece)]):
                place, offset = place + 1, offset + len(piece)
                continue
        while choices and choices[-1][3] == 1:
            choices.pop()
        if not choices:
            return _by_length(words, pieces)
        at, word, start, cover, kept = choices.pop()
        choices.append((at, word, start, cover - 1, kept))
        place, offset, first = at + 1, start + cover - 1, list(kept)


def _by_length(words: list[str], pieces: list[str | None]) -> list[int]:
    """Texts that disagree: the pieces are laid end to end on the words by
    their lengths; an unknown piece covers the rest of its word."""
    first, word, offset = [-1] * len(words), 0, 0
    for i, piece in enumerate(pieces):
        while word < len(words) and offset >= len(words[word]):
            word, offset = word + 1, offset - len(words[word])
        if word == len(words):
            break
        if offset == 0:
            first[word] = i
        offset = len(words[word]) if piece is None else offset + len(piece)
    return first


def _bytes(texts: pa.Array, which: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """The texts' bytes end to end, each without its first ``skip``."""
    at = np.frombuffer(texts.buffers()[1], dtype="<i8" if pa.types.is_large_string(texts.type) else "<i4")
    at = at[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    return raw[_ragged(at[which] + skip, at[which + 1] - at[which] - skip)]


def _by_heads(p: pa.Array, kept: np.ndarray, row_of: np.ndarray, cont: np.ndarray, unknown: np.ndarray, prefix: int,
              w: pa.Array, words: np.ndarray, w_row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in which every word that has pieces is one unknown piece or spelled
    in full, all at once: (places in ``words``, their first pieces, rows left
    out).  There ``align_unknown`` never has to choose: a piece without the
    prefix begins the next word."""
    head = ~cont[kept]
    heads = np.bincount(row_of[head], minlength=n_rows)
    bad = heads > np.bincount(w_row, minlength=n_rows)
    first_piece = np.flatnonzero(np.diff(row_of, prepend=-1))
    bad[row_of[first_piece][~head[first_piece]]] = True
    ok = ~bad[row_of]
    kept, row_of, head = kept[ok], row_of[ok], head[ok]
    heads = np.where(bad, 0, heads)
    word_at = np.searchsorted(w_row, np.arange(n_rows))           # a row's first word
    before = np.cumsum(heads) - heads
    word = word_at[row_of] + np.cumsum(head) - 1 - before[row_of]  # each piece's word
    strange = unknown[kept]
    pieces = np.bincount(word, minlength=len(words))
    bad[row_of[strange & (pieces[word] > 1)]] = True               # an unknown piece beside others
    skip = np.where(cont[kept], prefix, 0)
    size = pc.binary_length(p).to_numpy(zero_copy_only=False).astype(np.int64)[kept] - skip
    w_size = pc.binary_length(w).to_numpy(zero_copy_only=False).astype(np.int64)[words]
    spelled = np.bincount(word, weights=np.where(strange, 0, size), minlength=len(words)).astype(np.int64)
    known = np.zeros(len(words), dtype=bool)
    known[word[~strange]] = True
    bad[w_row[known & (spelled != w_size)]] = True
    mine, theirs = ~strange & ~bad[row_of], np.flatnonzero(known & ~bad[w_row])
    differ = np.flatnonzero(_bytes(p, kept[mine], skip[mine]) != _bytes(w, words[theirs], np.zeros(len(theirs), dtype=np.int64)))
    bad[w_row[theirs[np.searchsorted(np.cumsum(w_size[theirs]), differ, side="right")]]] = True
    good = head & ~bad[row_of]
    return word[good], kept[good], bad


def _word_tags_udf(cont_prefix: str, specials: Sequence[str], unk: str, with_starts: bool):
    """pieces, their tags, (their start flags,) words -> a tag for every word."""
    plen, bare = len(cont_prefix), len(cont_prefix.encode())

    def parts(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
        at = np.asarray(col.offsets, dtype=np.int64)
        return col.values.slice(int(at[0]), int(at[-1] - at[0])), at - at[0]

    def tagged(pieces: pa.Array, tags: pa.Array, starts: pa.Array, words: pa.Array) -> pa.Array:
        (p, p_at), (t, _), (w, w_at) = parts(pieces), parts(tags), parts(words)
        p, w = pc.fill_null(p, ""), pc.fill_null(w, "")
        # what a piece is follows from its text: looked at once for each distinct one
        coded = p.dictionary_encode()
        code, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        prefixed = pc.starts_with(distinct, cont_prefix).to_numpy(zero_copy_only=False).astype(bool)
        chars = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
        cont = prefixed[code]
        if with_starts:
            cont &= parts(starts)[0].to_numpy(zero_copy_only=False) == 0
        unknown = pc.equal(distinct, unk).to_numpy(zero_copy_only=False).astype(bool)[code]
        drop = pc.is_in(distinct, pa.array(list(specials), pa.string())).to_numpy(zero_copy_only=False).astype(bool)[code]
        size = chars[code] - np.where(cont, plen, 0)
        keep = np.flatnonzero(~drop & (size > 0))
        n_rows = len(p_at) - 1
        row_of = np.repeat(np.arange(n_rows), np.diff(p_at))[keep]
        w_size = pc.utf8_length(w).to_numpy(zero_copy_only=False).astype(np.int64)
        w_row = np.repeat(np.arange(len(w_at) - 1), np.diff(w_at))
        # without unknown pieces both sides are laid end to end: a word takes the piece at its offset
        base = np.int64(1) << 40
        p_off = np.cumsum(size[keep]) - size[keep]
        kept_at = np.concatenate([[0], np.cumsum(np.bincount(row_of, minlength=n_rows))]).astype(np.int64)
        shift = lambda off, at, rows: off - (off[np.minimum(at[:-1], max(len(off) - 1, 0))])[rows] if len(off) else off
        p_key = row_of * base + shift(p_off, kept_at, row_of)
        w_off = np.cumsum(w_size) - w_size
        w_key = w_row * base + shift(w_off, w_at, w_row)
        at = np.searchsorted(p_key, w_key)
        hit = (at < len(p_key)) & (w_size > 0)
        hit[hit] = p_key[at[hit]] == w_key[hit]
        first = np.where(hit, keep[np.minimum(at, max(len(keep) - 1, 0))] if len(keep) else 0, -1)
        strange = np.zeros(n_rows, dtype=bool)
        strange[row_of[unknown[keep]]] = True
        if strange.any():
            mine, full = strange[row_of], np.flatnonzero(strange[w_row] & (w_size > 0))
            place, piece, left = _by_heads(p, keep[mine], row_of[mine], cont, unknown, bare, w, full, w_row[full], n_rows)
            first[strange[w_row]] = -1
            first[full[place]] = piece
            strange &= left
        for r in np.flatnonzero(strange).tolist():
            mine = keep[kept_at[r]:kept_at[r + 1]]
            texts = p.take(pa.array(mine)).to_pylist()
            texts = [None if unknown[i] else x[plen:] if cont[i] else x for i, x in zip(mine.tolist(), texts)]
            a, b = int(w_at[r]), int(w_at[r + 1])
            found = np.array(align_unknown(w.slice(a, b - a).to_pylist(), texts), dtype=np.int64)
            first[a:b] = np.where(found >= 0, mine[np.maximum(found, 0)] if len(mine) else 0, -1)
        tag = t.take(pa.array(first, mask=first < 0)) if len(t) else pa.nulls(len(first), pa.string())
        return pa.ListArray.from_arrays(pa.array(w_at.astype(np.int32)), pc.fill_null(tag, "O"))

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for cols in batches:
            cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols]
            for at, n in row_slices(cols[0], SLICE_PIECES):
                yield tagged(*[c.slice(at, n) for c in cols])

    return F.arrow_udf(run, "array<string>")


def pieces_to_words(pieces_df: DataFrame, words_df: DataFrame | None = None, sent_col: str = "sent_id",
                    pieces_col: str = "pieces", tags_col: str = "piece_tags", words_col: str = "words",
                    cont_prefix: str = CONT, specials: Sequence[str] = (CLS, SEP), unk: str = "[UNK]",
                    starts_col: str | None = None) -> DataFrame:
    """Map predicted pieces back to the given words: a monotone alignment in
    which a word takes the tag of its first piece.  Pieces (continuation prefix
    removed, special pieces dropped) cover their own text; an unknown piece
    covers its word (``align_unknown``).  An empty word, or a word no piece
    starts on, gets ``O``.  Output ``(sent, pos, word, tag)``.

    Both sides are arrays of one sentence row.  ``words_df=None`` reads them
    from one table; a separate ``words_df`` joins sentence rows.  Tokens are
    never shuffled: one Arrow function aligns a batch of sentences, all those
    without unknown pieces together.  ``starts_col`` (1 on a first piece) tells
    first pieces that begin with the prefix's own characters from
    continuations."""
    both = pieces_df if words_df is None else pieces_df.join(words_df.select(sent_col, words_col), sent_col, "right")
    none = F.array().cast("array<string>")
    some = lambda c: F.coalesce(F.col(c), none)
    starts = F.coalesce(F.col(starts_col), F.array().cast("array<int>")) if starts_col else F.lit(None).cast("array<int>")
    tags = _word_tags_udf(cont_prefix, specials, unk, bool(starts_col))(some(pieces_col), some(tags_col), starts, some(words_col))
    rows = both.select(sent_col, some(words_col).alias("__w"), tags.alias("__t"))
    return (rows.select(sent_col, F.posexplode(F.arrays_zip(F.col("__w").alias("w"), F.col("__t").alias("t"))).alias("pos", "x"))
            .select(sent_col, F.col("pos").cast("int").alias("pos"), F.col("x.w").alias("word"), F.col("x.t").alias("tag")))


def fill_truncated(words_df: DataFrame, preds_df: DataFrame, keys: Sequence[str] = ("sent_id", "pos"),
                   tag_col: str = "tag", fill: str = "O") -> DataFrame:
    """Words past the end of a (truncated) prediction get ``O``."""
    p = preds_df.select(*keys, F.col(tag_col).alias("__t"))
    out = words_df.join(p, list(keys), "left").withColumn(tag_col, F.coalesce(F.col("__t"), F.lit(fill)))
    return out.drop("__t")
