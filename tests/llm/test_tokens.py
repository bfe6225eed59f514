"""Operators 1 and 2 against the libraries on whole texts."""

import hashlib
import random

import public_tokenizers as PT
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from tagweave.llm import bpe
from tagweave.llm import queries as Q
from tagweave.llm.token_counts import Counter, count_tokens, read_model_file

RANKS = PT.path("byte_bpe_multi_50k.tiktoken")
MODEL = PT.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "a", "the", "\n", "\t", "é", "<s>", "▁", "日本", "😀", "x.", " ", "1", "<0x0A>", "\x00", "　", "\x1c", "'s", "'",
         "\r\n", "\x85", "!", "99"]


def encoder():
    return tiktoken.Encoding("own", pat_str=PT.PATTERN, mergeable_ranks=bpe.parse_ranks(bpe.read_rank_file(RANKS)), special_tokens={})


def texts(n=1500):
    rng = random.Random(4)
    out = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(n)]
    out += ["".join(rng.choice(PARTS) for _ in range(5000)), "".join(rng.choice(["a", "1", "é", "'s", "!", "9"]) for _ in range(9000)),
            "a" * 30_000, " " * 5_000, "word " * 20_000]
    return out


def test_bpe_equals_the_library_and_comes_back(spark, table_dir):
    rows = list(enumerate(texts())) + [(-1, None), (0, texts()[0]), (None, "x")]
    d = table_dir(spark, "documents", rows, "doc_id long, text string")
    enc = encoder()
    want = sorted((i if i is not None else -9, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                   hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows for ids in [enc.encode_ordinary(t or "")])
    got = sorted((r.doc_id if r.doc_id is not None else -9, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in Q.op1_bpe(spark, d).collect())
    assert got == want


def test_decoding_slices_of_ids_gives_raw_bytes(spark):
    ids = encoder().encode_ordinary("日本語😀")
    df = spark.createDataFrame([(ids[:1],), (None,), ([],)], "token_ids array<int>")
    got = [bytes(r.decoded) for r in bpe.decode_documents(df, RANKS).collect()]
    assert got == [encoder().decode_bytes(ids[:1]), b"", b""]


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "text string, token_ids string, decoded int")
    assert bpe.encode_documents(df, RANKS, PT.PATTERN).count() == 0
    df = spark.createDataFrame([("a b", "clash")], "text string, token_ids string")
    assert bpe.encode_documents(df, RANKS, PT.PATTERN).first().token_ids == encoder().encode_ordinary("a b")


def test_counts_equal_the_library():
    c = Counter(read_model_file(MODEL))
    ts = texts(4000)
    assert c.count_batch(ts) == [len(x) for x in c.sp.encode(ts)]


@pytest.mark.parametrize("chunk,overlap", [(64, 4), (200, 32)])
def test_spliced_chunks_equal_whole_texts(spark, chunk, overlap):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(7)
    ts = ["".join(rng.choice(PARTS) for _ in range(400)) for _ in range(20)]
    ts += ["x" * 3000, "ab " * 500, None, "", "the " * 300, ts[0]]          # no safe place, repeats, empties
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(ts)], "doc_id long, text string, n string")
    got = {r.doc_id: r.n_tokens for r in count_tokens(df, MODEL, chunk_chars=chunk, overlap_chars=overlap).collect()}
    assert got == {i: len(sp.encode(t or "")) for i, t in enumerate(ts)}


def test_count_query_columns(spark, table_dir):
    d = table_dir(spark, "documents", [(1, "é a"), (2, None), (3, "word " * 6000)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.over_limit) for r in Q.op2_token_counts(spark, d).collect()}
    assert got == {1: (4, False), 2: (0, False), 3: (30000, True)}
    assert Q.op2_token_counts(spark, table_dir(spark, "documents", [], "doc_id long, text string")).select(F.col("n_tokens")).count() == 0


def test_count_with_clashing_columns_and_wide_characters(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    names = ["id", "text", "key", "tokens", "n_tokens", "__n", "__text_digest", "c0", "c1", "salt__"]
    texts_ = ["😀a日 " * 300, "é" * 999, "a b", None, "x y\n" * 250]
    rows = [(i, t, *[f"{n}{i}" for n in names[2:]]) for i, t in enumerate(texts_ * 3)]
    df = spark.createDataFrame(rows, names)
    out = count_tokens(df, MODEL, chunk_chars=100, overlap_chars=10)
    assert out.columns == [n for n in names if n != "n_tokens"] + ["n_tokens"]
    for r in out.collect():
        assert r.n_tokens == len(sp.encode(rows[r.id][1] or "")) and (r.key, r["__n"], r.c1) == (f"key{r.id}", f"__n{r.id}", f"c1{r.id}")
