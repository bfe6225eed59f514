"""The registered queries of the subpackage and their DuckDB statements.

Each query applies one operator to its whole table and derives the contract's
columns from the operator's own output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm import oracles as oracles_sql

QueryFn = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE over documents: ids, decoded again, as digests."""
    import public_tokenizers
    from tagweave.llm import bpe
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, keep_text=False)
    ids = F.col("token_ids")
    # decoding and the id digest read the ids in the same pass
    return out.select("doc_id", F.size(ids).cast("long").alias("n_tokens"),
                      bpe.id_list_digest(ids).alias("ids_sha256"),
                      F.sha2(bpe.decode(ids, spark, ranks), 256).alias("decoded_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of documents by the 32k piece model."""
    import public_tokenizers
    from tagweave.llm.token_counts import count_tokens
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
                      "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers in documents: base kinds, and what their contexts discover."""
    from tagweave.llm import pii
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.find_identifiers(docs)

    def of_kind(i: int):
        return F.size(F.filter("pii_base", lambda x: x["kind"] == i)).cast("long")

    count = [of_kind(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return out.select("doc_id", *count, F.sha2(pii.span_list(F.col("pii_base")), 256).alias("base_sha256"),
                      pii.span_list(F.col("pii")).alias("spans"))


def op4_suffix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes of repeated 200-byte strings."""
    from tagweave.llm.suffix_index import remove_repeats
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document; one seventh is held out."""
    import public_tokenizers
    from tagweave.llm.lattice_lm import score_documents
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_remainder("doc_id", 7) == 2, F.lit(False))
    out = score_documents(docs, ~held_out, public_tokenizers.path("piece_bpe_32k.model"), learned=True)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from tagweave.llm.html_text import extract_pages
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_pages(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_crosspoly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth embedding."""
    from tagweave.llm.crosspoly import nearest
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % 20 == 0)


def op8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, one row per (document, item)."""
    from tagweave.llm import leaks
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = leaks.find_leaks(docs, _read(spark, sf_dir, "benchmark"))
    return leaks.leaked_documents(docs, found).drop("text").distinct()


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle set size and component of every document."""
    from tagweave.llm import jaccard
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.link_documents(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def crc_remainder(doc_id: str, m: int):
    """crc32 of the id as text, modulo m (null for a null id)."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(m))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; the held-out fifth is never learned from."""
    from tagweave.llm import toxicity
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_remainder("doc_id", 5) == 0, F.lit(False))
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"), ~held_out)
    out = model.score(docs)
    return out.select("doc_id", held_out.alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_rmq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    from tagweave.llm.rmq_rank import rank_documents
    return rank_documents(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark").select("item_id", "text"))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations in budgeted windows, read back and digested; one more
    conversation holds the template's own control strings."""
    import public_tokenizers
    from tagweave.llm import chat
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return chat.read_back(turns.unionByName(extra), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_gnat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding; every seventh row's label
    is moved on by one."""
    from tagweave.llm.gnat import mine
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return mine(vectors, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, QueryFn] = {
    "op1_bpe": op1_bpe,
    "op2_token_counts": op2_token_counts,
    "op3_pii": op3_pii,
    "op4_suffix_index": op4_suffix_index,
    "op5_lattice": op5_lattice,
    "op6_html": op6_html,
    "op7_crosspoly": op7_crosspoly,
    "op8_leaks": op8_leaks,
    "op9_jaccard": op9_jaccard,
    "op10_toxicity": op10_toxicity,
    "op11_rmq": op11_rmq,
    "op12_chat": op12_chat,
    "op13_gnat": op13_gnat,
}

ORACLES: dict[str, str] = {"op8_leaks": oracles_sql.OP8_LEAKS, "op9_jaccard": oracles_sql.OP9_JACCARD,
                           "op11_rmq": oracles_sql.OP11_RMQ, "op13_gnat": oracles_sql.OP13_GNAT}


def queries() -> dict[str, QueryFn]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
