"""Inputs derived from the driver's tables (deterministic rules, so DuckDB can
state the same rows).  Every derived input reads the whole table it comes
from; nothing is subset, sampled or capped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave import constants as C
from tagweave.functions.text import normalize_ws


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def gold_tag(doc_id: Column, pos: Column) -> Column:
    """block = pos div 3, k = (doc_id*7 + block*5) mod 10; k >= 7 -> O, else
    B-/I- (B- on pos mod 3 = 0) of entity type k."""
    block = F.floor(pos / 3)
    k = F.pmod(doc_id * 7 + block * 5, F.lit(10))
    etype = F.element_at(F.array(*[F.lit(t) for t in C.ENTITY_TYPES]), (k + 1).cast("int"))
    prefix = F.when(F.pmod(pos, F.lit(3)) == 0, F.lit("B-")).otherwise(F.lit("I-"))
    return F.when(k >= 7, F.lit("O")).otherwise(F.concat(prefix, etype))


def pred_tag(doc_id: Column, pos: Column) -> Column:
    """O when (doc_id + pos) mod 11 = 0, else the gold tag."""
    return F.when(F.pmod(doc_id + pos, F.lit(11)) == 0, F.lit("O")).otherwise(gold_tag(doc_id, pos))


def normalized_documents(spark: SparkSession, sf_dir: str, ranged: bool = False) -> DataFrame:
    """documents(doc_id, text) with whitespace runs collapsed and stripped;
    ``ranged`` deals them out by ranges of doc_id first."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return (d.repartitionByRange("doc_id") if ranged else d).select("doc_id", normalize_ws(F.col("text")).alias("text"))


def doc_tokens(spark: SparkSession, sf_dir: str, with_tags: bool = True) -> DataFrame:
    """Tagged tokens ``(sent_id, pos, token[, gold, pred])`` of every document."""
    d = normalized_documents(spark, sf_dir)
    t = d.select(F.col("doc_id").alias("sent_id"), F.posexplode(F.split("text", " ", -1)).alias("pos", "token"))
    t = t.withColumn("pos", F.col("pos").cast("int"))
    if with_tags:
        t = t.withColumn("gold", gold_tag(F.col("sent_id"), F.col("pos"))) \
             .withColumn("pred", pred_tag(F.col("sent_id"), F.col("pos")))
    return t


def _gold_tag_py(doc_mod10: int, pos: int) -> str:
    k = (doc_mod10 * 7 + (pos // 3) * 5) % 10
    if k >= 7:
        return "O"
    return ("B-" if pos % 3 == 0 else "I-") + C.ENTITY_TYPES[k]


# the gold rule depends on doc_id only through doc_id mod 10 and repeats
# every 6 positions, so a sentence's tag array is a repeated 6-tag pattern
_GOLD_PATTERNS = [[_gold_tag_py(r, p) for p in range(6)] for r in range(10)]


def doc_sentences(spark: SparkSession, sf_dir: str, ranged: bool = False) -> DataFrame:
    """Wide form ``(sent_id, tokens, tags)`` with gold tags, built natively
    (pattern repeat + slice) rather than with a per-token lambda.  ``ranged``
    deals the documents out by ranges of their id before that, which a later
    global sort by ``sent_id`` keeps: its sampler then reads the documents only."""
    d = normalized_documents(spark, sf_dir, ranged)
    toks = F.split("text", " ", -1)
    pats = F.array(*[F.array(*[F.lit(t) for t in pat]) for pat in _GOLD_PATTERNS])
    d = d.select("doc_id", toks.alias("tokens"))
    n = F.size("tokens")
    pat = F.element_at(pats, (F.pmod(F.col("doc_id"), F.lit(10)) + 1).cast("int"))
    tags = F.slice(F.flatten(F.array_repeat(pat, F.ceil(n / 6).cast("int"))), 1, n)
    return d.select(F.col("doc_id").alias("sent_id"), "tokens", tags.alias("tags"))


def pred_tags(sent_id: Column, tags: Column) -> Column:
    """``pred_tag`` of a whole sentence: the gold tags, O where (id + pos) mod
    11 = 0 (a pattern that repeats every 11 positions)."""
    shift = F.pmod(sent_id, F.lit(11))
    hit = F.flatten(F.array_repeat(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: F.pmod(i + shift, F.lit(11)) == 0),
                                   F.ceil(F.size(tags) / 11).cast("int")))
    return F.zip_with(tags, F.slice(hit, 1, F.size(tags)), lambda t, h: F.when(h, F.lit("O")).otherwise(t))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a run log: run = user_id, metric value = value; step is the
    1-based order of (ts, event_id) inside the run (computed by the operators
    that need it)."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), "ts", "event_id", F.col("value").alias("value"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations grouped by conv_id as papers: sections = turns in order
    (heading = role, text = text)."""
    c = table(spark, sf_dir, "conversations")
    g = c.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    return g.select(
        F.concat(F.lit("conv://"), F.col("conv_id").cast("string")).alias("url"),
        F.col("conv_id"),
        F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("title"),
        F.get(F.col("ts"), 0)["text"].alias("abstract"),
        F.transform("ts", lambda t: F.struct(t["role"].alias("heading"), t["text"].alias("text"))).alias("sections"),
    )
