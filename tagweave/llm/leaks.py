"""Benchmark decontamination by spaced seeds (operator 8).

DataFrame functions only.  Texts become tokens (lower-cased runs of letters
and digits).  A document holds an item when, on one alignment of the two, some
``WINDOW`` consecutive item tokens agree in at least ``MIN_EQUAL`` places
(substitutions allowed); an item shorter than the window must occur whole.

Seeds.  Fixed masks select 6 of 8 or 9 neighbouring tokens and ignore the
rest.  For any two substitutions in a window, one of the masks lies in it
without touching them, so every overlap of the definition shares a seed hash
on the right alignment (the tests try all cases).  Items shorter than the
window get a seed of their whole length.

Test seeds are joined with training seeds by broadcast up to
``MAX_BROADCAST_SEEDS`` of them; a larger benchmark is joined in blocks of
hashes of that size, one after another, so what is broadcast stays bounded.
Hits are reduced to distinct (text, item, alignment) before any exchange; then
each hit text is compared token by token on its alignments.  A hit carries only
the tokens that its item covers, never the whole text.  Small sides are
broadcast by their measured bytes; beyond the bound the joins are salted, so
copies of one text or one common item don't meet in one task.

Edge cases: null or empty texts and items without tokens match nothing;
repeated rows are all found; ties between alignments go to the smaller one; an
empty benchmark leaks nothing; extra columns are kept whatever their names, but
``leaked_documents`` puts its own columns in place of those of the same name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm.joins import MAX_BROADCAST_BYTES, join_measured, numbered, renamed

# fixed values: token offsets each mask looks at
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
WINDOW = 13
MIN_EQUAL = 11                       # 80 % of the window, rounded up
MAX_BROADCAST_SEEDS = 1_000_000      # about 50 MB as a hash relation


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")


def _seed_hashes(words: Column, masks: list[tuple[int, ...]]) -> Column:
    """One hash per (place, mask), in that order; the element index is
    place * number of masks + mask number.  A seed that runs over the end is
    null."""
    k = len(masks)

    def at(j: Column) -> Column:
        i = (j / k).cast("int")
        case = None
        for m, mask in enumerate(masks):
            h = F.when(i + mask[-1] < F.size(words), F.xxhash64(F.lit(m), *[F.get(words, i + o) for o in mask]))
            case = h if k == 1 else (F.when(j % k == m, h) if case is None else case.when(j % k == m, h))
        return case

    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), F.size(words) * k - 1), at))


def _benchmark_seeds(items: DataFrame, masks: list[tuple[int, ...]]) -> DataFrame:
    """(hash, item, n, at): every seed of every item of n tokens; a short item
    only has the seed of its whole length."""
    k = len(masks)
    long_items = F.size("words") >= WINDOW
    seeds = items.select("item", F.size("words").alias("n"), long_items.alias("long"),
                         F.posexplode(_seed_hashes(F.col("words"), masks)).alias("j", "hash"))
    mask_no = F.col("j") % k
    whole = F.element_at(F.array(*[F.lit(m[-1] + 1) for m in masks]), mask_no + 1) == F.col("n")
    return (seeds.filter("hash is not null")
            .filter(F.when(F.col("long"), mask_no < len(MASKS)).otherwise((mask_no >= len(MASKS)) & whole))
            .select("hash", "item", "n", (F.col("j") / k).cast("int").alias("at")))


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
               item_text: str = "text", max_broadcast: int = MAX_BROADCAST_SEEDS,
               max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Leaked (text, item) pairs, one row each: ``text_key`` (SHA-256 of the
    text), ``item_id``, ``doc_start`` (token of the document where the item's
    first token would stand), ``n_equal`` (agreeing places on the alignment),
    ``n_item`` (tokens of the item)."""
    items = (benchmark.select(F.col(f"`{item_id}`").alias("item"), tokens(F.col(f"`{item_text}`")).alias("words"))
             .filter(F.size("words") > 0).checkpoint())
    # a short item's whole length is a mask of its own: fewer than WINDOW of them
    short = sorted(r.n for r in items.filter(F.size("words") < WINDOW).select(F.size("words").alias("n")).distinct().collect())
    masks = [*MASKS, *[tuple(range(n)) for n in short]]
    k = len(masks)
    seeds = _benchmark_seeds(items, masks).checkpoint()
    blocks = max(1, -(-seeds.count() // max_broadcast))

    body = F.col(f"`{text}`")
    # texts are known by a hash here; a collision only adds a candidate that is
    # then compared and found different
    worded = docs.select(F.xxhash64(body).alias("key"), tokens(body).alias("words"))
    places = worded.select("key", F.posexplode(_seed_hashes(F.col("words"), masks)).alias("j", "hash"))

    def hits_in(block: int) -> DataFrame:
        part = seeds.filter(F.pmod("hash", F.lit(blocks)) == block) if blocks > 1 else seeds
        return (places.join(F.broadcast(part), "hash")
                .select("key", "item", "n", ((F.col("j") / k).cast("int") - F.col("at")).alias("shift")))

    hits = reduce(DataFrame.unionByName, [hits_in(b) for b in range(blocks)])
    aligned = (hits.distinct().groupBy("key").agg(F.collect_list(F.struct("item", "n", "shift")).alias("hits")).checkpoint())

    bodies = docs.select(body.alias("t"), F.xxhash64(body).alias("key"))
    # copies of a text are one row before they are exchanged
    hit_docs = (join_measured(bodies, aligned, ["key"], F.size("hits") * 40 + 40, max_bytes=max_bytes)
                .groupBy("key", F.sha2("t", 256).alias("text_key")).agg(F.first("t").alias("t"), F.first("hits").alias("hits")))
    shift = F.col("h.shift")
    covered = (hit_docs.select("text_key", "hits", tokens(F.col("t")).alias("dw"))
               .select("text_key", "dw", F.explode("hits").alias("h"))
               .select("text_key", F.col("h.item").alias("item"), F.col("h.n").alias("n_item"), shift.alias("shift"),
                       F.slice("dw", F.greatest(shift, F.lit(0)) + 1, F.col("h.n") + F.least(shift, F.lit(0))).alias("part")))
    known = items.select("item", F.size("words").alias("n_item"), "words")
    before = F.least(F.col("shift"), F.lit(0))
    compared = (join_measured(covered, known, ["item", "n_item"], F.aggregate(
                    "words", F.lit(40), lambda a, w: a + 8 + F.octet_length(w)).cast("long"), max_bytes=max_bytes)
                .select("text_key", "item", "shift", "n_item",
                        F.transform(F.col("words"), lambda w, q: F.coalesce(
                            (F.when(q + before >= 0, F.get("part", q + before)) == w).cast("int"), F.lit(0))).alias("eq"))
                .checkpoint())      # else the filter below would inline the comparison into its lambdas
    width = F.least(F.lit(WINDOW), F.col("n_item"))
    need = F.when(F.col("n_item") < WINDOW, F.col("n_item")).otherwise(F.lit(MIN_EQUAL))
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    held = F.exists(F.sequence(F.lit(1), F.col("n_item") - width + 1), lambda s: total(F.slice("eq", s, width)) >= need)
    return (compared.filter(held)
            .groupBy("text_key", "item").agg(F.max(F.struct(total(F.col("eq")).alias("n_equal"), (-F.col("shift")).alias("back"),
                                                            F.col("n_item").alias("n_item"))).alias("best"))
            .select("text_key", F.col("item").alias("item_id"), (-F.col("best.back")).alias("doc_start"),
                    F.col("best.n_equal").alias("n_equal"), F.col("best.n_item").alias("n_item")))


def leaked_documents(docs: DataFrame, leaks: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``docs`` joined with the pairs of their text."""
    plain, names = numbered(docs)
    keyed = plain.withColumn("text_key", F.sha2(F.col(f"c{names.index(text)}"), 256))
    found = [c for c in leaks.columns if c != "text_key"]
    return (join_measured(keyed, leaks.checkpoint(), ["text_key"], F.lit(120).cast("long"))
            .select(*renamed(names, tuple(found)), *found))


def drop_leaked(docs: DataFrame, leaks: DataFrame, text: str = "text") -> DataFrame:
    """Documents that hold no item; all their columns."""
    plain, names = numbered(docs)
    keyed = plain.withColumn("text_key", F.sha2(F.coalesce(F.col(f"c{names.index(text)}"), F.lit("")), 256))
    gone = leaks.select("text_key").distinct().checkpoint()
    return join_measured(keyed, gone, ["text_key"], F.lit(100).cast("long"), "left_anti").select(*renamed(names))
