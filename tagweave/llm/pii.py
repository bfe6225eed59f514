"""Personal data by patterns that seed entities teach (operator 3).

DataFrame functions only.  Base spans of four kinds come from regular
expressions and checks (octets, Luhn, digit counts).  They are the seeds of a
bootstrapped extractor:

* every base span and every identifier-like candidate (digit groups, colon
  groups, spelled-out addresses) is an *instance* that stands in lexical
  *patterns*: the two words before it, and the word before with the word after;
* rounds score the pattern-instance graph: a pattern's confidence for a kind is
  f / (f + against + 1) with f the score of its distinct known instances (at least
  ``MIN_SUPPORT``) and against what contradicts the kind: its distinct instances
  that are seeds of other kinds, or of a shape that does not fit the kind.
  Unlabelled instances that fit are no evidence either way, so a context with
  many unseen identifiers is trusted as much as one with few; an instance's score is 1 - product(1 - confidence) over its patterns;
* instances that reach ``ACCEPT`` become known for the next round, and their
  occurrences are added to the spans.

Spans of the method never overlap base spans; base spans stay as they are.
Positions are code points, end exclusive, found in the row itself: the lengths
of the pieces between matches, summed in two levels, so no row is shuffled for
them.  Only occurrences (not texts) are exchanged to score the graph; sums over
a common pattern are pre-aggregated.

Edge cases: null text counts as empty (no spans); repeated rows each get the
spans of their text; an empty table gives an empty result; extra columns are
kept, whatever their names; those named like an output give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm.joins import MAX_BROADCAST_BYTES, join_measured, numbered, renamed

KINDS = ("email", "ip", "card", "phone")

# The matches of the plain patterns, written so that the regex engine neither
# recurses nor rescans: possessive repeats where nothing can be given back, and
# no start inside a run whose first position has failed.  "\G" lets a match
# begin where the last one ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SPELLED = (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}"
           r"(?:(?: ?[(\[{] ?at ?[)\]}] ?)[A-Za-z0-9-]{1,64}(?:(?: ?[(\[{] ?dot ?[)\]}] ?| dot |\.)[A-Za-z0-9-]{1,64}){1,8}"
           r"| at [A-Za-z0-9-]{1,64}(?: dot [A-Za-z0-9-]{1,64}){1,8})")
COLONS = r"(?<![0-9A-Za-z:])[0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{0,4}){3,7}(?![0-9A-Za-z:])"
DIGITS = r"(?<![0-9A-Za-z])[+(]?[0-9]{1,32}\)?(?:[ .-]{1,2}\(?[0-9]{1,32}\)?){0,8}(?![0-9A-Za-z])"
CANDIDATE = f"{SPELLED}|{COLONS}|{DIGITS}"

BLOCK = 128
ROUNDS = 3
MIN_SUPPORT = 3.0
ACCEPT = 0.8
MIN_DIGITS = 6


_PAIR = "array<struct<gap:int,m:string,left:string,right:string>>"
_SPAN = "array<struct<start:bigint,end:bigint,m:string,left:string,right:string>>"


def _pieces(pieces: Column, m: Column) -> Column:
    """Each match with the length of the piece before it and the neighbouring
    ends of the pieces around it."""
    n = F.size(m)
    return F.arrays_zip(F.transform(F.slice(pieces, 1, n), F.length).alias("gap"), m.alias("m"),
                        F.transform(F.slice(pieces, 1, n), lambda x: F.right(x, F.lit(80))).alias("left"),
                        F.transform(F.slice(pieces, 2, n), lambda x: F.left(x, F.lit(48))).alias("right"))


def _spans(text: Column, pattern: str, possible: Column) -> Column:
    """All matches of a text with the pieces between them.  ``possible`` is a
    cheap test without which no match can exist."""
    pairs = _pieces(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return F.coalesce(F.when(possible, pairs), F.array().cast(_PAIR))


def _positions(pairs: Column) -> Column:
    """Gaps to places: gap and match lengths are summed by blocks, so the work
    stays near linear in the number of matches."""
    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x["gap"] + F.length(x["m"]))

    n = F.size(pairs)
    blocks = F.transform(F.sequence(F.lit(0), ((n - 1) / BLOCK).cast("int")),
                         lambda b: total(F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK))))

    def located(before: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            b = (i / BLOCK).cast("int")
            start = (F.element_at(before, b + 1) + total(F.slice(pairs, b * BLOCK + 1, i - b * BLOCK)) + x["gap"])
            return F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("m"),
                            x["left"].alias("left"), x["right"].alias("right"))
        return F.transform(pairs, one)

    def sums(bs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(bs) - 1),
                           lambda b: F.aggregate(F.slice(bs, F.lit(1), b), F.lit(0).cast("long"), lambda a, x: a + x))

    # a one-element array carries a value that is used several times
    bound = F.transform(F.array(blocks), lambda bs: F.struct(sums(bs).alias("v")))
    out = F.flatten(F.transform(bound, lambda s: located(s["v"])))
    return F.when(n > 0, out).otherwise(F.array().cast(_SPAN))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _octets_ok(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)


def _luhn_ok(m: Column) -> Column:
    def check(d: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
            return acc + F.when(x > 9, x - 9).otherwise(x)
        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add) % 10 == 0
    return F.exists(F.array(_digits(m)), lambda d: F.when(F.length(d).between(12, 19), check(d)).otherwise(False))


def _phone_ok(m: Column) -> Column:
    return F.length(_digits(m)).between(9, 15)


def base_spans(text: Column) -> list[tuple[str, Column, object]]:
    """(kind, matches, check) of each kind, in order."""
    t = F.coalesce(text, F.lit(""))
    digit = t.rlike("[0-9][ -]?[0-9]")
    return [("email", _spans(t, EMAIL, F.contains(t, F.lit("@"))), lambda m: F.lit(True)),
            ("ip", _spans(t, IP, t.rlike(r"[0-9]\.[0-9]")), _octets_ok),
            ("card", _spans(t, CARD, digit), _luhn_ok),
            ("phone", _spans(t, PHONE, t.rlike(r"\+[0-9]")), _phone_ok)]


def _checked(found: Column, ok, kind: int) -> Column:
    return F.transform(F.filter(found, lambda x: ok(x["m"])),
                       lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"),
                                          x["end"].alias("end"), x["m"].alias("m"),
                                          x["left"].alias("left"), x["right"].alias("right")))


def _with_base(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``__base``: array<struct<start,kind,end,m>> sorted by start, kind."""
    kinds = base_spans(F.col(f"`{text}`"))
    raw = docs.select("*", *[pairs.alias(f"__p_{k}") for k, pairs, _ in kinds])
    at = raw.select(*[F.col(f"`{c}`") for c in docs.columns],
                    *[_positions(F.col(f"__p_{k}")).alias(f"__s_{k}") for k, _, _ in kinds])
    tagged = [_checked(F.col(f"__s_{k}"), ok, i) for i, (k, _, ok) in enumerate(kinds)]
    return at.select(*[F.col(f"`{c}`") for c in docs.columns], F.array_sort(F.concat(*tagged)).alias("__base"))


def _with_candidates(df: DataFrame, text: str) -> DataFrame:
    """Adds ``__cand``: candidate spans that overlap no base span."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    possible = t.rlike(r"[0-9](?:[ .()-]{0,2}[0-9]){5}|[0-9a-fA-F]:[0-9a-fA-F:]|[ (\[{]dot[ )\]}]|[(\[{] ?at ?[)\]}]")
    raw = df.withColumn("__cp", _spans(t, CANDIDATE, possible))
    at = raw.withColumn("__ca", _positions(F.col("__cp"))).drop("__cp")
    shaped = F.filter("__ca", lambda x: (F.length(_digits(x["m"])) >= MIN_DIGITS) | x["m"].rlike("[A-Za-z:]"))
    free = F.filter(shaped, lambda x: ~F.exists("__base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return at.withColumn("__cand", free).drop("__ca")


def _fits(kind: Column, m: Column) -> Column:
    """Whether a candidate's shape can be an identifier of the kind."""
    n = F.length(_digits(m))
    spelled = m.rlike(r"(?i)\bat\b|@")
    return (F.when(kind == 0, spelled)
            .when(kind == 1, m.rlike(r":.*:|[0-9]\.[0-9]+\.[0-9]+\.[0-9]") & ~spelled)
            .when(kind == 2, (n >= 8) & (n <= 24) & ~m.rlike("[:@]") & ~spelled)
            .otherwise((n >= MIN_DIGITS) & (n <= 15) & ~m.rlike("[:@]") & ~spelled))


def _patterns(left: Column, right: Column) -> Column:
    """The patterns an instance stands in: the two words before it, and the
    word before with the word after, within the text up to the next match."""
    end = r"""[\s:=(\["'#]*$"""
    word = r"""([^\s:=(\["'#]+)"""
    two = F.regexp_extract(left, r"""[^\s:=(\["'#]+[\s:=(\["'#]+[^\s:=(\["'#]+""" + end, 0)
    two = F.trim(F.regexp_replace(two, r"""[\s:=(\["'#]+""", " "))
    one = F.regexp_extract(left, word + end, 1)
    after = F.regexp_extract(right, r"""^[\s,.;:)\]"']*([^\s,.;:)\]"']+)""", 1)
    return F.array_compact(F.array(
        F.when(two != "", F.concat(F.lit("L "), F.lower(two))),
        F.when((one != "") & (after != ""), F.concat(F.lit("M "), F.lower(one), F.lit(" _ "), F.lower(after)))))


def _occurrences(df: DataFrame) -> DataFrame:
    """(key, start, end, inst, seed kind or null, pattern) of every instance."""
    def instance(x: Column, seed: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lower(x["m"]).alias("inst"), seed.alias("seed"),
                        _patterns(x["left"], x["right"]).alias("patterns"))

    both = F.concat(F.transform("__base", lambda x: instance(x, x["kind"])),
                    F.transform("__cand", lambda x: instance(x, F.lit(None).cast("int"))))
    return (df.select("__key", F.explode(both).alias("o"))
            .select("__key", "o.start", "o.end", "o.inst", "o.seed", F.explode("o.patterns").alias("pattern")))


def score_patterns(occurrences: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Iterated scores of the pattern-instance graph: (inst, kind, score) of
    the discovered instances."""
    edges = occurrences.groupBy("pattern", "inst").agg(F.max("seed").alias("seed")).checkpoint()
    kinds = F.explode(F.array(*[F.lit(i) for i in range(len(KINDS))])).alias("kind")
    fits = _fits(F.col("kind"), F.col("inst"))
    fitting = edges.select("pattern", "inst", "seed", kinds).filter(F.col("seed").isNotNull() | fits)
    # instances that contradict a kind stay so in every round
    contrary = F.when(F.col("seed").isNull(), ~fits).otherwise(F.col("seed") != F.col("kind"))
    against = (edges.select("pattern", "inst", "seed", kinds).filter(contrary)
               .groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("against")))
    known = edges.filter("seed is not null").groupBy("inst", F.col("seed").alias("kind")).agg(F.lit(1.0).alias("score"))
    found = None
    for _ in range(rounds):
        confident = (fitting.join(known, ["inst", "kind"]).groupBy("pattern", "kind").agg(F.sum("score").alias("f"))
                     .filter(F.col("f") >= MIN_SUPPORT)
                     .join(against, ["pattern", "kind"], "left")
                     .select("pattern", "kind", F.least(F.col("f") / (F.col("f") + F.coalesce("against", F.lit(0)) + 1), F.lit(0.99)).alias("conf"))
                     .filter("conf >= 0.5"))
        found = (fitting.filter("seed is null").join(confident, ["pattern", "kind"])
                 .groupBy("inst", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("conf"))))).alias("score"))
                 .filter(F.col("score") >= ACCEPT).checkpoint())
        known = (edges.filter("seed is not null").groupBy("inst", F.col("seed").alias("kind")).agg(F.lit(1.0).alias("score"))
                 .unionByName(found))
    return found


def find_identifiers(docs: DataFrame, text: str = "text", out: str = "pii", rounds: int = ROUNDS,
                     max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Adds ``<out>_base`` and ``<out>`` : arrays of struct<start,kind,end>
    (kind is an index into KINDS), sorted by start, then kind."""
    plain_docs, names = numbered(docs)
    body = f"c{names.index(text)}"
    t = F.coalesce(F.col(body), F.lit(""))
    spans = _with_candidates(_with_base(plain_docs, body), body)
    # texts without candidates get a key of their own that matches nothing, so
    # they spread over the join's partitions instead of meeting in one
    keyed = spans.withColumn("__key", F.when(F.size("__cand") > 0, F.sha2(t, 256)).otherwise(
        F.concat(F.lit("none "), F.xxhash64(t).cast("string"))))
    # no filter on the span columns: the optimizer would move it below them and
    # evaluate the whole span expression again inside every lambda
    occ = _occurrences(keyed.select("__key", "__base", "__cand")).checkpoint()
    found = score_patterns(occ, rounds)
    best = found.groupBy("inst").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
    added = (occ.filter("seed is null").groupBy("__key", "start", "end").agg(F.first("inst").alias("inst"))
             .join(best, "inst").groupBy("__key")
             .agg(F.collect_list(F.struct("start", "kind", "end")).alias("__added")).checkpoint())
    plain = F.transform("__base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end")))
    slim = keyed.select(*plain_docs.columns, "__key", plain.alias("__plain"))
    # what was added is measured: copies of one text don't meet in one task
    joined = join_measured(slim, added, ["__key"], F.size("__added") * 40 + 120, "left", max_bytes)
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return joined.select(*renamed(names, (out, f"{out}_base")), F.col("__plain").alias(f"{out}_base"),
                         F.array_sort(F.concat(F.col("__plain"), F.coalesce("__added", none))).alias(out))


def span_list(spans: Column) -> Column:
    """"kind:start:end" of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def mask(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in square brackets;
    overlapping spans become one, named by the first."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    # every position is reached from the last one, so a span inside a wider one adds nothing
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, x: Column) -> Column:
        clean = F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        return F.when(x["start"] >= acc["at"], F.struct(x["end"].alias("at"), F.concat(
            acc["parts"], F.array(clean, F.element_at(names, x["kind"] + 1))).alias("parts"))).otherwise(
            F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["parts"].alias("parts")))

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["parts"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, finish)).otherwise(text)
