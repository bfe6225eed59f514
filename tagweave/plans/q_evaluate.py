"""Queries: entity-level scoring, corpus statistics, per-token losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave import constants as C
from tagweave.functions.text import normalize_ws
from tagweave.operators import evaluate as EV
from tagweave.operators.sampling import sequential_batches
from tagweave.plans.catalog import register
from tagweave.session import cut_lineage
from tagweave.plans.fixtures import doc_sentences, doc_tokens, pred_tags, table
from tagweave.plans.q_tokens import TAGGED_SQL, chunks_sql


def _r6(c):
    return F.round(c, 6)


def _round_metrics(df):
    for c in ("precision", "recall", "f1", "accuracy"):
        if c in df.columns:
            df = df.withColumn(c, _r6(F.col(c)))
    return df


PRF_SQL = """round(case when n_pred = 0 then 0.0 else n_correct / n_pred end, 6) as precision,
       round(case when n_gold = 0 then 0.0 else n_correct / n_gold end, 6) as recall,
       round(case when n_correct = 0 then 0.0 else 2.0 * (n_correct / n_pred) * (n_correct / n_gold)
             / ((n_correct / n_pred) + (n_correct / n_gold)) end, 6) as f1"""

BY_TYPE_SQL = f"""with {TAGGED_SQL},
g as {chunks_sql('tagged', 'gold')},
p as {chunks_sql('tagged', 'pred')},
c as (select g.type, count(*) as n from g join p using (sent_id, type, start, "end") group by 1),
gc as (select type, count(*) as n from g group by 1),
pc as (select type, count(*) as n from p group by 1),
t as (select coalesce(gc.type, pc.type) as type, coalesce(c.n, 0)::BIGINT as n_correct,
             coalesce(pc.n, 0)::BIGINT as n_pred, coalesce(gc.n, 0)::BIGINT as n_gold
      from gc full outer join pc using (type) left join c on c.type = coalesce(gc.type, pc.type))"""


@register("entity_metrics_by_type", BY_TYPE_SQL + f"""
select type, n_correct, n_pred, n_gold, {PRF_SQL}, n_gold as number from t
""")
def q_entity_metrics_by_type(spark, sf_dir):
    return _round_metrics(EV.entity_metrics_by_type(doc_tokens(spark, sf_dir)))


OVERALL_SQL = f"""with {TAGGED_SQL},
g as {chunks_sql('tagged', 'gold')},
p as {chunks_sql('tagged', 'pred')},
o as (select (select count(*) from g join p using (sent_id, type, start, "end"))::BIGINT as n_correct,
             (select count(*) from p)::BIGINT as n_pred, (select count(*) from g)::BIGINT as n_gold,
             (select count(*) from tagged)::BIGINT as n_tokens,
             (select count(*) filter (where gold = pred) from tagged) as n_equal)"""


@register("entity_metrics_overall", OVERALL_SQL + f"""
select n_correct, n_pred, n_gold, n_tokens, {PRF_SQL}, round(n_equal / n_tokens, 6) as accuracy from o
""")
def q_entity_metrics_overall(spark, sf_dir):
    return _round_metrics(EV.entity_metrics_overall(doc_tokens(spark, sf_dir)))


@register("entity_metrics_batched", f"""with {TAGGED_SQL},
b as (select doc_id as sent_id, ((row_number() over (order by doc_id) - 1) // 8) as batch_id from documents),
bt as (select tagged.*, b.batch_id from tagged join b using (sent_id)),
g as {chunks_sql('(select *, row_number() over (partition by batch_id order by sent_id, pos) as rn from bt)', 'gold', 'batch_id', 'rn')},
p as {chunks_sql('(select *, row_number() over (partition by batch_id order by sent_id, pos) as rn from bt)', 'pred', 'batch_id', 'rn')},
o as (select (select count(*) from g join p using (batch_id, type, start, "end"))::BIGINT as n_correct,
             (select count(*) from p)::BIGINT as n_pred, (select count(*) from g)::BIGINT as n_gold,
             (select count(*) from bt)::BIGINT as n_tokens,
             (select count(*) filter (where gold = pred) from bt) as n_equal)
select n_correct, n_pred, n_gold, n_tokens, {PRF_SQL}, round(n_equal / n_tokens, 6) as accuracy from o
""")
def q_entity_metrics_batched(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sent_id"))
    batches = sequential_batches(docs, "sent_id", 8)
    toks = doc_tokens(spark, sf_dir).join(batches, "sent_id")
    return _round_metrics(EV.entity_metrics_batched(toks, "batch_id"))


_FLAT_COLS = [f"{t}_{m}" for t in sorted(C.ENTITY_TYPES) for m in ("f1", "number", "precision", "recall")]


@register("flatten_metrics", BY_TYPE_SQL + f""",
bt as (select type, n_correct, n_pred, n_gold, {PRF_SQL}, n_gold as number from t),
ov as (select sum(n_correct) as n_correct, sum(n_pred) as n_pred, sum(n_gold) as n_gold from t),
ovm as (select {PRF_SQL} from ov)
select {", ".join(f"max(case when type = '{c.rsplit('_', 1)[0]}' then {c.rsplit('_', 1)[1]}::DOUBLE end) as {c}"
                  for c in _FLAT_COLS)},
       (select f1 from ovm) as overall_f1, (select precision from ovm) as overall_precision,
       (select recall from ovm) as overall_recall
from bt
""")
def q_flatten_metrics(spark, sf_dir):
    toks = doc_tokens(spark, sf_dir)
    # the per-type table has one row per entity type: materialize it once
    by_type = cut_lineage(EV.entity_metrics_by_type(toks))
    overall = _round_metrics(EV.overall_from_type_counts(by_type))
    return EV.flatten_metrics(_round_metrics(by_type), overall)


@register("entity_type_counts", f"""with {TAGGED_SQL}
select substr(gold, 3) as type, count(*) as n_entities from tagged where gold like 'B-%' group by 1
""")
def q_entity_type_counts(spark, sf_dir):
    return EV.entity_type_counts(doc_tokens(spark, sf_dir), "gold")


@register("corpus_statistics", f"""with {TAGGED_SQL},
sp as (select tagged.*, d.lang as split from tagged join documents d on d.doc_id = tagged.sent_id),
ps as (select split, sent_id, count(*) as len from sp group by 1, 2),
l as (select split, count(*) as n_sentences, sum(len)::BIGINT as n_tokens, min(len) as min_len,
             round(avg(len), 6) as mean_len, max(len) as max_len from ps group by 1),
v as (select split, count(distinct token) as vocab_size from sp group by 1)
select * from l join v using (split)
""")
def q_corpus_statistics(spark, sf_dir):
    # the language rides with its document: joining it to the tokens would sort all of them
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sent_id"), F.col("lang").alias("split"), normalize_ws(F.col("text")).alias("text"))
    toks = docs.where("sent_id is not null").select("sent_id", "split", F.explode(F.split("text", " ", -1)).alias("token"))
    st = EV.corpus_statistics(toks, "split")
    return st.withColumn("mean_len", _r6(F.col("mean_len")))


def logits_table(spark, sf_dir):
    """embeddings as per-token scores: first 10 dims as double, label masked
    (-1) when vec_id mod 7 = 0, sentence = vec_id div 8."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id",
        F.floor(F.col("vec_id") / 8).alias("sent_id"),
        F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double")).alias("logits"),
        F.when(F.pmod(F.col("vec_id"), F.lit(7)) == 0, F.lit(-1)).otherwise(F.col("label")).cast("int").alias("label"),
    )


LOGITS_SQL = """lg as (select vec_id, vec_id // 8 as sent_id,
       list_transform(embedding[1:10], lambda x: x::DOUBLE) as logits,
       (case when vec_id % 7 = 0 then -1 else label end)::INTEGER as label from embeddings)"""

CE_SQL = "(list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))) - logits[label + 1])"


@register("argmax_decode", f"""with {LOGITS_SQL}
select vec_id, (list_position(logits, list_max(logits)) - 1)::INTEGER as pred_id from lg
""")
def q_argmax_decode(spark, sf_dir):
    return EV.argmax_decode(logits_table(spark, sf_dir), "logits", "pred_id").select("vec_id", "pred_id")


@register("masked_cross_entropy", f"""with {LOGITS_SQL}
select round(avg({CE_SQL}), 6) as loss, count(*) as n_tokens from lg where label <> -1
""")
def q_masked_cross_entropy(spark, sf_dir):
    r = EV.masked_cross_entropy(logits_table(spark, sf_dir), "logits", "label", -1)
    return r.withColumn("loss", _r6(F.col("loss")))


@register("mean_of_batch_losses", f"""with {LOGITS_SQL},
pb as (select sent_id as batch_id, avg({CE_SQL}) as bl from lg where label <> -1 group by 1)
select round(avg(bl), 6) as loss, count(*) as n_batches from pb
""")
def q_mean_of_batch_losses(spark, sf_dir):
    lg = logits_table(spark, sf_dir).where(F.col("label") != -1)
    per_tok = lg.select(F.col("sent_id").alias("batch_id"),
                        EV.token_cross_entropy(F.col("logits"), F.col("label")).alias("loss"))
    r = EV.mean_of_batch_losses(per_tok, "batch_id", "loss")
    return r.withColumn("loss", _r6(F.col("loss")))


@register("evaluate_files", OVERALL_SQL + f"""
select n_correct, n_pred, n_gold, n_tokens, {PRF_SQL}, round(n_equal / n_tokens, 6) as accuracy from o
""")
def q_evaluate_files(spark, sf_dir):
    from tagweave.plans.score import evaluate_files
    from tagweave.session import scratch_path
    from tagweave.sources.conll import write_conll
    gp, pp = scratch_path(spark, "gold"), scratch_path(spark, "pred")
    sents = doc_sentences(spark, sf_dir, ranged=True)
    write_conll(sents, gp, token_col="tokens", tag_col="tags", compression="gzip")
    write_conll(sents.withColumn("tags", pred_tags(F.col("sent_id"), F.col("tags"))), pp, token_col="tokens", tag_col="tags", compression="gzip")
    return _round_metrics(evaluate_files(spark, gp, pp, "\t"))
