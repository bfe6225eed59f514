"""Queries: sub-word pieces, alignment, padding, piece/word mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.functions.text import normalize_ws
from tagweave.operators import pieces as P
from tagweave.operators.sampling import dense_ids, sequential_batches
from tagweave.plans.catalog import register
from tagweave.plans.fixtures import doc_sentences, doc_tokens, table
from tagweave.plans.q_labels import LABELS_SQL_LIST
from tagweave.plans.q_tokens import TAGGED_SQL

WIDTH = 4
MAX_LEN = 512

# per piece: (sent_id, pos, j, piece, label, is_first)
PIECES_SQL = f"""{TAGGED_SQL},
pw as (select sent_id, pos, gold, (list_position({LABELS_SQL_LIST}, gold) - 1) as lab,
              regexp_extract_all(token, '.{{1,{WIDTH}}}') as ps from tagged),
pc as (select sent_id, pos, lab, j, case when j = 1 then ps[j] else '##' || ps[j] end as piece
       from (select sent_id, pos, lab, ps, unnest(generate_series(1, greatest(len(ps), 1))) as j from pw)),
pn as (select *, row_number() over (partition by sent_id order by pos, j) as k from pc)"""


def _expanded(spark, sf_dir):
    return P.expand_pieces(doc_sentences(spark, sf_dir), P.fixed_width_splitter(WIDTH))


@register("expand_pieces", f"""with {PIECES_SQL}
select sent_id, (count(*) + 2)::INTEGER as n_pieces,
       '[CLS] ' || string_agg(piece, ' ' order by k) || ' [SEP]' as pieces,
       '0' || string_agg(case when j = 1 then '1' else '0' end, '' order by k) || '0' as token_starts,
       string_agg(lab::VARCHAR, ',' order by k) filter (where j = 1) as labels
from pn group by sent_id
""")
def q_expand_pieces(spark, sf_dir):
    e = _expanded(spark, sf_dir)
    return e.select("sent_id", F.size("pieces").cast("int").alias("n_pieces"),
                    F.array_join("pieces", " ").alias("pieces"),
                    F.array_join("token_starts", "").alias("token_starts"),
                    F.array_join("labels", ",").alias("labels"))


# Vocabulary from the benchmark's words: the words, their beginnings of up to
# four characters, and as continuations all parts of up to three characters.
VOCAB_SQL = """bw as (select distinct unnest(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) as w from benchmark),
vt as (select distinct piece from (
         select w as piece from bw union all
         select substr(w, 1, k) from (select w, unnest(generate_series(1, least(4, length(w)))) as k from bw))
       where piece <> '' and not starts_with(piece, '##')),
vc as (select distinct substr(w, p, k) as part from (
         select w, p, unnest(generate_series(1, least(3, length(w) - p + 1))) as k
         from (select w, unnest(generate_series(2, length(w))) as p from bw where length(w) > 1))),
voc as (select piece, (999 + row_number() over (order by piece))::INTEGER as id
        from (select piece from vt union all select '##' || part from vc))"""

# greedy longest match, once for each distinct word
SPLIT_WORDS_SQL = """dw as (select distinct token as w from tagged where token <> ''),
m1 as (select w, max(k) as k from (select w, k, substr(w, 1, k) as s
         from (select w, unnest(generate_series(1, length(w))) as k from dw)) join vt on s = piece group by w),
mr as (select w, p, max(k) as k from (select w, p, k, substr(w, p, k) as s from (
         select w, p, unnest(generate_series(1, least(3, length(w) - p + 1))) as k
         from (select w, unnest(generate_series(2, length(w))) as p from dw where length(w) > 1))) join vc on s = part group by w, p),
gr(w, p, k, j) as (select w, 1::BIGINT, k, 1 from m1 union all
                   select gr.w, gr.p + gr.k, mr.k, gr.j + 1 from gr join mr on mr.w = gr.w and mr.p = gr.p + gr.k),
fit as (select distinct w from gr where p + k - 1 = length(w)),
wp as (select w, j, case when j = 1 then substr(w, p, k) else '##' || substr(w, p, k) end as piece from gr where w in (select w from fit)
       union all select w, 1, '[UNK]' from (select w from dw union all select '') where w not in (select w from fit))"""

VOCAB_PIECES_SQL = f"""{TAGGED_SQL},
{VOCAB_SQL},
{SPLIT_WORDS_SQL},
pc as (select sent_id, pos, (list_position({LABELS_SQL_LIST}, gold) - 1) as lab, j, wp.piece, coalesce(voc.id, 100) as id
       from tagged join wp on wp.w = tagged.token left join voc on voc.piece = wp.piece),
pn as (select *, row_number() over (partition by sent_id order by pos, j) as k from pc)"""


def vocabulary(spark, sf_dir):
    """The vocabulary of ``VOCAB_SQL`` as (piece, id)."""
    w = (table(spark, sf_dir, "benchmark").select(F.explode(F.split(normalize_ws(F.col("text")), " ", -1)).alias("w")).distinct()
         .where("w <> ''"))
    starts = w.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(4), F.length("w"))), lambda k: F.substring(F.col("w"), F.lit(1), k))).alias("piece"))
    starts = starts.unionByName(w.select(F.col("w").alias("piece"))).where(~F.col("piece").startswith("##"))
    at = F.sequence(F.lit(2), F.length("w"))
    parts = (w.where(F.length("w") > 1).select("w", F.explode(at).alias("p"))
             .select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.length("w") - F.col("p") + 1)),
                                           lambda k: F.concat(F.lit("##"), F.substring(F.col("w"), F.col("p"), k)))).alias("piece")))
    pieces = starts.distinct().unionByName(parts.distinct())
    return dense_ids(pieces, "piece", "id").select("piece", (F.col("id") + 1000).cast("int").alias("id"))


def _expanded_by_vocabulary(spark, sf_dir):
    return P.expand_pieces(doc_sentences(spark, sf_dir), P.VocabularySplitter(vocabulary(spark, sf_dir)))


@register("expand_pieces_vocabulary", f"""with recursive {VOCAB_PIECES_SQL.lstrip()}
select sent_id, (count(*) + 2)::INTEGER as n_pieces, '[CLS] ' || string_agg(piece, ' ' order by k) || ' [SEP]' as pieces,
       '101,' || string_agg(id::VARCHAR, ',' order by k) || ',102' as piece_ids,
       '0' || string_agg(case when j = 1 then '1' else '0' end, '' order by k) || '0' as token_starts,
       string_agg(lab::VARCHAR, ',' order by k) filter (where j = 1) as labels
from pn group by sent_id
""")
def q_expand_pieces_vocabulary(spark, sf_dir):
    e = _expanded_by_vocabulary(spark, sf_dir)
    return e.select("sent_id", F.size("pieces").cast("int").alias("n_pieces"), F.array_join("pieces", " ").alias("pieces"),
                    F.array_join("piece_ids", ",").alias("piece_ids"), F.array_join("token_starts", "").alias("token_starts"),
                    F.array_join("labels", ",").alias("labels"))


B2I_SQL = """case when lab in (1, 3, 5, 7, 9, 11, 13) then lab + 1 else lab end"""


@register("align_piece_labels", f"""with {PIECES_SQL}
select sent_id, '-100,' || coalesce(string_agg((case when j = 1 then lab else {B2I_SQL} end)::VARCHAR, ',' order by k)
                                    filter (where k <= {MAX_LEN - 2}) || ',', '') || '-100' as aligned_labels
from pn group by sent_id
""")
def q_align_piece_labels(spark, sf_dir):
    a = P.align_piece_labels(_expanded(spark, sf_dir), label_all_tokens=True, max_len=MAX_LEN)
    return a.select("sent_id", F.array_join("aligned_labels", ",").alias("aligned_labels"))


@register("pad_batches", f"""with {PIECES_SQL},
enc as (select sent_id, [101] || list(1000 + length(piece) order by k) || [102] as ids,
               [0] || list(case when j = 1 then 1 else 0 end order by k) || [0] as st,
               list(lab order by k) filter (where j = 1) as labs
        from pn group by sent_id),
b as (select *, (row_number() over (order by sent_id) - 1) // 8 as batch_id from enc),
cut as (select sent_id, batch_id, ids[1:{MAX_LEN}] as ids, st[1:{MAX_LEN}] as st,
               labs[1:list_sum(st[1:{MAX_LEN}])::INTEGER] as labs from b),
w as (select *, least(ceil(max(len(ids)) over (partition by batch_id) / 8) * 8, {MAX_LEN})::INTEGER as wd,
             max(len(labs)) over (partition by batch_id) as lw from cut),
p as (select sent_id, batch_id, wd as width,
             (ids || list_transform(range(wd - len(ids)), lambda x: 0)) as pids,
             (st || list_transform(range(wd - len(st)), lambda x: 0)) as pst,
             (labs || list_transform(range(lw - len(labs)), lambda x: -1)) as plab from w)
select sent_id, batch_id, width, array_to_string(pids, ',') as input_ids,
       array_to_string(list_transform(pids, lambda x: case when x <> 0 then 1 else 0 end), ',') as attention_mask,
       array_to_string(pst, ',') as token_starts, array_to_string(plab, ',') as labels
from p
""")
def q_pad_batches(spark, sf_dir):
    e = _expanded(spark, sf_dir).withColumn("input_ids", P.piece_ids(F.col("pieces")))
    # batch ids are numbered on the sentence keys only, then joined back
    keys = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sent_id"))
    b = e.select("sent_id", "input_ids", "token_starts", "labels").join(
        sequential_batches(keys, "sent_id", 8), "sent_id")
    p = P.pad_batches(b, "batch_id", "input_ids", "token_starts", "labels", pad_id=0, max_len=MAX_LEN,
                      multiple_of=8)
    return p.select("sent_id", "batch_id", F.col("width").cast("int").alias("width"),
                    *[F.array_join(c, ",").alias(c) for c in ("input_ids", "attention_mask", "token_starts",
                                                               "labels")])


@register("gather_first_pieces", f"""with {PIECES_SQL}
select sent_id, string_agg(piece, ' ' order by k) filter (where j = 1) as first_pieces from pn group by sent_id
""")
def q_gather_first_pieces(spark, sf_dir):
    g = P.gather_first_pieces(_expanded(spark, sf_dir), "pieces", "token_starts", "first_pieces")
    return g.select("sent_id", F.array_join("first_pieces", " ").alias("first_pieces"))


@register("pieces_to_words", f"""with {TAGGED_SQL}
select sent_id, pos, token as word, case when token = '' then 'O' else gold end as tag from tagged
""")
def q_pieces_to_words(spark, sf_dir):
    # the vocabulary's pieces, unknown ones among them
    e = _expanded_by_vocabulary(spark, sf_dir)
    # predicted piece tags: a word's first piece carries the word's tag, the
    # continuation pieces carry O, special pieces O
    per_piece = P.repeat_per_word(F.col("tags"), F.col("word_piece_counts"))
    starts = F.slice("token_starts", 2, F.greatest(F.size("token_starts") - 2, F.lit(0)))
    piece_tags = F.concat(
        F.array(F.lit("O")),
        F.zip_with(per_piece, starts, lambda t, st: F.when(st == 1, t).otherwise(F.lit("O"))),
        F.array(F.lit("O")))
    return P.pieces_to_words(e.select("sent_id", "pieces", "token_starts", piece_tags.alias("piece_tags"), F.col("tokens").alias("words")),
                             starts_col="token_starts")


@register("fill_truncated", f"""with {TAGGED_SQL}
select sent_id, pos, token, case when pos < 50 then pred else 'O' end as tag from tagged
""")
def q_fill_truncated(spark, sf_dir):
    t = doc_tokens(spark, sf_dir)
    words = t.select("sent_id", "pos", "token")
    preds = t.where(F.col("pos") < 50).select("sent_id", "pos", F.col("pred").alias("tag"))
    return P.fill_truncated(words, preds)
