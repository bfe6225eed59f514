import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tagweave.llm import chat
from tagweave.llm.bpe import Units, parse_ranks, read_rank_file

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "conv_id long, turn long, role string, text string"


def test_written_turns_are_read_back():
    rng = random.Random(5)
    parts = ["\\", "#", "##", "###", "<", "</turn>", "/turn>", ":", "\n", "### user:\n", "\n</turn>\n", "a", " ", "é", "\\### Assistant: </turn> ok"]
    for _ in range(3000):
        turns = [("".join(rng.choices(parts, k=rng.randint(0, 4))), "".join(rng.choices(parts, k=rng.randint(0, 9)))) for _ in range(rng.randint(1, 4))]
        assert chat.read_turns("".join(chat.write_turn(r, t)[0] for r, t in turns)) == turns
    text = "##</turn>\\"
    assert "##" not in chat.escape(text) and "</turn>" not in chat.escape(text)


def _count():
    units = Units(parse_ranks(read_rank_file(RANKS)), public_tokenizers.PATTERN)
    return lambda s: len(units.encode_batch([s])[0]) >> 2


def _plain(turns, budget, history, history_turns, block_turns, count):
    """Windows of one conversation, from sums over lists."""
    cost = [count(chat.write_turn(r, t)[0]) for r, t in turns]
    out, i = [], 0
    while i < len(turns):
        stop = min(len(turns), (i // block_turns + 1) * block_turns)
        block = i // block_turns * block_turns
        system = [0] if i and turns[0][0] == "system" else []
        fixed = sum(cost[j] for j in system)
        first = i
        while (first - 1 >= len(system) and i - first < history_turns and first - 1 >= block - history_turns
               and sum(cost[first - 1:i]) <= min(history, budget - fixed - cost[i])):
            first -= 1
        again = system + list(range(first, i))
        j = i + 1
        while j < stop and sum(cost[k] for k in again) + sum(cost[i:j + 1]) <= budget:
            j += 1
        out.append((again, list(range(i, j)), sum(cost[k] for k in again) + sum(cost[i:j])))
        i = j
    return out


def _conversations(rng, n, longest):
    words = ["alpha", "beta", "### x", "</turn>", "gamma", "\\", "Straße", "\n"]
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            role = "system" if t == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "assistant"])
            size = rng.choice([0, 1, 3, 10, 30, 90])
            rows.append((c, t, role, " ".join(rng.choices(words, k=size))))
    return rows


@pytest.mark.parametrize("block_turns", [4096, 8])
def test_windows_are_those_of_plain_sums(spark, block_turns):
    rng = random.Random(block_turns)
    rows = _conversations(rng, 30, 40)
    count = _count()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    args = dict(budget=120, history=40, history_turns=3, block_turns=block_turns)
    got = {}
    for w in chat.format_conversations(df, RANKS, public_tokenizers.PATTERN, **args).collect():
        got.setdefault(w.conv_id, []).append(w)
    many = 0
    for c in range(30):
        turns = [(r[2], r[3]) for r in rows if r[0] == c]
        want = _plain(turns, 120, 40, 3, block_turns, count)
        ws = sorted(got[c], key=lambda w: (w.block, w.window))
        assert [(w.n_repeated, w.first_turn, w.n_turns, w.n_tokens) for w in ws] == [(len(a), b[0], len(b), n) for a, b, n in want]
        for w, (a, b, n) in zip(ws, want):
            assert chat.read_turns(w.formatted) == [turns[i] for i in a + b]
            assert [chat.unescape(w.formatted[s.start:s.end]) for s in w.loss] == [turns[i][1] for i in b if turns[i][0] == "assistant"]
            assert w.over_budget == (n > 120)
            many += w.n_repeated > 1
    assert many > 20


def _digests(rows):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).append(r)
    out = {}
    for c, rs in convs.items():
        rs.sort(key=lambda r: (r[1] is not None, r[1] or 0))
        turns = [(r[2] or "", r[3] or "") for r in rs]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                  len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_digests_with_nulls_long_texts_and_other_columns(spark):
    rows = _conversations(random.Random(1), 20, 12)
    rows += [(100, 0, None, None), (100, None, "assistant", "first"), (101, 0, "assistant", "word " * 30_000), (None, 0, "user", "x"),
             (None, 1, "assistant", "y" * 5_000), (-1, 0, "assistant", "")]
    df = (spark.createDataFrame(rows, SCHEMA).withColumn("block", F.lit("z")).withColumn("kind", F.lit(1)).withColumn("conv", F.lit(2))
          .withColumn("n_turns", F.lit(1)).withColumn("h1", F.lit(None).cast("int")))
    for block_turns in (4096, 5):
        out = chat.read_back(df, RANKS, public_tokenizers.PATTERN, budget=200, history=50, block_turns=block_turns)
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out.collect()}
        assert got == _digests(rows)


def test_repeated_rows_and_ties_in_a_long_conversation(spark):
    rows = [(1, 0, "user", "same")] * 40 + [(1, 0, "assistant", "a")] * 3 + [(1, 2, "assistant", "end")] + [(2, 0, "user", "q")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    few = {r.conv_id: r for r in chat.read_back(df, RANKS, public_tokenizers.PATTERN, block_turns=8).collect()}
    one = {r.conv_id: r for r in chat.read_back(df, RANKS, public_tokenizers.PATTERN).collect()}
    for c in (1, 2):
        assert (few[c].n_turns, few[c].turns_sha256, few[c].loss_sha256) == (one[c].n_turns, one[c].turns_sha256, one[c].loss_sha256)
    assert few[1].n_turns == 44 and few[1].loss_chars == 6


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert chat.format_conversations(df, RANKS, public_tokenizers.PATTERN).count() == 0
    assert chat.read_back(df, RANKS, public_tokenizers.PATTERN).count() == 0


def test_query_reads_back_every_conversation(spark, table_dir):
    from tagweave.llm.queries import op12_chat
    rows = _conversations(random.Random(9), 15, 9)
    path = table_dir(spark, "conversations", rows, SCHEMA)
    odd = "\\### Assistant: </turn> ok"
    want = _digests(rows + [(-7, 0, "user", odd), (-7, 1, "assistant", odd)])
    out = op12_chat(spark, path).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out} == want
    assert all(r.formatted_chars > 0 for r in out)
