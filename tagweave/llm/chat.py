"""Chat formatting in budgeted windows (operator 12).

Template.  A turn is written as ``### role:`` + newline, the text, newline +
``</turn>`` + newline.  In a text a backslash is put behind the first sign of
every ``##`` and ``</turn>`` and before every backslash; in a role before
every backslash, colon, newline, ``#`` and ``<``.  A backslash always stands
for "take the next sign as it is", so control strings never occur inside a
text and every text is read back exactly.

Windows.  The turns of a conversation, by ``turn``, are written out one after
the other; running sums of their tokens (the written turn, by the given
byte-level BPE) decide where a window ends: a window holds the longest row of
new turns whose sum stays within ``budget``.  Every window but the first
retains the leading system turn and repeats the turns just before its new ones,
at most ``history_turns`` of them with at most ``history`` tokens together
(fewer where the first new turn needs the room).  Turns are never cut: a turn
that alone exceeds the budget has a window of its own (``over_budget``).

Loss.  Only new assistant turns are targets; repeated ones are masked, so each
assistant text lies under the mask exactly once.

Scale.  Conversations meet in sorted partitions and are written as a stream, a
window at a time.  A window also ends after every ``block_turns`` turns of a
conversation, which makes blocks the unit of work: a conversation of more turns
(found by a count) is numbered by a distributed sort of light keys and dealt
over its blocks, each with the system turn and the history it needs.

Edge cases: null text and null role count as empty; null conversation ids are
one conversation; null turns come first; equal turns are ordered by role, then
by a hash of the text; repeated rows are separate turns; an empty table gives no
window; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.llm.bpe import Units, parse_ranks, read_rank_file
from tagweave.operators.sampling import group_dense_ids

BUDGET = 1_024
HISTORY = 256
HISTORY_TURNS = 4
BLOCK_TURNS = 4_096
SLICE_CHARS = 1 << 20
MAX_BROADCAST_ROWS = 500_000

_END = "\n</turn>\n"
_IN_TEXT = re.compile(r"\\|#(?=#)|<(?=/turn>)")
_IN_ROLE = re.compile(r"[\\:\n#<]")
_HEAD = re.compile(r"### ((?:\\.|[^\\:])*):\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _IN_TEXT.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """The written turn, and where its escaped text starts and ends."""
    head = "### " + _IN_ROLE.sub(lambda m: "\\" + m[0], role) + ":\n"
    body = escape(text)
    return head + body + _END, len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a window."""
    out, at = [], 0
    while at < len(formatted):
        head = _HEAD.match(formatted, at)
        end = formatted.find(_END, head.end() - 1) if head else -1
        if end < 0:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(head[1]), unescape(formatted[head.end():end])))
        at = end + len(_END)
    return out


class Turn:
    """A written turn; ``before`` is the sum of the tokens of all turns before
    it in its block."""
    __slots__ = ("role", "written", "start", "end", "tokens", "before")

    def __init__(self, role: str, text: str):
        self.role = role
        self.written, self.start, self.end = write_turn(role, text)
        self.tokens = self.before = 0


class Windows:
    """Windows of one block, turn by turn."""

    def __init__(self, leads: bool, budget: int, history: int, history_turns: int):
        self.leads = leads                     # the block holds the conversation's first turn
        self.budget, self.history, self.history_turns = budget, history, history_turns
        self.system: Turn | None = None
        self.recent: deque[Turn] = deque()
        self.new: list[Turn] = []
        self.again: list[Turn] = []
        self.room = self.total = self.done = 0

    def remember(self, turn: Turn) -> None:
        turn.before, self.total = self.total, self.total + turn.tokens
        self.recent.append(turn)
        while self.recent and (len(self.recent) > self.history_turns or self.total - self.recent[0].before > self.history):
            self.recent.popleft()

    def add(self, turn: Turn) -> dict | None:
        """Takes the next new turn; the window it closes, if any."""
        closed = None
        if self.new and self.total + turn.tokens - self.new[0].before > self.room:
            closed = self.close()
        if not self.new:
            fixed = self.system.tokens if self.system else 0
            spare = min(self.history, self.budget - fixed - turn.tokens)
            recent = [t for t in self.recent if t is not self.system]
            first = bisect_left(recent, True, key=lambda t: self.total - t.before <= spare)
            self.again = ([self.system] if self.system else []) + recent[first:]
            self.room = self.budget - sum(t.tokens for t in self.again)
        if self.leads and not self.done and not self.new and turn.role == "system":
            self.system = turn
        self.new.append(turn)
        self.remember(turn)
        return closed

    def close(self) -> dict | None:
        if not self.new:
            return None
        at, loss, parts = 0, [], []
        for i, t in enumerate(self.again + self.new):
            if i >= len(self.again) and t.role == "assistant":
                loss.append({"start": at + t.start, "end": at + t.end})
            parts.append(t.written)
            at += len(t.written)
        tokens = sum(t.tokens for t in self.again + self.new)
        out = {"first_turn": self.done, "n_turns": len(self.new), "n_repeated": len(self.again), "n_tokens": tokens,
               "over_budget": tokens > self.budget, "formatted": "".join(parts), "loss": loss}
        self.done += len(self.new)
        self.new = []
        return out


_WINDOW = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("window", T.LongType()), T.StructField("first_turn", T.LongType()),
    T.StructField("n_turns", T.LongType()), T.StructField("n_repeated", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("over_budget", T.BooleanType()), T.StructField("formatted", T.StringType()),
    T.StructField("loss", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
_SYSTEM, _HISTORY, _NEW = 0, 1, 2


def _cold(rows: DataFrame) -> DataFrame:
    """Rows of conversations within one block, in order."""
    return (rows.withColumn("block", F.lit(0).cast("long")).withColumn("kind", F.lit(_NEW)).repartition("conv")
            .sortWithinPartitions("conv", "turn", "role", "h1", "h2", "text").select("conv", "block", "kind", "role", "text"))


def _hot(rows: DataFrame, block_turns: int, history_turns: int) -> DataFrame:
    """Rows of longer conversations, numbered by light keys and dealt over
    blocks; equal rows are one row with a count until they are numbered."""
    keyed = rows.withColumn("c", F.xxhash64("conv", F.lit(0))).withColumn("k1", F.xxhash64("conv", "turn", "role", "text"))
    keyed = keyed.withColumn("k2", F.xxhash64("text", "role", "turn", "conv"))
    once = keyed.groupBy("conv", "turn", "role", "text", "h1", "h2", "c", "k1", "k2").agg(F.count(F.lit(1)).alias("copies"))
    light = once.select("c", "turn", "role", "h1", "h2", "k1", "k2", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    order = ["turn", "role", "h1", "h2", "k1", "k2", "copy"]
    at = group_dense_ids(light, ["c"], order, "at").select("k1", "k2", "at")
    last = light.groupBy("c").agg((F.floor((F.count(F.lit(1)) - 1) / block_turns)).alias("last_block"))
    turns = once.join(at, ["k1", "k2"]).join(last, "c").select("conv", "role", "text", "at", "last_block")
    own = F.floor(F.col("at") / block_turns)

    def into(block, kind):
        return F.struct(block.cast("long").alias("block"), F.lit(kind).alias("kind"))

    none = F.array().cast("array<struct<block:bigint,kind:int>>")
    leads = (F.col("at") == 0) & (F.col("role") == "system")
    later = F.when((F.pmod("at", F.lit(block_turns)) >= block_turns - history_turns) & (own < F.col("last_block")) & ~leads,
                   F.array(into(own + 1, _HISTORY))).otherwise(none)
    every = F.when(leads & (F.col("last_block") > 0),
                   F.transform(F.sequence(F.lit(1).cast("long"), "last_block"), lambda b: into(b, _SYSTEM))).otherwise(none)
    dealt = turns.select("conv", "role", "text", "at", F.explode(F.concat(F.array(into(own, _NEW)), later, every)).alias("to"))
    return (dealt.select("conv", "role", "text", "at", "to.*").repartition("conv", "block")
            .sortWithinPartitions("conv", "block", "kind", "at").select("conv", "block", "kind", "role", "text"))


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held > SLICE_CHARS:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _write(rows: DataFrame, rank_file: str, pattern: str, budget: int, history: int, history_turns: int, block_turns: int) -> DataFrame:
    """(conv, block, window, ...): the windows of sorted rows."""
    ranks = rows.sparkSession.sparkContext.broadcast(read_rank_file(rank_file))
    schema = T.StructType([T.StructField("conv", rows.schema["conv"].dataType), *_WINDOW.fields])
    arrow = pa.schema([(n, t) for n, t in [
        ("block", pa.int64()), ("window", pa.int64()), ("first_turn", pa.int64()), ("n_turns", pa.int64()), ("n_repeated", pa.int64()),
        ("n_tokens", pa.int64()), ("over_budget", pa.bool_()), ("formatted", pa.string()),
        ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(parse_ranks(ranks.value), pattern)
        key = block = state = None
        number = 0
        out: list[dict] = []
        keys: list = []
        kind_of_key = None

        def take(window: dict | None) -> None:
            nonlocal number
            if window:
                window["first_turn"] += block * block_turns
                out.append(window | {"block": block, "window": number})
                keys.append(key)
                number += 1

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pylist(out, schema=arrow)
            done = pa.RecordBatch.from_arrays([pa.array(keys, kind_of_key), *made.columns], names=["conv", *arrow.names])
            out.clear()
            keys.clear()
            return done

        for batch in batches:
            kind_of_key = batch.column(0).type
            convs, blocks, kinds, roles = (batch.column(i).to_pylist() for i in range(4))
            texts = batch.column(4).to_pylist()
            for a, b in _slices(texts):
                turns = [Turn(r, t) for r, t in zip(roles[a:b], texts[a:b])]
                for t, ids in zip(turns, units.encode_batch([t.written for t in turns])):
                    t.tokens = len(ids) >> 2
                for i, t in zip(range(a, b), turns):
                    if state is None or convs[i] != key or blocks[i] != block:
                        if state is not None:
                            take(state.close())
                        key, block, number = convs[i], blocks[i], 0
                        state = Windows(block == 0, budget, history, history_turns)
                    if kinds[i] == _SYSTEM:
                        state.system = t
                    elif kinds[i] == _HISTORY:
                        state.remember(t)
                    else:
                        take(state.add(t))
                if out:
                    yield flush()
        if state is not None:
            take(state.close())
        if out:
            yield flush()

    return rows.mapInArrow(run, schema)


def _branches(turns: DataFrame, rank_file: str, pattern: str, budget: int, history: int, history_turns: int, block_turns: int,
              conv: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """Windows of the conversations within one block, whose windows lie
    together in order, and of the longer ones (if any)."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = turns.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"),
                        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"), body.alias("text"),
                        F.xxhash64(body).alias("h1"), F.crc32(body.cast("binary")).alias("h2"))
    args = rank_file, pattern, budget, history, history_turns, block_turns
    long = turns.groupBy(F.col(f"`{conv}`").alias("conv")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block_turns).select("conv").checkpoint()
    n_long = long.count()
    if not n_long:
        return _write(_cold(rows), *args), None
    long = F.broadcast(long) if n_long <= MAX_BROADCAST_ROWS else long
    same = rows["conv"].eqNullSafe(long["conv"])
    return (_write(_cold(rows.join(long, same, "left_anti")), *args),
            _write(_hot(rows.join(long, same, "left_semi"), block_turns, history_turns), *args))


def format_conversations(turns: DataFrame, rank_file: str, pattern: str, budget: int = BUDGET, history: int = HISTORY,
                         history_turns: int = HISTORY_TURNS, block_turns: int = BLOCK_TURNS, conv: str = "conv_id",
                         turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per window: ``conv``, block, window (from 0 in a block),
    first_turn (position of the first new turn), n_turns (new ones), n_repeated
    (turns repeated before them), n_tokens, over_budget, formatted, and loss
    (spans of ``formatted`` in code points, end exclusive)."""
    cold, hot = _branches(turns, rank_file, pattern, budget, history, history_turns, block_turns, conv, turn, role, text)
    return (cold if hot is None else cold.unionByName(hot)).withColumnRenamed("conv", conv)


def _read(windows: DataFrame) -> DataFrame:
    """Windows read back: what they add to their conversation."""
    schema = T.StructType([T.StructField("conv", windows.schema["conv"].dataType)])
    for name, kind in (("block", "long"), ("window", "long"), ("n_turns", "long"), ("turns", "binary"),
                       ("loss_chars", "long"), ("loss", "binary"), ("chars", "long")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_turns, turns, loss_chars, loss, chars = [], [], [], [], []
            formatted = batch.column("formatted")
            for i, again in enumerate(batch.column("n_repeated").to_pylist()):
                w = formatted[i].as_py()
                new = read_turns(w)[again:]
                under = "".join(unescape(w[s["start"]:s["end"]]) for s in batch.column("loss")[i].as_py())
                n_turns.append(len(new))
                turns.append("".join(f"{r}\n{t}\n" for r, t in new).encode())
                loss_chars.append(len(under))
                loss.append(under.encode())
                chars.append(len(w))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("block"), batch.column("window"), pa.array(n_turns, pa.int64()), pa.array(turns, pa.binary()),
                 pa.array(loss_chars, pa.int64()), pa.array(loss, pa.binary()), pa.array(chars, pa.int64())], names=schema.names)

    return windows.select("conv", "block", "window", "n_repeated", "formatted", "loss").mapInArrow(run, schema)


def _digest(parts: DataFrame) -> DataFrame:
    """Rows of a conversation, together and in order -> one row each."""
    schema = T.StructType([parts.schema["conv"]])
    for name, kind in (("n_turns", "long"), ("turns_sha256", "string"), ("loss_chars", "long"), ("loss_sha256", "string"), ("formatted_chars", "long")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def rows():
            nonlocal kind
            for b in batches:
                kind = b.column(0).type
                numbers = [b.column(n).to_pylist() for n in ("conv", "n_turns", "loss_chars", "chars")]
                turns, loss = b.column("turns"), b.column("loss")
                yield from ((c, n, lc, ch, turns[i].as_py(), loss[i].as_py()) for i, (c, n, lc, ch) in enumerate(zip(*numbers)))

        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out))
            kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=schema.names)
            out.clear()
            return done

        for key, group in groupby(rows(), key=lambda r: r[0]):
            whole, targets, n, lc, ch = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for r in group:
                n, lc, ch = n + r[1], lc + r[2], ch + r[3]
                whole.update(r[4])
                targets.update(r[5])
            out.append((key, n, whole.hexdigest(), lc, targets.hexdigest(), ch))
            if len(out) == 4096:
                yield flush()
        if out:
            yield flush()

    return parts.mapInArrow(run, schema)


def read_back(turns: DataFrame, rank_file: str, pattern: str, budget: int = BUDGET, history: int = HISTORY,
              history_turns: int = HISTORY_TURNS, block_turns: int = BLOCK_TURNS, conv: str = "conv_id",
              turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Formats, reads every window back and digests each conversation:
    ``conv``, n_turns, turns_sha256 (role, newline, text, newline per turn),
    loss_chars, loss_sha256 (all text under the mask), formatted_chars.

    Windows of a long conversation are read in parallel; only their bytes meet
    in order, as a stream, for the one digest."""
    cold, hot = _branches(turns, rank_file, pattern, budget, history, history_turns, block_turns, conv, turn, role, text)
    out = _digest(_read(cold))
    if hot is not None:
        out = out.unionByName(_digest(_read(hot).repartition("conv").sortWithinPartitions("conv", "block", "window")))
    return out.withColumnRenamed("conv", conv)
