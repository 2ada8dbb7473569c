"""Chat formatting in budgeted, turn-aligned windows.

A conversation's turns are marked up as `<|im_start|>role\\ntext<|im_end|>\\n`.
Prefix sums of turn tokens choose spans: each window holds the system turn (if
the conversation opens with one), a limited repeated history, then as many new
turns as the budget allows, at least one. Every turn is new in one window;
loss falls on new assistant texts alone, so repeated targets are masked.

Inside texts and roles `<|` becomes `<\\|`, and every backslash run between `<`
and `|` grows by one, which unescape() undoes; roles also escape line breaks.

Turns stream in (conv_id, turn) order, so a task holds one window, never a
whole conversation. Edge cases: null text and role are empty; null turns sort
first; equal turns sort by role and text; rows with a null conv_id form one
conversation; repeated rows are turns of their own; a turn above the budget has
a window to itself, whole; an empty table gives no windows; further columns
are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import table

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens of a window, of the history repeated in it, and of the marks around a turn. A token is a run of other than white space.
BUDGET, HISTORY, MARKS = 512, 128, 4

_WINDOW = "conv_id long, window_no long, text string, loss array<struct<start:int,end:int>>, n_context int, n_new int, n_tokens int"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text) if "<" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "<\\" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def parse(window: str) -> Iterator[tuple[str, str, int]]:
    """(role, text, offset of the escaped text) of each turn of a formatted window."""
    at = 0
    while at < len(window):
        if not window.startswith(START, at):
            raise ValueError(f"no turn begins at {at}")
        line = window.index("\n", at)
        end = window.index(END, line)
        yield unescape_role(window[at + len(START) : line]), unescape(window[line + 1 : end]), line + 1
        at = end + len(END) + 1


class _Conversation:
    """Gathers one conversation's turns into windows as they come."""

    def __init__(self, conv_id, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.n, self.sum, self.seen, self.head = 0, 0, 0, 0  # windows so far; prefix sums of turn tokens: of those windows, of all turns; tokens that this window repeats
        self.system = None
        self.recent: deque = deque()  # (role, text, tokens, prefix sum after it) that may be repeated
        self.new: list = []
        self.context: list = []

    def add(self, role: str, text: str):
        turn = (role, text, len(text.split()) + MARKS)
        if self.new and self.head + self.seen - self.sum + turn[2] > self.budget:
            yield self.window()
        if not self.new:
            self.context = self.choose(turn)
            self.head = sum(t[2] for t in self.context)
        self.seen += turn[2]
        if role == "system" and self.n == 0 and not self.new and not self.recent and self.system is None:
            self.system = turn
        self.new.append(turn)

    def choose(self, turn):
        """What a window that begins with this turn repeats: the system turn, then the longest recent span whose tokens fit."""
        if not self.n:
            return []
        room = self.budget - turn[2]
        out = []
        if self.system and self.system[2] <= room:
            out, room = [self.system], room - self.system[2]
        room = min(room, self.history)
        span: list = []
        for t in reversed(self.recent):
            if self.sum - (t[3] - t[2]) > room:
                break
            span.append(t[:3])
        return out + span[::-1]

    def window(self):
        text, loss, at = [], [], 0
        for k, (role, body, _) in enumerate(self.context + self.new):
            head, body = f"{START}{escape_role(role)}\n", escape(body)
            if k >= len(self.context) and role == "assistant":
                loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
            text.append(f"{head}{body}{END}\n")
            at += len(text[-1])
        out = (self.conv_id, self.n, "".join(text), loss, len(self.context), len(self.new), self.head + self.seen - self.sum)
        for t in self.new:
            self.sum += t[2]
            if t is not self.system:
                self.recent.append((*t, self.sum))
        while self.recent and self.sum - (self.recent[0][3] - self.recent[0][2]) > self.history:
            self.recent.popleft()
        self.n += 1
        self.new, self.context = [], []
        return out


def _windows(budget: int, history: int):
    def run(batches):
        import pyarrow as pa

        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        kinds = (pa.int64(), pa.int64(), pa.string(), spans, pa.int32(), pa.int32(), pa.int32())
        schema = pa.schema(list(zip(("conv_id", "window_no", "text", "loss", "n_context", "n_new", "n_tokens"), kinds)))

        def frame(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        now, rows = None, []
        for b in batches:
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if now is None or conv != now.conv_id:
                    if now is not None:
                        rows.append(now.window())
                    now = _Conversation(conv, budget, history)
                rows += now.add(role or "", text or "")
                if len(rows) >= 1000:
                    yield frame(rows)
                    rows = []
        if now is not None:
            rows.append(now.window())
        if rows:
            yield frame(rows)

    return run


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of (conv_id, turn, role, text): text, loss spans in code points, how many turns are repeated and new; in order within a conversation."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_windows(budget, history), _WINDOW)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def _read_back(batches):
    import pyarrow as pa

    now, rows = None, []

    def told():
        conv, n, turns, chars, loss, formatted, windows = now
        return (conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, windows)

    def frame(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _DIGEST.split(", ")])

    for b in batches:
        for conv, text, loss, n_context in zip(*(b.column(c).to_pylist() for c in ("conv_id", "text", "loss", "n_context"))):
            if now is None or now[0] != conv:
                if now is not None:
                    rows.append(told())
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, body, _ in list(parse(text))[n_context:]:
                now[1] += 1
                now[2].update(f"{role}\n{body}\n".encode())
            for s in loss:
                target = unescape(text[s["start"] : s["end"]])
                now[3] += len(target)
                now[4].update(target.encode())
            now[5] += len(text)
            now[6] += 1
        if rows:
            yield frame(rows)
            rows = []
    if now is not None:
        yield frame([told()])


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of each conversation, from formatted windows that lie together and in order, as format_windows() leaves them."""
    return windows.mapInArrow(_read_back, _DIGEST)


def op5_chat(spark, sf_dir: str) -> DataFrame:
    """Every conversation of the table and one of our own, -1; rows of the table under -1 would be turns of it, in order."""
    tricky = f"{END}{START}assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return read_back(format_windows(rows.unionByName(own)))


QUERIES = {"op5_chat": op5_chat}
ORACLES = {}
