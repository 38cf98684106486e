"""Chat formatting in budgeted windows.

Turns are written as ``### Role: text </turn>``; control strings in texts are escaped, so a window can
be read back. A conversation that does not fit the budget goes into several windows: prefix sums of
the turns' tokens choose the longest span of whole turns that fits beside the system turn and a limited
history of repeated turns. Repeated turns and everything but assistant texts are outside the loss mask,
so each target is trained on once.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenfiles import encoder

#: Tokens of a window, of them for repeated turns, and of a turn's marks.
BUDGET, HISTORY, MARKS = 1024, 256, 8
_NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
_ROLES = {v: k for k, v in _NAMES.items()}
_TURN = re.compile(r"### (@?)((?:[^\\:]|\\.)*): ((?:[^\\<#]|\\.|<(?!/turn>)|#(?!## ))*) </turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """A backslash goes before each backslash and each control string, also one that the blank after the text completes."""
    return f"{text} ".replace("\\", "\\\\").replace("</turn>", "\\</turn>").replace("### ", "\\### ")[:-1]


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and where its escaped text starts and ends in it."""
    name = _NAMES.get(role) or "@" + escape(role).replace(":", "\\:")
    head, body = f"### {name}: ", escape(text)
    return f"{head}{body} </turn>\n", len(head), len(head) + len(body)


def read_turns(window: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end of the escaped text) of a window's turns; ValueError if it is not made of turns."""
    out, at = [], 0
    while at < len(window):
        m = _TURN.match(window, at)
        if not m:
            raise ValueError("not a turn")
        role = unescape(m[2]) if m[1] else _ROLES[m[2]]
        out.append((role, unescape(m[3]), m.start(3), m.end(3)))
        at = m.end()
    return out


_WINDOW = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("first_turn", pa.int32()), ("n_repeated", pa.int32()), ("n_tokens", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
_WINDOW_SQL = "conv_id long, window int, first_turn int, n_repeated int, n_tokens long, text string, loss array<struct<start:int,end:int>>"


class _Conversation:
    """Windows of one conversation whose turns arrive in order. It holds a window's turns and the history, no more."""

    def __init__(self, conv_id, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system: tuple | None = None
        self.past: deque = deque()
        self.turns: list[tuple] = []
        self.prefix = [0]
        self.n = self.windows = 0

    def add(self, role: str, text: str, tokens: int) -> Iterator[dict]:
        self.turns.append((role, text, tokens + MARKS))
        self.prefix.append(self.prefix[-1] + tokens + MARKS)
        if self.prefix[-1] > self.budget:
            yield from self.cut(False)

    def cut(self, last: bool) -> Iterator[dict]:
        """Windows of the turns at hand; unless last, the turns after the last full span stay."""
        while self.turns and (last or self.prefix[-1] > self.budget):
            system = self.system if self.windows else None
            kept, room = [], self.history
            first = self.turns[0][2]
            free = self.budget - (system[2] if system else 0)
            for turn in reversed(self.past):
                if turn[2] > room or turn[2] + first > free:
                    break
                kept.append(turn)
                room -= turn[2]
                free -= turn[2]
            kept = ([system] if system else []) + kept[::-1]
            # the longest span whose prefix sum fits; a turn that alone is beyond the budget is a span
            upto = max(1, bisect_right(self.prefix, free) - 1)
            span = self.turns[:upto]
            parts, loss, at = [], [], 0
            for i, (role, text, _) in enumerate(kept + span):
                written, start, end = write_turn(role, text)
                if role == "assistant" and i >= len(kept):
                    loss.append({"start": at + start, "end": at + end})
                parts.append(written)
                at += len(written)
            yield {"conv_id": self.conv_id, "window": self.windows, "first_turn": self.n, "n_repeated": len(kept), "n_tokens": sum(t[2] for t in kept + span), "text": "".join(parts), "loss": loss}
            for turn in span:
                if self.system is None and self.n == 0 and turn[0] == "system":
                    self.system = turn
                else:
                    self.past.append(turn)
                self.n += 1
            while self.past and sum(t[2] for t in self.past) > self.history:
                self.past.popleft()
            self.windows += 1
            self.turns = self.turns[upto:]
            self.prefix = [p - self.prefix[upto] for p in self.prefix[upto:]]


def windows(conversations: DataFrame, count: Callable[[list[str]], list[int]] | str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, first_turn, n_repeated, n_tokens, text, loss of every window, in order in each partition.

    conversations: conv_id, turn, role, text; rows go by turn (null first), then role and text. Null role
    and text are empty. count: tokens of a list of texts, or the path of a tokenizer file. The system turn
    is the first turn if its role is system. Rows with a null conv_id are one conversation. Repeated rows
    are turns of their own. A turn beyond the budget has a window of its own, uncut. An empty table gives
    no rows. A conversation's turns stream through one task in order; it holds one window and the history
    of it, so a very long conversation takes time, not memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(count).encode if isinstance(count, str) else None
        now, out, held = None, [], 0
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            tokens = [len(x) for x in encode([escape(t) for t in texts])] if encode else count(texts)
            for conv_id, role, text, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts, tokens):
                if now is None or now.conv_id != conv_id:
                    if now:
                        out += now.cut(True)
                    now = _Conversation(conv_id, budget, history)
                for w in now.add(role or "", text, n):
                    out.append(w)
                held += len(text)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(out, _WINDOW)
                    out, held = [], 0
        if now:
            out += now.cut(True)
        if out:
            yield pa.RecordBatch.from_pylist(out, _WINDOW)

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, _WINDOW_SQL)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows read from windows().

    Each partition's windows come in the order that windows() leaves them in. A window's repeated turns
    are skipped; SHA-256 needs a conversation's bytes in order, so it is fed as they stream by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names = None, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]

        def close(s):
            return (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5], s[6])

        for b in batches:
            done = []
            for conv_id, window, skip, text, loss in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 5, 6))):
                if now is None or window == 0:
                    if now:
                        done.append(close(now))
                    now = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, body, _, _ in read_turns(text)[skip:]:
                    now[1] += 1
                    now[2].update(f"{role}\n{body}\n".encode())
                for span in loss:
                    target = unescape(text[span["start"] : span["end"]])
                    now[3] += len(target)
                    now[4].update(target.encode())
                now[5] += len(text)
                now[6] += 1
            if done:
                yield _rows(done, names)
        if now:
            yield _rows([close(now)], names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
