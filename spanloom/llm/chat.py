"""Chat formatting in budgeted windows: turn-aligned spans by prefix sums of turn tokens."""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN = re.compile(r"<turn ([^>]*)>\n([^<]*)\n</turn>\n")
_CODES = {"\\": "\\\\", "<": "\\l", ">": "\\g", "\n": "\\n"}
_BACK = {v[1]: k for k, v in _CODES.items()}
WINDOWS = "conv_id long, window long, formatted string, loss array<struct<start:long,end:long>>, new_from long, tokens long, over_budget boolean"


def escape(text: str, role: bool = False) -> str:
    """No control string of the template can stand in an escaped text: it has no <."""
    text = text.replace("\\", "\\\\").replace("<", "\\l")
    return text.replace(">", "\\g").replace("\n", "\\n") if role else text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text, flags=re.S) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn, and from where to where its text stands in it."""
    head = f"<turn {escape(role, True)}>\n"
    body = escape(text)
    return f"{head}{body}\n</turn>\n", len(head), len(head) + len(body)


def token_counter(tokenizer_file: str | None):
    """Counts with a public tokenizer's file (JSON), or about four bytes a token."""
    if tokenizer_file is None:
        return lambda text: -(-len(text.encode()) // 4)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


class _Conversation:
    """Windows of one conversation, made as its turns come; holds one window and the turns that may be repeated."""

    def __init__(self, conv_id, budget: int, history: int, count):
        self.id, self.budget, self.history, self.count = conv_id, budget, history, count
        self.system: list[tuple[str, int]] = []
        self.only_system = True
        self.recent: deque[tuple[str, int]] = deque()
        self.recent_tokens = self.window = self.tokens = self.fixed = 0
        self.open: list[tuple[str, int, int, bool]] = []
        self.context = ""

    def add(self, role: str, text: str) -> Iterator[tuple]:
        turn, a, b = render(role, text)
        n = self.count(turn)
        if self.open and self.fixed + self.tokens + n > self.budget:
            yield self.close()
            self.context = "".join(t for t, _ in self.system)
            self.fixed = sum(m for _, m in self.system)
            keep, total = [], 0
            for t, m in reversed(self.recent):
                if total + m > self.history or self.fixed + total + m + n > self.budget:
                    break
                keep.append(t)
                total += m
            self.context += "".join(reversed(keep))
            self.fixed += total
        self.open.append((turn, a, b, role == "assistant"))
        self.tokens += n
        self.only_system = self.only_system and role == "system"
        if self.only_system:
            self.system.append((turn, n))
        else:
            self.recent.append((turn, n))
            self.recent_tokens += n
            while self.recent and self.recent_tokens - self.recent[0][1] > self.history:
                self.recent_tokens -= self.recent.popleft()[1]

    def close(self) -> tuple:
        at, loss = len(self.context), []
        for turn, a, b, target in self.open:
            if target and b > a:
                loss.append({"start": at + a, "end": at + b})
            at += len(turn)
        total = self.fixed + self.tokens
        row = (self.id, self.window, self.context + "".join(t for t, *_ in self.open), loss, len(self.context), total, total > self.budget)
        self.window += 1
        self.open, self.tokens = [], 0
        return row


def format_conversations(turns: DataFrame, budget: int = 512, history: int = 128, tokenizer_file: str | None = None) -> DataFrame:
    """Rows of WINDOWS from conv_id, turn, role, text; other columns are not read.

    A window holds whole turns, as many as ``budget`` tokens allow, and one at least (over_budget: that
    turn alone is too long). Windows after the first begin with the conversation's leading system turns
    and with its latest turns, up to ``history`` tokens; new turns start at character new_from. loss has
    the places of assistant texts of new turns only, so a repeated target is masked. Turns stream through
    the task that sorts them: a very long conversation is never held whole.

    Null texts and roles are empty; rows with equal turns are ordered by role and text; null turns come
    last; rows without conv_id are one conversation. An empty table gives no windows."""

    def kernel(frames):
        count, now, out = token_counter(tokenizer_file), None, []
        for frame in frames:
            for conv, role, text in zip(frame["conv"], frame["role"], frame["text"], strict=True):
                conv = None if conv is None else int(conv)
                if now is None or conv != now.id:
                    if now is not None:
                        out.append(now.close())
                    now = _Conversation(conv, budget, history, count)
                out += now.add(role, text)
                if len(out) >= 500:
                    yield _frame(out)
                    out = []
        if now is not None:
            out.append(now.close())
        if out:
            yield _frame(out)

    t = turns.select(F.col("conv_id").cast("long").cast("string").alias("conv"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_last(), "role", "text").select("conv", "role", "text")
    return t.mapInPandas(kernel, WINDOWS)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["conv_id", "window", "formatted", "loss", "new_from", "tokens", "over_budget"])
    frame["conv_id"] = frame["conv_id"].astype("Int64")
    return frame


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of formatted windows alone."""

    def kernel(frames):
        def row():
            return (conv, n, turns.hexdigest(), chars, loss.hexdigest(), size)

        begun, out = False, []
        conv = n = turns = loss = chars = size = None
        for frame in frames:
            for c, text, spans, new in zip(frame["conv"], frame["formatted"], frame["loss"], frame["new_from"], strict=True):
                if not begun or c != conv:
                    if begun:
                        out.append(row())
                    begun, conv, n, chars, size, turns, loss = True, c, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, body in TURN.findall(text, int(new)):
                    turns.update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                    n += 1
                for s in spans:
                    own = unescape(text[int(s["start"]) : int(s["end"])])
                    chars += len(own)
                    loss.update(own.encode())
                size += len(text)
            if out:
                yield _digests(out)
                out = []
        if begun:
            yield _digests([row()])

    w = windows.select(F.col("conv_id").cast("string").alias("conv"), "window", "formatted", "loss", "new_from")
    w = w.repartition("conv").sortWithinPartitions("conv", "window")
    return w.mapInPandas(kernel, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    frame["conv_id"] = pd.array([None if x is None else int(x) for x in frame["conv_id"]], dtype="Int64")
    return frame
