"""Training windows from conversations.

Turns are written as ``<|im_start|>role\\ntext<|im_end|>\\n``.  Prefix sums of turn
tokens choose turn-aligned spans under a token budget; every window keeps the
system turn, repeats limited history, and masks targets that an earlier window
has trained on.  Control strings inside roles and texts are escaped reversibly.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, small_batches, table

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that chat templates give a meaning; none of them is left inside a formatted text.
CONTROL = (START, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>")
#: Tokens a window may hold, and those of them that repeated history may take.
BUDGET, HISTORY = 1024, 256

_ESCAPE = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_UNESCAPE = re.compile(r"\\([\\\-n])")
_TOKENS = re.compile(r"\w+|[^\w\s]")
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.S)


def escape(text: str) -> str:
    """Backslashes are doubled; a control string gets ``\\-`` after its first character."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\-" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: {"\\": "\\", "-": "", "n": "\n"}[m[1]], text)


def count_tokens(text: str) -> int:
    """Words and single signs; ``format_chats`` takes any other counter instead."""
    return sum(1 for _ in _TOKENS.finditer(text))


class Windows:
    """Builds the windows of one conversation from its turns, as they come; holds one window and its history."""

    def __init__(self, budget: int = BUDGET, history: int = HISTORY, tokens=count_tokens):
        self.budget, self.history, self.tokens = budget, history, tokens
        self.system: tuple | None = None
        self.turns: list[tuple[str, str, int]] = []
        self.sums = [0]  # of the tokens of ``turns``
        self.fresh = 0  # turns before this one are repeated
        self.seen = False

    def add(self, role: str, text: str):
        """Takes the next turn; a finished window or None."""
        turn = (role, text, self.tokens(text) + self.tokens(role) + 2)
        out = None
        if not self.seen and role == "system":
            self.system = turn
        spare = self.budget - (self.system[2] if self.system else 0)
        if self.system is not turn:
            if len(self.turns) > self.fresh and self.sums[-1] + turn[2] > spare:
                out = self.close()
                while self.fresh and self.sums[-1] - self.sums[0] + turn[2] > spare:  # a long turn leaves less room for history
                    self.turns.pop(0)
                    self.sums = [x - self.sums[1] for x in self.sums[1:]]
                    self.fresh -= 1
            self.turns.append(turn)
            self.sums.append(self.sums[-1] + turn[2])
        self.seen = True
        return out

    def close(self):
        """The window so far; its last turns, up to the history's tokens, stay for the next."""
        if not self.seen or (len(self.turns) == self.fresh and self.done()):
            return None
        window = self.render()
        keep = bisect_left(self.sums, self.sums[-1] - self.history)
        self.turns = self.turns[keep:]
        self.sums = [x - self.sums[keep] for x in self.sums[keep:]]
        self.fresh = len(self.turns)
        self.first = False
        return window

    first = True

    def done(self) -> bool:
        return not (self.first and self.system)

    def render(self) -> dict:
        """text, spans of the loss mask, spans of turns that are new, tokens."""
        parts, at, loss, new = [], 0, [], []
        shown = ([(self.system, self.first)] if self.system else []) + [(t, i >= self.fresh) for i, t in enumerate(self.turns)]
        for (role, text, _), fresh in shown:
            head = f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n"
            body = escape(text)
            low = at + len(head)
            turn = f"{head}{body}{END}\n"
            if fresh:
                new.append((at, at + len(turn)))
                if role == "assistant":
                    loss.append((low, low + len(body)))
            parts.append(turn)
            at += len(turn)
        return {"text": "".join(parts), "loss": loss, "new": new, "tokens": sum(t[2] for t, _ in shown)}


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_WINDOW_FIELDS = [("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("loss", _SPANS), ("new_turns", _SPANS), ("n_tokens", pa.int64()), ("last", pa.bool_())]
WINDOW_SCHEMA = "conv_id long, window long, text string, loss array<struct<start:long,end:long>>, new_turns array<struct<start:long,end:long>>, n_tokens long, last boolean"


def format_chats(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=count_tokens) -> DataFrame:
    """Windows of each conversation: conv_id, window, text, loss and new_turns (code point spans), n_tokens, last.

    Turns go by turn (nulls first), then role and text; repeated rows stay.  A
    null text or role is empty; rows with a null conv_id make up one conversation
    of their own.  Turns are never cut: one longer than the budget gets a window
    without history.  Rows are dealt by conversation and streamed in order, so a
    task holds one window, however long the conversation.
    """
    small_batches(conversations.sparkSession)

    def work(batches):
        now, builder, number, held = None, None, 0, None
        rows: list[tuple] = []

        def put(window, last):
            nonlocal number, held
            if window is not None:
                if held is not None:
                    rows.append((*held, False))
                spans = [[{"start": a, "end": b} for a, b in window[k]] for k in ("loss", "new")]
                held = (now[0], number, window["text"], *spans, window["tokens"])
                number += 1
            if last and held is not None:
                rows.append((*held, True))
                held = None

        def batch():
            made = [pa.array(c, t) for c, (_, t) in zip(zip(*rows), _WINDOW_FIELDS)]
            rows.clear()
            return pa.RecordBatch.from_arrays(made, [n for n, _ in _WINDOW_FIELDS])

        for b in batches:
            for conv, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if now != (conv,):
                    if builder:
                        put(builder.close(), True)
                    now, builder, number = (conv,), Windows(budget, history, tokens), 0
                put(builder.add(role or "", text or ""), False)
            if rows:
                yield batch()
        if builder:
            put(builder.close(), True)
        if rows:
            yield batch()

    cols = F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    dealt = conversations.select(*cols).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(released(work), WINDOW_SCHEMA)


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its windows, which must come in order (as ``format_chats`` gives them).

    Columns: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows.
    """

    def work(batches):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        state = None
        for b in batches:
            out = []
            for w in b.to_pylist():
                if state is None:
                    state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                text = w["text"]
                for span in w["new_turns"]:
                    role, body = _TURN.fullmatch(text[span["start"] : span["end"]]).groups()
                    state[0] += 1
                    state[1].update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                for span in w["loss"]:
                    said = unescape(text[span["start"] : span["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
                state[5] += 1
                if w["last"]:
                    out.append((w["conv_id"], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))
                    state = None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return windows.mapInArrow(released(work), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def op7_chat_formatting(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(rows.unionByName(added)))
