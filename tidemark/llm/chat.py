"""Chat formatting into budgeted windows.

Turns of a conversation are laid end to end; prefix sums of their tokens choose the longest span of whole turns that
fits the budget next to the system turn and a limited history, the last turns before the span. History is
repeated for context only: its turns are masked, as is everything but the assistant's new turns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
BUDGET, HISTORY = 1024, 256
#: Tokens that a turn's frame takes besides its text.
FRAME = 4
RESULT = (
    "conv_id long, window int, first_turn long, last_turn long, n_turns int, n_repeated int, n_tokens long, n_target_tokens long, "
    "over_budget boolean, text string, targets array<struct<begin: int, end: int>>"
)
_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("window", pa.int32()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("n_turns", pa.int32()), ("n_repeated", pa.int32())]
    + [("n_tokens", pa.int64()), ("n_target_tokens", pa.int64()), ("over_budget", pa.bool_()), ("text", pa.string())]
    + [("targets", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))]
)
Turn = tuple  # (turn, role, text, tokens)


def frame(role: str, text: str) -> tuple[str, str, str]:
    return f"<|{role}|>\n", text, "<|end|>\n"


def next_span(tokens: np.ndarray, start: int, room: int) -> int:
    """End of the longest span from start whose tokens fit in room; one turn at least."""
    sums = np.cumsum(tokens[start:])
    return start + max(1, int(np.searchsorted(sums, room, side="right")))


def history_start(tokens: np.ndarray, start: int, limit: int) -> int:
    """First of the turns before start that together hold at most `limit` tokens."""
    back = np.cumsum(tokens[:start][::-1])
    return start - int(np.searchsorted(back, limit, side="right"))


class Conversation:
    """Windows of one conversation whose turns arrive in order; holds the open window and its history only."""

    def __init__(self, conv_id: int | None, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system: list[Turn] = []
        self.turns: list[Turn] = []
        self.start = 0
        self.window = 0
        self.begun = False

    def add(self, turns: list[Turn]) -> None:
        for t in turns:
            if t[1] == "system" and not self.begun:
                self.system.append(t)
            else:
                self.begun = True
                self.turns.append(t)

    def windows(self, ended: bool) -> Iterator[dict]:
        """The windows that no later turn can change."""
        held = sum(t[3] for t in self.system)
        tokens = np.array([t[3] for t in self.turns], np.int64)
        while self.start < len(self.turns):
            back = history_start(tokens, self.start, self.history)
            repeated = int(tokens[back : self.start].sum())
            if held + repeated + tokens[self.start] > self.budget:  # the new turn comes first
                back, repeated = self.start, 0
            end = next_span(tokens, self.start, self.budget - held - repeated)
            if end == len(self.turns) and not ended:
                break
            yield self.render(self.turns[back : self.start], self.turns[self.start : end])
            self.start = end
        if ended and not self.window and self.system:
            yield self.render([], [])
        keep = history_start(tokens, self.start, self.history)
        self.turns, self.start = self.turns[keep:], self.start - keep

    def render(self, repeated: list[Turn], new: list[Turn]) -> dict:
        text, at, targets, aim = [], 0, [], 0
        shown = self.system + repeated + new
        for i, (_, role, body, n) in enumerate(shown):
            parts = frame(role, body)
            if i >= len(self.system) + len(repeated) and role == "assistant":
                targets.append({"begin": at + len(parts[0]), "end": at + len(parts[0]) + len(body)})
                aim += n - FRAME
            text.extend(parts)
            at += sum(map(len, parts))
        total = sum(t[3] for t in shown)
        self.window += 1
        span = new or self.system
        return {
            "conv_id": self.conv_id, "window": self.window - 1, "first_turn": span[0][0], "last_turn": span[-1][0], "n_turns": len(new), "n_repeated": len(repeated),
            "n_tokens": total, "n_target_tokens": aim, "over_budget": total > self.budget, "text": "".join(text), "targets": targets,
        }


def _format(folder: str, budget: int, history: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        with open(f"{folder}/byte_bpe_50k.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        cut = tiktoken.Encoding("turns", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        open_: Conversation | None = None
        done: list[dict] = []

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pylist(done, schema=_SCHEMA)
            done.clear()
            return out

        for batch in batches:
            ids = batch.column("conv_id").to_pylist()
            role = [r if r is not None else "unknown" for r in batch.column("role").to_pylist()]
            text = [t if t is not None else "" for t in batch.column("text").to_pylist()]
            turns = list(zip(batch.column("turn").to_pylist(), role, text, (FRAME + len(cut(t)) for t in text)))
            a = 0
            while a < len(ids):
                b = a
                while b < len(ids) and ids[b] == ids[a]:
                    b += 1
                if open_ is None or open_.conv_id != ids[a]:
                    if open_ is not None:
                        done.extend(open_.windows(True))
                    open_ = Conversation(ids[a], budget, history)
                open_.add(turns[a:b])
                for w in open_.windows(False):
                    done.append(w)
                    if len(done) >= 500:
                        yield sent()
                a = b
        if open_ is not None:
            done.extend(open_.windows(True))
        yield sent()

    return run


def chat_windows(
    conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizers: str = TOKENIZERS,
    conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """Training windows of every conversation, see RESULT: text in chat format, and the spans of it to learn from.

    System turns at the start of a conversation head each of its windows. Then come at most `history` tokens of whole
    turns repeated from before, and the new turns, as many as fit into `budget` tokens of the byte-level vocabulary
    (each turn with FRAME more). Every turn is new in exactly one window. targets are the character spans
    of new assistant turns; n_target_tokens are theirs.

    A turn that doesn't fit by itself isn't cut: it gets a window of its own, over_budget. A conversation of system
    turns only is one window without targets. NULL text: an empty turn. NULL role: shown as unknown, never a
    target. NULL turn: first. NULL conv_id: one conversation. Repeated rows and ties: each row is a turn, in order
    of role and text. Empty tables: no rows. Other columns are ignored, whatever their names.
    """
    if history >= budget:
        raise ValueError("history must leave room in the budget")
    rows = conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text")
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_format(tokenizers, budget, history), RESULT)
