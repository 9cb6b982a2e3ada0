"""Chat formatting into budgeted, turn-aligned training windows with a loss mask.

The turns of a conversation are cut by prefix sums of their tokens: a span ends before the first turn
whose prefix sum, less the sum at the span's start, exceeds what the budget leaves after the system
turn and the repeated history. Tokens are those of the turn as the template writes it, marks included.
Every window starts with the system turn in force (the last one before the span), then a limited number
of turns from before the span, then the span. Repeated turns are context: no repeated answer is under
the loss mask, so each assistant turn is a target exactly once. History gives way to the span: what does
not fit beside the span's first turn is not repeated.

Scale: one shuffle on the conversation with a sort inside partitions; a task then streams over its turns
and holds one window at a time, so a conversation of any length fits. Windows leave in order. A single
conversation is cut by one task, as its turns and their digests come one after another.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Production parameters, in tokens as ``count_tokens`` counts them.
BUDGET, HISTORY_TURNS, HISTORY_TOKENS = 1024, 2, 256
WINDOW_SCHEMA = "conv_id long, window long, n_context int, n_turns int, n_tokens long, text string, loss array<struct<start: int, end: int>>"
ARROW_WINDOW = pa.schema(
    [("conv_id", pa.int64()), ("window", pa.int64()), ("n_context", pa.int32()), ("n_turns", pa.int32()), ("n_tokens", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
)
_WORDS = re.compile(r"\w+|[^\w\s]")


def count_tokens(text: str) -> int:
    """Words and single symbols: a tokenizer-free estimate for budgeting."""
    return sum(1 for _ in _WORDS.finditer(text))


def escape(text: str) -> str:
    """Make turn marks inside a text inert; ``unescape`` restores it exactly."""
    return text.replace("\\", "\\\\").replace("</turn", "\\</turn").replace("<turn", "\\<turn")


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("<", "\\<").replace(">", "\\>")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


TAIL = "\n</turn>\n"


def head(role: str) -> str:
    return f"<turn {escape_role(role)}>\n"


def turn_tokens(role: str, text: str) -> int:
    """Tokens of a turn with its marks; a window's tokens are the sum over its turns."""
    return count_tokens(head(role)) + count_tokens(escape(text)) + count_tokens(TAIL)


def render(turns: list[tuple[str, str, bool]]) -> tuple[str, list[dict]]:
    """Text of a window and the spans (code points, end exclusive) of its targets."""
    out, at, loss = [], 0, []
    for role, text, target in turns:
        start, body = head(role), escape(text)
        at += len(start)
        if target:
            loss.append({"start": at, "end": at + len(body)})
        out += [start, body, TAIL]
        at += len(body) + len(TAIL)
    return "".join(out), loss


def parse(window: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window: the inverse of ``render``."""
    turns = []
    for block in window.split(TAIL)[:-1]:
        opened = re.match(r"<turn ((?:[^\\>]|\\.)*)>\n", block, re.DOTALL)
        turns.append((unescape(opened[1]), unescape(block[opened.end() :])))
    return turns


def format_chat(turns: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """Windows of all conversations: conv_id, window, n_context, n_turns, n_tokens, text, loss.

    Input columns conv_id, turn, role, text; others are ignored. Null role or text is empty, a null
    conv_id is a conversation of its own, turns sort by (turn, role, text) with nulls first, so ties and
    repeated rows keep a fixed order. A turn is never split: a window exceeds the budget only where its
    one turn and the system turn do, and then it repeats no history. Turns of role ``assistant`` are
    targets. A later system turn takes the place of an earlier one from the next window on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        conv, started, number = None, False, 0
        system: tuple[str, str, int] | None = None
        past: deque = deque(maxlen=max(history_turns, 1))
        span: list[tuple[str, str, int]] = []
        history: list[tuple[str, str, int]] = []
        prefix = origin = fixed = 0

        def close() -> None:
            nonlocal number, span, origin, system
            context = ([system] if system else []) + history
            shown = [(r, t, False) for r, t, _ in context] + [(r, t, r == "assistant") for r, t, _ in span]
            text, loss = render(shown)
            rows.append({"conv_id": conv, "window": number, "n_context": len(context), "n_turns": len(shown), "n_tokens": fixed + prefix - origin, "text": text, "loss": loss})
            for turn in span:
                if turn[0] == "system":
                    system = turn
                else:
                    past.append(turn)
            number, span, origin = number + 1, [], prefix

        def recall(room: int) -> list[tuple[str, str, int]]:
            kept, used = [], 0
            for turn in reversed(past if history_turns else ()):
                if used + turn[2] > min(history_tokens, room):
                    break
                used += turn[2]
                kept.append(turn)
            return kept[::-1]

        for batch in batches:
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not started or c != conv:
                    if span:
                        close()
                    conv, started, number, system, history, span, prefix, origin, fixed = c, True, 0, None, [], [], 0, 0, 0
                    past.clear()
                turn = (role or "", text or "", turn_tokens(role or "", text or ""))
                if span and fixed + prefix + turn[2] - origin > budget:
                    close()
                    fixed = system[2] if system else 0
                    history = recall(budget - fixed - turn[2])
                    fixed += sum(n for *_, n in history)
                prefix += turn[2]
                span.append(turn)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, ARROW_WINDOW)
                rows.clear()
        if span:
            close()
            yield pa.RecordBatch.from_pylist(rows, ARROW_WINDOW)

    src = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), F.col("turn"))
    dealt = src.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, WINDOW_SCHEMA)


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from formatted windows alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Windows of a conversation must be adjacent and in order, as ``format_chat`` leaves them; after a
    round through storage, repartition by conv_id and sort by (conv_id, window) first.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, rows = None, []

        def close() -> None:
            rows.append({"conv_id": state[0], "n_turns": state[1], "turns_sha256": state[2].hexdigest(), "loss_chars": state[3], "loss_sha256": state[4].hexdigest(), "formatted_chars": state[5]})

        for batch in batches:
            for c, k, skip, text, loss in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "window", "n_context", "text", "loss")), strict=True):
                if k == 0:
                    if state:
                        close()
                    state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parse(text)[skip:]:
                    state[1] += 1
                    state[2].update(f"{role}\n{body}\n".encode())
                for span in loss:
                    body = unescape(text[span["start"] : span["end"]])
                    state[3] += len(body)
                    state[4].update(body.encode())
                state[5] += len(text)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows.clear()
        if state:
            close()
            yield pa.RecordBatch.from_pylist(rows, schema)

    return windows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
