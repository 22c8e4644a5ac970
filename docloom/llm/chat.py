r"""Chat formatting in budgeted windows.

A turn is written as ``### role: text</turn>`` and a line end. Inside roles and texts a backslash, each
sign of ``###``, the slash of ``</turn>``, and in roles also colons and line ends, are preceded by
a backslash, so no text holds a control string and everything reads back exactly.

A conversation is cut into windows of whole turns. Prefix sums of turn tokens choose the longest span
that fits the budget beside the retained system turn and a limited suffix of the turns before the
span; at least one new turn is taken, so a turn larger than the budget stands whole. Repeated turns are
never under the loss mask: each assistant text is a target once, in the window where it is new.

Tokens are those of the formatted texts, by a vocabulary or, without one, words and signs.

Rows are streamed in order of (conv_id, turn, role, text), so a conversation of any length needs the
memory of one window. Null texts and roles count as empty, null turns come first, rows with a null
conv_id are one conversation, ties and repeated rows are turns of their own, an empty table gives no
window and other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.packing import tokenizer

BUDGET, HISTORY = 1024, 256
START, STOP = "### ", "</turn>\n"
#: Tokens of a turn's marks.
MARKS = 8
WINDOW = ("conv_id long, window long, formatted string, repeated int, "
          "loss array<struct<start:int,end:int>>")
TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.DOTALL)


def escape(text: str, role: bool = False) -> str:
    text = text.replace("\\", "\\\\").replace("</turn>", "<\\/turn>")
    text = re.sub("#{3,}", lambda m: "\\#" * len(m[0]), text)
    return text.replace(":", "\\:").replace("\n", "\\\n") if role else text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def format_window(turns: list[tuple[str, str]], repeated: int) -> tuple[str, list[tuple[int, int]]]:
    """The window's text and the spans of its new assistant texts, in code points."""
    out, at, loss = [], 0, []
    for i, (role, text) in enumerate(turns):
        head, body = f"{START}{escape(role, True)}: ", escape(text)
        out += [head, body, STOP]
        if i >= repeated and role == "assistant" and body:
            loss.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(STOP)
    return "".join(out), loss


def read_window(formatted: str) -> list[tuple[str, str]]:
    """The turns of a window, unescaped; raises if anything is left over."""
    turns, at = [], 0
    while at < len(formatted):
        found = TURN.match(formatted, at)
        if not found:
            raise ValueError(f"not a turn at {at}")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def simple_tokens(text: str) -> int:
    """Words and signs of a text, as a count of tokens that needs no vocabulary."""
    return len(re.findall(r"\w+|[^\w\s]", text))


def vocabulary_tokens(path: str, ranks: str | None = None, pattern: str = "") -> Callable[[str], int]:
    """Counts a text's ids in the vocabulary that ``path`` names on every executor (see ``packing.tokenizer``)."""
    return lambda text: len(tokenizer(path, ranks, pattern)(text))


def windows(turns: Iterator[tuple[object, str, str]], budget: int = BUDGET, history: int = HISTORY,
            tokens: Callable[[str], int] = simple_tokens) -> Iterator[tuple]:
    """(conv_id, window, formatted, repeated, loss) of turns (conv_id, role, text) in order."""
    fresh, sizes, tail, tail_sizes, system, conv, number = [], [], [], [], None, object(), 0

    def emit(final: bool) -> Iterator[tuple]:
        """Windows over what is fresh while it exceeds the budget; at the end, all."""
        nonlocal fresh, sizes, tail, tail_sizes, number
        while fresh:
            again = min(history, budget // 2)
            kept = int(np.searchsorted(np.cumsum(tail_sizes[::-1]), again, "right")) if tail else 0
            lead = [system[0]] if system and number else []
            used = (system[1] if lead else 0) + sum(tail_sizes[len(tail) - kept :])
            prefix = np.cumsum(sizes)
            if not final and used + prefix[-1] <= budget:
                return
            take = max(1, int(np.searchsorted(prefix, budget - used, "right")))
            old = lead + tail[len(tail) - kept :]
            text, loss = format_window(old + fresh[:take], len(old))
            yield conv, number, text, len(old), loss
            number += 1
            past, past_sizes = (tail + fresh[:take]), (tail_sizes + sizes[:take])
            if system and number == 1:
                past, past_sizes = past[1:], past_sizes[1:]
            near = int(np.searchsorted(np.cumsum(past_sizes[::-1]), again, "right")) if past else 0
            tail, tail_sizes = past[len(past) - near :], past_sizes[len(past) - near :]
            fresh, sizes = fresh[take:], sizes[take:]

    for key, role, text in turns:
        if key != conv:
            yield from emit(True)
            fresh, sizes, tail, tail_sizes, system, conv, number = [], [], [], [], None, key, 0
            if role == "system":
                system = ((role, text), tokens(escape(text)) + MARKS)
        fresh.append((role, text))
        sizes.append(tokens(escape(text)) + MARKS)
        yield from emit(False)
    yield from emit(True)


def format_chats(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY,
                 tokens: Callable[[str], int] = simple_tokens) -> DataFrame:
    """Windows of all conversations of ``rows`` (conv_id, turn, role, text), each partition in order."""
    clean = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turns() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
        names = ["conv_id", "window", "formatted", "repeated", "loss"]
        held, size = [], 0
        for conv, number, text, repeated, loss in windows(turns(), budget, history, tokens):
            held.append((conv, number, text, repeated, [{"start": a, "end": b} for a, b in loss]))
            size += len(text)
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    placed = clean.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return placed.select("conv_id", "role", "text").mapInArrow(run, WINDOW)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of every conversation, read from its windows as ``format_chats`` leaves them.

    A conversation's windows follow each other in one partition; repeated turns are skipped, and what
    is under the loss mask is cut out of the formatted text and unescaped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        state, out = None, []

        def close() -> None:
            if state is not None:
                out.append((state["conv"], state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["all"]))

        for batch in batches:
            for conv, number, text, repeated, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number == 0:
                    close()
                    state = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0}
                for role, said in read_window(text)[repeated:]:
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    said = unescape(text[span["start"] : span["end"]])
                    state["chars"] += len(said)
                    state["loss"].update(said.encode("utf-8", "surrogatepass"))
                state["all"] += len(text)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return formatted.select("conv_id", "window", "formatted", "repeated", "loss").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
