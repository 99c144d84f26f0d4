r"""Chat formatting with a grammar round trip.

Grammar of a formatted conversation, one turn after another:

    user       [INST] text [/INST]
    assistant  <s>text</s>
    system     <<SYS>>text<</SYS>>
    any other  [ROLE]role[/ROLE]text[/END]

Each turn is rendered as it is and parsed again; if other turns come back than went in, its contents are escaped:
every control string with any number of backslashes after its first character gets one more, and the parser takes
one away. So texts without control strings stay as they are, and every text comes back. The loss mask covers the
assistants' texts.

A conversation is sorted by turn in one task and streamed; it is put out in parts of about PART characters, cut
between turns, so neither a long conversation nor a hot one is held in memory.

Defined cases: null text is an empty text, a null role is an empty role; rows of a null conversation are a
conversation; rows of an equal turn are sorted by role and text, and repeated rows are turns of their own; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = 1 << 20
#: The template: role, what opens it, what closes it.
FORMS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
CONTROL = re.compile(r"(<<|<|\[)(\\*)(/?(?:s|SYS>)>|/?(?:INST|ROLE)\]|/END\])")
OPEN = {"[INST]": "user", "<s>": "assistant", "<<SYS>>": "system", "[ROLE]": ""}


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: f"{m[1]}\\{m[2]}{m[3]}", text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: f"{m[1]}{m[2][1:]}{m[3]}", text)


def _form(role: str, text: str) -> tuple[str, int, int]:
    if role in FORMS:
        first, last = FORMS[role]
        return first + text + last, len(first), len(first) + len(text)
    head = f"[ROLE]{role}[/ROLE]"
    return f"{head}{text}[/END]", len(head), len(head) + len(text)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end are of the escaped text in what was given."""
    out, at = [], 0
    while at < len(formatted):
        m = CONTROL.match(formatted, at)
        role = OPEN.get(m[0]) if m else None
        if role is None:
            raise ValueError(f"no turn begins at {at}")
        at = m.end()
        if not role:
            role, begin, at = _until(formatted, at, "[/ROLE]")
            role = unescape(role)
            text, end, after = _until(formatted, at, "[/END]")
        else:
            first, last = FORMS[role]
            at = m.start() + len(first)
            if not formatted.startswith(first, m.start()):
                raise ValueError(f"no turn begins at {m.start()}")
            text, end, after = _until(formatted, at, last)
        out.append((role, unescape(text), at, end))
        at = after
    return out


def _until(formatted: str, at: int, last: str) -> tuple[str, int, int]:
    """What stands before the next control string, its end, and what follows; that string must be `last`."""
    for m in CONTROL.finditer(formatted, at):
        if not m[2]:  # one with a backslash is content
            end = m.end() - len(last)
            if end < at or formatted[end : m.end()] != last:
                break
            return formatted[at:end], end, m.end()
    raise ValueError(f"the turn at {at} has no end {last!r}")


def render(role: str | None, text: str | None) -> tuple[str, int, int]:
    """A formatted turn and where its text is in it."""
    role, text = role or "", text or ""
    for r, t in ((role, text), (role if role in FORMS else escape(role), escape(text))):
        formatted, start, end = _form(r, t)
        try:
            if parse(formatted) == [(role, text, start, end)]:
                return formatted, start, end
        except ValueError:
            continue
    raise AssertionError("an escaped turn always comes back")


SCHEMA = "conv_id long, part long, formatted string, turns long, loss array<struct<start:long,end:long>>"
_ARROW = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("turns", pa.int64()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _format(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    now, part, pieces, size, loss = None, 0, [], 0, []
    ready: list[dict] = []

    def cut() -> None:
        nonlocal part, pieces, size, loss
        ready.append({"conv_id": now[0], "part": part, "formatted": "".join(pieces), "turns": len(pieces), "loss": loss})
        part, pieces, size, loss = part + 1, [], 0, []

    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if now is None or now[0] != conv:
                if pieces:
                    cut()
                now, part = (conv,), 0
            elif size >= limit:
                cut()
            formatted, start, end = render(role, text)
            if role == "assistant":
                loss.append({"start": size + start, "end": size + end})
            pieces.append(formatted)
            size += len(formatted)
            if sum(len(r["formatted"]) for r in ready[-1:]) >= limit or len(ready) >= 512:
                yield pa.RecordBatch.from_pylist(ready, schema=_ARROW)
                ready = []
    if pieces:
        cut()
    if ready:
        yield pa.RecordBatch.from_pylist(ready, schema=_ARROW)


def format_conversations(rows: DataFrame, part_chars: int = PART) -> DataFrame:
    """conv_id, part, formatted, turns, loss (spans of code points in formatted), parts in order within a task."""
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(lambda b: _format(b, part_chars), SCHEMA)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    now, ready = None, []

    def done() -> None:
        ready.append({"conv_id": now["id"], "n_turns": now["n"], "turns_sha256": now["turns"].hexdigest(), "loss_chars": now["chars"], "loss_sha256": now["loss"].hexdigest(), "formatted_chars": now["size"]})

    for batch in batches:
        for row in batch.to_pylist():
            if now is None or now["id"] != row["conv_id"] or row["part"] == 0:
                if now:
                    done()
                now = {"id": row["conv_id"], "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0}
            formatted = row["formatted"]
            for role, text, _, _ in parse(formatted):
                now["n"] += 1
                now["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for span in row["loss"]:
                text = unescape(formatted[span["start"] : span["end"]])
                now["chars"] += len(text)
                now["loss"].update(text.encode("utf-8", "surrogatepass"))
            now["size"] += len(formatted)
            if len(ready) >= 4096:
                yield pa.RecordBatch.from_pylist(ready, schema=schema)
                ready = []
    if now:
        done()
    if ready:
        yield pa.RecordBatch.from_pylist(ready, schema=schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the parser recovers from the parts, in the order that format_conversations gives them."""
    return formatted.mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
