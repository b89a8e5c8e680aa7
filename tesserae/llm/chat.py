"""Chat formatting with a grammar round trip.

A turn is rendered as ``<|im_start|>ROLE NEWLINE TEXT<|im_end|>NEWLINE``. A deterministic parser reads the whole
rendered conversation back, as a stream; where a recovered role or text differs from the source, the conflicting
content is escaped and rendered again, until both are identical. Escaping puts a backslash behind the ``<`` of
whatever the parser would take for a control string or for an escaped one (``<``, backslashes, ``|im_end|>``);
the parser takes one backslash away, so any number of levels is reversible.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Stands for a line break in a role.
NEWLINE = "<|nl|>"
_GUARDED = re.compile(r"<(\\*)\|(im_start|im_end|nl)\|>")
_ESCAPED = re.compile(r"<\\(\\*\|(?:im_start|im_end|nl)\|>)")


class Unparsable(ValueError):
    pass


def escape(text: str) -> str:
    return _GUARDED.sub(r"<\1\\|\2|>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1", text)


def parse(rendered: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """The turn that begins at a place: role, text, where its raw text begins and ends, where the turn ends."""
    if not rendered.startswith(START, at):
        raise Unparsable(f"no turn begins at {at}")
    head = rendered.find("\n", at)
    end = rendered.find(END, head + 1)
    if head < 0 or end < 0 or not rendered.startswith("\n", end + len(END)):
        raise Unparsable(f"the turn at {at} doesn't end")
    role, raw = rendered[at + len(START) : head], rendered[head + 1 : end]
    if START in role or END in role or START in raw:
        raise Unparsable(f"a control string stands inside the turn at {at}")
    return unescape(role.replace(NEWLINE, "\n")), unescape(raw), head + 1, end, end + len(END) + 1


def parse_all(rendered: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(rendered):
        role, text, _, _, at = parse(rendered, at)
        out.append((role, text))
    return out


class Rendering:
    """A conversation's output, written turn by turn and read back at once with whatever of it isn't read yet.

    The output so far always ends between two turns, so the parser holds nothing but the turn in hand. ``chars``: the
    length so far; begin and end of a turn's raw text count from the start of the conversation.
    """

    def __init__(self) -> None:
        self.chars = 0

    def add(self, role: str, text: str) -> tuple[str, str, str, int, int]:
        """Adds a turn: what is written, the role and text that the parser recovers, where the raw text begins and ends."""
        shown_role, shown = role.replace("\n", NEWLINE), text
        for _ in range(2):
            out = f"{START}{shown_role}\n{shown}{END}\n"
            try:
                got_role, got, begin, end, stop = parse(out)
                if (got_role, got) == (role, text) and stop == len(out):
                    place = self.chars
                    self.chars += len(out)
                    return out, got_role, got, place + begin, place + end
            except Unparsable:
                pass
            shown_role, shown = escape(role).replace("\n", NEWLINE), escape(text)
        raise AssertionError("escaping is not reversible")


def render(role: str, text: str) -> str:
    """One turn, escaped as far as the parser needs to give back role and text."""
    return Rendering().add(role, text)[0]


_DIGESTS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def _digest(batches: Iterator[pa.RecordBatch], keep_text: bool) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conversation; only the current conversation's running digests are held."""
    names = _DIGESTS + (["loss_spans", "formatted"] if keep_text else [])
    types = _TYPES + ([pa.list_(pa.list_(pa.int64())), pa.string()] if keep_text else [])
    now = None

    def row() -> list:
        found = [now["id"], now["n"], now["turns"].hexdigest(), now["loss_chars"], now["loss"].hexdigest(), now["output"].chars]
        if not keep_text:
            return found
        formatted = "".join(now["out"])
        check = hashlib.sha256()
        for role, text in parse_all(formatted):
            check.update(f"{role}\n{text}\n".encode())
        if check.digest() != now["source"].digest():
            raise AssertionError("the formatted conversation doesn't give back its turns")
        return [*found, now["spans"], formatted]

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    for batch in batches:
        done = []
        for key, role, text in zip(*(batch.column(k) for k in range(3)), strict=True):
            key, role, text = key.as_py(), role.as_py() or "", text.as_py() or ""
            if now is None or now["id"] != key:
                if now is not None:
                    done.append(row())
                now = {"id": key, "n": 0, "source": hashlib.sha256(), "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "output": Rendering(), "spans": [], "out": []}
            shown, got_role, got, begin, end = now["output"].add(role, text)
            now["turns"].update(f"{got_role}\n{got}\n".encode())
            if got_role == "assistant":
                now["loss_chars"] += len(got)
                now["loss"].update(got.encode())
                if keep_text:
                    now["spans"].append([begin, end])
            now["n"] += 1
            if keep_text:
                now["source"].update(f"{role}\n{text}\n".encode())
                now["out"].append(shown)
        yield batch_of(done)
    if now is not None:
        yield batch_of([row()])


def format_chat(turns: DataFrame, keep_text: bool = True) -> DataFrame:
    """One row per conversation of turns (conv_id long, turn, role, text), in the order of turn, then role, then text.

    Gives the digests of the turns read back from the output and of the text under the loss mask, and with
    keep_text ``formatted``, parsed once more as a whole, and ``loss_spans`` (start and end of each assistant text in
    it, in code points). Null role or text: empty. Null turn: first. Null conv_id: a conversation of its own. Equal
    rows: each is a turn. An empty table gives no row; other columns are not looked at. A task reads its rows sorted,
    as a stream; without keep_text it holds one turn and two digests, so a conversation of any length fits. (One
    conversation's digest is sequential and made by one task.)
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.mapInArrow(lambda batches: _digest(batches, keep_text), schema + (", loss_spans array<array<long>>, formatted string" if keep_text else ""))
