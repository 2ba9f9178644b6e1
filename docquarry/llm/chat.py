"""Chat formatting: a finite-state machine over roles and a declarative template.

A template names the control strings, the header and footer of a turn, which roles may
follow which, and which roles' texts carry loss. Formatting emits text segments with a
loss flag each. Control strings that occur inside a text (or a role) are escaped by a
backslash behind their first character, so that control strings in the output are always
the template's own and ``parse`` gives the turns back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import bound_batches

SEGMENTS = "conv_id long, turn long, part int, text string, loss boolean, error boolean"
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, valid boolean, first_error long"
)


@dataclass(frozen=True)
class Template:
    """Control strings, roles' order and loss of a chat format.

    ``follows`` maps a state (a role, or "" at the start) to the roles that may come next.
    """

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    after_role: str = "\n"
    after_turn: str = "\n"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            "": frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user"}),
        }
    )

    def __post_init__(self):
        for c in (self.start, self.end):
            if len(c) < 2 or "\\" in c or c[0] in (self.start[1:] + self.end[1:]):
                raise ValueError(f"unusable control string {c!r}")

    def _pattern(self, least: str) -> re.Pattern:
        return re.compile("|".join(rf"({re.escape(c[0])})(\\{least})({re.escape(c[1:])})" for c in dict.fromkeys((self.start, self.end))))

    def escape(self, text: str) -> str:
        """The text with one backslash more in each control string or escaped one."""
        if self.start[0] not in text and self.end[0] not in text:
            return text
        return self._pattern("*").sub(lambda m: "".join(self._found(m)[:1]) + "\\" + "".join(self._found(m)[1:]), text)

    def unescape(self, text: str) -> str:
        """Undoes ``escape``."""
        if "\\" not in text:
            return text
        return self._pattern("+").sub(lambda m: self._found(m)[0] + self._found(m)[1][1:] + self._found(m)[2], text)

    @staticmethod
    def _found(m: re.Match) -> list[str]:
        return [g for g in m.groups() if g is not None]

    def escape_role(self, role: str) -> str:
        """A role in one line, without control strings."""
        return self.escape(role.replace("%", "%25").replace("\n", "%0A"))

    def unescape_role(self, text: str) -> str:
        """Undoes ``escape_role``."""
        return self.unescape(text).replace("%0A", "\n").replace("%25", "%")

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """One turn as text segments with their loss flags."""
        head = f"{self.start}{self.escape_role(role)}{self.after_role}"
        return [(head, False), (self.escape(text), role in self.loss_roles), (self.end + self.after_turn, False)]

    def next_state(self, state: str | None, role: str) -> str | None:
        """The machine's next state; None when the role may not follow, and from then on."""
        return role if state is not None and role in self.follows.get(state, frozenset()) else None

    def parse(self, segments: Iterable[tuple[str, bool]]) -> Iterator[tuple[str, str, str]]:
        """Role, text and loss text of each turn, read from formatted text.

        Works on the joined text: segment borders matter for the loss mask only. Memory:
        one turn.
        """
        held, masked = "", []
        for text, loss in segments:
            if loss:
                masked.append((len(held), len(held) + len(text)))
            held += text
            while (stop := held.find(self.end)) >= 0 and len(held) >= stop + len(self.end) + len(self.after_turn):
                head = held.index(self.after_role, len(self.start))
                if not held.startswith(self.start):
                    raise ValueError("text between turns")
                body = head + len(self.after_role)
                under = "".join(held[lo:hi] for lo, hi in masked)
                yield self.unescape_role(held[len(self.start) : head]), self.unescape(held[body:stop]), self.unescape(under)
                held, masked = held[stop + len(self.end) + len(self.after_turn) :], []
        if held:
            raise ValueError("an unfinished turn")


def _ordered(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Each conversation's rows together and in order; null ids form one conversation."""
    own = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    return own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _emit(template: Template, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Segments of sorted turns: conv_id, turn, part, text, loss, error."""
    now, state = object(), ""
    for batch in batches:
        for conv, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if conv != now:
                now, state = conv, ""
            before, state = state, template.next_state(state, role)
            wrong = state is None and before is not None
            for part, (piece, loss) in enumerate(template.segments(role, text)):
                yield conv, turn, part, piece, loss, wrong


def format_turns(
    turns: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """All conversations as segments: conv_id, turn, part, text, loss, error.

    ``error`` marks the turn at which the role order broke (the conversation is formatted
    all the same). Null role or text counts as empty; rows of one turn number are ordered
    by role and text, repeated rows are turns each; a null conv_id is a conversation of
    its own; other columns aren't read; an empty table gives no rows. One shuffle by
    conversation; a task streams its sorted turns and holds one at a time.
    """
    bound_batches(turns.sparkSession)
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in _emit(template, batches):
            rows.append(row)
            if len(rows) >= 1500:
                yield _batch(rows, SEGMENTS)
                rows = []
        if rows:
            yield _batch(rows, SEGMENTS)

    return _ordered(turns, conv_col, turn_col, role_col, text_col).mapInArrow(run, SEGMENTS)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])


def _digest(template: Template, conv: int | None, segments: Iterable[tuple]) -> tuple:
    turns_hash, loss_hash = hashlib.sha256(), hashlib.sha256()
    n = loss_chars = chars = 0
    first_error: list[int] = []

    def pieces() -> Iterator[tuple[str, bool]]:
        nonlocal chars
        for _, turn, _, text, loss, wrong in segments:
            chars += len(text)
            if wrong and not first_error:
                first_error.append(turn)
            yield text, loss

    wrong_seen = False
    for role, text, under in template.parse(pieces()):
        turns_hash.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
        loss_hash.update(under.encode("utf-8", "replace"))
        loss_chars += len(under)
        n += 1
    wrong_seen = bool(first_error)
    return conv, n, turns_hash.hexdigest(), loss_chars, loss_hash.hexdigest(), chars, not wrong_seen, (first_error or [None])[0]


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """One row a conversation, from the formatted segments of ``format_turns``: turns,
    their digest, the loss text's length and digest, formatted length, valid, first_error.

    Follows ``format_turns`` in the same task: no further shuffle, one turn in memory.
    """
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(6))))
        out: list[tuple] = []
        for conv, own in groupby(rows, key=lambda r: r[0]):
            out.append(_digest(template, conv, own))
            if len(out) >= 2000:
                yield _batch(out, DIGESTS)
                out = []
        if out:
            yield _batch(out, DIGESTS)

    return segments.mapInArrow(run, DIGESTS)
