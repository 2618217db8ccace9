"""Chat formatting: a finite-state machine over roles, a declarative template, loss flags per segment.

A ``Template`` names for each role the marker before and after its text and whether its text is learnt
from, and for the machine the states a role may follow.  The machine reads a conversation's turns in
order, emits their segments (marker, text, marker: each with its loss flag) and says whether the order
held; a turn out of order is emitted all the same, and ``valid`` is false from there on.

**Escaping.**  Control strings are the marker texts without white space at their ends.  A text gets a backslash
before each backslash or control string; taking the backslash before such a string away again gives the
text back, as markers themselves never follow a backslash inside the output.

Conversations are dealt by id and sorted inside partitions; a task holds one batch of turns and the state
of the conversation at hand, so neither long nor many-turn conversations need memory.  A hash over a
conversation is a chain, so one conversation stays in one task.

Nulls and odd input: a null text is empty; a null role is the empty role; a role without an entry in the template takes
the template's markers for other roles and breaks the order; turns sort by turn (nulls first), then role, then text, so
ties and repeated rows have a fixed order; rows with a null conversation id form one conversation; an empty
table gives no rows; other columns are left behind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drainrules.llm.common import map_arrow


@dataclass(frozen=True)
class Role:
    before: str
    after: str
    loss: bool
    follows: tuple[str, ...]  # roles, or START


START = "<start>"
END_TURN = " </turn>\n"


@dataclass(frozen=True)
class Template:
    roles: dict[str, Role]
    other: tuple[str, str] = ("### Role {role}: ", END_TURN)  # markers of roles that are not listed
    first: tuple[str, ...] = (START,)
    last: tuple[str, ...] = ("assistant",)  # roles a conversation may end with

    def controls(self) -> list[str]:
        marks = {m.strip() for r in self.roles.values() for m in (r.before, r.after)}
        marks |= {self.other[0].split("{")[0].strip(), self.other[1].strip()}
        return sorted((m for m in marks if m), key=lambda m: (-len(m), m))


PLAIN = Template(
    roles={
        "system": Role("### System: ", END_TURN, False, (START,)),
        "user": Role("### User: ", END_TURN, False, (START, "system", "assistant")),
        "assistant": Role("### Assistant: ", END_TURN, True, ("user",)),
    }
)

SEGMENTS = "conv_id long, turn_no long, role string, part string, text string, loss boolean, valid boolean"


class Escaper:
    """Reversible escaping of control strings in texts."""

    def __init__(self, template: Template):
        marks = "|".join(map(re.escape, template.controls()))
        self._special = re.compile(rf"\\|{marks}")
        self._escaped = re.compile(rf"\\(\\|{marks})")

    def escape(self, text: str) -> str:
        return self._special.sub(lambda m: "\\" + m[0], text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(r"\1", text)


def format_conversations(conversations: DataFrame, template: Template = PLAIN) -> DataFrame:
    """Segments of all conversations, in order inside each partition: ``SEGMENTS``.

    ``part`` is ``before``, ``text`` or ``after``; the texts of a conversation's segments joined are its formatted
    form.  ``valid`` says whether the order of roles held up to this turn.
    """
    turns = (
        conversations.select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escaper = Escaper(template)
        conv: object = START  # no id yet
        state, valid, number = START, True, 0
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [], [], [], [])
            ids, _, roles, texts = (c.to_pylist() for c in batch.columns)
            for conv_id, role, text in zip(ids, roles, texts, strict=True):
                if conv_id != conv:
                    conv, state, valid, number = conv_id, START, True, 0
                known = template.roles.get(role)
                valid = valid and known is not None and state in known.follows
                if known is None:
                    # The role stands inside a marker: escaped, with its end written so that it can be read back.
                    before, after, loss = template.other[0].replace("{role}", role_name(role)), template.other[1], False
                else:
                    before, after, loss = known.before, known.after, known.loss
                for part, piece, learnt in (("before", before, False), ("text", escaper.escape(text), loss), ("after", after, False)):
                    for column, value in zip(columns, (conv_id, number, role, part, piece, learnt, valid), strict=True):
                        column.append(value)
                state, number = role, number + 1
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "turn_no", "role", "part", "text", "loss", "valid"])

    return map_arrow(turns, emit, SEGMENTS)


def role_name(role: str) -> str:
    """A role's name inside a marker: hexadecimal, so that it holds no control string."""
    return role.encode("utf-8", "surrogatepass").hex() or "-"


def _role_of(name: str) -> str:
    return "" if name == "-" else bytes.fromhex(name).decode("utf-8", "surrogatepass")


class Reader:
    """Reads formatted text back, turn by turn: the inverse of the template."""

    def __init__(self, template: Template = PLAIN):
        head, tail = template.other[0].split("{role}")
        self._before = [(role, r.before) for role, r in template.roles.items()]
        self._other = re.compile(re.escape(head) + "([0-9a-f]+|-)" + re.escape(tail))
        self._escaper = Escaper(template)
        afters = {r.after for r in template.roles.values()} | {template.other[1]}
        marks = "|".join(map(re.escape, sorted(afters, key=lambda m: -len(m))))
        controls = "|".join(map(re.escape, template.controls()))
        self._piece = re.compile(rf"\\(?:\\|{controls})|(?P<end>{marks})")

    def turns(self, formatted: str) -> list[tuple[str, str]]:
        """``(role, text)`` of each turn of a formatted conversation (or of some whole turns of one)."""
        out, at = [], 0
        while at < len(formatted):
            for role, before in self._before:
                if formatted.startswith(before, at):
                    at += len(before)
                    break
            else:
                m = self._other.match(formatted, at)
                if m is None:
                    raise ValueError(f"no turn begins at {at}")
                role, at = _role_of(m[1]), m.end()
            for m in self._piece.finditer(formatted, at):
                if m["end"] is not None:
                    out.append((role, self._escaper.unescape(formatted[at : m.start()])))
                    at = m.end()
                    break
            else:
                raise ValueError("a turn has no end")
        return out


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
)


def read_back(segments: DataFrame, template: Template = PLAIN) -> DataFrame:
    """One row per conversation, from the segments' texts and loss flags alone (``DIGESTS``).

    ``segments`` come as ``format_conversations`` gives them: a conversation's rows in order in one partition.
    """
    unlearnt_end = template.last

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, escaper = Reader(template), Escaper(template)
        conv: object = START
        held = ""
        n = loss_chars = formatted = 0
        all_hash, loss_hash, valid, last = hashlib.sha256(), hashlib.sha256(), True, ""
        rows: list[tuple] = []

        def done() -> None:
            rows.append((conv, n, all_hash.hexdigest(), loss_chars, loss_hash.hexdigest(), formatted, valid and last in unlearnt_end))

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"],
            )

        for batch in batches:
            ids, numbers, _, parts, texts, losses, valids = (c.to_pylist() for c in batch.columns)
            for conv_id, number, part, text, loss, ok in zip(ids, numbers, parts, texts, losses, valids, strict=True):
                if number == 0 and part == "before":
                    if conv != START:
                        done()
                    conv, held, n, loss_chars, formatted = conv_id, "", 0, 0, 0
                    all_hash, loss_hash, valid = hashlib.sha256(), hashlib.sha256(), True
                held += text
                formatted += len(text)
                valid = valid and ok
                if loss:
                    plain = escaper.unescape(text)
                    loss_chars += len(plain)
                    loss_hash.update(plain.encode("utf-8", "surrogatepass"))
                if part == "after":
                    for role, plain in reader.turns(held):
                        n += 1
                        last = role
                        all_hash.update(f"{role}\n{plain}\n".encode("utf-8", "surrogatepass"))
                    held = ""
            yield batch_of()
        if conv != START:
            done()
        yield batch_of()

    return map_arrow(segments, digest, DIGESTS)
