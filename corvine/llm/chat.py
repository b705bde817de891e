"""Chat formatting: a finite-state machine over roles, and a declarative template that emits segments with loss flags.

A turn becomes three segments: the template's opening with the role, the text, the closing. Control strings inside roles and
texts are escaped by one more backslash after their first character (a control string whose first character is followed
by backslashes counts too), so an escaped text holds none, and taking one backslash away brings it back. That
needs control strings whose first characters occur in no control string's rest, which the template checks.

The machine allows a system turn first, then user and assistant in turn, user first. A conversation is marked with its
first turn that breaks this; it is formatted all the same, so that nothing is lost silently.

Turns of a conversation stand together and in order, by one shuffle and a sort that spills; they stream, so even a
conversation of a third of all rows needs the memory of one turn. Output is read back from segments in their order.

Cases: null texts and roles are empty; a null conv_id is one conversation; null turns come first, ties go by role, then
text; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: state: {role: next state}
MACHINE = {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}}
SEGMENTS = "conv_id long, n long, part int, text string, loss boolean, valid boolean"


@dataclass(frozen=True)
class Template:
    opening: str = "<|"
    said: str = "}>"
    closing: str = "</s>"
    #: further strings that a model may read as control
    reserved: tuple[str, ...] = ("[INST]", "[/INST]")
    loss_roles: tuple[str, ...] = ("assistant",)
    _into: re.Pattern = field(init=False, compare=False)
    _back: re.Pattern = field(init=False, compare=False)

    def __post_init__(self):
        control = {self.opening, self.said, self.closing, *self.reserved}
        if any(len(c) < 2 or "\\" in c for c in control) or {c[0] for c in control} & set("".join(c[1:] for c in control)):
            raise ValueError("control strings need two characters, no backslash, and first characters that occur in no rest")
        rests = [(re.escape(c[0]), re.escape(c[1:])) for c in sorted(control)]
        object.__setattr__(self, "_into", re.compile("|".join(rf"(?<={a})(?=\\*{b})" for a, b in rests)))
        object.__setattr__(self, "_back", re.compile("|".join(rf"(?<={a})\\(?=\\*{b})" for a, b in rests)))

    def escape(self, text: str) -> str:
        return self._into.sub(r"\\", text)

    def unescape(self, text: str) -> str:
        return self._back.sub("", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        return [(f"{self.opening}{self.escape(role)}{self.said}", False), (self.escape(text), role in self.loss_roles), (self.closing, False)]

    def parse(self, turn: str) -> tuple[str, str]:
        """Role and text of a formatted turn without its closing."""
        role, said, text = turn.partition(self.said)
        if not said or not role.startswith(self.opening):
            raise ValueError("no turn stands here")
        return self.unescape(role[len(self.opening) :]), self.unescape(text)


def _format(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, n, state, begun = None, 0, "start", False
        for batch in batches:
            out = []
            for c, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if not begun or c != conv:
                    conv, n, state, begun = c, 0, "start", True
                role, text = role or "", text or ""
                state = MACHINE.get(state, {}).get(role, "broken")
                out += [(conv, n, part, s, loss, state != "broken") for part, (s, loss) in enumerate(template.segments(role, text))]
                n += 1
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names=["conv_id", "n", "part", "text", "loss", "valid"])

    return run


def formatted(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Segments of ``conversations`` (conv_id, turn, role, text): conv_id, n (turn), part, text, loss, valid (no broken order so far); in order within a partition."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(_format(template), SEGMENTS)


class _Reader:
    """Reads one conversation's formatted stream back, segment by segment."""

    def __init__(self, template: Template):
        self.template, self.rest, self.chars, self.turns, self.loss_chars, self.valid = template, "", 0, 0, 0, True
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, loss: bool, valid: bool) -> None:
        self.chars += len(text)
        self.valid &= valid
        if loss:
            plain = self.template.unescape(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
        # an escaped text never holds the closing, nor can one arise where segments meet
        self.rest += text
        if text == self.template.closing:
            role, said = self.template.parse(self.rest.removesuffix(text))
            self.all.update(f"{role}\n{said}\n".encode())
            self.turns, self.rest = self.turns + 1, ""


def _read(template: Template):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, reader, out = None, None, []

        def done():
            if reader:
                out.append((conv, reader.turns, reader.all.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars, reader.valid))

        def batch_of():
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)], names=names)

        for batch in batches:
            for c, text, loss, valid in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4, 5)), strict=True):
                if reader is None or c != conv:
                    done()
                    conv, reader = c, _Reader(template)
                reader.add(text, loss, valid)
            yield batch_of()
            out = []
        done()
        yield batch_of()

    return run


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid of each conversation in ``formatted`` segments."""
    return segments.mapInArrow(_read(template), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


ASKED = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.createDataFrame([(-1, 0, "user", ASKED), (-1, 1, "assistant", ASKED)], "conv_id long, turn long, role string, text string")
    return read_back(formatted(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)))


def _escapes_sql(text: str) -> str:
    """How many backslashes escaping adds: one for each control string, whose first character backslashes may follow."""
    t = Template()
    patterns = [re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in sorted({t.opening, t.said, t.closing, *t.reserved})]
    return " + ".join(f"len(regexp_extract_all({text}, '{p}'))" for p in patterns)


SQL = rf"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{ASKED}'), (-1, 1, 'assistant', '{ASKED}')) AS v(conv_id, turn, role, text)),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM c),
s AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before, {len(Template().opening + Template().said + Template().closing)} + length(role) + length(text) + {_escapes_sql("role")} + {_escapes_sql("text")} AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN i = 1 THEN role IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN role = 'user' ELSE before = 'user' AND role = 'assistant' END) AS valid
FROM s GROUP BY conv_id
"""
