"""Chat formatting with schema fingerprints.

The fingerprint of a record is a hash of its nested field paths. A registry of
declarative mappings, keyed by fingerprint, says where the turns, roles and texts of a
layout are; prompt, instruction, message and turn-by-row layouts all become canonical
turns ``(conv_id, turn, role, text)``. A template then marks each turn and escapes
control strings inside texts, and a loss span covers exactly the assistant's text.

Turns are formatted one by one, so a conversation of any length stays split over rows
(``format_turns``). ``read_back`` streams the sorted turns of each task and keeps running
digests only.

Defined cases: a null text or role is empty; turns are ordered by number, nulls first,
then role, then text, and repeated rows stay; rows with a null conversation id form one
conversation; unknown layouts raise for typed frames and give a null ``layout`` for JSON
records; empty tables give no rows; other columns are ignored, as fingerprints cover the
mapped fields alone.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

TURNS = "conv_id long, turn long, role string, text string"


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns.

    ``paths`` are the field paths that make its fingerprint. ``steps`` are (role, path)
    of single fields, in order; ``each`` is an array whose elements have a role and a
    text field; ``row`` names order, role and text of a layout with one turn a row.
    """

    name: str
    paths: tuple[str, ...]
    conv_id: str = "id"
    steps: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: str = ""
    role: str = ""
    text: str = ""
    row: tuple[str, str, str] | None = None


#: Field names of common conversation layouts, and what their roles are called.
LAYOUTS = (
    Layout("rows", ("conv_id", "role", "text", "turn"), "conv_id", row=("turn", "role", "text")),
    Layout("messages", ("id", "messages[].content", "messages[].role"), each="messages", role="role", text="content"),
    Layout("from_value", ("conversations[].from", "conversations[].value", "id"), each="conversations", role="from", text="value"),
    Layout("prompt", ("id", "prompt", "response"), steps=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("completion", ("completion", "id", "prompt"), steps=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("instruction", ("id", "input", "instruction", "output"), steps=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("question", ("answer", "id", "question"), steps=(("user", ("question",)), ("assistant", ("answer",)))),
)
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


REGISTRY = {fingerprint(layout.paths): layout for layout in LAYOUTS}


def schema_paths(kind: ST.DataType, prefix: str = "") -> list[str]:
    """Leaf paths of a type; ``[]`` marks the elements of an array."""
    if isinstance(kind, ST.StructType):
        dot = prefix + "." if prefix else ""
        return [p for f in kind.fields for p in schema_paths(f.dataType, dot + f.name)]
    if isinstance(kind, ST.ArrayType):
        return schema_paths(kind.elementType, prefix + "[]")
    return [prefix]


def record_paths(value, prefix: str = "") -> list[str]:
    """Leaf paths of a parsed JSON record."""
    if isinstance(value, dict):
        dot = prefix + "." if prefix else ""
        return [p for k, v in value.items() for p in record_paths(v, dot + k)]
    if isinstance(value, list):
        return [p for v in value for p in record_paths(v, prefix + "[]")]
    return [prefix]


def find_layout(paths, exact: bool = False) -> Layout | None:
    """The layout with this fingerprint; else, unless ``exact``, that of the most fields among ``paths``.

    The second step lets records carry other fields: their mapped fields alone are
    fingerprinted again.
    """
    paths = set(paths)
    if found := REGISTRY.get(fingerprint(paths)):
        return found
    if exact:
        return None
    inside = [layout for layout in LAYOUTS if REGISTRY.get(fingerprint(paths & set(layout.paths))) is layout]
    return max(inside, key=lambda layout: len(layout.paths), default=None)


def to_turns(records: DataFrame) -> DataFrame:
    """Canonical turns of a typed frame, whose layout follows from its schema."""
    layout = find_layout(schema_paths(records.schema))
    if layout is None:
        raise ValueError(f"no mapping for {sorted(schema_paths(records.schema))}")
    conv = F.col(layout.conv_id).cast("long").alias("conv_id")
    if layout.row:
        turn, role, text = layout.row
        rows = records.select(conv, F.col(turn).cast("long").alias("turn"), _canonical_role(F.col(role)).alias("role"), F.col(text).alias("text"))
    elif layout.each:
        rows = records.select(conv, F.posexplode(layout.each).alias("turn", "one"))
        rows = rows.select("conv_id", F.col("turn").cast("long"), _canonical_role(F.col(f"one.{layout.role}")).alias("role"), F.col(f"one.{layout.text}").alias("text"))
    else:
        steps = F.array(*[F.struct(F.lit(role).alias("role"), _joined(fields).alias("text")) for role, fields in layout.steps])
        rows = records.select(conv, F.posexplode(steps).alias("turn", "one")).select("conv_id", F.col("turn").cast("long"), "one.role", "one.text")
    return rows.withColumn("role", F.coalesce("role", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))


def _canonical_role(role: Column) -> Column:
    out = role
    for old, new in ROLES.items():
        out = F.when(role == old, new).otherwise(out)
    return out


def _joined(fields: tuple[str, ...]) -> Column:
    return F.array_join(F.filter(F.array(*[F.col(f) for f in fields]), lambda x: F.length(x) > 0), "\n\n")


def json_to_turns(records: DataFrame, column: str = "record") -> DataFrame:
    """Canonical turns, with ``layout``, of JSON records of mixed layouts, each chosen by its fingerprint.

    A record that is no object, has no mapping or lists turns that are no objects gives one
    row with a null ``layout``, and its id where it has one. Ids are integers, bare or as
    text; any other is null. Texts and roles that are no strings are their JSON text, half
    surrogate pairs become U+FFFD.
    """

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [row for record in batch["record"] for row in _record_turns(record)]
            yield pd.DataFrame(out, columns=["conv_id", "turn", "role", "text", "layout"]).astype({"conv_id": "Int64", "turn": "Int64"})

    return records.select(F.col(f"`{column}`").alias("record")).mapInPandas(convert, TURNS + ", layout string")


def _record_turns(record: str | None) -> list[tuple]:
    try:
        value = json.loads(record)
        layout = find_layout(record_paths(value)) if isinstance(value, dict) else None
    except (TypeError, ValueError, RecursionError):
        return [(None, None, "", "", None)]
    if not isinstance(value, dict):
        return [(None, None, "", "", None)]
    if layout is None:
        return [(_integer(value.get("id", value.get("conv_id"))), None, "", "", None)]
    conv = _integer(value.get(layout.conv_id))
    if layout.row:
        turn, role, text = layout.row
        turns = [(_integer(value.get(turn)), value.get(role), value.get(text))]
    elif layout.each:
        listed = value.get(layout.each)
        if not isinstance(listed, list) or not all(isinstance(one, dict) for one in listed):
            return [(conv, None, "", "", None)]
        turns = [(i, one.get(layout.role), one.get(layout.text)) for i, one in enumerate(listed)]
    else:
        turns = [(i, role, "\n\n".join(filter(None, (_string(value.get(f)) for f in fields)))) for i, (role, fields) in enumerate(layout.steps)]
    out = []
    for i, role, text in turns:
        role = _string(role)
        out.append((conv, i, ROLES.get(role, role), _string(text), layout.name))
    return out


def _integer(value) -> int | None:
    if isinstance(value, str) and re.fullmatch(r"[+-]?[0-9]{1,19}", value):
        value = int(value)
    fits = isinstance(value, int) and not isinstance(value, bool) and -(1 << 63) <= value < 1 << 63
    return value if fits else None


def _string(value) -> str:
    """A JSON value as text: null is empty, all but strings their JSON."""
    if value is None:
        return ""
    if not isinstance(value, str):
        value = json.dumps(value, ensure_ascii=False)
    return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


# The template: marks around each turn, and a backslash inside control strings of texts.

OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
#: Strings that chat templates give a meaning.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE), re.DOTALL)


def escaped(text: Column) -> Column:
    """Doubled backslashes, and a backslash after the first character of every control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return out


def unescape(text: str) -> str:
    """A backslash stands for the character after it; before U+2028 (in roles only) for a line end."""
    return re.sub(r"\\(.)", lambda found: "\n" if found[1] == "\u2028" else found[1], text, flags=re.DOTALL)


def format_turns(turns: DataFrame) -> DataFrame:
    """Each turn's piece of its conversation's text, and the loss span inside the piece.

    A conversation's text is its pieces in the order of ``turn``, ``role``, ``text``.
    ``loss_start`` and ``loss_end`` are code points inside the piece, null for turns that
    are not the assistant's.
    """
    # a line end in a role would end the mark; it is written as backslash and line separator
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\u2028"))
    body = escaped(F.col("text"))
    head = F.concat(F.lit(OPEN), role, F.lit(MIDDLE))
    assistant = F.col("role") == "assistant"
    return turns.select(
        "conv_id", "turn", "role", "text", F.concat(head, body, F.lit(CLOSE)).alias("formatted"),
        F.when(assistant, F.length(head)).alias("loss_start"), F.when(assistant, F.length(head) + F.length(body)).alias("loss_end"),
    )


def conversations(pieces: DataFrame) -> DataFrame:
    """Whole conversations: ``conv_id``, ``formatted`` and ``loss_spans``. Each is one value in memory."""
    rows = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "formatted", "loss_start", "loss_end"))).alias("p"))
    begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))
    walked = F.aggregate("p", begin, lambda acc, x: F.struct(
        (acc["at"] + F.length(x["formatted"])).alias("at"),
        F.when(x["loss_start"].isNotNull(), F.concat(acc["spans"], F.array(F.struct(
            (acc["at"] + x["loss_start"]).alias("start"), (acc["at"] + x["loss_end"]).alias("end"))))).otherwise(acc["spans"]).alias("spans")))
    return rows.select("conv_id", F.array_join("p.formatted", "").alias("formatted"), walked["spans"].alias("loss_spans"))


def read_back(pieces: DataFrame) -> DataFrame:
    """Parse the formatted text again and digest what is found, one row per conversation.

    ``turns_sha256`` covers role, line end, text, line end of every turn; ``loss_sha256``
    the unescaped text under the loss spans.
    """
    keys = ["conv_id", "turn", "role", "text"]
    ordered = pieces.repartition("conv_id").sortWithinPartitions(*keys).select("conv_id", "formatted", "loss_start", "loss_end")
    kind = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.mapInArrow(_digests, kind)


class _Running:
    """Digests of the conversation that is being read."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, start, end) -> None:
        at = 0
        for found in TURN.finditer(piece):
            if found.start() != at:
                raise ValueError("text between the turns")
            role = unescape(found[1])
            self.all.update(f"{role}\n{unescape(found[2])}\n".encode("utf-8", "surrogatepass"))
            self.turns, at = self.turns + 1, found.end()
        if at != len(piece):
            raise ValueError("a piece that is no whole turn")
        self.chars += len(piece)
        if start is not None:
            text = unescape(piece[start:end])
            self.loss.update(text.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(text)

    def row(self) -> tuple:
        return (self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(6)], names)

    running, done = None, []
    for batch in batches:
        for conv_id, piece, start, end in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            if running is None or conv_id != running.conv_id:
                if running is not None:
                    done.append(running.row())
                running = _Running(conv_id)
            running.add(piece, start, end)
        if len(done) >= 10_000:
            yield packed(done)
            done = []
    if running is not None:
        done.append(running.row())
    if done:
        yield packed(done)
