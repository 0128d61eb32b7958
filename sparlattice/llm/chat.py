"""Operator 4: chat formatting by schema fingerprint.

The nested field paths of a record (or of a table's schema) are hashed; the
hash selects a declarative mapping that turns its layout into canonical turns.
A template marks turns, escapes control strings inside texts, and a reader
gives turns and the text under the loss mask back.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, TEXT, CLOSE = "<|turn|>", "<|text|>", "<|close|>"
LOSS_ROLES = frozenset({"assistant"})
#: What a template of this kind may give a meaning to. Fixed values.
_CONTROL = re.compile(r"\\|<(?=\||/?s>|<SYS>>|</SYS>>)|\[(?=/?INST\])")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURNS = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|close\|>", re.DOTALL)
#: Names of roles in other layouts. Fixed values.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "prompter": "user"}


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def formatted(turns: list[tuple[str, str]]) -> str:
    return "".join(f"{TURN}{escape(role)}{TEXT}{escape(text)}{CLOSE}" for role, text in turns)


def read_back(chat: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURNS.finditer(chat)]


def loss_spans(chat: str, roles: frozenset[str] = LOSS_ROLES) -> list[tuple[int, int]]:
    """Code point spans of the escaped texts that the loss counts."""
    return [m.span(2) for m in _TURNS.finditer(chat) if unescape(m[1]) in roles]


def paths_of(value, at: str = "") -> set[str]:
    """Nested field paths with their kinds, ``[]`` standing for list items."""
    if isinstance(value, dict):
        return set().union(*(paths_of(v, f"{at}.{k}" if at else str(k)) for k, v in value.items())) if value else {f"{at}:object"}
    if isinstance(value, list):
        return set().union(*(paths_of(v, f"{at}[]") for v in value)) if value else {f"{at}[]:empty"}
    kind = "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, int | float) else "string"
    return {f"{at}:{kind}"}


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    if isinstance(kind, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind.fields)) if kind.fields else {f"{at}:object"}
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return {f"{at}:{'boolean' if isinstance(kind, T.BooleanType) else 'number' if isinstance(kind, T.NumericType) else 'string'}"}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns. ``turns``: the list of messages and the fields
    of role and text in one; else ``parts``: (role, fields that are joined by a
    blank line); else ``row``: the columns of a table with a turn a row."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[str, str, str] | None = None
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    row: tuple[str, str, str, str] | None = None


MAPPINGS = (
    Mapping("messages", ("messages[].role:string", "messages[].content:string"), turns=("messages", "role", "content")),
    Mapping("shared", ("conversations[].from:string", "conversations[].value:string"), turns=("conversations", "from", "value")),
    Mapping("dialogue", ("dialogue[].speaker:string", "dialogue[].text:string"), turns=("dialogue", "speaker", "text")),
    Mapping("instruction with input", ("instruction:string", "input:string", "output:string"), parts=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("instruction", ("instruction:string", "output:string"), parts=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction with system", ("system:string", "instruction:string", "input:string", "output:string"), parts=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("prompt and completion", ("prompt:string", "completion:string"), parts=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt and response", ("prompt:string", "response:string"), parts=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question and answer", ("question:string", "answer:string"), parts=(("user", ("question",)), ("assistant", ("answer",)))),
    Mapping("rows by turn", ("conv_id:number", "turn:number", "role:string", "text:string"), row=("conv_id", "turn", "role", "text")),
)
BY_FINGERPRINT = {fingerprint(set(m.paths)): m for m in MAPPINGS}


def mapping_of(paths: set[str]) -> Mapping | None:
    """The mapping whose fingerprint the paths have; failing that, the one with
    most paths whose paths are all among them, other fields being left aside."""
    if (exact := BY_FINGERPRINT.get(fingerprint(paths))) is not None:
        return exact
    inside = [m for m in MAPPINGS if set(m.paths) <= paths]
    return max(inside, key=lambda m: len(m.paths), default=None)


def canonical(record: dict) -> list[tuple[str, str]] | None:
    """The turns of one record; None if no mapping fits it."""
    m = mapping_of(paths_of(record))
    if m is None or m.row:
        return None
    if m.turns:
        items, role, text = m.turns
        return [(ROLES.get(x[role].lower(), x[role]), x[text]) for x in record[items]]
    joined = ((role, "\n\n".join(record[f] for f in fields if record[f])) for role, fields in m.parts)
    return [(role, text) for role, text in joined if text or role != "system"]


def formatted_records(records: DataFrame, column: str = "record") -> DataFrame:
    """``records`` with the JSON of each row's ``column`` as layout, fingerprint and chat.

    Null, malformed and unmapped records have a null layout and a null chat.
    """
    keep = [c for c in records.columns if c not in ("layout", "fingerprint", "chat")]
    out = records.select(*keep)
    schema = T.StructType([*out.schema.fields, *(T.StructField(c, T.StringType()) for c in ("layout", "fingerprint", "chat"))])

    def one(raw: str | None) -> tuple[str | None, str | None, str | None]:
        try:
            record = json.loads(raw) if raw is not None else None
        except (ValueError, RecursionError):
            record = None
        if not isinstance(record, dict):
            return None, None, None
        paths = paths_of(record)
        m = mapping_of(paths)
        turns = canonical(record)
        return m.name if turns is not None else None, fingerprint(paths), formatted(turns) if turns is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(x) for x in batch.column(column).to_pylist()]
            added = [pa.array([f[i] for f in found], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "layout", "fingerprint", "chat"])

    return out.mapInArrow(run, schema)


def formatted_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, chat) of a table whose schema's fingerprint maps to rows by turn.

    Turns are put in order within the task that holds their conversation and
    formatted as they stream by. A null text or role is an empty one; a null
    conv_id is a conversation of its own; rows of equal turn follow in the
    order of role and text.
    """
    m = mapping_of(schema_paths(rows.schema))
    if m is None or m.row is None:
        raise ValueError(f"no mapping of rows for {sorted(schema_paths(rows.schema))}")
    conv, turn, role, text = m.row
    turns = rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        current, parts = none, []
        for batch in batches:
            ids, chats = [], []
            for conv_id, r, t in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if conv_id != current and current is not none:
                    ids.append(current)
                    chats.append("".join(parts))
                    parts = []
                current = conv_id
                parts.append(formatted([(r, t)]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(chats, pa.string())], names=["conv_id", "chat"])
        if current is not none:
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array(["".join(parts)], pa.string())], names=["conv_id", "chat"])

    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, "conv_id long, chat string")


def digests(chats: DataFrame, roles: frozenset[str] = LOSS_ROLES) -> DataFrame:
    """What is read back from each formatted conversation, as digests."""

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for chat in batch.column(1).to_pylist():
                turns = read_back(chat)
                loss = "".join(unescape(chat[a:b]) for a, b in loss_spans(chat, roles))
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(chat)))
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chats.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
