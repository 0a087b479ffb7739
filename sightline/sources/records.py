"""Records of session logs as rows: each JSON line is walked once, and what is asked for comes out as typed columns.

Variants would do it within the plan, but a cast of theirs takes microseconds a field, and a mapping asks for some
forty. One decoder call a line and one lookup a field are ten times as fast; everything after it is columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.toolmap import Fields

#: What is read of a record itself: (column, path, type).
TOP = (
    ("type", "$.type", "STRING"), ("subtype", "$.subtype", "STRING"), ("ts", "$.timestamp", "STRING"), ("agent", "$.agentId", "STRING"), ("session", "$.sessionId", "STRING"),
    ("flag", "$.isCompactSummary", "BOOLEAN"), ("text", "$.message.content", "STRING"), ("trigger", "$.compactMetadata.trigger", "STRING"),
    ("pre", "$.compactMetadata.preTokens", "BIGINT"), ("post", "$.compactMetadata.postTokens", "BIGINT"), ("took", "$.compactMetadata.durationMs", "BIGINT"),
)
_SQL = {"STRING": "string", "BOOLEAN": "boolean", "BIGINT": "bigint", "WHOLE": "bigint"}
_ARROW = {"STRING": pa.string(), "BOOLEAN": pa.bool_(), "BIGINT": pa.int64(), "WHOLE": pa.int64()}
_STEP = re.compile(r"\.([A-Za-z0-9_]+)|\['([^']*)'\]|\[([0-9]+)\]")


def steps(path: str) -> list[str | int]:
    """``$.todos[0].content`` as todos, 0, content."""
    return [int(m[3]) if m[3] else m[2] if m[2] is not None else m[1] for m in _STEP.finditer(path)]


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def parse(raw: str | None) -> Any:
    """A JSON text's value; None where it is none, or has text that is no Unicode."""
    if not raw:
        return None
    try:
        value = _DECODER.decode(raw)
        if "\\ud" in raw or "\\uD" in raw:
            json.dumps(value, ensure_ascii=False).encode()
        return value
    except (ValueError, RecursionError):
        return None


_DECODER = json.JSONDecoder(parse_constant=_no_constant)


def field(value: Any, way: list[str | int], kind: str) -> Any:
    """What lies at the end of a way, if it is of exactly this type."""
    for step in way:
        if isinstance(step, int):
            value = value[step] if isinstance(value, list) and step < len(value) else None
        else:
            value = value.get(step) if isinstance(value, dict) else None
    if kind == "STRING":
        return value if isinstance(value, str) else None
    if kind == "BOOLEAN":
        return value if isinstance(value, bool) else None
    if not isinstance(value, int) or isinstance(value, bool):
        return None
    if kind == "WHOLE":
        return value & 0xFFFFFFFF if 0 <= value < 1 << 64 else None
    return value if -(1 << 63) <= value < 1 << 63 else None


def rows_of(record: Any) -> list[tuple[int | None, str | None, Any]]:
    """(place, name, input) of each tool block of an assistant's record; one row without a tool for any other record."""
    if not isinstance(record, dict):
        return []
    if record.get("type") != "assistant":
        return [(None, None, None)]
    content = field_list(record)
    return [(at, b["name"], b.get("input")) for at, b in enumerate(content) if isinstance(b, dict) and b.get("type") == "tool_use" and isinstance(b.get("name"), str)]


def field_list(record: dict) -> list:
    message = record.get("message")
    content = message.get("content") if isinstance(message, dict) else None
    return content if isinstance(content, list) else []


def events(lines: DataFrame, inputs: Fields, raw: str = "raw") -> DataFrame:
    """A row for every tool block, and for every record that is no assistant's: the columns of ``lines`` but ``raw``, and

    ``_type``, ``_ts`` and the like of TOP, ``_named`` (has an agent), ``block_pos``, ``tool_name`` and the fields of ``inputs``.
    """
    kept = [c for c in lines.columns if c != raw]
    top = [(f"_{n}", p, k) for n, p, k in TOP]
    asked = [(n, p, k) for n, (p, k) in zip(inputs.names(), inputs.found, strict=True)]
    kinds = {n: k for n, _, k in top + asked}
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in lines.select(*kept).schema]
    made = [f"`{n}` {_SQL[k]}" for n, k in kinds.items()] + ["_named boolean", "block_pos int", "tool_name string"]
    of_record, of_input = by_key(top), by_key(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            named, places, tools = [], [], []
            cols: dict[str, dict[int, Any]] = {n: {} for n in kinds}
            for i, text in enumerate(batch.column(len(kept)).to_pylist()):
                record = parse(text)
                for place, name, given in rows_of(record):
                    fill(cols, len(at), record, of_record)
                    if isinstance(given, dict):
                        fill(cols, len(at), given, of_input)
                    at.append(i)
                    named.append("agentId" in record)
                    places.append(place)
                    tools.append(name)
            if not at:
                continue
            passed = batch.take(pa.array(at, pa.int64()))
            arrays = [passed.column(i) for i in range(len(kept))]
            arrays += [pa.array(map(cols[n].get, range(len(at))), _ARROW[k], size=len(at)) if cols[n] else pa.nulls(len(at), _ARROW[k]) for n, k in kinds.items()]
            arrays += [pa.array(named, pa.bool_()), pa.array(places, pa.int32()), pa.array(tools, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *kinds, "_named", "block_pos", "tool_name"])

    return lines.select(*kept, raw).mapInArrow(run, ", ".join(own + made))


def by_key(fields: list[tuple[str, str, str]]) -> dict[str, list[tuple[str, list[str | int], str]]]:
    """Fields (column, path, type) by the first key of their paths, so that only keys that a record has are looked at."""
    out: dict[str, list[tuple[str, list[str | int], str]]] = {}
    for name, path, kind in fields:
        first, *rest = steps(path)
        out.setdefault(first, []).append((name, rest, kind))
    return out


def fill(cols: dict[str, dict[int, Any]], row: int, record: dict, fields: dict[str, list]) -> None:
    for key, value in record.items():
        for name, way, kind in fields.get(key, ()):
            if (found := field(value, way, kind)) is not None:
                cols[name][row] = found
