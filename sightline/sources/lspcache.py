"""Symbols from a language server's pickled caches, as a source of the same tables as ``code``.

A pickle can run code when it is loaded, so these are read by an unpickler that knows no class but
stand-ins: whatever object a cache names becomes the mapping of its state.
"""

from __future__ import annotations

import hashlib
import io
import pickle
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .code import FILES
from .tree import SYMBOLS, Node, rows

#: Symbol kinds of the language server protocol, their category and label.
KINDS = {
    2: ("module", "module"), 3: ("module", "namespace"), 5: ("type", "class"), 6: ("function", "method"), 7: ("variable", "property"), 8: ("variable", "field"),
    9: ("function", "constructor"), 10: ("type", "enum"), 11: ("type", "interface"), 12: ("function", "function"), 13: ("variable", "variable"), 14: ("variable", "constant"),
    19: ("impl", "impl"), 22: ("variable", "enum_member"), 23: ("type", "struct"), 26: ("type", "type_param"),
}
DEFAULT_KIND = 12
#: Estimates where there is no source: tokens of a line, characters of a line.
LINE_TOKENS, LINE_CHARS = 15, 40
_RAW, _DOCUMENTS = "raw_document_symbols.pkl", "document_symbols.pkl"


class _State(dict):
    """In place of any class: an object becomes the mapping of its state."""

    def __init__(self, *args: object, **more: object):
        super().__init__()

    def __setstate__(self, state: object) -> None:
        parts = state if isinstance(state, tuple) else (state,)
        for part in parts:
            if isinstance(part, dict):
                self.update(part)


class _Reader(pickle.Unpickler):
    def find_class(self, module: str, name: str) -> type:
        return _State

    def persistent_load(self, pid: object) -> object:
        raise pickle.UnpicklingError("external objects are not read")


def load(raw: bytes) -> Any:
    """The plain values of a pickle; nothing in it is run."""
    return _Reader(io.BytesIO(raw)).load()


def caches(root: str) -> list[str]:
    """One cache of each language: the raw symbols, else the documents'."""
    out = []
    for folder in sorted(Path(root, ".serena", "cache").glob("*/")):
        found = next((folder / n for n in (_RAW, _DOCUMENTS) if (folder / n).exists()), None)
        if found:
            out.append(str(found))
    return out


def _int(value: object, other: int = 0) -> int:
    return value if isinstance(value, int) and not isinstance(value, bool) else other


def _get(value: object, *keys: str) -> object:
    for k in keys:
        value = value.get(k) if isinstance(value, dict) else None
    return value


def node(value: object) -> Node | None:
    """A symbol and its children; None if it has no name."""
    name = _get(value, "name")
    if not isinstance(name, str):
        return None
    kind = _int(_get(value, "kind"), DEFAULT_KIND)
    first, last = _int(_get(value, "range", "start", "line")), _int(_get(value, "range", "end", "line"))
    start = first * LINE_CHARS + _int(_get(value, "range", "start", "character"))
    end = last * LINE_CHARS + _int(_get(value, "range", "end", "character"))
    below = _get(value, "children")
    identity = hashlib.sha256(repr((name, kind, first, last)).encode("utf-8", "surrogatepass")).hexdigest()
    return Node(name, *KINDS.get(kind, ("unknown", "unknown")), start, end, (first + 1, last + 1), [n for c in (below if isinstance(below, list) else []) if (n := node(c))], identity, (last - first + 1 if last > first else 1) * LINE_TOKENS)


def documents(raw: bytes, is_raw: bool) -> list[tuple[str, list[Node]]]:
    """(path, root symbols) of a cache; entries that are too short are passed over, other faults are errors."""
    entries = _get(load(raw), "obj")
    if not isinstance(entries, dict):
        raise ValueError("a cache needs a mapping 'obj'")
    out = []
    for path, entry in entries.items():
        if not isinstance(path, str) or not isinstance(entry, tuple):
            raise ValueError(f"not an entry of a cache: {path!r}")
        if len(entry) < 2:
            continue
        listed = None if is_raw else _get(entry[1], "root_symbols")
        listed = listed if isinstance(listed, list) else entry[1]
        if not isinstance(listed, list):
            raise ValueError(f"no symbols for {path}")
        out.append((path, [n for s in listed if (n := node(s))]))
    return out


def scan(spark: SparkSession, root: str, keep: Callable[[str], bool] | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, symbols) of all caches of a project; the path filter applies after decoding.

    A cache is a row, decoded in one task: a pickle has no parts that can be read alone.
    """
    found = caches(root)
    if not found:
        raise FileNotFoundError(f"no language-server cache below {root}")

    def decode(kind: str):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for path, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    docs = [(p, r) for p, r in documents(raw, path.endswith("/" + _RAW)) if keep is None or keep(p)]
                    if kind == "files":
                        got = [(p, max((n.lines[1] for n in r), default=0)) for p, r in docs]
                    else:
                        got = [row for p, r in docs for row in rows(p, None, r)]
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), types[kind], strict=True)], names=names[kind])

        return run

    from .code import _arrow

    schemas = {"files": FILES, "symbols": SYMBOLS}
    types = {k: _arrow(spark, v) for k, v in schemas.items()}
    names = {k: [x.split()[0] for x in v.split(", ")] for k, v in schemas.items()}
    raw = spark.read.format("binaryFile").load([f"file://{Path(p).resolve()}" for p in found]).select("path", "content")
    return raw.mapInArrow(decode("files"), FILES), raw.mapInArrow(decode("symbols"), SYMBOLS)
