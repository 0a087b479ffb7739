"""Chat formatting: records of any known layout become canonical turns, and turns one marked-up text with a loss mask.

A record is a JSON object. The paths of its leaves (``messages[].role``) that some mapping names are hashed into the
record's fingerprint; the fingerprint alone selects the mapping, a declaration of where each turn's role and
text lie. A mapping has one fingerprint for each set of its optional paths, so the table of fingerprints is
made once and a record costs one walk and one lookup.

The template marks turns with ``START role SEP text END``. Control strings inside roles and texts get a backslash
after their first character (one more than they have there), so no marker but the template's own
is in the output and reading back takes exactly that backslash away.

Defined results: a null text or role is an empty one, of a number its JSON. A record that is null, no JSON object, or of a
fingerprint without mapping (no paths known, or those of two layouts at once) has null ``layout``, no turns and an empty
text; paths that no mapping names change nothing. An absent or empty optional text makes no turn. An empty list has no
turns, under the name of its layout. Repeated rows and ids each give their own row; other columns are not read.
Rows of a conversation (``gather``) come by turn, then role, then text, nulls first; repeated rows are turns of their own.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that a text must not hold as they are: the template's own, and those of other common templates.
CONTROL = (START, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
#: Names of roles in the layouts that say who speaks ("from"), and what they are called here. Other names stay.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
#: The role under the loss mask.
LEARNED = "assistant"


@dataclass(frozen=True)
class Mapping:
    """A layout: where its turns lie.

    ``turns`` lists (role, path of the text); a role that starts with ``@`` is the path of its name. Paths with the same
    ``x[]`` step belong to the elements of one list. ``optional`` paths may be absent.
    """

    name: str
    turns: tuple[tuple[str, str], ...]
    optional: frozenset[str] = frozenset()

    def paths(self) -> set[str]:
        return {p for role, text in self.turns for p in (text, *([role[1:]] if role.startswith("@") else []))}


MAPPINGS = (
    Mapping("messages", (("@messages[].role", "messages[].content"),)),
    Mapping("message_parts", (("@messages[].role", "messages[].content[].text"),)),
    Mapping("turns", (("@turns[].role", "turns[].text"),)),
    Mapping("conversations", (("system", "system"), ("@conversations[].from", "conversations[].value")), frozenset({"system"})),
    Mapping("prompt_completion", (("system", "system"), ("user", "prompt"), ("assistant", "completion")), frozenset({"system"})),
    Mapping("prompt_response", (("system", "system"), ("user", "prompt"), ("assistant", "response")), frozenset({"system"})),
    Mapping("question_answer", (("system", "system"), ("user", "question"), ("assistant", "answer")), frozenset({"system"})),
    Mapping("instruction", (("system", "system"), ("user", "instruction+input"), ("assistant", "output")), frozenset({"system", "input"})),
)


def _steps(path: str) -> list[str]:
    """``a[].b`` as a, [], b."""
    return [s for part in path.split(".") for s in re.split(r"(\[\])", part) if s]


def _parts(path: str) -> list[str]:
    """The paths that are joined by blank lines to one text."""
    return path.split("+")


def fingerprint(paths: set[str]) -> int:
    """A hash of a set of paths, whatever their order."""
    return int.from_bytes(hashlib.sha256("\n".join(sorted(paths)).encode()).digest()[:8], "little", signed=True)


class Layouts:
    """The mappings by fingerprint."""

    def __init__(self, mappings: tuple[Mapping, ...] = MAPPINGS):
        self.known = {p for m in mappings for whole in m.paths() for p in _parts(whole)}
        self.lists = {p[: p.rindex("[]") + 2] for p in self.known if "[]" in p}
        self.by_print: dict[int, Mapping] = {}
        for m in mappings:
            own = {p for whole in m.paths() for p in _parts(whole)}
            empty = {p for p in self.lists if any(q.startswith(p) for q in own)}
            for r in range(len(m.optional) + 1):
                for absent in combinations(sorted(m.optional), r):
                    self._add(own - set(absent), m)
            # A list without elements has no paths below it, but its own.
            for e in (e for e in empty if e.count("[]") == 1):
                for rest in ({p for p in own if not p.startswith(e)}, {p for p in own - m.optional if not p.startswith(e)}):
                    self.by_print.setdefault(fingerprint({e, *rest}), m)

    def _add(self, paths: set[str], mapping: Mapping) -> None:
        if self.by_print.setdefault(fingerprint(paths), mapping) != mapping:
            raise ValueError(f"{mapping.name}: another mapping has these paths")

    def paths_of(self, record: Any) -> set[str]:
        """The known paths that a record holds; a list without elements counts as its own path."""
        found: set[str] = set()
        todo = [("", record)]
        while todo:
            at, value = todo.pop()
            if isinstance(value, dict):
                todo += ((f"{at}.{k}" if at else k, v) for k, v in value.items())
            elif isinstance(value, list):
                todo += ((f"{at}[]", v) for v in value)
                if not value:
                    found.add(f"{at}[]")
            else:
                found.add(at)
        return {p for p in found if p in self.known or p in self.lists}

    def turns(self, record: Any) -> tuple[str | None, int, list[tuple[str, str]]]:
        """(layout, fingerprint, canonical turns) of a record."""
        key = fingerprint(self.paths_of(record)) if isinstance(record, dict) else 0
        mapping = self.by_print.get(key) if isinstance(record, dict) else None
        if mapping is None:
            return None, key, []
        out: list[tuple[str, str]] = []
        for role, text in mapping.turns:
            if role.startswith("@"):
                head = role[1 : role.index("[]")]
                for element in record.get(head) or []:
                    name = _text(_at(element, _steps(role[len(head) + 4 :])))
                    out.append((ROLES.get(name, name) if role.endswith(".from") else name, _text(_at(element, _steps(text[len(head) + 3 :])))))
                continue
            found = [_text(v) for p in _parts(text) if (v := _at(record, _steps(p))) not in (None, "") or p not in mapping.optional]
            if found:
                out.append((role, "\n\n".join(found)))
        return mapping.name, key, out


def _at(value: Any, steps: list[str]) -> Any:
    """What lies below ``steps``; below a list step, the texts of all elements that have one, joined."""
    for i, step in enumerate(steps):
        if step == "[]":
            if not isinstance(value, list):
                return None
            below = [_at(v, steps[i + 1 :]) for v in value]
            return "".join(_text(v) for v in below)
        if not isinstance(value, dict):
            return None
        value = value.get(step)
    return value


def _text(value: Any) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value)


# --- template -------------------------------------------------------------------------------------------

_TAILS = "|".join(re.escape(c[1:]) for c in CONTROL)
_HEADS = "".join({re.escape(c[0]) for c in CONTROL})
_MARK = re.compile(rf"([{_HEADS}])(\\*)(?=(?:{_TAILS}))")
_ESCAPED = re.compile(rf"([{_HEADS}])\\(\\*)(?=(?:{_TAILS}))")
_TURN = re.compile(rf"{re.escape(START)}(.*?){re.escape(SEP)}(.*?){re.escape(END)}\n", re.S)


def escape(text: str) -> str:
    """One backslash more in every control string; no first character of one occurs later in one, so they never overlap."""
    return _MARK.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, spans of code points under the loss mask: the learned role's escaped texts)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, END, "\n")
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns that a formatted text was made of."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


# --- DataFrames -----------------------------------------------------------------------------------------


def gather(rows: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(id, record): the rows of each conversation as one JSON record of the layout ``turns``.

    A conversation is one text in the end, so it is one row here; the rows of different ones never meet.
    """
    listed = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))))
    return rows.groupBy(id_col).agg(F.to_json(F.struct(listed.alias("turns")), {"ignoreNullFields": "false"}).alias("record"))


def format_chats(records: DataFrame, id_col: str = "conv_id", record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(id, layout, fingerprint, turns, formatted, loss_spans) of every record. Narrow: no shuffle."""
    schema = f"`{id_col}` {records.schema[id_col].dataType.simpleString()}, layout string, fingerprint long, turns array<struct<role:string,text:string>>, formatted string, loss_spans array<struct<start:long,end:long>>"
    turn_type = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layouts = Layouts(mappings)
        for part in slices(batches):
            made = [layouts.turns(_parsed(r)) for r in part.column(1).to_pylist()]
            texts = [render(turns) for _, _, turns in made]
            yield pa.RecordBatch.from_pydict({
                id_col: part.column(0), "layout": pa.array([m[0] for m in made], pa.string()), "fingerprint": pa.array([m[1] for m in made], pa.int64()),
                "turns": pa.array([[{"role": r, "text": t} for r, t in m[2]] for m in made], turn_type),
                "formatted": pa.array([t[0] for t in texts], pa.string()),
                "loss_spans": pa.array([[{"start": a, "end": b} for a, b in t[1]] for t in texts], span_type),
            })

    return records.select(id_col, record_col).mapInArrow(run, schema)


def _parsed(record: str | None) -> Any:
    try:
        return json.loads(record) if record else None
    except ValueError:
        return None


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the formatted texts and their loss spans alone."""
    schema = f"`{id_col}` {formatted.schema[id_col].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    hexed = lambda t: hashlib.sha256(t.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out: list[tuple] = []
            for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                out.append((len(turns), hexed("".join(f"{role}\n{said}\n" for role, said in turns)), len(loss), hexed(loss), len(text)))
            cols = list(zip(*out, strict=True))
            names, types = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_pydict({id_col: part.column(0)} | {n: pa.array(c, t) for n, c, t in zip(names, cols, types, strict=True)})

    return formatted.select(id_col, "formatted", "loss_spans").mapInArrow(run, schema)
