"""Tool mapping: stanzas that say how a tool's JSON input becomes a path, a depth, targets and a description.

Stanzas come from the package's TOML and from a user's; the merged mapping is compiled once to Columns
over a variant, so that mapping millions of calls needs neither a join nor a UDF. Whoever needs another
mapping brings a function of the same shape as ``columns`` (see ``Mapper``).
"""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import NamedTuple, Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import functions as X

VERSION = 1
CODES = {"Unseen": 0, "NameOnly": 1, "Overview": 2, "Signature": 3, "FullBody": 4}
#: Where a user's mapping is looked for, below the working and the home folder.
LOCAL_CONFIG, USER_CONFIG = ".sightline/tools.toml", ".config/sightline/tools.toml"


class Warned(NamedTuple):
    """What is wrong with a mapping; such warnings are returned, not printed."""

    kind: str  # parse, version, empty_names, duplicate, missing_depth, empty_patterns
    text: str


@dataclass(frozen=True)
class Stanza:
    names: tuple[str, ...]
    path_keys: tuple[str, ...] = ()
    pattern_keys: tuple[str, ...] = ()
    path_required: bool = True
    depth: dict = field(default_factory=dict)
    description: str = ""
    symbol_key: str | None = None
    line_keys: tuple[str, str] | None = None
    extends: str | None = None


class Mapper(Protocol):
    """Struct(file_path, read_depth, description, target_symbol, target_start, target_end) of a tool call."""

    def __call__(self, name: Column, f: Fields, stanzas: list[Stanza]) -> Column: ...


# --- loading --------------------------------------------------------------------------------------------


def _depth_spec(spec: dict) -> dict:
    """``spec`` if every depth that it names is one."""
    kind = spec["type"]
    named = {"fixed": lambda: [spec["value"]], "conditional": lambda: [spec["if_true"], spec["if_false"], spec["default"]], "pattern_match": lambda: [spec["default"], *(p["depth"] for p in spec["patterns"])]}[kind]()
    if kind == "conditional":
        spec["condition_key"]
    if kind == "pattern_match":
        spec["key"], [p["prefix"] for p in spec["patterns"]]
        if {p.get("match_type", "prefix") for p in spec["patterns"]} - {"prefix", "contains", "exact"}:
            raise KeyError("match_type")
    if unknown := set(named) - set(CODES):
        raise KeyError(f"depth {sorted(unknown)}")
    return spec


def parse(text: str) -> list[Stanza]:
    """Stanzas of a TOML mapping; ValueError if it is none, or of a newer version than ours."""
    data = tomllib.loads(text)
    version = data.get("version")
    if not isinstance(version, int) or isinstance(version, bool) or version < 0:
        raise ValueError("a mapping needs a version")
    if version > VERSION:
        raise ValueError(f"mapping version {version} is not supported (at most {VERSION})")
    out = []
    try:
        for t in data.get("tool", []):
            lines = t.get("target_lines")
            out.append(Stanza(
                tuple(t["names"]), tuple(t["path_keys"]), tuple(t.get("pattern_keys", ())), t.get("path_required", True), _depth_spec(t["depth"]) if "depth" in t else {}, t["description"],
                t["target_symbol"]["key"] if "target_symbol" in t else None, (lines["offset_key"], lines["limit_key"]) if lines else None, t.get("extends"),
            ))
    except (KeyError, TypeError) as e:
        raise ValueError(f"stanza {len(out)}: {e}") from e
    return out


def load(path: str) -> tuple[list[Stanza] | None, list[Warned]]:
    """A user's mapping; whatever is wrong with it as a whole is a warning, and there is none then."""
    try:
        return parse(Path(path).read_text(encoding="utf-8")), []
    except (OSError, ValueError) as e:
        return None, [Warned("version" if "version" in str(e) and "supported" in str(e) else "parse", f"{path}: {e}")]


#: The stanzas of the package.
DEFAULTS = tuple(parse(Path(__file__).with_name("default_tools.toml").read_text(encoding="utf-8")))


def find_config(given: str | None = None, cwd: str | None = None, home: str | None = None) -> str | None:
    """The user's mapping: the given file if it exists, else the working folder's, else the home folder's."""
    home = home or os.environ.get("HOME") or os.environ.get("USERPROFILE")
    places = [given, os.path.join(cwd or os.getcwd(), LOCAL_CONFIG), os.path.join(home, USER_CONFIG) if home else None]
    return next((p for p in places if p and os.path.exists(p)), None)


def resolve(given: str | None = None, cwd: str | None = None, home: str | None = None) -> tuple[list[Stanza], list[Warned]]:
    """The mapping in force, and what is wrong with the user's."""
    path = find_config(given, cwd, home)
    user, warnings = load(path) if path else (None, [])
    if user is None:
        return list(DEFAULTS), warnings
    merged, more = merge(DEFAULTS, user)
    return merged, warnings + more


def merge(base: tuple[Stanza, ...], user: list[Stanza]) -> tuple[list[Stanza], list[Warned]]:
    """User stanzas over the base, with warnings.

    A name belongs to the last user stanza that lists it, and a stanza that has no name left goes.
    ``extends`` fills what is empty from the base stanza of that name; a stanza that still has no depth
    goes. A base stanza that shares any name with what is left is dropped whole.
    """
    warnings: list[Warned] = []
    owner: dict[str, int] = {}
    for i, s in enumerate(user):
        for n in s.names:
            if n in owner:
                warnings.append(Warned("duplicate", f"name {n!r} in stanzas {owner[n]} and {i}; stanza {i} wins"))
            owner[n] = i
    full: list[Stanza] = []
    for i, s in enumerate(user):
        if not s.names:
            warnings.append(Warned("empty_names", f"stanza {i} has no names"))
        elif i in owner.values():
            parent = next((b for b in base if s.extends in b.names), None) if s.extends else None
            if parent:
                s = replace(s, path_keys=s.path_keys or parent.path_keys, pattern_keys=s.pattern_keys or parent.pattern_keys, depth=s.depth or parent.depth, symbol_key=s.symbol_key or parent.symbol_key, line_keys=s.line_keys or parent.line_keys)
            if not s.depth:
                warnings.append(Warned("missing_depth", f"stanza {i} has no depth"))
                continue
            if s.depth["type"] == "pattern_match" and not s.depth["patterns"]:
                warnings.append(Warned("empty_patterns", f"stanza {i} has no patterns, its default always holds"))
            full.append(s)
    taken = {n for s in full for n in s.names}
    return [b for b in base if not taken & set(b.names)] + full, warnings


# --- Columns --------------------------------------------------------------------------------------------


def typed(v: Column, path: str, kind: str = "STRING") -> Column:
    """A field of exactly this type; anything else is as good as absent."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == kind, F.try_variant_get(v, path, kind.lower()))


def _at(key: str) -> str:
    """The variant path of a key."""
    return f"$.{key}" if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", key) else f"$['{key}']"


class Fields:
    """The fields of a tool's input that a mapping names; each (path, type) is one column, whoever reads it.

    ``sources.records.events`` fills the columns of all that has been asked for, in one walk of each record.
    """

    def __init__(self, prefix: str = "_in"):
        self.prefix, self.found = prefix, {}

    def typed(self, path: str, kind: str = "STRING") -> Column:
        """A field of exactly this type; anything else is as good as absent."""
        return F.col(f"{self.prefix}{self.found.setdefault((path, kind), len(self.found))}")

    def whole(self, key: str) -> Column:
        """A whole number from 0 below 2^64, by its lowest 32 bits."""
        return self.typed(_at(key), "WHOLE")

    def names(self) -> list[str]:
        return [f"{self.prefix}{i}" for i in range(len(self.found))]


def _first(f: Fields, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*(f.typed(_at(k)) for k in keys)) if keys else F.lit(None).cast("string")


def _depth(f: Fields, spec: dict) -> Column:
    kind = spec["type"]
    if kind == "fixed":
        return F.lit(CODES[spec["value"]])
    if kind == "conditional":
        flag = f.typed(_at(spec["condition_key"]), "BOOLEAN")
        return F.when(flag, CODES[spec["if_true"]]).when(~flag, CODES[spec["if_false"]]).otherwise(CODES[spec["default"]])
    text, out = F.coalesce(f.typed(_at(spec["key"])), F.lit("")), None
    tests = {"prefix": F.startswith, "contains": F.contains, "exact": lambda a, b: a == b}
    for p in spec["patterns"]:
        test = tests[p.get("match_type", "prefix")](text, F.lit(p["prefix"]))
        out = F.when(test, CODES[p["depth"]]) if out is None else out.when(test, CODES[p["depth"]])
    return F.lit(CODES[spec["default"]]) if out is None else out.otherwise(CODES[spec["default"]])


def _describe(f: Fields, template: str, display: Column) -> Column:
    """The template with its ``{key}``, ``{key|short}`` and ``{key|cmd}``; braces around anything else are text."""
    parts, at = [], 0
    for m in re.finditer(r"\{([A-Za-z_][A-Za-z0-9_]*)(?:\|(short|cmd))?\}", template):
        own = f.typed(_at(m[1]))
        value = F.coalesce(display, own, F.lit("?")) if m[1] == "pattern" else F.coalesce(own, F.lit("?"))
        value = X.short_path(value) if m[2] == "short" else X.truncate_command(value) if m[2] == "cmd" else value
        parts += [F.lit(template[at : m.start()]), value]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def columns(name: Column, f: Fields, stanzas: list[Stanza]) -> Column:
    """Struct(file_path, read_depth, description, target_symbol, target_start, target_end) of a tool call.

    ``f`` gives the fields of the call's input. Of several stanzas that list a name the last holds. A call of an unknown
    tool, or one that lacks its required path, is an untracked call of depth Unseen.
    """
    null = F.lit(None)
    owner = {n: i for i, s in enumerate(stanzas) for n in s.names}
    out = None
    for i, s in enumerate(stanzas):
        own = [n for n in s.names if owner[n] == i]
        if not own:
            continue
        path = _first(f, s.path_keys)
        display = F.coalesce(_first(f, s.pattern_keys), f.typed("$.todos[0].content"), path)
        start, count = (f.whole(k) for k in s.line_keys) if s.line_keys else (null.cast("bigint"), null.cast("bigint"))
        ranged = start.isNotNull() & count.isNotNull()
        row = F.struct(path.alias("file_path"), _depth(f, s.depth).alias("read_depth"), _describe(f, s.description, display).alias("description"),
                       (f.typed(_at(s.symbol_key)) if s.symbol_key else null.cast("string")).alias("target_symbol"), F.when(ranged, start).alias("target_start"), F.when(ranged, (start + count) % (1 << 32)).alias("target_end"))
        test = name.isin(*own) & (path.isNotNull() if s.path_required else F.lit(True))
        out = F.when(test, row) if out is None else out.when(test, row)
    other = F.struct(null.cast("string").alias("file_path"), F.lit(0).alias("read_depth"), F.concat(name, F.lit(" (untracked)")).alias("description"), null.cast("string").alias("target_symbol"), null.cast("bigint").alias("target_start"), null.cast("bigint").alias("target_end"))
    return other if out is None else out.otherwise(other)
