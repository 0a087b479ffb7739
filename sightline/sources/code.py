"""Source trees as tables: which files are read, and their symbols."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import lang_python, lang_rust, lang_typescript
from .tree import SYMBOLS, Node, rows, total_lines

FILES = "file_path string, total_lines long"


class Language(Protocol):
    """What a language has to bring: file extensions, and symbols of a source text. A module will do."""

    EXTENSIONS: tuple[str, ...]

    def extract(self, source: str) -> list[Node]: ...


@dataclass
class Registry:
    """Languages by extension; of two for one extension the first holds."""

    languages: list[Language] = field(default_factory=list)

    def register(self, language: Language) -> None:
        self.languages.append(language)

    def extensions(self) -> set[str]:
        return {e for x in self.languages for e in x.EXTENSIONS}

    def language(self, path: str) -> Language | None:
        extension = os.path.splitext(path)[1].removeprefix(".")
        return next((x for x in self.languages if extension in x.EXTENSIONS), None)


def builtin() -> Registry:
    return Registry([lang_rust, lang_python, lang_typescript])


def symbols(sources: DataFrame, registry: Registry | None = None) -> DataFrame:
    """The symbols of ``sources`` (file_path, source), in the columns of ``tree.SYMBOLS``.

    One pass without a shuffle; a file is one row, and its symbols are in memory one file at a time.
    Files of no known extension, null sources, and files that a language fails on give no symbols.
    """
    known = registry or builtin()
    names = [x.split()[0] for x in SYMBOLS.split(", ")]
    types = _arrow(sources.sparkSession, SYMBOLS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: list = []
        for batch in batches:
            for path, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                language = known.language(path) if path and source is not None else None
                try:
                    whole += list(rows(path, source, language.extract(source))) if language else []
                except (ValueError, IndexError, RecursionError):
                    pass
                if len(whole) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*whole, strict=True), types, strict=True)], names=names)
                    whole = []
        if whole:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*whole, strict=True), types, strict=True)], names=names)

    return sources.select("file_path", "source").mapInArrow(run, SYMBOLS)


def _arrow(spark: SparkSession, ddl: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in StructType.fromDDL(ddl).fields]


def files(sources: DataFrame, registry: Registry | None = None) -> DataFrame:
    """(file_path, total_lines) of ``sources`` that a language reads."""
    extension = F.regexp_extract("file_path", r"[^/]\.([^./]+)$", 1)
    feeds = F.length("source") - F.length(F.replace("source", F.lit("\n"), F.lit("")))
    unfinished = (F.length("source") > 0) & ~F.endswith("source", F.lit("\n"))
    return sources.where(extension.isin(*sorted((registry or builtin()).extensions())) & F.col("source").isNotNull()).select("file_path", (feeds + unfinished.cast("int")).cast("long").alias("total_lines"))


# --- which files ----------------------------------------------------------------------------------------


def _glob(pattern: str) -> str:
    """The regular expression of an ignore pattern without slashes at its ends."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + r"(?:.*/)?", i + 3
        elif pattern.startswith("/**", i) and i + 3 == len(pattern):
            out, i = out + r"/.*", i + 3
        elif pattern[i] == "*":
            out, i = out + r"[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + r"[^/]", i + 1
        elif pattern[i] == "[" and (end := pattern.find("]", i + 2)) > 0:
            out, i = out + fnmatch.translate(pattern[i : end + 1]).removeprefix("(?s:").removesuffix(r")\z").removesuffix(r")\Z"), end + 1
        elif pattern[i] == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return out


@dataclass(frozen=True)
class _Rule:
    base: str  # the folder of the ignore file
    test: re.Pattern[str]
    keep: bool
    folders: bool


def _rules(path: Path) -> list[_Rule]:
    out = []
    for line in path.read_text(errors="replace").splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        keep, line = line.startswith("!"), line.removeprefix("!")
        folders, line = line.endswith("/"), line.rstrip("/")
        anchored, line = "/" in line, line.removeprefix("/")
        if line:
            out.append(_Rule(str(path.parent), re.compile((r"" if anchored else r"(?:.*/)?") + _glob(line) + r"\Z", re.S), keep, folders))
    return out


def _ignored(path: str, folder: bool, rules: list[_Rule]) -> bool:
    """The last rule that fits decides."""
    for r in reversed(rules):
        if (folder or not r.folders) and path.startswith(r.base + "/") and r.test.match(path[len(r.base) + 1 :]):
            return not r.keep
    return False


class Tree:
    """The folders below a root, without hidden entries and what ``.ignore`` files, and in a git work tree ``.gitignore`` files, exclude."""

    def __init__(self, root: str):
        self.top = Path(root).resolve()
        in_git = any((p / ".git").exists() for p in (self.top, *self.top.parents))
        self.names = [".gitignore"] * in_git + [".ignore"]
        above = [p for p in reversed(self.top.parents) if in_git]
        #: The rules that hold in the root itself.
        self.start = self._with([r for p in above for n in self.names if (p / n).is_file() for r in _rules(p / n)], str(self.top))

    def _with(self, rules: list[_Rule], folder: str) -> list[_Rule]:
        return rules + [r for n in self.names if os.path.isfile(f"{folder}/{n}") for r in _rules(Path(folder, n))]

    def list(self, folder: str, rules: list[_Rule]) -> tuple[list[str], list[str]]:
        """(folders, files) of a folder in which ``rules`` hold, as relative paths in order."""
        folders, files = [], []
        try:
            entries = sorted(os.scandir(self.top / folder), key=lambda e: e.name)
        except OSError:
            return folders, files
        for e in entries:
            is_folder = e.is_dir(follow_symlinks=False)
            if not e.name.startswith(".") and not _ignored(e.path, is_folder, rules) and (is_folder or e.is_file()):
                (folders if is_folder else files).append(os.path.relpath(e.path, self.top))
        return folders, files

    def walk(self, folder: str, rules: list[_Rule], deep: bool = True, enter: Callable[[str], bool] = lambda folder: True) -> Iterator[str]:
        """The files below a folder; ``rules`` are those of the folder above it (of the root: its own)."""
        own = self._with(rules, str(self.top / folder)) if folder else rules
        folders, files = self.list(folder, own)
        yield from files
        for f in folders if deep else ():
            if enter(f):
                yield from self.walk(f, own, True, enter)


def project_files(root: str, keep: Callable[[str], bool] | None = None, registry: Registry | None = None) -> list[str]:
    """Relative paths of the sources below ``root`` (``Tree``), in the order of their components.

    ``keep`` sees a relative path before anything of the file is read.
    """
    known, tree = registry or builtin(), Tree(root)
    found = [p for p in tree.walk("", tree.start) if known.language(p) and (keep is None or keep(p))]
    return sorted(found, key=lambda p: p.split("/"))


def read_sources(spark: SparkSession, root: str, paths: Iterable[str]) -> DataFrame:
    """(file_path, source) of files below ``root``; a file that is not UTF-8 fails the scan, when it is read."""
    top, paths = str(Path(root).resolve()), list(paths)
    # Spark's reader passes over files without content.
    empty = [p for p in paths if not os.path.getsize(f"{top}/{p}")]
    nothing = spark.createDataFrame([(p, "") for p in empty], "file_path string, source string")
    paths = [p for p in paths if p not in set(empty)]
    if not paths:
        return nothing
    found = spark.read.format("binaryFile").load([f"file://{_escaped(f'{top}/{p}')}" for p in paths])
    relative = F.substr(F.regexp_replace("path", "^file:(//)?", ""), F.lit(len(top) + 2))
    bad = F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("path"))).cast("string")
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), bad)
    return found.select(relative.alias("file_path"), text.alias("source")).unionByName(nothing)


def _escaped(path: str) -> str:
    """A path as a pattern that fits it alone."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def scan(spark: SparkSession, root: str, keep: Callable[[str], bool] | None = None, registry: Registry | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, symbols) of a project."""
    sources = read_sources(spark, root, project_files(root, keep, registry))
    return files(sources, registry), symbols(sources, registry)


__all__ = ["FILES", "SYMBOLS", "Language", "Registry", "builtin", "files", "project_files", "read_sources", "scan", "symbols", "total_lines"]
