"""Source trees, source texts and ordered line files as data sources of Spark: listed, read, parsed and written by executors."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import code
from .tree import SYMBOLS, rows

_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Rows of a batch that goes to Spark.
BATCH = 256


# --- a tree of sources ------------------------------------------------------------------------------------


@dataclass
class Folder(InputPartition):
    """A folder that one task walks, with the ignore rules from above; of the root itself, its own files alone."""

    path: str
    rules: list = field(default_factory=list)
    deep: bool = True


class SourceTree(DataSource):
    """``spark.read.format("source_tree").option("root", folder)``: (file_path, source) of every source that no ignore file excludes.

    Filters on file_path (a prefix, an extension, a path or some paths) are taken over: folders and files beyond them are not
    even listed. The root lies where driver and executors see it.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "file_path string, source string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _TreeReader(self.options["root"])


class _TreeReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = str(Path(root).resolve())
        self.prefixes: list[str] = []
        self.suffixes: list[str] = []
        self.paths: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != ("file_path",):
                yield f
            elif isinstance(f, IsNotNull):
                pass  # no path is null
            elif isinstance(f, StringStartsWith):
                self.prefixes.append(f.value)
            elif isinstance(f, StringEndsWith):
                self.suffixes.append(f.value)
            elif isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = wanted if self.paths is None else self.paths & wanted
            else:
                yield f

    def _wanted(self, path: str) -> bool:
        return all(path.startswith(p) for p in self.prefixes) and all(path.endswith(s) for s in self.suffixes) and (self.paths is None or path in self.paths)

    def _leads_to(self, folder: str) -> bool:
        """Whether something below a folder can be wanted."""
        inside = lambda p: p.startswith(f"{folder}/") or f"{folder}/".startswith(p)
        return all(map(inside, self.prefixes)) and (self.paths is None or any(p.startswith(f"{folder}/") for p in self.paths))

    def partitions(self) -> list[Folder]:
        """The root's own files, and each folder in it: the driver looks at one level alone."""
        tree = code.Tree(self.root)
        return [Folder("", deep=False)] + [Folder(d, tree.start) for d in tree.list("", tree.start)[0] if self._leads_to(d)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        tree, known = code.Tree(self.root), code.builtin()
        paths, sources = [], []
        for path in tree.walk(partition.path, partition.rules or tree.start, partition.deep, self._leads_to):
            if known.language(path) and self._wanted(path):
                paths.append(path)
                sources.append(Path(self.root, path).read_text(encoding="utf-8"))
                if len(paths) == BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(sources)], names=["file_path", "source"])
                    paths, sources = [], []
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(sources)], names=["file_path", "source"])


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """The sources below a folder; filters on file_path are pushed into the scan."""
    spark.conf.set(_PUSHDOWN, "true")
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").option("root", root).load()


# --- symbols as a table function --------------------------------------------------------------------------


_TYPES = {"string": StringType(), "int": IntegerType(), "long": LongType()}


@udtf
class CodeSymbols:
    """``code_symbols(file_path, source)``: the symbols of a text; ``code_symbols(file_path, source, 'id', ...)`` some columns of them."""

    @staticmethod
    def analyze(file_path: AnalyzeArgument, source: AnalyzeArgument, *columns: AnalyzeArgument) -> AnalyzeResult:
        schema = StructType([StructField(n, _TYPES[t]) for n, t in (c.split() for c in SYMBOLS.split(", "))])
        names = [c.value for c in columns] or schema.fieldNames()
        if unknown := set(names) - set(schema.fieldNames()):
            raise ValueError(f"symbols have no {sorted(map(str, unknown))}")
        return AnalyzeResult(StructType([schema[n] for n in names]))

    def eval(self, file_path: str, source: str, *columns: str) -> Iterator[tuple]:
        language = code.builtin().language(file_path) if file_path and source is not None else None
        names = [c.split()[0] for c in SYMBOLS.split(", ")]
        at = [names.index(c) for c in columns] or range(len(names))
        try:
            found = list(rows(file_path, source, language.extract(source))) if language else []
        except (ValueError, IndexError, RecursionError):
            found = []
        for row in found:
            yield tuple(row[i] for i in at)


def register_functions(spark: SparkSession) -> None:
    """``SELECT ... FROM t, LATERAL code_symbols(t.file_path, t.source)``"""
    spark.udtf.register("code_symbols", CodeSymbols)


# --- ordered files of lines -------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    """Where a task has listed the files that it has written aside, and what they are to be called: a task has any number of them."""

    listed: str


class OrderedLines(DataSource):
    """``df.write.format("ordered_lines").option("folder", f).option("suffix", ".log")``: rows (name, line) as one file for each name.

    Tasks write aside and list their files there; files get their names when all tasks are done, and none does if one fails. The folder lies where driver
    and executors see it. ``write_lines`` deals and sorts the rows.
    """

    @classmethod
    def name(cls) -> str:
        return "ordered_lines"

    def schema(self) -> str:
        return "name string, line string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _LineWriter(self.options["folder"], self.options.get("suffix", ".log"))


class _LineWriter(DataSourceWriter):
    def __init__(self, folder: str, suffix: str):
        self.folder, self.suffix = folder, suffix
        self.aside = os.path.join(folder, f".aside-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> Written:
        os.makedirs(self.aside, exist_ok=True)
        listed = os.path.join(self.aside, f"{uuid.uuid4().hex}.names")
        out = None
        with open(listed, "w", encoding="utf-8") as names:
            try:
                for row in iterator:
                    if out is None or row.name != name:  # noqa: F821
                        if out:
                            out.close()
                        name, aside = row.name, uuid.uuid4().hex
                        names.write(json.dumps([aside, f"{name}{self.suffix}"]) + "\n")
                        out = open(os.path.join(self.aside, aside), "w", encoding="utf-8")  # noqa: SIM115
                    out.write(f"{row.line}\n")
            finally:
                if out:
                    out.close()
        return Written(listed)

    def commit(self, messages: list[Written | None]) -> None:
        for m in filter(None, messages):
            with open(m.listed, encoding="utf-8") as names:
                for aside, name in map(json.loads, names):
                    os.replace(os.path.join(self.aside, aside), os.path.join(self.folder, name))
        self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        if os.path.isdir(self.aside):
            with os.scandir(self.aside) as left:
                for f in left:
                    os.remove(f.path)
            os.rmdir(self.aside)


def write_lines(lines: DataFrame, name: str, line: str, order: list[str], folder: str, suffix: str = ".log") -> None:
    """One file below ``folder`` for each value of ``name``, its lines in ``order``; all files or none."""
    lines.sparkSession.dataSource.register(OrderedLines)
    dealt = lines.repartition(name).sortWithinPartitions(name, *order).selectExpr(f"`{name}` as name", f"`{line}` as line")
    dealt.write.format("ordered_lines").option("folder", folder).option("suffix", suffix).mode("append").save()
