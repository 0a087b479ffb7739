"""Joins by ranges and by name suffixes as joins by equality.

*Ranges*: a range of whole numbers is the union of O(log n) dyadic nodes (aligned runs of 2^level numbers), and a point lies
in one node of each level, its ancestors. A point is in a range exactly when one of its ancestors is one of the range's
nodes, and then exactly one is. So ranges of any length cost a few rows, where bins of a fixed width cost one each.
Rows multiply in these joins, which the planner's estimate does not know: sides are merged, never sent to the driver.

*Suffixes*: a target names a symbol by any suffix of its path of names. Every suffix of every symbol is a key, and
targets meet them by equality instead of being tested against each symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strip_keywords

#: The highest level of nodes; a range beyond 2^LEVELS is a run of nodes of that level.
LEVELS = 24


def _node(level: Column, index: Column) -> Column:
    return F.struct(level.cast("int").alias("level"), index.cast("long").alias("index"))


def range_nodes(start: Column, end: Column, levels: int = LEVELS) -> Column:
    """The dyadic nodes whose union is [start, end); none for an empty range."""
    x, y = start.cast("long"), end.cast("long")
    low = lambda l: F.call_function("shiftright", x + F.call_function("shiftleft", F.lit(1).cast("long"), l) - 1, l)  # noqa: E731, E741
    high = lambda l: F.call_function("shiftright", y, l)  # noqa: E731, E741

    def at(level: Column) -> Column:
        a, b = low(level), high(level)
        left = F.when((a < b) & (a % 2 != 0), _node(level, a))
        right = F.when((a + F.abs(a % 2) < b) & (b % 2 != 0), _node(level, b - 1))
        return F.array(left, right)

    below = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), at)), lambda n: n.isNotNull())
    a, b = low(F.lit(levels)), high(F.lit(levels))
    top = F.when(a < b, F.transform(F.sequence(a, F.greatest(a, b - 1)), lambda i: _node(F.lit(levels), i)))
    return F.concat(below, F.coalesce(top, F.array().cast("array<struct<level:int,index:bigint>>")))


def ancestors(point: Column, levels: int = LEVELS) -> Column:
    """The node of each level that holds a point."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda l: _node(l, F.call_function("shiftright", point.cast("long"), l)))


def stab_join(points: DataFrame, ranges: DataFrame, keys: list[str], point: str, start: str, end: str, levels: int = LEVELS) -> DataFrame:
    """Pairs of a point and a range [start, end) that holds it, with equal ``keys``; each pair once. Other columns must differ."""
    p = points.select("*", F.inline(ancestors(F.col(point), levels)).alias("_level", "_index"))
    r = ranges.select("*", F.inline(range_nodes(F.col(start), F.col(end), levels)).alias("_level", "_index"))
    return p.join(r.hint("merge"), [*keys, "_level", "_index"]).drop("_level", "_index")


def levels_of(ranges: DataFrame, start: str, end: str) -> int:
    """The highest level that the nodes of these ranges can have; one aggregate."""
    longest = ranges.agg(F.max(F.col(end).cast("long") - F.col(start).cast("long"))).first()[0] or 0
    return min(LEVELS, max(1, int(longest).bit_length() - 1))


def range_join(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str, right_start: str, right_end: str, levels: int | None = LEVELS) -> DataFrame:
    """Pairs with equal ``keys`` whose half-open ranges share a line; strict on both sides, so an empty range meets only what spans it.

    A point has a row for each level; without ``levels`` they are those that the ranges of each side can have, which is looked up first.

    Of two such ranges one starts within the other: the right one's start lies in [start, end), or the left one's
    after the right one's start and before its end. The cases exclude each other, so a pair comes once.
    """
    s, e, a, b = (F.col(c) for c in (start, end, right_start, right_end))
    of = lambda side, x, y: levels_of(side, x, y) if levels is None else levels
    within = stab_join(right, left, keys, right_start, start, end, of(left, start, end))
    after = stab_join(left, right.withColumn("_from", a + 1), keys, start, "_from", right_end, of(right, right_start, right_end)).drop("_from")
    both = within.unionByName(after)
    return both.where((s < b) & (a < e))


def suffixes(path: Column) -> Column:
    """``a/b/c`` as a/b/c, b/c, c."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def name_keys(name_path: Column, name: Column) -> Column:
    """The (bare, key) by which targets find a symbol: suffixes of its path and its name, as they are and without keywords."""
    keyed = lambda bare, keys: F.transform(keys, lambda k: F.struct(F.lit(bare).alias("bare"), k.alias("key")))
    own = lambda p, n: F.array_union(suffixes(p), F.array(n))
    return F.concat(keyed(False, own(name_path, name)), keyed(True, own(strip_keywords(name_path), strip_keywords(name))))


def suffix_join(targets: DataFrame, symbols: DataFrame, keys: list[str], target: str, name_path: Column, name: Column) -> DataFrame:
    """Pairs of a target and a symbol that it names (``operators.name_matches``), with equal ``keys``; each once for a row of ``symbols``.

    ``symbols`` are known by (keys, ord). Other columns must differ.
    """
    wanted = F.array(F.struct(F.lit(False).alias("bare"), F.col(target).alias("key")), F.struct(F.lit(True).alias("bare"), strip_keywords(F.col(target)).alias("key")))
    t = targets.select("*", F.inline(wanted).alias("_bare", "_key"))
    s = symbols.select("*", F.inline(name_keys(name_path, name)).alias("_bare", "_key"))
    found = t.join(s.hint("merge"), [*keys, "_bare", "_key"]).drop("_bare", "_key")
    return found.dropDuplicates([*targets.columns, "ord"])
