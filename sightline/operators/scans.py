"""Ordered scans of groups of any size: running counts and last values without a group ever being in one task.

A group's rows are cut into chunks that follow its order. Within a chunk a window does the scan; a chunk's total
is one row, those few rows are scanned in turn, and what came before a chunk is added to its rows. So a task holds
a chunk, and the second scan a row for each chunk of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import kept


def chunk_scan(rows: DataFrame, partition: list[str], chunk: dict[str, Column], order: list[str], counts: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with how many rows before each, in its group, meet each condition of ``counts``, and the last value that is
    not null of each of ``lasts`` before it.

    ``chunk`` are columns that never fall along ``order`` within a group (a log's place, its split, a run of lines): a row's
    chunk follows from its own values, so a task that is run again deals alike. Rows are scanned and written once.
    """
    counts, lasts = counts or {}, lasts or {}
    keys = [*partition, *(f"_chunk_{c}" for c in chunk)]
    before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    cut = rows.withColumns({f"_chunk_{c}": v for c, v in chunk.items()})
    local = cut.withColumns({f"_is_{n}": F.coalesce(c, F.lit(False)) for n, c in counts.items()} | {f"_at_{n}": v for n, v in lasts.items()})
    local = local.withColumns({n: F.coalesce(F.sum(F.col(f"_is_{n}").cast("long")).over(before), F.lit(0)) for n in counts} | {n: F.last(f"_at_{n}", ignorenulls=True).over(before) for n in lasts})
    local = kept(local, "scanned")
    place = F.struct(*order)
    sums = [F.sum(F.col(f"_is_{n}").cast("long")).alias(f"_sum_{n}") for n in counts]
    ends = [F.max_by(f"_at_{n}", F.when(F.col(f"_at_{n}").isNotNull(), place)).alias(f"_end_{n}") for n in lasts]
    totals = local.groupBy(*keys).agg(*sums, *ends)
    earlier = W.partitionBy(*partition).orderBy(*keys[len(partition) :]).rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(*keys, *(F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_sum_{n}") for n in counts), *(F.last(f"_end_{n}", ignorenulls=True).over(earlier).alias(f"_end_{n}") for n in lasts))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    joined = local.alias("l").join(carried.alias("c"), same)
    return joined.select(*(F.col(f"l.{c}") for c in rows.columns if c not in {*counts, *lasts}), *((F.col(f"l.{n}") + F.col(f"_sum_{n}")).alias(n) for n in counts), *(F.coalesce(F.col(f"l.{n}"), F.col(f"_end_{n}")).alias(n) for n in lasts))
