"""Follow a project's newest session: its log as a stream, its sources between micro-batches, the next session when there is one."""

from __future__ import annotations

import itertools
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans import toolmap
from ..sources import code
from . import live
from .tail import FileWatch, SessionWatch, read_stream


def _project(spark: SparkSession, root: str, keep: Callable[[str], bool] | None) -> Callable[[list[str]], tuple[DataFrame, DataFrame]]:
    def scan(paths: list[str]) -> tuple[DataFrame, DataFrame]:
        found = code.read_sources(spark, root, [os.path.relpath(p, root) for p in paths])
        return code.files(found), code.symbols(found)

    return scan


def follow(
    spark: SparkSession, project: str, log_dir: str, state_dir: str, session: str | None = None, stanzas: list | None = None, keep: Callable[[str], bool] | None = None,
    interval: str = "250 milliseconds", show: Callable[[dict, str, live.LiveState], None] | None = None, stop: Callable[[], bool] = lambda: False,
) -> live.LiveState | None:
    """Fold logs and source changes into a live ledger below ``state_dir``, a shared folder, until ``stop`` says so.

    A session is read from its first line, so nothing is to be filled in before. ``show`` gets a session's panel after every
    micro-batch that changed it, and the tables of its state. Sources are looked at after each batch, too, and what changed
    comes with the next one.
    """
    root = os.path.realpath(project)
    stanzas = stanzas or toolmap.resolve()[0]
    watch = SessionWatch(log_dir, session)
    scan, own = _project(spark, root, keep), lambda: [os.path.join(root, p) for p in code.project_files(root, keep)]
    state = None
    while watch.session and not stop():
        session = watch.session
        folder = f"{state_dir.rstrip('/')}/{session}-{uuid.uuid4().hex[:8]}"
        state, files = live.LiveState(spark, f"{folder}/query"), FileWatch([])
        if not live.poll_sources(files, own(), scan, [session], -1, f"{folder}/sources"):
            live.write_sources(*_none(spark), [session], -1, f"{folder}/sources")
        changes = itertools.count()
        events = live.events_of(read_stream(spark, log_dir, session), root, session, stanzas)
        panels = live.live(events, live.source_stream(spark, f"{folder}/sources"))

        def seen(batch: DataFrame, number: int, state: live.LiveState = state, session: str = session) -> None:
            for panel in batch.collect():  # one row, of the session that is followed
                if show:
                    shown.append((panel.asDict(), session, state))

        shown: list[tuple] = []
        query = live.start(panels, f"{folder}/query", seen, interval)
        try:
            while query.isActive and not stop() and not watch.switched():
                live.poll_sources(files, own(), scan, [session], next(changes), f"{folder}/sources")
                while shown:
                    show(*shown.pop(0))
                time.sleep(0.25)
        finally:
            query.stop()
        if query.exception():
            raise query.exception()
    return state


def _none(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    empty = code.read_sources(spark, "/", [])
    return code.symbols(empty), code.files(empty)
