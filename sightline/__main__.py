"""``python -m sightline --project P --coverage``: reports, symbol trees and live coverage from the command line."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.sql import SparkSession


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="sightline", description="How much of a code base has a coding agent looked at?")
    p.add_argument("-p", "--project", required=True, help="root of the project")
    p.add_argument("-s", "--session", help="session id (default: the newest)")
    p.add_argument("--log-dir", help="folder of session logs (default: derived from the project)")
    what = p.add_mutually_exclusive_group(required=True)
    what.add_argument("--coverage", action="store_true", help="print the coverage report")
    what.add_argument("--dump", action="store_true", help="print the symbol tree")
    what.add_argument("--follow", metavar="STATE_DIR", help="follow the session; the live ledger is kept below this folder")
    p.add_argument("--serena", action="store_true", help="symbols from a language server's cache")
    p.add_argument("-a", "--agent", help="coverage of one agent, by a prefix of its id")
    p.add_argument("--log-output", help="write the session's events as text below this folder")
    p.add_argument("--tools-config", help="TOML mapping of tools")
    p.add_argument("--format", choices=("table", "json"), default="table")
    which = p.add_mutually_exclusive_group()
    which.add_argument("--filter", help="only what lies below this path of the project")
    which.add_argument("--filter-regex", help="only files whose path matches")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    from . import operators as O
    from .plans import report, toolmap
    from .plans.filters import PathFilter
    from .sources import code, lspcache, sessions
    from .streaming.follow import follow

    a = arguments(argv)
    logging.basicConfig(stream=sys.stderr)
    only = PathFilter.choose(a.filter, a.filter_regex)
    if only:
        only.validate(a.project)
    spark = spark or SparkSession.builder.appName("sightline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    keep = only.matches if only else None
    root = os.path.realpath(a.project)
    if a.dump:
        files, symbols = lspcache.scan(spark, root, keep) if a.serena else code.scan(spark, root, keep)
        sys.stdout.write(report.dump(root, files, symbols, only))
    elif a.coverage:
        formatter = report.JsonFormatter() if a.format == "json" else report.TextFormatter()
        sys.stdout.write(report.run(spark, a.project, a.log_dir, a.session, a.agent, only, formatter, a.tools_config, a.serena, event_log_dir=a.log_output))
    else:
        logs = a.log_dir or sessions.log_dir(a.project)
        if not logs:
            raise SystemExit(f"no session logs for {a.project}")

        def show(panel: dict, session: str, state) -> None:  # noqa: ANN001
            at = panel["depths"].get
            sys.stdout.write(f"{session}: {panel['seen']} seen, {at(4, 0)} full, {at(5, 0)} stale; {panel['calls']} calls since reset {panel['epoch']}\n")
            sys.stdout.flush()

        follow(spark, a.project, logs, a.follow, a.session, toolmap.resolve(a.tools_config)[0], keep, show=show)


if __name__ == "__main__":
    main()
