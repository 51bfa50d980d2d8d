"""Runs registered queries from the command line: python -m gridspark.cli QUERY [--tables DIR] [--out DIR] [--format parquet], and
runs over files: python -m gridspark.cli RUN --config FILE [--run-id NAME].

Exit codes: 0 done, 2 wrong arguments, settings or an unknown query, 3 input that can't be read, 4 a run that ended as failed, 1
anything else.
"""

from __future__ import annotations

import argparse
import sys

from . import assistant_run, monitoring_run, pipelines, runs
from .pipelines import ConfigError
from .queries import QUERIES
from .sources import contracts, readers

RUNS = pipelines.RUNS | runs.RUNS | {"monitoring": monitoring_run.run_monitoring, "genai": assistant_run.run_assistant}


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gridspark")
    parser.add_argument("query", help="a query's name, or `list`")
    parser.add_argument("--tables", help="folder of the star-schema tables")
    parser.add_argument("--out", help="folder to write to; without it the first rows are shown")
    parser.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    parser.add_argument("--master")
    parser.add_argument("--config", help="settings of a run, a YAML file")
    parser.add_argument("--run-id")
    try:
        given = parser.parse_args(args)
    except SystemExit as e:
        return int(e.code or 0)
    if given.query == "list":
        print(*sorted(QUERIES), sep="\n")
        return 0
    if given.query in RUNS:
        return _run(given)
    if given.query not in QUERIES or not given.tables:
        print(f"{given.query}: no such query" if given.query not in QUERIES else "--tables is needed", file=sys.stderr)
        return 2
    from pyspark.errors import AnalysisException

    from .session import build

    spark = build("gridspark", given.master)
    try:
        out = QUERIES[given.query](spark, given.tables)
    except AnalysisException as e:
        print(e, file=sys.stderr)
        return 3
    try:
        if given.out:
            out.write.mode("overwrite").format(given.format).save(given.out)
        else:
            out.show(20, truncate=False)
    except Exception as e:  # noqa: BLE001  the exit code says so
        print(e, file=sys.stderr)
        return 1
    return 0


def _run(given: argparse.Namespace) -> int:
    from pyspark.errors import AnalysisException

    from .session import build

    if not given.config:
        print("--config is needed", file=sys.stderr)
        return 2
    try:
        spark = build("gridspark", given.master)
        done = RUNS[given.query](spark, given.config, given.run_id)
    except (ConfigError, contracts.ContractError) as e:
        print(e, file=sys.stderr)
        return 2
    except (AnalysisException, OSError, readers.HeaderError) as e:
        print(e, file=sys.stderr)
        return 3
    print(f"{done.component} {done.run_id}: {done.status}")
    return 4 if done.failed() else 0


if __name__ == "__main__":
    sys.exit(main())
