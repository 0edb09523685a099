"""python -m tideloom list | run QUERY --input FOLDER [--output FOLDER] [--show ROWS] | experiment CONFIG.json --input FOLDER --output FOLDER"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from tideloom.plans import matrix, registry


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tideloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    run = commands.add_parser("run", help="run one query")
    run.add_argument("query")
    run.add_argument("--input", required=True)
    run.add_argument("--output")
    run.add_argument("--show", type=int, default=20)
    experiment = commands.add_parser("experiment", help="run methods and seeds of a configuration, with metrics, status and lock")
    experiment.add_argument("config", help='JSON file, e.g. {"methods": ["popularity", "markov"], "seeds": [0], "top": 10}')
    experiment.add_argument("--input", required=True)
    experiment.add_argument("--output", required=True)
    given = parser.parse_args(argv)
    known = registry.queries()
    if given.command == "list":
        print(*sorted(known), sep="\n")
        return 0
    if given.command == "experiment":
        config = json.loads(Path(given.config).read_text())
        matrix.run(SparkSession.builder.appName("tideloom").getOrCreate(), config, given.input, given.output).show(100, truncate=False)
        return 0
    if given.query not in known:
        parser.error(f"no such query: {given.query}")
    found = known[given.query](SparkSession.builder.appName("tideloom").getOrCreate(), given.input)
    if given.output:
        found.write.mode("errorifexists").parquet(given.output)
    else:
        found.show(given.show, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
