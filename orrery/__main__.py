"""python -m orrery: a run by configuration file and command line."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession

from orrery import __version__
from orrery.plans import config
from orrery.plans.run import execute
from orrery.sources.ascii import read_table


def main(args: list[str]) -> int:
    given, other = config.parse_command(args)
    for name, text in (("help", config.usage), ("version", lambda: f"{__version__}\n"), ("template", config.template)):
        if name in other:
            sys.stdout.write(text())
            return 0
    path = other.get("conf", "orrery.conf")
    held = {}
    if os.path.exists(path):
        with open(path) as f:
            held = config.parse_file(f.read())
    else:
        print(f"no configuration file {path}", file=sys.stderr)
    spark = SparkSession.builder.appName("orrery").getOrCreate()
    run = config.check(held | given, lambda p: read_table(spark, p))
    for note in run.notes:
        print(note, file=sys.stderr)
    execute(spark, run)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
