"""Command line: build a graph from tables, ask questions of one, replay sessions. Tables are Parquet folders.

    python -m evograph build --events E --verdicts V --out G [--config C]
    python -m evograph ask --graph G --questions Q --notes N --note-events L --out A [--config C]
    python -m evograph replay --events E --out R [--candidates 10]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from evograph.plans import pipeline
from evograph.shared import ship
from evograph.sources import sinks
from evograph.streaming import incremental


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="evograph", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)
    needs = {"build": ["events", "verdicts", "out"], "ask": ["graph", "questions", "notes", "note-events", "out"], "replay": ["events", "out"]}
    for name, options in needs.items():
        c = commands.add_parser(name)
        for o in options:
            c.add_argument(f"--{o}", required=True)
        if name == "replay":
            c.add_argument("--candidates", type=int, default=10)
        else:
            c.add_argument("--config", help="JSON file of knobs, over the defaults")
    args = top.parse_args(argv)
    spark = SparkSession.builder.appName("evograph").getOrCreate()
    ship(spark)
    read = spark.read.parquet
    config = pipeline.Config.read(args.config) if getattr(args, "config", None) else pipeline.Config()
    if args.command == "build":
        sinks.write_tables(pipeline.build(read(args.events), read(args.verdicts), config), args.out)
    elif args.command == "ask":
        built = {n: read(f"{args.graph}/{n}") for n in ("events", "edges", "sessions", *(["stars"] if config.hierarchy else []))}
        sinks.write_tables({"answers": pipeline.ask(read(args.questions), read(args.notes), read(args.note_events), built, config)}, args.out)
    else:
        sinks.write_tables({"edges": incremental.replay(read(args.events), args.candidates)}, args.out)


if __name__ == "__main__":
    main()
