"""Jobs for spark-submit: index a directory, turn conversations into prompts, answer tool calls.

    python -m textquarry index ROOT TABLE
    python -m textquarry prompts TURNS TABLE OUT
    python -m textquarry tools CALLS ROOT TABLE OUT

TURNS (conv_id, turn, role, text) and CALLS (call_id, seq, name, input) are
Parquet; OUT is written as Parquet. ``tools`` also writes the file table after
the calls to OUT_files and upserts the texts stored by them into TABLE.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from textquarry.operators.tools import ToolBox
from textquarry.plans.chat import prompts
from textquarry.plans.index import index_directory
from textquarry.sources.vector_table import VectorTable
from textquarry.sources.workspace import read_workspace, workspace_files


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="textquarry")
    jobs = parser.add_subparsers(dest="job", required=True)
    for job, names in {"index": ["root", "table"], "prompts": ["turns", "table", "out"],
                       "tools": ["calls", "root", "table", "out"]}.items():
        sub = jobs.add_parser(job)
        for name in names:
            sub.add_argument(name)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"textquarry {args.job}").getOrCreate()
    table = VectorTable.ensure(spark, args.table)
    if args.job == "index":
        index_directory(spark, args.root, table)
    elif args.job == "prompts":
        prompts(spark.read.parquet(args.turns), table.read()).write.parquet(args.out)
    else:
        files = workspace_files(read_workspace(spark, args.root))
        box, calls = ToolBox(files, table.read()), spark.read.parquet(args.calls)
        after, stored = box.effects(calls)
        box.execute(calls).write.parquet(args.out)
        after.write.parquet(f"{args.out.rstrip('/')}_files")
        table.upsert(stored)


if __name__ == "__main__":
    main()
