"""Command line: ``python -m gridloom.plans.cli partition|analyze|convert|heatmap ...``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import fields

from pyspark.sql import SparkSession

from gridloom.operators import metrics
from gridloom.plans.run import heatmap, run
from gridloom.settings import Settings
from gridloom.sources import files, sinks


def _settings(args: argparse.Namespace) -> Settings:
    known = {f.name for f in fields(Settings)}
    return Settings(**{k: v for k, v in vars(args).items() if k in known and v is not None})


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gridloom")
    sub = p.add_subparsers(dest="command", required=True)
    numbers = lambda s: [int(x) for x in s.split(",")]
    for name in ("partition", "analyze", "convert", "heatmap"):
        c = sub.add_parser(name)
        c.add_argument("--graph-file", required=True)
        c.add_argument("--file-format", default="auto")
        c.add_argument("--coord-file")
        c.add_argument("--coord-format", default="metis")
        c.add_argument("--dimensions", type=int, default=2)
        c.add_argument("--out")
        if name == "partition":
            c.add_argument("--num-blocks", type=int, required=True)
            c.add_argument("--tool")
            c.add_argument("--epsilon", type=float)
            c.add_argument("--sfc-resolution", type=int)
            c.add_argument("--hier-levels", type=numbers)
            c.add_argument("--cuts-per-dim", type=numbers)
            c.add_argument("--block-sizes")
            c.add_argument("--previous-partition")
            c.add_argument("--refine", dest="no_refinement", action="store_false", default=None)
            c.add_argument("--bisect", action="store_true", default=None)
            c.add_argument("--renumber", action="store_true", default=None)
            c.add_argument("--metrics-level")
            c.add_argument("--repeat", type=int)
        if name == "analyze":
            c.add_argument("--partition", required=True)
            c.add_argument("--num-blocks", type=int)
            c.add_argument("--metrics-level", default="easy")
        if name == "convert":
            c.add_argument("--to", choices=("metis", "binary", "edgelist_binary", "parquet"), required=True)
        if name == "heatmap":
            c.add_argument("--cells", type=int, default=32)
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> str:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("gridloom").getOrCreate()
    if args.command == "convert":
        v, e = files.read_graph(spark, args.graph_file, args.file_format, args.dimensions)
        {"metis": lambda: sinks.write_metis(v, e, args.out, single=True), "binary": lambda: sinks.write_graph_binary(v, e, args.out), "edgelist_binary": lambda: sinks.write_edge_list_binary(v, e, args.out), "parquet": lambda: sinks.write_edges(e, args.out)}[args.to]()
        return args.out
    if args.command == "analyze":
        _, e = files.read_graph(spark, args.graph_file, args.file_format, args.dimensions)
        part = files.read_partition(spark, args.partition)
        k = args.num_blocks or part.agg({"blk": "max"}).first()[0] + 1
        text = metrics.as_text(metrics.metrics(e, part, k, args.metrics_level))
    else:
        v, e = files.read_input(spark, args.graph_file, args.file_format, args.coord_file, args.coord_format, args.dimensions)
        if args.command == "heatmap":
            cells = heatmap(v, args.cells)
            if args.out:
                cells.coalesce(1).write.mode("overwrite").csv(args.out, header=True)
            return f"{cells.count()} cells"
        s = _settings(args)
        previous = files.read_partition(spark, args.previous_partition) if args.previous_partition else None
        targets = files.read_block_sizes(spark, args.block_sizes) if args.block_sizes else None
        part, m = run(v, e, s, targets=targets, previous=previous)
        if args.out:
            sinks.write_partition(part, args.out, single=True)
        text = metrics.as_text(m)
    print(text)
    return text


if __name__ == "__main__":
    main()
