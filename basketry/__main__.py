"""python -m basketry STEP... | all | list: runs steps of the retail chain and writes what they give as Parquet."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from . import roles
from .operators import features, ranking
from .plans.steps import Graph, retail_graph
from .session import get_session
from .sources import files


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="python -m basketry", description=__doc__)
    parser.add_argument("steps", nargs="*", default=[], help="steps to run, all, or list")
    parser.add_argument("--data", default="/root/testdata/sf0.01", help="the folder of the star schema")
    parser.add_argument("--out", help="where results go; without it they are only computed")
    parser.add_argument("--only", action="store_true", help="the steps without what they need, which is read from --out")
    parser.add_argument("--from", dest="start", help="begin at this step of the chain; what comes before is read from --out")
    parser.add_argument("--scale", type=float, default=1.0, help="the data's size, for the estimate of time")
    parser.add_argument("--dry-run", action="store_true", help="only tell what would run")
    parser.add_argument("--master", help="the Spark master, if not the cluster's own")
    return parser.parse_args(argv)


def write(result, folder: str, name: str) -> str:
    """Stores a DataFrame, a table of them, or a model; tells what was done."""
    if isinstance(result, DataFrame):
        result.write.mode("overwrite").parquet(f"{folder}/{name}")
        return "written"
    if isinstance(result, dict) and all(isinstance(x, DataFrame) for x in result.values()):
        files.write_tables(result, f"{folder}/{name}")
        return f"{len(result)} tables written"
    if isinstance(result, PipelineModel):
        ranking.save_ranker(result, f"{folder}/{name}", features.FEATURES)
        return "model saved"
    return "kept in memory"


def read(spark, graph: Graph, folder: str | None, names: list[str]) -> dict:
    """Results of earlier runs of steps that don't run now, where they are there."""
    have = {}
    for name in graph.steps:
        path = f"{folder}/{name}"
        if not folder or name in names or not files.exists(spark, path):
            continue
        if files.exists(spark, f"{path}/_SUCCESS"):
            have[name] = spark.read.parquet(path)
        elif files.exists(spark, f"{path}/model"):
            have[name], _ = ranking.load_ranker(spark, path, features.FEATURES)
    return have


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    graph = retail_graph()
    if args.steps == ["list"]:
        print("\n".join(f"{s.name:16} {s.minutes:5.1f} min  needs {', '.join(s.needs) or 'nothing'}" for s in graph.steps.values()))
        return 0
    targets = None if args.steps in ([], ["all"]) else args.steps
    try:
        names = graph.resolve(targets, args.only, args.start)
    except KeyError as e:
        print(e.args[0], file=sys.stderr)
        return 2
    print(f"{', '.join(names)}: about {graph.estimate(names, args.scale):.0f} min")
    if args.dry_run:
        return 0
    spark = get_session("basketry", args.master)
    graph = retail_graph(roles.raw(spark, args.data), roles.clean(spark, args.data))
    have = read(spark, graph, args.out, names)
    # bound tables and open windows aren't results: they are made anew where a step needs them
    for name in ("raw", "tables", "window", "clean"):
        if name not in names and any(name in graph.steps[n].needs for n in names):
            have[name] = graph.steps[name].run(*[have.setdefault(n, graph.steps[n].run()) for n in graph.steps[name].needs])
    for name in names:
        began, step = time.perf_counter(), graph.steps[name]
        if missing := [n for n in step.needs if n not in have]:
            print(f"{name} needs {', '.join(missing)}, which isn't in --out", file=sys.stderr)
            return 2
        have[name] = step.run(*[have[n] for n in step.needs])
        if args.out:
            said = "" if name in ("raw", "tables", "window") else write(have[name], args.out, name)
        elif isinstance(have[name], DataFrame):
            have[name].write.format("noop").mode("overwrite").save()
            said = "computed"
        else:
            said = "kept in memory"
        print(f"{name}: {said or 'bound'}, {time.perf_counter() - began:.1f} s", flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
