"""python -m corvine curate | evaluate | paths."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import workflow


def main(given: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="corvine")
    kinds = parser.add_subparsers(dest="kind", required=True)
    curate = kinds.add_parser("curate", help="records of an index list as frames in six splits")
    for name in ("indices", "dataset-path", "output-dir"):
        curate.add_argument(f"--{name}", required=True)
    curate.add_argument("--seed", type=int, default=42)
    curate.add_argument("--train-fraction", type=float, default=0.8)
    curate.add_argument("--limit", type=int)
    evaluate = kinds.add_parser("evaluate", help="errors of training runs as one table")
    evaluate.add_argument("runs", nargs="+", metavar="LABEL=path")
    evaluate.add_argument("--out", required=True)
    paths = kinds.add_parser("paths", help="a configuration with the paths of its data")
    paths.add_argument("config")
    for name in ("train", "val", "out"):
        paths.add_argument(f"--{name}", required=True)
    a = parser.parse_args(given)
    spark = SparkSession.builder.getOrCreate()
    if a.kind == "curate":
        workflow.curate(spark, a.indices, a.dataset_path, a.output_dir, a.seed, a.train_fraction, a.limit).show()
    elif a.kind == "evaluate":
        workflow.evaluate(spark, a.runs, a.out).show()
    else:
        workflow.set_paths(spark, a.config, a.out, a.train, a.val)


if __name__ == "__main__":
    main()
