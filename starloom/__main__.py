"""``python -m starloom <folder> <pairs> <output> [--job rich|stacked] [--cf proxy|oof]``, also for spark-submit."""

from __future__ import annotations

import argparse

from starloom.plans.jobs import InputFiles, predict_files
from starloom.session import build_session


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="starloom", description=__doc__)
    parser.add_argument("folder")
    parser.add_argument("pairs")
    parser.add_argument("output")
    parser.add_argument("--job", choices=["rich", "stacked"], default="rich")
    parser.add_argument("--cf", choices=["proxy", "oof"], default="proxy", help="source of the rich job's neighbourhood scores")
    options = parser.parse_args(arguments)
    extra = {"cf": options.cf} if options.job == "rich" else {}
    spark = build_session("starloom")
    predict_files(spark, InputFiles(options.folder), options.pairs, options.output, options.job, **extra)


if __name__ == "__main__":
    main()
