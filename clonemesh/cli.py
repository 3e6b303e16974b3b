"""Command line: profile, run, auto, benchmark."""

from __future__ import annotations

import argparse
import json


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("clonemesh").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="clonemesh", description="Consensus clustering of receptor repertoires.")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("profile", "run", "auto", "benchmark"):
        c = sub.add_parser(name)
        c.add_argument("input")
        c.add_argument("--config")
        c.add_argument("--preset")
        if name != "profile":
            c.add_argument("--out", default="runs")
            c.add_argument("--name")
            c.add_argument("--objective", default="fast_screening")
            c.add_argument("--methods", nargs="*")
        if name == "run":
            c.add_argument("--mode", default="balanced", choices=["conservative", "balanced", "coverage"])
        if name == "benchmark":
            c.add_argument("--labels", required=True)
            c.add_argument("--datasets", nargs="*", default=[], help="tables for leave-one-dataset-out")
    a = p.parse_args(argv)
    spark = _spark()
    from .plans.benchmark import full_benchmark
    from .plans.engine import Engine

    e = Engine(spark, getattr(a, "objective", "fast_screening"), getattr(a, "mode", "auto"), a.config, a.preset)
    if a.command == "profile":
        from .operators.profile import profile
        from .plans.config import noise_config

        print(json.dumps(profile(e.load(a.input), noise_config(e.config)).__dict__, indent=2))
    elif a.command == "benchmark":
        from .sources.readers import read_labels

        found = full_benchmark(e, e.load(a.input), read_labels(spark, a.labels), a.out, {p: e.load(p) for p in a.datasets}, methods=a.methods)
        for name, d in found.items():
            print(name)
            d.show(truncate=False)
    else:
        _, d = e.run(a.input, a.out, a.name, methods=a.methods)
        print(d)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
