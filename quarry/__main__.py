"""python -m quarry ingest | eval | compare | serve | export-tool-schema"""

from __future__ import annotations

import argparse
import json
import sys

import quarry


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("quarry").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _prepared(spark, path: str, args):
    from quarry.plans.pipeline import build_pipeline, load_config
    from quarry.sources import datasets

    conf = load_config(path)
    chunks, name, qrels = None, "", None
    if getattr(args, "dataset", None):
        name, qrels, folder = datasets.resolve(spark, args.dataset, args.path)
        folder = args.corpus or folder
        if folder:
            conf["documents"] = [folder]
        elif name == "synthetic" and not conf.get("documents"):
            chunks = datasets.synthetic_chunks(spark)
    return build_pipeline(spark, conf, chunks), name, qrels


def metric_at(value: str) -> tuple[str, int]:
    name, _, k = value.partition("@")
    return name, int(k or 10)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quarry")
    parser.add_argument("--version", action="version", version=quarry.__version__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("ingest", "eval", "compare", "serve"):
        p = sub.add_parser(name)
        p.add_argument("config", nargs=2 if name == "compare" else 1)
        if name in ("eval", "compare"):
            p.add_argument("--dataset", default="synthetic")
            p.add_argument("--path")
            p.add_argument("--corpus")
            p.add_argument("-n", type=int)
            p.add_argument("-k", type=int, default=10)
            p.add_argument("--metric", default="recall@10")
            p.add_argument("--strict", action="store_true")
    sub.add_parser("export-tool-schema").add_argument("--form", default="canonical", choices=["canonical", "mcp", "openai", "anthropic"])
    args = parser.parse_args(argv)
    if args.command == "export-tool-schema":
        from quarry.plans.export import rendered

        print(json.dumps(rendered(args.form), indent=2))
        return 0
    spark = _session()
    if args.command == "compare":
        from quarry.plans.pipeline import compare

        name, k = metric_at(args.metric)
        (a, _, qrels), (b, _, _) = (_prepared(spark, c, args) for c in args.config)
        for r in compare(a, b, qrels, name, k, args.n).collect():
            print(f"{r.name}@{k} n={r.n}: {r.mean_a:.3f} -> {r.mean_b:.3f}, delta {r.delta:+.3f} [{r.ci_low:.3f}, {r.ci_high:.3f}]{' significant' if r.significant else ''}")
        return 0
    pipeline, name, qrels = _prepared(spark, args.config[0], args)
    if pipeline is None:
        print("nothing is configured", file=sys.stderr)
        return 1
    if args.command == "ingest":
        print(f"{pipeline.corpus.chunks.count()} chunks")
        return 0
    if args.command == "serve":
        from quarry.plans.export import serve

        serve(spark, pipeline)
        return 0
    from quarry.plans.pipeline import evaluate

    report = evaluate(pipeline, qrels, name, args.k, args.n)
    print(report.text())
    return int(args.strict and not report.overall["overall_pass"])


if __name__ == "__main__":
    sys.exit(main())
