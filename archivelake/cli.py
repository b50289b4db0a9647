"""Command line: index, search, watch and measure folders, show counts, reconcile."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import schema
from .archive import Archive, report_text
from .sources import scan


def shown(r) -> str:
    page = f" (page {r['page'] + 1})" if r["page"] is not None else ""
    return f"{r['rank']:>3}  {r['score']:.6f}  {r['path']}{page}\n     {r['caption']}\n     {', '.join(r['objects'])}"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="archivelake")
    top.add_argument("--store", default="archivelake-store")
    verbs = top.add_subparsers(dest="verb", required=True)
    for verb in ("index", "bench", "watch"):
        p = verbs.add_parser(verb)
        p.add_argument("path")
        p.add_argument("--force", action="store_true")
        p.add_argument("--at-once", type=int, default=None, help="tasks that use the captioning model at a time")
    verbs.choices["bench"].add_argument("--warm-up", action="store_true")
    verbs.choices["watch"].add_argument("--seconds", type=float, default=5.0)
    verbs.choices["watch"].add_argument("--rounds", type=int, default=None, help="stop after so many looks")
    p = verbs.add_parser("search")
    p.add_argument("query")
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--kind", choices=["image", "pdf"])
    p.add_argument("--has-text", action="store_true")
    p.add_argument("--object")
    for verb in ("stats", "reconcile", "recover", "version"):
        verbs.add_parser(verb)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.verb == "version":
        print(schema.VERSION)
        return 0
    archive = Archive(spark or SparkSession.builder.getOrCreate(), args.store)
    if args.verb in ("index", "bench"):
        if scan.files(archive.spark, args.path).isEmpty():
            print(f"nothing to index at {args.path}")
        elif args.verb == "bench":
            if args.warm_up:  # loads models and compiles code
                archive.duplicates(args.path)["exact"].count()
            print(report_text(archive.index(args.path, args.force, args.at_once), args.warm_up))
        else:
            print(json.dumps(archive.index(args.path, args.force, args.at_once)["stats"], sort_keys=True))
    elif args.verb == "watch":
        n = 0
        while args.rounds is None or n < args.rounds:
            stats = archive.index(args.path, args.force, args.at_once)["stats"]
            if stats.get("indexed") or stats.get("updated"):
                print(json.dumps(stats, sort_keys=True), flush=True)
            n += 1
            if args.rounds is None or n < args.rounds:
                time.sleep(args.seconds)
    elif args.verb == "search":
        found = archive.search(args.query, args.limit, kind=args.kind, has_text=args.has_text, label=args.object).orderBy(F.col("rank")).collect()
        print("\n".join(map(shown, found)) if found else "no results")
    elif args.verb == "stats":
        for name, n in archive.stats().items():
            print(name, n)
    else:
        print(json.dumps(archive.reconcile() if args.verb == "reconcile" else archive.recover()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
