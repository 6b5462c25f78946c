"""Command line: ``python -m kinelake {catalog,scan,convert,stats,inspect,batches} ...``."""

from __future__ import annotations

import argparse
import json
import os

from kinelake import api
from kinelake.operators import stats
from kinelake.session import session
from kinelake.sources import lerobot, writers
from kinelake.spec import REGISTRY, dataset_path


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kinelake")
    p.add_argument("--master", default="local[*]")
    p.add_argument("--root", default=None, help="folder of the dumps")
    p.add_argument("--dataset", default="", help="comma list; all registered dumps if empty")
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("catalog")
    scan = sub.add_parser("scan")
    scan.add_argument("--rescan", action="store_true")
    scan.add_argument("--max-episodes", type=int)
    convert = sub.add_parser("convert", help="write dumps as v2.1 repos; those that are there are left")
    convert.add_argument("--out", required=True, help="folder of the repos")
    for name in ("stats", "inspect", "batches"):
        s = sub.add_parser(name)
        s.add_argument("--action-length", type=float, default=1.0)
        s.add_argument("--action-freq", type=float)
        s.add_argument("--action-mode", default="abs")
        s.add_argument("--out", default=None)
        s.add_argument("--size", type=int, default=32)
        s.add_argument("--seed", type=int, default=0)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = session(a.master)
    if a.what == "catalog":
        REGISTRY.catalog(spark).show(100, truncate=False)
        return
    for name in REGISTRY.select(a.dataset):
        folder = dataset_path(name, a.root)
        if not os.path.isdir(folder):
            print(json.dumps({"dataset": name, "missing": folder}))
            continue
        source = REGISTRY.get(name)
        spec = source.spec
        if a.what == "convert":
            dest = os.path.join(a.out, name)
            if not writers.ready(dest):
                episodes = source.episodes(spark, folder) if source.episodes is not None else lerobot.scan(spark, folder, spec)
                writers.convert(api.dataset(spark, name, a.root).complete().frames, episodes, dest, spec)
            print(json.dumps({"dataset": name, "repo": dest}))
            continue
        if a.what == "scan" and source.episodes is not None:
            n = source.episodes(spark, folder).selectExpr("count(*) as episodes", "sum(n_frames) as frames").first()
            print(json.dumps({"dataset": name, **n.asDict()}))
            continue
        if a.what == "scan":
            rows = writers.scanned(spark, folder, spec, lerobot.scan, os.path.join(folder, ".index"), a.max_episodes, a.rescan)
            n = rows.selectExpr("count(*) as episodes", "sum(n_frames) as frames").first()
            print(json.dumps({"dataset": name, **n.asDict()}))
            continue
        ds = api.dataset(spark, name, a.root, action_length=a.action_length, action_freq=a.action_freq, action_mode=a.action_mode).complete()
        if a.what == "stats":
            out = a.out or os.path.join(folder, stats.stats_name("joint", ds.resolved[0].rep, "default", ds.freq, a.action_length))
            stats.save_stats(ds.statistics(), out)
            print(json.dumps({"dataset": name, "stats": out}))
        elif a.what == "inspect":
            ds.windows().printSchema()
            ds.windows().show(3, truncate=120)
        else:
            ds.normalized().batches(a.size, seed=a.seed).write.mode("overwrite").parquet(a.out or os.path.join(folder, ".batches"))


if __name__ == "__main__":
    main()
