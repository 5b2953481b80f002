"""Upkeep and reading of a stored log: python -m loomlog ROOT COMMAND; Spark settings come from spark-submit or --conf.

Options that have a variable beside them take its value where they are not given.
"""

from __future__ import annotations

import argparse
import json
import os

from .model import Query, QueryItem


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomlog", description=__doc__)
    p.add_argument("root", nargs="?", default=os.environ.get("LOOMLOG_ROOT"), help="the store's folder (LOOMLOG_ROOT)")
    p.add_argument("command", choices=["head", "read", "tracking", "check", "compact", "vacuum", "load"])
    p.add_argument("--conf", action="append", default=[], metavar="KEY=VALUE", help="a Spark setting")
    p.add_argument("--type", action="append", default=[], help="read: an event type (any of them)")
    p.add_argument("--tag", action="append", default=[], help="read: a tag (all of them)")
    p.add_argument("--start", type=int, help="read: first position, inclusive")
    p.add_argument("--backwards", action="store_true")
    p.add_argument("--limit", type=int)
    p.add_argument("--keep", type=int, default=1, help="vacuum: manifests that stay readable")
    p.add_argument("--max-header-bytes", type=int, default=int(os.environ.get("LOOMLOG_MAX_HEADER_BYTES", 0)) or None, help="bound of an event's type and tags (LOOMLOG_MAX_HEADER_BYTES)")
    p.add_argument("--source", help="load: a Parquet table of events")
    p.add_argument("--order", action="append", default=[], help="load: columns that order the events")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    """Runs one command and prints JSON lines; returns 1 if a check fails."""
    a = parser().parse_args(argv)
    if not a.root:
        parser().error("no root")
    if spark is None:
        from pyspark.sql import SparkSession

        b = SparkSession.builder.appName("loomlog")
        for c in a.conf:
            b = b.config(*c.split("=", 1))
        spark = b.getOrCreate()
    from .sources.store import EventStore

    store = EventStore(spark, a.root, a.max_header_bytes)
    if a.command == "head":
        print(json.dumps({"head": store.head()}))
    elif a.command == "read":
        query = Query([QueryItem(a.type, a.tag)]) if a.type or a.tag else None
        for e in store.read(query, a.start, a.backwards, a.limit):
            print(json.dumps({"position": e.position, "type": e.event.event_type, "tags": e.event.tags, "uuid": e.event.uuid, "metadata": e.event.metadata, "data": e.event.data.hex()}))
    elif a.command == "tracking":
        for r in store.tracking().toLocalIterator():
            print(json.dumps(r.asDict()))
    elif a.command == "check":
        r = store.check().first().asDict()
        print(json.dumps(r))
        return 0 if r["ok"] else 1
    elif a.command == "compact":
        store.compact()
    elif a.command == "vacuum":
        print(json.dumps({"deleted": store.vacuum(a.keep)}))
    elif a.command == "load":
        print(json.dumps({"head": store.bulk_load(spark.read.parquet(a.source), a.order)}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
