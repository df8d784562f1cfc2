"""python -m quarry index|search|get|status: the engine from a shell, results as JSON lines."""

from __future__ import annotations

import argparse
import datetime
import json
import sys

from pyspark.sql import SparkSession

from .api import Engine
from .plans.search import SearchOptions


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quarry", description=__doc__)
    verbs = p.add_subparsers(dest="verb", required=True)
    for name in ("index", "search", "get", "status"):
        v = verbs.add_parser(name)
        v.add_argument("--store", required=True, help="folder of the index")
        if name == "index":
            v.add_argument("vault")
        if name == "search":
            v.add_argument("query", nargs="+")
            v.add_argument("--limit", type=int, default=10)
            v.add_argument("--filter")
            v.add_argument("--as-of")
            v.add_argument("--links", action="store_true")
            v.add_argument("--now", default=datetime.date.today().isoformat())
        if name == "get":
            v.add_argument("ids", nargs="+")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("quarry").getOrCreate()
    engine = Engine(spark, a.store)
    if a.verb == "index":
        print(json.dumps(engine.index_vault(a.vault)))
        return 0
    if a.verb == "search":
        found = engine.query(a.query, a.now, SearchOptions(limit=a.limit, filter=a.filter, as_of=a.as_of, link_depth=int(a.links)))
        found = found.select("query_id", "rank", "chunk_id", "path", "title", "heading", "line_start", "line_end", "score", "sources", "validity_state").orderBy("query_id", "rank")
    else:
        found = engine.get(a.ids) if a.verb == "get" else engine.status()
    for row in found.toLocalIterator():
        print(json.dumps(row.asDict(True), default=str, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
