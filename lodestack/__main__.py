"""python -m lodestack ROOT ls VOLUME FRN | search QUERY... | request: a thin command line over a catalogue.

-n limits the answer, -p prints paths only, -j prints JSON lines; `request` reads JSON requests {"query", "limit"} from standard input and
answers each with one JSON line.
"""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame

from lodestack.catalog import Catalog
from lodestack.session import build_session

CLI_LIMIT, REQUEST_LIMIT = 50, 200


def answer(catalog: Catalog, query: str, limit: int, now: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows, summary): content search if the query has content terms, else metadata search."""
    if catalog.parse(query, now).has_content_search:
        return catalog.search_content(query, now, limit), None
    found = catalog.search(query, now)
    return found.page(0, limit), found.summary()


def show(rows: DataFrame, paths_only: bool, as_json: bool) -> None:
    path = next((c for c in ("full_path", "file_path", "name") if c in rows.columns), rows.columns[0])
    if paths_only:
        for row in rows.select(path).toLocalIterator():
            print(row[0])
    elif as_json:
        for line in rows.toJSON().toLocalIterator():
            print(line)
    else:
        rows.show(1_000_000, truncate=60)


def main(argv: list[str]) -> None:
    parser = argparse.ArgumentParser(prog="lodestack", description=__doc__)
    parser.add_argument("root")
    parser.add_argument("command", choices=["ls", "search", "request", "version"])
    parser.add_argument("words", nargs="*")
    parser.add_argument("-n", type=int, default=CLI_LIMIT)
    parser.add_argument("-p", action="store_true")
    parser.add_argument("-j", action="store_true")
    args = parser.parse_args(argv)
    if args.command == "version":
        print("lodestack 0.1")
        return
    catalog = Catalog(build_session(), args.root)
    if args.command == "ls":
        show(catalog.list_directory(args.words[0], int(args.words[1])), args.p, args.j)
    elif args.command == "search":
        show(answer(catalog, " ".join(args.words), args.n, int(time.time()))[0], args.p, args.j)
    else:
        for line in sys.stdin:
            request = json.loads(line)
            began = time.time()
            rows, summary = answer(catalog, request["query"], request.get("limit", REQUEST_LIMIT), int(began))
            items = [json.loads(x) for x in rows.toJSON().collect()]  # at most `limit` rows
            total = summary.first()["total_matches"] if summary is not None else len(items)
            print(json.dumps({"results": items, "total": total, "search_time_us": int((time.time() - began) * 1e6)}, ensure_ascii=False), flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
