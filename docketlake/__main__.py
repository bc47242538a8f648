"""Command line: resolve, preview, collect, cache info, cache clear. Exit 0, or 2 where a run is blocked or an option is wrong."""

from __future__ import annotations

import argparse
import json
import sys

from docketlake.operators.scope import Query, QueryError
from docketlake.session import local_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docketlake")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("resolve", help="one meeting per hint, or the reason why not")
    r.add_argument("--meeting", action="append", required=True)
    r.add_argument("--calendar", help="parquet with wg, meeting_no, suffix, start_date, meeting_kind")
    r.add_argument("--directories", help="parquet with wg, name, url")
    r.add_argument("--calendar-page", action="append", default=[], metavar="GROUP=PAGE", help="calendar page of a group, an address or a file")
    r.add_argument("--directory-page", action="append", default=[], metavar="GROUP=ADDRESS", help="page that lists the meetings of a group")
    r.add_argument("--output")
    for name in ("preview", "collect"):
        c = sub.add_parser(name)
        c.add_argument("--meeting", action="append", required=True, help="folder of a meeting, repeatable")
        c.add_argument("--query", default="")
        c.add_argument("--include-tdoc", action="append", default=[])
        c.add_argument("--company", action="append", default=[])
        c.add_argument("--aliases", help="JSON object company -> spellings")
        c.add_argument("--output", required=True)
        c.add_argument("--work-dir", help="folder for payloads that all executors share")
        c.add_argument("--max-concurrency", type=int, default=4)
        c.add_argument("--retries", type=int, default=3)
        c.add_argument("--refresh", action="store_true", help="ask for every file afresh")
        c.add_argument("--public-host", action="append", default=[], help="host that the mirror stands for, repeatable")
        c.add_argument("--mirror-root", help="address or folder of a mirror")
        c.add_argument("--no-mirror", action="store_true")
        if name == "collect":
            c.add_argument("--stage", choices=("core", "complete"), default="core")
            c.add_argument("--cache-dir")
            c.add_argument("--no-cache", action="store_true")
            c.add_argument("--download", help="folder for members of the archives")
            c.add_argument("--parse-workers", type=int)
            c.add_argument("--batch-size", type=int, default=1000)
            c.add_argument("--no-resume", action="store_true")
    cache = sub.add_parser("cache").add_subparsers(dest="action", required=True)
    for action in ("info", "clear"):
        a = cache.add_parser(action)
        a.add_argument("--cache-dir", required=True)
        if action == "clear":
            a.add_argument("--yes", action="store_true")
    return p


def _aliases(path: str | None) -> dict[str, tuple[str, ...]]:
    if not path:
        return {}
    with open(path, encoding="utf-8") as f:
        value = json.load(f)
    if not isinstance(value, dict) or not all(isinstance(v, list) for v in value.values()):
        raise QueryError("aliases must be a JSON object of lists")
    return {k: tuple(map(str, v)) for k, v in value.items()}


def _pairs(given: list[str]) -> dict[str, str]:
    if wrong := [g for g in given if "=" not in g]:
        raise QueryError(f"not GROUP=PAGE: {', '.join(wrong)}")
    return dict(g.split("=", 1) for g in given)


def _options(args: argparse.Namespace):
    from docketlake.plans import api
    from docketlake.sources.fetch import Route

    if min(args.max_concurrency, getattr(args, "batch_size", 1), getattr(args, "parse_workers", None) or 1) < 1 or args.retries < 0:
        raise QueryError("numbers must be positive")
    route = Route(tuple(args.public_host), None if args.no_mirror else args.mirror_root, args.retries, args.refresh)
    more = {k: getattr(args, k) for k in ("parse_workers", "batch_size", "download") if hasattr(args, k)}
    return api.Options(args.work_dir, route, args.max_concurrency, **more)


def run(args: argparse.Namespace, spark=None) -> int:
    from docketlake.plans import api

    if args.command == "cache" and args.action == "clear":
        print(json.dumps({"cleared": api.cache_clear(args.cache_dir, confirm=args.yes)}))
        return 0
    spark = spark or local_session()
    if args.command == "cache":
        print(json.dumps(api.cache_report(spark, args.cache_dir)))
        return 0
    if args.command == "resolve":
        if not (args.calendar or args.calendar_page) or not (args.directories or args.directory_page):
            raise QueryError("a calendar and directories are needed, as tables or as pages")
        calendar = spark.read.parquet(args.calendar) if args.calendar else api.read_calendar(spark, _pairs(args.calendar_page))
        directories = spark.read.parquet(args.directories) if args.directories else api.read_directories(spark, _pairs(args.directory_page))
        got = api.resolve(spark, args.meeting, calendar, directories).orderBy("hint_id")
        rows = [json.loads(x) for x in got.toJSON().collect()]  # a row per hint given
        print(json.dumps(rows, ensure_ascii=False))
        if args.output:
            api.sinks.write_json(rows, args.output)
        return 0 if all(r["status"] == "resolved" for r in rows) else 2
    query = Query(args.query, tuple(args.include_tdoc), tuple(args.company), _aliases(args.aliases))
    options = _options(args)
    if args.command == "preview":
        result = api.preview(spark, args.meeting, query, options=options)
    else:
        state = None if args.no_resume else f"{args.output.rstrip('/')}.state"
        result = api.collect(spark, args.meeting, query, args.stage, None if args.no_cache else args.cache_dir, state_dir=state, options=options)
    result.write(args.output)
    return result.exit_code


def main(argv: list[str] | None = None, spark=None) -> int:
    try:
        return run(parser().parse_args(argv), spark)
    except (QueryError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
