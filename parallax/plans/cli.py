"""Command line: ``python -m parallax.plans.cli COMMAND --data FOLDER``. Exit codes: 1 errors found or nothing to fit, 2 input missing."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from parallax.plans import pipelines
from parallax.session import local_session
from parallax.sources import tables

REGISTER = "key_bbref_minors string, key_mlbam long, key_fangraphs string, name_first string, name_last string, birth_year string, birth_month string, birth_day string, mlb_played_first string"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="parallax")
    p.add_argument("command", choices=("scrape", "crosswalk", "audit", "mlb", "model", "project", "counts", "all"))
    p.add_argument("--data", required=True, help="folder of tables")
    p.add_argument("--cache", help="folder of cached pages (scrape) or of JSON documents by side (mlb)")
    p.add_argument("--register", nargs="*", default=[], help="CSV shards of the person register (crosswalk)")
    p.add_argument("--start", type=int, default=2000)
    p.add_argument("--end", type=int, default=2026)
    p.add_argument("--side", choices=("batting", "pitching"), default="pitching")
    p.add_argument("--boot", type=int, default=200)
    p.add_argument("--train-direction", choices=("both", "kbo_to_mlb", "mlb_to_kbo"), default="both")
    p.add_argument("--players", help="names, comma separated")
    p.add_argument("--season", type=int, default=2026)
    p.add_argument("--top", type=int, default=5)
    p.add_argument("--min-pt", type=float, default=None)
    p.add_argument("--source", choices=("statsapi", "bref"), default="statsapi")
    p.add_argument("--report", help="where to write the Markdown report")
    p.add_argument("--offline", action="store_true", help="read cached pages alone, as Spark always does here; pages are downloaded by sources.fetch")
    p.add_argument("-v", "--verbose", action="store_true", help="Spark's own messages too")
    return p


def run(args: argparse.Namespace, store: pipelines.Store) -> int:
    direction = None if args.train_direction == "both" else args.train_direction
    source = "" if args.source == "statsapi" else "_bref"

    def say(text: str) -> None:
        Path(args.report).write_text(text, encoding="utf-8") if args.report else print(text)

    if args.command in ("scrape", "all"):
        pipelines.scrape_cached(store, args.cache, args.start, args.end)
    if args.command in ("crosswalk", "all"):
        pipelines.link(store, tables.read_csv(store.spark, args.register, REGISTER)).stats.show(truncate=False)
    if args.command == "mlb":
        docs = {s: store.spark.read.schema("key_mlbam long, body string").json(f"{args.cache}/{s}") for s in ("batting", "pitching")}
        leagues = {s: store.spark.read.schema("body string").json(f"{args.cache}/league_{s}") for s in ("batting", "pitching")}
        pipelines.fetch_away(store, docs, leagues, args.start, args.end)
    if args.command in ("audit", "all"):
        _, text, code = pipelines.audit(store, args.start, args.end)
        say(text)
        if args.command == "audit":
            return code
    if args.command == "model":
        say(pipelines.fit(store, args.side, args.min_pt, direction, args.boot, source).report)
    if args.command == "project":
        players = args.players.split(",") if args.players else None
        pipelines.projections(store, args.side, args.season, players, args.top, 150 if args.min_pt is None else args.min_pt, direction, args.boot, source).show(200, truncate=False)
    if args.command in ("counts", "all"):
        if args.command == "counts" or store.exists(f"mlb_{args.side}{source}"):
            pipelines.sample_sizes(store, args.side, source).show()
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        spark = local_session()
        if args.verbose:
            spark.sparkContext.setLogLevel("INFO")
        return run(args, pipelines.Store(spark, args.data))
    except tables.MissingInput as e:
        print(e, file=sys.stderr)
        return 2
    except (pipelines.NothingToFit, pipelines.TooFewTeams) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
