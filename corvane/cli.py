"""Commands: init, index, search, stats, topics, reindex, refine, revectorize, rebuild, segment, reindex-full, migrate, interactive, version."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone

from pyspark.sql import DataFrame

from corvane.api import Conversations
from corvane.operators import retrieval
from corvane.operators.pending import reindex_status
from corvane.plans import reindex
from corvane.plans.residency import StageLog
from corvane.session import session

VERSION = "0.1.0"
HELP, EXITS = "/help /stats /limit N /mode vector|text; an empty line leaves", ("/exit", "/quit", "/q", "exit", "quit", "")


def _show(rows) -> None:
    for r in rows:
        print(f"{r['rank']:>3}  {r['score']:.4f}  [{r['label']}]  {r['author_role']}: {r['snippet']}")


def _report(found: dict) -> None:
    """The numbers of a report, and a line per intent."""
    for k, v in found.items():
        if isinstance(v, DataFrame):
            for r in v.toLocalIterator():
                print(f"{k}: {r[0]}: {r[1]}")
        else:
            print(f"{k}: {v}")


def interactive(talks: Conversations, lines=sys.stdin) -> None:
    """A line loop over searches."""
    limit, mode = retrieval.LINE_LIMIT, "vector"
    for line in lines:
        line = line.strip()
        if line in EXITS:
            return
        command, _, rest = line.partition(" ")
        if command == "/help":
            print(HELP)
        elif command == "/stats":
            _report(talks.get_statistics())
        elif command == "/limit" and rest.isdigit():
            limit = retrieval.clamp_limit(int(rest))
        elif command == "/mode" and rest in retrieval.MODES:
            mode = rest
        elif command.startswith("/"):
            print(HELP)
        else:
            _show(talks.search(line, limit, mode).collect())


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corvane")
    parser.add_argument("--root", default="corvane-store")
    parser.add_argument("--profile")
    parser.add_argument("--log", action="store_true", help="a line per stage")
    parser.add_argument("--master")
    parser.add_argument("--buckets", type=int, default=16, help="of tables that are made")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("init").add_argument("source")
    found = commands.add_parser("search")
    found.add_argument("query")
    found.add_argument("--limit", type=int, default=retrieval.CLI_LIMIT)
    found.add_argument("--mode", default="vector", choices=retrieval.MODES)
    found.add_argument("--topic")
    commands.add_parser("topics").add_argument("--limit", type=int, default=20)
    for name in ("reindex", "refine", "revectorize"):
        commands.add_parser(name).add_argument("--limit", type=int)
    full = commands.add_parser("reindex-full")
    full.add_argument("--force", action="store_true")
    full.add_argument("--status", action="store_true")
    full.add_argument("--after")
    full.add_argument("--limit", type=int)
    again = commands.add_parser("rebuild")
    again.add_argument("--vectors-only", action="store_true")
    again.add_argument("--resume", action=argparse.BooleanOptionalAction, default=True)
    for name in ("stats", "index", "segment", "migrate", "interactive", "version"):
        commands.add_parser(name)
    told = parser.parse_args(args)
    if told.command == "version":
        print(VERSION)
        return 0
    talks = Conversations(session(told.master), told.root, told.profile, StageLog() if told.log else None, told.buckets)
    live = {"progress": print} if told.log else {}  # a line per batch
    store, now = talks.store, datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    match told.command:
        case "init":
            _report(talks.import_archive(told.source, now))
        case "search":
            _show(talks.search(told.query, told.limit, told.mode, told.topic).collect())
        case "stats":
            _report(talks.get_statistics())
            for model in talks.models():
                print(model)
        case "index":
            print(f"messages: {talks.rebuild_index()}")
            print(f"vectors: {talks.index_vectors()}")
        case "topics":
            print(talks.rollups.topic_totals().first().asDict())
            for r in talks.rollups.topic_rollup(told.limit).collect():
                print(f"{r['segment_topic']}: {r['messages']} messages, {r['conversations']} conversations, {r['span']}")
        case "reindex":
            print(reindex.revectorize_outdated(store, talks.profile, now, limit=told.limit, **live))
        case "refine":
            print(reindex.refine_pending(store, talks.profile, now, limit=told.limit, **live))
        case "revectorize":
            print(reindex.revectorize_dimension(store, talks.profile, now, told.limit, **live))
        case "reindex-full":
            if told.status:
                with store.aligned():
                    print(reindex_status(store.read("messages"), store.read("message_content"), store.read("vectors"), talks.profile.version).first().asDict())
            else:
                print(reindex.reindex_all(store, talks.profile, now, force=told.force, after=told.after, limit=told.limit, **live))
        case "rebuild":
            print(reindex.rebuild(store, talks.profile, now, vectors_only=told.vectors_only, resume=told.resume, **live))
        case "segment":
            print(reindex.segment_pending(store, talks.profile.segment_threshold))
        case "migrate":
            for r in reindex.migrate(store, now).collect():
                print(f"{r['item']}: {r['n']}")
        case "interactive":
            interactive(talks)
    return 0


if __name__ == "__main__":
    sys.exit(main())
