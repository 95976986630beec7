"""Command line: python -m tideline.cli --repo URI COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
import time
from itertools import chain, islice

from pyspark.sql import SparkSession

from tideline.operators.frame import Frame, mask, paged
from tideline.sources.transfer import export_collections, import_collections, write_csv_text
from tideline.store.repo import Repo
from tideline.store.schema import Schema


def one(known: list[str], given: str, what: str) -> str:
    """The name given, or the only one that begins with it."""
    if given in known:
        return given
    found = [k for k in known if k.startswith(given)]
    if len(found) != 1:
        raise SystemExit(f"{what} {given!r}: {'none' if not found else 'several'} found")
    return found[0]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tideline")
    p.add_argument("--repo", required=True)
    p.add_argument("--timing", action="store_true", help="print the seconds a command took")
    p.add_argument("--pretty", action="store_true", help="print columns under one another")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: str, **options):
        c = sub.add_parser(name, aliases={"length": ["len"], "delete": ["del"]}.get(name, []))
        for a in args:
            if a[-1] in "?*":
                c.add_argument(a[:-1], nargs=a[-1])
            else:
                c.add_argument(a)
        for k, v in options.items():
            c.add_argument(f"--{k.replace('_', '-')}", **v)
        return c

    text, flag = {}, {"action": "store_true"}
    number = {"type": int}
    command("read", "series", "columns*", greater_than=text, less_than=text, before=text, mask=text, limit=number, offset=number, tail=number, closed={"default": "l"}, paginate=number)
    command("length", "series", greater_than=text, less_than=text)
    command("ls", "collection?")
    command("create", "columns*", collection={"required": True}, kv=flag)
    command("write", "series")
    command("rev", "collection", extend={"action": "count", "default": 0})
    command("help")
    for name in ("merge", "defrag", "trim"):
        command(name, "collection*")
    command("squash", "collection*")
    command("push", "remote", "collection*", shallow=flag)
    command("pull", "remote", "collection*", shallow=flag)
    command("delete", "names*")
    command("rename", "old", "new")
    command("gc")
    command("export", "folder", "collection*", type={"default": "csv"})
    command("import", "folder", "collection*")
    command("version")
    return p


def text_of(v) -> str:
    return "" if v is None else v.isoformat() if hasattr(v, "isoformat") else str(v)


def table(pages: list, offset: int, limit: int | None, pretty: bool, say) -> None:
    """Rows of several DataFrames, one after the other, as CSV or in columns of equal width."""
    rows = chain.from_iterable(df.toLocalIterator() for df in pages)
    rows = (tuple(map(text_of, r)) for r in islice(rows, offset, None if limit is None else offset + limit))
    head = tuple(pages[0].columns)
    if not pretty:
        for r in chain([head], rows):
            say(",".join(r))
        return
    rows = [head, *rows]  # what a screen shows
    widths = [max(len(r[i]) for r in rows) for i in range(len(head))]
    for r in rows:
        say("  ".join(x.ljust(w) for x, w in zip(r, widths)).rstrip())


def run(spark: SparkSession, argv: list[str], out=sys.stdout, text=None) -> int:
    args = parser().parse_args(argv)
    began, repo = time.time(), Repo(spark, args.repo)
    say = lambda *x: print(*x, file=out)

    def collection(name: str):
        return repo.collection(one(repo.ls(), name, "collection"))

    def series(path: str):
        c, _, label = path.partition("/")
        c = collection(c)
        return c / one(c.ls(), label, "series")

    command = {"len": "length", "del": "delete"}.get(args.command, args.command)
    chosen = getattr(args, "collection", None)
    some = [collection(x) for x in chosen] if isinstance(chosen, list) and chosen else list(repo) if isinstance(chosen, list) else []
    if command == "read":
        s = series(args.series)
        df = s.df(args.greater_than, args.less_than, args.before, args.closed)
        if args.mask:  # before the projection, so that it sees every column
            df = mask(df, args.mask, s.schema.idx)
        frame = Frame(df, s.schema)
        if args.tail:  # of the rows, before anything is made of them
            frame = frame.tail(args.tail)
        computed = any("(" in c for c in args.columns)
        pages = [Frame(p, s.schema) for p in paged(frame.df, s.schema.idx, args.paginate)] if args.paginate else [frame]
        shown = []
        for page in pages or [frame]:
            if computed:  # aggregates are those of a page
                page = page.reduce(*args.columns)
                shown.append(page.sorted(*page.df.columns).df)
            else:
                shown.append(page.sorted().select(*args.columns).df)
        table(shown, args.offset or 0, args.limit, args.pretty, say)
    elif command == "length":
        say(series(args.series).df(args.greater_than, args.less_than).count())
    elif command == "ls":
        for x in repo.ls() if not args.collection else collection(args.collection).ls():
            say(x)
    elif command == "create":
        lines = [c for c in args.columns]
        repo.create_collection((Schema.kv if args.kv else Schema)(*lines), args.collection)
    elif command == "write":
        c, _, label = args.series.partition("/")
        write_csv_text(repo, one(repo.ls(), c, "collection"), label, sys.stdin.read() if text is None else text)
    elif command == "rev":
        c = collection(args.collection)
        for r in c.changelog.log():
            segments = c.manifest(revision=r).segments if args.extend else ()
            say("*" if r.is_leaf else " ", r.child, *([f"{len(segments)} segments"] if args.extend else []))
            for s in segments if args.extend > 1 else ():
                say("   ", s.label, json.dumps(s.interval.to_json(c.schema)), s.digest, s.length)
    elif command in ("merge", "defrag", "trim", "squash"):
        for c in some:
            got = getattr(c, command)()
            say(c.label, got if isinstance(got, int) else len(got))
    elif command in ("push", "pull"):
        getattr(repo, command)(Repo(spark, args.remote), *(c.label for c in some), shallow=args.shallow)
    elif command == "delete":
        for name in args.names:
            c, _, label = name.partition("/")
            if label:
                collection(c).delete(one(collection(c).ls(), label, "series"))
            else:
                repo.delete(one(repo.ls(), c, "collection"))
    elif command == "rename":
        a, b = args.old.partition("/"), args.new.partition("/")
        if a[2]:
            collection(a[0]).rename(a[2], b[2])
        else:
            repo.rename(args.old, args.new)
    elif command == "gc":
        say(*repo.gc())
    elif command == "export":
        export_collections(repo, args.folder, [c.label for c in some], args.type)
    elif command == "import":
        import_collections(repo, args.folder, args.collection or None)
    elif command == "help":
        say(parser().format_help())
    elif command == "version":
        from tideline import __version__

        say(__version__)
    if args.timing:
        say(f"{time.time() - began:.3f} s")
    return 0


if __name__ == "__main__":
    session = SparkSession.builder.appName("tideline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    sys.exit(run(session, sys.argv[1:]))
