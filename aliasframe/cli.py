"""Command line: ``python -m aliasframe.cli init|status|ingest|export|payees|lint|fakeness|key|lens``.

Exit codes: 0 fine, 1 refused or some file faulty, 2 wrong use or no access. Messages on the error stream; no real value is
printed unless ``--show-raw`` asks for it.
"""

from __future__ import annotations

import argparse
import os
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.text import token_number
from .operators import aliases, checks, projection, redact
from .plans import ingest as plan
from .sources import keys, statement


def _spark() -> SparkSession:
    spark = SparkSession.builder.appName("aliasframe").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    statement.register(spark)
    return spark


def _ingest(spark, store, args) -> int:
    options = {f"map.{name}": header for name, _, header in (pair.partition("=") for pair in args.map or [])}
    rows = statement.read(spark, list(args.files), **options)
    bad = 0
    for r in plan.ingest(store, rows).orderBy("source_file").toLocalIterator():
        bad += r["faulty"] > 0
        print(f"{r['source_file']}: {r['n_rows']} rows, {r['new_variants']} new spellings, {r['faulty']} faulty")
    if args.show_raw:
        for r in rows.where(F.col("reason").isNotNull()).select("source_file", "record_no", "reason").toLocalIterator():
            print(f"{r['source_file']} record {r['record_no']}: {r['reason']}", file=sys.stderr)
    return int(bad > 0)


def _export(store, args) -> int:
    raw, mapping, variants = (plan.table(store, t) for t in ("raw_transactions", "alias_mapping", "payee_variant"))
    stamp = datetime.now(UTC).isoformat()
    months = [args.month] if args.month else sorted(r[0] for r in projection.months(raw).toLocalIterator())
    worst = 0
    for month in months:
        out = f"{args.out}/proj-{month}{'' if args.parts else '.json'}" if not args.month else args.out
        done = projection.export_month(raw, mapping, variants, month, out, stamp, single=not args.parts)
        print(f"{month}: {done['verdict']}, {done['rows']} rows, {done['findings']} findings", file=sys.stderr if done["verdict"] == "red" else sys.stdout)
        worst |= done["verdict"] == "red"
    return int(worst)


def _payees(store, args) -> int:
    try:
        if args.merge:
            plan.change(store, aliases.merge, *args.merge)
        elif args.split:
            plan.change(store, aliases.split, args.split)
        elif args.rename:
            plan.change(store, aliases.rename, *args.rename)
        else:
            for r in aliases.review(plan.table(store, "alias_mapping"), plan.table(store, "payee_variant")).orderBy(token_number(F.col("head")), "head").toLocalIterator():
                print(f"{r['head']}\t{r['variant_count']}\t{r['confidence']:.2f}{' review' if r['low_confidence'] else ''}")
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def _key(args) -> int:
    held = keys.KeyFile(args.file)
    try:
        if args.action == "generate":
            held.generate(args.force)
        elif args.action == "set":
            held.set(sys.stdin.readline().strip(), args.force)
        elif args.action == "delete":
            held.delete()
        print("key present" if held.present() else "no key")
    except (ValueError, FileExistsError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="aliasframe")
    sub = p.add_subparsers(dest="command", required=True)
    with_store = argparse.ArgumentParser(add_help=False)
    with_store.add_argument("--store", required=True)
    with_store.add_argument("--key", help="else from the environment")
    sub.add_parser("init", parents=[with_store])
    sub.add_parser("status", parents=[with_store])
    i = sub.add_parser("ingest", parents=[with_store])
    i.add_argument("files", nargs="+")
    i.add_argument("--map", action="append", metavar="FIELD=HEADER")
    i.add_argument("--show-raw", action="store_true")
    e = sub.add_parser("export", parents=[with_store])
    e.add_argument("--out", required=True)
    e.add_argument("--parts", action="store_true", help="a folder of JSON lines instead of one document")
    which = e.add_mutually_exclusive_group(required=True)
    which.add_argument("--month")
    which.add_argument("--all-months", action="store_true")
    y = sub.add_parser("payees", parents=[with_store])
    todo = y.add_mutually_exclusive_group()
    todo.add_argument("--review", action="store_true")
    todo.add_argument("--merge", nargs=2, metavar=("WINNER", "LOSER"))
    todo.add_argument("--split")
    todo.add_argument("--rename", nargs=2, metavar=("TOKEN", "LABEL"))
    sub.add_parser("lint").add_argument("file")
    sub.add_parser("fakeness").add_argument("target")
    k = sub.add_parser("key")
    k.add_argument("action", choices=("generate", "set", "delete", "show"), help="set reads the key from the input; none is ever printed")
    k.add_argument("file")
    k.add_argument("--force", action="store_true")
    n = sub.add_parser("lens", parents=[with_store])
    n.add_argument("text")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "key":
        return _key(args)
    if args.command == "status" and "://" not in args.store and not os.path.exists(os.path.join(args.store, "store.json")):
        print("no store here", file=sys.stderr)  # known without a session
        return 2
    spark = _spark()
    if args.command == "lint":
        found = checks.lint_file(spark, args.file)
        print(checks.report(found))
        return int(not found.isEmpty())
    if args.command == "fakeness":
        found = checks.scan_files(spark, args.target).select("kind", F.format_string("%s:%d:%d", "path", "line", "col").alias("detail"))
        print(checks.report(found))
        return int(not found.isEmpty())
    try:
        store = plan.open_store(spark, args.store, args.key, create=args.command == "init")
    except (FileNotFoundError, PermissionError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    if args.command in ("init", "status"):
        print("ready")
        return 0
    if args.command == "ingest":
        return _ingest(spark, store, args)
    if args.command == "export":
        return _export(store, args)
    if args.command == "payees":
        return _payees(store, args)
    one = spark.createDataFrame([(1, args.text)], "k int, text string")
    print(redact.lens(one, "k", "text", plan.table(store, "alias_mapping")).first()["rendered"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
