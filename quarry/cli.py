"""Command line: gen, load, query, compact, verify, resplit, serve; without a command, an interactive prompt."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from quarry import schema as schemas
from quarry.config import Config
from quarry.errors import EngineError
from quarry.operators import approx
from quarry.session import Session
from quarry.sources import generator


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry", description=__doc__)
    p.add_argument("--data", default="data", help="folder of the table")
    p.add_argument("--config", help="TOML file of settings")
    p.add_argument("--schema", help="TOML file of columns")
    s = p.add_subparsers(dest="command")
    g = s.add_parser("gen", help="append generated rows")
    g.add_argument("rows", type=int)
    g.add_argument("--csv", help="write them to this folder as CSV instead")
    s.add_parser("load", help="append a CSV file with a header").add_argument("file")
    q = s.add_parser("query", help="answer a statement")
    q.add_argument("sql")
    q.add_argument("--accuracy", type=float, help="answer from a sample at the rate that this target asks for")
    q.add_argument("--aqp-mode", choices=[*approx.MODES, "off"])
    c = s.add_parser("compact", help="merge delta files into segments")
    c.add_argument("--all", action="store_true", help="whatever the strategy would pick")
    s.add_parser("verify", help="compare files with the manifest")
    s.add_parser("serve", help="the HTTP interface").add_argument("--port", type=int, default=8000)
    s.add_parser("resplit", help="rewrite all segments").add_argument("--rows", type=int)
    return p


def show(found: dict) -> str:
    if found["type"] == "groups":
        return "\n".join(f"GROUP: {g['key']}|{g['value']}|{g['confidence']}" for g in found["groups"]) or "EMPTY"
    return f"SCALAR: {found['value']}|{found['confidence']}" if found["type"] == "scalar" else "EMPTY"


def run(session: Session, args: argparse.Namespace) -> str:
    store = session.store
    if args.command == "gen":
        rows = generator.rows(session.spark, args.rows, store.schema, session.config.seed)
        if args.csv:
            rows.write.mode("overwrite").option("header", True).csv(args.csv)
            return f"{args.rows} rows written to {args.csv}"
        return f"{store.append(rows)} rows"
    if args.command == "load":
        return f"{session.load_csv(args.file)} rows"
    if args.command == "query":
        if args.aqp_mode:
            session.set_aqp_mode(args.aqp_mode)
        elif args.accuracy is not None:
            session.accuracy = args.accuracy
        return show(session.query(args.sql))
    if args.command == "compact":
        return f"{store.compact(all_deltas=args.all)} deltas merged"
    if args.command == "verify":
        return "\n".join(f"{name}: {'ok' if ok else 'FAILED'}" for name, ok in store.verify().items()) or "empty"
    return f"{store.resplit(args.rows)} segments"


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("quarry").getOrCreate()
    config = Config.load(args.config) if args.config else Config()
    schema = schemas.load(args.schema) if args.schema and Path(args.schema).exists() else None
    try:
        with Session(spark, args.data, schema, config) as session:
            if args.command is None:
                from quarry.repl import Prompt

                Prompt(session).cmdloop()
            elif args.command == "serve":
                from quarry.http_api import server

                session.compact_in_background()
                server(session, args.port).serve_forever()
            else:
                print(run(session, args))
    except EngineError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
