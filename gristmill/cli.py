"""Command line: index, ask, chat, status, check, serve."""

from __future__ import annotations

import argparse
import sys
import time

from gristmill.engine import Engine, as_text
from gristmill.session import session
from gristmill.sources.files import Audit, HouseRules, record_score


def show(engine: Engine, audit: Audit, question: str) -> None:
    began = time.time()
    answer = engine.ask(question)
    if answer.compiled is not None:
        with engine.limit():
            print(as_text(answer.chart["data"] if answer.chart else answer.compiled.df))
        print("\n".join(x for x in (answer.text, answer.hint, f"[{answer.tier}] {' > '.join(answer.compiled.explain)}") if x))
    elif answer.docs is not None:
        print(answer.text or as_text(answer.docs.select("source", "chunk", "score")))
    else:
        print(answer.text)
        for i, option in enumerate(answer.options or [], start=1):
            print(f"  {i}. {option}")
    audit.log(question, answer.kind, time.time() - began, answer.compiled.tables_used if answer.compiled else ())


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gristmill")
    parser.add_argument("--store", default="gristmill-store", help="folder of the indexed tables")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("index").add_argument("paths", nargs="+")
    commands.add_parser("ask").add_argument("question")
    commands.add_parser("chat")
    commands.add_parser("status")
    commands.add_parser("check")
    commands.add_parser("serve").add_argument("--port", type=int, default=8080)
    parser.add_argument("--rules", default="", help="text file of rules for the model, one a line")
    args = parser.parse_args(argv)
    rules, scores = HouseRules(args.rules) if args.rules else None, f"{args.store}/scores.json"
    engine, audit = Engine(session(), rules=rules), Audit(f"{args.store}/audit")
    if args.command == "index":
        engine.open(args.store)  # what is indexed stays
        print("\n".join(engine.load(args.paths) + [f"warning: {w}" for w in engine.warnings]))
        engine.catalog.discover_links()
        engine.describe()
        engine.save(args.store)
        return 0
    names = engine.open(args.store)
    if args.command in ("status", "check"):
        print(as_text(engine.reports()["inventory"]()) if names else "nothing is indexed")
        if args.command == "check":
            record_score(scores, "check", {"tables": len(names), "ok": bool(names)})
        return int(args.command == "check" and not names)
    if args.command == "serve":
        from gristmill.server import serve

        serve(engine, audit, args.port, rules=rules, scores=scores)
    elif args.command == "ask":
        show(engine, audit, args.question)
    else:
        for line in sys.stdin:
            if line.strip():
                show(engine, audit, line.strip())
    return 0


if __name__ == "__main__":
    sys.exit(main())
