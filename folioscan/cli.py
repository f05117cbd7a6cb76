"""Command line: index folders, search, show quality. Exit codes: 0 ok, 1 folder unavailable, 2 usage or query error, 3 store unusable."""

from __future__ import annotations

import argparse
import json
import os
import re
import sys
import time

from .plans.querylang import QueryError


def arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="folioscan")
    p.add_argument("--store", default=os.environ.get("FOLIOSCAN_STORE", "folioscan-store"))
    p.add_argument("--dir", action="append", default=[], help="folder to index")
    p.add_argument("--search")
    p.add_argument("--type", default=None)
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--cursor")
    p.add_argument("--locations", type=int, metavar="DOC_ID")
    p.add_argument("--context", metavar="LOCATION", help="a location as JSON: segment_row_id, start and end")
    p.add_argument("--offset", type=int, default=0)
    p.add_argument("--revision", type=int)
    p.add_argument("--regex", action="store_true")
    p.add_argument("--match-case", action="store_true")
    p.add_argument("--whole-word", action="store_true")
    p.add_argument("--mode", choices=("literal", "expanded", "hybrid"), default="literal")
    p.add_argument("--synonyms", help="JSON file")
    p.add_argument("--quality", action="store_true")
    p.add_argument("--reprocess", nargs="*", metavar="PATH", help="parse these files again, or all that another parser version made")
    p.add_argument("--report", metavar="FILE", help="write the report of the run as JSON")
    p.add_argument("--embedding-model", metavar="FOLDER", default=os.environ.get("FOLIOSCAN_MODEL"))
    p.add_argument("--build-vectors", action="store_true")
    p.add_argument("--self-check", action="store_true")
    p.add_argument("--watch", type=float, metavar="SECONDS", help="index again and, when something changed, search again at this pace")
    p.add_argument("--rounds", type=int, default=0, help="end --watch after so many rounds")
    p.add_argument("--ocr", action="store_true", help="parse files again that had no recognition")
    p.add_argument("--version", action="version", version="folioscan 1")
    p.add_argument("--json", action="store_true")
    return p.parse_args(argv)


def listing(result: dict) -> str:
    """Results as plain lines; tags are dropped."""
    lines = []
    for r in result["results"]:
        lines.append(f"{r['path']}  ({r['total_matches']})")
        lines += ["    " + re.sub(r"<[^>]+>", "", s) for part in r["segments"] for s in part["snippets"]]
    return "\n".join(lines)


def self_check(spark) -> dict:
    from .functions.fold import fold_text
    from .functions.porter import stem

    return {"folding": fold_text("會議", spark) == "会议", "stemming": stem("outstandings") == "outstand", "spark": spark.range(3).count() == 3}


def main(argv: list[str] | None = None, spark=None) -> int:
    try:
        args = arguments(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    from .facade import Engine
    from .operators.expand import read_synonyms
    from .operators.vectors import HashEncoder, OnnxEncoder
    from .session import session
    from .sources.store import StoreError

    show = lambda x: print(json.dumps(x, ensure_ascii=False, default=str))
    if any(not os.path.isdir(d) for d in args.dir):
        print("folder unavailable", file=sys.stderr)
        return 1
    spark = spark or session()
    if args.self_check:
        checks = self_check(spark)
        show(checks)
        return 0 if all(checks.values()) else 3
    try:
        if args.ocr:
            from .sources import ocr

            ocr.enable()
        engine = Engine(spark, args.store, args.dir, encoder=OnnxEncoder(args.embedding_model) if args.embedding_model else HashEncoder())
        if args.dir:
            report = engine.run(backfill="ocr_disabled" if args.ocr else None)
            if args.report:
                with open(args.report, "w", encoding="utf-8") as f:
                    json.dump(report, f, ensure_ascii=False, default=str)
            elif not args.search:
                show(report)
        if args.reprocess is not None:
            show(engine.start_reprocess(args.reprocess or None))
        if args.build_vectors:
            show({"revision": engine.build_vectors()})
        options = {"match_case": args.match_case, "whole_word": args.whole_word, "regex": args.regex}
        if args.locations is not None:
            from .plans.search import Options

            show(engine.match_locations(args.search or "", args.locations, options=Options(**options), offset=args.offset, limit=args.limit, revision=args.revision))
        elif args.context:
            place = json.loads(args.context)
            show(engine.match_context(*(int(place[k]) for k in ("segment_row_id", "start", "end"))))
        elif args.search:
            synonyms = read_synonyms(args.synonyms)[0] if args.synonyms else None
            result = engine.search(args.search, args.type, args.limit, cursor=args.cursor, search_mode=args.mode, synonyms=synonyms, **options)
            show(result) if args.json else print(listing(result))
        seen, n = engine.store.revision, 0
        while args.watch is not None and (not args.rounds or n < args.rounds):
            time.sleep(args.watch)
            n += 1
            engine.run()
            if engine.store.revision != seen:
                seen = engine.store.revision
                if args.search:
                    print(listing(engine.search(args.search, args.type, args.limit, **options)), flush=True)
        if args.quality:
            show(engine.problem_documents(args.offset, args.limit) | {"status": engine.index_status()})
    except (QueryError, ValueError, KeyError, TypeError) as e:
        print(getattr(e, "code", str(e)), file=sys.stderr)
        return 2
    except (StoreError, OSError) as e:
        print(str(e), file=sys.stderr)
        return 3
    return 0


if __name__ == "__main__":
    sys.exit(main())
