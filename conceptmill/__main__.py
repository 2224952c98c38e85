"""Command line: import, add-refsets, inspect, verify, stats, list, expand, search, lookup, history, hierarchy, diff, batch."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from . import batch as batches
from .catalog import Config, load, save, verify
from .ecl import EclError, ParseError
from .engine import Engine, diff
from .session import local_session
from .sources import snapshot

OPERATORS = {"descendants": "<", "descendants-or-self": "<<", "children": "<!", "children-or-self": "<<!", "ancestors": ">", "ancestors-or-self": ">>", "parents": ">!", "parents-or-self": ">>!"}


def resolve(name: str, library: str | None) -> str:
    """A path as it is, or a name of the library: name, name@date prefix, the latest of those that match."""
    if "/" in name or Path(name).exists() or not library:
        return name
    base, _, wanted = name.partition("@")
    found = []
    for p in Path(library).iterdir():
        stem, _, date = p.name.partition("@")
        if stem == base and date.startswith(wanted.replace("-", "")) and (p / "manifest").exists():
            found.append((date, p.name))
    if not found:
        raise FileNotFoundError(f"{name} is not in {library}")
    return str(Path(library) / max(found)[1])


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="conceptmill", description=__doc__)
    parser.add_argument("--config")
    parser.add_argument("--library")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, args in {"import": ["archive", "index"], "add-refsets": ["base", "archive", "index"], "inspect": ["archive"], "verify": ["index"], "stats": ["index"], "list": [], "expand": ["index", "ecl"], "search": ["index", "text"], "lookup": ["index", "concept"], "history": ["index", "concept"], "hierarchy": ["index", "operator", "concept"], "diff": ["old", "new", "ecl"], "batch": ["index"]}.items():
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a)
        if name == "expand":
            p.add_argument("--display", action="store_true")
            p.add_argument("--count", action="store_true")
            p.add_argument("--offset", type=int, default=0)
            p.add_argument("--limit", type=int)
        if name in ("import", "add-refsets"):
            p.add_argument("--sha256")
        if name == "import":
            p.add_argument("--edition")
        if name == "add-refsets":
            p.add_argument("--date", type=int, required=True)
        if name == "batch":
            p.add_argument("--workers", type=int, default=1)
            p.add_argument("--seconds", type=float)
    a = parser.parse_args(argv)
    show = lambda x: print(json.dumps(x, ensure_ascii=False, default=str))
    if a.command == "inspect":
        show(vars(snapshot.inspect(a.archive)))
        return 0
    if a.command == "list":
        for p in sorted(Path(a.library or ".").iterdir()):
            if (p / "manifest").exists():
                print(p.name)
        return 0
    spark = local_session()
    config = Config.load(a.config) if a.config else Config()
    engine = lambda name: Engine(load(spark, resolve(name, a.library), config))
    try:
        if a.command in ("import", "add-refsets"):
            base = load(spark, resolve(a.base, a.library), config) if a.command == "add-refsets" else None
            options = {"edition": a.edition} if a.command == "import" else {"expected_date": a.date, "base": base}
            made = snapshot.import_snapshot(spark, a.archive, config=config, expected_checksum=a.sha256, progress=lambda s: print(s, file=sys.stderr), **options)
            if base is not None:
                made = snapshot.add_refsets(base, made)
            save(made, a.index)
            show(made.manifest)
        elif a.command == "verify":
            bad = verify(engine(a.index).c)
            show(bad)
            return 1 if any(bad.values()) else 0
        elif a.command == "stats":
            show(engine(a.index).c.manifest)
        elif a.command == "diff":
            for r in diff(a.ecl, engine(a.old), engine(a.new)).filter("change <> 'unchanged'").orderBy("concept_id").toLocalIterator():
                print(f"{r['change']}\t{r['concept_id']}")
        elif a.command == "batch":
            for line in batches.batch(engine(a.index), sys.stdin, a.workers, a.seconds):
                print(line, flush=True)
        else:
            request = {
                "expand": lambda: {"ecl": a.ecl, "count_only": a.count, "display": a.display, "offset": a.offset, "limit": a.limit},
                "search": lambda: {"search": a.text},
                "lookup": lambda: {"concept": a.concept},
                "history": lambda: {"history": a.concept},
                "hierarchy": lambda: {"ecl": f"({OPERATORS[a.operator]} {a.concept}) {{{{ C active = 1 }}}}", "display": True},
            }[a.command]()
            response = batches.answer(engine(a.index), request)
            show(response)
            if a.command == "expand" and "offset" in response.get("error", {}):
                print(ParseError(**response["error"]).caret(a.ecl), file=sys.stderr)
            return 1 if "error" in response else 0
    except (EclError, snapshot.ImportFailure, OSError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
