"""Answer request dictionaries, one at a time or from JSON lines."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor, as_completed

from pyspark.sql import functions as F

from . import __version__
from .ecl import EclError, ParseError
from .ecl.tree import MissingReference
from .engine import Engine
from .sources.sinks import KIND_NAMES

MAX_LINE = 512 * 1024
ASKED = {"ecl", "search", "concept", "history", "manifest"}
KNOWN = ASKED | {"id", "within", "count_only", "display", "offset", "limit", "include_inactive"}


def answer(engine: Engine, request: dict) -> dict:
    """The response to one request; errors are part of it, and ``id`` is echoed first."""
    started = time.perf_counter()
    out: dict = {"id": request.get("id")} if isinstance(request, dict) else {"id": None}
    try:
        if not isinstance(request, dict):
            raise ValueError("a request is an object")
        if unknown := set(request) - KNOWN:
            raise ValueError(f"unknown fields: {', '.join(sorted(unknown))}")
        asked = ASKED & set(request)
        if len(asked) != 1:
            raise ValueError("a request asks for exactly one of " + ", ".join(sorted(ASKED)))
        out |= {"manifest": _manifest, "concept": _concept, "history": _history, "search": _search, "ecl": _ecl}[asked.pop()](engine, request)
    except ParseError as e:
        out["error"] = {"kind": e.kind, "offset": e.offset, "message": e.message}
    except (EclError, ValueError) as e:
        out["error"] = {"kind": type(e).__name__, "message": str(e)}
    out["milliseconds"] = round((time.perf_counter() - started) * 1000, 3)
    return out


def _provenance(engine: Engine) -> dict:
    """Which release, supplements and settings an answer is from."""
    m = engine.c.manifest
    return {"edition": m.get("edition"), "archive_sha256": m.get("archive_sha256"), "config_sha256": engine.c.config.fingerprint(), "supplements": [s.get("archive_sha256") for s in m.get("supplements", [])]}


def _manifest(engine: Engine, request: dict) -> dict:
    if set(request) - {"manifest", "id"}:
        raise ValueError("manifest stands alone")
    return {"engine": {"version": __version__}, "manifest": engine.c.manifest} | _provenance(engine)


def _concept(engine: Engine, request: dict) -> dict:
    return {"concept": engine.lookup(int(request["concept"]))}


def _history(engine: Engine, request: dict) -> dict:
    concept = int(request["history"])
    told = lambda df: [r.asDict() for r in engine.labelled(df.select("concept_id").distinct()).join(df, "concept_id").orderBy("refset", "concept_id").collect()]
    own = engine.labelled(engine.c.concept.filter(F.col("concept_id") == concept).select("concept_id")).first()
    if own is None:
        raise MissingReference(f"{concept} is no concept of the edition")
    return {"concept": concept, "display": own["display"], "active": own["active"], "successors": told(engine.successors(concept)), "predecessors": told(engine.predecessors(concept))}


def _search(engine: Engine, request: dict) -> dict:
    found = engine.search(request["search"], request.get("within"), int(request.get("limit", 50)), bool(request.get("include_inactive", False)))
    total = engine.search_candidates(request["search"], request.get("within"), bool(request.get("include_inactive", False))).count()
    return {"total": total, "concepts": [r.asDict() for r in found.collect()]}


def _ecl(engine: Engine, request: dict) -> dict:
    result = engine.evaluate(request["ecl"])
    offset, limit = int(request.get("offset") or 0), request.get("limit")
    limit = None if limit is None else int(limit)
    if offset < 0 or (limit or 0) < 0:
        raise ValueError("offset and limit are not negative")
    out = _provenance(engine) | {"result_type": result.kind, "total": result.df.count()} | ({} if request.get("count_only") else {"offset": offset})
    if request.get("count_only"):
        return out
    page = result.window(offset, limit)
    if result.kind == "values":
        return out | {"values": [{"type": KIND_NAMES[r["kind"]], "value": r["text"]} for r in page.collect()]}
    if result.kind == "rows":
        return out | {"rows": [r.asDict() for r in page.collect()]}
    if request.get("display"):
        return out | {"concepts": [r.asDict() for r in engine.labelled(page).orderBy("concept_id").collect()]}
    return out | {"codes": [r[0] for r in page.collect()]}


def answer_line(engine: Engine, line: str) -> str:
    if len(line.encode("utf-8", "surrogatepass")) > MAX_LINE:
        return json.dumps({"id": None, "error": {"kind": "Limit", "message": f"a line is longer than {MAX_LINE} bytes"}})
    try:
        request = json.loads(line)
    except json.JSONDecodeError as e:
        return json.dumps({"id": None, "error": {"kind": "Syntax", "message": str(e)}})
    return json.dumps(answer(engine, request), ensure_ascii=False, default=str)


def _id_of(line: str):
    try:
        request = json.loads(line)
    except json.JSONDecodeError:
        return None
    return request.get("id") if isinstance(request, dict) else None


def batch(engine: Engine, lines: Iterable[str], workers: int = 1, seconds: float | None = None) -> Iterator[str]:
    """Responses to JSON lines; with several workers as they are done, to be matched by ``id``.

    With ``seconds`` a request whose jobs run longer is cancelled and answered with an error.
    """
    filled = (line for line in lines if line.strip())

    def one(line: str) -> str:
        if seconds is None:
            return answer_line(engine, line)
        try:
            return with_timeout(engine, seconds, lambda: answer_line(engine, line))
        except TimeoutError as e:
            return json.dumps({"id": _id_of(line), "error": {"kind": "Cancelled", "message": str(e)}})

    if workers <= 1:
        for line in filled:
            yield one(line)
        return
    with ThreadPoolExecutor(workers) as pool:
        for done in as_completed([pool.submit(one, line) for line in filled]):
            yield done.result()


def with_timeout(engine: Engine, seconds: float, work):
    """``work()``, whose Spark jobs are interrupted once the time is over; then TimeoutError."""
    spark, tag = engine.spark, f"conceptmill-{uuid.uuid4().hex}"
    done = threading.Event()

    def watch() -> None:  # a job may begin just after others were interrupted
        rest = seconds
        while not done.wait(rest):
            spark.interruptTag(tag)
            rest = 0.2

    spark.addTag(tag)
    began = time.monotonic()
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        result = work()
    except Exception as e:
        if time.monotonic() - began >= seconds:
            raise TimeoutError(f"no answer within {seconds} s") from e
        raise
    finally:
        done.set()
        watcher.join()
        spark.removeTag(tag)
    if time.monotonic() - began >= seconds:
        raise TimeoutError(f"no answer within {seconds} s")
    return result
