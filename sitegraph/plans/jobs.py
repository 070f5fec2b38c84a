"""One crawl as one job that can be run again: a payload that is checked, a run that resumes, a summary."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.html.kernel import ExtractOptions
from sitegraph.operators import archive as A
from sitegraph.operators.policy import Scope
from sitegraph.plans.crawl import Options, SiteWalk, State, Stats
from sitegraph.plans.persist import Site
from sitegraph.url.kernel import NormalizeOptions

TERMINAL = ("completed", "stopped")
KNOWN = {
    "strategy": str, "batch": int, "concurrency": int, "max_depth": int, "max_pages": int, "max_duration": (int, float), "max_total_bytes": int, "max_queued": int, "respect_robots": bool,
    "sitemaps": bool, "user_agent": str, "robots_max": int, "traps": bool, "max_segment_repeat": int, "max_path_depth": int, "max_query_params": int, "max_urls_per_path": int,
    "soft_dup_threshold": int, "follow_canonical": bool, "recrawl": bool, "progress_interval": (int, float),
}
NESTED = {"scope": Scope, "extract": ExtractOptions, "normalize": NormalizeOptions}


@dataclass
class Job:
    uid: str
    seeds: list[str]
    options: dict = field(default_factory=dict)
    crawl_uid: str | None = None


def _group(name: str, value: dict, warn: Callable[[str], None]) -> dict:
    """The options of a group, each of the kind of its default; lists stand for tuples."""
    if not isinstance(value, dict):
        raise TypeError(f"option {name} has the wrong type")
    known, out = {f.name: f.default for f in fields(NESTED[name])}, {}
    for key, v in value.items():
        if key not in known or callable(known[key]):
            warn(f"unknown option {name}.{key}")
            continue
        v = tuple(v) if isinstance(v, list) else v
        kind = type(known[key])
        if not isinstance(v, kind) or kind is int and isinstance(v, bool) or kind is tuple and not all(isinstance(x, str) for x in v):
            raise TypeError(f"option {name}.{key} has the wrong type")
        out[key] = v
    return out


def checked(options: dict, warn: Callable[[str], None] = print) -> dict:
    """A payload's options: unknown names are told and dropped, wrong types refused."""
    out = {}
    for name, value in options.items():
        if name in NESTED:
            out[name] = _group(name, value, warn)
        elif name not in KNOWN:
            warn(f"unknown option {name}")
        elif not isinstance(value, KNOWN[name]) or isinstance(value, bool) and KNOWN[name] is not bool:
            raise TypeError(f"option {name} has the wrong type")
        else:
            out[name] = value
    return out


def built(options: dict, warn: Callable[[str], None] = print) -> Options:
    """Options from a payload's names and values; an order by priority without a function is breadth first."""
    options = {k: NESTED[k](**v) if k in NESTED and isinstance(v, dict) else v for k, v in options.items()}
    if options.get("strategy") == "priority" and options.get("priority") is None:
        warn("strategy priority needs a function; breadth first instead")
        options["strategy"] = "bfs"
    return Options(**options)


def start_job(seeds: list[str] | str, options: dict | None = None, uid: str | None = None, warn: Callable[[str], None] = print, crawl_uid: str | None = None) -> Job:
    """A job for a queue; seeds and options are checked at once. crawl_uid: a run that is there and is to go on."""
    seeds = [seeds] if isinstance(seeds, str) else list(seeds)
    if not seeds or not all(isinstance(s, str) and s.strip() for s in seeds):
        raise TypeError("a job needs seeds")
    return Job(uid or uuid.uuid4().hex, seeds, checked(options or {}, warn), crawl_uid)


class Handler:
    """Runs jobs against a corpus, with their state in a store; the payload's options win over the defaults.

    A job that ended gives its stored summary without a fetch. One that died goes on where its last finished round left it:
    rows in flight are pending again and pages done aren't fetched again. A round adds its parts in one commit; a run that
    ends is saved whole, with the archive.
    """

    def __init__(self, spark: SparkSession, corpus: DataFrame, store: A.Store, defaults: dict | None = None, warn: Callable[[str], None] = print, persist_body=None) -> None:
        self.spark, self.corpus, self.store, self.defaults, self.warn, self.persist_body = spark, corpus, store, defaults or {}, warn, persist_body
        self.site, self.walk = Site(spark, store), None

    def crawls(self) -> DataFrame:
        return self.site.table("crawl")

    def _summary(self, row: dict, resumed: bool) -> dict:
        stats = {k: v for k, v in json.loads(row["stats"] or "{}").items() if k not in ("by_host", "places")}
        return {**stats, "uid": row["uid"], "stopped_by": row["stopped_by"], "attempt": row["attempt"], "resumed": resumed}

    def run(self, job: Job, fail_after: int | None = None) -> dict:
        """The summary of the crawl. fail_after: for tests, the round after which the run breaks off."""
        uid = job.crawl_uid or job.uid
        row = self.site.crawl(uid)
        if row is None and job.crawl_uid is not None:
            raise KeyError(f"no crawl {uid}")
        if row is not None and row["status"] in TERMINAL:
            return self._summary(row, False)
        options = {**self.defaults, **job.options}
        if not any(options.get(k) for k in ("max_pages", "max_depth", "max_duration", "max_total_bytes")):
            self.warn("the job has no budget")
        resumed = row is not None
        row = row or self.site.create(uid, job.seeds, job.options, job.uid)
        archive = self.site.table("archive") if options.get("recrawl") else None
        self.walk = walk = SiteWalk(self.spark, self.corpus, built(options, self.warn), archive)
        state = walk.start(job.seeds)
        if self.store.has(f"run_queued_{uid}"):
            base = json.loads(row["stats"] or "{}")
            tables = {k: self.store.read(f"run_{k}_{uid}") for k in State.TABLES if self.store.has(f"run_{k}_{uid}")}
            tables["queued"] = A.recover(tables["queued"])
            places = base.get("places", {})
            state = State(self.spark, places.get("seq", 0), places.get("links", 0), places.get("done", 0), **tables)
            walk.stats = Stats(walk.o.max_pages, base)
        now = self.spark.range(1).select(F.current_timestamp().alias("t")).head()["t"]
        row = {**row, "status": "running", "attempt": (row["attempt"] or 0) + 1, "error": None, "started_at": now}
        first = {} if self.store.has(f"run_queued_{uid}") else {f"run_queued_{uid}": state.queued.read()}
        self.site.write(row, first)
        why = "completed"

        def stats() -> str:
            return json.dumps({**walk.stats.snapshot(state.waiting), "places": {"seq": state.seq, "links": state.link_seq, "done": state.done}})

        try:
            for n, (why, pages) in enumerate(walk.rounds(state)):
                if pages is None:
                    break
                row["stats"] = stats()
                self.site.write(row, {f"run_{k}_{uid}": p.last for k in State.TABLES if (p := getattr(state, k)).last is not None})
                if fail_after is not None and n + 1 >= fail_after:
                    raise RuntimeError("broken off")
        except Exception as e:
            self.site.write({**row, "status": "failed", "error": str(e)[:500]})
            raise
        ended = self.spark.range(1).select(F.current_timestamp().alias("t")).head()["t"]
        row = {**row, "status": "completed" if why not in ("stop", "abort") else "stopped", "stopped_by": why, "stats": stats(), "ended_at": ended}
        if state.pages.count:
            self.site.save(row, state.pages.read(), state.links.read(), state.frontier, self.persist_body)
        else:
            self.site.write(row)
        return self._summary(row, resumed)

    def _optional(self, name: str) -> DataFrame | None:
        return self.store.read(name) if self.store.has(name) else None

    def pages(self, uid: str) -> DataFrame | None:
        return self._optional(f"run_pages_{uid}")

    def links(self, uid: str) -> DataFrame | None:
        return self._optional(f"run_links_{uid}")
