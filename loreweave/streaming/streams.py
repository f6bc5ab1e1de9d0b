"""Stateful behaviour over live events."""

from __future__ import annotations

import itertools
import json
import zlib
from collections import OrderedDict, deque
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as tx
from ..sources.graph_store import GraphStore


def dedupe_events(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each (project_id, id) once within the watermark on ts."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["project_id", "id"])


def windowed_activity(events: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Counts per tumbling window and tool; works on a batch as on a stream."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    sums = rows.groupBy(F.window("ts", width), "tool_name").agg(F.count("*").alias("n"))
    return sums.select(F.col("window.start").alias("window_start"), "tool_name", "n")


def session_windows(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    sums = rows.groupBy(F.session_window("ts", gap), "session_id").agg(F.count("*").alias("n"))
    return sums.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "session_id", "n")


def _by_project(events: DataFrame, columns: list[str], schema: str, step: Callable[[Any, pd.DataFrame | None, GroupState], tuple[Any, list[tuple]]], timers: bool = False) -> DataFrame:
    """Runs step(held state or None, events in order of seq or None on a timeout, state) -> (state to hold or None, rows) per project.

    What is held is one JSON text a project, of a size that the step bounds. With timers, timeouts of processing time are on, and a query
    runs on until it is stopped; without, it can end when there is no more to read.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else None
        rows = None if timers and state.hasTimedOut else pd.concat(list(parts)).sort_values(["seq", "id"])
        held, out = step(held, rows, state)
        if held is None:
            state.remove()
        else:
            state.update((json.dumps(held),))
        yield pd.DataFrame([(*key, *r) for r in out], columns=["project_id", *names])

    rows = events.select("project_id", *columns)
    return rows.groupBy("project_id").applyInPandasWithState(run, f"project_id string, {schema}", "held string", "append", GroupStateTimeout.ProcessingTimeTimeout if timers else GroupStateTimeout.NoTimeout)


class _Keyed(StatefulProcessor):
    """A processor of one project's rows in their order, with its state in parts that are read and written one by one."""

    columns: tuple[str, ...] = ()
    order: tuple[str, ...] = ("seq", "id")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def step(self, rows: pd.DataFrame) -> list[tuple]:
        """Rows to give out, without the key."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        # What a trigger's tasks kept of a project; the source's limits bound it.
        events = pd.concat([part[list(self.columns)] for part in rows]).sort_values(list(self.order), kind="stable")
        yield pd.DataFrame([(*key, *r) for r in self.step(events)], columns=[*self.key, *self.names])

    def close(self) -> None:
        pass


def _stateful(rows: DataFrame, processor: _Keyed, schema: str, key: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """Runs the processor per key; its state lives in RocksDB, of which a trigger reads what it touches."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    processor.key, processor.names = key, [c.split()[0] for c in schema.split(", ")]
    return rows.select(*key, *processor.columns).groupBy(*key).transformWithStateInPandas(processor, ", ".join([*(f"{k} string" for k in key), schema]), "Append", "None")


def _folded(rows: DataFrame, fold: Callable[[pd.DataFrame], pd.DataFrame], schema: str, most: int = 50_000) -> DataFrame:
    """What fold keeps of each task's rows, before they meet in one place; fold(fold(a) + b) must be fold(a + b)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for part in parts:
            held.append(part)
            if sum(map(len, held)) > most + 2 * len(held[0]):
                held = [fold(pd.concat(held))]
        if held:
            yield fold(pd.concat(held))

    return rows.mapInPandas(run, schema)


_PACKED = "sessions array<string>, codes binary, seqs binary, ids binary"


def _packed(rows: DataFrame, most: int = 50_000) -> DataFrame:
    """(project_id, session_id, id, seq) as a row for up to `most` events of a project: the sessions once, and the events in a few bytes each."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for part in itertools.chain(parts, [None]):
            if part is not None:
                held.append(part)
            if held and (part is None or sum(map(len, held)) >= most):
                out = []
                for project, own in pd.concat(held).groupby("project_id", dropna=False, sort=False):
                    own = own.sort_values("seq", kind="stable")
                    codes, sessions = pd.factorize(own["session_id"], use_na_sentinel=False)
                    steps = np.diff(own["seq"].to_numpy(np.int64), prepend=0)
                    ids = "\0".join("" if i is None else i for i in own["id"])
                    out.append((project, list(sessions), *(zlib.compress(b, 1) for b in (codes.astype(np.int32).tobytes(), steps.tobytes(), ids.encode()))))
                held = []
                yield pd.DataFrame(out, columns=["project_id", *(c.split()[0] for c in _PACKED.split(", "))])

    return rows.select("project_id", "session_id", "id", "seq").mapInPandas(run, f"project_id string, {_PACKED}")


class _LastActive(_Keyed):
    """Tells which of a project's sessions are pushed out, and when: only the `sessions` that were active last stay. A row a session that was active
    or pushed out in the trigger, with the seq of the project's last event and the events that pushed it out."""

    columns = ("sessions", "codes", "seqs", "ids")

    def __init__(self, sessions: int):
        self.sessions = sessions

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("order", "sessions array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        blocks = [r for part in rows for r in part[list(self.columns)].itertuples(index=False)]
        yield pd.DataFrame([(*key, *r) for r in self.pushed(blocks)], columns=[*self.key, *self.names])

    def pushed(self, blocks: list[Any]) -> list[tuple]:
        held = list(self.last.get()[0]) if self.last.exists() else []
        number = {s: i for i, s in enumerate(held)}
        codes = np.concatenate([np.array([number.setdefault(s, len(number)) for s in b.sessions], np.int32)[np.frombuffer(zlib.decompress(b.codes), np.int32)] for b in blocks])
        seqs = np.concatenate([np.frombuffer(zlib.decompress(b.seqs), np.int64).cumsum() for b in blocks])
        order = np.argsort(seqs, kind="stable")
        told = len(number) > self.sessions  # ids are read only where they matter
        if told or (np.diff(seqs[order]) == 0).any():
            ids = np.array([i for b in blocks for i in zlib.decompress(b.ids).decode().split("\0")], object)
            order = np.lexsort((pd.factorize(ids, sort=True)[0], seqs))
        names, at, gone = list(number), int(seqs[order[-1]]), {}
        if told:
            now = OrderedDict.fromkeys(range(len(held)))
            for place in order.tolist():
                code = int(codes[place])
                now.pop(code, 0)
                now[code] = None
                if len(now) > self.sessions:
                    gone.setdefault(now.popitem(last=False)[0], []).append({"seq": int(seqs[place]), "id": ids[place]})
            stay = list(now)
        else:
            final = np.full(len(names), -1, np.int64)
            final[codes[order]] = np.arange(len(order))  # of equal ones the last is kept
            stay = [i for i in range(len(held)) if final[i] < 0] + [i for i in np.argsort(final, kind="stable").tolist() if final[i] >= 0]
        self.last.update(([names[i] for i in stay],))
        return [(names[i], at, gone.get(i, [])) for i in sorted({*np.unique(codes).tolist(), *gone})]


class _Recent(_Keyed):
    """Holds something for a session, until it is pushed out."""

    def __init__(self, keep: int):
        self.keep = keep

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", self.kept)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        events, at = [], 0
        for part in rows:
            for r in part[list(self.columns)].itertuples(index=False):
                if r.gone is None:
                    events.append((r.seq, r.id or "", r))
                else:
                    at = int(r.at)
                    events += [(x["seq"], x["id"], None) for x in r.gone]
        events.sort(key=lambda e: e[:2])
        found = self.held.get() if self.held.exists() else None
        held, out = self.begin(found), []
        for seq, _, r in events:
            if r is None:
                self.pushed_out(held, seq, out)
                held = None
            else:
                held = held or self.begin(None)
                self.event(held, r, out)
        if held is not None:
            self.held.update(self.end(held))
        elif found is not None:
            self.held.clear()
        yield pd.DataFrame([(*key, *r) for r in self.after(held, at, out)], columns=[*self.key, *self.names])

    def begin(self, found: Any) -> Any:
        raise NotImplementedError

    def end(self, held: Any) -> tuple:
        raise NotImplementedError

    def event(self, held: Any, r: Any, out: list[tuple]) -> None:
        raise NotImplementedError

    def pushed_out(self, held: Any, seq: int, out: list[tuple]) -> None:
        pass

    def after(self, held: Any, at: int, out: list[tuple]) -> list[tuple]:
        return out


def _recent(rows: DataFrame, processor: _Recent, sessions: int, schema: str) -> DataFrame:
    """Runs the processor per session of a project. What is one place for a project is only which sessions were active last; events go to their sessions."""
    pushed = _stateful(_packed(rows), _LastActive(sessions), "session_id string, at long, gone array<struct<seq:long,id:string>>")
    own = [c for c in processor.columns if c not in ("at", "gone")]
    both = rows.select("project_id", "session_id", *own).unionByName(pushed, allowMissingColumns=True)
    return _stateful(both, processor, schema, ("project_id", "session_id"))


class _Open:
    """Open warnings in their order, the last `keep`, found by file."""

    def __init__(self, keep: int, found: Any):
        self.keep, self.n, self.held, self.by_file = keep, 0, OrderedDict(), {}
        for i, files in found:
            self.add(i, list(files))

    def add(self, i: str, files: list[str]) -> None:
        self.held[self.n] = (i, files)
        for f in files:
            self.by_file.setdefault(f, set()).add(self.n)
        self.n += 1
        if len(self.held) > self.keep:
            self._drop(next(iter(self.held)))

    def _drop(self, n: int) -> str:
        i, files = self.held.pop(n)
        for f in files:
            self.by_file[f].discard(n)
        return i

    def touched(self, files: set[str]) -> list[str]:
        """Those of any of the files, which are open no more."""
        return [self._drop(n) for n in sorted(set().union(*(self.by_file.get(f, ()) for f in files)))]


class _Warnings(_Recent):
    columns = ("id", "seq", "kind", "passed", "files", "at", "gone")
    kept = "edits array<struct<id:string,files:array<string>>>, checks array<struct<id:string,files:array<string>>>"

    def begin(self, found: Any) -> tuple[_Open, _Open]:
        edits, checks = found or ([], [])
        return _Open(self.keep, edits), _Open(self.keep, checks)

    def end(self, held: tuple[_Open, _Open]) -> tuple:
        return tuple(list(x.held.values()) for x in held)

    def event(self, held: tuple[_Open, _Open], r: Any, out: list[tuple]) -> None:
        (edits, checks), files, seq = held, set(r.files), int(r.seq)
        if r.kind == "Write":
            out += [(i, "failing", "clear", seq) for i in checks.touched(files)]
            if files:
                edits.add(r.id, sorted(files))
                out.append((r.id, "unverified", "raise", seq))
        else:
            out += [(i, "unverified", "clear", seq) for i in edits.touched(files)]
            if r.passed:
                out += [(i, "failing", "clear", seq) for i in checks.touched(files)]
            else:
                checks.add(r.id, sorted(files))
                out.append((r.id, "failing", "raise", seq))

    def pushed_out(self, held: tuple[_Open, _Open], seq: int, out: list[tuple]) -> None:
        out += [(i, kind, "clear", seq) for kind, x in zip(("unverified", "failing"), held) for i, _ in x.held.values()]


def debt_warnings(events: DataFrame, keep: int = 100, sessions: int = 16) -> DataFrame:
    """Rows that raise and clear warnings per session as tool events arrive: an edit is unverified until a check touches one
    of its files, a failed check stands until an edit touches one of its. State: the last `keep` open ones of each, of the `sessions` that wrote
    or checked last in a project; a session that is pushed out has its warnings cleared."""
    rows = events.withColumn("kind", tx.tool_class(F.col("tool_name"), F.col("text"))).withColumn("passed", tx.check_passed(F.col("text"))).where("kind <> 'Read'")
    return _recent(rows, _Warnings(keep), sessions, "event_id string, warning string, action string, seq long")


class _Scratch(_Recent):
    columns = ("id", "seq", "kind", "at", "gone")
    kept = "edits array<string>, checks array<string>"

    def begin(self, found: Any) -> tuple[deque, deque]:
        return tuple(deque(x, self.keep) for x in found or ([], []))

    def end(self, held: tuple[deque, deque]) -> tuple:
        return tuple(list(x) for x in held)

    def event(self, held: tuple[deque, deque], r: Any, out: list[tuple]) -> None:
        held[r.kind != "Write"].append(r.id)

    def after(self, held: Any, at: int, out: list[tuple]) -> list[tuple]:
        return [(at, True, [], []) if held is None else (at, False, *self.end(held))]


def stream_scratch(events: DataFrame, keep: int = 100, sessions: int = 16) -> DataFrame:
    """Each session's last `keep` edits and checks as tool events arrive, of the `sessions` that wrote or checked last in a project.

    A row (session_id, at, evicted, edits, checks) a session and trigger in which it changed, with the ids it holds, oldest first; at is the
    seq of the project's last event. A session pushed out has a row with evicted and nothing held, and starts anew when it comes again.
    """
    rows = events.withColumn("kind", tx.tool_class(F.col("tool_name"), F.col("text"))).where("kind <> 'Read'")
    return _recent(rows, _Scratch(keep), sessions, "at long, evicted boolean, edits array<string>, checks array<string>")


def stream_extraction_batches(events: DataFrame, most: int = 10, wait_ms: int = 15_000) -> DataFrame:
    """(project_id, batch, ids) of batches as they close: at `most` events, or wait_ms of processing time after the first one arrived."""

    def step(held: Any, pdf: pd.DataFrame | None, state: GroupState) -> tuple[Any, list[tuple]]:
        held = held or {"batch": 0, "open": [], "until": 0}
        out = []
        if pdf is None:
            out.append((held["batch"], held["open"]))
            held = {"batch": held["batch"] + 1, "open": [], "until": 0}
        else:
            for i in pdf["id"]:
                if not held["open"]:
                    held["until"] = state.getCurrentProcessingTimeMs() + wait_ms
                held["open"].append(i)
                if len(held["open"]) == most:
                    out.append((held["batch"], held["open"]))
                    held = {"batch": held["batch"] + 1, "open": [], "until": 0}
        if held["open"]:
            state.setTimeoutDuration(max(1, held["until"] - state.getCurrentProcessingTimeMs()))
        return held, out

    return _by_project(events, ["id", "seq"], "batch long, ids array<string>", step, timers=True)


class _EventLog(_Keyed):
    columns = ("id", "seq")

    def __init__(self, most: int):
        self.most = most

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getListState("log", "id string")

    def step(self, rows: pd.DataFrame) -> list[tuple]:
        fresh = rows["id"].tolist()[-self.most :]
        held = [] if len(fresh) == self.most else [x[0] for x in self.log.get()]
        held = [*held, *fresh][-self.most :]
        self.log.put([(i,) for i in held])
        return [(int(rows["seq"].max()), held)]


def stream_event_log(events: DataFrame, most: int = 20) -> DataFrame:
    """(project_id, at, ids): the last `most` events of a project, oldest first, each time it had new ones; at is the last one's seq. Each task
    of a trigger sends on only its own last `most`."""
    last = lambda rows: rows.sort_values(["seq", "id"], kind="stable").groupby("project_id", dropna=False, sort=False).tail(most)
    rows = _folded(events.select("project_id", "id", "seq"), last, "project_id string, id string, seq long")
    return _stateful(rows, _EventLog(most), "at long, ids array<string>")


_SEEN = ["first_seq", "first_id", "last_seq", "last_id"]


def _seen(rows: pd.DataFrame) -> pd.DataFrame:
    """A row a session, with its first and last event."""
    by = rows.groupby(["project_id", "session_id"], dropna=False, sort=False)
    if by.ngroups == len(rows):
        return rows
    first, last = (rows.sort_values(_SEEN[k : k + 2], kind="stable") for k in (0, 2))
    keys = ["project_id", "session_id"]
    return first.drop_duplicates(keys)[[*keys, *_SEEN[:2]]].merge(last.drop_duplicates(keys, keep="last")[[*keys, *_SEEN[2:]]], on=keys)


class _Sessions(_Keyed):
    columns = ("session_id", *_SEEN)
    order = ("first_seq", "first_id")
    parts = 1024

    def __init__(self, keep: int):
        self.keep = keep

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "numbered long, held long")
        self.known = handle.getMapState("known", "part int", "sessions array<string>, indexes array<long>, seen array<long>")

    def _part(self, session: str) -> int:
        return zlib.crc32((session or "").encode()) % self.parts

    def step(self, rows: pd.DataFrame) -> list[tuple]:
        numbered, held = self.counts.get() if self.counts.exists() else (0, 0)
        rows = _seen(rows.assign(project_id="")).sort_values(list(self.order), kind="stable")
        at, out, index = int(rows["last_seq"].max()), [], {}
        of_part = rows["session_id"].map(self._part).tolist()
        known = {k: {s: (i, seen) for s, i, seen in zip(*self.known.getValue((k,)))} if held and self.known.containsKey((k,)) else {} for k in set(of_part)}
        for s, last, k in zip(rows["session_id"].tolist(), rows["last_seq"].tolist(), of_part):
            if s in known[k]:
                index[s] = known[k][s][0]
            else:
                index[s], numbered, held = numbered, numbered + 1, held + 1
                out.append((s, index[s], at, False))
            known[k][s] = (index[s], last)
        if held > self.keep + self.keep // 4:  # now and then the sessions seen longest ago are forgotten
            stored = {key[0]: {s: (i, seen) for s, i, seen in zip(*value)} for key, value in self.known.iterator()}
            known = stored | known
            by_age = sorted(((seen, i, s) for own in known.values() for s, (i, seen) in own.items()), reverse=True)
            for _, _, s in by_age[self.keep :]:
                del known[self._part(s)][s]
            held = self.keep
        for k, own in known.items():
            self.known.updateValue((k,), (list(own), [i for i, _ in own.values()], [seen for _, seen in own.values()]))
        self.counts.update((numbered, held))
        current = rows.sort_values(_SEEN[2:], kind="stable")["session_id"].iloc[-1]
        return out + [(current, index[current], at, True)]


def stream_sessions(events: DataFrame, keep: int = 10_000) -> DataFrame:
    """(project_id, session_id, session_index, at, current): a row for each session that is new, and one for the current session, seen last,
    in each trigger; sessions are numbered from 0 in the order in which they were first seen. Each task of a trigger sends on a row a session. State: the
    `keep` sessions seen last, up to a quarter more between clearings; one that was forgotten and comes again is new, with the next number."""
    rows = events.select("project_id", "session_id", F.col("seq").alias("first_seq"), F.col("id").alias("first_id"), F.col("seq").alias("last_seq"), F.col("id").alias("last_id"))
    rows = _folded(rows, _seen, "project_id string, session_id string, first_seq long, first_id string, last_seq long, last_id string")
    return _stateful(rows, _Sessions(keep), "session_id string, session_index long, at long, current boolean")


class BatchCounts:
    """What a stream took in, counted by observe() on the way into its sink: no state in the query and no pass over the rows of its own.

    Give `into(each)` to foreachBatch; each must write the batch. Nothing is dropped: the source is held back by its limits a trigger. late
    counts events whose end_time lies more than late_s before the latest one of earlier batches. A batch that comes again is counted
    once. After a restart, go on with the counts and the latest time that `totals()` gave: BatchCounts(late_s, **those).
    """

    def __init__(self, late_s: float = 3600.0, batch: int = -1, ingested: int = 0, tool_events: int = 0, queued: int = 0, late: int = 0, latest: float | None = None):
        self.late_s = late_s
        self._held = {"batch": batch, "ingested": ingested, "tool_events": tool_events, "queued": queued, "late": late, "latest": latest}

    def totals(self) -> dict:
        return dict(self._held)

    def into(self, each: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        def counted(batch: DataFrame, number: int) -> None:
            if number <= self._held["batch"]:
                return each(batch, number)
            seen, tool, latest = Observation(), F.coalesce(F.col("event_kind") == "tool_call", F.lit(False)), self._held["latest"]
            late = F.lit(False) if latest is None else F.col("end_time") < F.lit(latest - self.late_s)
            each(
                batch.observe(
                    seen, F.count(F.lit(1)).alias("ingested"), F.count(F.when(tool, 1)).alias("tool_events"), F.count(F.when(~tool, 1)).alias("queued"),
                    F.count(F.when(late, 1)).alias("late"), F.max("end_time").alias("latest"),
                ), number,
            )
            found = seen.get
            top = [x for x in (latest, found.pop("latest")) if x is not None]
            self._held = {"batch": number, **{k: self._held[k] + v for k, v in found.items()}, "latest": max(top, default=None)}

        return counted


class ObservedMetrics(StreamingQueryListener):
    """Sums of what observe_metrics() saw in streaming queries, by the query's name (else its id). A batch that comes again is counted once."""

    def __init__(self) -> None:
        self.totals: dict[str, dict[str, int]] = {}
        self._last: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        at = event.progress
        row = at.observedMetrics.get("pipeline_metrics")
        if row is None or self._last.get(key := str(at.id), -1) >= at.batchId:
            return
        self._last[key] = at.batchId
        own = self.totals.setdefault(at.name or key, {})
        for name, n in row.asDict().items():
            own[name] = own.get(name, 0) + (n or 0)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def observe_metrics(events: DataFrame) -> DataFrame:
    """The same events; ObservedMetrics, added to spark.streams, sums their counters as they pass: events, tool calls, queued prose."""
    tool = F.coalesce(F.col("event_kind") == "tool_call", F.lit(False))
    return events.observe("pipeline_metrics", F.count(F.lit(1)).alias("events"), F.count(F.when(tool, 1)).alias("tool_events"), F.count(F.when(~tool, 1)).alias("queued"))


def community_refresh(read: Callable[[], tuple[DataFrame, DataFrame]], refresh: Callable[[DataFrame, DataFrame], None], every: int = 5, small: int = 10) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: communities are computed anew in every `every`-th batch, from the first on, and in each while the graph has less
    than `small` nodes. read gives (nodes, edges) as stored, refresh takes them."""

    def commit(_: DataFrame, number: int) -> None:
        nodes, edges = read()
        if number % every == 0 or nodes.limit(small).count() < small:
            refresh(nodes, edges)

    return commit


def upsert_graph(store: GraphStore, stream: str = "graph") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over (kind, node and edge columns): all new nodes of a batch and then its edges, in one commit; a batch that comes
    again, after a stop at any point, adds nothing twice and leaves nothing half."""

    def commit(batch: DataFrame, number: int) -> None:
        nodes = batch.where("kind = 'node'").select("project_id", "id", "node_type", "label", "seq")
        store.commit(stream, number, nodes, batch.where("kind = 'edge'").select("project_id", "id", "edge_type", "source_node_id", "target_node_id", "seq"))

    return commit
