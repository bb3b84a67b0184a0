"""Keyed state machines for streams: running usage, recovery links, debouncing. Their state is typed columns in the state store, not text.

transformWithState needs the RocksDB state store, which ``keyed`` sets for the session.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLASSES = ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")
MAX_SAFE = (1 << 53) - 1


def keyed(stream: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, mode: str, time: str) -> DataFrame:
    """The processor over the stream's rows by key. ``time``: ProcessingTime, which timers and forgetting state need and with which a query always has a next batch, or None."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return stream.groupBy(*keys).transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode=mode, timeMode=time)


class UsageMeter(StatefulProcessor):
    """Usage by model of one session (ST2). Rows may come late: the ``held`` rows of highest ordinal are kept and counted anew when one comes before them."""

    def __init__(self, held: int, ttl_ms: int | None):
        self.bound, self.ttl = held, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        numbers = ", ".join(f"{{0}}{c} long" for c in CLASSES)
        self.base = handle.getValueState("base", "ordinal long, model string, beats long, invalid long, late long, late_tokens long, known boolean, " + numbers.format("c_"), self.ttl)
        self.sums = handle.getMapState("sums", "model string", numbers.format(""), self.ttl)
        self.rows = handle.getMapState("rows", "ordinal long", "model string, used boolean, known boolean, " + numbers.format("u_") + ", " + numbers.format("c_"), self.ttl)

    @staticmethod
    def _count(base: dict, sums: dict, rows: list[tuple]) -> None:
        """Take rows (ordinal, model, last, cumulative) in order, as the batch form does."""
        for ordinal, model, last, cumulative in rows:
            base["ordinal"] = ordinal
            if model is not None and model.strip():
                base["model"] = model
            if last is None:
                continue
            if all(not x for x in last[:-1]) and (last[-1] or 0) > 0:
                same = base["cumulative"] is not None and cumulative is not None and cumulative == base["cumulative"]
                base["beats" if same else "invalid"] += 1
            elif None in last or not all(0 <= x <= MAX_SAFE for x in last) or last[1] + last[2] > last[0] or last[5] != last[0] + last[3]:
                base["invalid"] += 1
            else:
                base["cumulative"] = cumulative if cumulative is not None else base["cumulative"]
                sums[base["model"]] = tuple(a + b for a, b in zip(sums.get(base["model"], (0,) * 6), last))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        base = {"ordinal": -1, "model": "unknown", "beats": 0, "invalid": 0, "late": 0, "late_tokens": 0, "cumulative": None}
        if self.base.exists():
            b = self.base.get()
            base = {"ordinal": b[0], "model": b[1], "beats": b[2], "invalid": b[3], "late": b[4], "late_tokens": b[5], "cumulative": tuple(b[7:13]) if b[6] else None}
        sums = {k[0]: tuple(v) for k, v in self.sums.iterator()}
        held = {k[0]: (k[0], v[0], tuple(v[3:9]) if v[1] else None, tuple(v[9:15]) if v[2] else None) for k, v in self.rows.iterator()}
        for r in rows:
            last = tuple(r["u_" + c] for c in CLASSES) if r["used"] else None
            cumulative = tuple(r["c_" + c] for c in CLASSES) if r["known"] else None
            if r["ordinal"] <= base["ordinal"] or r["ordinal"] in held:
                base["late"] += 1
                base["late_tokens"] += (last[-1] or 0) if last and r["ordinal"] not in held else 0
            else:
                held[r["ordinal"]] = (r["ordinal"], r["model"], last, cumulative)
        order = sorted(held.values(), key=lambda x: x[0])
        fold, keep = order[: max(0, len(order) - self.bound)], order[max(0, len(order) - self.bound) :]
        self._count(base, sums, fold)
        for r in fold:
            if self.rows.containsKey((r[0],)):
                self.rows.removeKey((r[0],))
        none = (None,) * 6
        for o, model, last, cumulative in keep:
            self.rows.updateValue((o,), (model, last is not None, cumulative is not None, *(last or none), *(cumulative or none)))
        for model, values in sums.items() if fold else ():
            self.sums.updateValue((model,), values)
        self.base.update((base["ordinal"], base["model"], base["beats"], base["invalid"], base["late"], base["late_tokens"], base["cumulative"] is not None, *(base["cumulative"] or none)))
        self._count(base, sums, keep)
        for model, values in sorted(sums.items() or [("unknown", (0,) * 6)]):
            yield Row(session_id=key[0], model=model, **dict(zip(CLASSES, values)), heartbeats=base["beats"], invalid_rows=base["invalid"], late=base["late"], late_tokens=base["late_tokens"])

    def close(self) -> None:
        pass


class RecoveryLinker(StatefulProcessor):
    """Failures of one project and key, linked to the next success in the project's order (ST3)."""

    FIELDS = "at long, provider string, session string, sequence long, revision string, result string"

    def __init__(self, delay_us: int, idle_ms: int, max_open: int | None, ttl_ms: int | None):
        self.delay, self.idle, self.max_open, self.ttl = delay_us, idle_ms, max_open, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.FIELDS, self.ttl)
        self.waiting = handle.getListState("waiting", self.FIELDS, self.ttl)
        self.mark = handle.getValueState("mark", "newest long, at long, provider string, session string, sequence long, revision string", self.ttl)

    def _take(self, project: str, rows: list[tuple]) -> Iterator[Row]:
        """Link rows, which come in order after all that were taken before."""
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        for r in rows:
            if r[5] == "failure":
                waiting.append(r)
                if self.max_open is not None and len(waiting) > self.max_open:
                    yield Row(project_id=project, failure=waiting.pop(0)[4], recovered_by=None, recovered_session=None, state="unlinked")
            else:
                for f in waiting:
                    if f[2] != r[2]:
                        yield Row(project_id=project, failure=f[4], recovered_by=r[4], recovered_session=r[2], state="linked")
                waiting = []
        self.waiting.put(waiting) if waiting else self.waiting.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest, frontier = None, None
        if self.mark.exists():
            m = self.mark.get()
            newest, frontier = m[0], None if m[1] is None else tuple(m[1:6])
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        for r in rows:
            row = (r["at"], r["provider"], r["session_id"], r["sequence"], r["revision_id"], r["result"])
            if frontier is not None and row[:5] <= frontier:
                yield Row(project_id=key[0], failure=row[4], recovered_by=None, recovered_session=None, state="late")
            else:
                held.append(row)
                newest = row[0] if newest is None else max(newest, row[0])
        held.sort()
        ready = [r for r in held if r[0] <= newest - self.delay] if newest is not None else []
        yield from self._take(key[0], ready)
        frontier = ready[-1][:5] if ready else frontier
        held = held[len(ready) :]
        self.held.put(held) if held else self.held.clear()
        self.mark.update((newest, *(frontier or (None,) * 5)))
        if self.delay:
            for t in [*self.handle.listTimers()]:
                self.handle.deleteTimer(t)
        if held:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """No row came for ``idle``: what is held is taken as it is."""
        held = sorted(tuple(r) for r in self.held.get()) if self.held.exists() else []
        yield from self._take(key[0], held)
        if held:
            self.held.clear()
            self.mark.update((self.mark.get()[0], *held[-1][:5]))

    def close(self) -> None:
        pass


class Debouncer(StatefulProcessor):
    """The last event of a burst of one entity, once no further one came for the gap (ST5): each event pushes a processing-time timer."""

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "deadline long, hash string, at long, events long")
        self.own = handle.getValueState("own", "hash string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = self.pending.get() if self.pending.exists() else None
        deadline, hash_, at, events = tuple(now) if now is not None else (None, None, None, 0)
        own = self.own.get()[0] if self.own.exists() else None
        before = deadline
        for r in sorted(rows, key=lambda r: (r["at"], not r["written"])):
            if r["written"]:
                own = r["hash"]
                self.own.update((own,))
            elif r["hash"] != own:
                events += 1
                if at is None or r["at"] >= at:
                    hash_, at = r["hash"], r["at"]
                deadline = max(deadline or 0, r["at"] // 1000 + self.gap)
        if deadline is not None and deadline != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(deadline)
        if events:
            self.pending.update((deadline, hash_, at, events))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.pending.exists():
            deadline, hash_, at, events = self.pending.get()
            self.pending.clear()
            yield Row(entity=key[0], hash=hash_, at=at, events=events, deadline=deadline)

    def close(self) -> None:
        pass
