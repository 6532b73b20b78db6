"""Progress of jobs as a stream: the same folds as ``operators.progress``, with bounded state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evidara.operators.progress import RING, TERMINAL

UPDATE = "ms long, seq long, status string, stage string, state string, progress long, detail string, stats string, page_count long, page_current long, preview string"
STEP = "state string, progress long, detail string, stats string, page_count long, page_current long, preview string"
LINES = "status string, status_line string, counters_line string, latest_preview string, n_events long, ended long"
SHOWN = f"job_id long, {LINES}, first_kept long, stage string, {', '.join(f'stage_{x.strip()}' if x.strip().startswith('state') else x.strip() for x in STEP.split(','))}"
#: Store of the states; the one that knows timers and several states a key.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fold_step(step: tuple | None, u: Row) -> tuple:
    """A stage's (state, progress, detail, stats, page_count, page_current, preview) after an update."""
    _, _, detail, stats, count, current, preview = step or ("", 0, "", "", None, None, None)
    count = u.page_count if (u.page_count or 0) > 0 else count
    current = u.page_current if (u.page_current or 0) > 0 else current
    if current is not None:
        current = max(1, min(current, count or current))
    return (u.state if u.state is not None else "pending", u.progress or 0, u.detail or detail, u.stats or stats, count, current, u.preview or preview)


class Progress(StatefulProcessor):
    """State of a job: lines, a step for each stage, a ring of its last RING events, and updates that wait for their turn.

    Updates wait until the watermark has passed them and are then folded by (ts, seq), so those that come late, but within
    the watermark's delay, take their place; a timer at the latest waiting one brings the turn. After a terminal update the job's steps, ring and
    waiting updates go at once and later updates are ignored; what remembers the end goes ``remember`` seconds of event time later.
    """

    def __init__(self, remember: int):
        self.remember = remember * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getValueState("lines", LINES)
        self.steps = handle.getMapState("steps", "stage string", STEP)
        self.ring = handle.getMapState("ring", "slot long", "seq long, stage string")
        self.waiting = handle.getListState("waiting", UPDATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        came = [tuple(r[1:]) for r in rows]
        known = self.lines.get() if self.lines.exists() else None
        if came and (known is None or known[5] is None):
            self.waiting.appendList(came)
            self.handle.registerTimer(max(r[0] for r in came))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        lines = tuple(self.lines.get()) if self.lines.exists() else (None, None, None, None, 0, None)
        if lines[5] is not None:
            if expiredTimerInfo.getExpiryTimeInMs() >= lines[5] + self.remember:
                self.lines.clear()
            return
        watermark = timerValues.getCurrentWatermarkInMs()
        update, shown = (Row(*[x.split()[0] for x in kind.split(", ")]) for kind in (UPDATE, SHOWN))
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2])
        touched, steps = set(), {}
        status, line, counters, preview, n, ended = lines
        while rows and rows[0][0] <= watermark and ended is None:
            u = update(*rows.pop(0))
            status, line, counters = u.status, u.detail or line, u.stats or counters
            stage = (u.stage or "").strip(" ")
            if stage:
                if stage not in steps:
                    steps[stage] = tuple(self.steps.getValue((stage,))) if self.steps.containsKey((stage,)) else None
                steps[stage] = fold_step(steps[stage], u)
                preview = u.preview or preview
                self.ring.updateValue((n % RING,), (u.seq, stage))
                n += 1
                touched.add(stage)
            if status in TERMINAL:
                ended = u.ms
        first = self.ring.getValue((n % RING if n > RING else 0,))[0] if n else None
        lines = (status, line, counters, preview, n, ended)
        for stage in sorted(touched) or [None]:
            yield shown(*key, *lines, first, stage, *(steps[stage] if stage else (None,) * 7))
        self.lines.update(lines)
        if ended is not None:
            for state in (self.steps, self.ring, self.waiting):
                state.clear()
            self.handle.registerTimer(ended + self.remember)
            return
        for stage, step in steps.items():
            self.steps.updateValue((stage,), step)
        if rows:
            self.waiting.put(rows)
        else:
            self.waiting.clear()


def progress(spark: SparkSession, updates: DataFrame, late: str = "1 hour", remember: int = 86_400) -> DataFrame:
    """Changed rows (job_id, its lines, stage, its step) of a stream of updates, in update mode.

    ``updates`` has the columns of UPDATE with ``ts`` in place of ``ms``. Updates later than ``late`` are dropped by the watermark.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    ms = F.unix_millis("ts").alias("ms")
    rows = updates.withWatermark("ts", late).select("job_id", ms, *[x.split()[0] for x in UPDATE.split(", ")][1:], "ts")
    return rows.groupBy("job_id").transformWithState(Progress(remember), SHOWN, "update", "EventTime")
