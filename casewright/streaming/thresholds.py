"""Threshold rules over a stream: the sliding window and cooldown as keyed state."""

from __future__ import annotations

from bisect import insort
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from casewright.functions import ids
from casewright.operators.detect import (
    FINDING_COLUMNS,
    GROUP,
    MAX_ENTITY_VALUES,
    MAX_EVIDENCE,
    _rule_meta,
    threshold_matches,
)
from casewright.operators.rules import Rule

# --- Fixed values -----------------------------------------------------------------------------------------------
RETAINED_WINDOWS = 2
# ------------------------------------------------------------------------------------------------------------

BUCKETS_PER_WINDOW = 4

_FIRED = (
    "org_id string, rule int, group_key string, group_values array<string>, at_ms bigint, first_ms bigint, "
    "evidence array<string>, counted array<string>"
)


class SlidingThreshold(StatefulProcessor):
    """Events of one (org, rule, group): those of the last two windows, and when the rule last fired.

    Events are held in buckets of a quarter of a window, beside the number of events of each bucket. A batch whose
    buckets and window together hold fewer events than the threshold cannot fire: it reads and writes the buckets its
    own events fall into and no other. Otherwise the buckets from a window before its first event on are read. Buckets
    that two windows have passed go, and when time has passed a group by two windows, all of its state does.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buckets = handle.getMapState("buckets", "bucket bigint", "uids array<string>, times array<bigint>, counted array<string>")
        self.totals = handle.getMapState("totals", "bucket bigint", "events bigint")
        self.group = handle.getValueState("group", "newest bigint, fired bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        window, threshold = int(batch["window_ms"].iloc[0]), int(batch["threshold"].iloc[0])
        width = max(1, window // BUCKETS_PER_WINDOW)
        newest, last = self.group.get() if self.group.exists() else (None, None)
        totals = {k[0]: v[0] for k, v in self.totals.iterator()}
        arrivals = [
            (int(r.time_ms), r.event_uid, r.value, list(r.group_values))
            for r in batch.sort_values(["time_ms", "event_uid"]).drop_duplicates("event_uid").itertuples(index=False)
        ]
        first, final = (arrivals[0][0] - window) // width, arrivals[-1][0] // width
        own = {at // width for at, *_ in arrivals}
        reached = [b for b in totals if first <= b <= final]
        quiet = sum(totals[b] for b in reached) + len(arrivals) < threshold
        held = {b: self._bucket(b) for b in (own.intersection(totals) if quiet else reached)}
        known = {entry[1] for entries in held.values() for entry in entries}
        fresh = [entry for entry in arrivals if entry[1] not in known]
        out = []
        if not quiet:
            kept = sorted((entry for entries in held.values() for entry in entries), key=lambda e: e[:2])
            last, found = self._sweep(arrivals, kept, known, newest, last, window, threshold)
            out = [(*key, *row) for row in found]
        newest = max(arrivals[-1][0], arrivals[-1][0] if newest is None else newest)
        oldest = (newest - RETAINED_WINDOWS * window) // width
        for bucket in {entry[0] // width for entry in fresh}:
            entries = sorted([*held.get(bucket, []), *[e[:3] for e in fresh if e[0] // width == bucket]], key=lambda e: e[:2])
            totals[bucket] = len(entries)
            if bucket >= oldest:
                self.buckets.updateValue((bucket,), ([e[1] for e in entries], [e[0] for e in entries], [e[2] for e in entries]))
                self.totals.updateValue((bucket,), (len(entries),))
        for bucket in [b for b in totals if b < oldest]:
            self.buckets.removeKey((bucket,))
            self.totals.removeKey((bucket,))
        self.group.update((newest, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(newest + RETAINED_WINDOWS * window + 1)
        yield pd.DataFrame(out, columns=[*GROUP, "group_values", "at_ms", "first_ms", "evidence", "counted"])

    def _bucket(self, bucket: int) -> list[tuple]:
        uids, times, counted = self.buckets.getValue((bucket,))
        return list(zip(times, uids, counted, strict=True))

    def _sweep(self, arrivals, kept, known, newest, last, window, threshold) -> tuple[int | None, list[tuple]]:
        """Take the arrivals in order of time; returns when the rule last fired, and what it found."""
        inside: list[tuple] = []  # the window of the event at hand, in (time, uid) order
        counts: Counter = Counter()
        pending = 0
        out = []
        for at, uid, value, group_values in arrivals:
            newest = at if newest is None else max(newest, at)
            # Arrivals come in time order, so what was held is taken in as the window moves on.
            while pending < len(kept) and kept[pending][0] <= at:
                inside.append(kept[pending])
                counts[self._counted(kept[pending])] += 1
                pending += 1
            if uid not in known:
                entry = (at, uid, value)
                insort(inside, entry, key=lambda e: e[:2])
                counts[self._counted(entry)] += 1
            low = max(at - window, newest - RETAINED_WINDOWS * window)
            drop = 0
            while drop < len(inside) and inside[drop][0] < low:
                counted = self._counted(inside[drop])
                counts[counted] -= 1
                if not counts[counted]:
                    del counts[counted]
                drop += 1
            del inside[:drop]
            if len(counts) < threshold or (last is not None and last != at and at - last < window):
                continue
            if last == at:
                continue  # the same instant again rebuilds the finding it already gave
            last = at
            evidence = inside[:MAX_EVIDENCE]
            values = sorted({e[2] for e in evidence if e[2] is not None})[:MAX_ENTITY_VALUES]
            out.append((group_values, at, evidence[0][0], [e[1] for e in evidence], values))
        return last, out

    @staticmethod
    def _counted(entry: tuple) -> str:
        return entry[1] if entry[2] is None else entry[2]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nothing of this group can count any more, nor can it be within the cooldown."""
        self.buckets.clear()
        self.totals.clear()
        self.group.clear()
        yield pd.DataFrame([], columns=[*GROUP, "group_values", "at_ms", "first_ms", "evidence", "counted"])

    def close(self) -> None:
        return None


def detect_threshold_stream(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """Findings of the threshold rules over a stream of stored events.

    Lateness follows the longest window: state older than two windows before the newest event is dropped.
    Needs the RocksDB state store. A redelivered event is known by its id and changes nothing.
    """
    longest = max(r.window_ms for r in rules)
    timed = events.withWatermark("time", f"{RETAINED_WINDOWS * longest // 1000} seconds")
    fired = (
        threshold_matches(timed, rules, "time")
        .groupBy(*GROUP)
        .transformWithStateInPandas(
            statefulProcessor=SlidingThreshold(), outputStructType=_FIRED, outputMode="append", timeMode="EventTime"
        )
    )
    meta = F.broadcast(_rule_meta(events, rules))
    grouping = F.map_from_arrays("group_by", F.transform("group_values", lambda v: F.array(v)))
    plain = F.map_filter(grouping, lambda k, v: F.coalesce(k != F.col("count_distinct"), F.lit(True)))
    counted = F.when(
        F.col("count_distinct").isNotNull(), F.map_from_arrays(F.array("count_distinct"), F.array("counted"))
    ).otherwise(F.create_map().cast("map<string,array<string>>"))
    return fired.join(meta, "rule").select(
        "org_id",
        ids.digest(F.col("rule_id"), F.col("group_key"), F.col("at_ms"), F.get("evidence", F.lit(0))).alias("finding_id"),
        *[c for c in FINDING_COLUMNS if c.startswith("rule_")],
        "severity_id",
        "techniques",
        "tactics",
        F.map_concat(plain, counted).alias("entities"),
        "evidence",
        "first_ms",
        F.col("at_ms").alias("last_ms"),
    )
