"""The recents list as a fold of mergeable summaries (WIN1 with removes).

A run of events changes the list in a way that a small summary holds, whatever
the list was before:

* ``front``: what the run added and still shows, most recent first.  All of it
  stands before the older entries, so the cap treats it as a list of its own.
* ``touched``: each premises the run added or removed, at its first time, with
  the most entries ``front`` held since the touch before; ``last``: since the
  last touch.  An older entry at place i stays if nothing touched it and never
  ``limit`` entries stood before it: those of ``front``, and of the i older ones
  before it those that were not touched yet.
* ``fresh``: the list before does not matter, because it was cleared, or
  ``front`` was full at some time.  Then nothing else is kept.

Summaries are associative: ``then`` joins two neighbouring runs.  Every sorted
partition makes one for each of its users, so a user with a third of all events
is spread over many tasks and comes back as one row for each.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

SUMMARY = "user_id long, part int, fresh boolean, touched array<struct<pid:long,most:int>>, last int, front array<long>"


@dataclass
class Summary:
    limit: int
    fresh: bool = False
    touched: dict[int, int] = field(default_factory=dict)
    last: int = 0
    front: list[int] = field(default_factory=list)

    def event(self, op: str, pid: int) -> None:
        if op == "clear":
            self._renew([])
            return
        if not self.fresh and pid not in self.touched:
            self.touched[pid] = self.last
            self.last = 0
        if pid in self.front:
            self.front.remove(pid)
        if op == "add":
            self.front.insert(0, pid)
            del self.front[self.limit :]
        if not self.fresh:
            # a touch of an entry that stays in front does not lower the count before it
            self.last = max(self.last, len(self.front))
            if self.last >= self.limit:
                self._renew(self.front)

    def _renew(self, front: list[int]) -> None:
        self.fresh, self.touched, self.last, self.front = True, {}, 0, front

    def after(self, before: list[int]) -> list[int]:
        """The list that this run leaves of ``before``."""
        if self.fresh:
            return list(self.front)
        kept = list(self.front)
        for place, entry in enumerate(before):
            if entry in self.touched:
                continue
            ahead, stays = place, True
            earlier = set(before[:place])
            for pid, most in self.touched.items():
                stays = stays and ahead + most < self.limit
                ahead -= pid in earlier
            if stays and ahead + self.last < self.limit:
                kept.append(entry)
        return kept

    def then(self, later: Summary) -> Summary:
        """The summary of this run and the next one."""
        if later.fresh:
            return later
        both = Summary(self.limit, self.fresh, front=later.after(self.front))
        if self.fresh:
            return both
        own, touched, most = set(self.front), dict(self.touched), self.last
        ahead = len(self.front)  # of this run's entries, those the next one has not touched
        for pid, peak in later.touched.items():
            most = max(most, ahead + peak)
            if most >= self.limit:
                both._renew(both.front)
                return both
            ahead -= pid in own
            if pid not in touched:
                touched[pid], most = most, 0
        both.touched, both.last = touched, max(most, ahead + later.last)
        if both.last >= self.limit:
            both._renew(both.front)
        return both


def _summaries(limit: int):
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.struct([("pid", pa.int64()), ("most", pa.int32())])), pa.int32(), pa.list_(pa.int64())]

    def run(batches):
        part = TaskContext.get().partitionId()
        user, held, done = None, None, []

        def row():
            touched = [{"pid": p, "most": m} for p, m in held.touched.items()]
            return (user, part, held.fresh, touched, held.last, held.front)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in ("user_id", "part", "fresh", "touched", "last", "front")])

        for b in batches:
            for u, op, pid in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held is None or u != user:
                    if held is not None:
                        done.append(row())
                    user, held = u, Summary(limit)
                held.event(op, pid)
            if len(done) > 5000:
                yield batch_of(done)
                done = []
        if held is not None:
            done.append(row())
        if done:
            yield batch_of(done)

    return run


def _lists(limit: int):
    def run(batches):
        user, held, out = None, None, []

        def shown():
            return [(user, k, pid) for k, pid in enumerate(held.front)]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["user_id", "position", "pid"])

        for b in batches:
            for r in b.to_pylist():
                one = Summary(limit, r["fresh"], {t["pid"]: t["most"] for t in r["touched"]}, r["last"], r["front"])
                if held is not None and r["user_id"] == user:
                    held = held.then(one)
                else:
                    out += shown() if held is not None else []
                    user, held = r["user_id"], one
            if len(out) > 5000:
                yield batch_of(out)
                out = []
        out += shown() if held is not None else []
        if out:
            yield batch_of(out)

    return run


def slice_summaries(log: DataFrame, limit: int) -> DataFrame:
    """One summary per user and sorted partition of the log."""
    order = ["user_id", "ts", "event_id"]
    events = log.select(*order, "op", "pid")
    # a stated number: partitions small in bytes still take time to fold, and are not merged
    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = events.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ranged.select("user_id", "op", "pid").mapInArrow(_summaries(limit), SUMMARY)


def fold_lists(log: DataFrame, limit: int) -> DataFrame:
    """(user_id, position, pid) of every user whose list is not empty, from a
    log (user_id, ts, event_id, op, pid) applied in (ts, event_id) order; op is
    add, remove or clear.  A user has as many summaries as partitions hold
    events of theirs; they are joined in that order."""
    parts = slice_summaries(log, limit)
    return parts.repartition("user_id").sortWithinPartitions("user_id", "part").mapInArrow(
        _lists(limit), "user_id long, position int, pid long"
    )
