"""A consumer group over a stream of jobs: own pending work, idle work of others, then new work.

The stream brings messages of a queue: a job is added, a consumer polls, acknowledges or starts anew. A
queue's state is its waiting entries (a list) and its pending ones (a map), and a timer
for each delivery tells of jobs that fell silent.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "queue long, at long, seq long, action string, consumer long, job long, deliveries int"
ADD, POLL, ACK, RESTART = "ADD", "POLL", "ACK", "RESTART"


class ConsumerGroup(StatefulProcessor):
    """Deliveries of a queue's jobs.

    A poll gets up to ``count`` of the consumer's own pending jobs that aren't in flight (it started anew since they were given to it);
    if there is none, up to ``claim`` pending jobs of others that have been idle for ``idle_ms``; if there is none, up to
    ``count`` new ones. A job in flight isn't given to its consumer again. A job that was delivered ``most`` times and falls idle is DEAD
    instead of claimed. An ack settles the consumer's ``count`` oldest jobs in flight. Each delivery that stays untouched
    for ``idle_ms`` is told of once as STALE, by its timer or when it is touched later, whichever comes first.
    """

    def __init__(self, count: int, claim: int, idle_ms: int, most: int):
        self.count, self.claim, self.idle_ms, self.most = count, claim, idle_ms, most

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "entry long, job long")
        self.pending = handle.getMapState("pending", "entry long", "job long, consumer long, at long, deliveries int, flying boolean, told boolean")
        self.entries = handle.getValueState("entries", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        pending = {k[0]: list(v) for k, v in self.pending.iterator()} if self.pending.exists() else {}
        before = {k: tuple(v) for k, v in pending.items()}
        n = self.entries.get()[0] if self.entries.exists() else 0
        out: list[tuple] = []
        timers = set()

        def tell(at: int, seq: int, action: str, entry: int) -> None:
            job, consumer, _, deliveries, _, _ = pending[entry]
            out.append((key[0], at, seq, action, consumer, job, deliveries))

        def touch(entry: int, at: int, seq: int) -> None:
            given = pending[entry][2]
            if at - given >= self.idle_ms and not pending[entry][5]:
                tell(given + self.idle_ms, 0, "STALE", entry)

        def deliver(entry: int, consumer: int, at: int, seq: int, action: str) -> None:
            pending[entry] = [pending[entry][0], consumer, at, pending[entry][3] + 1, True, False]
            timers.add(at + self.idle_ms)
            tell(at, seq, action, entry)

        batch = pd.concat(list(rows)).sort_values(["at", "seq"])
        for at, seq, kind, consumer, job in zip(*(batch[c].tolist() for c in ("at", "seq", "kind", "consumer", "job")), strict=True):
            if kind == ADD:
                waiting.append((n, job))
                n += 1
            elif kind == RESTART:
                for p in pending.values():
                    p[4] = p[4] and p[1] != consumer
            elif kind == ACK:
                for entry in sorted(e for e, p in pending.items() if p[1] == consumer and p[4])[: self.count]:
                    touch(entry, at, seq)
                    tell(at, seq, "ACK", entry)
                    del pending[entry]
            elif kind == POLL:
                own = sorted(e for e, p in pending.items() if p[1] == consumer and not p[4])[: self.count]
                idle = [] if own else sorted(e for e, p in pending.items() if p[1] != consumer and at - p[2] >= self.idle_ms)[: self.claim]
                for entry in own + idle:
                    touch(entry, at, seq)
                    if idle and pending[entry][3] >= self.most:
                        tell(at, seq, "DEAD", entry)
                        del pending[entry]
                    else:
                        deliver(entry, consumer, at, seq, "OWN" if own else "RECLAIMED")
                if not own and not idle:
                    for entry, job in waiting[: self.count]:
                        pending[entry] = [job, consumer, at, 0, False, False]
                        deliver(entry, consumer, at, seq, "NEW")
                    waiting = waiting[self.count :]
        if waiting:
            self.waiting.put(waiting)
        elif self.waiting.exists():
            self.waiting.clear()
        for entry in before.keys() - pending.keys():
            self.pending.removeKey((entry,))
        for entry, p in pending.items():
            if before.get(entry) != tuple(p):
                self.pending.updateValue((entry,), tuple(p))
        self.entries.update((n,))
        alive = {p[2] + self.idle_ms for p in pending.values() if not p[5]}
        for at in timers & alive:
            self.handle.registerTimer(at)
        yield pd.DataFrame(out, columns=["queue", "at", "seq", "action", "consumer", "job", "deliveries"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        out = []
        for k, (job, consumer, at, deliveries, flying, told) in [(k, tuple(v)) for k, v in self.pending.iterator()]:
            if at + self.idle_ms == now and not told:
                out.append((key[0], now, 0, "STALE", consumer, job, deliveries))
                self.pending.updateValue(k, (job, consumer, at, deliveries, flying, True))
        yield pd.DataFrame(out, columns=["queue", "at", "seq", "action", "consumer", "job", "deliveries"])

    def close(self) -> None:
        pass


def deliveries(messages: DataFrame, count: int = 4, claim: int = 8, idle_ms: int = 12 * 3_600_000, most: int = 3, late: str = "1 hour") -> DataFrame:
    """What a consumer group does with a stream of ``messages``: queue, at, seq, action, consumer, job, deliveries.

    ``messages``: ts (timestamp), queue, seq, kind, consumer, job. A queue's messages count in the order of ts and seq; rows with a
    null queue, ts or seq are no messages. Times are milliseconds. See :class:`ConsumerGroup`.
    """
    spark = messages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    own = messages.where("queue IS NOT NULL AND ts IS NOT NULL AND seq IS NOT NULL").withWatermark("ts", late)
    own = own.selectExpr("ts", "CAST(queue AS LONG) AS queue", "unix_millis(ts) AS at", "seq", "kind", "coalesce(CAST(consumer AS LONG), -1L) AS consumer", "coalesce(CAST(job AS LONG), -1L) AS job")
    return own.groupBy("queue").transformWithStateInPandas(statefulProcessor=ConsumerGroup(count, claim, idle_ms, most), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
