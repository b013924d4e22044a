import random
from datetime import datetime, timedelta, timezone

import pytest

from corvane.sources.folders import workspace
from corvane.streaming import groups, jobs

HOUR = 3_600_000
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def walk(messages, idle, most, end):
    """The deliveries by a plain loop over each queue's messages (hour, queue, seq, kind, consumer, job)."""
    out = []
    for queue in {m[1] for m in messages}:
        waiting, pending, n = [], {}, 0
        stale = lambda e: out.append((queue, pending[e]["at"] + idle, 0, "STALE", pending[e]["c"], pending[e]["job"], pending[e]["d"]))
        for hour, _, seq, kind, c, job in sorted(m for m in messages if m[1] == queue):
            at = hour * HOUR
            if kind == "ADD":
                waiting.append((n, job))
                n += 1
            for p in pending.values():
                if kind == "RESTART" and p["c"] == c:
                    p["flying"] = False
            own = [e for e in sorted(pending) if pending[e]["c"] == c and not pending[e]["flying"]][:4]
            idle_ones = [e for e in sorted(pending) if pending[e]["c"] != c and at - pending[e]["at"] >= idle][:8]
            if kind == "ACK":
                for e in [e for e in sorted(pending) if pending[e]["c"] == c and pending[e]["flying"]][:4]:
                    if at - pending[e]["at"] >= idle:
                        stale(e)
                    p = pending.pop(e)
                    out.append((queue, at, seq, "ACK", c, p["job"], p["d"]))
            elif kind == "POLL":
                new = [] if own or idle_ones else waiting[:4]
                waiting = waiting[len(new) :]
                for e, job in new:
                    pending[e] = {"job": job, "d": 0, "c": None, "at": at}
                for e in own or idle_ones or [e for e, _ in new]:
                    p = pending[e]
                    if p["d"] and at - p["at"] >= idle:
                        stale(e)
                    if not own and idle_ones and p["d"] >= most:
                        out.append((queue, at, seq, "DEAD", p["c"], p["job"], p["d"]))
                        del pending[e]
                        continue
                    p.update(c=c, at=at, d=p["d"] + 1, flying=True)
                    out.append((queue, at, seq, "OWN" if own else "RECLAIMED" if idle_ones else "NEW", c, p["job"], p["d"]))
        for e in pending:
            if pending[e]["at"] + idle <= end:
                stale(e)
    return sorted(out)


@pytest.mark.parametrize("files", [1, 4])
def test_as_a_loop_however_the_stream_is_cut(spark, files):
    r = random.Random(8)
    kinds = ["ADD"] * 5 + ["POLL"] * 3 + ["ACK"] * 2 + ["RESTART"]
    messages = [(h, r.randint(0, 2), i, r.choice(kinds), r.randint(0, 2), i) for i, h in enumerate(sorted(r.randint(0, 400) for _ in range(500)))]
    folder = workspace(spark, "messages")
    schema = "ts timestamp, queue long, seq long, kind string, consumer long, job long"
    step = -(-len(messages) // files)
    for k in range(files):
        part = messages[k * step : (k + 1) * step]
        spark.createDataFrame([(START + timedelta(hours=m[0]), *m[1:]) for m in part], schema).coalesce(1).write.mode("append").parquet(folder)
        import time

        time.sleep(1.1)  # the file stream goes by the files' times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = jobs.finish(groups.deliveries(stream, idle_ms=12 * HOUR, late="1 hour"), workspace(spark, "stream"))
    base = int(START.timestamp() * 1000)
    rows = sorted((x.queue, x.at - base, x.seq, x.action, x.consumer, x.job, x.deliveries) for x in got.collect())
    want = walk(messages, 12 * HOUR, 3, (messages[-1][0] - 1) * HOUR)
    assert rows == want
    assert {x[3] for x in rows} >= {"NEW", "OWN", "RECLAIMED", "DEAD", "ACK", "STALE"}
