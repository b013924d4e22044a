import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corvane.llm.common import materialize
from corvane.llm.mixing import mix, mixed_documents, schedule, source_targets


def targets(sizes, weights=(3, 1, 2), volume=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, open_, rest = {s: 0.0 for s in names}, set(names), volume * sum(sizes.values())
    while rest > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        for s in open_:
            out[s] += rest * w[s] / total
        rest = sum(max(0.0, out[s] - most * sizes[s]) for s in names)
        open_ = {s for s in open_ if out[s] < most * sizes[s]}
        out = {s: min(out[s], most * sizes[s]) for s in names}
    return out


def table(spark):
    rows = [(i, "wörd " * (1 + i % 37), ["big", "big", "mid", "é", "small" if i % 50 == 0 else "big"][i % 5]) for i in range(900)]
    rows += [(2000, None, "mid"), (2001, "", "mid"), (2002, "long " * 4000, None), (2003, "a b\tc\x1fd", None), (5, "again once more", "mid"), (None, "no id here", "mid"), (2004, "empty", "zero"), (2005, "", "none")]
    return spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, source string, target double"), rows


@pytest.mark.parametrize("block", [7, 512])
def test_against_brute_force(spark, block):
    df, rows = table(spark)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want = targets(sizes)
    order = defaultdict(list)
    for i, t, s in rows:
        order[s].append((hashlib.md5(f"mix:{'-' if i is None else i}".encode()).hexdigest(), -1 if i is None else i, size(t)))
    taken = []
    for s, docs in order.items():
        need, lo = math.floor(want[s] + 1e-9), 0
        for _, i, n in sorted(docs):
            taken.append((i, n, sizes[s], need // sizes[s] * n + max(0, min(n, need % sizes[s] - lo)) if n else 0))
            lo += n
    got = mix(df, block=block).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.source_size, r.taken) for r in got) == sorted(taken)
    assert all(r.target == pytest.approx(want[r.source]) and r.taken <= 2 * r.size for r in got)


def test_schedule_is_even_everywhere(spark):
    sized = spark.createDataFrame([("a", 3000), ("b", 9000), ("c", 500)], "source string, size long")
    sources = materialize(source_targets(sized))
    slots = schedule(sources, 16).orderBy("position").collect()
    per = {r.src: r.target for r in sources.collect()}
    assert {s: sum(x.words for x in slots if x.src == s) for s in per} == {s: math.floor(t) for s, t in per.items()}
    share = {s: sum(x.src == s for x in slots) / len(slots) for s in per}
    for at in range(100, len(slots), 100):
        seen = Counter(x.src for x in slots[:at])
        assert all(abs(seen[s] - share[s] * at) < 6 for s in per)


def test_copies_and_empty(spark):
    df, rows = table(spark)
    got = Counter(r.doc_id for r in mixed_documents(df).collect())
    want = {r.doc_id: round(r.taken / max(1, r.size)) for r in mix(df).collect()}
    assert all(abs(got[i] - n) <= 1 and got[i] <= 2 for i, n in want.items() if i not in (5,))
    assert mixed_documents(df).columns == df.columns
    assert mix(df.limit(0)).count() == 0 and mixed_documents(df.limit(0)).count() == 0
    assert mix(df.where(F.col("doc_id") == 2001)).first().taken == 0


def test_clashing_columns(spark):
    df, _ = table(spark)
    for c in ("times_", "digest_", "id_", "times", "digest", "copy", "own_digest", "k0", "size", "src"):
        df = df.withColumn(c, df["doc_id"])
    got = mixed_documents(df)
    assert got.columns == df.columns and got.count() > 0 and got.where("digest <> doc_id").count() == 0
