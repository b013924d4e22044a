import hashlib
import zlib
from collections import defaultdict

from corvane.llm.sharding import shard_documents, write_shards


def table(spark):
    rows = [(i, f"text {i} " * (1 + i % 40)) for i in range(600)] + [(1000 + i, "copy of one text") for i in range(300)]
    rows += [(2000, None), (2001, ""), (2002, "x" * 9000), (3, "text 3 again"), (7, rows[7][1]), (7, rows[7][1]), (None, "no id"), (None, "no id")]
    return spark.createDataFrame([(*r, "a") for r in rows], "doc_id long, text string, shard string"), rows


def brute(rows, n=8, whole=1 / 256):
    keyed = sorted((int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16), -(1 << 63) if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    total, ends, out, slots, groups = sum(k[2] for k in keyed), 0, [], defaultdict(int), defaultdict(int)
    for key, _, size, _ in keyed:
        groups[key] += size
    begun = {}
    for key, i, size, crc in keyed:
        begun.setdefault(key, ends)
        ends += size
        twice = 2 * begun[key] + groups[key] if groups[key] <= total * whole / n else 2 * ends - size
        shard = min(n - 1, twice * n // (2 * total))
        out.append((-1 if i == -(1 << 63) else i, size, crc, shard, slots[shard]))
        slots[shard] += 1
    return sorted(out)


def test_against_brute_force(spark):
    df, rows = table(spark)
    for options in ({}, {"ranges": 16, "per_range": 1}, {"whole": 0.5}, {"whole": 0.5, "ranges": 300}):
        got = shard_documents(df, **options).collect()
        assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got) == brute(rows, whole=options.get("whole", 1 / 256))


def test_sizes_near_equal_and_slots_gapless(spark):
    df, rows = table(spark)
    shards = defaultdict(list)
    for r in shard_documents(df).collect():
        shards[r.shard].append(r)
    sizes = [sum(r.size for r in s) for s in shards.values()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 2 * 9001
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards.values())


def test_empty_table_and_files(spark, tmp_path):
    df, rows = table(spark)
    assert shard_documents(df.limit(0)).count() == 0
    assert shard_documents(df.where("doc_id = 5")).count() == 1
    write_shards(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.text or "") for r in back.collect()) == sorted((t or "") for _, t in rows)


def test_groups_that_are_small_stay_whole_and_alike_rows_are_split(spark):
    rows = [(i, f"text {i // 6} and more of it") for i in range(3000)] + [(None, "the same row again and again")] * 1500 + [(7, "another one")] * 1500
    df = spark.createDataFrame(rows, "doc_id long, text string")
    shards, sizes, slots = defaultdict(set), defaultdict(int), defaultdict(list)
    for r in shard_documents(df, ranges=64, whole=0.02).collect():
        shards[r.text_crc32].add(r.shard)
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    hot = [zlib.crc32(t.encode()) for t in ("the same row again and again", "another one")]
    assert all(len(s) == 1 for t, s in shards.items() if t not in hot) and len(shards[hot[0]]) > 1
    assert max(sizes.values()) - min(sizes.values()) < 0.05 * sum(sizes.values()) / 8
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
