import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corvane.llm import queries
from corvane.llm.merkle_manifest import fold, hex_text, manifest, verified

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def leaf_of(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(digests):
    """The levels of a tree, from its leaves to its root."""
    levels = [list(digests)]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([H(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def proof(levels, at):
    out = []
    for level in levels[:-1]:
        out.append((level[at ^ 1] if (at ^ 1) < len(level) else None, at % 2))
        at //= 2
    return out


def want(rows):
    """(id, leaf, subroot, root, siblings, folded root) of each row, by plain lists."""
    groups = defaultdict(list)
    for r in rows:  # doc_id, source, lang, n_chars, text
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees, ordered = {}, {}
    for g in names:
        ordered[g] = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[g] = tree([leaf_of(r) for r in ordered[g]])
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(ordered[g]):
            steps = proof(trees[g], i) + proof(top, k)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            digest = leaf_of((*r[:3], r[3] + 1, r[4])) if hit else leaf_of(r)
            for sibling, odd in steps:
                digest = H(*([sibling, digest] if odd else [digest, sibling or ""]))
            out.append((r[0], leaf_of(r), trees[g][-1][0], top[-1][0], H(*[s for s, _ in steps if s]), digest, digest == top[-1][0]))
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, s, g, n, t, "clash", 9) for i, s, g, n, t in rows], "doc_id long, source string, lang string, n_chars long, text string, idx string, tree int")


def got(df):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    rows = verified(manifest(df, altered={"n_chars": tampered}))
    return [tuple(r) for r in rows.select("id", hex_text(F.col("leaf")), hex_text(F.col("subroot")), hex_text(F.col("root")), F.sha2(hex_text(F.col("proof")).cast("binary"), 256), "folded_root", "verified").collect()]


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 37, "de": 16, None: 5, "é": 1, "zz": 2}, {"a": 2, "b": 2, "c": 2, "d": 3, "e": 1}])
def test_against_plain_lists(spark, sizes):
    r = random.Random(3)
    rows, i = [], 0
    for g, n in sizes.items():
        for _ in range(n):
            i += r.randint(1, 9)
            rows.append((i, r.choice(["x", None, "ü"]), g, r.choice([None, 3, 70]), r.choice(["", None, "ein Wort é", "a" * 3000])))
    r.shuffle(rows)
    assert sorted(got(table(spark, rows)), key=repr) == sorted(want(rows), key=repr)


def test_repeated_rows_ids_and_nulls(spark):
    rows = [(5, "x", "en", 3, "same")] * 9 + [(5, "x", "en", 3, "other"), (None, "x", "en", 1, "no id"), (None, None, None, None, None), (7, "y", "fr", 1, "lone"), (-4, "y", "fr", 1, "less")]
    assert sorted(got(table(spark, rows)), key=repr) == sorted(want(rows), key=repr)


def test_empty_table(spark):
    assert got(table(spark, [(1, "x", "en", 3, "t")]).limit(0)) == []


def test_any_change_of_a_proof_is_seen(spark):
    df = table(spark, [(i, "s", "en" if i % 3 else "de", i, f"text {i}") for i in range(11)])
    rows = manifest(df)
    assert "altered_leaf" not in rows.columns and all(r.verified for r in verified(rows).collect())
    broken = rows.withColumn("proof", F.concat(F.expr("substring(proof, 1, 31)"), F.lit(b"\x00"), F.expr("substring(proof, 33)")))
    assert not any(r.verified for r in verified(broken.where(F.length("proof") > 0)).collect())
    swapped = rows.withColumn("sides", F.translate("sides", "LR", "RL"))
    assert not any(r.verified for r in verified(swapped).collect())
    assert rows.select(fold(F.col("leaf"), F.col("proof"), F.col("sides")).alias("f")).distinct().count() == 1


def test_query_over_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = queries.op11_merkle_manifest(spark, sf)
    assert sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())) == sorted(want(rows))
