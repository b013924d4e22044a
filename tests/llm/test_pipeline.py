from collections import Counter

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from corvane.llm import language_id, mixing, ngram_join
from corvane.llm.common import materialize


def test_stages_hand_on_what_they_keep(spark):
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "mixing", "packing"] and corpus_pipeline.ORACLE_SQL is None
    rejected = {r.doc_id for r in language_id.identify(docs).where("rejected").collect()}
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(materialize(stage(spark, steps[-1], source)))
    assert all(s.columns == docs.columns for s in steps[:4])
    first = {r.doc_id for r in steps[1].collect()}
    assert first == {r.doc_id for r in docs.collect()} - rejected and len(first) > 0.95 * docs.count()
    kept = {r.doc_id for r in ngram_join.near_duplicates(steps[1]).where("kept").collect()}
    assert {r.doc_id for r in steps[2].collect()} == kept and len(kept) == steps[2].count()
    copies = {r.doc_id: round(r.taken / max(1, r.size)) for r in mixing.mix(steps[2]).collect()}
    assert Counter(r.doc_id for r in steps[3].collect()) == Counter({i: n for i, n in copies.items() if n})
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = sum(len(full.encode(r.text, add_special_tokens=False).ids) + 1 for r in steps[3].collect())
    packed = steps[4].collect()
    assert sum(r.length for r in packed) == tokens
    assert len({r.sequence_id for r in packed}) <= -(-tokens // 2048) + 2


def test_stages_stand_clashing_columns_nulls_and_no_rows(spark):
    rows = [(i, f"the house and the river of winter number {i % 40} in the small village " * (1 + i % 5), "en", f"s{i % 3}", 1) for i in range(80)] + [(100, None, None, None, None), (101, "", "en", "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("score", "rejected", "kept", "times", "length", "size", "node", "taken", "t", "rid"):
        docs = docs.withColumn(c, docs["doc_id"])
    for table in (docs, docs.limit(0)):
        at = table
        for name, stage in corpus_pipeline.STAGES:
            at = materialize(stage(spark, at, ""))
            assert name == "packing" or at.columns == docs.columns
        assert (at.count() > 0) == (table is docs)


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert "sequence_id" in got.columns and got.count() > 0


def test_short_documents_stay(spark):
    short = ["das Haus", "la maison", "a river", "el invierno", "Ja", "ok then", "noch ein kleines Haus am Fluss"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = spark.createDataFrame([(10_000 + i, t, None, "short", len(t)) for i, t in enumerate(short)], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    both = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more)
    at = both
    for name, stage in corpus_pipeline.STAGES[:2]:
        at = materialize(stage(spark, at, ""))
        assert {r.doc_id for r in at.where("doc_id >= 10000").collect()} == {10_000 + i for i in range(len(short))}, name
