from pyspark.sql import functions as F

from corvane.operators import ingest, metrics, scope


def test_messages_that_memory_sees(spark):
    m = spark.createDataFrame(
        [("c", i, t, role, turn, run) for i, (t, role, turn, run) in enumerate([
            (1, "user", None, None), (2, "system", 1, None), (3, "assistant", 1, 10), (4, "assistant", 1, 11), (5, "user", 1, None), (6, "user", 2, None), (7, "user", 3, None), (8, "assistant", 3, None), (9, None, 1, 10), (10, None, None, None), (10, "user", 99, None),
        ])], "conversation_id string, message_id int, created_at int, role string, turn_id int, run_id int",
    )
    turns = spark.createDataFrame([(1, 10), (2, 12), (3, None)], "turn_id int, active_run_id int")
    runs = spark.createDataFrame([(10, "COMPLETED"), (11, "COMPLETED"), (12, "RUNNING")], "run_id int, status string")
    got = [(r.position, r.message_id) for r in scope.visible_messages(m, turns, runs).orderBy("position").collect()]
    assert got == [(1, 0), (2, 1), (3, 2), (4, 4), (5, 9)]
    assert [r.message_id for r in scope.visible_messages(m, turns, runs, 2).orderBy("position").collect()] == [4, 9]
    assert scope.visible_messages(m.limit(0), turns, runs).count() == 0


def test_strict_measures(spark):
    rows = [([1, 2, 2, 7], [1, 5, 5, 5, 5, 2], [2]), ([], [1], []), (None, None, None), ([1, None], [None, 1], None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, e array<int>, f array<int>, r array<int>")
    got = {r[0]: tuple(r)[1:] for r in df.select("i", *[c.alias(k) for k, c in metrics.strict_measures(F.col("e"), F.col("f"), F.col("r")).items()]).collect()}
    assert got == {0: (0.75, 0.25, 0.75, 0.5, 1.0), 1: (0.0, 0.0, 0.0, 0.0, 0.0), 2: (None,) * 5, 3: (1.0, 1.0, 1.0, None, None)}


def test_places_of_chunks(spark):
    chunks = spark.createDataFrame([(1, "bc", [1, 2]), (2, "bc", [1, 2]), (3, "zz", [1, 2]), (4, "bc", [2]), (5, "bc", []), (6, None, [1]), (7, "x", [99])], "chunk_id int, text string, block_ids array<int>")
    blocks = spark.createDataFrame([(1, 5, 3, 100, 104, "abcd"), (2, 4, None, None, 50, "xbc")], "block_id int, order_index int, page int, source_start int, source_end int, text string")
    segments = spark.createDataFrame([(1, 0, 1, None, 7), (1, 1, 2, 6, None), (1, 2, 2, 8, 9)], "chunk_id int, ord int, block_id int, source_start int, source_end int")
    got = {r[0]: tuple(r)[1:] for r in ingest.source_locations(chunks, blocks, segments).collect()}
    # 2: block 2 holds the text first but knows no page or start
    assert got == {1: (3, 6, 9), 2: (3, 101, 103), 3: (3, 100, 104), 4: (None, None, 50), 5: (None,) * 3, 6: (3, 100, 104), 7: (None,) * 3}
