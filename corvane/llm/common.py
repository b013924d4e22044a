"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session of one machine gets a new folder of its own; a
    cluster, whose machines share no such folder, must name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def batches_by_bytes(spark: SparkSession, size: str = "16m") -> None:
    """Has Spark cut the batches that it hands to Python by their bytes, so that long texts don't add up in a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    It cuts the lineage as a checkpoint does, but stays columnar, and a lost
    executor costs a re-read only. The table goes when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/corvane-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def map_groups(
    df: DataFrame,
    keys: list[str],
    func: Callable[[dict[str, np.ndarray], pa.Table], dict | None],
    schema: StructType | str,
    batch_rows: int = 20_000,
) -> DataFrame:
    """Applies ``func`` to each group of ``df`` by its long, non-null ``keys``.

    The rows are shuffled by key and sorted, and each task streams through its
    groups, so many small groups cost little. Callers keep groups bounded.
    ``func`` gets the group's key values and its rows and returns columns.
    """
    out = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = out.fieldNames()
    types = [_arrow_type(f.dataType) for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        made: list[dict] = []
        rows = 0

        def flush() -> pa.RecordBatch:
            columns = []
            for n, t in zip(names, types, strict=True):
                parts = [m[n] for m in made]
                if isinstance(parts[0], np.ndarray):
                    columns.append(pa.array(np.concatenate(parts)).cast(t))
                else:
                    columns.append(pa.array([x for p in parts for x in p], t))
            return pa.RecordBatch.from_arrays(columns, names=names)

        def groups() -> Iterator[pa.Table]:
            nonlocal held
            for batch in batches:
                if not batch.num_rows:
                    continue
                t = pa.Table.from_batches([batch])
                if held is not None:
                    t = pa.concat_tables([held, t])
                cut = group_starts(t, keys)
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    yield t.slice(a, b - a)
                held = t.slice(cut[-1])
            if held is not None and held.num_rows:
                yield held

        for group in groups():
            got = func({k: group[k][0].as_py() for k in keys}, group)
            if got is not None and (n := len(got[names[0]])):
                made.append(got)
                rows += n
                if rows >= batch_rows:
                    yield flush()
                    made, rows = [], 0
        if made:
            yield flush()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, out)


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def group_starts(t: pa.Table, keys: Iterable[str]) -> list[int]:
    """Where runs of equal keys start in a sorted table."""
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        x = t[k].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new).tolist()


def matrix(column: pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """A list column whose lists have one length, as a matrix."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks)
    flat = a.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype, copy=False).reshape(len(a), -1)


def tiles(members: DataFrame, group: list[str], ident: list[str], block: int) -> DataFrame:
    """Deals the members of each group into pairs of blocks.

    A group of m members has ceil(m / block) blocks by a hash of ``ident``; a
    member goes to a tile for each other block of its group, so that each
    unordered pair of blocks meets once in a group (``group``, tile_a, tile_b)
    of about 2 * block rows. Column ``own`` is the member's block. Groups of
    any size are covered whole, and a small group is one tile.
    """
    sizes = members.groupBy(*group).agg(F.count(F.lit(1)).alias("tile_n"))
    dealt = members.join(sizes, group).withColumn("tile_nb", F.ceil(F.col("tile_n") / block))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(*ident), F.col("tile_nb")))
    dealt = dealt.withColumn("tile_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tile_nb") - 1)))
    return dealt.withColumns({"tile_a": F.least("own", "tile_j"), "tile_b": F.greatest("own", "tile_j")}).drop("tile_j", "tile_n", "tile_nb")


def union_find(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' components under the given links."""
    root = np.arange(n)
    while True:
        a, b = root[left], root[right]
        low = np.minimum(a, b)
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new
