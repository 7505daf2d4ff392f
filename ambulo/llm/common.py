"""What several operators share: checkpoint folder, word spans, rolling hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Multipliers of the rolling hashes; any odd 64-bit numbers would do.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xC2B2AE3D27D4EB4F


#: Rows of an Arrow batch, at most: with texts of some 100 KB a batch stays within some 100 MB.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's spark.sql.execution.arrow.maxRecordsPerBatch to BATCH_ROWS, if it is more: texts may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir.

    Where none is set a local session, whose tasks run on the driver's machine,
    gets a temporary folder; on a cluster that is an error.  Every operator that
    writes asks for it, so this also bounds the session's Arrow batches.
    """
    small_batches(spark)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Tables that ``written`` made and ``remove_written`` hasn't removed.
_TABLES: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: for large results, which it compresses and reads by column.

    The table stays until remove_written, as what is made of it is read later.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    _TABLES.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df (written already, a few numbers a row), marked for broadcast if it has at most so many rows; else as it is, to be joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def tables_written() -> int:
    """How many tables of ``written`` there are."""
    return len(_TABLES)


def remove_written(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables that ``written`` made, but for the first ``since``; call it when the results that rest on them are stored."""
    while len(_TABLES) > since:
        remove(spark, _TABLES.pop())


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(doc_id long, text_hash long, text): each text of a doc_id once; rows with a null in either are left out.

    Only the texts of rows that do repeat are shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").where("doc_id is not null and text is not null")
    again = cut_lineage(rows.groupBy("doc_id", "text_hash").count().where("count > 1").drop("count"))
    if again.isEmpty():
        return rows
    keys, again = ["doc_id", "text_hash"], small(again)
    return rows.join(again, keys, "left_anti").unionByName(rows.join(again, keys, "left_semi").dropDuplicates(keys))


def byte_rows(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    """The UTF-8 bytes of each text of a batch, b"" for null."""
    for value in batch.column(column).cast(pa.binary()):
        yield value.as_py() or b""


def parts_of(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows, so that a worker holds the results of few texts at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


#: Bits of the filter by doc_id.
ID_BITS = 1 << 20


def with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs (doc_id long, not null) that can have one of ids (doc_id long), before they are joined.

    A bitmap of ID_BITS bits, at most, goes to all tasks; it may pass other
    rows but never drops one that has an id.
    """
    slots = ids.select(F.pmod("doc_id", F.lit(ID_BITS)).cast("int").alias("slot")).distinct().toArrow().column(0).to_numpy()
    bits = np.zeros(ID_BITS, bool)
    bits[slots] = True
    packed = np.packbits(bits).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(np.frombuffer(packed, np.uint8)).view(bool)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(held[ids & (ID_BITS - 1)]))

    return docs.mapInArrow(run, docs.schema)


def mix64(h: np.ndarray) -> np.ndarray:
    """Spread the bits of each 64-bit number (xor-shift and multiply, a bijection)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.size = base, 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            self.size = max(n, 2 * self.size, 4096)
            self.up = self._table(self.base)
            self.down = self._table(pow(self.base, -1, 1 << 64))
        return self.up, self.down

    def _table(self, base: int) -> np.ndarray:
        steps = np.full(self.size, base, np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the words: runs without bytes 9 to 13 and 32."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span, from one prefix sum."""
    up, down = powers.upto(len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up[: len(values)], out=prefix[1:])
    return mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: bytes, powers: Powers) -> np.ndarray:
    """A 64-bit hash of each word of a text."""
    data = np.frombuffer(text, np.uint8)
    starts, ends = word_spans(data)
    return span_hashes(data, starts, ends, powers) if len(starts) else np.zeros(0, np.uint64)


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """min(a[i:i + width]) for every whole window, in O(n log width)."""
    span = 1
    while span * 2 <= width:
        a = np.minimum(a[:-span], a[span:])
        span *= 2
    rest = width - span
    return np.minimum(a[: len(a) - rest], a[rest:]) if rest else a


def minimisers(h: np.ndarray, window: int, equal: bool = False) -> np.ndarray:
    """Positions that hold the smallest hash of some window of ``window`` hashes.

    Any ``window`` consecutive hashes that two sequences share put at least
    one common position in both.  Fewer hashes than a window form one window.
    Of a run of equal neighbours only the first stays, unless ``equal``.
    """
    n = len(h)
    if n == 0:
        return np.zeros(0, np.int64)
    if n <= window:
        chosen = h == h.min()
    else:
        least = sliding_min(h, window)
        padded = np.zeros(len(least) + 2 * (window - 1), np.uint64)
        padded[window - 1 : window - 1 + len(least)] = least
        chosen = ~sliding_min(~padded, window) == h
    if not equal:
        chosen[1:] &= h[1:] != h[:-1]
    return np.flatnonzero(chosen)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row, whatever uses it.

    The optimizer copies a plain column's expression into filters and lambda
    bodies, where it would be evaluated for every element of an array.  It
    doesn't look through a generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
