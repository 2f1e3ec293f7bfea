"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Identifier lists up to this many rows (8 MB of longs) are broadcast, longer ones are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Rows an Arrow batch may hold, so that a batch of very long texts still fits a Python worker.
BATCH_ROWS = 1_000

#: Words are runs of anything but the six ASCII white-space characters; bytes.split() cuts at exactly these.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


#: What a worker process keeps from task to task. Tasks that have no use for it drop it, so that the stages of a
#: pipeline do not add up in a worker's memory.
WORKER_CACHE: dict = {}


def fresh_worker() -> None:
    if WORKER_CACHE:
        WORKER_CACHE.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Lower Spark's default Arrow batch length; a value that someone has set is left alone."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where the session names none, on a local master only."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="kawara-")
        context.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discarded(df: DataFrame) -> None:
    """Delete the table of a written() that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keyed(docs: DataFrame) -> DataFrame | None:
    """docs with a row_key of each row's own, in the order of doc_id (null last), then text; None if doc_id is one."""
    if not docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count():
        return None
    # the number tells equal rows apart, so that a range of the sort holds no more than its share of them
    order = [F.asc_nulls_last("doc_id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), "row_key"]
    rows = docs.withColumn("row_key", F.monotonically_increasing_id()).sort(*order)
    return written(rows.withColumn("row_key", F.monotonically_increasing_id()), "keyed")


def without_ids(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose key is not among ids. Short lists (counted first) are broadcast, which moves no row."""
    ids = ids.select(key).distinct()
    short = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if short else ids, key, "left_anti")


def with_ids(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose key is among ids, under the same rule."""
    ids = ids.select(key).distinct()
    short = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if short else ids, key, "left_semi")


def hashed_text(docs: DataFrame) -> DataFrame:
    """doc_id and the text's bytes, null as empty; columns are picked by name, so others may clash freely."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], keeps_cache: bool = False) -> DataFrame:
    """mapInArrow with a state of its own for each task: make() returns what turns a batch into columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps_cache:
            fresh_worker()
        step = make()
        for batch in batches:
            columns = step(batch)
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in target], schema=target)

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def filtered(docs: DataFrame, make: Callable[[], Callable[[list[bytes]], list[bool]]]) -> DataFrame:
    """The rows of docs, unchanged, whose text (null as empty) make()'s function keeps. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        keep = make()
        for batch in batches:
            texts = [(x or "").encode() for x in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep(texts), pa.bool_()))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


class WordHashes(dict):
    """xxhash of a word's bytes, remembered for the words seen lately."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: An odd base, so that it has an inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, a bijection: spreads every input bit over the whole word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Rabin-Karp hashes of all windows of a fixed length over word hashes, modulo 2**64, then mixed.

    With c[i] the sum of the first i words' hashes times BASE**-j, a window is (c[i + n] - c[i]) * BASE**(i + n - 1).
    """

    def __init__(self, length: int):
        self.length = length
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(1024, 1 << (n - 1).bit_length())
            one = np.ones(1, np.uint64)
            self.up = np.cumprod(np.concatenate([one, np.full(n - 1, BASE)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([one, np.full(n - 1, INVERSE)]), dtype=np.uint64)

    def __call__(self, words: np.ndarray) -> np.ndarray:
        n, k = len(words), self.length
        if n < k:
            return np.empty(0, np.uint64)
        self._powers(n)
        c = np.zeros(n + 1, np.uint64)
        np.cumsum(words * self.down[:n], dtype=np.uint64, out=c[1:])
        return mixed((c[k:] - c[:-k]) * self.up[k - 1 : n])


def covered(hits: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n words lie in a window that is marked in hits (one flag for each window start)."""
    steps = np.zeros(n + 1, np.int32)
    starts = np.flatnonzero(hits)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + length, -1)
    return np.cumsum(steps[:-1]) > 0
