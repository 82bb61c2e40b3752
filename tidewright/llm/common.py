"""Helpers shared by the operators: shared-folder tables and size-checked joins."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Tables of up to so many bytes, by counted rows and their width, may be broadcast.
BROADCAST_BYTES = 16_000_000
#: Texts that a worker looks at together, and rows of texts that reach it at once.
TEXTS, BATCH_ROWS = 512, 2000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; where the session has Spark's own batch size, batches are made small enough for long texts."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only on one machine, as in tests; an error on a cluster without one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.startswith("local"):
        found = tempfile.mkdtemp(prefix="tidewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps, which it does once the driver has collected what refers to them."""
    gc.collect()
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def drop_stored(df: DataFrame) -> None:
    """Delete a table made by :func:`store` that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_ids(df: DataFrame, ids: DataFrame, n_ids: int, on: str | list[str], how: str, width: int = 8) -> DataFrame:
    """Join a large table with a keyed one of ``n_ids`` rows of ``width`` bytes: broadcast when these are few, else shuffled."""
    return df.join(F.broadcast(ids) if n_ids * width <= BROADCAST_BYTES else ids.hint("merge"), on, how)


def _free_memory(start: bool) -> None:
    """Let a worker give memory back: large blocks are mapped on their own, the rest is trimmed when a task ends."""
    try:
        if start:
            pa.set_memory_pool(pa.system_memory_pool())
            ctypes.CDLL(None).mallopt(-3, 1 << 20)
        else:
            ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` on a task's batches, after which the reused worker keeps no more memory than it needs."""

    def run(parts: Iterator) -> Iterator:
        _free_memory(start=True)
        try:
            yield from work(parts)
        finally:
            _free_memory(start=False)

    return run


def map_texts(docs: DataFrame, start: Callable[[], Callable[[list], dict]], added: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` (all by default) and the ``added`` ones, which a worker's function makes from lists of texts.

    ``start`` is called once a task.  Its function gets a list of texts and returns lists by column name, and under
    ``None`` the positions of the texts that the rows come from, where they are not one for each text.
    The kept columns never leave Arrow, so ids and other values stay as they are whatever nulls stand beside them.
    """
    keep = docs.columns if keep is None else keep
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`"))
    new = StructType.fromDDL(added)
    schema = StructType([*docs.select(*[F.col(f"`{c}`") for c in keep]).schema.fields, *new.fields])
    arrow = to_arrow_schema(new)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for part in parts:
            for s in range(0, part.num_rows, TEXTS):
                now = part.slice(s, TEXTS)
                made = work(now.column(now.num_columns - 1).to_pylist())
                kept = pa.RecordBatch.from_arrays(now.columns[:-1], schema=pa.schema(list(now.schema)[:-1]))
                at = made.pop(None, None)
                if at is not None:
                    kept = kept.take(pa.array(at, pa.int64()))
                cells = [pa.array(made[f.name], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays([*kept.columns, *cells], schema=pa.schema([*kept.schema, *arrow]))

    return source.mapInArrow(tidy(run), schema)


class Cache:
    """Values by key in two generations, each bounded by the bytes its entries are counted with; the older one goes when the younger is full."""

    def __init__(self, most: int = 30_000_000):
        self.most, self.young, self._old, self._held = most, {}, {}, 0

    def get(self, key):
        """The value or None; one of the older generation becomes young again."""
        found = self.young.get(key)
        if found is None and (found := self._old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value, size: int = 0) -> None:
        """``size``: bytes of key and value beside their objects."""
        if self._held > self.most:
            self.young, self._old, self._held = {}, self.young, 0
        self.young[key] = value
        self._held += 180 + (size or 2 * len(key))
