"""Plumbing that the corpus operators share: stored intermediates and group-aligned Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than one in so many rows is hot.
HOT_SHARE = 1_000

_own_root: dict[str, str] = {}
#: In a worker process: the operator whose task ran last, and how to drop what it remembers.
_holder: list = []
_stored: list[str] = []


try:  # glibc keeps what is freed unless it is asked
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):
    _trim = None


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode a folder of our own."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        folder = tempfile.mkdtemp(prefix="kymo-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_root[app] = f"file://{folder}"
    return _own_root[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: later jobs survive lost executors and don't repeat its work."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stored.append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """many joined with the row that one has for its key; one counts the key's rows in its column n, which is left out.

    Keys with more than a thousandth of the total rows of many, fewer than a thousand, are joined by broadcast, so that their rows stay
    spread; the others by a shuffle, none of whose keys then holds more than that thousandth.
    """
    hot = F.broadcast(one.where(F.col("n") > total / HOT_SHARE).drop("n"))
    few = many.join(hot, keys, "inner")
    rest = many.join(hot.select(*keys), keys, "left_anti")
    return few.unionByName(rest.join(one.where(F.col("n") <= total / HOT_SHARE).drop("n"), keys, how))


def discard(df: DataFrame) -> None:
    """Delete what stored() wrote for df; only for tables that no later plan reads."""
    path = getattr(df, "stored_at", None)
    if path and path in _stored:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
        _stored.remove(path)


def discard_all(spark: SparkSession) -> None:
    """Delete every stored intermediate of this process, once no result that reads them is needed."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    while _stored:
        at = jvm.org.apache.hadoop.fs.Path(_stored.pop())
        at.getFileSystem(conf).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def claim(owner: str, forget: Callable[[], None] = lambda: None) -> None:
    """Called as an operator's task begins in a worker: what another operator remembers there is dropped.

    Workers are used again and again; memory is thus bounded by one operator's, not by all that ran before.
    """
    if _holder and _holder[0] != owner:
        _holder[1]()
        gc.collect()
        hand_back()
    _holder[:] = [owner, forget]


def hand_back() -> None:
    """What a worker has freed goes back to the machine."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of so many rows, so that a piece's Python objects are few."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Batches sorted by keys, dealt anew so that no group of equal keys spans two tables."""
    carry: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table[k].combine_chunks() for k in keys]
        end = tuple(c[-1].as_py() for c in columns)
        if last is not None and end == last and tuple(c[0].as_py() for c in columns) == last:
            carry.append(table)
            continue
        starts = group_starts([c.to_numpy(zero_copy_only=False) for c in columns])
        cut = int(starts[-1])
        whole = pa.concat_tables([*carry, table.slice(0, cut)])
        if whole.num_rows:
            yield whole
        carry, last = [table.slice(cut)], end
        continue
    if carry:
        yield pa.concat_tables(carry)


def group_starts(columns: list[np.ndarray]) -> np.ndarray:
    """Row numbers at which a new group of equal values begins."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, dtype=np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def table_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
