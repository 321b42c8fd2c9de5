"""What the training-data operators share: tables in the shared folder, whole texts and row slices."""

import atexit
import ctypes
import shutil
import tempfile
import threading
import uuid
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a temporary one only in local mode where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = found.get() if found.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tallyspark-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


_HELD = threading.local()


def _scopes() -> list:
    """The open scopes of this thread, the innermost last."""
    return _HELD.__dict__.setdefault("scopes", [])


class Scope:
    """Tables written inside a ``with`` block go at its end, but for those kept: what is still read lazily afterwards.

    A kept table belongs to the block around it, if there is one, and else to the cluster's shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> "Scope":
        _scopes().append(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        path = df._tallyspark_path
        if path in self.paths:
            self.paths.remove(path)
            if len(_scopes()) > 1:
                _scopes()[_scopes().index(self) - 1].paths.append(path)
        return df

    def __exit__(self, *failure) -> None:
        _scopes().remove(self)
        for path in self.paths:
            _delete(self.spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing reads any more; other DataFrames stay as they are."""
    path = getattr(df, "_tallyspark_path", None)
    if path:
        _delete(df.sparkSession, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: it cuts the lineage and outlives any executor."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tallyspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes():
        _scopes()[-1].paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tallyspark_path = path
    return out


def whole_text(col: str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


@lru_cache(maxsize=1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def release() -> None:
    """Give memory that is free again back to the system: workers live on between tasks beside a full JVM."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def lean(f):
    """An Arrow function that leaves nothing but its result behind."""

    @wraps(f)
    def run(*columns):
        out = f(*columns)
        release()
        return out

    return run


def lean_rows(f):
    """The same for a function over batches."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            release()

    return run


def byte_tokens(texts: pa.Array, fold: bytes | None) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The row of every token and the tokens: what white space parts, after ``fold`` has mapped each byte."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    data = data[int(offsets[0]) : int(offsets[-1])].to_pybytes() if n and data is not None else b""
    offsets = pa.py_buffer((offsets - offsets[0]).astype(np.int32)) if n else pa.py_buffer(np.zeros(1, np.int32))
    folded = pa.Array.from_buffers(pa.string(), n, [None, offsets, pa.py_buffer(data.translate(fold) if fold else data)])
    listed = pc.ascii_split_whitespace(folded)
    flat = listed.flatten()
    owner = np.repeat(np.arange(n), pc.list_value_length(listed).to_numpy(zero_copy_only=False).astype(np.int64))
    some = pc.greater(pc.binary_length(flat), 0)
    return owner[some.to_numpy(zero_copy_only=False)], flat.filter(some).dictionary_encode()


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))


def rows_per_slice(lengths: np.ndarray, most: int):
    """Slices of consecutive rows whose lengths sum to about ``most`` (a longer row stands alone)."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield slice(start, len(lengths))
