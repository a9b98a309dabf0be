"""Shared helpers: tables in the shared folder, hold-out folds, hash filters of fixed size."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL_ROOTS: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which every executor reaches; unset, a temporary folder, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="llm-")
    return _LOCAL_ROOTS[app]


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and its size is known to the planner.

    The shuffle files of the write go when it ends; else they stay until the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/llm/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `stored` returned, after their last reader."""
    for table in tables:
        context = table.sparkSession.sparkContext
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            if re.fullmatch(r".*/llm/[0-9a-f]{32}", folder):
                path = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(folder))
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def sample_rows(df: DataFrame, id_col: str, limit: int) -> DataFrame:
    """At most limit rows, those with the smallest hash of the id.

    Rows whose hash is beyond four times the expected cut are left out first, so that what all tasks send on
    together is bounded by the limit, not by their number."""
    range_ = 1 << 40
    drawn = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(range_))
    cut = range_ * min(1.0, 4 * limit / max(1, df.count()))
    return df.filter(drawn <= int(cut)).orderBy(drawn, F.col(id_col)).limit(limit)


_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def release() -> None:
    """Give memory that a task no longer uses back to the system. Python workers live on, and the next stage finds it free."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_texts(docs: DataFrame, id_col: str, text_col: str, worker, columns: str, rows_at_once: int = 512,
              chars_at_once: int = 1 << 21, tidy: bool = False) -> DataFrame:
    """doc_id plus the columns that worker() computes from texts, one row per row of docs, in Arrow batches.

    worker() is called once per task and returns a function from a list of texts (null as "") to a list of columns;
    it sees at most rows_at_once texts at a time, and no more than chars_at_once characters unless one text is longer. Only the two named columns of docs are read.
    A tidy task releases its memory at its end."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    picked = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = picked.schema["doc_id"].dataType.simpleString()
    schema = T._parse_datatype_string(f"doc_id {id_type}, {columns}")
    arrow = to_arrow_schema(schema)

    def run(batches):
        step = worker()
        for whole in batches:
            texts = whole.column(1).to_pylist()
            for start, end in cuts(texts, rows_at_once, chars_at_once):
                part = whole.slice(start, end - start)
                out = step(texts[start:end])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0)] + [pa.array(v, type=f.type) for v, f in zip(out, list(arrow)[1:], strict=True)],
                    schema=arrow)
        if tidy:
            whole = texts = part = out = step = None
            release()

    return picked.mapInArrow(run, schema)


def cuts(texts: list[str], rows: int, chars: int):
    start = held = 0
    for i, t in enumerate(texts):
        if i > start and (i - start >= rows or held + len(t) > chars):
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


FILTER_CELLS = 1 << 20


def semi_filter(df: DataFrame, col: str, wanted: DataFrame, wanted_col: str) -> DataFrame:
    """The rows of df whose hash cell also holds a value of wanted: all wanted rows, and few others as long as wanted is
    small. At most FILTER_CELLS numbers are broadcast, whatever the input; an exact join has to follow."""
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_CELLS))
    cells = stored(wanted.select(cell(wanted_col).alias("cell")).distinct())
    return df.join(F.broadcast(cells), cell(col) == F.col("cell"), "left_semi")


def drop_rows(df: DataFrame, col: str, dropped: DataFrame, dropped_col: str, also: Column | None = None) -> DataFrame:
    """The rows of df without an equal value in dropped (and with `also` true for the pair). Rows outside the hash cells of
    dropped pass without a shuffle; nulls equal nothing and pass."""
    name = "_cell"
    while name in df.columns:
        name += "_"
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_CELLS))
    cells = F.broadcast(stored(dropped.select(cell(dropped_col).alias(name)).distinct()))
    on = df[col] == dropped[dropped_col]
    inside = cell(df[col]) == F.col(name)
    near = df.join(cells, inside, "left_semi").join(dropped, on if also is None else on & also, "left_anti")
    return df.join(cells, inside, "left_anti").unionByName(near)
