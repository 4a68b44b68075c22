"""Session helpers shared by all operators: reading tables and cutting lineage."""

from __future__ import annotations

import math
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` below `sf_dir`; any URI Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a folder of our own, on one machine only."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not known:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        sc.setCheckpointDir(known)
        known = sc.getCheckpointDir()
    return known.rstrip("/")


#: Spark deletes a query's shuffle files when it ends, not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end_with_query(spark: SparkSession) -> Iterator[None]:
    """Queries started within leave no shuffle files behind."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


#: Seconds from one time that the driver gives memory back to the next; one takes some hundredths of a second.
TRIM_EVERY = 5

_trimmed = -math.inf


def trim_driver(spark: SparkSession) -> None:
    """Give native memory that the driver's JVM has freed back to the system, where it is a HotSpot on Linux.

    Over many queries the JVM's C allocator keeps ever more of what was freed.
    """
    global _trimmed
    if time.monotonic() - _trimmed < TRIM_EVERY:
        return
    _trimmed = time.monotonic()
    sc = spark.sparkContext
    try:
        lang, beans = sc._jvm.java.lang, sc._jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # by reflection: the server's own class is not a public one
        invoke = next(m for m in lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
        arguments = sc._gateway.new_array(lang.Object, 4)
        arguments[0], arguments[1] = sc._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(beans, arguments)
    except Exception:  # a JVM without this command
        _trimmed = math.inf


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back.

    Cuts the lineage (a lost executor only costs the tasks that were reading)
    and keeps a costly plan from being computed once per consumer. The files of
    the shuffles behind it go once it is written, and so does the memory that
    the driver has freed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    with shuffles_end_with_query(spark):
        df.write.parquet(path)
    trim_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by `materialize` that nothing will read again."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/tables/" in path:
                p = sc._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of a column that a function of `vectorized` gets at a time (one longer value comes alone).
SLICE_BYTES = 1 << 20


def vectorized(return_type: str):
    """A UDF of one column that is made when it is first applied: making one needs a session, importing a module must not.

    It is written for a pandas Series and gets slices of the batch, so what
    lives as Python objects is bounded whatever a batch holds.
    """

    def make(f):
        @wraps(f)
        def apply(column):
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_type
            from pyspark.sql.types import DataType

            kind, most = to_arrow_type(DataType.fromDDL(return_type)), SLICE_BYTES

            # within, so that workers get them by value and need not import this module
            def slices(values):
                if len(values) > 1 and values.nbytes > most:
                    half = len(values) // 2
                    yield from slices(values[:half])
                    yield from slices(values[half:])
                elif len(values):
                    yield values

            def run(values: pa.Array) -> pa.Array:
                import ctypes

                import pandas as pd

                made = []
                for part in slices(values):
                    out = f(pd.Series(part.to_pylist(), dtype=object))
                    made.append(pa.array(out.to_dict("records") if isinstance(out, pd.DataFrame) else out.tolist(), kind, from_pandas=True))
                if values.nbytes > most:  # workers stay, idle, beside the next stage's
                    pa.default_memory_pool().release_unused()
                    try:
                        ctypes.CDLL(None).malloc_trim(0)
                    except (AttributeError, OSError):  # not glibc
                        pass
                return pa.concat_arrays(made) if made else pa.array([], kind)

            run.__annotations__ = {"values": pa.Array, "return": pa.Array}
            return F.arrow_udf(run, return_type)(column)

        return apply

    return make
