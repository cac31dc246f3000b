"""What every operator needs from the session: inputs, shared tables, code on the executors."""

from __future__ import annotations

import atexit
import ctypes
import functools
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_OWN: str | None = None
#: Where the tables that were written are.
_STORED: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many underscores behind it as keep it apart from all columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session (one machine) that names none gets one of its own."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.match(r"local(\[|$)", conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    global _OWN
    if _OWN is None:
        _OWN = tempfile.mkdtemp(prefix="stratalog-")
        atexit.register(shutil.rmtree, _OWN, ignore_errors=True)
    return _OWN


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and makes what is read
    a plain scan, whose exchanges adaptive execution can split where a key is hot.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stratalog/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    _STORED[stored] = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Remove tables that ``materialise`` wrote, once all that was made of them has been written itself."""
    for df in stored:
        jvm, path = df.sparkSession._jvm, _STORED.pop(df)
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="stratalog-code-")) / "stratalog.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


Batches = Iterator[pa.RecordBatch]


def release() -> None:
    """Give back to the system what this process has freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for mapInArrow; a worker that idles after its task doesn't hold on to the memory of that task's batches."""

    @functools.wraps(run)
    def whole(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            release()

    return whole
