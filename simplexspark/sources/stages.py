"""Stage hand-over: named Parquet stages, compute-once results, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File beside the data of a stage; readers pass over names that begin so.
MANIFEST = "_inputs"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_root: dict[str, str] = {}
_scope: ContextVar[list[str] | None] = ContextVar("stage_scope", default=None)


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate stages: what the cluster names in
    ``spark.checkpoint.dir``. A private temporary folder is used only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_root:
        _local_root[app] = tempfile.mkdtemp(prefix="simplexspark-")
    return _local_root[app]


def save_stage(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def load_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _file(spark: SparkSession, *path: str):
    """A path and the file system that holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(*path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def stage_exists(spark: SparkSession, path: str) -> bool:
    marker, fs = _file(spark, path, "_SUCCESS")
    return fs.exists(marker)


def fingerprint(spark: SparkSession, inputs: Sequence[str]) -> str:
    """Digest of name, length and time of every file under the input paths, whatever their order. The listing is a Spark
    job over file entries; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(inputs))
    mark = F.xxhash64("path", "length", "modificationTime")
    row = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.bit_xor(mark), F.lit(0)),
                    F.coalesce(F.sum(mark.cast("decimal(20,0)")), F.lit(0))).first()
    return " ".join(str(v) for v in row)


def _manifest(spark: SparkSession, path: str) -> str | None:
    at, fs = _file(spark, path, MANIFEST)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return stream.readUTF()
    finally:
        stream.close()


def materialise(spark: SparkSession, path: str, build: Callable[[], DataFrame], partition_by: Sequence[str] = (),
                inputs: Sequence[str] | None = None, version: str = "") -> DataFrame:
    """Build and write once; later calls reload. A half-written folder has no ``_SUCCESS``
    and is built again. With ``inputs`` (paths that ``build`` reads) the stage also holds their fingerprint and ``version``,
    which stands for the plan and its parameters: if either differs, or the mark is missing, it is built again. The mark is written
    last, so a job lost in between leaves a stage that the next call rebuilds. ``inputs`` must not hold ``path`` itself."""
    wanted = None if inputs is None else f"{version}\n{fingerprint(spark, inputs)}"
    if not stage_exists(spark, path) or (wanted is not None and _manifest(spark, path) != wanted):
        save_stage(build(), path, partition_by)
        if wanted is not None:
            at, fs = _file(spark, path, MANIFEST)
            stream = fs.create(at, True)
            try:
                stream.writeUTF(wanted)
            finally:
                stream.close()
    return load_stage(spark, path)


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Everything that ``cut`` writes inside is removed at the end, also after an error. Results that still read those stages
    must be written before: the last statement inside is an action or a write. Scopes nest; the innermost owns a stage. Jobs started from
    other threads are not in the scope."""
    made: list[str] = []
    token = _scope.set(made)
    try:
        yield made
    finally:
        _scope.reset(token)
        for path in made:
            at, fs = _file(spark, path)
            fs.delete(at, True)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What jobs inside have shuffled goes when they end. Otherwise Spark keeps it until the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def cut(df: DataFrame, label: str = "stage", partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: a flat lineage that
    survives the loss of executors, with real sizes for the planner's broadcast choice. Inside a ``stage_scope`` the folder
    goes with the scope, otherwise it is left to the clean-up rule of the scratch folder."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    made = _scope.get()
    if made is not None:
        made.append(path)
    with _shuffles_dropped(spark):
        df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
