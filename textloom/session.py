"""Session helpers: where intermediate tables go, and a session for local runs."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Session option: deal small input tables out over so many tasks.
REPARTITION = "spark.textloom.inputPartitions"
_local_folder: str | None = None
_shipped: set[str] = set()


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench. On a cluster, bring your own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("textloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config(REPARTITION, cores)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: What goes to a Python worker at once: rows by their bytes, as texts may be long.
BATCH_BYTES, BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application, and keep
    what is sent to them small (a smaller limit of the session stays)."""
    if int(spark.conf.get(BATCH_BYTES).rstrip("b") or 0) > BATCH_LIMIT:
        spark.conf.set(BATCH_BYTES, str(BATCH_LIMIT))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = pathlib.Path(__file__).parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="textloom-zip-")) / "textloom.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, str(source.relative_to(package.parent)))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Executors may disappear, so a machine-local folder is accepted only when the
    whole session is local and names none, as in tests.
    """
    global _local_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="textloom-")
    return _local_folder


def write_through(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, survives lost executors, and keeps column pruning for the
    readers of the table.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    # readers are lazy, so the table goes when the application ends
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)
