"""Tables between the steps of a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.session import write_through

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder. The shuffle files of the job that
    writes it go when it ends: from then on the table stands for them."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return write_through(df)
    finally:
        conf.set(CLEANUP, before)


def discarded(table: DataFrame) -> None:
    """Delete a :func:`saved` table before its application ends: nothing reads it from here on."""
    spark = table.sparkSession
    for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def whole_row(df: DataFrame, *but: str) -> Column:
    """All columns of ``df`` (but some) as one, named ``row``: out of the way of an
    operator's own names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in but]).alias("row")


def own_column(name: str) -> Column:
    """A column of a :func:`whole_row`."""
    return F.col(f"row.`{name}`").alias(name)


def free_name(name: str, taken: list[str]) -> str:
    """``name`` with as many underscores as it takes."""
    while name in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
