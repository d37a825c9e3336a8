"""CSV files of analytics rows and prediction reports: six decimals, an empty cell where there is no value."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaybook.functions.columns import six_places
from quaybook.schema import ANALYTICS, REPORT


def _write_one(df: DataFrame, path: str, header: tuple[str, ...], order: list[str]) -> None:
    """Write rows, by ``order``, as the single file ``path`` on its own file system; raises where that is impossible."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parent = target.getParent()
    if parent is not None and not files.exists(parent):
        raise OSError(f"cannot open {path} for writing")
    aside = f"{path}.{uuid.uuid4().hex}.parts"
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in header])
    rows = df.select(F.struct(*order).alias("place"), line.alias("value"))
    # the names have no place, and so come first
    names = spark.createDataFrame([(",".join(header),)], "value string").select(F.lit(None).cast(rows.schema["place"].dataType).alias("place"), "value")
    names.union(rows).repartition(1).sortWithinPartitions(F.col("place").asc_nulls_first()).select("value").write.text(aside)
    try:
        part = next(s.getPath() for s in files.listStatus(jvm.org.apache.hadoop.fs.Path(aside)) if s.getPath().getName().startswith("part-"))
        if files.exists(target):
            files.delete(target, False)
        if not files.rename(part, target):
            raise OSError(f"cannot open {path} for writing")
    finally:
        files.delete(jvm.org.apache.hadoop.fs.Path(aside), True)


def analytics_text(rows: DataFrame) -> DataFrame:
    """The analytics columns as they are written."""
    return rows.select("symbol", "seq", *[(six_places(F.col(c)) if t == "double" else F.col(c)).alias(c) for c, t in ANALYTICS])


def write_analytics_csv(rows: DataFrame, path: str) -> None:
    """One file in message order; for output of any size use :func:`write_analytics`."""
    names = tuple(c for c, _ in ANALYTICS)
    _write_one(analytics_text(rows), path, names, ["symbol", "seq"])


def write_analytics(rows: DataFrame, path: str) -> None:
    """A folder of CSV files, each with the header, one part of the order in each."""
    analytics_text(rows).orderBy("symbol", "seq").write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_prediction_report_csv(report: DataFrame, path: str) -> None:
    text = report.select(F.monotonically_increasing_id().alias("place"), *[(six_places(F.col(c)) if c in REPORT[-3:] else F.col(c)).alias(c) for c in REPORT])
    _write_one(text, path, REPORT, ["place"])


def backend_output_path(base: str, backend: str, several: bool) -> str:
    """``base``, with the backend's name before the last dot of its file name if several backends write."""
    if not several:
        return base
    folder, slash, name = base.rpartition("/")
    stem, dot, suffix = name.rpartition(".")
    return f"{folder}{slash}{stem}_{backend}.{suffix}" if dot else f"{folder}{slash}{name}_{backend}.csv"
