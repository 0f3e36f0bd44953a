"""Scans and sinks."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Raw panel as delivered: one CSV per station and year, header row, "NA" nulls.
RAW_SCHEMA = T.StructType([
    T.StructField("No", T.IntegerType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("day", T.IntegerType()),
    T.StructField("hour", T.IntegerType()),
    T.StructField("PM2.5", T.DoubleType()),
    T.StructField("PM10", T.DoubleType()),
    T.StructField("SO2", T.DoubleType()),
    T.StructField("NO2", T.DoubleType()),
    T.StructField("CO", T.DoubleType()),
    T.StructField("O3", T.DoubleType()),
    T.StructField("TEMP", T.DoubleType()),
    T.StructField("PRES", T.DoubleType()),
    T.StructField("DEWP", T.DoubleType()),
    T.StructField("RAIN", T.DoubleType()),
    T.StructField("wd", T.StringType()),
    T.StructField("WSPM", T.DoubleType()),
    T.StructField("station", T.StringType()),
])


def csv_files(spark: SparkSession, path: str) -> list[str]:
    """The files under ``path`` (a file, folder or glob), in order, without those
    that Spark leaves out as well (names that begin with _ or a dot)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    out, todo = [], list(fs.globStatus(root) or [])
    while todo:
        st = todo.pop()
        if st.getPath().getName()[:1] in ("_", "."):
            continue
        if st.isDirectory():
            todo += list(fs.listStatus(st.getPath()))
        else:
            out.append(st.getPath().toString())
    return sorted(out)


def header_groups(spark: SparkSession, files: list[str]) -> dict[str, list[str]]:
    """The files of each header line. Only the first line of a file is read, on
    the driver, through its file system (and its codec, if it is compressed)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def header(f: str) -> str | None:
        p = jvm.org.apache.hadoop.fs.Path(f)
        stream, codec = p.getFileSystem(conf).open(p), codecs.getCodec(p)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
        try:
            return reader.readLine()
        finally:
            reader.close()

    groups: dict[str, list[str]] = {}
    with ThreadPoolExecutor(8) as pool:
        for f, line in zip(files, pool.map(header, files)):
            if line is not None and line.strip("\ufeff \t"):  # an empty file has no rows
                groups.setdefault(line, []).append(f)
    return groups


def read_raw_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA, require: Sequence[str] = ()) -> DataFrame:
    """S1 + U1: CSV scan with declared types; ``path`` may be a file, folder or
    glob over one file per station and year. Columns bind by header name, and
    each file by its own: files of one header are one scan, the scans are united
    by name. Columns that a file lacks are NULL in its rows, others are dropped;
    a file without one of the ``require`` columns raises. A value that isn't of
    its declared type is NULL and counts in ``malformed`` (see
    :func:`malformed_rows`). ``PM2.5`` becomes ``PM2_5``."""
    files = csv_files(spark, path)
    if not files:
        raise ValueError(f"no file at {path}")
    parts = [_typed_csv(spark, group, schema, require) for _, group in sorted(header_groups(spark, files).items())]
    out = parts[0] if parts else _typed_csv(spark, files[:1], schema, ())
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _typed_csv(spark: SparkSession, files: list[str], schema: T.StructType, require: Sequence[str]) -> DataFrame:
    """Files of one header."""
    raw = spark.read.option("header", True).option("nullValue", "NA").option("enforceSchema", False)
    names = raw.csv(files[0]).columns  # the header only: no types are inferred
    lacking = [c for c in require if c not in names]
    if lacking:
        raise ValueError(f"{files[0]} lacks the columns {lacking}")
    if not names:  # an empty file
        return spark.createDataFrame([], schema).select(
            *[F.col(f"`{f.name}`").alias(f.name.replace(".", "_")) for f in schema.fields], F.lit(0).alias("malformed"))
    text = raw.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(files)
    cols, bad = [], F.lit(0)
    for f in schema.fields:
        name = f.name.replace(".", "_")
        if f.name not in names:
            cols.append(F.lit(None).cast(f.dataType).alias(name))
            continue
        c = F.trim(F.col(f"`{f.name}`"))
        typed = c.try_cast(f.dataType)
        cols.append(typed.alias(name))
        bad = bad + (c.isNotNull() & typed.isNull()).cast("int")
    return text.select(*cols, bad.alias("malformed"))


def malformed_rows(df: DataFrame) -> DataFrame:
    """One row: rows with a malformed value, and such values in all."""
    return df.agg(F.count_if(F.col("malformed") > 0).cast("long").alias("rows"),
                  F.coalesce(F.sum("malformed"), F.lit(0)).cast("long").alias("cells"))


def read_panel(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Read a stored panel; ``split`` filters on the partition column, so
    only that directory is listed and read."""
    df = spark.read.parquet(path)
    return df.where(F.col("split") == split) if split else df


def write_panel(df: DataFrame, path: str, by_split: bool = True) -> None:
    """S3: Parquet sink, partitioned by ``split`` so each split is its own
    directory (partition pruning on read)."""
    w = df.write.mode("overwrite")
    if by_split and "split" in df.columns:
        w = w.partitionBy("split")
    w.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", "NA").csv(path)


def write_results(df: DataFrame, path: str, by: Sequence[str] = ("model", "split")) -> None:
    """Predictions or metrics, one folder for each model and split. Only the
    folders that ``df`` has rows for are replaced, whole: a rerun of one model
    overwrites its own part, however often it runs, and leaves all others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_results(spark: SparkSession, path: str, **only: str) -> DataFrame:
    """Results of :func:`write_results`; ``only`` names partition values
    (``model="gbt"``): other folders are not read."""
    df = spark.read.parquet(path)
    for c, v in only.items():
        df = df.where(F.col(c) == v)
    return df


def write_json(df: DataFrame, path: str) -> None:
    """Small result tables (comparison, metrics, parameters) as JSON;
    predictions go to Parquet with :func:`write_panel`."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_report(lines: DataFrame, path: str) -> None:
    """Report table ``(seq, line)`` written as text, one line per row."""
    lines.orderBy("seq").select(F.col("line").cast("string")).coalesce(1).write.mode("overwrite").text(path)


METADATA_SCHEMA = ("features map<string, map<string, struct<unit: string, range: string, missing_percentage: double>>>")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Nested dataset description -> one row per measured column
    ``(group, column, unit, value_range, missing_pct)``. Groups and columns are
    map keys, so one scan reads any document, whatever its names; fields that an
    entry lacks are NULL."""
    doc = spark.read.option("multiLine", True).schema(METADATA_SCHEMA).json(path)
    group = doc.select(F.explode("features").alias("group", "columns"))
    return group.select("group", F.explode("columns").alias("column", "d")).select(
        "group", "column", F.col("d.unit").alias("unit"), F.col("d.range").alias("value_range"),
        F.col("d.missing_percentage").alias("missing_pct"))


def assets_check(spark: SparkSession, expected: DataFrame, root: str) -> DataFrame:
    """Expected relative paths ``(path)`` anti-joined with the files
    present under ``root``; returns ``(path, present)`` for every expected file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("path").alias("full"))
    # The root as its file system writes it, however it was given.
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    prefix = fs.makeQualified(hadoop).toString().rstrip("/") + "/"
    files = files.where(F.startswith("full", F.lit(prefix))).select(F.substring("full", len(prefix) + 1, 1 << 20).alias("path"))
    missing = expected.join(files, "path", "left_anti").select("path", F.lit(False).alias("present"))
    found = expected.join(files, "path", "left_semi").select("path", F.lit(True).alias("present"))
    return found.unionByName(missing)


def overview(df: DataFrame, time: str = "datetime", target: str = "PM2_5") -> DataFrame:
    """Rows, time span and total nulls per split (or overall)."""
    nulls = sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
    aggs = [F.count(F.lit(1)).alias("rows"), F.min(time).alias("min_time"), F.max(time).alias("max_time"),
            F.lit(target in df.columns).alias("has_target"), F.sum(nulls).alias("total_nulls"),
            F.lit(len(df.columns)).alias("n_columns")]
    if "split" in df.columns:
        return df.groupBy("split").agg(*aggs)
    return df.agg(*aggs)
