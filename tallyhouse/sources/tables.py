"""Delimited sources: capture CSVs, public registers, account lists and labelled corpora."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN_END = "2050-01-01 00:00:00"


def load_concat_csv(
    spark: SparkSession, path: str, schema: T.StructType | str, pattern: str = "*.csv", bad_rows: str | None = None
) -> DataFrame:
    """All CSVs below ``path`` as one table, each row with the path of its file as ``filename``.

    Texts and bad rows are treated as by ``robust_load_csv``.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return _quoted_csv(reader, path, schema, bad_rows).select("*", F.col("_metadata.file_path").alias("filename"))


def _quoted_csv(reader: DataFrameReader, path: str, schema: T.StructType | str, bad_rows: str | None) -> DataFrame:
    reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    if bad_rows is None:
        return reader.option("mode", "FAILFAST").schema(schema).csv(path)
    known = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*known.fields, T.StructField(bad_rows, T.StringType())])
    return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad_rows).schema(full).csv(path)


def robust_load_csv(spark: SparkSession, path: str, schema: T.StructType | str, bad_rows: str | None = None) -> DataFrame:
    """CSV whose quoted texts may hold carriage returns, line breaks and doubled quotes.

    A row that does not fit the schema stops the job, or is kept whole in the column named by ``bad_rows``. Since
    a line break may stand inside a text, a file is read by one task: keep files to some hundred megabytes, and
    convert a corpus to Parquet once.
    """
    return _quoted_csv(spark.read, path, schema, bad_rows)


def load_register(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str,
    columns: Sequence[str] | None = None,
    sep: str = ";",
    encoding: str = "ISO-8859-1",
    header: bool = True,
) -> DataFrame:
    """Public register file: ``;`` separated, Latin-1. Only ``columns`` are parsed."""
    df = (
        spark.read.option("sep", sep)
        .option("encoding", encoding)
        .option("header", header)
        .schema(schema)
        .csv(list(path) if not isinstance(path, str) else path)
    )
    return df.select(*columns) if columns else df


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files, or directories of part files, in one folder (metadata only)."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(n for n in names if not n.startswith((".", "_")))


def load_register_dir(spark: SparkSession, folder: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Folder of register files as one table.

    A single national file (``BRASIL`` in its name) wins over the state files, ``.txt``
    files have no header and take their names from ``header.txt``, and a folder mixing
    both extensions is an error.
    """
    names = [n for n in list_files(spark, folder) if n.endswith((".txt", ".csv"))]
    txt = [n for n in names if n.endswith(".txt")]
    if txt and len(txt) != len(names):
        raise ValueError("the folder holds both TXT and CSV files")
    data = [n for n in names if "header" not in n]
    national = [n for n in data if "BRASIL" in n]
    if len(national) > 1:
        raise ValueError("more than one national file")
    chosen = [f"{folder}/{n}" for n in (national or data)]
    if schema is None and txt:
        head = spark.read.option("encoding", "ISO-8859-1").text(f"{folder}/header.txt").first()[0]
        schema = T.StructType([T.StructField(c.strip().strip('"'), T.StringType()) for c in head.split(";")])
    if schema is None:
        return spark.read.option("sep", ";").option("encoding", "ISO-8859-1").option("header", True).csv(chosen)
    return load_register(spark, chosen, schema, header=not txt)


def load_pool_sources(spark: SparkSession, path: str) -> DataFrame:
    """Validity interval of each account list; a list in use has no end yet."""
    raw = spark.read.option("header", True).schema("file STRING, first_batch STRING, last_batch STRING").csv(path)
    return raw.select(
        "file",
        F.to_timestamp_ntz("first_batch").alias("first_batch"),
        F.to_timestamp_ntz(F.coalesce("last_batch", F.lit(OPEN_END))).alias("last_batch"),
    )


def load_pools(spark: SparkSession, root: str, schema: T.StructType | str) -> DataFrame:
    """Every account list below ``root`` in long form, one ``file`` value per list."""
    rows = load_concat_csv(spark, root, schema)
    return rows.select(F.regexp_extract("filename", r"([^/=]+?)(?:\.csv)?(?:/part-[^/]*)?$", 1).alias("file"), *[
        c for c in rows.columns if c != "filename"
    ])


def load_group_data(spark: SparkSession, path: str, schema: T.StructType | str, prefix: str) -> DataFrame:
    """Union of sample files, the group being what follows ``prefix`` in the path."""
    rows = load_concat_csv(spark, path, schema)
    return rows.withColumn("group", F.regexp_extract("filename", prefix + r"([^/.]+)", 1)).drop("filename")


def read_labelled_arff(spark: SparkSession, path: str, columns: Sequence[str] = ("label", "text")) -> DataFrame:
    """Labelled texts in ARFF: header lines dropped, ``'`` quotes, yes/no turned to 1/0."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").rlike("^[@%]"))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    row = F.from_csv("value", schema.simpleString()[len("struct<"):-1].replace(":", " "), {"quote": "'", "escape": "\\"})
    label = F.col(columns[0])
    return lines.select(row.alias("_r")).select("_r.*").withColumn(
        columns[0], F.when(label == "yes", 1).when(label == "no", 0)
    )
