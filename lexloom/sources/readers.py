"""Sources: delimited text, JSON in four shapes, plain text, vectors."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


def null_strings(df: DataFrame, na: Sequence[str] = schemas.NA_STRINGS, columns: Sequence[str] | None = None) -> DataFrame:
    """Strings of the missing-value set become null."""
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)]
    return df.withColumns({c: F.when(~F.col(c).isin(*na), F.col(c)) for c in strings}) if strings and na else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", na: Sequence[str] = (), multi_line: bool = True) -> DataFrame:
    """Delimited text with a header and doubled quotes.  Fields may hold line
    breaks with ``multi_line``, for which a file is read by one task; without,
    a file is split.  An absent field is null."""
    df = spark.read.csv(path, schema=schema, sep=sep, header=True, multiLine=multi_line, quote='"', escape='"', enforceSchema=True)
    return null_strings(df, na)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType, na: Sequence[str] = schemas.NA_STRINGS) -> DataFrame:
    """Headerless tab-separated text with given names.  Quotes are ordinary
    characters, so a stray one can't swallow a field."""
    return null_strings(spark.read.csv(path, schema=schema, sep="\t", header=False, quote=""), na)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A row for each line; a line that doesn't parse gives nulls."""
    return spark.read.schema(schema).json(path)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A row for each item of a file's array; a file is read by one task."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_keyed_json(spark: SparkSession, path: str, value: T.StructType, key: str = "pmid") -> DataFrame:
    """One object of objects: a row for each key; a file is read by one task."""
    text = spark.read.text(path, wholetext=True)
    whole = text.select(F.from_json("value", T.MapType(T.StringType(), value)).alias("m"))
    return whole.select(F.explode("m").alias(key, "v")).select(key, "v.*")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A row for each line, empty ones too."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file: path, text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def rows_as_documents(df: DataFrame, source: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Each row as a document of "column: value" lines, its source in the
    metadata.  A null value prints as nothing."""
    columns = list(columns or [c for c in df.columns if c != source])
    lines = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    return df.select(F.concat_ws("\n", *lines).alias("page_content"), F.create_map(F.lit("source"), F.col(source).cast("string")).alias("metadata"))


def rows_by_position(df: DataFrame, order: Sequence[str], offset: int, n: int) -> DataFrame:
    """``n`` rows from ``offset`` on in a stated order."""
    return df.orderBy(*order).offset(offset).limit(n)


def from_rows(spark: SparkSession, rows: Iterable, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def open_vectors(spark: SparkSession, path: str) -> DataFrame:
    """A stored vector collection."""
    return spark.read.parquet(path)


def read_span_annotations(spark: SparkSession, path: str) -> DataFrame:
    """``{"classes": [..], "annotations": [[text, {"entities": [[s, e, l]]}]]}``
    as rows of text and spans.  The pair mixes types, so it is read as strings
    first and its parts parsed after."""
    whole = spark.read.text(path, wholetext=True)
    parsed = whole.select(F.from_json("value", "annotations array<array<string>>").alias("a"))
    pairs = parsed.select(F.explode("a.annotations").alias("p"))
    spans = F.from_json(F.get("p", F.lit(1)), "entities array<array<string>>")["entities"]
    as_span = lambda x: F.struct(F.get(x, F.lit(0)).cast("int").alias("start"), F.get(x, F.lit(1)).cast("int").alias("end"), F.get(x, F.lit(2)).alias("label"))
    return pairs.select(F.get("p", F.lit(0)).alias("text"), F.transform(spans, as_span).alias("entities"))


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any store that Spark reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)
    return sorted(x.getPath().getName() for x in found)


def copy_into(spark: SparkSession, source: str, folder: str) -> str:
    """Copies a file into a data folder and returns its new path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a = jvm.org.apache.hadoop.fs.Path(source)
    b = jvm.org.apache.hadoop.fs.Path(folder, a.getName())
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)
    return b.toString()
