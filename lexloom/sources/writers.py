"""Sinks: delimited text, JSON, span corpora, folds, and safe rewriting."""

from __future__ import annotations

import html
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import number_rows


def write_csv(df: DataFrame, path: str, index: bool = False, order: Sequence[str] = ()) -> None:
    """CSV with a header; ``index`` puts an unnamed running number first, in the
    given order, or in the order of the columns' values where none is given, as
    a distributed table has no order of its own.  An empty table writes a header
    or no file; nulls are written as empty fields."""
    if index:
        names = df.columns
        df = number_rows(df, [F.col(f"`{c}`") for c in order or names], "_index").select(F.col("_index").alias(""), *(F.col(f"`{c}`") for c in names))
    df.write.mode("overwrite").option("escape", '"').csv(path, header=True)


def append_rows(df: DataFrame, path: str) -> None:
    """Appends to a table; the schema is stored once, so no header repeats."""
    df.write.mode("append").parquet(path)


def remaining(df: DataFrame, done_path: str, key: str) -> DataFrame:
    """Rows whose key the table at ``done_path`` doesn't hold yet; a null key is
    done once any row with a null key is."""
    spark = df.sparkSession
    if not exists(spark, done_path):
        return df
    done = spark.read.parquet(done_path).select(F.col(key).alias("_done"))
    return df.join(done, F.col(key).eqNullSafe(F.col("_done")), "left_anti")


def resume(df: DataFrame, done_path: str, key: str, step: Callable[[DataFrame], DataFrame]) -> None:
    """Applies a costly step to the rows that are not done and appends its rows,
    so a job that broke off goes on where it stopped."""
    append_rows(step(remaining(df, done_path, key)), done_path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def json_array(df: DataFrame, limit: int = 10_000) -> str:
    """A small table as one JSON array; refuses tables over ``limit`` rows."""
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("j")).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; use write_json_lines")
    return json.dumps([json.loads(r.j) for r in rows], ensure_ascii=False, indent=2)


def write_span_corpus(df: DataFrame, path: str) -> None:
    """Documents with span arrays as Parquet, nested columns and all."""
    df.write.mode("overwrite").parquet(path)


def write_folds(df: DataFrame, path: str, by: Sequence[str] = ("fold", "split")) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def html_table(df: DataFrame, limit: int = 1_000) -> str:
    """A small summary as an HTML table; refuses tables over ``limit`` rows."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    cell = lambda tag, x: f"<{tag}>{'' if x is None else html.escape(str(x))}</{tag}>"
    head = "".join(cell("th", c) for c in df.columns)
    body = "".join("<tr>" + "".join(cell("td", x) for x in r) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def overwrite_in_place(df: DataFrame, path: str, write: Callable[[DataFrame, str], None] = lambda d, p: d.write.parquet(p)) -> None:
    """Replaces the table that ``df`` reads: written beside it, then swapped by
    two renames.  If the second fails the old table is put back, so the path
    holds one of the two whenever this returns or raises."""
    spark = df.sparkSession
    fresh, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    write(df, fresh)
    fs, target = _fs(spark, path)
    to = lambda p: _fs(spark, p)[1]
    if not fs.rename(target, to(old)):
        fs.delete(to(fresh), True)
        raise OSError(f"{path} could not be moved; it is as it was")
    if not fs.rename(to(fresh), target):
        if not fs.rename(to(old), target):
            raise OSError(f"{path} is at {old}, its new rows at {fresh}")
        fs.delete(to(fresh), True)
        raise OSError(f"{path} could not be replaced; it is as it was")
    fs.delete(to(old), True)
