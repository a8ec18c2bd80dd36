"""Readers and writers of the content formats. Every reader is lazy; bad records are left out, not raised."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import nonblank, normalize_text


def _name() -> Column:
    return F.col("_metadata.file_name")


def read_objects(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON objects, one a file, by metadata.object_id; files that can't be read or have no id are left out, of equal ids the last file by name counts."""
    r = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    df = (r.schema(schema) if schema else r).json(path)
    df = df.select("*", _name().alias("_file"), F.col("metadata.object_id").alias("_id")).where("_id IS NOT NULL")
    keep = [c for c in df.columns if c not in ("_corrupt_record", "_id")]
    row = F.struct(*[F.col(c) for c in keep])
    return df.groupBy("_id").agg(F.max_by(row, "_file").alias("r")).select("r.*").drop("_file")


def read_web_records(spark: SparkSession, path: str) -> DataFrame:
    """Scraped pages from files that hold lists of records: url, title, content, contacts, links; without those that are empty."""
    schema = "url string, title string, main_content string, content string, contacts array<struct<type:string,value:string>>, links array<struct<url:string,text:string>>"
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.select("url", "title", F.coalesce(nonblank("main_content"), nonblank("content")).alias("content"), "contacts", "links").where("content IS NOT NULL")


def find_column(columns: list[str], *parts: str) -> str | None:
    """The last column whose lower-case name has one of the parts."""
    return next((c for c in reversed(columns) if any(p in c.lower() for p in parts)), None)


def questions_answers(df: DataFrame, question: str | int | None = None, answer: str | int | None = None) -> DataFrame:
    """question, answer from a sheet whose columns are found by name (question, frage; answer, antwort) or given by name or position; blank and 'nan' rows are left out."""
    by = lambda c, *parts: df.columns[c] if isinstance(c, int) and c < len(df.columns) else c if isinstance(c, str) else find_column(df.columns, *parts) if c is None else None
    q, a = by(question, "question", "frage"), by(answer, "answer", "antwort")
    if q is None or a is None:
        raise ValueError(f"no question or answer column among {df.columns}")
    out = df.select(normalize_text(F.col(q).cast("string")).alias("question"), normalize_text(F.col(a).cast("string")).alias("answer"))
    full = lambda c: F.coalesce((F.col(c) != "") & (F.lower(c) != "nan"), F.lit(False))
    return out.where(full("question") & full("answer"))


def read_sheet(spark: SparkSession, path: str, **columns: str | int) -> DataFrame:
    """A sheet of questions and answers saved as CSV; spreadsheets themselves need a reader that isn't part of Spark."""
    return questions_answers(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path), **columns)


def choose_sheet(names: list[str], preferred: tuple[str, ...] = ("Sheet1", "QA", "Data")) -> str:
    """The first of the preferred sheets there is, else the first sheet."""
    if not names:
        raise ValueError("no sheet")
    return next((n for n in preferred if n in names), names[0])


def read_workbook(spark: SparkSession, folder: str, sheet: str | None = None, **columns: str | int) -> DataFrame:
    """question, answer and row_number of a workbook exported to a folder of CSV files, one a sheet; which sheet is chosen as choose_sheet says.

    row_number is the row's line in the sheet, of which the header is the first; a sheet is read by one task, as its rows
    have an order, and rows left out keep their numbers.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(n[:-4] for n in (f.getPath().getName() for f in found) if n.endswith(".csv"))
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{folder}/{sheet or choose_sheet(names)}.csv")
    numbered = df.withColumn("_row_number", F.monotonically_increasing_id().cast("int") + 2)
    by = {k: v for k, v in columns.items()}
    q = by.get("question", find_column(df.columns, "question", "frage"))
    a = by.get("answer", find_column(df.columns, "answer", "antwort"))
    both = questions_answers(df, q, a)  # raises where there is no such column
    assert both.columns == ["question", "answer"]
    q, a = (df.columns[c] if isinstance(c, int) else c for c in (q, a))
    kept = numbered.select(normalize_text(F.col(q).cast("string")).alias("question"), normalize_text(F.col(a).cast("string")).alias("answer"), F.col("_row_number").alias("row_number"))
    full = lambda c: F.coalesce((F.col(c) != "") & (F.lower(c) != "nan"), F.lit(False))
    return kept.where(full("question") & full("answer"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: file, text."""
    return spark.read.text(path, wholetext=True).select(_name().alias("file"), F.col("value").alias("text"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A crawl's manifest, a JSON object a line."""
    return spark.read.schema("id string, url string, status int, content_type string, html_file string, title string").json(path).where("id IS NOT NULL")


def read_classification(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a page classification with an id and a class."""
    schema = "page_id string, status string, title string, url string, html_file string, page_class string, confidence string, object_id_suggested string, notes string"
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path).where(nonblank("page_id").isNotNull() & nonblank("page_class").isNotNull())


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A database table; with a whole-number key and its bounds read in parallel."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        r = r.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return r.load()


def write_report(df: DataFrame, path: str) -> None:
    """A CSV report with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_by_category(df: DataFrame, path: str, category: str = "category") -> None:
    """JSON files, a folder a category."""
    df.write.mode("overwrite").partitionBy(category).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions stored under a path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())


def write_version(df: DataFrame, path: str) -> int:
    """Writes a new version beside the others, which stay as backups; its number."""
    n = max(versions(df.sparkSession, path), default=0) + 1
    df.write.parquet(f"{path}/v={n}")
    return n


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, by default the last."""
    known = versions(spark, path)
    n = version if version is not None else max(known, default=0)
    if n not in known:
        raise FileNotFoundError(f"no version {n} under {path}")
    return spark.read.parquet(f"{path}/v={n}")


def run(df: DataFrame, sink: Callable[[DataFrame], object], dry_run: bool = False) -> DataFrame:
    """Gives the rows to the sink, or with dry_run only returns the plan."""
    if not dry_run:
        sink(df)
    return df
