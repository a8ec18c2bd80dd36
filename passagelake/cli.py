"""python -m passagelake.cli build-content --web DIR --qa FILE --store DIR [--force] [--dry-run] [--only web|qa]
python -m passagelake.cli migrate --objects-dir DIR --out DIR [--report-csv DIR] [--chunk-chars N] [--chunk-overlap N] [--min-chars N] [--dry-run]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import api
from .sources import io

OBJECTS = "metadata struct<object_id:string,object_type:string,title:string,url:string,classification_notes:string>, related_pages array<string>, content struct<full_text:string>"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build-content")
    b.add_argument("--web")
    b.add_argument("--qa")
    b.add_argument("--store", required=True)
    b.add_argument("--force", action="store_true")
    b.add_argument("--dry-run", action="store_true")
    b.add_argument("--only", choices=("web", "qa"))
    m = sub.add_parser("migrate")
    m.add_argument("--objects-dir", required=True)
    m.add_argument("--out", required=True)
    m.add_argument("--report-csv")
    m.add_argument("--chunk-chars", type=int, default=1000)
    m.add_argument("--chunk-overlap", type=int, default=200)
    m.add_argument("--min-chars", type=int, default=250)
    m.add_argument("--dry-run", action="store_true")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("passagelake").getOrCreate()
    if a.command == "build-content":
        web = io.read_web_records(spark, a.web) if a.web and a.only != "qa" else None
        pairs = io.read_sheet(spark, a.qa) if a.qa and a.only != "web" else None
        if web is None and pairs is None:
            raise SystemExit("nothing to read: give --web or --qa")
        api.build_content(spark, a.store, web, pairs, force=a.force, dry_run=a.dry_run).show(truncate=False)
        return
    o = io.read_objects(spark, a.objects_dir, OBJECTS).select("metadata.*", "related_pages", F.col("content.full_text").alias("full_text"))
    chunks, report = api.migrate_objects(o, size=a.chunk_chars, overlap=a.chunk_overlap, min_chars=a.min_chars)
    io.run(chunks, lambda df: df.write.mode("overwrite").parquet(f"{a.out}/chunks"), a.dry_run)
    if a.report_csv:
        io.run(report, lambda df: io.write_report(df, a.report_csv), a.dry_run)
    report.agg(F.count(F.lit(1)).alias("objects"), F.count_if("enriched").alias("enriched"), F.count_if("still_thin").alias("still_thin"), F.sum("num_chunks").alias("chunks")).show()


if __name__ == "__main__":
    main()
