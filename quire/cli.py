"""spark-submit entry: python -m quire.cli INPUT -o OUTPUT [--chars] [--pages 1,3-5] [--indent N] [-v]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quire.plans import pipelines


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quire", description="Documents to structured JSON")
    p.add_argument("input", help="folder of PDF, DOCX, HTML and JSON files, or with --chars a parquet table of characters")
    p.add_argument("-o", "--output", help="folder for the JSON; files that are broken or have no reader are listed beside it; without it the documents are printed")
    p.add_argument("--chars", action="store_true", help="the input is a table of positioned characters")
    p.add_argument("--no-vision", action="store_true", help="types by heuristics (the default without a tagger)")
    p.add_argument("--pages", help="pages such as 1,3-5 (PDF files and characters)")
    p.add_argument("--indent", type=int, default=0, help="indent the JSON if not 0")
    p.add_argument("-v", "--verbose", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("quire").getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if a.verbose else "WARN")
    if a.chars:
        chars = spark.read.parquet(a.input)
        pages = chars.select("doc_id", "page_number").distinct().select("*", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
        docs = pipelines.layout_document(chars, pages, page_range=a.pages, pretty=bool(a.indent))
    else:
        docs, rest = pipelines.convert(spark, a.input, pretty=bool(a.indent), page_range=a.pages)
        if a.output:
            rest.write.mode("overwrite").json(f"{a.output.rstrip('/')}-rest")
    if a.output:
        pipelines.write_json(docs, a.output)
    else:
        for row in docs.select("json").toLocalIterator():
            print(row.json)


if __name__ == "__main__":
    main()
