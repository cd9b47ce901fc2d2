"""Command line: python -m lanternql [--explain | --schema | --syntax] [--folder DIR] "select ..."."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from lanternql.session import Engine
from lanternql.sources.tables import STYLES, text_table


def main() -> None:
    p = argparse.ArgumentParser(prog="lanternql")
    p.add_argument("query", help="a program of the dialect, or @file")
    p.add_argument("--folder", help="register every <name>.parquet of this folder")
    p.add_argument("--style", choices=STYLES, default="table1")
    p.add_argument("--row-number", action="store_true", help="number the rows of the result")
    p.add_argument("--tail", type=int, help="only the last rows")
    p.add_argument("--safe", action="store_true", help="no files, no changes")
    for verb in ("explain", "schema", "syntax"):
        p.add_argument(f"--{verb}", action="store_true")
    a = p.parse_args()
    text = open(a.query[1:], encoding="utf-8").read() if a.query.startswith("@") else a.query
    spark = SparkSession.builder.appName("lanternql").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, safe_mode=a.safe)
    if a.folder:
        engine.register_folder(a.folder)
    if a.syntax:
        print(*engine.syntax(text), sep="\n")
    elif a.explain:
        engine.explain(text)
    elif a.schema:
        print(engine.schema(text).simpleString())
    elif a.tail is not None:
        print(*text_table(spark.createDataFrame(engine.tail(text, a.tail), engine.schema(text)), a.style), sep="\n")
    else:
        out = engine.numbered(text) if a.row_number else engine.run(text)
        if isinstance(out, DataFrame):
            for line in text_table(out, a.style):
                print(line)
        elif out is not None:
            print(out)


if __name__ == "__main__":
    main()
