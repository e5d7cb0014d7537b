"""Command line: ``python -m codestrata -i PROJECT [-o OUT] [--emit json|graph|schema] …``."""

from __future__ import annotations

import argparse
import os
import sys

from .plans import catalog
from .plans.analyze import analyze, property_graph
from .session import build_session
from .sources import java_source, sinks
from .streaming.upsert import upsert


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("codestrata")
    parser.add_argument("-i", "--input", help="folder of Java files")
    parser.add_argument("-s", "--source", help="Java source text instead of a folder")
    parser.add_argument("-t", "--target", action="append", default=[], help="only this file (relative); may repeat")
    parser.add_argument("-o", "--output", help="folder for results")
    parser.add_argument("--emit", choices=["json", "graph", "schema"], default="json")
    parser.add_argument("--app-name")
    parser.add_argument("-c", "--cache-dir", help="keep the graph here and replace only what changed")
    parser.add_argument("--eager", action="store_true", help="treat every file as changed")
    parser.add_argument("--keep-nulls", action="store_true")
    options = parser.parse_args(arguments)
    if options.emit == "schema":
        print(catalog.contract())
        return 0
    if bool(options.input) == bool(options.source):
        parser.error("one of --input and --source is needed")
    if not options.output and not options.cache_dir:
        parser.error("--output or --cache-dir is needed")
    if options.eager and not options.cache_dir:
        parser.error("--eager needs --cache-dir")
    spark = build_session()
    spark.sparkContext.setCheckpointDir(os.environ.get("CODESTRATA_CHECKPOINTS", f"{options.output or options.cache_dir}/.checkpoints"))
    app = options.app_name or os.path.basename((options.input or "").rstrip("/")) or "application"
    if options.source:
        files = java_source.from_rows(spark.createDataFrame([(app, "<pseudo-path>", options.source)], "app string, file_key string, source string"))
    else:
        files = java_source.scan_files(spark, options.input, app)
    if options.target:
        files = java_source.only_files(files, spark.createDataFrame([(t,) for t in options.target], "file_key string"))
    if options.cache_dir:
        for row in upsert(files, options.cache_dir, app, full_run=not options.target, eager=options.eager).groupBy("status").count().collect():
            print(f"{row['status']}: {row['count']}", file=sys.stderr)
    if options.output:
        found = analyze(files)
        if options.emit == "json":
            sinks.write_json(found, f"{options.output}/analysis", options.keep_nulls)
        else:
            sinks.write_cypher(*property_graph(found, app), app, f"{options.output}/graph")
    return 0


if __name__ == "__main__":
    sys.exit(main())
