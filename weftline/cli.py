"""Command line: ``python -m weftline.cli --ats FILE --notes FILE --config FILE [--out FILE] [--pretty] [--all-candidates]``."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftline.plans import pipeline
from weftline.storage import materialise

log = logging.getLogger("weftline")


def parse_args(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="weftline", description="Consolidate records of several sources into entities.")
    p.add_argument("--ats", help="JSON documents: a file, folder or pattern")
    p.add_argument("--notes", help="text notes: a file, folder or pattern")
    p.add_argument("--config", required=True, help="projection configuration")
    p.add_argument("--out", help="also write the output here")
    p.add_argument("--pretty", action="store_true", help="indent the output")
    p.add_argument("--all-candidates", action="store_true", help="all entities, not only the first")
    args = p.parse_args(argv)
    if not (args.ats or args.notes):
        p.error("at least one of --ats and --notes is needed")
    return args


def emit(rows, many: bool, out: str | None, pretty: bool) -> None:
    """JSON to standard output and, if asked for, a file, one row after another; of many rows, a list.

    A file that cannot be written is only a warning.
    """
    indent, file = 2 if pretty else None, None
    if out:
        try:
            Path(out).parent.mkdir(parents=True, exist_ok=True)
            file = Path(out).open("w", encoding="utf-8")
        except OSError as error:
            log.warning("cannot write %s: %s", out, error)

    def write(text: str) -> None:
        nonlocal file
        sys.stdout.write(text)
        if file:
            try:
                file.write(text)
            except OSError as error:
                log.warning("cannot write %s: %s", out, error)
                file = None

    try:
        if many:
            write("[")
        for i, row in enumerate(rows):
            text = json.dumps(row, ensure_ascii=False, indent=indent)
            if many:
                text = ("," if i else "") + ("\n  " + text.replace("\n", "\n  ") if pretty else " " * bool(i) + text)
            write(text)
        write(("\n]" if pretty else "]") * many)
    finally:
        sys.stdout.write("\n")
        if file:
            file.close()


def main(argv: list[str] | None = None, spark: SparkSession | None = None, extractor=None) -> int:
    args = parse_args(argv)
    logging.basicConfig(stream=sys.stderr, level=logging.INFO)
    try:
        config = pipeline.load_config(args.config)
    except (OSError, ValueError, TypeError) as error:
        log.error("configuration: %s", error)
        return 1
    spark = spark or SparkSession.builder.appName("weftline").getOrCreate()
    profiles, quarantine = pipeline.ingest(spark, args.ats, args.notes, **({"extractor": extractor} if extractor else {}))
    if quarantine is not None:
        # Reasons and a few names; the rows themselves are in the quarantine frame.
        for row in quarantine.groupBy("reason").agg(F.count("*").alias("n"), F.min("_source_id").alias("one")).orderBy(F.desc("n")).limit(20).collect():
            log.warning("%d records are skipped, %s among them: %s", row["n"], row["one"], row["reason"])
    if not profiles.take(1):
        log.error("no source could be read")
        return 1
    try:
        # All rows are made and written before the first is printed: an error prints none.
        rows = materialise(pipeline.run(profiles, config, args.all_candidates), "projected").orderBy("cluster_id")
    except Exception as error:
        log.error("%s", error)
        return 1
    emit((json.loads(r["json"]) for r in rows.toLocalIterator()), args.all_candidates, args.out, args.pretty)
    return 0


if __name__ == "__main__":
    sys.exit(main())
