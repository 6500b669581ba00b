"""Command line: python -m cuelake.plans.cli cues.parquet folder --mode merged."""

from __future__ import annotations

import argparse
import logging
import os
import sys
import time

from . import adapters, config, pipeline


def span(seconds: float) -> str:
    """4.20s, 2m 4.20s or 1h 2m 4.20s."""
    h, m, s = int(seconds // 3600), int(seconds % 3600 // 60), seconds % 60
    return f"{h}h {m}m {s:.2f}s" if h else f"{m}m {s:.2f}s" if m else f"{s:.2f}s"


def parse(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="cuelake")
    p.add_argument("tables", help="folder with spoken.parquet and events.parquet")
    p.add_argument("out", help="folder for subtitle files")
    p.add_argument("--mode", choices=config.MODES, default="merged")
    p.add_argument("--config")
    p.add_argument("-v", "--verbose", action="store_true")
    return p.parse_args(args)


def main(args: list[str] | None = None) -> int:
    """0, 1 if the input is missing, 2 if a boundary fails; other errors pass."""
    a = parse(args)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.INFO, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    if "://" not in a.tables and not os.path.isdir(a.tables):
        logging.error("%s is missing", a.tables)
        return 1
    from pyspark.sql import SparkSession

    began = time.monotonic()
    spark = SparkSession.builder.getOrCreate()
    own = config.with_mode(config.load(a.config) if a.config else config.Config(), a.mode)
    read = lambda name: spark.read.parquet(f"{a.tables}/{name}.parquet")
    try:
        cues = pipeline.process(read("spoken") if own.transcription.enabled else None, read("events") if own.ocr.enabled else None, own)
        written = pipeline.write_subtitles(cues, a.out if "://" in a.out else "file://" + os.path.abspath(a.out)).count()
    except adapters.PipelineError as e:
        logging.error("%s", e)
        return 2
    logging.info("%d files in %s", written, span(time.monotonic() - began))
    return 0


if __name__ == "__main__":
    sys.exit(main())
