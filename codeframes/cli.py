"""``python -m codeframes.cli extract FRAMES --readings TABLE [...]``: the plan over tables of frames and readings;
``extract VIDEO... --backend MODULE:SETUP``: the same from video files; ``bench PREDICTIONS`` and
``bench FOLDER --backend MODULE:SETUP...``: the comparison of backends.

FRAMES is a parquet table of video_id, path, timestamp_ms and phash, and READINGS one of video_id, path, text and
confidence.  ``--second`` names a table of second readings for doubtful frames, or their MODULE:SETUP.  A SETUP is called
once per task and gives a function from a list of PNG images to a list of (text, confidence).  Exit codes: 0 done, 1
failed with a one-line message, 2 wrong usage."""

from __future__ import annotations

import argparse
import importlib
import os
import sys
import time
from collections.abc import Sequence

from codeframes import __version__
from codeframes.schemas import Settings, parse_crop


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codeframes", description="Recover code from tables of screen captures.")
    p.add_argument("--version", action="version", version=__version__)
    commands = p.add_subparsers(dest="command")
    b = commands.add_parser("bench", help="compare backends over labelled frames")
    b.add_argument("predictions", help="parquet table of backend, name, truth, text and error; with --backend a folder of pictures and texts")
    b.add_argument("--backend", action="append", metavar="MODULE:SETUP", help="a reader of pictures; may be given more than once")
    b.add_argument("--order", help="backends by preference, with commas; the first wins ties")
    d = Settings()
    e = commands.add_parser("extract", help="merge readings into scripts with provenance")
    e.add_argument("frames", nargs="+", help="a table of frames, or video files")
    how = e.add_mutually_exclusive_group(required=True)
    how.add_argument("--readings", help="table of readings of a table's frames")
    how.add_argument("--backend", help="MODULE:SETUP of the reader of video frames")
    e.add_argument("--second", help="table of second readings, or MODULE:SETUP")
    e.add_argument("--no-escalate", action="store_true", help="don't use second readings")
    e.add_argument("--out", default="out")
    e.add_argument("--fps", type=float, help="frames a second: of a video (default 1), or to thin a table")
    e.add_argument("--crop", metavar="X,Y,W,H", help="the region of a video's frames that is read")
    e.add_argument("--scene-threshold", type=float, default=d.scene_threshold, help="sensitivity to scene cuts, above 0 and at most 1")
    e.add_argument("--dedup-max-distance", type=int, default=d.dedup_max_distance)
    for name in ("score_threshold", "escalate_below", "similarity_threshold", "low_confidence_threshold", "conflict_margin"):
        e.add_argument("--" + name.replace("_", "-"), type=float, default=getattr(d, name))
    return p


def setup_of(name: str):
    """The object that MODULE:NAME names."""
    module, colon, attribute = name.partition(":")
    if not (module and colon and attribute):
        raise ValueError(f"a backend is MODULE:SETUP, not {name!r}")
    return getattr(importlib.import_module(module), attribute)


def extract(args: argparse.Namespace) -> str:
    names = ("dedup_max_distance", "score_threshold", "escalate_below", "similarity_threshold", "low_confidence_threshold", "conflict_margin", "scene_threshold")
    given = {name: getattr(args, name) for name in names}
    settings = Settings(fps=1.0 if args.fps is None else args.fps, crop=parse_crop(args.crop) if args.crop else None, out_dir=args.out, **given)
    if args.readings and (args.crop or len(args.frames) > 1):
        raise ValueError("--crop and several inputs are for video files, which need --backend")
    second = None if args.no_escalate else args.second
    setups = [setup_of(x) for x in (args.backend, second if args.backend else None) if x]
    for video in args.frames if args.backend else ():
        if not os.path.isfile(video):
            raise FileNotFoundError(f"no such video: {video}")
    from pyspark.sql import SparkSession

    from codeframes.sources import sinks

    start = time.perf_counter()
    spark = SparkSession.builder.appName("codeframes").getOrCreate()
    result = _from_videos(spark, args, settings, setups) if args.backend else _from_tables(spark, args, settings, second)
    sinks.write_scripts(result.scripts, f"{args.out}/scripts")
    sinks.write_provenance(result.provenance, f"{args.out}/provenance")
    counters = [c for c in result.stats.columns if c != "video_id"]
    from pyspark.sql import functions as F

    totals = result.stats.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters)).first().asDict()
    return sinks.summary(totals | {"total_time": time.perf_counter() - start})


def _from_videos(spark, args: argparse.Namespace, settings: Settings, setups: list):
    from codeframes.plans.video import ImageBackend, extract_videos

    makers = [lambda pictures, crop, k=k, setup=setup: ImageBackend(("first", "second")[k], setup, pictures, crop) for k, setup in enumerate(setups)]
    return extract_videos(spark, args.frames, f"{os.path.abspath(args.out)}/frames", makers[0], settings, makers[1] if len(makers) > 1 else None)


def _from_tables(spark, args: argparse.Namespace, settings: Settings, second: str | None):
    from codeframes.operators.frames import sample_fps
    from codeframes.plans.pipeline import Plan, TableBackend

    frames = spark.read.parquet(args.frames[0])
    if args.fps is not None:
        frames = sample_fps(frames, args.fps)
    again = TableBackend("second", spark.read.parquet(second)) if second else None
    return Plan(TableBackend("first", spark.read.parquet(args.readings)), settings, again).run(frames)


def bench(args: argparse.Namespace) -> tuple[str, int]:
    """The report, and 0 if there is a winner."""
    from pyspark.sql import SparkSession

    from codeframes.operators import evaluate

    if args.backend:
        from codeframes.plans.bench import run_folder

        backends = [(name, setup_of(name)) for name in dict.fromkeys(args.backend)]
        shown, best, failures = run_folder(SparkSession.builder.appName("codeframes").getOrCreate(), args.predictions, backends)
        for name, picture, error in failures:
            print(f"warning: {name} left out, as it failed on {picture}: {error}", file=sys.stderr)
        return shown, 0 if best else 1
    predictions = SparkSession.builder.appName("codeframes").getOrCreate().read.parquet(args.predictions)
    report = evaluate.benchmark(evaluate.score_predictions(predictions)).cache()
    names = sorted(r.backend for r in report.select("backend").collect())
    asked = [n for n in (args.order or "").split(",") if n]
    return evaluate.format_report(report, [*asked, *(n for n in names if n not in asked)]), 0 if names else 1


def main(argv: Sequence[str] | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if args.command is None:
        p.print_usage(sys.stderr)
        return 2
    try:
        if args.command == "bench":
            shown, code = bench(args)
            print(shown)
            return code
        print(extract(args))
    except Exception as e:  # noqa: BLE001  one line for any failure
        print(f"codeframes: error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
