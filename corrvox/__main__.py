"""``python -m corrvox solve|compare|strain|convert|settings``; exit codes: 0 done, 2 wrong settings or input."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="corrvox", description="Digital volume correlation on Spark.")
    sub = p.add_subparsers(dest="command", required=True)
    for name, words in (("solve", ["config"]), ("compare", ["results", "reference"]), ("strain", ["results", "out"]), ("convert", ["volume", "out"]), ("settings", ["file"])):
        q = sub.add_parser(name)
        for w in words:
            q.add_argument(w)
        if name == "solve":
            q.add_argument("--partial", action="store_true")
        if name == "strain":
            q.add_argument("--window", type=int, default=25)
        if name == "convert":
            q.add_argument("--shape")
            q.add_argument("--dtype")
            q.add_argument("--brick", type=int, default=64)
            q.add_argument("--levels", type=int, default=1)
            q.add_argument("--overwrite", action="store_true")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("corrvox").getOrCreate()
    from corrvox import config
    from corrvox.plans import run
    from corrvox.sources import text, volume_sink, volumes

    try:
        if a.command == "solve":
            cfg, t = config.load(a.config), time.time()
            run.run(spark, cfg)
            run.finish(spark, cfg, time.time() - t, a.partial)
        elif a.command == "compare":
            run.compare(spark, a.results, a.reference).show(vertical=True)
        elif a.command == "strain":
            run.write_strain(spark, a.results, a.out, a.window)
        elif a.command == "convert":
            more = {k: v for k, v in (("shape", a.shape), ("dtype", a.dtype)) if v}
            bricks = volumes.read_bricks(spark, a.volume, a.brick, **more)
            if a.out.endswith(".zarr"):
                lay = volumes.layout(a.volume, more)
                volume_sink.write_zarr(bricks, tuple(lay["shape"]), lay["dtype"], a.brick, a.out, overwrite=a.overwrite, levels=a.levels)
            else:
                volumes.convert(bricks, a.out, "overwrite" if a.overwrite else "error")
        else:
            found = text.settings_map(text.lines_of(spark, a.file)).first()
            if found["unknown"]:
                print(f"unknown keys: {', '.join(found['unknown'])}", file=sys.stderr)
            print(config.from_settings(found["settings"]))
    except (ValueError, FileNotFoundError, FileExistsError, AnalysisException) as e:
        print(f"corrvox: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
