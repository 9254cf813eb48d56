"""The command line: convert, rechunk, sort, append, add-layer. Exit codes: 0 done, 1 an engine error, 2 wrong usage."""

from __future__ import annotations

import argparse
import logging
import os
import sys
import warnings

from . import __version__
from .config import LAYOUTS, AppConfig, apply_overrides
from .errors import LoomError, ValidationError
from .functions.runtime import usable_cpus


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="matrixloom", description="Annotated matrix stores on Spark")
    top.add_argument("--version", action="version", version=__version__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=text)
        p.add_argument("-v", "--verbose", action="store_true", help="log what is done")
        p.add_argument("-q", "--quiet", action="store_true", help="no warnings")
        p.add_argument("--cpus", type=int, help="local cores where no cluster is configured")
        p.add_argument("--branch", help="branch of a repository; made at its current tip if new")
        p.add_argument("-m", "--message", help="commit message")
        return p

    def output(p: argparse.ArgumentParser) -> None:
        p.add_argument("-o", "--output", required=True)
        p.add_argument("--overwrite", action="store_true", default=None)
        p.add_argument("--backend", choices=("plain", "repo"))

    def chunks(p: argparse.ArgumentParser) -> None:
        for name in ("row-chunk", "col-chunk", "nnz-chunk", "clevel"):
            p.add_argument(f"--{name}", type=int)
        p.add_argument("--auto-shard", action="store_true", default=None, help="files of many chunks, as large as a band's budget allows")

    p = command("convert", "make a store of one input, or of several stacked by rows")
    p.add_argument("inputs", nargs="+")
    output(p)
    chunks(p)
    p.add_argument("--from", dest="fmt", help="input kind, instead of detecting it")
    p.add_argument("--layout", choices=LAYOUTS)
    p.add_argument("--sort-by", nargs="+")
    p.add_argument("--obs-columns", nargs="+")
    p.add_argument("--eager", dest="lazy", action="store_false", default=None, help="read the input once, into the shared folder, before anything else")
    p = command("rechunk", "copy a store with one matrix on another chunk grid")
    p.add_argument("store")
    output(p)
    chunks(p)
    p.add_argument("--matrix", default="X")
    p = command("sort", "copy a store with its rows sorted")
    p.add_argument("store")
    output(p)
    p.add_argument("--by", nargs="+", required=True)
    p = command("append", "add the rows of another store")
    p.add_argument("store")
    p.add_argument("cells")
    p.add_argument("--drop-derived", action="store_true")
    p.add_argument("--include-new-obs", action="store_true")
    p = command("add-layer", "copy a matrix into a layer")
    p.add_argument("store")
    p.add_argument("--layer", required=True)
    p.add_argument("--matrix", default="X")
    p.add_argument("--layout", choices=LAYOUTS, default="csc")
    p.add_argument("--overwrite", action="store_true")
    chunks(p)
    return top


def _session(cpus: int | None):
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName("matrixloom")
    if cpus or not (SparkSession.getActiveSession() or os.environ.get("SPARK_CONF_DIR") or os.environ.get("MASTER") or os.environ.get("SPARK_REMOTE")):
        builder = builder.config("spark.master", f"local[{cpus or usable_cpus()}]")
    return builder.getOrCreate()


def _agree(args, spark) -> bool:
    """Consent to what append drops: the flag, or an answer on a terminal."""
    from .plans import ops

    if args.drop_derived:
        return True
    drops = ops.plan_append(spark, args.store, cells=args.cells).drops()
    if not drops:
        return False
    if not sys.stdin.isatty():
        raise ValidationError(f"append would drop {', '.join(drops)}; pass --drop-derived to agree")
    return input(f"append drops {', '.join(drops)}. Go on? [y/N] ").strip().lower() in ("y", "yes")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    layout = getattr(args, "layout", None)
    if args.command in ("convert", "add-layer"):
        idle = {"csr": "col_chunk", "csc": "row_chunk"}.get(layout or "csr")
        if idle and getattr(args, idle) is not None:
            parser().error(f"--{idle.replace('_', '-')} has no effect on {layout or 'csr'} output")
    logging.basicConfig(level=logging.WARNING, format="%(asctime)s %(name)s: %(message)s")
    logging.getLogger("matrixloom").setLevel(logging.INFO if args.verbose else logging.WARNING)
    try:
        names = ("overwrite", "backend", "layout", "lazy", "row_chunk", "col_chunk", "nnz_chunk", "clevel", "auto_shard", "sort_by", "obs_columns", "cpus")
        cfg = apply_overrides(AppConfig(), **{n: getattr(args, n, None) for n in names if not (args.command == "add-layer" and n == "overwrite")})
        from .plans import ops

        spark = _session(args.cpus)
        extra = {"cfg": cfg, "branch": args.branch, "message": args.message}
        with warnings.catch_warnings():
            if args.quiet:
                warnings.simplefilter("ignore")
            if args.command == "convert":
                done = ops.convert(spark, args.inputs, output=args.output, fmt=args.fmt, **extra)
            elif args.command == "rechunk":
                done = ops.rechunk(spark, args.store, output=args.output, matrix=args.matrix, **extra)
            elif args.command == "sort":
                done = ops.sort(spark, args.store, output=args.output, by=args.by, **extra)
            elif args.command == "append":
                done = ops.append(spark, args.store, cells=args.cells, drop_derived=_agree(args, spark), include_new_obs=args.include_new_obs, **extra)
            else:
                done = ops.add_layer(spark, args.store, layer=args.layer, matrix=args.matrix, layout=args.layout, overwrite=args.overwrite, **extra)
    except LoomError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(f"{done.path}: {done.n_obs} x {done.n_vars}" + (f", snapshot {done.snapshot_id[:12]}" if done.snapshot_id else ""))
    return 0
