"""Jobs: `python -m factorspark fit ...` and `convert`, and for sites that keep their rows `site-round` and `accumulate`."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.matrix import SparseMatrix
from factorspark.operators.cells import bound_nonzero
from factorspark.operators.params import FitParams
from factorspark.plans import quality, site_round
from factorspark.plans.em import ppca_em, ppca_em_wide
from factorspark.plans.layout import prepare
from factorspark.plans.sites import ppca_em_sites
from factorspark.plans.transform import BASES, transform
from factorspark.session import tune
from factorspark.sources import readers, tables, writers

METHODS = ("wide", "noise", "scored", "sites")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="factorspark", description=__doc__)
    jobs = top.add_subparsers(dest="job", required=True)
    fit = jobs.add_parser("fit", help="fit components of a matrix and write them")
    convert = jobs.add_parser("convert", help="turn a text matrix into a Parquet table of cells")
    site = jobs.add_parser("site-round", help="send the sums of one site's rows for a round")
    total = jobs.add_parser("accumulate", help="write the factor of the next round once all sites have sent theirs")
    for job in (site, total):
        job.add_argument("--exchange", required=True, help="folder that sites share")
        job.add_argument("--round", type=int, default=0)
        job.add_argument("--cols", type=int, required=True)
        job.add_argument("--pcs", type=int, required=True)
    site.add_argument("--input", required=True, help="Parquet table of the site's cells")
    site.add_argument("--site", required=True, help="its name")
    site.add_argument("--rows", type=int, required=True, help="its number of rows")
    total.add_argument("--sites", type=int, required=True)
    total.add_argument("--start", action="store_true", help="write the factor of round 0 instead")
    total.add_argument("--max-iter", type=int, default=3)
    total.add_argument("--tolerance", type=float)
    total.add_argument("--seed", type=int, default=42)
    for job in (fit, convert):
        job.add_argument("--input", required=True)
        job.add_argument("--output", required=True)
        job.add_argument("--base", type=int, default=0, help="smallest column id of coordinate text")
        job.add_argument("--shift", type=int, default=0, help="taken off both ids of coordinate text")
        job.add_argument("--binary", action="store_true", help="treat every stored value as 1")
    convert.add_argument("--format", choices=("coo", "dense"), required=True)
    fit.add_argument("--format", choices=("parquet", "rows", "coo", "dense"), default="parquet")
    fit.add_argument("--rows", type=int, required=True)
    fit.add_argument("--cols", type=int, required=True)
    fit.add_argument("--pcs", type=int, required=True)
    fit.add_argument("--method", choices=METHODS, default="wide")
    fit.add_argument("--max-iter", type=int, default=3)
    fit.add_argument("--tolerance", type=float, help="change of the factor, or error, to stop at")
    fit.add_argument("--error-rate", type=float, default=1.0, help="share of rows for the reconstruction error")
    fit.add_argument("--reconstruction", action="store_true", help="measure that error in each round (noise)")
    fit.add_argument("--next-singular-value", type=float, help="for the spectral error (scored)")
    fit.add_argument("--subsample", type=int, default=10)
    fit.add_argument("--site-rows", help="Parquet table (site, n_rows) (sites)")
    fit.add_argument("--center", choices=("site", "global"), default="site")
    fit.add_argument("--seed", type=int, default=42)
    fit.add_argument("--data-set", default="")
    fit.add_argument("--work", help="folder for the rounds; with --resume a fit continues there")
    fit.add_argument("--resume", action="store_true")
    fit.add_argument("--out-format", choices=writers.FORMATS, default="parquet")
    fit.add_argument("--project", choices=BASES, help="also write the rows in this basis")
    return top


def read(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.format == "coo":
        return readers.read_coo_text(spark, args.input, args.base, args.shift, binary=args.binary)
    if args.format == "dense":
        return readers.read_dense_text(spark, args.input)
    table = spark.read.parquet(args.input)
    return readers.read_rows(table) if args.format == "rows" else table


def convert(spark: SparkSession, args: argparse.Namespace) -> None:
    read(spark, args).filter("value <> 0").write.mode("overwrite").parquet(args.output)


def refuse(args: argparse.Namespace) -> None:
    """End on options that the method has no use for, or lacks."""
    wrong = {
        "--method scored needs --next-singular-value": args.method == "scored" and args.next_singular_value is None,
        "--method scored takes no --work and no --resume": args.method == "scored" and (args.work or args.resume),
        "--method noise takes --tolerance with --reconstruction only": args.method == "noise" and args.tolerance is not None and not args.reconstruction,
        "--reconstruction goes with --method noise": args.reconstruction and args.method != "noise",
        "--resume needs --work": args.resume and not args.work,
        "--method sites needs --site-rows": args.method == "sites" and not args.site_rows,
        "--project posterior goes with --method noise or scored": args.project == "posterior" and args.method not in ("noise", "scored"),
        "--error-rate must lie above 0 and not above 1": not 0 < args.error_rate <= 1,
    }
    for said, so in wrong.items():
        if so:
            raise SystemExit(said)


def fit(spark: SparkSession, args: argparse.Namespace) -> None:
    refuse(args)
    site_rows = spark.read.parquet(args.site_rows).persist() if args.site_rows else None
    entries = bound_nonzero(read(spark, args), args.cols)
    matrix = SparseMatrix(entries, args.rows, args.cols, site_rows=site_rows)
    params = FitParams(args.pcs, args.max_iter, args.tolerance, subsample=args.subsample, seed=args.seed)
    k = params.checked(args.rows, args.cols).n_components
    folder = args.work
    if args.method == "wide":
        result = ppca_em_wide(matrix, params, folder=folder, resume=args.resume, track_change=True)
    elif args.method == "sites":
        result = ppca_em_sites(
            matrix, params, center=args.center, folder=folder, resume=args.resume, track_change=True
        )
    elif args.method == "scored":
        result = quality.ppca_em_scored(matrix, params, args.next_singular_value, args.tolerance)
    else:
        layout = prepare(matrix, k, folder=folder)
        score = quality.reconstruction_score(layout, k, args.error_rate, args.seed) if args.reconstruction else None
        result = ppca_em(
            matrix,
            params,
            layout=layout,
            resume=args.resume,
            score=score,
            score_tolerance=args.tolerance if score else None,
        )
    result.factor.write.mode("overwrite").parquet(f"{args.output}/factor")
    components = readers.dense_to_entries(result.components(), "u", key="col_id")
    writers.save_result(components, f"{args.output}/components", args.cols, k, args.out_format)
    tables.append_metrics(
        spark, f"{args.output}/metrics", result.layout.folder, result.metrics, args.rows, args.cols, k,
        app=args.method, data_set=args.data_set,
    )
    if args.project:
        factor, means = spark.read.parquet(f"{args.output}/factor"), result.layout.stats
        tables.save_projection(transform(matrix, factor, k, args.project, result.ss, means), f"{args.output}/projection")
    result.layout.release()
    if site_rows is not None:
        site_rows.unpersist()
    print(f"{result.rounds} rounds, stopped by {result.stopped_by}, noise variance {result.ss}")


def send_round(spark: SparkSession, args: argparse.Namespace) -> None:
    cells = bound_nonzero(spark.read.parquet(args.input), args.cols).withColumn("site", F.lit(args.site))
    site_rows = spark.createDataFrame([(args.site, args.rows)], "site string, n_rows bigint")
    # Means go by the site's own number of rows; ids may be those of all sites.
    ids = 1 + (cells.agg(F.max("row_id").alias("top")).first()["top"] or 0)
    matrix = SparseMatrix(cells.select("site", "row_id", "col_id", "value"), max(ids, args.rows), args.cols, site_rows=site_rows)
    sent = site_round.site_round(matrix, args.exchange, args.round, args.pcs)
    print(f"round {args.round} of {args.site}: {'sent' if sent else 'nothing to do'}")


def accumulate(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.start:
        site_round.begin(spark, args.exchange, args.cols, args.pcs, seed=args.seed)
        print("round 0: next")
        return
    found = site_round.accumulate_round(
        spark, args.exchange, args.round, args.pcs, args.cols, args.sites, args.max_iter, args.tolerance
    )
    print(f"round {found.round}: {found.state}" + ("" if found.dw is None else f", change {found.dw}"))


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = tune(SparkSession.builder.appName("factorspark").getOrCreate())
    {"fit": fit, "convert": convert, "site-round": send_round, "accumulate": accumulate}[args.job](spark, args)


if __name__ == "__main__":
    main()
