"""Command line: spark-submit -m locuspark.cli --Y pheno.tsv --GD gd.tsv --GM gm.tsv --model GLM MLM."""

from __future__ import annotations

import argparse

import numpy as np
from pyspark.sql import functions as F

from locuspark.plans.pipeline import run
from locuspark.session import build_session
from locuspark.sources.readers import read_hapmap, read_numeric, read_phenotype


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="locuspark")
    p.add_argument("--Y", required=True)
    p.add_argument("--G")
    p.add_argument("--GD")
    p.add_argument("--GM")
    p.add_argument("--KI")
    p.add_argument("--CV")
    p.add_argument("--model", nargs="+", default=["BLINK"])
    p.add_argument("--trait", help="a trait's name, or its position from 0")
    p.add_argument("--PCA_total", type=int, default=3)
    p.add_argument("--maf_threshold", type=float, default=0.05)
    p.add_argument("--SNP_impute", default="middle")
    p.add_argument("--cutOff", type=float)
    p.add_argument("--p_threshold", type=float)
    p.add_argument("--LD", type=float, default=0.7)
    p.add_argument("--maxLoop", type=int, default=10)
    p.add_argument("--group_from", type=int, default=1)
    p.add_argument("--group_to", type=int)
    p.add_argument("--bin_size", type=float, default=5_000_000)
    p.add_argument("--super_bin_size", type=float, default=10_000)
    p.add_argument("--super_qtn_counts", type=int, nargs="+")
    p.add_argument("--h2", type=float)
    p.add_argument("--NQTN", type=int)
    p.add_argument("--output_dir", default=".")
    p.add_argument("--no_file_output", action="store_true")
    p.add_argument("--buspred", action="store_true")
    return p


def select_traits(names: tuple[str, ...], wanted: str | int | None) -> tuple[str, ...]:
    """All traits, or one by name or position; negative positions count from the end."""
    if wanted is None:
        return names
    if isinstance(wanted, bool):
        raise TypeError("a trait is a name or a position")
    if isinstance(wanted, str) and wanted in names:
        return (wanted,)
    try:
        return (names[int(wanted)],)
    except (ValueError, IndexError):
        raise ValueError(f"no trait {wanted!r}; there are {', '.join(names)}") from None


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if (args.G is None) == (args.GD is None) or (args.GD is None) != (args.GM is None):
        raise SystemExit("give either --G, or --GD and --GM")
    spark = build_session()
    pheno = read_phenotype(spark, args.Y)
    genotype = read_hapmap(spark, args.G, impute_method=args.SNP_impute) if args.G else read_numeric(spark, args.GD, args.GM, args.SNP_impute)
    rows = pheno.frame.orderBy("row").collect()
    traits = {t: {r["taxon"]: r[t] for r in rows} for t in select_traits(pheno.traits, args.trait)}
    covariates = kinship = None
    if args.CV:
        cv = read_phenotype(spark, args.CV)
        covariates = {r["taxon"]: [r[t] for t in cv.traits] for r in cv.frame.collect()}
    if args.KI:
        table = spark.read.option("sep", "\t").csv(args.KI).toPandas()
        kinship = (table.iloc[:, 0].astype(str).tolist(), table.iloc[:, 1:].to_numpy(float))
    results = run(
        traits, genotype, args.model, covariates, kinship, pca_total=args.PCA_total, maf_threshold=args.maf_threshold, cutoff=args.cutOff, p_threshold=args.p_threshold,
        ld=args.LD, max_loop=args.maxLoop, group_from=args.group_from, group_to=args.group_to, bin_size=args.bin_size, super_bin_size=args.super_bin_size,
        super_counts=tuple(args.super_qtn_counts) if args.super_qtn_counts else None, h2=args.h2, qtn=args.NQTN, predict=args.buspred,
        output=None if args.no_file_output else args.output_dir,
    )
    for name, result in results.items():
        found = 0 if result.significant is None else result.significant.count()
        print(f"{name}: lambda {result.lambda_gc:.3f}, h2 {result.fit.h2:.3f}, {found} significant, {result.seconds:.1f} s")
        if found:
            for row in result.significant.orderBy(F.col("`P.value`"), "marker_idx").limit(3).collect():
                print(f"  {row['SNP']} {row['Chr']}:{row['Pos']} p={row['P.value']:.3g}")
        if result.prediction is not None:
            print(f"  predicted {len(result.taxa)} samples, mean PEV {np.mean(result.prediction.pev):.4g}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
