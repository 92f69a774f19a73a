"""One call from inputs to result tables: prepare each trait once, run each model, predict, write."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuspark.functions import mixed
from locuspark.operators import models as M
from locuspark.operators import predict as P
from locuspark.operators import scan as S
from locuspark.operators.blocks import BlockKinship
from locuspark.operators.gram import Components, design, gram, pca, scaled_gram, square_to_long, zhang_from
from locuspark.operators.qc import Aligned, align, filter_maf
from locuspark.operators.testing import bonferroni_threshold, inflation, qq
from locuspark.operators.viz import manhattan
from locuspark.session import MAX_SAMPLES
from locuspark.sources.genotype import Genotype
from locuspark.sources.sinks import OutputFiles, result_path, write_csv

MODELS = ("GLM", "MLM", "CMLM", "MLMM", "FARMCPU", "BLINK", "GBLUP", "CBLUP", "SBLUP")
PREDICTORS = ("GBLUP", "CBLUP", "SBLUP")
LEAST_VALUES = 10


@dataclass(frozen=True)
class Options:
    """Everything that a run can be told; checked before any data are read."""

    models: tuple[str, ...] = ("BLINK",)
    pca_total: int = 3
    maf_threshold: float = 0.05
    cutoff: float | None = None
    p_threshold: float | None = None
    fdr_cut: bool = False
    ld: float = 0.7
    group_from: int = 1
    group_to: int | None = None
    bin_size: float = 5_000_000
    max_loop: int = 10
    super_bin_size: float = 10_000
    super_counts: tuple[int, ...] | None = None
    predict: bool = False
    prediction_model: str | None = None
    h2: float | None = None
    qtn: int | None = None
    kinship: str = "VanRaden"
    multiple: bool = False
    output: str | None = None

    @classmethod
    def of(cls, model: str | Sequence[str] = "BLINK", **given) -> Options:
        names = [model] if isinstance(model, str) else list(model)
        if not names:
            raise ValueError("name a model")
        if any(not isinstance(n, str) or not n.strip() for n in names):
            raise TypeError("model names must be strings")
        names = [n.strip().upper() for n in names]
        if len(set(names)) < len(names):
            raise ValueError("models must not repeat")
        unknown = [n for n in names if n not in MODELS]
        if unknown:
            raise ValueError(f"unknown models {', '.join(unknown)}; choose from {', '.join(MODELS)}")
        kinship = given.get("kinship", "VanRaden")
        if not isinstance(kinship, str):
            raise TypeError("kinship must be a string")
        match = {"vanraden": "VanRaden", "zhang": "Zhang"}.get(kinship.strip().casefold())
        if match is None:
            raise ValueError("kinship must be VanRaden or Zhang")
        predictor = given.get("prediction_model")
        if predictor is not None:
            if not isinstance(predictor, str) or not predictor.strip():
                raise TypeError("prediction_model must be a string")
            predictor = predictor.strip().upper()
            if predictor not in PREDICTORS:
                raise ValueError("prediction_model must be gBLUP, cBLUP or sBLUP")
        out = cls(tuple(names), **{**given, "kinship": match, "prediction_model": predictor})
        out._check()
        return out

    def needs_kinship(self) -> bool:
        return self.predict or self.prediction_model is not None or self.output is not None or any(m not in ("GLM", "FARMCPU", "BLINK") for m in self.models)

    def _check(self) -> None:
        for name in ("fdr_cut", "multiple"):
            if not isinstance(getattr(self, name), bool):
                raise TypeError(f"{name} must be a boolean")
        for name in ("cutoff", "p_threshold"):
            value = getattr(self, name)
            if value is not None and not 0 < value <= 1:
                raise ValueError(f"{name} must be between 0 and 1")
        checks = [
            (self.pca_total >= 0, "pca_total must not be negative"),
            (0 <= self.maf_threshold <= 0.5, "maf_threshold must be between 0 and 0.5"),
            (0 <= self.ld <= 1, "ld must be between 0 and 1"),
            (self.group_from >= 1, "group_from must be at least 1"),
            (self.group_to is None or self.group_to >= self.group_from, "group_to must not be below group_from"),
            (self.bin_size > 0, "bin_size must be positive"),
            (self.max_loop >= 1, "max_loop must be at least 1"),
            (self.super_bin_size > 0, "super_bin_size must be positive"),
            ((self.h2 is None) == (self.qtn is None), "h2 and qtn go together"),
            (self.h2 is None or 0 < self.h2 <= 1, "h2 must be in (0, 1]"),
            (self.qtn is None or self.qtn >= 1, "qtn must be at least 1"),
        ]
        if self.super_counts is not None:
            if any(type(c) is not int for c in self.super_counts):
                raise TypeError("super_counts must be integers")
            checks.append((len(self.super_counts) > 0 and min(self.super_counts) > 0, "super_counts must be positive and not empty"))
        for ok, message in checks:
            if not ok:
                raise ValueError(message)


@dataclass(frozen=True)
class Prepared:
    """What the traits with the same missing values share."""

    genotype: Genotype
    kinship: np.ndarray | BlockKinship | None
    x: np.ndarray
    components: Components | None
    markers: int
    spectra: dict[str, mixed.Spectrum] = field(default_factory=dict)

    def spectrum(self) -> mixed.Spectrum | None:
        """None where the kinship lies in blocks, which keep their own products."""
        if isinstance(self.kinship, BlockKinship):
            return None
        if "null" not in self.spectra:
            self.spectra["null"] = mixed.spectrum(self.kinship, self.x)
        return self.spectra["null"]


@dataclass(frozen=True)
class Result:
    model: str
    trait: str
    gwas: DataFrame
    significant: DataFrame | None
    lambda_gc: float
    prediction: P.Prediction | None
    fit: M.ModelResult
    kinship: np.ndarray | BlockKinship | None
    components: Components | None
    taxa: tuple[str, ...]
    files: OutputFiles | None
    seconds: float


def prepare(aligned: Aligned, y: np.ndarray, options: Options) -> Prepared:
    """Mask, frequency filter, one Gram job for kinship and components, design."""
    seen = np.nonzero(~np.isnan(y))[0]
    part = aligned.genotype if len(seen) == aligned.genotype.n else aligned.genotype.view(samples=seen)
    kept = filter_maf(part, options.maf_threshold)
    kept = kept.with_packed(kept.packed.drop("maf")).persist()
    m = kept.count()
    if not m:
        raise ValueError(f"no marker passes the frequency threshold {options.maf_threshold}")
    needs_kinship = options.needs_kinship() and aligned.kinship is None
    blocks = kept.n > MAX_SAMPLES and (needs_kinship or options.pca_total > 0)
    if blocks and needs_kinship and options.kinship != "VanRaden":
        raise ValueError(f"Zhang's kinship takes {MAX_SAMPLES} samples at most")
    shared = BlockKinship.of(kept) if blocks else gram(kept, "mean") if needs_kinship or options.pca_total else None
    if blocks and shared.empty:
        raise ValueError("no marker varies")
    if aligned.kinship is not None:
        k = aligned.kinship[np.ix_(seen, seen)]
    elif not needs_kinship:
        k = None  # fixed-effect scans have no use for an n x n matrix
    else:
        # Above the bound, as a factor in blocks of samples.  Markers are imputed here, so both centrings are one.
        k = shared if blocks else scaled_gram(shared, kept.n) if options.kinship == "VanRaden" else zhang_from(shared, kept.n)
    components = None
    if options.pca_total:
        components = pca(kept, options.pca_total, known=shared if blocks or options.maf_threshold >= 0.05 else None)
    cv = None if aligned.covariates is None else aligned.covariates[seen]
    return Prepared(kept, k, design(kept.n, None if components is None else components.scores, options.pca_total, cv), components, m)


def _constant(prepared: Prepared) -> DataFrame:
    """Scan rows of models that only predict."""
    return prepared.genotype.packed.select("marker_idx", *[F.lit(v).alias(c) for c, v in (("p_value", 1.0), ("effect", 0.0), ("se", 1.0), ("stat", 0.0))])


def _blocks(k: np.ndarray | BlockKinship | None) -> BlockKinship | None:
    return k if isinstance(k, BlockKinship) else None


def run_model(name: str, prepared: Prepared, y: np.ndarray, options: Options, shared: dict[str, M.ModelResult]) -> tuple[M.ModelResult, P.Prediction | None]:
    """A model's scan and, where it has one, its own prediction."""
    g, x, k, taxa = prepared.genotype, prepared.x, prepared.kinship, prepared.genotype.taxa
    threshold = options.p_threshold if options.p_threshold is not None else 1.0 / prepared.markers

    def mlm() -> M.ModelResult:
        if "MLM" not in shared:
            found = M.mlm(g, y, x, k, known=prepared.spectrum())
            shared["MLM"] = M.ModelResult(found.rows.persist(), "MLM", found.vg, found.ve, found.h2)
        return shared["MLM"]

    if name == "GLM":
        return M.glm(g, y, x), None
    if name == "MLM":
        return mlm(), None
    if name == "CMLM":
        return M.cmlm(g, y, x, k, options.group_from, min(options.group_to or g.n, g.n)), None
    if name == "MLMM":
        return M.mlmm(g, y, x, k), None
    if name == "FARMCPU":
        return M.farmcpu(g, y, x, options.max_loop, options.bin_size, threshold), None
    if name == "BLINK":
        by_fdr = options.fdr_cut and options.p_threshold is None
        alpha = (options.cutoff if options.cutoff is not None else 0.05) if by_fdr else None
        return M.blink(g, y, x, options.max_loop, options.ld, None if by_fdr else threshold, alpha), None
    if name == "SBLUP":
        found = mlm()
        chosen = P.select_super(g, found.rows, y, x, options.super_bin_size, options.super_counts, _blocks(k)).markers
        fit = P.sblup(g, y, x, chosen, taxa, _blocks(k))
        return M.ModelResult(found.rows, "SBLUP", fit.vg, fit.ve, fit.h2, chosen), fit
    fit = P.gblup(y, x, k, taxa, prepared.spectrum()) if name == "GBLUP" else P.cblup(g, y, x, taxa, options.group_to, _blocks(k))
    return M.ModelResult(_constant(prepared), name, fit.vg, fit.ve, fit.h2), fit


def predict(name: str, prepared: Prepared, y: np.ndarray, found: M.ModelResult, own: P.Prediction | None, options: Options) -> P.Prediction | None:
    chosen = options.prediction_model
    if not (options.predict or chosen or name in PREDICTORS):
        return None
    if chosen is None:
        chosen = name if name in ("CBLUP", "SBLUP") else "SBLUP" if name == "FARMCPU" and found.selected else "GBLUP"
    if chosen == "SBLUP" and not found.selected:
        raise ValueError("sBLUP needs markers that the model selected")
    if own is not None and options.prediction_model in (None, name):
        return own
    g, x = prepared.genotype, prepared.x
    try:
        if chosen == "SBLUP":
            return P.sblup(g, y, x, found.selected, g.taxa, _blocks(prepared.kinship))
        if chosen == "CBLUP":
            return P.cblup(g, y, x, g.taxa, options.group_to, _blocks(prepared.kinship))
        return P.gblup(y, x, prepared.kinship, g.taxa)
    except (ValueError, np.linalg.LinAlgError) as error:
        warnings.warn(f"prediction failed: {error}", stacklevel=2)
        return None


def run(
    traits: dict[str, Mapping[str, float | None]],
    genotype: Genotype,
    model: str | Sequence[str] = "BLINK",
    covariates: dict[str, Sequence[float]] | None = None,
    kinship: tuple[Sequence[str], np.ndarray] | None = None,
    **given,
) -> dict[str, Result]:
    """Results by ``trait_MODEL``; traits with fewer than ten values are skipped with a warning."""
    options = Options.of(model, **given)
    if options.h2 is not None:
        simulated = P.simulate_phenotype(genotype, options.h2, options.qtn)
        traits = {"SimTrait": dict(zip(genotype.taxa, simulated.tolist()))}
    aligned = align(traits, genotype, covariates, kinship)
    if aligned.dropped:
        warnings.warn(f"kept {len(aligned.taxa)} of {len(aligned.taxa) + aligned.dropped} taxa", stacklevel=2)
    cache: dict[bytes, Prepared] = {}
    results: dict[str, Result] = {}
    for trait, column in aligned.phenotype.items():
        seen = ~np.isnan(column)
        if seen.sum() < LEAST_VALUES:
            warnings.warn(f"only {int(seen.sum())} samples have {trait}; skipped", stacklevel=2)
            continue
        key = seen.tobytes()
        if key not in cache:
            cache[key] = prepare(aligned, column, options)
        prepared, y, shared = cache[key], column[seen], {}
        for name in options.models:
            results[f"{trait}_{name}"] = _one(name, trait, prepared, y, options, shared)
    return results


def _one(name: str, trait: str, prepared: Prepared, y: np.ndarray, options: Options, shared: dict) -> Result:
    began = time.time()
    found, own = run_model(name, prepared, y, options, shared)
    rows = found.rows.persist()
    table = S.gwas_table(prepared.genotype, rows).persist()
    threshold = options.cutoff if options.cutoff is not None else bonferroni_threshold(prepared.markers)
    hits = table.where(F.col("`P.value`") <= threshold)
    prediction = predict(name, prepared, y, found, own, options)
    files = None
    if options.output is not None:
        files = write_results(name, trait, prepared, rows, table, prediction, options.output)
    return Result(name, trait, table, None if hits.isEmpty() else hits, inflation(rows, "p_value"), prediction, found, prepared.kinship, prepared.components, prepared.genotype.taxa, files, time.time() - began)


def write_results(name: str, trait: str, prepared: Prepared, rows: DataFrame, table: DataFrame, prediction: P.Prediction | None, folder: str) -> OutputFiles:
    spark = rows.sparkSession
    at = lambda what, model=None: result_path(folder, model, trait, what)
    placed = rows.join(prepared.genotype.packed.select("marker_idx", "chromosome", "position"), "marker_idx")
    pca_path = None
    if prepared.components is not None:
        scores = prepared.components.scores
        frame = spark.createDataFrame(pa.table({"Taxa": pa.array(prepared.genotype.taxa), **{f"PC{i + 1}": scores[:, i] for i in range(scores.shape[1])}}))
        pca_path = write_csv(frame, at("PCA"))
    return OutputFiles(
        gwas=write_csv(table.drop("marker_idx"), at("GWAS.Results", name)),
        prediction=None if prediction is None else write_csv(prediction.frame(spark), at("Prediction", name)),
        kinship=_write_kinship(spark, prepared, at),
        pca=pca_path,
        manhattan=write_csv(manhattan(placed).tables["points"], at("Manhattan", name)),
        qq=write_csv(qq(rows, "p_value", "marker_idx"), at("QQ", name)),
    )


def _write_kinship(spark: SparkSession, prepared: Prepared, at: Callable[[str], str]) -> str:
    """In long form; where it lies in blocks, as its factor F with a column for each marker, as F F' has n x n cells."""
    k = prepared.kinship
    if not isinstance(k, BlockKinship):
        return write_csv(square_to_long(spark, k, prepared.genotype.taxa), at("Kinship"))
    names = dict(prepared.genotype.packed.select("marker_idx", "snp").collect())
    used = [int(i) for i in k.blocks.markers[k.columns]]
    return write_csv(k.factor_frame(prepared.genotype.taxa, [f"{names[i]}" for i in used]), at("KinshipFactor"))


def multiple_tables(results: dict[str, Result], trait: str) -> dict[str, DataFrame]:
    """A trait's GWAS tables by model, without those that only predict, for joint plots."""
    return {r.model: r.gwas for r in results.values() if r.trait == trait and r.model not in ("GBLUP", "CBLUP")}
