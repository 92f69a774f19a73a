"""Operators over blocks of samples against the same in memory; no query may ask the driver for all cells or for n x n numbers."""

import numpy as np
import pytest

from locuspark.functions import mixed
from locuspark.operators import gram as G
from locuspark.operators import ld
from locuspark.operators import models as M
from locuspark.operators import predict as P
from locuspark.operators import qc
from locuspark.operators.clusters import DistinctSamples
from locuspark.plans import pipeline, queries
from locuspark.sources.genotype import Genotype, from_array

N, MARKERS = 90, 12


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(7)
    g = rng.binomial(2, rng.uniform(0.1, 0.6, MARKERS), (N, MARKERS)).astype(float)
    g[:, 5] = np.where(rng.random(N) < 0.9, g[:, 2], g[:, 5])
    return g


@pytest.fixture
def geno(spark, values, monkeypatch):
    """Markers in falling order of place on two chromosomes; the driver may not read them."""
    g = from_array(spark, values, chromosomes=["1"] * 7 + ["2"] * 5, positions=np.arange(MARKERS, 0, -1) * 100.0).persist()
    monkeypatch.setattr(Genotype, "markers", lambda *_: pytest.fail("all cells reach the driver"))
    return g


def test_f1_prune_without_cells_on_the_driver(geno, values):
    assert ld.prune_markers(geno, 0.3) == ld.ld_prune(values, 0.3) != list(range(MARKERS))


def test_f3_matrix_without_cells_on_the_driver(geno, values):
    found = {(r["i"], r["j"]): r["r2"] for r in ld.ld_matrix(geno, 10).collect()}
    expected = np.corrcoef(values[:, :10].T) ** 2
    assert len(found) == 55 and all(v == pytest.approx(expected[p], abs=1e-12) for p, v in found.items())


@pytest.mark.parametrize("driver, tile", [(2000, 1 << 24), (5, 8 * N * 4), (5, 1)])
def test_f4_matrix_of_all_markers(spark, values, monkeypatch, driver, tile):
    """No cap on the partners, also of more markers than the driver holds: by tiles of four and of one; missing dosages and a marker that does not vary."""
    monkeypatch.setattr(ld, "MAX_SQUARE", driver, raising=False)
    monkeypatch.setattr(ld, "TILE_BYTES", tile, raising=False)
    rng = np.random.default_rng(11)
    more = np.column_stack([values, np.full(N, 2.0), rng.binomial(2, 0.4, (N, 7 if driver == 5 else 500))]).astype(float)
    more[::9, 3] = np.nan
    found = {(r["i"], r["j"]): r["r2"] for r in ld.ld_matrix(from_array(spark, more).persist()).collect()}
    m = more.shape[1]
    with np.errstate(divide="ignore", invalid="ignore"):
        expected = np.corrcoef(np.nan_to_num(more).T) ** 2
    np.fill_diagonal(expected, 1.0)
    assert sorted(found) == [(i, j) for i in range(m) for j in range(i, m)]
    close([np.nan if found[p] is None else found[p] for p in sorted(found)], [expected[p] for p in sorted(found)], 1e-10)


def test_f11_decay_without_arrays_in_a_join(geno, values):
    found = ld.ld_decay(geno, max_dist=250.0, every=True)
    assert "zip_with" not in found._jdf.queryExecution().toString()
    rows = {(r["i"], r["j"]): (r["distance"], r["r2"]) for r in found.collect()}
    r2 = np.corrcoef(values.T) ** 2
    pairs = [(i, j) for i in range(MARKERS) for j in range(i + 1, MARKERS) if (i < 7) == (j < 7) and j - i <= 2]
    assert sorted(rows) == pairs and all(rows[p] == (100.0 * (p[1] - p[0]), pytest.approx(r2[p], abs=1e-12)) for p in pairs)


@pytest.fixture
def both(spark, values):
    """The genotype, a phenotype and a design; and how to run something in memory and then over blocks."""
    rng = np.random.default_rng(8)
    y = values[:, 3] - 0.7 * values[:, 8] + rng.standard_normal(N)
    return from_array(spark, values).persist(), y, np.column_stack([np.ones(N), rng.standard_normal(N)])


@pytest.fixture
def blocks(monkeypatch):
    """From the call on, a few samples are too many for the driver."""

    def on():
        for module in (G, P, M, mixed):
            for name, value in (("MAX_SAMPLES", 20), ("MAX_CELLS", 0)):
                if hasattr(module, name):
                    monkeypatch.setattr(module, name, value)
        monkeypatch.setattr(Genotype, "markers", lambda *_: pytest.fail("all cells reach the driver"))

    return on


def scanned(rows):
    found = rows.orderBy("marker_idx").collect()
    return np.array([[np.nan if v is None else v for v in r] for r in found], float)


def close(a, b, tolerance=1e-7):
    assert np.allclose(a, b, rtol=tolerance, atol=tolerance, equal_nan=True)


def test_f2_chain_of_products(spark, both, blocks, values):
    g, y, _ = both
    expected = P.bayes_b(y, values, 40, 10, rng=np.random.default_rng(5))[0]
    blocks()
    close(scanned(P.bayes_b_chains(spark, y, g, [5], iterations=40, burn_in=10))[:, 2], expected)


def test_f4_breeding_values(both, blocks):
    g, y, x = both
    a = P.gblup(y, x, G.vanraden(g))
    blocks()
    b = P.gblup(y, x, G.kinship(g))
    for name in ("blue", "blup", "pev", "h2"):
        close(getattr(a, name), getattr(b, name), 1e-6)


def test_f5_f12_f17_components(both, blocks):
    g, _, _ = both
    a = G.pca(g, 3)
    blocks()
    b = G.pca(g, 3)
    close(np.abs(a.scores), np.abs(b.scores))
    close(a.eigenvalues, b.eigenvalues)
    close(a.explained, b.explained)
    close(*[np.abs([r["loadings"] for r in c.loadings.orderBy("marker_idx").collect()]) for c in (a, b)])


def test_f7_stepwise_model(both, blocks):
    g, y, x = both
    a = M.mlmm(g, y, x, G.vanraden(g), max_steps=4)
    expected = scanned(a.rows)
    blocks()
    b = M.mlmm(g, y, x, G.dense_or_blocks(g), max_steps=4)
    assert a.selected == b.selected and a.paths == b.paths
    close(scanned(b.rows), expected, 1e-5)


def test_f9_f15_folds_of_ridge_regression(spark, values, both, blocks):
    _, y, _ = both
    holes = values.copy()
    holes[::7, 4], holes[:72, 9] = np.nan, np.nan
    g = from_array(spark, holes).persist()
    a = [P.cross_validate_rrblup(g, y, penalty=p) for p in (3.0, None)]
    blocks()
    for before, after in zip(a, [P.cross_validate_rrblup(g, y, penalty=p) for p in (3.0, None)]):
        close(before.predictions, after.predictions, 1e-6)
        close(before.penalties, after.penalties, 1e-5)


def test_f13_f18_ridge_effects(both, blocks):
    g, y, _ = both
    a = [P.rrblup(g, y, p) for p in (3.0, None)]
    expected = [scanned(r.effects) for r in a]
    blocks()
    for before, effects, after in zip(a, expected, [P.rrblup(g, y, p) for p in (3.0, None)]):
        close(scanned(after.effects), effects, 1e-6)
        close(before.prediction, after.prediction, 1e-6)


def test_f16_mixed_scan(both, blocks):
    g, y, x = both
    a = M.mlm(g, y, x, G.vanraden(g))
    expected = scanned(a.rows)
    blocks()
    close(scanned(M.mlm(g, y, x, G.kinship(g)).rows), expected, 1e-6)


def test_f19_selected_markers(both, blocks):
    g, y, x = both
    rows = M.mlm(g, y, x, G.vanraden(g)).rows.persist()
    a = P.select_super(g, rows, y, x, 1.0, (2, 4, 8))
    expected = P.sblup(g, y, x, a.markers)
    blocks()
    k = G.kinship(g)
    b = P.select_super(g, rows, y, x, 1.0, (2, 4, 8), k)
    assert a.markers == b.markers
    found = P.sblup(g, y, x, b.markers, k=k)
    close(found.blup, expected.blup, 1e-6)
    close(found.pev, expected.pev, 1e-6)


def test_f20_folds_of_gblup(both, blocks):
    g, y, _ = both
    a = P.cross_validate_gblup(y, G.vanraden(g))
    blocks()
    b = P.cross_validate_gblup(y, G.dense_or_blocks(g))
    close(a.predictions, b.predictions, 1e-6)
    close(a.penalties, b.penalties, 1e-5)


def test_f21_new_samples(both, blocks):
    g, y, _ = both
    k, train = G.vanraden(g), N * 3 // 4
    fit = P.gblup(y[:train], np.ones((train, 1)), k[:train, :train])
    expected = P.predict_new(k[:train, :train], k[train:, :train], fit.blup)
    blocks()
    close(P.predict_new_blocks(G.dense_or_blocks(g), y, train), expected, 1e-5)


def test_f8_f14_whole_run(spark, both, blocks, tmp_path, monkeypatch):
    """With files, components and predictions; a trait with holes."""
    g, y, _ = both
    traits = {"a": dict(zip(g.taxa, y.tolist())), "b": {t: None if i % 13 == 0 else float(v) for i, (t, v) in enumerate(zip(g.taxa, y))}}
    options = dict(pca_total=2, predict=True, p_threshold=0.05, maf_threshold=0.0)
    run = lambda folder: pipeline.run(traits, g, ["GLM", "MLM", "FarmCPU"], output=str(tmp_path / folder), **options)
    before = run("before")
    expected = {k: [tuple(x) for x in r.gwas.select("SNP", "`P.value`").collect()] for k, r in before.items()}
    cells = Genotype.markers
    blocks()
    monkeypatch.setattr(Genotype, "markers", cells)  # FarmCPU's cofactors
    monkeypatch.setattr(pipeline, "MAX_SAMPLES", 20)
    after = run("after")
    for name, rows in expected.items():
        found = dict(tuple(x) for x in after[name].gwas.select("SNP", "`P.value`").collect())
        assert all(found[s] == pytest.approx(p, rel=1e-5, abs=1e-9) for s, p in rows) and len(found) == len(rows)
        close(after[name].prediction.prediction, before[name].prediction.prediction, 1e-5)
    k = before["a_MLM"].kinship
    f = {r[0]: np.array(r[1:], float) for r in spark.read.option("header", True).csv(after["a_MLM"].files.kinship).collect()}
    f = np.stack([f[t] for t in g.taxa])
    close(f @ f.T, k)


def test_f1_traits_as_arrays(spark, both, monkeypatch):
    """The same as dictionaries, and none is made by taxon; the query collects no row for each sample."""
    g, y, _ = both
    holes = np.where(np.arange(N) % 13 == 0, np.nan, y)
    expected = pipeline.align({"a": dict(zip(g.taxa, y)), "b": {t: None if np.isnan(v) else v for t, v in zip(g.taxa, holes)}}, g)
    found = pipeline.align({"a": qc.Trait(g.taxa, y), "b": qc.Trait(g.taxa, holes)}, g)
    assert found.taxa == expected.taxa and found.genotype is g and found.dropped == 0
    for name in "ab":
        close(found.phenotype[name], expected.phenotype[name], 0)
    other = qc.Trait(("T3", "T1", "X"), np.array([1.0, 2.0, 3.0]))
    part = pipeline.align({"a": other}, g)
    assert part.taxa == ("T3", "T1") and part.phenotype["a"].tolist() == [1.0, 2.0] and part.dropped == 1
    seen = {}
    monkeypatch.setattr(queries, "run", lambda traits, g, *a, **k: seen.update(traits) or {})
    queries.pipeline_multi_trait(spark, "/root/testdata/sf0.001")
    assert all(isinstance(t, qc.Trait) for t in seen.values()) and np.isnan(seen["holes"].values).sum() == len(range(0, 150, 13))
    assert not np.isnan(seen["balance"].values).any()


def repeated(spark, values, both):
    """Samples of which some have the same dosages, each twice or thrice."""
    _, y, x = both
    who = np.concatenate([np.arange(N), np.arange(0, N, 2), np.arange(0, N, 6)])
    rng = np.random.default_rng(9)
    return from_array(spark, values[who]).persist(), y[who] + 0.3 * rng.standard_normal(len(who)), x[who] + [0, 1] * rng.standard_normal((len(who), 2))


@pytest.mark.parametrize("held", [1 << 26, 1])
def test_f6_f10_linkage_without_all_distances(held, monkeypatch):
    """As with all distances, also where rows of distances are given up and made again, and with equal points as one."""
    monkeypatch.setattr(mixed, "LINKAGE_BYTES", held)
    monkeypatch.setattr(mixed, "LINKAGE_ROWS", 4 if held > 1 else 1)
    rng = np.random.default_rng(3)
    for n, m in ((2, 2), (120, 4), (300, 12)):
        points, weight = rng.normal(size=(n, m)), rng.integers(1, 4, n)
        close(mixed.average_linkage_of(points), mixed.average_linkage(points), 1e-10)
        close(mixed.average_linkage_of(points, weight)[:, 2], mixed.average_linkage(np.repeat(points, weight, axis=0))[1 - n :, 2], 1e-7)


@pytest.mark.parametrize("held", [1 << 28, 1])
def test_f2_f3_rows_of_distances_are_made_once(held, monkeypatch):
    """As many chains at a time as rows fit: with room, a row for each point and a few batches; without, the same merges."""
    monkeypatch.setattr(mixed, "LINKAGE_BYTES", held)
    monkeypatch.setattr(mixed, "LINKAGE_PART", 200, raising=False)
    rng = np.random.default_rng(4)
    centres, sums = rng.normal(size=(9, 6)) * 3, mixed._Distances.__dict__.get("_sums", mixed._Distances.__dict__.get("_from"))
    points = np.vstack([centres[i % 9] + rng.normal(size=6) for i in range(900)])
    made = []
    monkeypatch.setattr(mixed._Distances, sums.__name__, lambda self, at: made.append(len(at)) or sums(self, at))
    found, expected = mixed.average_linkage_of(points), mixed.average_linkage(points)
    close(found, expected, 1e-10)
    if held > 1:
        assert sum(made) == 900 and len(made) < 900 / 8


def test_f6_clusters_of_many_samples(both, blocks):
    """Not all levels: at as many clusters as samples, prediction error variances rest on the rounding of zero eigenvalues."""
    g, y, x = both
    expected = [P.cblup(g, y, x, group_to=most) for most in (3, 8, 12)]
    blocks()
    for a, most in zip(expected, (3, 8, 12)):
        b = P.cblup(g, y, x, group_to=most)
        for name in ("blue", "blup", "pev", "h2"):
            close(getattr(a, name), getattr(b, name), 1e-6)


def test_f6_clusters_of_equal_samples(spark, values, both, blocks):
    g, y, x = repeated(spark, values, both)
    expected = [P.cblup(g, y, x, group_to=most) for most in (9, None)]
    blocks()
    for a, most in zip(expected, (9, None)):
        b = P.cblup(g, y, x, group_to=most)
        for name in ("blue", "blup", "h2"):
            close(getattr(a, name), getattr(b, name), 1e-5)


def test_f6_error_variances_of_singular_kinships(spark, values, both, blocks):
    """Against the inverse, with eigenvalues of zero left out: of clusters, and of samples apart."""
    g, y, x = repeated(spark, values, both)
    k = G.vanraden(g)
    fit = mixed.reml(y, x, k)
    blocks()
    samples = DistinctSamples.of(G.dense_or_blocks(g))
    for groups in (40, N, len(y)):
        level = samples.level(groups, samples.merges())
        own = np.arange(len(y)) if level.apart else level.label[samples.place]
        z = np.eye(own.max() + 1)[own]
        means = z / z.sum(axis=0)
        inner = np.linalg.pinv(means.T @ k @ means, rcond=1e-10, hermitian=True)
        expected = np.diag(np.linalg.inv(z.T @ z / fit.ve + inner / fit.vg))
        close(samples.posterior(level, fit)[level.label[samples.place]], expected[own], 1e-8)


def test_f10_scan_over_clusters(spark, values, both, blocks):
    """Few clusters, and up to as many as samples; equal samples; missing dosages and a marker that does not vary."""
    holes = np.column_stack([values, np.full(N, 2.0)])
    holes[::7, 4] = np.nan
    cases = [(from_array(spark, holes).persist(), *both[1:]), repeated(spark, values, both)]
    expected = []
    for g, y, x in cases:
        k = G.vanraden(from_array(spark, np.delete(holes, 4, axis=1))) if g is cases[0][0] else G.vanraden(g)
        for most in (8, 25, None):
            found = M.cmlm(g, y, x, k, group_to=most)
            expected.append((found.method, found.h2, scanned(found.rows)))
    blocks()
    for (g, y, x), most in [(c, most) for c in cases for most in (8, 25, None)]:
        found = M.cmlm(g, y, x, G.dense_or_blocks(g), group_to=most)
        method, h2, rows = expected.pop(0)
        assert found.method == method
        close(found.h2, h2, 1e-5)
        close(scanned(found.rows), rows, 1e-5)
