"""Scans and models against dense formulations."""

import numpy as np
import pytest

from locuspark.functions import mixed, special
from locuspark.operators import gram as G
from locuspark.operators import models as M
from locuspark.operators import predict as P
from locuspark.operators import scan as S
from locuspark.operators.ld import ld_prune
from locuspark.plans.pipeline import Options, run
from locuspark.sources.genotype import from_array

N, MARKERS = 70, 60


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(20260916)
    g = rng.binomial(2, rng.uniform(0.2, 0.5, MARKERS), (N, MARKERS)).astype(float)
    g[:, 59] = 1.0
    x = np.column_stack([np.ones(N), rng.normal(size=N)])
    y = 2.5 * g[:, 10] - 2.0 * g[:, 40] + x[:, 1] + rng.normal(size=N)
    chromosomes = [str(1 + i // 20) for i in range(MARKERS)]
    positions = [1e6 * (1 + i % 20) for i in range(MARKERS)]
    return from_array(spark, g, chromosomes=chromosomes, positions=positions).persist(), g, x, y


def rows(frame):
    found = sorted(frame.collect(), key=lambda r: r["marker_idx"])
    return {c: np.array([np.nan if r[c] is None else r[c] for r in found]) for c in ("p_value", "effect", "se", "stat")}


def dense_gls(y, x, g, v):
    """Coefficient of g, and the last diagonal of the inverse information."""
    full = np.column_stack([x, g])
    vi = np.linalg.inv(v)
    inverse = np.linalg.inv(full.T @ vi @ full)
    return (inverse @ full.T @ vi @ y)[-1], inverse[-1, -1], full, inverse


def test_glm_matches_ordinary_least_squares(data):
    geno, g, x, y = data
    found = rows(S.glm(geno, y, x))
    for j in (0, 10, 33):
        effect, spread, full, _ = dense_gls(y, x, g[:, j], np.eye(N))
        left = y - full @ np.linalg.lstsq(full, y, rcond=None)[0]
        se = np.sqrt(left @ left / (N - 3) * spread)
        assert found["effect"][j] == pytest.approx(effect, rel=1e-10)
        assert found["se"][j] == pytest.approx(se, rel=1e-10)
        assert found["p_value"][j] == pytest.approx(special.t_two_sided(np.array([effect / se]), N - 3)[0], rel=1e-9)
    assert [found[c][59] for c in ("effect", "se", "stat", "p_value")] == [0, 1, 0, 1]
    assert int(np.argmin(found["p_value"])) in (10, 40)


def test_reward_takes_the_best_substitute(data):
    geno, g, x, y = data
    chosen = [10, 40]
    scanned = S.glm(geno, y, x, chosen)
    found = rows(S.reward(geno, scanned, y, x, chosen))
    base = np.column_stack([x, g[:, chosen]])
    best = np.ones(2)
    for j in range(MARKERS):
        r = g[:, j] - base @ np.linalg.lstsq(base, g[:, j], rcond=None)[0]
        if r @ r < 1e-8:
            continue
        full = np.column_stack([base, g[:, j]])
        beta = np.linalg.lstsq(full, y, rcond=None)[0]
        left = y - full @ beta
        t = beta / np.sqrt(np.diag(np.linalg.inv(full.T @ full)) * (left @ left) / (N - 5))
        best = np.minimum(best, special.t_two_sided(t[2:4], N - 5))
    assert np.allclose(found["p_value"][chosen], best, rtol=1e-8)
    assert np.allclose(found["effect"][chosen], np.linalg.lstsq(base, y, rcond=None)[0][2:], rtol=1e-9)


def test_mlm_uses_the_null_variance(data):
    geno, g, x, y = data
    k = G.vanraden(geno)
    model = M.mlm(geno, y, x, k)
    found = rows(model.rows)
    fit = mixed.reml(y, x, k)
    for j in (3, 10):
        effect, spread, _, _ = dense_gls(y, x, g[:, j], k + fit.delta * np.eye(N))
        assert found["effect"][j] == pytest.approx(effect, rel=1e-7)
        assert found["se"][j] == pytest.approx(np.sqrt(fit.vg * spread), rel=1e-7)
    assert np.isnan(found["effect"][59]) and found["p_value"][59] == 1
    holes = g.copy()
    holes[3, 5] = np.nan
    part = rows(M.mlm(from_array(geno.packed.sparkSession, holes), y, x, k, impute="none").rows)
    seen = np.isfinite(holes[:, 5])
    effect, spread, _, _ = dense_gls(y[seen], x[seen], g[seen, 5], (k + fit.delta * np.eye(N))[np.ix_(seen, seen)])
    assert part["effect"][5] == pytest.approx(effect, rel=1e-6)


def test_kinships_and_components(data, spark):
    geno, g, _, _ = data
    f = g.mean(axis=0) / 2
    keep = (f > 0) & (f < 1)
    z = (g - 2 * f)[:, keep]
    assert np.allclose(G.vanraden(geno), z @ z.T / (2 * f * (1 - f))[keep].sum(), atol=1e-12)
    assert np.allclose(G.vanraden_factor(g) @ G.vanraden_factor(g).T, G.vanraden(geno), atol=1e-12)
    assert np.diag(G.scale_kinship(G.vanraden(geno))).mean() == pytest.approx(1)
    found = G.pca(geno, 3)
    use = np.minimum(f, 1 - f) >= 0.05
    u, s, vt = np.linalg.svd((g - 2 * f)[:, use], full_matrices=False)
    assert np.allclose(found.eigenvalues, s[:3] ** 2 / (N - 1))
    assert np.allclose(np.abs(found.scores), np.abs(u[:, :3] * s[:3]), atol=1e-8)
    loadings = np.array([r["loadings"] for r in found.loadings.orderBy("marker_idx").collect()])
    assert np.allclose(np.abs(loadings), np.abs(vt[:3].T), atol=1e-8)
    zhang = G.zhang(geno)
    assert np.allclose(zhang, zhang.T) and zhang.max() <= 2.0 + 1e-9
    with pytest.warns(UserWarning):
        assert np.array_equal(G.vanraden(from_array(spark, np.ones((4, 3)) * 2)), np.eye(4))


def test_iterative_models_find_the_planted_markers(data):
    geno, _, x, y = data
    k = G.vanraden(geno)
    for model in (M.farmcpu(geno, y, x, bin_size=1e6), M.blink(geno, y, x), M.mlmm(geno, y, x, k, max_steps=5)):
        assert {10, 40} <= set(model.selected)
        found = rows(model.rows)
        assert set(np.argsort(found["p_value"])[:2]) == {10, 40}
    assert M.cmlm(geno, y, x, k, group_to=40).method.startswith("CMLM(g=")
    with pytest.raises(ValueError):
        M.cmlm(geno, y, x, k, group_to=2)


def test_blink_without_candidates_calibrates(data):
    geno, _, x, _ = data
    y = np.random.default_rng(1).normal(size=N)
    model = M.blink(geno, y, x, threshold=1e-9)
    assert model.selected == ()
    plain = rows(S.glm(geno, y, x))["p_value"]
    c = -np.log10(np.quantile(plain, 0.05)) / 1.3
    assert np.allclose(rows(model.rows)["p_value"], np.minimum(1, plain ** (1 / c)), rtol=1e-9)


def test_ld_prune():
    base = np.array([[0, 1, 2, 0, 1, 2, 2, 0, 1, 0, 2, 1]]).T
    other = np.array([[0, 0, 1, 2, 2, 1, 0, 1, 2, 2, 0, 0]]).T
    values = np.column_stack([base, other, base, 2 - other, np.ones(12)])
    assert ld_prune(values, 0.7) == [0, 1]


def test_bic_prefix(data):
    _, g, x, y = data
    assert M.select_by_bic(y, x, g[:, [10, 40, 5, 6]]) == 2


def test_gblup_solves_henderson(data):
    geno, g, x, y = data
    k = G.vanraden(geno) + 0.05 * np.eye(N)
    fit = P.gblup(y, x, k, geno.taxa)
    lhs = np.block([[x.T @ x / fit.ve, x.T / fit.ve], [x / fit.ve, np.eye(N) / fit.ve + np.linalg.inv(k) / fit.vg]])
    inverse = np.linalg.inv(lhs)
    solution = inverse @ np.concatenate([x.T @ y, y]) / fit.ve
    assert np.allclose(fit.blue, x @ solution[:2], atol=1e-8)
    assert np.allclose(fit.blup, solution[2:], atol=1e-8)
    assert np.allclose(fit.pev, np.diag(inverse)[2:], atol=1e-8)
    assert np.allclose(P.predict_new(k, k, fit.blup), fit.blup, atol=1e-5)
    assert fit.frame(geno.packed.sparkSession).columns == ["Taxa", "BLUE", "BLUP", "PEV", "gBreedingValue", "Prediction"]
    grouped = P.cblup(geno, y, x, geno.taxa)
    assert grouped.method == "cBLUP" and np.isfinite(grouped.pev).all()


def test_low_rank_kinship_equals_the_dense_one(data, spark):
    geno, g, x, y = data
    few = from_array(spark, g[:, :30])
    dense, factor = G.vanraden(few), G.kinship(few)
    assert isinstance(factor, mixed.Factor) and np.allclose(factor.block(np.arange(N), np.arange(N)), dense, atol=1e-10)
    assert np.allclose(factor.times(y), dense @ y) and np.allclose(factor.solve(0.3, x), np.linalg.solve(dense + 0.3 * np.eye(N), x))
    a, b = mixed.reml(y, x, dense), mixed.reml(y, x, factor)
    assert (a.reml, a.vg, a.ve) == pytest.approx((b.reml, b.vg, b.ve), rel=1e-6)
    for h2 in (None, 0.4):
        one, two = (rows(M.mlm(geno, y, x, k, h2=h2).rows) for k in (dense, factor))
        assert all(np.allclose(one[c], two[c], rtol=1e-5, atol=1e-8, equal_nan=True) for c in one)
        one, two = (P.gblup(y, x, k, h2=h2) for k in (dense, factor))
        assert np.allclose(one.blup, two.blup, atol=1e-5) and np.allclose(one.pev, two.pev, atol=1e-5) and np.allclose(one.blue, two.blue, atol=1e-5)
    known = mixed.given(y, x, dense, 0.4)
    assert known.h2 == pytest.approx(0.4) and known.reml <= a.reml + 1e-9


def test_wide_genotypes_use_the_samples_side(data, spark):
    _, g, _, y = data
    wide = from_array(spark, g[:25])
    assert G.narrow(wide) is None and isinstance(G.kinship(wide), np.ndarray)
    found = G.pca(wide, 2, maf=0.0)
    centred = g[:25] - g[:25].mean(axis=0)
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(np.abs(found.scores), np.abs(u[:, :2] * s[:2]), atol=1e-8)
    fit = P.rrblup(wide, y[:25], 3.0)
    effects = np.linalg.solve(centred.T @ centred + 3 * np.eye(MARKERS), centred.T @ (y[:25] - y[:25].mean()))
    assert np.allclose([r["effect"] for r in fit.effects.orderBy("marker_idx").collect()], effects, atol=1e-9)


def test_group_means_of_a_compressed_kinship(data):
    geno = data[0]
    k = G.vanraden(geno)
    small, z = M.compress_kinship(k, 9)
    assert np.allclose(small, np.linalg.inv(z.T @ z) @ z.T @ k @ z @ np.linalg.inv(z.T @ z)) and (z.sum(axis=1) == 1).all()


def test_unit_kinship(data):
    _, _, x, y = data
    k = G.vanraden(data[0])
    unit = M.UnitKinship.of(k)
    p = np.eye(N) - 1 / N
    assert np.trace(p @ unit.matrix @ p) == pytest.approx(N - 1)
    best = -np.inf
    for d in np.exp(np.linspace(-10, 10, 4001)):
        v = unit.matrix + d * np.eye(N)
        beta = np.linalg.solve(x.T @ np.linalg.solve(v, x), x.T @ np.linalg.solve(v, y))
        left = y - x @ beta
        s2 = left @ np.linalg.solve(v, left) / N
        best = max(best, -0.5 * (N * np.log(2 * np.pi * s2) + np.linalg.slogdet(v)[1] + N))
    assert unit.likelihood(y, x) == pytest.approx(best, abs=1e-4) and unit.likelihood(y, x) >= best - 1e-9
    for bad in (-k, np.ones((N, N)), k + np.triu(np.ones((N, N)))):
        with pytest.raises(ValueError):
            M.UnitKinship.of(bad)


def test_nth_markers(spark):
    geno = from_array(spark, np.zeros((3, 40)))
    odd = geno.with_packed(geno.packed.where("marker_idx % 2 = 1"))
    assert P.nth_markers(odd, [19, 0, 7]) == [39, 1, 15]


def test_spike_and_slab_keeps_its_score(data):
    _, g, _, y = data
    centred = y - y.mean()
    chain = P.SpikeAndSlab(g.T @ g, g.T @ centred, float(centred @ centred), N, 0.9)
    rng = np.random.default_rng(3)
    for _ in range(20):
        chain.sweep(rng)
    assert np.allclose(chain.score, g.T @ (centred - g @ chain.beta)) and 0 < np.count_nonzero(chain.beta) < MARKERS


def test_super_and_sblup(data):
    geno, _, x, y = data
    scanned = M.mlm(geno, y, x, G.vanraden(geno)).rows.persist()
    chosen = P.select_super(geno, scanned, y, x, counts=(2, 5, 10))
    assert {10, 40} <= set(chosen.markers) and len(chosen.reml) == len(chosen.counts)
    assert np.corrcoef(P.sblup(geno, y, x, chosen.markers).prediction, y)[0, 1] > 0.7
    with pytest.raises(ValueError):
        P.sblup(geno, y, x, [])


@pytest.mark.parametrize("penalty", [2.5, None])
def test_ridge_is_penalised_least_squares(data, penalty):
    geno, g, _, y = data
    fit = P.rrblup(geno, y, penalty)
    z = g - g.mean(axis=0)
    effects = np.linalg.solve(z.T @ z + fit.penalty * np.eye(MARKERS), z.T @ (y - y.mean()))
    found = np.array([r["effect"] for r in fit.effects.orderBy("marker_idx").collect()])
    assert np.allclose(found, effects, atol=1e-9) and np.allclose(fit.gebv, z @ effects, atol=1e-9)


def test_cross_validation_uses_training_samples_only(data):
    geno, g, _, y = data
    cv = P.cross_validate_rrblup(geno, y, 5, penalty=3.0)
    train = cv.folds != 2
    z = g - g[train].mean(axis=0)
    dual = np.linalg.solve(z[train] @ z[train].T + 3 * np.eye(train.sum()), y[train] - y[train].mean())
    assert np.allclose(cv.predictions[~train], z[~train] @ z[train].T @ dual + y[train].mean(), atol=1e-9)
    assert cv.pearson_r > 0.3 and len(cv.by_fold()) == 5
    k = G.vanraden(geno)
    assert np.isfinite(P.cross_validate_gblup(y, k).predictions).all()
    with pytest.raises(ValueError, match="semidefinite"):
        P.cross_validate_gblup(y, -k)


def test_folds():
    assert np.bincount(P.folds(17, 5)).tolist() == [4, 4, 3, 3, 3]
    assert P.folds(6, 3).tolist() == [0, 0, 1, 1, 2, 2]
    assert np.bincount(P.folds(10, 2, groups=list("aaaabbbccd"))).tolist() == [5, 5]
    assert P.folds(4, ids=[7, 7, 9, 9]).tolist() == [0, 0, 1, 1]
    for bad in (dict(k=1), dict(k=True), dict(ids=[1, 1, 1, 1]), dict(k=2, groups=["a"] * 4)):
        with pytest.raises(ValueError):
            P.folds(4, **bad)


def test_bayes_b_is_seeded(spark):
    rng = np.random.default_rng(0)
    g = rng.binomial(2, 0.4, (50, 8)).astype(float)
    y = 3 * g[:, 2] + rng.normal(size=50) * 0.3
    a, _ = P.bayes_b(y, g, 120, 40, rng=np.random.default_rng(5))
    b, _ = P.bayes_b(y, g, 120, 40, rng=np.random.default_rng(5))
    assert np.array_equal(a, b) and np.argmax(np.abs(a)) == 2
    chains = P.bayes_b_chains(spark, y, g, [5], iterations=120, burn_in=40).orderBy("marker_idx").collect()
    assert np.allclose([r["effect"] for r in chains], a)


def test_run(data, tmp_path):
    geno, _, _, y = data
    traits = {"t": dict(zip(geno.taxa, y.tolist())), "few": {t: (1.0 if i < 5 else None) for i, t in enumerate(geno.taxa)}}
    with pytest.warns(UserWarning, match="skipped"):
        found = run(traits, geno, ["GLM", "MLM", "SBLUP", "GBLUP"], pca_total=2, output=str(tmp_path), super_counts=(5, 10))
    assert set(found) == {"t_GLM", "t_MLM", "t_SBLUP", "t_GBLUP"}
    table = found["t_GLM"].gwas
    assert table.columns[:9] == ["SNP", "Chr", "Pos", "P.value", "maf", "nobs", "effect", "se", "FDR.Adjusted.P.values"]
    order = [(r["Chr"], r["Pos"]) for r in table.collect()]
    assert order == sorted(order) and len(order) == 59 or len(order) == 60
    assert found["t_GLM"].significant.count() >= 1 and found["t_GBLUP"].prediction is not None
    assert found["t_SBLUP"].fit.selected and all(found["t_GLM"].files.paths())


@pytest.mark.parametrize(
    "given, error",
    [
        (dict(model=[]), ValueError), (dict(model=["GLM", "glm"]), ValueError), (dict(model="LASSO"), ValueError), (dict(model=[3]), TypeError),
        (dict(maf_threshold=0.6), ValueError), (dict(h2=0.5), ValueError), (dict(fdr_cut=1), TypeError), (dict(kinship="none"), ValueError),
        (dict(super_counts=(1.5,)), TypeError), (dict(prediction_model="ols"), ValueError), (dict(cutoff=0.0), ValueError), (dict(group_from=5, group_to=4), ValueError),
    ],
)
def test_options_are_checked(given, error):
    with pytest.raises(error):
        Options.of(**given)


def test_simulated_trait_is_reproducible(data):
    geno = data[0]
    assert np.array_equal(P.simulate_phenotype(geno), P.simulate_phenotype(geno))
    assert set(run({"t": {t: 0.0 for t in geno.taxa}}, geno, "GLM", pca_total=0, h2=0.7, qtn=5)) == {"SimTrait_GLM"}
