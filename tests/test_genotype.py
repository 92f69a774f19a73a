"""Packed genotypes, readers, stores, quality control."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from locuspark.operators import qc
from locuspark.operators.viz import multi_model
from locuspark.sources.genotype import from_array, from_long, to_long
from locuspark.sources.readers import marker_map, phenotype_from_frame, read_hapmap, read_numeric, read_phenotype
from locuspark.sources.sinks import safe_name
from locuspark.sources.store import import_hapmap, open_store, write_store
from locuspark.streaming.ingest import append_packed, hapmap_stream


def packed(g):
    rows = g.packed.orderBy("marker_idx").collect()
    return np.array([[np.nan if v is None else v for v in r["dosages"]] for r in rows]).T


def code(spark, calls, major=False):
    frame = spark.createDataFrame([(calls,)], "c array<string>").select(qc.numericalise(F.col("c"), major).alias("d"))
    return [None if np.isnan(v) else v for v in frame.first()["d"]]


@pytest.mark.parametrize(
    "calls, major, expected",
    [
        (["AA", "AT", "TT", "NN"], False, [0, 1, 2, None]),
        (["AA", "AT", "TA", "TT"], False, [0, 1, 1, 2]),
        (["AA", "AA", "AT", "TT", "TT", "TT"], True, [2, 2, 1, 0, 0, 0]),
        (["A", "G", "R", "N"], False, [0, 2, 1, None]),
        (["AA", "NN"], False, [0, 0]),
        (["aa", "tt", "--"], False, [0, 2, None]),
        (["AA", "AT", "NN"], False, [0, 1, None]),
        (["A", "C", "G", "T"], False, [0, 0, 0, 0]),
        (["G", "T", "K"], False, [0, 2, 1]),
        ([], False, []),
    ],
)
def test_numericalise(spark, calls, major, expected):
    assert code(spark, calls, major) == expected


@pytest.mark.parametrize("method, expected", [("middle", [0, 1, 2]), ("major", [0, 2, 2]), ("minor", [0, 0, 2]), ("mean", [0, 1, 2])])
def test_impute(spark, method, expected):
    g = from_array(spark, np.array([[0.0, np.nan], [np.nan, np.nan], [2.0, np.nan]]))
    found = packed(qc.impute(g, method))
    assert found[:, 0].tolist() == expected
    assert found[0, 1] == {"middle": 1, "major": 2, "minor": 0, "mean": 1}[method]


def test_maf_counts_missing_samples_and_view_selects(spark):
    g = from_array(spark, np.array([[0, 2, 0], [1, 2, np.nan], [2, 2, 1], [0, 2, 0]], float))
    rows = {r["marker_idx"]: r["maf"] for r in qc.with_maf(g).collect()}
    assert rows == {0: 3 / 8, 1: 0.0, 2: 1 / 8}
    assert [r["marker_idx"] for r in qc.filter_maf(g, 0.125).packed.orderBy("marker_idx").collect()] == [0, 2]
    view = g.view(samples=[-1, 2, 2], markers=[0, 1])
    assert view.taxa == ("T4", "T3", "T3") and packed(view).tolist() == [[0, 2], [2, 2], [2, 2]]
    with pytest.raises(TypeError):
        g.view(samples=[True])
    with pytest.raises(IndexError):
        g.view(samples=[4])
    with pytest.raises(ValueError, match="imputed"):
        qc.require_finite(g)
    assert g.markers([2, 0])[:, 1].tolist() == [0, 1, 2, 0]


def test_long_round_trip(spark):
    values = np.array([[0, 1], [2, np.nan], [1, 1]])
    g = from_array(spark, values)
    long = to_long(g).orderBy(F.rand(1))
    again = from_long(long, g.packed.drop("dosages"), g.taxa)
    assert np.array_equal(packed(again), values, equal_nan=True)


def test_phenotype_rules(spark, tmp_path):
    path = tmp_path / "y.tsv"
    path.write_text('Taxa\tEarHT\tdpoll\nA\t1.5\tNA\nB\t2\tN/A\n"C"\tnan\t3\n')
    found = read_phenotype(spark, str(path))
    assert found.traits == ("EarHT", "dpoll")
    assert [tuple(r)[:3] for r in found.frame.orderBy("row").collect()] == [("A", 1.5, None), ("B", 2.0, None), ("C", None, 3.0)]
    bad = ["a string, t double", [("x", 1.0), ("x", 2.0)]], ["a string, t double", [(None, 1.0)]], ["a string, t double", [("x", float("inf"))]], ["a string, t string", [("x", "tall")]], ["a string, t double", []], ["a string", [("x",)]]
    for schema, rows in bad:
        with pytest.raises(ValueError):
            phenotype_from_frame(spark.createDataFrame(rows, schema))


def test_numeric_and_hapmap_files(spark, tmp_path):
    (tmp_path / "gd.tsv").write_text('taxa\tm1\tm2\n"T1"\t0\tNA\nT2\t2\t1\n')
    (tmp_path / "gm.tsv").write_text("SNP\tChromosome\tPosition\nm1\t1\t10\nm2\t2\t20.5\n")
    g = read_numeric(spark, str(tmp_path / "gd.tsv"), str(tmp_path / "gm.tsv"))
    assert g.taxa == ("T1", "T2") and packed(g).tolist() == [[0, 1], [2, 1]]
    (tmp_path / "gm.tsv").write_text("SNP\tChromosome\tPosition\nm2\t1\t10\nm1\t2\t20.5\n")
    with pytest.raises(ValueError, match="order"):
        read_numeric(spark, str(tmp_path / "gd.tsv"), str(tmp_path / "gm.tsv"))
    head = "rs\talleles\tchrom\tpos\tstrand\tassembly\tcenter\tprotLSID\tassayLSID\tpanelLSID\tQCcode\tS1\tS2\tS3\tS4\n"
    row = "m{}\tA/T\t{}\t{}" + "\t." * 7 + "\t{}\n"
    (tmp_path / "h.txt").write_text(head + row.format(1, 1, 5, "AA\tAT\tTT\tNN") + row.format(2, 1, 9, "CC\tCC\tGG\tGG"))
    h = read_hapmap(spark, str(tmp_path / "h.txt"))
    assert packed(h).tolist() == [[0, 0], [1, 0], [2, 2], [1, 2]]
    store = import_hapmap(spark, str(tmp_path / "store"), str(tmp_path / "h.txt"))
    assert store.shape == (4, 2) and store.read_markers(1, 2, samples=[3, 0]).tolist() == [[2], [0]]
    assert [tuple(r) for r in store.marker_map().orderBy("marker_idx").collect()] == [(0, "m1", "1", 5.0), (1, "m2", "1", 9.0)]
    with pytest.raises(Exception):
        write_store(h, str(tmp_path / "store"))
    with pytest.raises(ValueError, match="complete"):
        open_store(spark, str(tmp_path / "nothing"))
    (tmp_path / "drop").mkdir()
    (tmp_path / "drop" / "a.txt").write_text(row.format(3, 2, 1, "A\tR\tG\tN"))
    append_packed(hapmap_stream(spark, str(tmp_path / "drop"), h.taxa), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["dosages"] == [0, 1, 2, 1]


def test_marker_map_rules(spark):
    for rows in ([("a", "1", 1.0), ("a", "1", 2.0)], [(None, "1", 1.0)], [("a", "1", float("nan"))], [("a", None, 1.0)]):
        with pytest.raises(ValueError):
            marker_map(spark.createDataFrame(rows, "s string, c string, p double"))


def test_align_follows_the_phenotype(spark):
    g = from_array(spark, np.array([[0, 1], [1, 1], [2, 0], [0, 0]], float), taxa=["A", "B", "C", "F"])
    pheno = {"t": {"E": 1.0, "C": 2.0, "A": None, "B": 4.0}}
    found = qc.align(pheno, g, covariates={t: [i] for i, t in enumerate("ABC")}, kinship=(list("CBA"), np.arange(9.0).reshape(3, 3)))
    assert found.taxa == ("C", "A", "B") and found.dropped == 1
    assert packed(found.genotype)[:, 0].tolist() == [2, 0, 1]
    assert found.covariates.ravel().tolist() == [2, 0, 1] and found.kinship[0].tolist() == [0, 2, 1]
    with pytest.raises(ValueError, match="common"):
        qc.align({"t": {"Z": 1.0}}, g)
    k = qc.incidence_kinship(["b", "a"], ["x", "y"], [[0, 1], [1, 0]], ["y", "x"], [[2, 1], [1, 3]], ["a", "b"])
    assert k.tolist() == [[3, 1], [1, 2]]
    with pytest.raises(ValueError, match="zeros"):
        qc.incidence_kinship(["a"], ["x"], [[0]], ["x"], [[1]], ["a"])


def test_multi_model_rejects_conflicts(spark):
    a = spark.createDataFrame([("s", "1", 5, 0.1)], "SNP string, Chr string, Pos long, `P.value` double")
    b = spark.createDataFrame([("s", "1", 6, 0.1)], "SNP string, Chr string, Pos long, `P.value` double")
    with pytest.raises(ValueError, match="conflicting"):
        multi_model({"A": a, "B": b})
    with pytest.raises(ValueError, match="more than once"):
        multi_model({"A": a.union(a)})


def test_safe_names():
    assert safe_name('a/b:c*"d" .') == "a_b_c__d_" and safe_name("..") == "unnamed"
