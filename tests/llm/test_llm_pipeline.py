"""Near-duplicate groups, the pipeline's stages, and the queries over the smallest tables."""

import glob
import itertools
import os

import numpy as np
import pytest

from locuspark.llm import neardup
from locuspark.llm.queries import PIECE_MODEL, SQL, queries

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF) or not os.path.exists(PIECE_MODEL), reason="no tables")


def jaccard(a, b):
    split = lambda t: (t or "").lower().split()
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    x, y = grams(split(a)), grams(split(b))
    return len(x & y) / len(x | y) if x | y else 1.0


def brute_groups(rows, similarity=0.8):
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if label[i] != label[j] and jaccard(rows[i][1], rows[j][1]) >= similarity - 1e-9:
            old, new = label[j], label[i]
            label = [new if x == old else x for x in label]
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((doc, min(ids) if ids else None))
    return sorted(out, key=str)


def corpus():
    rng = np.random.default_rng(5)
    prose = lambda n: " ".join(f"w{v}" for v in rng.integers(0, 500, n))
    rows, at = [], itertools.count(1)
    for n in (6, 30, 80, 300, 900):
        for _ in range(4):
            text = prose(n)
            rows.append((next(at), text))
            for edits in (0, 1, 3, 6):  # near copies at falling similarity
                words = text.split()
                for k in rng.integers(0, n, edits * n // 200 + (edits > 0)):
                    words[k] = "edited"
                rows.append((next(at), " ".join(words)))
            rows.append((next(at), text + " " + prose(max(1, n // 9))))
            rows.append((next(at), text[: len(text) // 2]))
    rows += [(next(at), None), (next(at), ""), (None, rows[0][1]), (None, "unique text of no id"), (3, rows[2][1])]
    return rows


@pytest.mark.parametrize("block_rows", [16384, 20])
def test_groups_equal_brute_force(spark, block_rows):
    rows = corpus()
    frame = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, size int, key string").repartition(3)
    found = sorted((tuple(r) for r in neardup.near_duplicate_groups(frame, block_rows=block_rows).collect()), key=str)
    assert found == brute_groups(rows)
    assert neardup.near_duplicate_groups(frame.limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    rows = corpus() + [(None, "unique text of no id"), (9999, "unique text of no id"), (5, "another text under a known id")]
    schema = "doc_id long, text string, _row int, _sum string, key string"
    frame = spark.createDataFrame([(i, t, 1, "k", "x") for i, t in rows], schema).repartition(3)
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if label[i] != label[j] and jaccard(rows[i][1], rows[j][1]) >= 0.8 - 1e-9:
            label = [label[i] if x == label[j] else x for x in label]
    groups = [[rows[k][0] for k in range(len(rows)) if label[k] == g] for g in set(label)]
    kept = neardup.one_of_each_group(frame)
    assert kept.columns == frame.columns and {(r["_row"], r["_sum"], r["key"]) for r in kept.collect()} == {(1, "k", "x")}
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((min((i for i in g if i is not None), default=None) for g in groups), key=str)
    assert neardup.one_of_each_group(frame.limit(0)).count() == 0


def test_small_sets_lose_no_link(spark):
    rows = []
    for i in range(600):
        words = [f"d{i}x{k}" for k in range(9)]
        rows += [(2 * i, " ".join(words[:8])), (2 * i + 1, " ".join(words))]
    found = neardup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"), block_rows=500).collect()
    assert all(r["component_id"] == r["doc_id"] // 2 * 2 for r in found) and len(found) == 1200


def test_radius_of_the_worst_case():
    assert neardup._bit_differs(0, 1, 4) == pytest.approx(0.1875) and neardup._bit_differs(0, 0, 7) == pytest.approx(0)
    assert neardup.worst_radius(1.0, 256) == 0 and neardup.worst_radius(0.8, 256) > neardup.radius_for(0.8, 256)


def test_size_rings_and_radius():
    assert neardup.radius_for(1.0, 256) == 0 and 50 < neardup.radius_for(0.8, 256) < 64
    assert len(neardup.shingle_hashes("a b c")) == 1 and len(neardup.shingle_hashes("a b c d e f")) == 2 and len(neardup.shingle_hashes(None)) == 0


def test_stages_have_their_effect(spark, tmp_path):
    words = lambda seed, n=60: " ".join(f"v{x}" for x in np.random.default_rng(seed).integers(0, 300, n))
    docs = [(i, words(i), "en", "s", 9) for i in range(300)]
    docs += [(1000 + i, words(i) + " vileword", "en", "s", 9) for i in range(300, 400)]
    docs += [(2000, words(7) + " tail", "en", "s", 9), (2001, words(50, 20) + " " + words(9999, 30) + " x", "en", "s", 9), (2002, "password=abcdefghijklmno and " + words(77777), "en", "s", 9), (2003, None, None, None, None), (2004, "", "en", "s", 0)]
    labels = [(d[0], 1, int(d[0] >= 1000)) for d in docs if d[0] < 2000]
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, words(9999, 30))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    frame = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        frame = stage(spark, frame, d)
        if name != "pieces":
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        frame = frame.persist()
        seen[name] = {r["doc_id"]: r for r in frame.collect()}
    clean = set(range(300)) - {7}
    assert not [i for i in seen["toxicity"] if 1000 <= i < 2000] and len(set(range(300)) - set(seen["toxicity"])) <= 3
    assert 2000 not in seen["near duplicates"] and 7 in seen["near duplicates"]
    assert 2001 not in seen["decontamination"] and 2001 in seen["near duplicates"]
    assert seen["secrets"][2002]["text"].startswith("[ASSIGN] and") and seen["secrets"][2002]["n_chars"] == len(seen["secrets"][2002]["text"])
    assert set(seen["pieces"]) == set(seen["secrets"]) and len(clean - set(seen["pieces"])) <= 3
    assert all(r["n_tokens"] == len(r["ids"] or []) for r in seen["pieces"].values())


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, _toxicity double, _leaked long, _neardup_id long, _row string, _sum string, row int, key string, score double, size int"


@pytest.fixture(scope="module")
def small_tables(spark, tmp_path_factory):
    words = lambda seed, n=40: " ".join(f"v{x}" for x in np.random.default_rng(seed).integers(0, 300, n))
    rows = [(i, words(i)) for i in range(60)] + [(100 + i, words(i) + " vileword") for i in range(60, 100)]
    rows += [(None, words(3)), (None, words(999)), (None, words(999)), (None, words(555)), (7, words(8)), (200, None), (201, ""), (202, "x" * 20_000 + " " + words(202)), (203, words(203, 20_000))]
    rest = ("en", "s", 5, 0.25, 7, 8, "r", "u", 9, "k", 0.75, 3)
    d = str(tmp_path_factory.mktemp("small"))
    spark.createDataFrame([(*r, *rest) for r in rows], CLASHING).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(100 <= (i or 0) < 200)) for i, _ in rows if i is None or i < 200], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, words(555))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_keep_clashing_columns_and_judge_rows_without_an_id(spark, small_tables):
    docs = spark.read.parquet(f"{small_tables}/documents.parquet")
    stages = dict(pipeline.STAGES)
    for name in ("toxicity", "near duplicates", "decontamination", "secrets"):
        found = stages[name](spark, docs, small_tables)
        assert found.columns == docs.columns
        rows = found.collect()
        assert rows and {tuple(r)[5:] for r in rows} == {(0.25, 7, 8, "r", "u", 9, "k", 0.75, 3)}, name
        texts = [r["text"] for r in rows if r["doc_id"] is None]
        if name == "near duplicates":
            assert len(texts) == 2 and len(set(texts)) == 2  # the copy of a named document and one of two twins are gone
            assert {200, 202, 203} <= {r["doc_id"] for r in rows} and not {201} & {r["doc_id"] for r in rows}
        if name == "decontamination":
            assert len(texts) == 3 and len(rows) == docs.count() - 1  # the item goes, though its row has no id
        if name == "secrets":
            assert len(rows) == docs.count()


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages_of_empty_tables(spark, small_tables, tmp_path, name):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{small_tables}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    stage = dict(pipeline.STAGES)[name]
    assert stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{small_tables}/documents.parquet")
    if name in ("toxicity", "decontamination"):  # without labels or items everything stays
        assert stage(spark, docs, str(tmp_path)).count() == docs.count()


@needs_tables
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    expected = con.execute(SQL[name])
    columns = [c[0] for c in expected.description]
    found = queries()[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)
    text = lambda v: "null" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    assert sorted(tuple(text(r[c]) for c in columns) for r in found.collect()) == sorted(tuple(map(text, r)) for r in expected.fetchall())


@needs_tables
def test_pipeline_runs(spark):
    assert pipeline.run(spark, SF).count() > 0
