"""Inverted vector index and pruned top-k against plain search."""

import numpy as np
import pytest
from conftest import rows

from strandline.operators import similarity, vector_index as vi


def clustered(spark, n=900, width=8, groups=3, spread=0.05, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    data = [(i, int(rng.integers(groups)), [float(x) for x in centres[i % 12] + spread * rng.normal(size=width)]) for i in range(n)]
    return spark.createDataFrame(data, "id int, grp int, vec array<float>")


def asked(df, every=50):
    return df.where(f"id % {every} = 0").selectExpr("id AS query_id", "vec AS query_vector")


def rounded(df):
    return sorted((r["query"], r["rank"], r["match"], round(r["score"], 9)) for r in df.collect())


def test_probed_cells_find_the_neighbours(spark):
    df = clustered(spark)
    index = vi.build_index(df, "id", "vec", cells=16, block_rows=50)
    assert sum(n for n, _, _ in index.cells.values()) == 900 and index.probes < len(index.cells)
    exact = similarity.knn_search(df, asked(df), "id", "vec", "query_id", "query_vector", k=5, min_score=None)
    found = vi.knn_indexed(index, asked(df), "query_id", "query_vector", k=5)
    assert vi.index_recall(index, found, exact).first()["recall"] >= 0.9
    for probes in (1, None):
        whole = vi.knn_indexed(index, asked(df), "query_id", "query_vector", k=5, exact=True, probes=probes)
        assert rounded(whole) == rounded(exact)


def test_recall_at_the_defaults_on_vectors_without_clusters(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=32)]) for i in range(2000)], "id int, vec array<float>")
    index = vi.build_index(df, "id", "vec")
    exact = similarity.knn_search(df, asked(df), "id", "vec", "query_id", "query_vector", k=5, min_score=None)
    got = vi.index_recall(index, vi.knn_indexed(index, asked(df), "query_id", "query_vector"), exact).first()
    assert got["recall"] >= 0.9 and got["indexed"] == 2000


def test_only_folders_of_probed_cells_are_read(spark):
    df = clustered(spark)
    index = vi.build_index(df, "id", "vec", cells=16)
    every, some = index.rows(spark).inputFiles(), index.rows(spark, sorted(index.cells)[:2]).inputFiles()
    assert 0 < len(some) < len(every) and all("cell=" in f for f in some)


def test_zero_null_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [-1.0, 0.0]), (5, [0.0, 0.0])], "id int, vec array<double>")
    index = vi.build_index(df, "id", "vec")
    ask = df.selectExpr("id AS query_id", "vec AS query_vector")
    got = vi.knn_indexed(index, ask, "query_id", "query_vector", k=2, exact=True)
    assert rounded(got) == [(1, 1, 1, 0.0), (1, 2, 2, 0.0), (2, 1, 2, 1.0), (2, 2, 1, 0.0), (4, 1, 4, 1.0), (4, 2, 1, 0.0), (5, 1, 1, 0.0), (5, 2, 2, 0.0)]
    none = vi.build_index(df.limit(0), "id", "vec")
    assert vi.knn_indexed(none, ask, "query_id", "query_vector").count() == 0
    assert vi.knn_indexed(index, ask.limit(0), "query_id", "query_vector", exact=True).count() == 0


def test_least_score_and_more_wanted_than_there_is(spark):
    df = clustered(spark, n=60)
    index = vi.build_index(df, "id", "vec", cells=4)
    exact = similarity.knn_search(df, asked(df, 20), "id", "vec", "query_id", "query_vector", k=100, min_score=0.5)
    assert rounded(vi.knn_indexed(index, asked(df, 20), "query_id", "query_vector", k=100, min_score=0.5, exact=True)) == rounded(exact)


@pytest.mark.parametrize("spread,skips", [(0.05, True), (5.0, False)])
def test_pruned_topk_is_exact_and_skips_tiles_of_clustered_rows(spark, spread, skips):
    df = clustered(spark, spread=spread)
    found, tiles = vi.cosine_topk_pruned(df, "id", "grp", "vec", 4, cells=12, block_rows=40)
    plain = similarity.cosine_topk(df, "id", "grp", "vec", 4)
    key = lambda df: sorted((r["grp"], r["id_a"], r["rank"], r["id_b"], round(r["score"], 9)) for r in df.collect())
    assert key(found) == key(plain)
    counts = rows(tiles)
    assert len(counts) == 3 and all(0 < compared <= total for _, total, compared in counts)
    assert (sum(c for _, _, c in counts) < 0.5 * sum(t for _, t, _ in counts)) == skips


def test_pruned_topk_of_small_and_odd_groups(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.0, 0.0]), (3, 1, [1.0, 1.0]), (4, None, [1.0, 1.0]), (5, 0, None), (6, 0, [-1.0, 0.1])], "id int, grp int, vec array<double>")
    found, _ = vi.cosine_topk_pruned(df, "id", "grp", "vec", 3, cells=2)
    got = sorted((r["grp"], r["id_a"], r["id_b"], round(r["score"], 3)) for r in found.collect())
    assert got == [(0, 1, 2, 0.0), (0, 1, 6, -0.995), (0, 2, 1, 0.0), (0, 2, 6, 0.0), (0, 6, 1, -0.995), (0, 6, 2, 0.0)]
