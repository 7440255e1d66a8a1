import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import vectors as fv
from strandline.operators import similarity


def cloud(spark, n=90, width=6, groups=2, seed=4):
    rng = np.random.default_rng(seed)
    data = [(i, f"g{i % groups}", [float(x) for x in rng.normal(size=width)]) for i in range(n)]
    data[5] = (5, "g1", [0.0] * width)
    return data, spark.createDataFrame(data, "id long, g string, v array<double>")


def cos(a, b):
    length = np.linalg.norm(a) * np.linalg.norm(b)
    return float(np.dot(a, b) / length) if length else 0.0


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_topk_against_brute_force(spark, block_rows):
    data, df = cloud(spark)
    got = {}
    for r in similarity.cosine_topk(df, "id", "g", "v", 4, block_rows).orderBy("rank").collect():
        got.setdefault(r["id_a"], []).append(r["id_b"])
    for i, g, v in data:
        want = sorted((j for j, h, _ in data if h == g and j != i), key=lambda j: (-round(cos(v, data[j][2]), 12), j))[:4]
        assert got[i] == want


def test_knn_paths_agree(spark):
    data, df = cloud(spark)
    ask = df.filter("id < 3").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    args, more = ("id", "v", "q", "qv"), {"k": 5, "min_score": 0.1, "where": F.col("g") == "g0"}
    few = similarity.knn_search(df, ask, *args, **more)
    many = similarity.knn_search(df, ask, *args, **more, block_rows=2)
    pick = lambda x: [(r["query"], r["rank"], r["match"], round(r["score"], 9)) for r in x.orderBy("query", "rank").collect()]
    assert pick(few) == pick(many)
    for q in range(3):
        want = sorted(((-cos(data[q][2], v), i) for i, g, v in data if g == "g0" and cos(data[q][2], v) >= 0.1))[:5]
        assert [m for x, _, m, _ in pick(few) if x == q] == [i for _, i in want]


def test_approximate_search_reports_its_recall(spark):
    data, df = cloud(spark)
    ask = df.filter("id % 5 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    exact = similarity.knn_search(df, ask, "id", "v", "q", "qv", k=3, min_score=None)
    wide = similarity.knn_approximate(df, ask, "id", "v", "q", "qv", width=len(data[0][2]), k=3, tables=24, planes=3)
    row = similarity.recall(exact, wide).first()
    assert row["wanted"] == 3 * ask.count() and row["recall"] >= 0.9


def test_search_of_nothing(spark):
    _, df = cloud(spark)
    ask = df.select(F.col("id").alias("q"), F.col("v").alias("qv"))
    assert similarity.knn_search(df, ask.limit(0), "id", "v", "q", "qv").count() == 0
    assert similarity.knn_search(df.limit(0), ask, "id", "v", "q", "qv").count() == 0


def test_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0], [])], "a array<double>, b array<double>, z array<double>, e array<double>")
    c = {k: F.col(k) for k in "abze"}
    got = df.select(
        fv.cosine(c["a"], c["b"]).alias("ab"), fv.cosine(c["b"], c["a"]).alias("ba"), fv.cosine(c["a"], c["z"]).alias("az"), fv.euclidean(c["a"], c["b"]).alias("d"),
        fv.euclidean(c["e"], c["e"]).alias("de"), fv.distance_to_similarity(F.lit(2.0), F.lit(4.0)).alias("s"), fv.distance_to_similarity(F.lit(0.0), F.lit(0.0)).alias("s0"),
        fv.to_unit_sum(c["a"]).alias("u"), fv.to_unit_sum(c["z"]).alias("uz"),
    ).first()
    assert got["ab"] == got["ba"] == pytest.approx(0.96) and got["az"] == 0.0
    assert got["d"] == pytest.approx(2**0.5) and got["de"] == 1.0 and got["s"] == 0.5 and got["s0"] == 1.0
    assert got["u"] == pytest.approx([3 / 7, 4 / 7]) and got["uz"] == [0.0, 0.0]


def test_validate(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([([1.0, 2.0],), ([nan, 1.0],), ([inf, 1.0],), ([1.0],), (None,)], "v array<double>")
    assert tuple(similarity.validate_vectors(df, "v", 2).first()) == (5, 1, 1, 1, 1, False)


def test_embed_retries(spark, tmp_path):
    flag = str(tmp_path / "failed")

    def flaky(texts):
        import os

        assert len(texts) <= 2
        if not os.path.exists(flag):
            open(flag, "w").close()
            raise RuntimeError("busy")
        return [[len(t)] for t in texts]

    df = spark.createDataFrame([(i, "x" * i) for i in range(5)], "id long, t string").coalesce(1)
    got = similarity.embed(df, "id", "t", flaky, batch=2, backoff=0.01)
    assert sorted((r["id"], r["embedding"]) for r in got.collect()) == [(i, [float(i)]) for i in range(5)]


@pytest.mark.parametrize("metric, k", [("cosine", 3), ("euclidean", None)])
def test_a_tile_needs_no_matrix_of_both_sides(monkeypatch, metric, k):
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(8)
    side = lambda first, n: pd.DataFrame({"g": 0, "id": np.arange(first, first + n), "vec": list(rng.normal(size=(n, 4)))})
    left, right = side(0, 900), side(600, 700)
    compare = similarity._tile("bigint", "int", metric, k, True, None if k else 4.5)[0]
    whole = compare(left, right)
    monkeypatch.setattr(similarity, "TILE_CELLS", 7000, raising=True)
    tracemalloc.start()
    parts = compare(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert whole[["id_a", "id_b"]].equals(parts[["id_a", "id_b"]]) and np.allclose(whole["score"], parts["score"])
    assert peak < 900 * 700 * 8
