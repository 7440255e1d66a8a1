"""Hard negatives, lexical search and id planes against plain versions."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import hard_negatives as hn
from strandline.llm import lexical_search as ls
from strandline.llm import token_planes as tp
from strandline.session import scratch_path

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


# --- hard negatives -----------------------------------------------------------------------


def plain_negatives(rows, every=100, k=5, low=80, high=100):
    """(vec_id, label, whole-number vector) rows -> the mined tuples."""
    rows = list(dict.fromkeys((i, g, tuple(v)) for i, g, v in rows))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda r: (-r[0], r[1] is not None, r[1] or 0)
    out = []
    for a, g, v in rows:
        if a is None or a % every:
            continue
        scored = [(dot(v, w), i, h == g) for i, h, w in rows if i != a]
        for p, pid, _ in sorted((s for s in scored if s[2]), key=order)[:k]:
            fit = sorted((s for s in scored if not s[2] and low * p <= 100 * s[0] <= high * p), key=order)[:k]
            out += [(a, pid, n, i, p, s) for n, (s, i, _) in enumerate(fit, 1)]
    return sorted(out, key=repr)


def mined(spark, rows, every=100, **more):
    df = spark.createDataFrame([(i, g, list(map(int, v))) for i, g, v in rows], "vec_id long, label int, vec array<bigint>")
    got = hn.mined(df, F.pmod(F.col("vec_id"), F.lit(every)) == 0, **more)
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("block", [40, 4096])
def test_hard_negatives_of_clustered_rows(spark, block):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 60, (12, 6))
    rows = [(i, int(rng.integers(0, 4)), np.floor(centres[i % 12] + rng.normal(0, 3, 6))) for i in range(600)]
    assert mined(spark, rows, 20, block=block) == plain_negatives(rows, 20)


def test_hard_negatives_of_ties_copies_and_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 2), [rng.randint(-2, 2) for _ in range(4)]) for i in range(300)]
    rows += [(1000 + i, i % 3, [1, 1, 1, 1]) for i in range(200)]
    rows += [(None, 1, [2, 2, 2, 2]), (None, 2, [2, 2, 2, 2]), (7, 1, [5]), (8, 2, []), *rows[:40], (100, 2, [1, 2, 2, 1])]
    assert mined(spark, rows, 50, block=64) == plain_negatives(rows, 50)


def test_prepared_rows_leave_out_what_is_not_finite(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.001], 3), (2, [nan, 1.0], 3), (3, [inf, 1.0], 3), (4, None, 3), (5, [1.0], None), (6, [None, 1.0], 3), (1, [0.5, -0.001], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("query", F.lit("clash")).withColumn("cell", F.lit(1))
    assert [tuple(r) for r in hn.prepared(df).collect()] == [(1, 3, [128, -1])] * 2
    assert hn.mined(hn.prepared(df.limit(0)), F.col("vec_id") == 0).count() == 0
    alone = hn.prepared(df.where("vec_id = 1"))
    assert hn.mined(alone, F.col("vec_id") == 1).count() == 0


def test_tree_covers_its_rows_and_skips_nodes():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(0, 4, (800, 5)) + np.repeat(rng.normal(0, 200, (16, 5)), 50, axis=0)).astype(np.int64)
    most = float((x.astype(float) ** 2).sum(axis=1).max())
    tree = hn.Tree(np.arange(800), np.zeros(800, np.int64), x, most)
    points = hn.augmented(x, most)
    held = [r for rows, kids in zip(tree.rows, tree.children) if not kids for r in rows.tolist()]
    assert sorted(held) == list(range(800)) and len(tree.rows) > 16
    for centre, radius, rows in zip(tree.centres, tree.radius, tree.rows):
        assert (hn.distances(points[rows], centre) <= radius).all()
    q = {"query": [1], "anchor": [-1], "label": [0], "qvec": [x[3]], "same": [True], "low": [hn.NONE + 1], "high": [-(hn.NONE + 1)], "threshold": [hn.NONE + 1]}
    import pandas as pd

    search, seen = hn.Search(pd.DataFrame(q), 5), []
    verify = search._verify
    search._verify = lambda t, x_, a, at, rows: (seen.append(len(rows)), verify(t, x_, a, at, rows))
    search.run(tree)
    best = np.sort(x @ x[3])[::-1][:5]
    assert search.found[:, 1].tolist() == best.tolist() and sum(seen) < 400


# --- lexical search -----------------------------------------------------------------------


def plain_ranks(docs, items, k=10):
    words = {n: TERM.findall((t or "").translate(LOWER)) for n, (_, t) in enumerate(docs)}
    filled = [w for w in words.values() if w]
    n_docs, total = len(filled), sum(map(len, filled))
    df = Counter(t for w in filled for t in set(w))
    out = []
    for item, text in items:
        terms = set(TERM.findall((text or "").translate(LOWER)))
        scored = []
        for n, w in words.items():
            if not w:
                continue
            tf, m = Counter(w), 10 + (90 * len(w) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in terms if tf[t])
            if score > 0:
                scored.append((-score, docs[n][0] is not None, docs[n][0] or 0))
        out += [(item, r, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_words,head", [(200_000, 0.02), (60, 0.3)])
def test_ranks_against_brute_force(spark, block_words, head):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)] + ["Ünï", "日本", "X1"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    text = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    docs = [(i, text(rng.randint(1, 40))) for i in range(400)] + [(500 + i, "w1 w2 w3 w50") for i in range(150)]
    docs += [(None, "w50 W51"), (None, "w50 w51"), (900, None), (901, ""), (902, " .,-"), (903, "w0 " * 20000 + "w52"), (3, "w55"), (3, "w55")]
    items = [(k, text(rng.randint(1, 12))) for k in range(30)] + [(30, None), (31, "..."), (32, "unknown words"), (33, "W50 w51 x1"), (34, "w1 w2 w3 w50")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, norm int").repartition(5)
    got = ls.ranked(frame, spark.createDataFrame(items, "item_id long, text string"), block_words=block_words, head=head)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_ranks(docs, items)


def test_ranks_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert ls.ranked(docs.limit(0), items).count() == ls.ranked(docs, items.limit(0)).count() == 0
    assert ls.ranked(docs, items).dtypes == [("item_id", "int"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert ls.ranked(docs.withColumn("text", F.lit(None).cast("string")), items).count() == 0


def test_buckets_out_of_reach_are_skipped():
    query = ls.Query(np.array([1, 2]), np.array([100, 10]), 10_000, 3)
    query.search(ls.Bucket(np.array([1]), np.array([1]), np.array([99]), np.array([99.0])), np.array([[1, 1]]))
    assert query.scores.size == 0  # 100.5 * 99 lies below the threshold
    query.search(ls.Bucket(np.array([1, 2]), np.array([1, 1]), np.array([200, 900]), np.array([200.0, 900.0])), np.array([[1, 1], [1, 2]]))
    assert query.scores.tolist() == [20_000] and query.ids[:, 1].tolist() == [1]


# --- id planes ---------------------------------------------------------------------------


ODD = [
    (None, None), (None, "same"), (5, "a  b"), (-3, ""), (10**12, "x\n\ny <|endoftext|> \t z\n\n"), (7, "don't I'll '' 're\r\n 12a .. , é日本 \n"), (8, "\n\n\n a\n\n\nb c.\nd"),
    (9, "naïve ½ ² ª   \x1c tab\tend "), (9, "naïve ½ ² ª   \x1c tab\tend "), (9, "other"), (11, "emoji 🙂🙂 and ​ signs — “quoted” … "), (12, "word " * 40_000), (13, "Ωμέγα Привет 한국어 ひらがな"),
]


def expected(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE_BPE)
    return {(i, x): [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in rows}


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_planes_round_trip(spark, planes):
    rng = random.Random(6)
    rows = ODD + [(100 + k, " ".join(rng.choice(["ab", "Cde,", "fgh.\n", "12", "日本"]) + rng.choice("xyz") for _ in range(rng.randint(0, 60)))) for k in range(200)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ids string, start int").repartition(7)
    path = scratch_path(spark, "test-planes")
    tp.write_planes(tp.token_ids(docs, BYTE_BPE, files=3), path, planes, block=1000)
    got = sorted(tp.read_planes(spark, path).collect(), key=lambda r: r["start"])
    want = expected(rows)
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    at, whole, left = 0, [], Counter((i, tuple(want[i, t])) for i, t in rows)
    for r in got:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert r["start"] == at and r["n_tokens"] == len(ids)
        left[r["doc_id"], tuple(ids)] -= 1
        at += len(ids)
        whole += ids
    assert not +left and tp.manifest(path)["n_ids"] == at
    assert tp.ids_between(path, 0, at).tolist() == whole and tp.ids_between(path, 990, 2015).tolist() == whole[990:2015]
    assert tp.ids_between(path, at - 3, at + 9).tolist() == whole[-3:] and tp.ids_between(path, 5, 5).size == 0


def test_planes_query_and_empty_table(spark):
    docs = spark.createDataFrame([(2, "b c"), (1, "a")], "doc_id long, text string")
    got = [tuple(r) for r in tp.round_trip(docs, BYTE_BPE, scratch_path(spark, "test-planes")).orderBy("start").collect()]
    want = expected([(1, "a"), (2, "b c")])
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    a, b = want[1, "a"], want[2, "b c"]
    assert got == [(1, 0, len(a), crc(a)), (2, len(a), len(b), crc(b))]
    path = scratch_path(spark, "test-planes")
    assert tp.round_trip(docs.limit(0), BYTE_BPE, path).count() == 0 and tp.manifest(path)["files"] == []


def test_store_of_pretokens_stays_bounded(monkeypatch):
    monkeypatch.setattr(tp, "KEPT", 50)
    store, rng = tp.WordStore(BYTE_BPE), random.Random(1)
    for _ in range(20):
        texts = [" ".join(str(rng.random()) for _ in range(5)) for _ in range(4)]
        assert store.encode(texts) == store.whole(texts)
        assert len(store) <= 50 + 5 * 4


def test_planes_of_single_blocks():
    for ids in ([], [0], [0, 0, 0], [2**32 - 1, 5], list(range(300))):
        for bits in (True, False):
            a = np.array(ids, np.uint32)
            planes = tp.to_planes(a, bits)
            assert tp.from_planes(planes, a.size, bits).tolist() == ids and (any(ids) or not planes)


def test_damaged_blocks_are_found(tmp_path):
    place = tmp_path / "x.idp"
    with open(place, "wb") as sink:
        out = tp.FileWriter(sink, False, 4)
        out.add(1, np.arange(10, dtype="<u4").tobytes())
        out.close()
    raw = bytearray(place.read_bytes())
    with open(place, "rb") as source:
        assert tp.FileReader(source, len(raw)).between(3, 9).tolist() == [3, 4, 5, 6, 7, 8]
    raw[len(tp.MAGIC) + 10] ^= 255
    place.write_bytes(raw)
    with open(place, "rb") as source, pytest.raises(Exception):
        tp.FileReader(source, len(raw)).between(0, 10)
