import random

import pytest
from conftest import plan_of, rows
from pyspark.sql import functions as F

from strandline.operators import matching


def names(spark, values, column):
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def brute_greedy(pairs):
    taken, out = set(), []
    for a in sorted({a for a, _ in pairs}):
        for z in sorted(z for x, z in pairs if x == a):
            if z not in taken:
                taken.add(z)
                out.append((a, z))
                break
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_equals_the_sequential_loop(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({(f"a{rng.randrange(12):02d}", f"z{rng.randrange(12):02d}") for _ in range(30)})
    got = matching.greedy_one_to_one(spark.createDataFrame(pairs, "l string, r string"), "l", "r")
    assert rows(got) == brute_greedy(pairs)


def test_containment_against_brute_force(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("ab c") for _ in range(n))
    short, long = {word(rng.randrange(0, 7)) for _ in range(60)}, {word(rng.randrange(1, 14)) for _ in range(80)}
    got = matching.containment_pairs(names(spark, short, "p"), names(spark, long, "t"), "p", "t")
    assert rows(got) == sorted([(p, t) for p in short if p for t in long if p in t], key=repr)
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)


def test_underscore_is_a_wildcard(spark):
    slugs = names(spark, ["silver_harbor_en", "silverXharbor_fr", "silver__harbor", "other"], "slug")
    titles = names(spark, ["Silver Harbor", "Nothing"], "title")
    got = matching.pattern_join(slugs, titles, "title", "slug")
    assert rows(got.select("title", "slug")) == [("Nothing", None), ("Silver Harbor", "silverXharbor_fr"), ("Silver Harbor", "silver_harbor_en")]


def test_fuzzy_match(spark):
    left = names(spark, ["Marina", "Pilot", "Willow", "Red Kettle"], "a")
    right = names(spark, ["The Secret World of Marina", " pilot ", "My Neighbor Willow", "Heron"], "z")
    got = matching.fuzzy_substring_match(left, right, "a", "z")
    assert rows(got) == [
        ("marina", "the secret world of marina", "fuzzy_substring"), ("pilot", "pilot", "exact"), ("willow", "my neighbor willow", "fuzzy_substring"),
    ]
    counts = matching.cross_reference(got, left, right, "a", "z").first()
    assert tuple(counts) == (1, 2, 1, 1)


def test_alias_match(spark):
    left, right = names(spark, ["a", "b", "x"], "l"), names(spark, ["a", "bb", "y"], "r")
    aliases = spark.createDataFrame([("b", "bb"), ("a", "y")], "left_name string, right_name string")
    got = matching.alias_match(left, right, "l", "r", aliases)
    assert rows(got) == sorted([("a", "a", "exact"), ("b", "bb", "alias"), ("x", None, "only_left"), (None, "y", "only_right")], key=repr)


def test_null_keys_never_match(spark):
    left = spark.createDataFrame([("1", None), ("2", "a")], "id string, k string")
    right = spark.createDataFrame([(None,), ("a",)], "k string")
    assert [r["id"] for r in matching.unmatched(left, right, F.col("k"), F.col("k")).collect()] == ["1"]
    assert matching.orphans(left, "k", right.filter("k = 'b'"), "k").collect()[0]["references"] == 1


def test_resolve_by_name_or_slug(spark):
    df = spark.createDataFrame([("SILVER HARBOR", "x"), (None, "silver_harbor_en_v2"), ("", "nope_fr")], "n string, s string")
    dim = spark.createDataFrame([("id1", "Silver Harbor")], "id string, title string")
    got = matching.resolve_entity_id(df, dim, "n", "s", "id", "title").orderBy("s").collect()
    assert [r["resolved_id"] for r in got] == [None, "id1", "id1"]


def test_coalesce_join_prefers_the_id(spark):
    df = spark.createDataFrame([("i1", "b"), (None, "b"), ("zz", "c")], "id string, name string")
    lookup = spark.createDataFrame([("i1", "a", 10), ("i2", "b", 20)], "lid string, lname string, v int")
    got = matching.coalesce_join(df, lookup, "id", "lid", F.col("name"), F.col("lname"), ["v"]).collect()
    assert sorted((r["id"] or "", r["v"] or 0) for r in got) == [("", 20), ("i1", 10), ("zz", 0)]


def test_wildcards_alone_and_percent_signs(spark):
    df = spark.createDataFrame([("ab",), ("abcdef",), ("abcdeg",), ("",)], "slug string")
    short = spark.createDataFrame([("___",), ("a%e",), ("%",), ("c_e",), ("______",), ("_______",)], "p string")
    got = {tuple(r) for r in matching.containment_pairs(short, df, "p", "slug", wildcard=True).collect()}
    long = {"abcdef", "abcdeg"}
    want = {(p, t) for p in ("___", "a%e", "c_e", "______") for t in long} | {("%", t) for t in long | {"ab"}}
    assert got == want
