import random
from collections import defaultdict, deque

import pytest
from conftest import plan_of, rows
from pyspark.sql import functions as F

from strandline.operators import graph
from strandline.plans import graph_queries

E = "source_node_id string, target_node_id string, edge_type string"


def film_edges(spark):
    return spark.createDataFrame(
        [
            ("c1", "f1", "appears_in"), ("c2", "f1", "appears_in"), ("c2", "f2", "appears_in"), ("c3", "f2", "appears_in"),
            ("c3", "f2", "appears_in"), ("c1", "s1", "is_species"), ("c2", "s1", "is_species"), ("c3", "s2", "is_species"),
            ("l1", "f1", "filmed_at"), ("l1", "f2", "filmed_at"), ("d1", "f1", "directed"), ("d1", "f2", "directed"), ("x9", "f9", "directed"),
        ],
        E,
    )


def film_nodes(spark):
    kinds = {"f": "film", "c": "character", "s": "species", "l": "location", "d": "director"}
    ids = ["f1", "f2", "f3", "c1", "c2", "c3", "s1", "s2", "l1", "d1"]
    return spark.createDataFrame([(i, kinds[i[0]], i.upper(), "{bad" if i == "c1" else '{"a":"1"}') for i in ids], "node_id string, node_type string, name string, properties string")


def test_components_against_union_find(spark):
    rng = random.Random(11)
    pairs = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(230)] + [(f"p{i}", f"p{i+1}") for i in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, z in pairs:
        ra, rz = find(a), find(z)
        parent[max(ra, rz)] = min(ra, rz)
    nodes = spark.createDataFrame([("alone",), ("n1",)], "node_id string")
    got = dict(tuple(r) for r in graph.weak_components(nodes, spark.createDataFrame([(a, z, "e") for a, z in pairs], E)).collect())
    want = {x: find(x) for x in parent} | {"alone": "alone"}
    want.setdefault("n1", "n1")
    assert got == want


def test_components_carry_few_edges_through_the_rounds(spark, monkeypatch):
    rng = random.Random(5)
    pairs = sorted({(f"f{rng.randrange(300)}", f"c{rng.randrange(200)}") for _ in range(3000)})
    sizes, real = [], graph.written

    def noted(df, name):
        out = real(df, name)
        if out.columns == ["a", "b"]:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "written", noted)
    nodes = spark.createDataFrame([("alone",)], "node_id string")
    got = graph.weak_components(nodes, spark.createDataFrame([(a, z, "e") for a, z in pairs], E))
    assert {r["component"] for r in got.collect()} == {"alone", "c0"} and sum(sizes) < 2 * len(pairs)


def test_nodes_of_one_hash_are_hashed_again(spark, monkeypatch):
    calls, real = [], F.xxhash64

    def same_at_first(*cols):
        calls.append(cols)
        return F.lit(7).cast("bigint") if len(calls) == 1 else real(*cols)

    monkeypatch.setattr(graph.F, "xxhash64", same_at_first)
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "node_id string")
    edges = spark.createDataFrame([("b", "c", "e"), ("c", "b", "e"), ("a", "a", "e"), (None, "a", "e")], E)
    assert rows(graph.weak_components(nodes, edges)) == [("a", "a"), ("b", "b"), ("c", "b"), (None, None)]


def test_metrics_and_dangling_ends(spark):
    nodes, edges = film_nodes(spark), film_edges(spark)
    assert rows(graph.dangling_endpoints(nodes, edges)) == [("f9",), ("x9",)]
    full, _ = graph.graph_from_tables(nodes, edges)
    assert full.count() == 12
    assert full.filter("node_id = 'c1'").first()["properties"] == {}
    got = graph.graph_metrics(nodes, edges).first()
    assert (got["node_count"], got["edge_count"], got["connected_components"]) == (12, 13, 3)
    assert got["avg_degree"] == pytest.approx(26 / 12) and got["density"] == pytest.approx(13 / 132)
    with pytest.raises(ValueError):
        graph.graph_from_tables(nodes, edges.limit(0))
    check = {r["node_type"]: r for r in graph.connectivity_check(nodes, edges, [("film", "character"), ("character", "film")]).collect()}
    assert (check["film"]["total"], check["film"]["validated"], check["film"]["is_valid"]) == (3, 2, False)
    assert check["character"]["is_valid"] is True


def brute_centrality(edges):
    """Textbook definitions on one small directed graph, by enumeration of shortest paths."""
    adj, ids, deg = defaultdict(set), set(), defaultdict(int)
    for a, z in edges:
        adj[a].add(z)
        ids |= {a, z}
        deg[a] += 1
        deg[z] += 1
    n, dist, cnt = len(ids), {}, {}
    for s in ids:
        d, c, todo = {s: 0}, {s: 1.0}, deque([s])
        while todo:
            u = todo.popleft()
            for w in adj[u]:
                if w not in d:
                    d[w], c[w] = d[u] + 1, 0.0
                    todo.append(w)
                if d[w] == d[u] + 1:
                    c[w] += c[u]
        dist[s], cnt[s] = d, c
    out = {}
    for v in ids:
        into = [dist[s][v] for s in ids if s != v and v in dist[s]]
        close = (len(into) / sum(into)) * (len(into) / (n - 1)) if into else 0.0
        between = sum(
            cnt[s][v] * cnt[v][t] / cnt[s][t]
            for s in ids for t in ids
            if len({s, v, t}) == 3 and t in dist[s] and v in dist[s] and t in dist[v] and dist[s][v] + dist[v][t] == dist[s][t]
        )
        out[v] = (deg[v] / (n - 1), close, between / ((n - 1) * (n - 2)))
    return out


def test_centrality_against_brute_force(spark):
    rng = random.Random(5)
    data = {}
    for ego in ("a", "b"):
        data[ego] = [(f"{ego}{rng.randrange(9)}", f"{ego}{rng.randrange(9)}") for _ in range(16)]
        data[ego] = [(x, y) for x, y in data[ego] if x != y]
    ego = spark.createDataFrame([(e, x, y) for e, pairs in data.items() for x, y in pairs], "ego string, source_node_id string, target_node_id string")
    got = {(r["ego"], r["node_id"]): r for r in graph.ego_centrality(ego).collect()}
    for e, pairs in data.items():
        for v, (d, c, b) in brute_centrality(pairs).items():
            r = got[(e, v)]
            assert (r["degree_centrality"], r["closeness"], r["betweenness"]) == pytest.approx((d, c, b))


def test_ego_networks(spark):
    ego = graph.ego_edges(film_edges(spark), ["appears_in", "filmed_at", "directed"], "appears_in", "is_species")
    f1 = rows(ego.filter("ego = 'f1'").select("source_node_id", "target_node_id"))
    assert f1 == [("c1", "f1"), ("c1", "s1"), ("c2", "f1"), ("c2", "s1"), ("d1", "f1"), ("l1", "f1")]
    ranked = graph.ego_ranking(ego, film_nodes(spark), "character", "degree", 1)
    assert {(r["ego"], r["node_id"]) for r in ranked.collect()} == {("f1", "c1"), ("f2", "c3")}
    members = graph.ego_centrality(ego).filter("node_id like 'c%'").collect()
    assert all(r["closeness"] == 0.0 and r["betweenness"] == 0.0 for r in members)


def test_similarity(spark):
    attrs = graph.shared_attributes(film_edges(spark), "directed", "filmed_at", "appears_in", "is_species")
    got = graph.similarity_network(attrs, 1).collect()
    assert [(r["entity_a"], r["entity_b"], r["score"], r["shared_director"], r["shared_locations"], r["shared_species"]) for r in got] == [("f1", "f2", 7, True, ["l1"], ["s1"])]
    assert graph.similarity_network(attrs, 8).count() == 0


@pytest.mark.parametrize("minimum", [1, 2, 4, 6])
def test_prefix_filter_loses_no_pair(spark, minimum):
    rng = random.Random(minimum)
    data = {(f"e{i}", kind, f"{kind}{rng.randrange(1, m)}") for i in range(40) for kind, m, k in (("location", 9, 4), ("species", 6, 3)) for _ in range(k)}
    data |= {(f"e{i}", "director", f"d{rng.randrange(6)}") for i in range(40)} | {(f"e{i}", "location", "everywhere") for i in range(40)}
    attrs = spark.createDataFrame(sorted(data), "entity string, kind string, attribute string")
    by = defaultdict(set)
    for e, k, a in data:
        by[e].add((k, a))
    want = set()
    for x in by:
        for y in by:
            if x < y:
                common = by[x] & by[y]
                score = 5 * any(k == "director" for k, _ in common) + sum(k != "director" for k, _ in common)
                if score >= minimum:
                    want.add((x, y, score))
    assert {(r["entity_a"], r["entity_b"], r["score"]) for r in graph.similarity_network(attrs, minimum).collect()} == want


def test_co_members(spark):
    seeds = spark.createDataFrame([("c2",)], "node_id string")
    assert rows(graph.co_members(seeds, film_edges(spark), "appears_in")) == [("c2", "c1", 1), ("c2", "c3", 1)]


@pytest.mark.parametrize("block,pairs", [(3, 50), (20_000, 4_000_000), (7, 1)])
def test_best_co_members_by_blocks(spark, monkeypatch, block, pairs):
    """Every member meets one heavy target; ties, repeated links, a lone member and NULLs."""
    monkeypatch.setattr(graph, "TILE_PAIRS", pairs)
    rng = random.Random(block)
    links = [(f"m{k}", "all") for k in range(40)] + [(f"m{rng.randint(0, 39)}", f"t{rng.randint(0, 25)}") for _ in range(300)]
    links += links[:20] + [("lone", "own"), (None, "all"), ("m1", None)]
    edges = spark.createDataFrame([(*x, "in") for x in links] + [("m1", "m2", "other")], f"{graph.SRC} string, {graph.DST} string, edge_type string")
    held = {}
    for m, t in links:
        if m and t:
            held.setdefault(m, set()).add(t)
    want = []
    for m in held:
        best = sorted((-len(held[m] & held[o]), o) for o in held if o != m and held[m] & held[o])[:4]
        want += [(m, o, -n, k) for k, (n, o) in enumerate(best, 1)]
    assert rows(graph.co_members_topk(edges, "in", 4, block_members=block)) == sorted(want, key=repr)
    seeds = spark.createDataFrame([("m3",), ("lone",), ("nobody",)], "node_id string")
    assert rows(graph.co_members_topk(edges, "in", 4, seeds, block)) == sorted([w for w in want if w[0] == "m3"], key=repr)
    assert graph.co_members_topk(edges.limit(0), "in").count() == 0


def test_numbered_edges(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (1, "c")], "s int, t string")
    got = graph.edge_set(df, "links", "x", F.col("s"), "y", F.col("t"), "edge_").orderBy("edge_id").collect()
    assert [(r["edge_id"], r["source_node_id"], r["target_node_id"]) for r in got] == [("edge_1", "x_1", "y_a"), ("edge_2", "x_1", "y_c"), ("edge_3", "x_2", "y_b")]


def test_components_query_over_all_edges(spark, tmp_path):
    from __spark_entry__ import queries

    tables = {
        "orders": ("o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string, o_orderdate date, o_totalprice double", [(k, k, "1", "O", None, 1.0) for k in range(40)]),
        "customer": ("c_custkey long, c_name string", [(k, f"c{k}") for k in range(42)]),
        "part": ("p_partkey long, p_name string, p_type string, p_size int, p_brand string", [(k, "p", "t", 1, f"b{k if k < 44 else 44}") for k in range(48)]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey long", [(k, "s", 1) for k in range(45)]),
        # Two long paths of orders, one over common parts and one over common suppliers.
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long", [(k, k + j, k) if k < 20 else (k, k + 1, k + j) for k in range(40) for j in (0, 1)]),
    }
    for name, (schema, data) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    built = queries()["build_edges"](spark, str(tmp_path)).collect()
    root = {r["node_id"]: r["node_id"] for r in queries()["build_nodes"](spark, str(tmp_path)).collect()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in built:
        a, z = sorted((find(e["source_node_id"]), find(e["target_node_id"])))
        root[z] = a
    got = dict(tuple(r) for r in queries()["weak_components_all"](spark, str(tmp_path)).select("node_id", "component").collect())
    assert got == {n: find(n) for n in root}
    assert got["film_0"] == got["film_19"] != got["film_20"] == got["film_39"] and got["character_44"] == got["character_47"]


def test_customers_of_one_name_are_one_director(spark, tmp_path):
    def table(name, schema, rows_):
        spark.createDataFrame(rows_, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))

    table("customer", "c_custkey bigint, c_name string", [(1, "a"), (2, "a"), (3, "b")])
    table("orders", "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string", [
        (1, 1, "O", 10.2, None, "1"), (2, 2, "O", 20.2, None, "1"), (3, 2, "O", 30.2, None, "1")])
    table("part", "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int", [(1, "p", "x", "t", 1)])
    table("supplier", "s_suppkey bigint, s_name string, s_nationkey int", [(1, "s", 1)])
    got = graph_queries.nodes(spark, str(tmp_path)).where("node_type = 'director'").select("name", "properties")
    assert rows(got) == [("a", '{"film_count":3,"total":61}'), ("b", '{"film_count":0,"total":null}')]


def test_networks_are_dealt_once_and_never_checkpointed(spark, monkeypatch):
    ego = graph.ego_edges(film_edges(spark), ["appears_in", "filmed_at", "directed"], "appears_in", "is_species")
    for df in (graph.ego_nodes(ego), graph.ego_degrees(ego)):
        dealt = [x for x in plan_of(df).splitlines() if "Exchange hashpartitioning(ego" in x]
        assert dealt and not any("node_id" in x for x in dealt)
    monkeypatch.setattr(graph, "cut_lineage", lambda *a: pytest.fail("a checkpoint stores rows uncompressed"))
    assert graph.ego_centrality(ego).count() == graph.ego_nodes(ego).count()


def test_counting_components_joins_no_labels(spark, monkeypatch):
    monkeypatch.setattr(graph, "weak_components", lambda *a: pytest.fail("labels of all nodes"))
    assert graph.graph_metrics(film_nodes(spark), film_edges(spark)).first()["connected_components"] == 3


def test_few_pairs_are_joined_without_copies(spark, monkeypatch):
    edges = film_edges(spark)
    want = rows(graph.co_members_topk(edges, "appears_in", 2, block_members=10))
    monkeypatch.setattr(graph, "_best_partners", lambda *a: pytest.fail("a tile"))
    few = graph.co_members_topk(edges, "appears_in", 2, block_members=1)
    assert rows(few) == want and "FlatMapCoGroups" not in plan_of(few)


def test_connectivity_reads_its_edges_once(spark, monkeypatch):
    nodes, edges = film_nodes(spark), film_edges(spark)
    got = graph.connectivity_check(nodes, edges, [("film", "character"), ("character", "species"), ("director", "film")])
    assert sorted(map(tuple, got.collect())) == [("character", "species", 3, 3, 3, True), ("director", "film", 1, 1, 1, True), ("film", "character", 3, 2, 2, False)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("explode(") == 1


def test_similarity_reads_attributes_once(spark):
    held = [("a", "director", "d"), ("b", "director", "d"), ("a", "location", "l"), ("b", "location", "l"), ("b", "species", "s"), ("c", "species", None), (None, "species", "s")]
    attributes = spark.createDataFrame(held, "entity string, kind string, attribute string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "b"), ("a", "c"), ("c", "c"), ("a", None)], "entity_a string, entity_b string")
    got = graph.attribute_similarity(pairs, attributes)
    assert rows(got) == [("a", "b", 6, True, ["l"], []), ("b", "b", 7, True, ["l"], ["s"])]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("kind#") and plan.count("Join ") == 1


def test_totals_are_added_in_the_order_of_the_orders(spark, tmp_path):
    # In order 34.49999999999999; from behind or customer by customer 34.5, which rounds to 35.
    prices = {1: 9.37, 2: 9.04, 3: 8.58, 4: 7.51}
    tables = {
        "customer": ("c_custkey bigint, c_name string", [(1, "a"), (2, "a"), (3, "a")]),
        "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
                   [(k, 1 + (k + 1) % 2, "O", prices[k], None, "1") for k in (4, 2, 1, 3)]),
        "part": ("p_partkey bigint, p_name string, p_brand string, p_type string, p_size int", [(1, "p", "x", "t", 1)]),
        "supplier": ("s_suppkey bigint, s_name string, s_nationkey int", [(1, "s", 1)]),
    }
    for name, (schema, rows_) in tables.items():
        spark.createDataFrame(rows_, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = graph_queries.nodes(spark, str(tmp_path)).where("node_type = 'director'").select("name", "properties")
    assert rows(got) == [("a", '{"film_count":4,"total":34}')]


def test_only_networks_with_longer_paths_are_walked(spark, monkeypatch):
    data = {
        "flat": [("a", "flat"), ("a", "flat"), ("b", "flat"), ("a", "s"), ("b", "s"), ("loop", "loop")],
        "deep": [("a", "b"), ("b", "deep"), ("c", "b"), ("c", "b"), ("d", "d")],
        "pair": [("a", "b"), ("b", "a"), ("c", "c")],
    }
    edges = [(e, u, w) for e, pairs in data.items() for u, w in pairs]
    walked, path_levels = [], graph.path_levels
    monkeypatch.setattr(graph, "path_levels", lambda ego: walked.append({r["ego"] for r in ego.select("ego").distinct().collect()}) or path_levels(ego))
    got = {(r["ego"], r["node_id"]): r for r in graph.ego_centrality(spark.createDataFrame(edges, "ego string, source_node_id string, target_node_id string")).collect()}
    assert walked == [{"deep", "pair"}]
    for e, pairs in data.items():
        want = brute_centrality(pairs)
        assert {v for x, v in got if x == e} == want.keys()
        for v, (d, c, b) in want.items():
            r = got[(e, v)]
            assert (r["degree_centrality"], r["closeness"], r["betweenness"]) == pytest.approx((d, c, b))


def shuffled_rows(spark, df):
    """Rows that the stages of a frame's collection write for shuffles."""
    def stages():
        store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
        found = store.stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), jvm.jvm.java.util.ArrayList())
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (found.apply(i) for i in range(found.size()))}

    before = stages()
    got = rows(df)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return got, sum(n for k, n in stages().items() if k not in before)


def test_a_pair_is_dealt_with_one_row_a_side(spark):
    held = [(f"e{i}", "location" if k % 2 else "species", f"x{(i + k) % 60:02}") for i in range(20) for k in range(60)]
    held += [("e0", "director", "d"), ("e1", "director", "d"), ("e0", "owner", "o"), ("lone", "owner", "o")]
    attributes = spark.createDataFrame(held, "entity string, kind string, attribute string").coalesce(1)
    pairs = [(f"e{i}", f"e{j}") for i in range(20) for j in range(i + 1, 20)] + [("e0", "lone"), ("lone", "none")]
    got, dealt = shuffled_rows(spark, graph.attribute_similarity(spark.createDataFrame(pairs, "entity_a string, entity_b string"), attributes))
    by = {e: {(k, x) for o, k, x in held if o == e} for e, _, _ in held}
    want = []
    for x, y in pairs:
        common = by[x] & by.get(y, set())
        names = lambda kind: sorted(v for k, v in common if k == kind)
        if common:
            led = bool(names("director"))
            want.append((x, y, 5 * led + len(names("location")) + len(names("species")), led, names("location"), names("species")))
    assert got == sorted(want, key=repr)
    assert dealt < 6 * len(pairs)
