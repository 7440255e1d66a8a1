"""Graph queries over orders, parts, suppliers, customers and brands, with their SQL twins.

Roles: an order is the centre ("film"), its parts are the members ("character"), its
suppliers the places ("location"), its customer the single maker ("director") and a
part's brand the members' attribute ("species").
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.operators import graph
from strandline.plans import base as b

Q: dict = {}
SQL: dict[str, str] = {}
T = b.table
INTO = ["appears_in", "filmed_at", "directed"]


def nodes(s, f):
    part, orders = T(s, f, "part"), T(s, f, "orders")
    # One director a name, however many customers bear it. A sum of doubles has the last bit of its order of addition, which
    # decides where it ends in .50; the twin adds in the order of the orders.
    along = Window.partitionBy("c_name").orderBy("o_orderkey")
    placed = T(s, f, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").withColumns(
        {"t": F.sum("o_totalprice").over(along.rowsBetween(Window.unboundedPreceding, 0)), "i": F.row_number().over(along)}
    )
    customer = placed.groupBy("c_name").agg(F.count("o_orderkey").alias("n"), F.round(F.max_by("t", "i"), 0).cast("bigint").alias("t"))
    return graph.union_all(
        [
            graph.node_set(orders, "film", F.col("o_orderkey"), F.col("o_orderpriority"), status=F.col("o_orderstatus"), year=F.year("o_orderdate")),
            graph.node_set(part, "character", F.col("p_partkey"), F.col("p_name"), type=F.col("p_type"), size=F.col("p_size")),
            graph.node_set(T(s, f, "supplier"), "location", F.col("s_suppkey"), F.col("s_name"), nation=F.col("s_nationkey")),
            graph.node_set(part.select("p_brand").distinct(), "species", F.col("p_brand"), F.col("p_brand")),
            graph.node_set(customer, "director", F.md5("c_name"), F.col("c_name"), film_count=F.col("n"), total=F.col("t")),
        ]
    )


def _edge_frames(s, f, numbered=False):
    li = T(s, f, "lineitem")
    made = T(s, f, "orders").join(T(s, f, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    p = (lambda x: x) if numbered else (lambda x: None)
    return [
        graph.edge_set(li, "appears_in", "character", F.col("l_partkey"), "film", F.col("l_orderkey"), p("edge_char_film_")),
        graph.edge_set(li, "filmed_at", "location", F.col("l_suppkey"), "film", F.col("l_orderkey"), p("edge_loc_film_")),
        graph.edge_set(T(s, f, "part"), "is_species", "character", F.col("p_partkey"), "species", F.col("p_brand"), p("edge_char_species_")),
        graph.edge_set(made, "directed", "director", F.md5("c_name"), "film", F.col("o_orderkey"), p("edge_dir_film_")),
    ]


def edges(s, f, numbered=False):
    return graph.union_all(_edge_frames(s, f, numbered))


SQL_NODES = """nodes AS (
SELECT 'film_' || o_orderkey AS node_id, 'film' AS node_type, o_orderpriority AS name, CAST(json_object('status', o_orderstatus, 'year', year(o_orderdate)) AS VARCHAR) AS properties FROM orders
UNION ALL SELECT 'character_' || p_partkey, 'character', p_name, CAST(json_object('type', p_type, 'size', p_size) AS VARCHAR) FROM part
UNION ALL SELECT 'location_' || s_suppkey, 'location', s_name, CAST(json_object('nation', s_nationkey) AS VARCHAR) FROM supplier
UNION ALL SELECT DISTINCT 'species_' || p_brand, 'species', p_brand, '{}' FROM part
UNION ALL SELECT 'director_' || md5(c_name), 'director', c_name, CAST(json_object('film_count', count(o_orderkey), 'total', CAST(round(sum(o_totalprice), 0) AS BIGINT)) AS VARCHAR) FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_name)"""
SQL_EDGES = """edges AS (
SELECT 'character_' || l_partkey AS source_node_id, 'film_' || l_orderkey AS target_node_id, 'appears_in' AS edge_type FROM lineitem
UNION ALL SELECT 'location_' || l_suppkey, 'film_' || l_orderkey, 'filmed_at' FROM lineitem
UNION ALL SELECT 'character_' || p_partkey, 'species_' || p_brand, 'is_species' FROM part
UNION ALL SELECT 'director_' || md5(c_name), 'film_' || o_orderkey, 'directed' FROM orders JOIN customer ON o_custkey = c_custkey)"""
_SQL_ENDS = SQL_EDGES + ", ends AS (SELECT source_node_id AS node_id FROM edges UNION ALL SELECT target_node_id FROM edges)"

Q["build_nodes"] = nodes
SQL["build_nodes"] = f"WITH {SQL_NODES} SELECT * FROM nodes"
Q["build_edges"] = lambda s, f: edges(s, f, numbered=True)
SQL["build_edges"] = f"""WITH {SQL_EDGES}, n AS (SELECT *, row_number() OVER (PARTITION BY edge_type ORDER BY source_node_id, target_node_id) AS i FROM edges)
SELECT source_node_id, target_node_id, edge_type, '{{"relationship_strength":1.0}}' AS properties,
CASE edge_type WHEN 'appears_in' THEN 'edge_char_film_' WHEN 'filmed_at' THEN 'edge_loc_film_' WHEN 'is_species' THEN 'edge_char_species_' ELSE 'edge_dir_film_' END || i AS edge_id FROM n"""
Q["graph_from_tables"] = lambda s, f: (
    graph.graph_from_tables(nodes(s, f).filter(F.col("node_type") != "species"), edges(s, f))[0]
    .select("node_id", "node_type", F.col("properties")["size"].alias("size"))
)
SQL["graph_from_tables"] = f"""WITH {SQL_NODES}, {_SQL_ENDS}, k AS (SELECT * FROM nodes WHERE node_type <> 'species')
SELECT node_id, node_type, properties::JSON ->> 'size' AS size FROM k UNION ALL SELECT DISTINCT node_id, NULL, NULL FROM ends WHERE node_id NOT IN (SELECT node_id FROM k)"""
Q["weak_components"] = lambda s, f: graph.weak_components(
    nodes(s, f).filter(F.col("node_type").isin("director", "film", "location")), edges(s, f).filter("edge_type = 'directed'")
)
SQL["weak_components"] = f"""WITH {SQL_NODES}, {SQL_EDGES}, d AS (SELECT source_node_id AS c, target_node_id AS o FROM edges WHERE edge_type = 'directed'),
m AS (SELECT c, least(c, min(o)) AS component FROM d GROUP BY 1)
SELECT node_id, coalesce(m1.component, m2.component, node_id) AS component FROM nodes LEFT JOIN m m1 ON node_id = m1.c LEFT JOIN d ON node_id = d.o LEFT JOIN m m2 ON d.c = m2.c WHERE node_type IN ('director', 'film', 'location')"""
Q["weak_components_all"] = lambda s, f: graph.weak_components(nodes(s, f), edges(s, f))
# A keyed recursion keeps one label a node, so it ends after as many rounds as the longest path has edges.
SQL["weak_components_all"] = f"""WITH RECURSIVE {SQL_NODES}, {_SQL_ENDS}, every AS (SELECT node_id FROM nodes UNION SELECT node_id FROM ends),
e2 AS (SELECT DISTINCT source_node_id AS u, target_node_id AS w FROM edges UNION SELECT DISTINCT target_node_id, source_node_id FROM edges),
cc(node_id, component) USING KEY (node_id) AS (SELECT node_id, node_id FROM every
UNION SELECT e2.w, min(cc.component) FROM cc JOIN e2 ON e2.u = cc.node_id JOIN recurring.cc AS r ON r.node_id = e2.w WHERE cc.component < r.component GROUP BY e2.w)
SELECT node_id, component FROM cc"""
Q["graph_metrics"] = lambda s, f: b.rounded(graph.graph_metrics(nodes(s, f), edges(s, f)), ["avg_degree", "density"], 9)
SQL["graph_metrics"] = f"""WITH RECURSIVE {SQL_NODES}, {_SQL_ENDS}, every AS (SELECT node_id FROM nodes UNION SELECT node_id FROM ends),
e2 AS (SELECT DISTINCT source_node_id AS u, target_node_id AS w FROM edges UNION SELECT DISTINCT target_node_id, source_node_id FROM edges),
reach AS (SELECT min(source_node_id) AS x FROM edges UNION SELECT w FROM reach JOIN e2 ON u = x),
n AS (SELECT (SELECT count(*) FROM every) AS node_count, (SELECT count(*) FROM edges) AS edge_count, (SELECT count(*) FROM reach) AS r)
SELECT node_count, edge_count, node_count - r + 1 AS connected_components, round(edge_count * 2 / node_count, 9) AS avg_degree, round(edge_count / (node_count * (node_count - 1)), 9) AS density FROM n"""
Q["density"] = lambda s, f: b.rounded(graph.graph_metrics(nodes(s, f), edges(s, f), components=False).select("density"), ["density"], 9)
SQL["density"] = f"""WITH {SQL_NODES}, {_SQL_ENDS}, every AS (SELECT node_id FROM nodes UNION SELECT node_id FROM ends), n AS (SELECT (SELECT count(*) FROM every) AS v, (SELECT count(*) FROM edges) AS e)
SELECT round(e / (v * (v - 1)), 9) AS density FROM n"""
_SQL_CENTRAL = f"""WITH {SQL_NODES}, {_SQL_ENDS}, every AS (SELECT node_id FROM nodes UNION SELECT node_id FROM ends), dg AS (SELECT node_id, count(*) AS degree FROM ends GROUP BY 1),
c AS (SELECT node_id, coalesce(degree, 0) AS degree, coalesce(degree, 0) / ((SELECT count(*) FROM every) - 1) AS centrality FROM every LEFT JOIN dg USING (node_id))
SELECT node_id, degree, round(centrality, 9) AS centrality FROM c"""
Q["degree_centrality"] = lambda s, f: b.rounded(graph.degree_centrality(nodes(s, f), edges(s, f)), ["centrality"], 9)
SQL["degree_centrality"] = _SQL_CENTRAL
Q["global_centrality_rank"] = lambda s, f: b.rounded(graph.degree_centrality(nodes(s, f), edges(s, f), 10), ["centrality"], 9)
SQL["global_centrality_rank"] = _SQL_CENTRAL + " ORDER BY degree DESC, node_id LIMIT 10"
Q["edge_type_counts"] = lambda s, f: graph.edge_type_counts(edges(s, f))
SQL["edge_type_counts"] = f"WITH {SQL_EDGES} SELECT edge_type, count(*) AS edges FROM edges GROUP BY 1"
Q["connectivity_check"] = lambda s, f: graph.connectivity_check(nodes(s, f), edges(s, f), [("film", "character"), ("character", "film"), ("director", "film")])
SQL["connectivity_check"] = f"""WITH {SQL_NODES}, {_SQL_ENDS}, t AS (SELECT 'film' AS a, 'character' AS p UNION ALL SELECT 'character', 'film' UNION ALL SELECT 'director', 'film'),
lk AS (SELECT DISTINCT n.node_id, n.node_type, o.node_type AS p FROM nodes n JOIN (SELECT source_node_id AS x, target_node_id AS y FROM edges UNION SELECT target_node_id, source_node_id FROM edges) e ON n.node_id = e.x JOIN nodes o ON o.node_id = e.y)
SELECT *, total = validated AS is_valid FROM (SELECT a AS node_type, p AS partner_type, (SELECT count(*) FROM nodes WHERE node_type = a) AS total, (SELECT count(*) FROM lk WHERE lk.node_type = a AND lk.p = t.p) AS linked_to_partner,
(SELECT count(*) FROM nodes WHERE node_type = a AND node_id IN (SELECT node_id FROM ends)) AS validated FROM t)"""


def _ego(s, f):
    return graph.ego_edges(edges(s, f), INTO, "appears_in", "is_species")


_SQL_EGO = SQL_EDGES + """,
ego AS (SELECT target_node_id AS ego, source_node_id, target_node_id, edge_type FROM edges WHERE edge_type <> 'is_species'
UNION ALL SELECT m.ego, e.source_node_id, e.target_node_id, e.edge_type FROM (SELECT DISTINCT target_node_id AS ego, source_node_id AS m FROM edges WHERE edge_type = 'appears_in') m JOIN edges e ON m.m = e.source_node_id AND e.edge_type = 'is_species'),
dg AS (SELECT ego, node_id, count(*) AS degree FROM (SELECT ego, source_node_id AS node_id FROM ego UNION ALL SELECT ego, target_node_id FROM ego) GROUP BY ALL),
sz AS (SELECT ego, count(*) AS n FROM dg GROUP BY 1)"""
Q["ego_subgraph"] = _ego
SQL["ego_subgraph"] = f"WITH {_SQL_EGO} SELECT * FROM ego"
Q["ego_nodes"] = lambda s, f: graph.ego_nodes(_ego(s, f))
SQL["ego_nodes"] = f"WITH {_SQL_EGO} SELECT ego, node_id FROM dg"
Q["ego_degree_rank"] = lambda s, f: b.rounded(graph.ego_ranking(_ego(s, f), nodes(s, f), "character", "degree", 3), ["score"], 9)
SQL["ego_degree_rank"] = f"""WITH {_SQL_EGO}, c AS (SELECT dg.ego, node_id, degree / (n - 1) AS score FROM dg JOIN sz USING (ego) WHERE starts_with(node_id, 'character_')),
r AS (SELECT *, row_number() OVER (PARTITION BY ego ORDER BY score DESC, node_id) AS rank FROM c) SELECT ego, node_id, round(score, 9) AS score, rank FROM r WHERE rank <= 3"""
Q["ego_centrality"] = lambda s, f: b.rounded(graph.ego_centrality(_ego(s, f)), ["degree_centrality", "closeness", "betweenness"], 9)
SQL["ego_centrality"] = f"""WITH {_SQL_EGO}, inn AS (SELECT ego, target_node_id AS node_id, count(DISTINCT source_node_id) AS r FROM ego GROUP BY ALL)
SELECT dg.ego, node_id, round(degree / (n - 1), 9) AS degree_centrality, round(coalesce(r, 0) / (n - 1), 9) AS closeness, 0.0::DOUBLE AS betweenness
FROM dg JOIN sz USING (ego) LEFT JOIN inn ON dg.ego = inn.ego AND dg.node_id = inn.node_id""".replace("SELECT dg.ego, node_id,", "SELECT dg.ego, dg.node_id,")


def _places(s, f):
    """Regions as centres of customers and suppliers through their nations."""
    nation, region = T(s, f, "nation"), T(s, f, "region")
    own = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    edge = lambda df, a, z: df.select(F.col("r_name").alias("ego"), a.alias(graph.SRC), z.alias(graph.DST))
    c = T(s, f, "customer").join(own, F.col("c_nationkey") == F.col("n_nationkey"))
    p = T(s, f, "supplier").join(own, F.col("s_nationkey") == F.col("n_nationkey"))
    return graph.union_all([edge(own, F.col("n_name"), F.col("r_name")), edge(c, F.col("c_name"), F.col("n_name")), edge(p, F.col("s_name"), F.col("n_name"))])


Q["path_centrality"] = lambda s, f: b.rounded(graph.ego_centrality(_places(s, f)), ["degree_centrality", "closeness", "betweenness"], 9)
SQL["path_centrality"] = """WITH own AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey),
kids AS (SELECT r_name, n_name, c_name AS kid FROM customer JOIN own ON c_nationkey = n_nationkey UNION ALL SELECT r_name, n_name, s_name FROM supplier JOIN own ON s_nationkey = n_nationkey),
k AS (SELECT own.r_name, own.n_name, count(kid) AS k FROM own LEFT JOIN kids USING (r_name, n_name) GROUP BY ALL),
g AS (SELECT r_name, sum(k) AS kk, count(*) AS nn, sum(k) + count(*) + 1 AS n FROM k GROUP BY 1)
SELECT r_name AS ego, kid AS node_id, round(1 / (n - 1), 9) AS degree_centrality, 0.0::DOUBLE AS closeness, 0.0::DOUBLE AS betweenness FROM kids JOIN g USING (r_name)
UNION ALL SELECT r_name, n_name, round((k + 1) / (n - 1), 9), round(k / (n - 1), 9), round(k / ((n - 1) * (n - 2)), 9) FROM k JOIN g USING (r_name)
UNION ALL SELECT r_name, r_name, round(nn / (n - 1), 9), round((n - 1) / (nn + 2 * kk), 9), 0.0 FROM g"""
Q["node_metadata"] = lambda s, f: graph.node_metadata(nodes(s, f), edges(s, f), "character", "appears_in")
SQL["node_metadata"] = f"""WITH {SQL_NODES}, {_SQL_ENDS}, fc AS (SELECT source_node_id AS node_id, count(DISTINCT target_node_id) AS film_count FROM edges WHERE edge_type = 'appears_in' GROUP BY 1),
dg AS (SELECT node_id, count(*) AS degree FROM ends GROUP BY 1)
SELECT node_id, coalesce(film_count, 0) AS film_count, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN fc USING (node_id) LEFT JOIN dg USING (node_id) WHERE node_type = 'character'"""


def _attributes(s, f):
    return graph.shared_attributes(edges(s, f), "directed", "filmed_at", "appears_in", "is_species")


_SQL_ATTR = SQL_EDGES + """,
attr AS (SELECT DISTINCT target_node_id AS entity, CASE edge_type WHEN 'directed' THEN 'director' ELSE 'location' END AS kind, source_node_id AS attribute FROM edges WHERE edge_type IN ('directed', 'filmed_at')
UNION SELECT DISTINCT a.target_node_id, 'species', z.target_node_id FROM edges a JOIN edges z ON a.source_node_id = z.source_node_id AND z.edge_type = 'is_species' WHERE a.edge_type = 'appears_in')"""
_SQL_SCORE = """SELECT entity_a, entity_b, CAST(CASE WHEN count(CASE WHEN kind = 'director' THEN 1 END) > 0 THEN 5 ELSE 0 END + count(CASE WHEN kind <> 'director' THEN 1 END) AS BIGINT) AS score,
count(CASE WHEN kind = 'director' THEN 1 END) > 0 AS shared_director, coalesce(list(attribute ORDER BY attribute) FILTER (kind = 'location'), []) AS shared_locations,
coalesce(list(attribute ORDER BY attribute) FILTER (kind = 'species'), []) AS shared_species FROM hits GROUP BY ALL"""


def attribute_similarity(s, f):
    """Every order with the next order of its customer."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    pairs = T(s, f, "orders").select(
        F.concat(F.lit("film_"), F.col("o_orderkey").cast("string")).alias("entity_a"),
        F.concat(F.lit("film_"), F.lead("o_orderkey").over(w).cast("string")).alias("entity_b"),
    ).filter(F.col("entity_b").isNotNull())
    return graph.attribute_similarity(pairs, _attributes(s, f))


Q["attribute_similarity"] = attribute_similarity
SQL["attribute_similarity"] = f"""WITH {_SQL_ATTR}, pr AS (SELECT 'film_' || o_orderkey AS entity_a, 'film_' || lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS entity_b FROM orders),
hits AS (SELECT entity_a, entity_b, x.kind, x.attribute FROM pr JOIN attr x ON x.entity = entity_a JOIN attr y ON y.entity = entity_b AND y.kind = x.kind AND y.attribute = x.attribute)
{_SQL_SCORE}"""


def _nation_attributes(s, f):
    """Nations by region, by the priorities their customers order with and by part types they supply."""
    n = T(s, f, "nation")
    region = n.select(F.col("n_name").alias("entity"), F.lit("director").alias("kind"), F.col("n_regionkey").cast("string").alias("attribute"))
    sold = (
        T(s, f, "lineitem").select("l_suppkey", "l_partkey").distinct()
        .join(T(s, f, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(T(s, f, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select("s_nationkey", "p_size", "p_brand").distinct().join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    )
    sizes = sold.select(F.col("n_name").alias("entity"), F.lit("location").alias("kind"), F.col("p_size").cast("string").alias("attribute"))
    brands = sold.select(F.col("n_name").alias("entity"), F.lit("species").alias("kind"), F.col("p_brand").alias("attribute"))
    return graph.union_all([region, sizes, brands]).distinct()


Q["similarity_network"] = lambda s, f: graph.similarity_network(_nation_attributes(s, f), 78)
SQL["similarity_network"] = f"""WITH sold AS (SELECT DISTINCT n_name, p_size, p_brand FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey JOIN nation ON s_nationkey = n_nationkey),
attr AS (SELECT n_name AS entity, 'director' AS kind, CAST(n_regionkey AS VARCHAR) AS attribute FROM nation UNION SELECT n_name, 'location', CAST(p_size AS VARCHAR) FROM sold UNION SELECT n_name, 'species', p_brand FROM sold),
hits AS (SELECT x.entity AS entity_a, y.entity AS entity_b, x.kind, x.attribute FROM attr x JOIN attr y ON y.kind = x.kind AND y.attribute = x.attribute AND x.entity < y.entity),
sc AS ({_SQL_SCORE}) SELECT * FROM sc WHERE score >= 78"""
def _parts(s, f):
    return T(s, f, "part").select(F.concat(F.lit("character_"), F.col("p_partkey").cast("string")).alias("node_id"))


Q["co_members"] = lambda s, f: graph.co_members(_parts(s, f), edges(s, f), "appears_in")
_SQL_SHARED = f"""WITH {SQL_EDGES}, lk AS (SELECT DISTINCT source_node_id AS member, target_node_id AS target FROM edges WHERE edge_type = 'appears_in'),
sd AS (SELECT 'character_' || p_partkey AS seed FROM part),
sh AS (SELECT seed, z.member, count(*) AS shared FROM sd JOIN lk a ON a.member = seed JOIN lk z ON z.target = a.target WHERE z.member <> seed GROUP BY ALL)"""
SQL["co_members"] = f"{_SQL_SHARED} SELECT * FROM sh"
Q["co_members_topk"] = lambda s, f: graph.co_members_topk(edges(s, f), "appears_in", 10, _parts(s, f))
SQL["co_members_topk"] = f"""{_SQL_SHARED} SELECT seed, member, shared, row_number() OVER (PARTITION BY seed ORDER BY shared DESC, member) AS rank FROM sh
QUALIFY row_number() OVER (PARTITION BY seed ORDER BY shared DESC, member) <= 10"""
