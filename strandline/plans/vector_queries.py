"""Vector, corpus, report and streaming queries, with their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import dims as fd
from strandline.functions import text
from strandline.functions import vectors as fv
from strandline.operators import corpus, series, similarity, vector_index
from strandline.plans import base as b
from strandline.plans import reports
from strandline.plans.cleaning_queries import _SQL_WORDS, WS, _quote
from strandline.session import plan_bytes, scratch_path
from strandline.streaming import streams

Q: dict = {}
SQL: dict[str, str] = {}
T = b.table
D = b.SHIP_DIMS

# --- vectors -----------------------------------------------------------------------
Q["cosine_matrix_topk"] = lambda s, f: b.rounded(similarity.cosine_topk(T(s, f, "embeddings"), "vec_id", "label", "embedding", 10, 512), ["score"])
_SQL_COS = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.label, a.vec_id AS id_a, z.vec_id AS id_b, list_cosine_similarity(a.v, z.v) AS score FROM e a JOIN e z ON a.label = z.label AND a.vec_id <> z.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY label, id_a ORDER BY score DESC, id_b) AS rank FROM p)"""
SQL["cosine_matrix_topk"] = f"WITH {_SQL_COS} SELECT label, id_a, id_b, round(score, 6) AS score, rank FROM r WHERE rank <= 10"
Q["similarity_rank"] = lambda s, f: similarity.cosine_topk(T(s, f, "embeddings"), "vec_id", "label", "embedding", 3, 512).select("label", "id_a", "id_b", "rank")
SQL["similarity_rank"] = f"WITH {_SQL_COS} SELECT label, id_a, id_b, rank FROM r WHERE rank <= 3"


def _nation_vectors(s, f):
    return similarity.normalized_vectors(b.ship_lines(s, f), ["nation"], D, ["tax"])


_SQL_NV = b.SQL_SHIP_LINES + """, m AS (SELECT nation, avg(qty) AS qty, avg(price) AS price, avg(disc) AS disc, avg(net) AS net FROM ship_lines GROUP BY 1),
nv AS (SELECT nation, [qty / (qty + price + disc + net), price / (qty + price + disc + net), disc / (qty + price + disc + net), net / (qty + price + disc + net)] AS vector FROM m)"""
Q["normalized_vectors"] = lambda s, f: _nation_vectors(s, f).select("nation", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))
SQL["normalized_vectors"] = f"WITH {_SQL_NV} SELECT nation, list_transform(vector, lambda x: round(x, 6)) AS vector FROM nv"
Q["cosine_euclidean"] = lambda s, f: (
    _nation_vectors(s, f).withColumn("unit", F.array(F.lit(1.0), F.lit(0.5), F.lit(0.25), F.lit(0.125)))
    .select("nation", F.round(fv.cosine(F.col("vector"), F.col("unit")), 6).alias("cosine"), F.round(fv.euclidean(F.col("vector"), F.col("unit")), 6).alias("euclidean"))
)
SQL["cosine_euclidean"] = f"""WITH {_SQL_NV} SELECT nation, round(list_cosine_similarity(vector, [1.0, 0.5, 0.25, 0.125]::DOUBLE[]), 6) AS cosine, round(list_distance(vector, [1.0, 0.5, 0.25, 0.125]::DOUBLE[]), 6) AS euclidean FROM nv"""
Q["distance_to_similarity"] = lambda s, f: b.rounded(similarity.distance_matrix(_nation_vectors(s, f), "nation", "vector", 10), ["distance", "similarity"])
SQL["distance_to_similarity"] = f"""WITH {_SQL_NV}, p AS (SELECT a.nation AS id_a, z.nation AS id_b, list_distance(a.vector, z.vector) AS d FROM nv a, nv z)
SELECT id_a, id_b, round(d, 6) AS distance, round(CASE WHEN id_a = id_b THEN 1.0 ELSE greatest(0.0, 1.0 - d / (SELECT max(d) FROM p)) END, 6) AS similarity FROM p"""
Q["fingerprint"] = lambda s, f: b.rounded(similarity.fingerprint(_nation_vectors(s, f), "nation", ["qty", "price", "disc", "net"], 3), ["value"])
SQL["fingerprint"] = f"""WITH {_SQL_NV}, l AS (SELECT nation, unnest(['qty', 'price', 'disc', 'net']) AS dimension, unnest(vector) AS v FROM nv),
t AS (SELECT dimension FROM l GROUP BY 1 ORDER BY sum(v) DESC LIMIT 3) SELECT nation, dimension, round(v * 100, 6) AS value FROM l WHERE dimension IN (SELECT dimension FROM t)"""


def _asked(s, f):
    """Every fiftieth vector as a query against all."""
    return T(s, f, "embeddings").where(F.pmod(F.col("vec_id"), F.lit(50)) == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


_SQL_ASKED = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT vec_id AS query, v AS qv FROM e WHERE vec_id % 50 = 0)"
_SQL_KNN = _SQL_ASKED + """,
p AS (SELECT query, vec_id AS match, list_cosine_similarity(qv, v) AS score FROM q, e WHERE label <> 3), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, match) AS rank FROM p WHERE score >= 0.05)
SELECT query, match, round(score, 6) AS score, rank FROM r WHERE rank <= 5"""


def _knn(s, f, rows):
    return b.rounded(
        similarity.knn_search(
            T(s, f, "embeddings"), _asked(s, f), "vec_id", "embedding", "query_id", "query_vector",
            k=5, min_score=0.05, where=F.col("label") != 3, block_rows=rows,
        ), ["score"],
    )


Q["knn_search"] = lambda s, f: _knn(s, f, 4096)
SQL["knn_search"] = f"WITH {_SQL_KNN}"
Q["knn_search_tiled"] = lambda s, f: _knn(s, f, 100)
SQL["knn_search_tiled"] = f"WITH {_SQL_KNN}"


def _index(s, f):
    return vector_index.build_index(T(s, f, "embeddings"), "vec_id", "embedding")


def knn_indexed(s, f):
    """All rows indexed; the cells that a bound allows are probed too, so the result is exact."""
    return b.rounded(vector_index.knn_indexed(_index(s, f), _asked(s, f), "query_id", "query_vector", k=5, exact=True), ["score"])


def knn_indexed_recall(s, f):
    """What the default probes find of the exact neighbours."""
    index, asked = _index(s, f), _asked(s, f)
    found = vector_index.knn_indexed(index, asked, "query_id", "query_vector", k=5)
    exact = similarity.knn_search(T(s, f, "embeddings"), asked, "vec_id", "embedding", "query_id", "query_vector", k=5, min_score=None)
    return vector_index.index_recall(index, found, exact)


Q["knn_indexed"] = knn_indexed
SQL["knn_indexed"] = f"""WITH {_SQL_ASKED}, r AS (SELECT query, vec_id AS match, list_cosine_similarity(qv, v) AS score FROM q, e)
SELECT query, match, round(score, 6) AS score, row_number() OVER w AS rank FROM r WINDOW w AS (PARTITION BY query ORDER BY score DESC, match) QUALIFY row_number() OVER w <= 5"""
# Depends on the fitted cells; the tests ask for a recall of 0.9 at least.
Q["knn_indexed_recall"] = knn_indexed_recall
Q["cosine_topk_pruned"] = lambda s, f: b.rounded(vector_index.cosine_topk_pruned(T(s, f, "embeddings"), "vec_id", "label", "embedding", 10, cells=4)[0], ["score"])
SQL["cosine_topk_pruned"] = SQL["cosine_matrix_topk"]
# Depends on the fitted cells; the tests show that clustered data leave tiles out.
Q["cosine_topk_tiles"] = lambda s, f: vector_index.cosine_topk_pruned(T(s, f, "embeddings"), "vec_id", "label", "embedding", 10, cells=4)[1]
Q["validate_vectors"] = lambda s, f: similarity.validate_vectors(
    T(s, f, "embeddings").withColumn(
        "v", F.when(F.col("label") == 1, F.concat("embedding", F.array(F.lit(float("nan")).cast("float")))).when(F.col("label") != 2, F.col("embedding"))
    ), "v", 64,
)
SQL["validate_vectors"] = """WITH e AS (SELECT CASE WHEN label = 1 THEN list_append(embedding, 'nan'::FLOAT) WHEN label <> 2 THEN embedding END AS v FROM embeddings),
a AS (SELECT count(*) AS total, count(*) - count(v) AS null_vectors, count(CASE WHEN len(v) <> 64 THEN 1 END) AS wrong_width, count(CASE WHEN len(list_filter(v, lambda x: isnan(x))) > 0 THEN 1 END) AS nan_vectors,
count(CASE WHEN len(list_filter(v, lambda x: isinf(x))) > 0 THEN 1 END) AS inf_vectors FROM e) SELECT *, null_vectors + wrong_width + nan_vectors + inf_vectors = 0 AS valid FROM a"""


def embed(s, f):
    def letters(texts):
        return [[len(t), t.count("a"), t.count("e"), t.count(" ")] for t in texts]

    return similarity.embed(T(s, f, "documents"), "doc_id", "text", letters)


Q["embed"] = embed
SQL["embed"] = "SELECT doc_id, [length(text), length(text) - length(replace(text, 'a', '')), length(text) - length(replace(text, 'e', '')), length(text) - length(replace(text, ' ', ''))]::DOUBLE[] AS embedding FROM documents"


def score_text(s, f):
    def letters(texts):
        return [{"joy": t.count("o") / len(t), "fear": t.count("f") / len(t)} for t in texts]

    return corpus.score_text(T(s, f, "documents").select("doc_id", "text"), "text", letters, ["joy", "fear", "anger"]).drop("text")


Q["score_text"] = score_text
SQL["score_text"] = f"""WITH w AS (SELECT doc_id, text, {_SQL_WORDS.replace('{0}', 'text')} AS ws FROM documents), c AS (SELECT doc_id, CASE WHEN len(ws) > 450 THEN array_to_string(ws[1:450], ' ') ELSE text END AS t FROM w)
SELECT doc_id, CASE WHEN trim(t) = '' THEN 0 ELSE (length(t) - length(replace(t, 'o', ''))) / length(t) END AS emotion_joy, CASE WHEN trim(t) = '' THEN 0 ELSE (length(t) - length(replace(t, 'f', ''))) / length(t) END AS emotion_fear,
0.0::DOUBLE AS emotion_anger FROM c"""


def lexicon_scores(s, f):
    """Share of the documents' words that the benchmark texts use, weighted by length."""
    lexicon = T(s, f, "benchmark").select(F.explode(text.words(F.lower("text"))).alias("word")).distinct().select(
        "word", F.when(F.length("word") > 5, "long").otherwise("short").alias("label"), (F.lit(1.0) / (F.length("word") + 6)).alias("weight")
    )
    return b.rounded(corpus.lexicon_scores(T(s, f, "documents"), "doc_id", "text", lexicon), ["score"])


Q["lexicon_scores"] = lexicon_scores
SQL["lexicon_scores"] = f"""WITH lx AS (SELECT DISTINCT unnest({_SQL_WORDS.replace('{0}', 'lower(text)')}) AS word FROM benchmark),
dw AS (SELECT doc_id, unnest({_SQL_WORDS.replace('{0}', 'lower(text)')}) AS word FROM documents), tt AS (SELECT doc_id, count(*) AS n FROM dw GROUP BY 1),
sc AS (SELECT doc_id, CASE WHEN length(word) > 5 THEN 'long' ELSE 'short' END AS label, sum(1.0::DOUBLE / (length(word) + 6)) / any_value(n) AS score FROM dw JOIN lx USING (word) JOIN tt USING (doc_id) GROUP BY ALL)
SELECT doc_id, label, round(coalesce(score, 0.0), 6) AS score FROM documents CROSS JOIN (VALUES ('long'), ('short')) v(label) LEFT JOIN sc USING (doc_id, label)"""

# --- corpus ---------------------------------------------------------------------------
Q["chunk_text"] = lambda s, f: corpus.chunk_text(T(s, f, "documents").select("doc_id", "text"), "text", 300, 50)
SQL["chunk_text"] = f"""WITH w AS (SELECT doc_id, text, {_SQL_WORDS.replace('{0}', 'text')} AS ws FROM documents),
c AS (SELECT doc_id, CASE WHEN len(ws) <= 300 THEN [text] ELSE list_transform(range(0, len(ws), 250), lambda i: array_to_string(ws[i + 1:i + 300], ' ')) END AS cs FROM w)
SELECT doc_id, len(cs) AS total_chunks, unnest(cs) AS chunk, generate_subscripts(cs, 1) AS chunk_num FROM c"""


def chunk_with_tokenizer(s, f):
    return corpus.chunk_with_tokenizer(T(s, f, "documents").select("doc_id", "text"), "text", lambda t: [ord(c) for c in t], lambda ids: "".join(map(chr, ids)), 1000, 100)


Q["chunk_with_tokenizer"] = chunk_with_tokenizer
SQL["chunk_with_tokenizer"] = """WITH c AS (SELECT doc_id, CASE WHEN length(text) <= 1000 THEN [text] ELSE list_transform(range(0, length(text), 900), lambda i: substring(text, i + 1, 1000)) END AS cs FROM documents)
SELECT doc_id, len(cs) AS total_chunks, unnest(cs) AS chunk, generate_subscripts(cs, 1) AS chunk_num FROM c"""
Q["count_tokens"] = lambda s, f: T(s, f, "documents").select("doc_id", corpus.count_tokens("text", lambda t: t.split(" ")).alias("tokens"))
SQL["count_tokens"] = "SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END AS tokens FROM documents"
Q["entity_documents"] = lambda s, f: corpus.entity_documents(
    T(s, f, "part").withColumn("description", F.when(F.col("p_size") > 40, F.concat(F.lit("A large "), F.col("p_name")))),
    "part", "p_partkey", "p_name", F.concat("p_name", F.lit(" is a part of brand "), "p_brand", F.lit(".")),
    [("p_type", "Type: ", "."), ("p_size", "Size: ", ".")], "description", ["p_type", "p_size"],
)
SQL["entity_documents"] = """SELECT 'part_' || p_partkey AS doc_id, 'part' AS type, p_name AS name, CASE WHEN p_size > 40 THEN 'A large ' || p_name ELSE p_name || ' is a part of brand ' || p_brand || '. Type: ' || p_type || '.' || CASE WHEN p_size <> 0 THEN ' Size: ' || p_size || '.' ELSE '' END END AS text,
CAST(json_object('p_type', p_type, 'p_size', p_size) AS VARCHAR) AS metadata FROM part"""


def quote_documents(s, f):
    """The conversations' most intense minutes as documents."""
    turns = T(s, f, "conversations").select("conv_id", "turn", "text", (F.col("turn") * 45.0).alias("start"))
    scored = turns.withColumn("lines", F.lit(1)).withColumn("long", F.length("text") / 1999.0).withColumn("vowel", F.regexp_count("text", F.lit("[aeiou]")) / 997.0)
    minutes = series.minute_aggregate(scored, ["conv_id"], "start", ["long", "vowel"])
    top = series.intensity_rank(minutes, ["conv_id"], "minute_offset", ["long", "vowel"], "dialogue_count", 3)
    return b.rounded(corpus.quote_documents(top, turns, ["conv_id"], "minute_offset", "start", "text", ["turn"], ["long", "vowel"]), ["long", "vowel"])


Q["quote_documents"] = quote_documents
SQL["quote_documents"] = """WITH t AS (SELECT conv_id, turn, text, CAST(floor(turn * 45.0 / 60) AS BIGINT) AS minute_offset, length(text) / 1999.0::DOUBLE AS long, len(regexp_extract_all(text, '[aeiou]')) / 997.0::DOUBLE AS vowel FROM conversations),
m AS (SELECT conv_id, minute_offset, avg(long) AS long, avg(vowel) AS vowel FROM t GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY long + vowel DESC, minute_offset) AS rn FROM m),
j AS (SELECT conv_id, minute_offset, string_agg(text, ' ' ORDER BY turn) AS txt FROM t GROUP BY ALL)
SELECT concat_ws('_', 'quote', conv_id, minute_offset) AS doc_id, 'quote' AS type, conv_id, minute_offset, CASE WHEN length(txt) > 500 THEN txt[1:497] || '...' ELSE txt END AS text, round(long, 6) AS long, round(vowel, 6) AS vowel
FROM r JOIN j USING (conv_id, minute_offset) WHERE rn <= 3"""
Q["corpus_stats"] = lambda s, f: b.rounded(corpus.corpus_stats(T(s, f, "documents"), "lang", "text"), ["avg_length", "avg_tokens"])
SQL["corpus_stats"] = f"""SELECT lang, count(*) AS documents, round(avg(length(text)), 6) AS avg_length, round(avg(length(text) // 4), 6) AS avg_tokens, count(CASE WHEN trim(regexp_replace(text, '{WS}', ' ', 'g')) = '' THEN 1 END) AS empty_texts FROM documents GROUP BY 1"""
Q["corpus_in_range"] = lambda s, f: corpus.corpus_in_range(T(s, f, "documents"))
SQL["corpus_in_range"] = "SELECT count(*) AS total_documents, count(*) BETWEEN 100 AND 2000 AS in_expected_range FROM documents"
Q["embedding_cost"] = lambda s, f: b.rounded(corpus.embedding_cost(T(s, f, "documents"), "text"), ["estimated_cost_usd"], 9)
SQL["embedding_cost"] = "WITH a AS (SELECT count(*) AS total_documents, CAST(sum(length(text) // 4) AS BIGINT) AS total_tokens FROM documents) SELECT *, round(total_tokens / 1000000.0::DOUBLE * 0.02::DOUBLE, 9) AS estimated_cost_usd, total_tokens / 1000000.0 * 0.02 < 2 AS under_budget FROM a"
Q["batch_ids"] = lambda s, f: corpus.batch_ids(T(s, f, "documents").select("source", "doc_id"), ["source", "doc_id"], 100)
SQL["batch_ids"] = "SELECT source, doc_id, (row_number() OVER (ORDER BY source, doc_id) - 1) // 100 AS batch_id FROM documents"


def _answers(s, f):
    """Turns as answers: their text with figures of the conversation woven in."""
    c = T(s, f, "conversations")
    extra = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" Correlation r = 0."), F.length("text").cast("string"), F.lit(", p < 0.05, n = "), F.col("conv_id").cast("string"), F.lit(" in the Emotion Archive at minute "), F.col("turn").cast("string")))
    extra = extra.when(F.col("turn") % 3 == 1, F.lit(" I imagine this compound_sentiment (joy: 0.92, fear: 0.1) \"a quoted line of text\" and emotional range; interpretation of the top quartile."))
    return c.select(
        "conv_id", "turn", "role", F.concat("text", F.coalesce(extra, F.lit(""))).alias("answer"),
        F.array(F.lit("QUARTILE"), F.lit("the"), F.col("role")).alias("terms"),
    )


_CITE = ["Emotion Archive", "success_metrics"]
_SQL_ANS = """an AS (SELECT conv_id, turn, role, text || CASE turn % 3 WHEN 0 THEN ' Correlation r = 0.' || length(text) || ', p < 0.05, n = ' || conv_id || ' in the Emotion Archive at minute ' || turn
WHEN 1 THEN ' I imagine this compound_sentiment (joy: 0.92, fear: 0.1) "a quoted line of text" and emotional range; interpretation of the top quartile.' ELSE '' END AS answer, ['QUARTILE', 'the', role] AS terms FROM conversations)"""


def _cnt(patterns):
    return "(" + " + ".join(f"len(regexp_extract_all(answer, {_quote('(?i)' + p)}))" for p in patterns) + ")"


def _any(patterns):
    return "(" + " OR ".join(f"regexp_matches(answer, {_quote('(?i)' + p)})" for p in patterns) + ")"


_STAT = {k: [p for p, kk in corpus.STATISTICAL_PATTERNS if kk == k] for k in ("correlation", "pvalue", "quartile", "zscore", "sample_size")}
_SQL_DET = _SQL_ANS + f""", det AS (SELECT *, {_cnt(_CITE)} + {" + ".join(f"CAST({_any([p])} AS BIGINT)" for p in corpus.TIME_PATTERNS + corpus.ID_PATTERNS)} AS citation_count,
{_any(corpus.TIME_PATTERNS)} AS has_timestamps, {_any(corpus.ID_PATTERNS)} AS has_ids, {_cnt([p for p, _ in corpus.STATISTICAL_PATTERNS])} AS stat_count,
{", ".join(f"{_any(ps)} AS has_{k}" for k, ps in _STAT.items())}, {_cnt(corpus.METRIC_PATTERNS)} AS metric_count, {_cnt(corpus.INTERPRETATION_PATTERNS)} AS interpretation_count,
{_cnt(corpus.SCORE_PATTERNS)} AS score_count, {_cnt(corpus.QUOTE_PATTERNS)} AS quote_count FROM an),
ex AS (SELECT *, list_filter(terms, lambda t: contains(lower(answer), lower(t))) AS found_terms, list_filter(terms, lambda t: NOT contains(lower(answer), lower(t))) AS missing_terms FROM det),
sc AS (SELECT *, least(1.0, citation_count / 2.0::DOUBLE) * 0.15::DOUBLE + least(1.0, stat_count / 2.0::DOUBLE) * 0.25::DOUBLE + least(1.0, metric_count / 2.0::DOUBLE) * 0.25::DOUBLE
  + least(1.0, (CAST(interpretation_count > 0 AS INTEGER) + CAST(score_count > 0 AS INTEGER) + CAST(quote_count > 0 AS INTEGER)) / 2.0::DOUBLE) * 0.25::DOUBLE + len(found_terms) / len(terms) * 0.1::DOUBLE AS vs FROM ex)"""
Q["detect_patterns"] = lambda s, f: corpus.detect_patterns(_answers(s, f), "answer", _CITE).drop("answer", "terms")
SQL["detect_patterns"] = f"WITH {_SQL_DET} SELECT * EXCLUDE (answer, terms) FROM det"
Q["expected_terms"] = lambda s, f: corpus.expected_terms(_answers(s, f), "answer", "terms").drop("answer", "terms")
SQL["expected_terms"] = f"WITH {_SQL_DET} SELECT conv_id, turn, role, found_terms, missing_terms FROM ex"
Q["rubric_score"] = lambda s, f: corpus.rubric_score(_answers(s, f), "answer", _CITE, "terms").select("conv_id", "turn", F.round("validation_score", 6).alias("validation_score"), "passed")
SQL["rubric_score"] = f"WITH {_SQL_DET} SELECT conv_id, turn, round(vs, 6) AS validation_score, vs >= 0.7::DOUBLE AS passed FROM sc"
Q["rubric_report"] = lambda s, f: b.rounded(corpus.rubric_report(corpus.rubric_score(_answers(s, f), "answer", _CITE, "terms"), "role"), ["pass_rate", "mean_score"])
SQL["rubric_report"] = f"""WITH {_SQL_DET} SELECT CASE WHEN grouping(role) = 1 THEN '_ALL_' ELSE role END AS role, count(*) AS total, count(CASE WHEN vs >= 0.7::DOUBLE THEN 1 END) AS passed,
round(count(CASE WHEN vs >= 0.7::DOUBLE THEN 1 END) / count(*), 6) AS pass_rate, round(avg(vs), 6) AS mean_score FROM sc GROUP BY ROLLUP (role)"""


def narrative_excerpts(s, f):
    turns = T(s, f, "conversations").select("conv_id", "turn", "text", (F.col("turn") * 45.0).alias("start"))
    bucketed = turns.withColumn("minute_offset", text.minute_bucket("start"))
    scored = series.minute_aggregate(turns.withColumn("long", F.length("text") / 1999.0).withColumn("zeta", F.regexp_count("text", F.lit("z")) / 97.0), ["conv_id"], "start", ["long", "zeta"])
    around = series.context_window(bucketed.groupBy("conv_id").agg(F.max("minute_offset").alias("minute_offset")), ["conv_id"], "minute_offset", 2)
    out = corpus.narrative_excerpts(around, scored, series.longest_lines(bucketed, ["conv_id", "minute_offset"], "text", 1, 80, "turn"), ["conv_id"], "minute_offset", ["long", "zeta"], fd.compound(["long"], ["zeta"]))
    return out.select("conv_id", "minute_offset", "dialogue", F.round(F.col("emotions")["zeta"], 6).alias("zeta"), F.round("compound", 6).alias("compound"))


Q["narrative_excerpts"] = narrative_excerpts
SQL["narrative_excerpts"] = """WITH t AS (SELECT conv_id, turn, text, CAST(floor(turn * 45.0 / 60) AS BIGINT) AS minute_offset, length(text) / 1999.0::DOUBLE AS long, len(regexp_extract_all(text, 'z')) / 97.0::DOUBLE AS zeta FROM conversations),
m AS (SELECT conv_id, minute_offset, avg(long) AS long, avg(zeta) AS zeta FROM t GROUP BY ALL), a AS (SELECT conv_id, max(minute_offset) AS mm FROM t GROUP BY 1),
w AS (SELECT conv_id, unnest(generate_series(greatest(mm - 2, 0), mm + 2)) AS minute_offset FROM a),
x AS (SELECT *, row_number() OVER (PARTITION BY conv_id, minute_offset ORDER BY length(text) DESC, turn) AS rn FROM t WHERE trim(text) <> '')
SELECT w.conv_id, w.minute_offset, CASE WHEN x.text IS NULL THEN ['[No dialogue]'] WHEN length(x.text) > 80 THEN [x.text[1:77] || '...'] ELSE [x.text] END AS dialogue, CASE WHEN m.zeta > 0.01 THEN round(m.zeta, 6) END AS zeta, round(coalesce(m.long - m.zeta, 0), 6) AS compound
FROM w LEFT JOIN m USING (conv_id, minute_offset) LEFT JOIN x ON x.conv_id = w.conv_id AND x.minute_offset = w.minute_offset AND rn = 1"""


def running_cost_ledger(s, f):
    usage = T(s, f, "conversations").select(
        "conv_id", "turn", F.col("role").alias("model"), (F.length("text") * 7).alias("input_tokens"), (F.length("text") * 3).alias("output_tokens")
    )
    prices = T(s, f, "conversations").select(F.col("role").alias("model")).distinct().filter("model <> 'system'").select(
        "model", (F.length("model") * 0.11).alias("input"), (F.length("model") * 0.23).alias("output")
    )
    out = corpus.running_cost_ledger(usage, prices, "conv_id", "turn", "model", "user")
    return b.rounded(out, ["cost", "session_total"])


Q["running_cost_ledger"] = running_cost_ledger
SQL["running_cost_ledger"] = """WITH RECURSIVE u AS (SELECT conv_id, turn, role AS model, length(text) * 7 AS i, length(text) * 3 AS o, CASE role WHEN 'system' THEN 4 ELSE length(role) END AS l FROM conversations),
c AS (SELECT *, i / 1000.0::DOUBLE * (l * 0.11::DOUBLE) + o / 1000.0::DOUBLE * (l * 0.23::DOUBLE) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM u),
t AS (SELECT *, 0.0::DOUBLE AS before, cost >= 20 AS rejected, CASE WHEN cost >= 20 THEN 0.0 ELSE cost END AS st FROM c WHERE rn = 1
UNION ALL SELECT c.*, t.st, t.st + c.cost >= 20, CASE WHEN t.st + c.cost >= 20 THEN t.st ELSE t.st + c.cost END FROM t JOIN c ON c.conv_id = t.conv_id AND c.rn = t.rn + 1)
SELECT conv_id, turn, model, CAST(i AS INTEGER) AS input_tokens, CAST(o AS INTEGER) AS output_tokens, round(cost, 6) AS cost, round(st, 6) AS session_total,
list_filter([CASE WHEN before < 5 AND st >= 5 THEN 5.0::DOUBLE END, CASE WHEN before < 10 AND st >= 10 THEN 10.0::DOUBLE END, CASE WHEN before < 15 AND st >= 15 THEN 15.0::DOUBLE END], lambda x: x IS NOT NULL) AS thresholds_crossed, rejected FROM t"""

# --- reports -------------------------------------------------------------------------


def safe_select(s, f):
    T(s, f, "orders").createOrReplaceTempView("report_orders")
    return reports.safe_select(
        s, "SELECT o_orderpriority, count(*) AS n, round(max(o_totalprice), 2) AS top FROM report_orders GROUP BY o_orderpriority;", ["report_orders"]
    )


Q["safe_select"] = safe_select
SQL["safe_select"] = "SELECT o_orderpriority, count(*) AS n, round(max(o_totalprice), 2) AS top FROM orders GROUP BY 1"
Q["find_by_criteria"] = lambda s, f: reports.find_by_criteria(
    T(s, f, "orders").select("o_orderkey", "o_orderpriority", F.year("o_orderdate").cast("bigint").alias("year"), (F.col("o_totalprice") / 6000).alias("rating")),
    ("o_orderpriority", "1-urgent"), ("year", 1997), ("rating", 50.0), ["o_orderkey"],
).drop("rating")
SQL["find_by_criteria"] = "SELECT o_orderkey, o_orderpriority, year(o_orderdate) AS year FROM orders WHERE lower(o_orderpriority) = '1-urgent' AND year(o_orderdate) >= 1997 AND o_totalprice / 6000 >= 50 ORDER BY year(o_orderdate) DESC, o_orderkey LIMIT 100"
_UP = (["purchase", "signup", "view"], ["click", "error"])
_SQL_UP = b.SQL_EVENT_SERIES + ', up AS (SELECT *, (purchase + signup + "view") - (click + error) AS x FROM event_series)'
Q["series_report"] = lambda s, f: b.rounded(
    reports.series_report(b.event_series(s, f), ["user_id"], "minute_offset", fd.compound(*_UP)), ["overall", "variance", "emotional_range", "beginning", "ending", "peak_score", "dip_score"]
)
SQL["series_report"] = f"""WITH {_SQL_UP}, g AS (SELECT user_id, avg(x) AS overall, var_pop(x) AS variance, max(x) - min(x) AS emotional_range, arg_min(x, minute_offset) AS beginning, arg_max(x, minute_offset) AS ending,
arg_max(minute_offset, {{'a': x, 'b': -minute_offset}}) AS peak_minute, arg_min(minute_offset, {{'a': x, 'b': minute_offset}}) AS dip_minute, max(x) AS peak_score, min(x) AS dip_score, count(*) AS n FROM up GROUP BY 1)
SELECT user_id, peak_minute, dip_minute, n, {b.sql_rounded(['overall', 'variance', 'emotional_range', 'beginning', 'ending', 'peak_score', 'dip_score'])}, CASE WHEN overall > 0.1 THEN 'positive' WHEN overall < -0.1 THEN 'negative' ELSE 'neutral' END AS direction FROM g"""
Q["report_extremes"] = lambda s, f: b.rounded(reports.report_extremes(b.event_series(s, f), ["user_id"], "minute_offset", fd.compound(*_UP)), ["score"])
SQL["report_extremes"] = f"""WITH {_SQL_UP}, r AS (SELECT user_id, minute_offset, x, row_number() OVER (PARTITION BY user_id ORDER BY x DESC, minute_offset) AS a, row_number() OVER (PARTITION BY user_id ORDER BY x, minute_offset) AS z FROM up)
SELECT user_id, minute_offset, round(x, 6) AS score, a AS rank, 'peak' AS side FROM r WHERE a <= 5 UNION ALL SELECT user_id, minute_offset, round(x, 6), z, 'valley' FROM r WHERE z <= 5"""


def compare_arcs(s, f):
    """Arcs of the return flags per nation by the strongest dimension: all six frames as tagged rows."""
    arcs = reports.compare_arcs(b.ship_series(s, f), ["nation"], "week", "flag", F.round(fd.strongest_value(D), 9), ["A", "N", "R"])

    def part(name, frame, label, value, digits=6):
        return frame.select("nation", F.lit(name).alias("part"), label.alias("name"), F.round(value, digits).alias("value"))

    bucket = F.concat_ws("-", "flag", F.col("week").cast("string"))
    out = [
        *[part(f"stats_{c}", arcs["stats"], F.col("flag"), F.col(c).cast("double")) for c in ("avg", "min", "max", "n")],
        part("correlation", arcs["correlations"], F.concat_ws("-", "member_a", "member_b"), F.col("r")),
        part("summary", arcs["summary"], F.concat_ws("|", "closest_pair", "most_different_pair"), F.col("avg_correlation")),
        part("peak", arcs["peaks"], F.concat_ws("-", bucket, F.col("rank").cast("string")), F.col("score")),
        part("divergence", arcs["divergence"], F.col("week").cast("string"), F.col("variance"), 9),
        part("distinctive", arcs["distinctive"], bucket, F.col("others_mean")),
    ]
    return reduce(DataFrame.unionByName, out)


Q["compare_arcs"] = compare_arcs
SQL["compare_arcs"] = f"""WITH {b.SQL_SHIP_SERIES}, x AS (SELECT nation, flag, week, round(greatest({', '.join(D)}), 9) AS v FROM ship_series),
al AS (SELECT nation, week, max(CASE WHEN flag = 'A' THEN v END) AS a, max(CASE WHEN flag = 'N' THEN v END) AS n, max(CASE WHEN flag = 'R' THEN v END) AS r, round(var_pop(v), 9) AS var, count(*) AS c FROM x GROUP BY ALL),
d AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY var DESC, week) AS rn FROM al WHERE c > 1),
co AS (SELECT nation, 'A-N' AS name, corr(a, n) AS r FROM al GROUP BY 1 UNION ALL SELECT nation, 'A-R', corr(a, r) FROM al GROUP BY 1 UNION ALL SELECT nation, 'N-R', corr(n, r) FROM al GROUP BY 1),
pk AS (SELECT *, row_number() OVER (PARTITION BY nation, flag ORDER BY v DESC, week) AS rank FROM x QUALIFY rank <= 3),
ot AS (SELECT pk.nation, pk.flag, pk.week, pk.v, avg(x.v) AS m FROM pk JOIN x ON x.nation = pk.nation AND x.week = pk.week AND x.flag <> pk.flag GROUP BY ALL)
{" UNION ALL ".join(f"SELECT nation, 'stats_{c}' AS part, flag AS name, round({e}, 6) AS value FROM x GROUP BY nation, flag" for c, e in (("avg", "avg(v)"), ("min", "min(v)"), ("max", "max(v)"), ("n", "count(v)::DOUBLE")))}
UNION ALL SELECT nation, 'correlation', name, round(r, 6) FROM co UNION ALL SELECT nation, 'summary', arg_max(name, r) || '|' || arg_min(name, r), round(avg(r), 6) FROM co GROUP BY 1
UNION ALL SELECT nation, 'peak', flag || '-' || week || '-' || rank, round(v, 6) FROM pk UNION ALL SELECT nation, 'divergence', CAST(week AS VARCHAR), var FROM d WHERE rn <= 3
UNION ALL SELECT nation, 'distinctive', flag || '-' || week, round(m, 6) FROM ot WHERE v > m + 0.1"""
Q["series_export"] = lambda s, f: (
    reports.series_export(b.ship_series(s, f), "week", D, b.SHIP_POSITIVE, b.SHIP_NEGATIVE, 400, 520)
    .select("nation", "flag", "week", F.round("compound", 6).alias("compound"), F.col("dominant.name").alias("dominant"), F.col("dominant.polarity").alias("polarity"))
)
SQL["series_export"] = f"""WITH {b.SQL_SHIP_SERIES}, m AS (SELECT *, greatest(0.0, qty, price, net) AS pv, greatest(0.0, disc, tax) AS nv FROM ship_series WHERE week BETWEEN 400 AND 520)
SELECT nation, flag, week, round((qty + price + net) / 3.0 - (disc + tax) / 2.0, 6) AS compound, CASE WHEN pv > nv THEN CASE WHEN qty = pv THEN 'qty' WHEN price = pv THEN 'price' ELSE 'net' END WHEN nv <= 0 THEN NULL WHEN disc = nv THEN 'disc' ELSE 'tax' END AS dominant,
CASE WHEN pv > nv THEN 'positive' ELSE 'negative' END AS polarity FROM m"""
Q["entity_lookup"] = lambda s, f: b.rounded(
    reports.entity_lookup(reports.summary_by_entity(b.ship_series(s, f), b.SHIP_KEYS, D, "lines"), {"nation": "nation_7", "flag": None}, defaults={"qty": 0.0}), D
)
SQL["entity_lookup"] = f"WITH {b.SQL_SHIP_SERIES} SELECT nation, flag, {', '.join(f'round(avg({d}), 6) AS {d}' for d in D)}, count(*) AS buckets, CAST(sum(lines) AS BIGINT) AS lines FROM ship_series WHERE nation = 'NATION_7' GROUP BY ALL"

# --- streams --------------------------------------------------------------------------


# Three parts arrive in order, each a third of the time covered and ten days at least; events of up to
# 40 minutes before a border come with the next part.
_PART, _PARTS = 10 * 86400, [0, 1, 2]
#: Seconds added to the streams' times: a watermark begins at 1970, and whatever is older counts as late.
_ORIGIN = 10_000 * 86400
#: Stored bytes of the events for each file of a part.
_FILE_BYTES = 16 << 20


def _event_rows(s, f):
    return T(s, f, "events").select(
        "event_id", "user_id", "event_type", "value",
        F.timestamp_seconds(b.seconds_since("ts", "2024-01-01") + _ORIGIN).alias("ts"),
        *[F.when(F.col("event_type") == d, F.col("value") / 997.0).otherwise(F.lit(0.0)).alias(d) for d in b.EVENT_DIMS],
    )


def _timed_stream(s, f, again=False):
    """Events from several micro-batches and a closing marker, and the delay they need; ``again``: each in the next part too.

    A micro-batch takes in one part, in files that grow in number with the input, so there are as many
    micro-batches however large it is. The delay is longer than a part: in whatever order
    files are taken, no event is late when it first arrives.
    """
    rows = _event_rows(s, f)
    late = F.unix_timestamp("ts") + F.coalesce(F.pmod("event_id", F.lit(3)), F.lit(0)) * 1200
    first, last = rows.agg(F.min(late), F.max(late)).first()
    start = (first or 0) // 86400 * 86400
    days = max(_PART // 86400, -(-((last or 0) - start + 1) // (len(_PARTS) * 86400)))
    # Events without a time come first.
    part = F.coalesce(F.floor((late - start) / (days * 86400)), F.lit(0))
    if again:
        rows = rows.withColumn("part", F.explode(F.array(part, part + 1)))
    else:
        rows = rows.withColumn("part", part)
    files = max(1, -(-plan_bytes(rows) // _FILE_BYTES))
    marker = rows.limit(1).select(*[F.lit("2100-01-01").cast("timestamp").alias(c) if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes])
    path = streams.staged_arrivals(rows, F.col("part"), [*_PARTS, *([len(_PARTS)] if again else [])], marker, "arrivals", files)
    stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)
    return stream.drop("part"), f"{days + 1} days"


def _event_stream(s, f, again=False):
    return _timed_stream(s, f, again)[0]


def stream_minute_aggregate(s, f):
    stream, delay = _timed_stream(s, f)
    out = streams.run_to_parquet(streams.stream_minute_aggregate(stream, ["user_id"], "ts", b.EVENT_DIMS, "1 hour", delay), "minute")
    got = s.read.schema("user_id bigint, dialogue_count bigint, " + ", ".join(f"{d} double" for d in b.EVENT_DIMS) + ", bucket_start timestamp").parquet(out)
    return b.rounded(got.withColumn("minute_offset", F.floor((F.unix_timestamp("bucket_start") - _ORIGIN) / 3600).cast("bigint")).drop("bucket_start"), b.EVENT_DIMS)


Q["stream_minute_aggregate"] = stream_minute_aggregate
SQL["stream_minute_aggregate"] = f"WITH {b.SQL_EVENT_SERIES} SELECT user_id, minute_offset, dialogue_count, {b.sql_rounded(b.EVENT_DIMS)} FROM event_series"


def stream_idempotent_load(s, f):
    """Every event arrives twice, its copy in a later micro-batch."""
    twice, delay = _timed_stream(s, f, again=True)
    out = streams.run_to_parquet(streams.stream_idempotent(twice.select("event_id", "ts", "value"), ["event_id"], "ts", delay), "dedup")
    return s.read.schema("event_id bigint, ts timestamp, value double").parquet(out).filter("event_id IS NOT NULL").select("event_id", "value")


Q["stream_idempotent_load"] = stream_idempotent_load
SQL["stream_idempotent_load"] = "SELECT event_id, value FROM events"


def stream_sessions(s, f):
    stream, delay = _timed_stream(s, f)
    out = streams.run_to_parquet(streams.stream_sessions(stream, ["user_id"], "ts", "value", "5 hours", delay), "sessions")
    got = s.read.schema("user_id bigint, start timestamp, end timestamp, intensity double, members bigint").parquet(out)
    return got.withColumns({c: F.unix_timestamp(c) - _ORIGIN for c in ("start", "end")})


Q["stream_sessions"] = stream_sessions
SQL["stream_sessions"] = f"""WITH {b.SQL_EVENT_LINES}, m AS (SELECT *, CASE WHEN seconds - lag(seconds) OVER (PARTITION BY user_id ORDER BY seconds, event_id) <= 18000 THEN 0 ELSE 1 END AS fresh FROM event_lines),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY seconds, event_id) AS island FROM m)
SELECT user_id, min(seconds) AS "start", max(seconds) AS "end", max(value) AS intensity, count(*) AS members FROM i GROUP BY user_id, island"""


def stream_quality_gate(s, f):
    path, state = scratch_path(s, "gate"), scratch_path(s, "gate-state")
    rows = _event_stream(s, f).filter("event_id IS NOT NULL").select("event_id", "event_type", "value")
    streams.stream_quality_gate(rows, (F.col("value") > 200) | (F.col("event_type") == "error"), path, state).awaitTermination()
    return s.read.schema("event_id bigint, side string").option("basePath", path).parquet(path).select("event_id", "side")


Q["stream_quality_gate"] = stream_quality_gate
SQL["stream_quality_gate"] = "SELECT event_id, CASE WHEN value > 200 OR event_type = 'error' THEN 'quarantine' ELSE 'good' END AS side FROM events"


def stream_batch_load(s, f):
    path, state = scratch_path(s, "batches"), scratch_path(s, "batches-state")
    twice = _event_stream(s, f, again=True).filter("event_id IS NOT NULL").select("event_id", "value")
    query = streams.load_batches(twice, path, ["event_id"], state)
    query.awaitTermination()
    return s.read.schema("event_id bigint, value double").parquet(path)


Q["stream_batch_load"] = stream_batch_load
SQL["stream_batch_load"] = "SELECT event_id, value FROM events"
