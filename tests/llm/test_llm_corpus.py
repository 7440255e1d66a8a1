"""Joins, graphs, language model and pipeline: results that depend on all rows."""

import math
import random

import brute
import pytest

import corpus_pipeline
from strandline.llm import lattice_lm, line_dedup, ngram_join, url_graph
from strandline.llm.components import components

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, rep string, prefix string"


def family(rng, n):
    """Texts of a few originals with edits, copies, boilerplate, blanks and NULL."""
    base = [[f"w{rng.randint(0, 300)}" for _ in range(rng.randint(1, 60))] for _ in range(30)]
    for _ in range(n):
        words = list(rng.choice(base if rng.random() < 0.7 else base[:2]))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**6)}"
        yield " ".join(words)


def rows_of(seed, n):
    rng = random.Random(seed)
    return [(i, t) for i, t in enumerate(family(rng, n))] + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "A b"), (n + 4, "a B")]


def with_clashes(spark, rows):
    return spark.createDataFrame([(i, t, "r", "p") for i, t in rows], DOCS)


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, size, percent):
    rows = rows_of(5, 350)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(with_clashes(spark, rows), size, percent).collect()}
    assert got == brute.near(rows, size, percent)


def test_near_duplicates_of_odd_rows(spark):
    text = " ".join(f"t{k}" for k in range(40))
    rows = [(7, text), (7, text), (3, text + " end"), (None, text), (9, "other words here that stand alone"), (7, "a second text of this very number")]
    rows += [(12, "a second text of this very number")]
    got = sorted(((r["doc_id"] or -1, r["component_id"]) for r in ngram_join.near_duplicates(with_clashes(spark, rows)).collect()), key=repr)
    assert got == sorted([(7, 3), (7, 3), (3, 3), (-1, None), (9, 9), (7, 3), (12, 3)], key=repr)
    kept = ngram_join.one_of_each(with_clashes(spark, rows))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "9", "None"] and kept.columns == ["doc_id", "text", "rep", "prefix"]
    assert ngram_join.near_duplicates(with_clashes(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("members", [1 << 18, 300])
def test_links_within_groups_are_counted(spark, monkeypatch, members):
    monkeypatch.setattr(ngram_join, "TILE_MEMBERS", members)
    rng = random.Random(5)
    rows = []
    for group in range(3):
        base = [f"g{group}w{i}" for i in range(70)]
        for k in range(14 if group else 2):
            words = list(base)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(70)] = f"x{rng.randrange(20)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows), rows[20][1]), (len(rows) + 1, "alone here"), (len(rows) + 2, None)]
    sets = {i: frozenset(tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)) for i, t in rows if t}
    sets[len(rows) - 2] = frozenset({("alone", "here")})

    def links(i):
        return len({s for s in sets.values() if s != sets[i] and 100 * len(s & sets[i]) >= 85 * len(s | sets[i])}) if i in sets else 0

    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)
    assert {r["doc_id"]: r["n_links"] for r in got.collect()} == {i: links(i) for i, _ in rows}


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (501, 500), (600, 600)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {**{k: 0 for k in range(201)}, 500: 500, 501: 500}


def test_lines_against_brute_force(spark):
    rng = random.Random(8)
    lines = list(family(rng, 500)) + ["  ", "", "short one", "short one"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 7)))) for i in range(150)] + [(150, None), (151, ""), (152, "\n\n"), (153, "long line " * 4000)]
    want = brute.lines_kept(rows)
    docs = with_clashes(spark, rows)
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_lines"]) for r in line_dedup.line_report(docs).collect()}
    assert got == {i: (n, n - len(k), ",".join(map(str, k))) for i, (n, k) in want.items()}
    clean = line_dedup.without_repeats(docs)
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert clean.columns == docs.columns
    for i, t in rows:
        n, kept = want[i]
        if n and not kept:
            assert i not in texts
        else:
            stay = [x for k, x in enumerate((t or "").split("\n")) if k in kept or not x.strip()]
            assert texts[i] == (None if t is None else "\n".join(stay)), i


def test_near_lines_meet_once_a_run_of_keys(spark, monkeypatch):
    rng, made, real = random.Random(4), [], line_dedup.stored
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        words = list(base)
        for k in rng.sample(range(150), rng.choice((1, 2, 2))):
            words[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))

    def joined(plan):
        below = plan.children()
        own = plan.metrics().get("numOutputRows").get().value() if "Join" in plan.nodeName() and "first" in plan.simpleString(1000) else 0
        return max([own] + [joined(below.apply(k)) for k in range(below.size())])

    def noted(df, name):
        if name == "line-pairs":
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            n = len(df.collect())
            made.append((n, joined(df._jdf.queryExecution().executedPlan())))
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        return real(df, name)

    monkeypatch.setattr(line_dedup, "stored", noted)
    got = {r["doc_id"]: r["kept_lines"] for r in line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: ",".join(map(str, k)) for i, (_, k) in brute.lines_kept(rows).items()}
    pairs, most = made[-1]
    assert len(made) == 2 and 0 < pairs <= most <= 5 * pairs, made


def test_only_lines_that_share_keys_are_parted(spark, monkeypatch):
    rng, parted, real = random.Random(6), [], line_dedup._sets
    rows = [(i, " ".join(f"{rng.choice('abxyz')}{rng.randrange(10**6)}" for _ in range(30))) for i in range(200)]
    rows += [(200 + i, rows[i][1] + " more") for i in range(3)] + [(300 + i, rows[i][1]) for i in range(10, 30)]

    def noted(lines, keep):
        parted.append(lines.count())
        return real(lines, keep)

    monkeypatch.setattr(line_dedup, "_sets", noted)
    got = {r["doc_id"]: r["kept_lines"] for r in line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: "0" if i < 200 else "" for i, _ in rows}
    assert sum(parted) <= 12, parted


def test_lines_of_odd_shapes(spark):
    rng, lines = random.Random(12), []
    for first in ("a", "c", "ac", "\u00e9\u4e16", "At"):  # all, none and some of the shingles come first in the order of the first filter
        for n in (5, 6, 9, 12, 25, 40):
            base = [f"{rng.choice(first)}{rng.randrange(10**6)}" for _ in range(n)]
            lines.append(base)
            lines += [base[:k] for k in (n - 1, n - n // 10 - 1)] + [base + ["more"] * k for k in (1, n // 8)] + [base[1:]]
            for _ in range(3):
                near = list(base)
                near[rng.choice((0, n - 1, rng.randrange(n)))] = "other"
                lines.append(near)
    lines += [["a", "b", "c", "d", "e"] * k for k in range(1, 6)] + [["x"] * k for k in range(1, 9)] + [["b", "a"] * k for k in range(1, 9)]
    shapes = (" ", "  ", "\t", " \r", "\x0b ", "\f")
    texts = [rng.choice(("", " ", "\t")) + "".join(w + (rng.choice(shapes) if k % 2 else " ") for w in words) for k, words in enumerate(lines)]
    rng.shuffle(texts)
    rows = [(i, "\n".join(rng.choice(texts) for _ in range(rng.randint(1, 4)))) for i in range(40)] + [(100 + i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: (r["n_lines"], r["kept_lines"]) for r in line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (n, ",".join(map(str, k))) for i, (n, k) in brute.lines_kept(rows).items()}


def test_lines_of_odd_rows(spark):
    text = "this line has a few words in it\nand a second line stands below it"
    docs = with_clashes(spark, [(2, text), (2, text), (None, text), (2, "and a second line stands below it")])
    got = sorted((str(r["doc_id"]), r["kept_lines"]) for r in line_dedup.line_report(docs).collect())
    assert got == [("2", ""), ("2", ""), ("2", ""), ("None", "0,1")]
    assert line_dedup.line_report(docs.limit(0)).count() == line_dedup.without_repeats(docs.limit(0)).count() == 0


def test_pages_against_brute_force(spark):
    hosts = ["a.example.org", "example.org", "b.c.example.com", "c.example.com", "x.net", "y.net", "Org", "bad.com"]
    rng = random.Random(2)
    pages = []
    for i in range(200):
        links = "".join(f"<a href='http://{rng.choice(hosts)}/x'>l</a>" for _ in range(rng.randint(0, 3)))
        pages.append((i, f"https://{rng.choice(hosts)}/{rng.choice(['en/1', 'en/2', 'de/', 'fr/', 'es/', ''])}{rng.choice(['', '?q=/de/', '#x', '7.html'])}", links))
    pages += [(900, None, None), (901, "no host", ""), (902, "http://", None), (903, "a://b.org?x://y/z", "<a href='//bad.com'>"), (0, pages[0][1], None)]
    got = url_graph.judged(spark.createDataFrame(pages, "page_id long, url string, html string"), url_graph.RULES).collect()
    want = brute.urls(pages, url_graph.RULES, url_graph.LINK)
    assert len(got) == len(pages) and {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == want
    assert {v for _, _, r, v in want.values() if r is None} == {"allow", "block"}


def test_pages_without_rows_or_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.b/", "<a href=//c.d>")], "page_id long, url string, html string")
    assert url_graph.judged(pages.limit(0), url_graph.RULES).count() == 0
    assert [r["verdict"] for r in url_graph.judged(pages, [], rounds=5).collect()] == ["allow"]


def test_distrust_reaches_hosts_beside_a_blocked_one(spark):
    urls = ["http://bad.site.net/x", "http://new.site.net:80/", "http://one.co.uk/x", "http://two.co.uk/", "http://10.0.0.1/x", "http://9.0.0.1/", "http://good.shop.net/", "http://far.shop.net/"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    rules = [("block", h, "/x") for h in ("site.net", "one.co.uk", "10.0.0.1")] + [("allow", "good.shop.net", "/")]
    got = {r["host"]: r for r in url_graph.judged(pages, rules).collect()}
    assert {h for h, r in got.items() if r["verdict"] == "block"} == {"bad.site.net", "new.site.net:80", "one.co.uk", "10.0.0.1"}
    assert got["new.site.net:80"]["rule"] is None and got["new.site.net:80"]["distrust"] > 0 and got["far.shop.net"]["trust"] > 0
    ties = url_graph.domain_ties(spark.createDataFrame([("a.b.c.de",), ("b.de",)], "host string")).collect()
    assert {(r["src"], r["dst"]) for r in ties} == {(x, y) for p in ("b.c.de", "c.de") for x, y in (("a.b.c.de", p), (p, "a.b.c.de"))}


def test_walks_end_where_nothing_moves(spark):
    n = 34
    links = [(f"h{k}.x", f"h{k + 1}.x", 1.0) for k in range(n)] + [("h0.x", f"s{k}.x", 1.0) for k in range(30)]
    edges = spark.createDataFrame(links, "src string, dst string, n double").checkpoint()
    seeds = spark.createDataFrame([(f"h{n}.x", 0.0, 1.0), ("h0.x", 1.0, 0.0)], "host string, trust double, distrust double")
    once = {r["host"]: r for r in url_graph.propagated(edges, seeds).collect()}
    assert all(math.isclose(once[f"h{n - k}.x"]["distrust"], 0.15 * 0.85**k, rel_tol=1e-6) for k in range(n + 1))
    assert math.isclose(once["s3.x"]["trust"], 0.15 * 0.85 / 31, rel_tol=1e-6)
    dealt = {r["host"]: r for r in url_graph.propagated(edges, seeds, wide=7).collect()}
    assert once.keys() == dealt.keys() and all(math.isclose(once[h][c], dealt[h][c], abs_tol=1e-12) for h in once for c in ("trust", "distrust"))


def test_language_model(spark):
    rows = [(i, t and t.replace("w", "The ")) for i, t in rows_of(4, 120)] + [(1000, "日本語 İx " + "y" * 300), (1001, "\u00e9t\u00e9 \U0001f642")]
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    once = {r["doc_id"]: r for r in lattice_lm.scores(docs, path).collect()}
    for i, (held, n, known, train, base) in brute.unigram(rows).items():
        r = once[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, train)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0 and math.isfinite(r["score"])
    assert lattice_lm.scores(docs.limit(0), path).count() == 0
    twice = spark.createDataFrame([*rows[:3], rows[0], (None, "a b")], "doc_id long, text string")
    assert lattice_lm.scores(twice, path).count() == 5


def test_chunks_are_stored_in_small_rows(spark):
    """A row is one document or a slice of words, however large the chunk."""
    docs = spark.range(40, numPartitions=2).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(id * 100, id * 100 + 149), x -> concat('w', x))) AS text")
    got = lattice_lm.chunks(docs).collect()
    told = [r for r in got if r["places"] is not None]
    assert sorted(r["doc_id"] for r in told) == list(range(40)) and {len(r["places"]) for r in told} == {150}
    listed = [r for r in got if r["words"] is not None]
    assert len(told) + len(listed) == len(got) and max(len(r["words"]) for r in listed) == lattice_lm.SLICE
    for part in {r["chunk"] for r in listed}:
        words = [w for r in sorted((r for r in listed if r["chunk"] == part), key=lambda r: r["first"]) for w in r["words"]]
        assert len(words) == len(set(words)) == 2050


def test_the_lattice_sums_all_segmentations():
    pieces = lattice_lm.Pieces(b"")
    weights = {"▁": 0.1, "a": 0.2, "b": 0.15, "▁a": 0.05, "ab": 0.1, "▁ab": 0.02, "<0xC3>": 0.01, "<0xA9>": 0.02}
    pieces.log = {k: math.log(v) for k, v in weights.items()}

    def total(s):
        if not s:
            return 1.0
        spelled = math.prod(weights[f"<0x{b:02X}>"] for b in s[0].encode()) * total(s[1:]) if s[0] not in weights else 0.0
        return spelled + sum(w * total(s[len(p) :]) for p, w in weights.items() if s.startswith(p))

    for word in ("", "a", "ab", "abab", "aéb"):
        assert math.isclose(math.exp(pieces.marginal(word)), total("▁" + word), rel_tol=1e-12)


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(6)
    item = " ".join(f"bench{k}" for k in range(14))
    docs = []
    for i in range(60):
        words = [f"v{rng.randint(0, 4000)}" for _ in range(60)]
        lines = [" ".join(words[k : k + 20]) for k in (0, 20, 40)]
        docs.append((i, "\n".join([*lines, "All of these rights are reserved by us"]), "en", f"s{i % 3}", 0))
    docs.append((100, docs[5][1], "en", "s0", 0))
    docs.append((101, docs[6][1].replace("\n", " x\n", 1), "en", "s0", 0))
    docs.append((102, docs[7][1].split("\n")[0] + " " + item + " " + " ".join(f"n{k}" for k in range(40)), "en", "s1", 0))
    docs += [(103, "too short", "en", "s1", 0), (104, None, None, None, None), (105, "again and again it goes " * 12, "de", "s2", 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    state = {i: t for i, t, *_ in docs}
    now = frame
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        before, now = state, spark.read.parquet(f"{tmp_path}/{name}")
        state = {r["doc_id"]: r["text"] for r in now.collect()}
        if name == "quality_rules":
            assert state == {i: t for i, t in before.items() if not brute.quality(t)[5]}
        elif name == "line_dedup":
            kept = brute.lines_kept(list(before.items()))
            assert state == {i: "\n".join(t.split("\n")[k] for k in kept[i][1]) for i, t in before.items() if kept[i][1]}
        elif name == "ngram_join":
            assert state == {i: t for i, t in before.items() if brute.near(list(before.items()), 5, 80)[i][1] == i}
        elif name == "decontamination":
            assert set(state) == set(before) and not any("bench3" in t for t in state.values())
            assert all(state[i] == t for i, t in before.items() if "bench" not in t)
            assert all(r["n_chars"] == len(r["text"]) for r in now.collect())
        assert name == "bpe" or now.columns == frame.columns
    assert 100 not in state and 103 not in state and 104 not in state and 105 not in state and 102 in state
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_join", "decontamination", "bpe"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(state)
