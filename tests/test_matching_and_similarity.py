import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliowire.functions import text
from foliowire.operators import matching, relevance, similarity

ASSETS = "portfolio_id string, pos bigint, ticker string, name string, aliases array<string>, sector string, country string"


@pytest.fixture()
def assets(rows):
    return rows([
        ("P", 0, "AAPL", "Apple Inc.", ["iPhone maker"], "Technology", "US"),
        ("P", 1, "SAN.MC", "Banco Santander, S.A.", ["Santander"], "Banca", "Spain"),
        ("P", 2, "BBVA", "Banco Bilbao Vizcaya", [], "Banca", "Spain"),
        ("Q", 0, "MSFT", "Microsoft Corporation", [], None, ""),
    ], ASSETS)


def tickers(rows, assets, text):
    docs = rows([(1, text)], "news_id int, text string")
    found = matching.resolve(matching.mentions(docs, matching.entity_keys(assets)))
    return {(r["portfolio_id"], r["ticker"]): r["score"] for r in found.collect()}


def test_mentions_follow_word_boundaries(rows, assets):
    assert tickers(rows, assets, "APPLE rises") == {("P", "AAPL"): 0.95}
    assert tickers(rows, assets, "pineapple juice") == {}
    assert tickers(rows, assets, "New from the iPhone-maker!") == {("P", "AAPL"): 0.9}
    assert tickers(rows, assets, "Santander and BBVA") == {("P", "SAN.MC"): 0.9, ("P", "BBVA"): 0.95}
    assert tickers(rows, assets, "banco") == {}  # the root of two assets
    assert tickers(rows, assets, "Microsoft") == {("Q", "MSFT"): 0.95}
    assert tickers(rows, assets.limit(0), "Microsoft") == {}


def test_dotted_ticker(rows, assets):
    docs = rows([(1, "buy SAN.MC now")], "news_id int, text string")
    plain = matching.mentions(docs, matching.entity_keys(assets)).count()
    fixed = matching.mentions(docs, matching.entity_keys(assets, fix_dotted=True)).select("ticker").collect()
    assert plain == 0 and [r[0] for r in fixed] == ["SAN.MC"]


def test_rule_relevance_flags(rows, assets):
    docs = rows([(1, "the technology sector in spain"), (2, "business as usual"), (3, "give us peace"), (4, "apple falls")], "news_id int, text string")
    orgs = rows([(4, ["Banco Santander"]), (2, [])], "news_id int, orgs array<string>")
    got = {(r["news_id"], r["portfolio_id"]): r for r in matching.rule_relevance(docs, orgs, assets).collect()}
    assert set(got) == {(1, "P"), (3, "P"), (4, "P")}
    assert got[(1, "P")]["sector_match"] and got[(1, "P")]["country_match"] and got[(1, "P")]["direct_score"] == 0.5
    assert got[(3, "P")]["direct_score"] == 0.3  # the country code as a whole word
    assert got[(4, "P")]["matched_assets"] == ["AAPL", "SAN.MC"] and got[(4, "P")]["direct_score"] == 0.95


def test_substring_join_equals_search_in_every_text(rows):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abç", k=rng.randint(1, 5))) for _ in range(30)) for _ in range(40)] + ["a\tb  ab", "", "A b"]
    words = {"".join(rng.choices("abç", k=rng.randint(1, 6))) for _ in range(60)} | {"a b", "b ab", "ça a", "aaaaaaaaaaaa b", " a"}
    found = matching.substring_mentions(rows(list(enumerate(texts)), "news_id int, text string"), rows([(w,) for w in words], "term string"),
                                        "news_id", "text", F.length("term") <= 2)
    expected = {(i, w) for i, t in enumerate(texts) for w in words if w in t.lower() and (len(w) > 2 or re.search(rf"\b{re.escape(w)}\b", t.lower()))}
    assert {tuple(r) for r in found.collect()} == expected


def test_scan_and_joins_give_the_same_rows(rows, assets, monkeypatch):
    """Above the limit of terms the joins take over, with the same result."""
    rng = random.Random(9)
    pieces = ["Apple", "apple inc", "iPhone-maker", "Banco", "Santander", "BBVA", "us", "bus", "US.", "spain", "Españá", "technology", "banca", "x", "pine", "Microsoft"]
    docs = rows([(i, " ".join(rng.choices(pieces, k=12))) for i in range(60)] + [(100, None), (101, ""), (102, "ÀPPLE İPHONE ﬁn")], "news_id int, text string")
    orgs = docs.select("news_id", F.array("text").alias("orgs")).where("news_id % 3 = 0 and text is not null")
    scanned = {tuple(map(str, r)) for r in matching.rule_relevance(docs, orgs, assets).collect()}
    found = {tuple(r) for r in matching.mentions(docs, matching.entity_keys(assets)).collect()}
    monkeypatch.setattr(matching.textscan, "TERM_LIMIT", 2)
    assert {tuple(map(str, r)) for r in matching.rule_relevance(docs, orgs, assets).collect()} == scanned
    assert {tuple(r) for r in matching.mentions(docs, matching.entity_keys(assets)).collect()} == found
    assert len(scanned) > 20


def test_watch_terms_are_made_once_for_many_batches(rows, assets):
    watch = matching.WatchTerms(assets)
    texts = [(1, "the technology sector in spain"), (2, "apple falls"), (3, "give us peace")]
    schema, orgs = "news_id int, text string", rows([], "news_id int, orgs array<string>")
    whole = {tuple(map(str, r)) for r in matching.rule_relevance(rows(texts, schema), orgs, assets).collect()}
    parts = [r for t in texts for r in matching.rule_relevance(rows([t], schema), orgs, watch).collect()]
    assert {tuple(map(str, r)) for r in parts} == whole and len(whole) == 3


def test_texts_are_scanned_once_without_a_shuffle_of_them(rows, assets):
    docs = rows([(1, "apple")], "news_id int, text string")
    orgs = rows([], "news_id int, orgs array<string>")
    plan = matching.rule_relevance(docs, orgs, assets)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2  # texts and organisation names
    exchanged = [line for line in matching.rule_relevance(docs, orgs, assets)._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in line]
    assert exchanged and not any("text" in line for line in exchanged)


@pytest.mark.parametrize("how", [0, 1, 2])
def test_searcher_equals_plain_search(how):
    rng = random.Random(how)
    terms = ["".join(rng.choices("ab é_.", k=rng.randint(1, 4))) for _ in range(80)] + ["a", "ab", "b a"]
    searcher = matching.textscan.Searcher([(how, t) for t in terms])
    for _ in range(150):
        text = "".join(rng.choices("ab É_.Á-", k=rng.randint(0, 25)))
        low = text.lower()
        body = matching.textscan.comparable(low, searcher.fold)
        tests = {0: lambda t: f" {t} " in body, 1: lambda t: t in low, 2: lambda t: re.search(rf"\b{re.escape(t)}\b", low)}
        assert searcher.found(text) == [n for n, t in enumerate(terms) if t.strip() and tests[how](t)]


def vectors(rng, n, dim=8, copies=0):
    base = rng.normal(size=(n, dim))
    clustered = base[rng.integers(0, max(1, n // 4), n)] + 0.3 * rng.normal(size=(n, dim))
    out = [list(map(float, v)) for v in clustered]
    return out + [out[0]] * copies


def table(rows, vecs, scope=lambda i: 0):
    return rows([(i, scope(i), v) for i, v in enumerate(vecs)], "id bigint, scope int, vector array<double>")


def unit(vecs):
    m = np.array(vecs)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.mark.parametrize("threshold, history", [(0.9, 16), (0.5, 7), (-0.2, 500)])
def test_similar_pairs_equal_brute_force(rows, threshold, history):
    vecs = vectors(np.random.default_rng(5), 120, copies=30)
    got = {(r["earlier_id"], r["later_id"]) for r in similarity.similar_pairs(
        table(rows, vecs, lambda i: i % 2), ["scope"], ["id"], "id", threshold, history).collect()}
    sims, expected = unit(vecs) @ unit(vecs).T, set()
    for scope in (0, 1):
        firsts = []
        for i in range(scope, len(vecs), 2):
            copy = next((j for j in firsts if vecs[j] == vecs[i]), None)
            if copy is not None:
                expected.add((copy, i))
            else:
                expected |= {(j, i) for j in firsts[-history:] if sims[i, j] >= threshold}
                firsts.append(i)
    assert got == expected


def test_earlier_similarity_with_a_hot_scope(rows):
    vecs = vectors(np.random.default_rng(1), 90, copies=40)
    def scope(i):
        return 0 if i % 3 else i % 2

    got = {r["id"]: (r["max_similarity"], r["is_duplicate"]) for r in
           similarity.earlier_similarity(table(rows, vecs, scope), ["scope"], ["id"], "id", 0.95, history=10).collect()}
    u = unit(vecs)
    for i in range(len(vecs)):
        before = [j for j in range(i) if scope(j) == scope(i)][-10:]
        best = max([float(u[i] @ u[j]) for j in before] + [0.0])
        assert got[i][0] == pytest.approx(best, abs=1e-9) and got[i][1] == (best >= 0.95)


def test_positions_are_dense_in_a_hot_scope(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("scope"), F.lit(1).alias("ts"))
    placed = similarity.with_position(df.repartition(7), ["scope"], ["ts", "k"]).toPandas().sort_values(["scope", "k"])
    for _, group in placed.groupby("scope"):
        assert list(group["position"]) == list(range(len(group)))


def greedy(vecs, threshold, store):
    u, kept, flags = unit(vecs), [], []
    for i in range(len(vecs)):
        dup = any(float(u[i] @ u[j]) >= threshold for j in kept[-store:])
        flags.append(dup)
        if not dup:
            kept.append(i)
    return flags


@pytest.mark.parametrize("threshold, store", [(0.9, 500), (0.6, 500), (0.9, 5)])
def test_greedy_duplicates_equal_sequential_scan(rows, threshold, store):
    vecs = vectors(np.random.default_rng(9), 80, copies=50)
    flagged = similarity.greedy_duplicates(table(rows, vecs), ["scope"], ["id"], "id", threshold, store=store, memory=3).collect()
    assert len(flagged) == len(vecs)
    assert {r["id"]: r["is_duplicate"] for r in flagged} == dict(enumerate(greedy(vecs, threshold, store)))


def test_greedy_filter_state_is_bounded():
    u = unit(vectors(np.random.default_rng(2), 210))
    sims, dup, kept, at = similarity.greedy_filter(np.zeros((0, 8)), np.zeros(0), u, np.arange(210.0), 0.999999, store=50, memory=20, ttl=None)
    assert not dup[0] and sims[0] == 0.0 and len(kept) <= 50 and len(at) == len(kept)
    again, flags, _, _ = similarity.greedy_filter(u[:1], np.zeros(1), u[:1], np.array([100.0]), 0.9, 50, 20, ttl=10.0)
    assert not flags[0] and again[0] == 0.0  # the only match has expired


def test_semantic_relevance_blocks_agree(rows, monkeypatch):
    rng = np.random.default_rng(4)
    news = rows([(i, list(map(float, v))) for i, v in enumerate(rng.normal(size=(25, 6)))] + [(99, [0.0] * 6)], "news_id int, vector array<double>")
    held = rows([(f"P{i % 3}", f"T{i}", i, list(map(float, v))) for i, v in enumerate(rng.normal(size=(20, 6)))],
                "portfolio_id string, ticker string, pos int, vector array<double>")
    def result():
        return sorted((r["news_id"], r["portfolio_id"], round(r["semantic_score"], 9), round(r["semantic_mean_score"], 9), r["best_asset"])
                      for r in relevance.semantic_relevance(news, held, minimum=None).collect())

    whole = result()
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 4)
    parts = result()
    assert len(whole) == 26 * 3
    assert [w for w in whole if w[0] != 99] == [p for p in parts if p[0] != 99]
    assert all(w[2] == 0.0 for w in whole if w[0] == 99)
    gated = {(r["news_id"], r["portfolio_id"]) for r in relevance.semantic_relevance(news, held).collect()}
    assert gated == {w[:2] for w in whole if w[2] >= 0.3}


def test_blend(spark):
    def score(d, s):
        return spark.range(1).select(relevance.blend(F.lit(d), F.lit(s))).first()[0]

    assert score(0.95, 0.5) == pytest.approx(0.815) and score(0.5, 0.6) == pytest.approx(0.55) and score(0.0, 0.5) == pytest.approx(0.35)


def test_bit_set_never_drops_a_member(spark, rows):
    members = rows([(f"key{i}",) for i in range(300)], "k string")
    holds = matching._bit_set(members)
    assert members.where(holds(F.col("k"))).count() == 300
    others = spark.range(5000).select(F.concat(F.lit("other"), "id").alias("k"))
    assert others.where(holds(F.col("k"))).count() < 100


def clustered(seed, n, dim=24, per=40, spread=0.15):
    """Vectors around n / per random directions, some copies and one without length."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // per), dim))
    vecs = centres[rng.integers(0, len(centres), n)] + spread * rng.normal(size=(n, dim))
    vecs[: n // 20] = vecs[0]
    vecs[-1] = 0
    return [list(map(float, v)) for v in vecs], centres


ASSET_VECTORS = "portfolio_id string, ticker string, pos bigint, vector array<double>"


@pytest.mark.parametrize("minimum", [0.3, 0.8])
def test_pruned_relevance_equals_all_pairs(rows, monkeypatch, minimum):
    monkeypatch.setattr(similarity, "BALL_ROWS", 8)
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 16)  # the ball of the copies has several parts
    held, centres = clustered(1, 400)
    news = rows([(i, v) for i, v in enumerate(clustered(1, 120)[0])], "news_id bigint, vector array<double>")
    assets = rows([(f"P{i % 23}", f"T{i % 7}", i // 23 % 5, v) for i, v in enumerate(held)], ASSET_VECTORS)
    def plain(df):
        return {(r["news_id"], r["portfolio_id"]): (r["semantic_score"], r["semantic_mean_score"], r["best_asset"]) for r in df.collect()}

    every = relevance.semantic_relevance(news, assets, minimum=None)
    # ties of score between copies go to the first by position and ticker; products of copies may differ in their last digits
    sims = {}
    for r in news.crossJoin(assets.withColumnRenamed("vector", "a")).collect():
        u, a = np.array(r["vector"]), np.array(r["a"])
        size = np.linalg.norm(u) * np.linalg.norm(a)
        sims.setdefault((r["news_id"], r["portfolio_id"]), []).append((-round(float(u @ a / size) if size else 0.0, 10), r["pos"], r["ticker"]))
    expected = {k: (v[0], v[1], min(sims[k])[2]) for k, v in plain(every).items() if v[0] >= minimum}
    got = plain(relevance.semantic_relevance(news, assets, minimum=minimum))
    assert got.keys() == expected.keys() and len(expected) > 100
    assert all(got[k][:2] == pytest.approx(expected[k][:2], abs=1e-9) and got[k][2] == expected[k][2] for k in got)


def test_pruned_pairs_equal_all_pairs(rows, monkeypatch):
    monkeypatch.setattr(similarity, "BALL_ROWS", 8)
    left, right = clustered(1, 150)[0], clustered(1, 300)[0]
    a = rows(list(enumerate(left)), "x bigint, vector array<double>")
    b = rows(list(enumerate(right)), "y bigint, vector array<double>")
    got = {(r["x"], r["y"]) for r in similarity.cross_similar(a, b, "x", "y", 0.7).collect()}
    def units(v):
        m = np.array(v)
        length = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, length, out=np.zeros_like(m), where=length > 0)

    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(units(left) @ units(right).T >= 0.7)))) and got
    assert similarity.cross_similar(a.limit(0), b, "x", "y", 0.7).count() == 0 == similarity.cross_similar(a, b.limit(0), "x", "y", 0.7).count()


def test_pairs_compared_grow_slower_than_the_assets(spark, rows, monkeypatch):
    """With more assets of the same kind of neighbourhoods, a news item meets about as many of them as before."""
    monkeypatch.setattr(similarity, "BALL_ROWS", 10)
    news = similarity.Balls(rows(list(enumerate(clustered(5, 200)[0])), "x bigint, vector array<double>"), "x")
    shares = []
    for n in (500, 1000, 2000):
        assets = similarity.Balls(rows(list(enumerate(clustered(5, n)[0])), "y bigint, vector array<double>"), "y")
        pairs = similarity.ball_pairs(spark, news, assets, 0.8).agg(F.sum("pairs")).first()[0]
        shares.append(pairs / (200 * n))
    assert shares[2] < 0.6 * shares[0] and shares[0] < 0.5, shares


def test_near_copies_equal_all_pairs(rows, monkeypatch):
    """Every pair is found, however far apart it stands and however crowded its neighbourhood."""
    monkeypatch.setattr(similarity, "BALL_ROWS", 8)
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 16)
    vecs = clustered(3, 700)[0]
    got = similarity.near_copies(rows(list(enumerate(vecs)), "id bigint, vector array<double>"), "id", 0.9).collect()
    first = {}
    for i, v in enumerate(vecs):
        first.setdefault(tuple(v), i)
    keep = sorted(first.values())
    m = np.array([vecs[i] for i in keep])
    length = np.linalg.norm(m, axis=1, keepdims=True)
    unit_ = np.divide(m, length, out=np.zeros_like(m), where=length > 0)
    a, b = np.nonzero(np.triu(unit_ @ unit_.T, 1) >= 0.9)
    expected = {(keep[i], keep[j]) for i, j in zip(a, b)} | {(first[tuple(v)], i) for i, v in enumerate(vecs) if first[tuple(v)] != i}
    assert {(r["earlier_id"], r["later_id"]) for r in got} == expected and len(got) == len(expected) > 1000



def test_near_copies_send_a_row_a_bounded_number_of_times():
    """What is sent for the comparison grows with the rows; before, a row went to every block of a fixed size."""
    sent = []
    for balls in (100, 400, 1600):
        pivots = unit(np.random.default_rng(0).normal(size=(balls, 8)))
        table = type("Table", (), {"pivots": pivots, "radius": np.full(balls, 2.0), "rows_in": np.full(balls, 1024)})()
        sides = similarity.Sides(table, 0.5)
        rows_of = np.zeros(sides.meetings["_side"].max() + 1)
        np.add.at(rows_of, sides.first, 1024)
        sent.append((rows_of[sides.meetings["_side"]]).sum() / (1024 * balls))
    assert max(sent) <= 2 * similarity.MOST_SIDES and sent[2] < 1.3 * sent[0], sent


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def watched(rows):
    assets = rows([("W1", 1, "ACME", "Acme Works Inc.", ["Big Acme"], "energy", "spain")],
                  "portfolio_id string, pos int, ticker string, name string, aliases array<string>, sector string, country string")
    news = rows([(1, "The Acme  Works of Spain", "web"), (2, "nothing here", "web")], "news_id bigint, text string, source string")
    return assets, news.withColumn("orgs", text.mined_organisations("text", None, squeezed=True))


def test_names_are_mined_once_a_text(rows):
    """The names were mined twice, for a filter and for the search, from texts whose white space was collapsed first."""
    assets, news = watched(rows)
    found = matching.rule_relevance(news.select("news_id", "text"), news.select("news_id", "orgs"), assets)
    assert plan_of(found).count("regexp_extract_all(") == 1
    assert [(r["news_id"], r["matched_assets"], r["country_match"]) for r in found.collect()] == [(1, ["ACME"], True)]
    odd = rows([("Goldman \n Sachs and\u00a0Morgan\u2003Stanley aBig Bank",)], "t string")
    squeezed = F.regexp_replace("t", f"[{text.SPACE}]+", " ")
    assert odd.select(text.mined_organisations("t", None, squeezed=True)).first() == odd.select(text.mined_organisations(squeezed, None)).first() == (["Goldman Sachs", "Morgan Stanley"],)


def test_gated_hybrid_searches_the_texts_once(rows):
    assets, news = watched(rows)
    rules = matching.rule_relevance(news.select("news_id", "text"), news.select("news_id", "orgs"), assets)
    vectors = rows([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "news_id bigint, vector array<double>")
    held = rows([("W1", "ACME", 1, [1.0, 0.1])], "portfolio_id string, ticker string, pos int, vector array<double>")
    kept = relevance.gated_hybrid_relevance(vectors, rules, held)
    assert "regexp_extract_all(" not in plan_of(kept) and [(r["news_id"], r["best_asset"]) for r in kept.collect()] == [(1, "ACME")]


def test_variants_search_the_labelled_texts_once(rows):
    from foliowire.operators import variants

    assets, news = watched(rows)
    labelled = rows([(1, "W1")], "news_id bigint, portfolio_id string")
    vectors = rows([(1, [1.0, 0.0])], "news_id bigint, vector array<double>")
    held = rows([("W1", "ACME", 1, [1.0, 0.1])], "portfolio_id string, ticker string, pos int, vector array<double>")
    moods = rows([(1, "positive", 0.9)], "news_id bigint, sentiment string, sentiment_confidence double")
    verdicts = rows([], "news_id bigint, portfolio_id string, is_relevant boolean, relevance_score double, affected_assets array<string>")
    analyses = rows([], "news_id bigint, portfolio_id string, severity double, direction string, confidence double, event_type string, explanation string")
    got = variants.variant_predictions(labelled, news, assets, vectors, held, moods, verdicts, analyses)
    assert "regexp_extract_all(" not in plan_of(got)
    assert {(r["variant"], tuple(r["matched_assets"])) for r in got.collect()} == {(v, ("ACME",)) for v in variants.VARIANTS}


def test_near_copies_of_no_vectors(rows):
    assert similarity.near_copies(rows([], "id bigint, vector array<float>"), "id", 0.9).count() == 0
