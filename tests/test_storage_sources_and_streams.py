import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliowire.operators import advisor, limiter, scoring_tables, similarity, storage
from foliowire.sources import corpora, feeds
from foliowire.streaming import jobs, state
from foliowire.streaming.daystore import DayStore


def now():
    return F.to_timestamp(F.lit("2024-06-01 00:00:00"))


RSS = """<rss><channel>
<item><title>One &amp; two</title><link>http://x/1</link><pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate><description>d</description></item>
<item><title>No link</title><description>d</description></item>
<item><title>No date</title><link>http://x/3</link></item>
<item><title>Offset</title><link>http://x/4</link><pubDate>Tue, 05 Mar 2024 10:00:00 +0200</pubDate></item></channel></rss>"""


def test_rss_files(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(RSS)
    items = feeds.read_rss(spark, str(tmp_path))
    news = {r["url"]: r for r in feeds.rss_to_news(items, F.lit("desk"), now()).collect()}
    assert set(news) == {"http://x/1", "http://x/3", "http://x/4"}
    assert news["http://x/1"]["title"] == "One & two" and news["http://x/1"]["published_at"] == dt.datetime(2024, 3, 5, 10)
    assert news["http://x/3"]["published_at"] == dt.datetime(2024, 6, 1) and news["http://x/3"]["summary"] == ""
    assert news["http://x/4"]["published_at"] == dt.datetime(2024, 3, 5, 8)
    regulator = feeds.regulator_to_news(items, "hechos", now()).first()
    assert regulator["source"] == "cnmv_hechos" and regulator["language"] == "es"


def test_json_feeds(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"status": "ok", "articles": [
        {"title": "T", "description": None, "url": "u", "publishedAt": "2024-03-05T10:00:00Z", "source": {"name": "S"}},
        {"title": None, "url": "v"}, {"title": "X", "url": ""}, {"title": "Y", "url": "w", "publishedAt": "later"}]}))
    got = {r["url"]: r for r in feeds.articles_to_news(feeds.read_json_documents(spark, str(tmp_path), feeds.ARTICLES), now()).collect()}
    assert set(got) == {"u", "w"} and got["u"]["source"] == "newsapi_S" and got["w"]["source"] == "newsapi_newsapi"
    assert got["u"]["summary"] == "" and got["w"]["published_at"] == dt.datetime(2024, 6, 1)


def test_filings(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"cik": "320193", "name": "Apple", "filings": {"recent": {
        "form": ["10-K", "8-K"], "filingDate": ["2024-01-02"], "accessionNumber": ["00-1-2"], "primaryDocDescription": []}}}))
    payload = feeds.read_json_documents(spark, str(tmp_path), feeds.SUBMISSIONS)
    rows = feeds.company_filings_to_news(payload, now()).collect()
    assert [r["title"] for r in rows] == ["[10-K] Apple", "[8-K] Apple"] and rows[0]["url"].endswith("/0000320193/0012") and rows[1]["url"].endswith("/0000320193/")
    assert rows[0]["published_at"] == dt.datetime(2024, 1, 2) and rows[1]["published_at"] == dt.datetime(2024, 6, 1) and rows[1]["summary"] == ""
    assert feeds.company_filings_to_news(payload, now(), limit=1).count() == 1


def test_corpus_and_prediction_files(spark, rows, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": "1", "labels": {"is_relevant": true, "direction": "alcista"}}\n\n{"id": "2", "labels": {"is_relevant": false}}\n')
    lines = corpora.read_lines(spark, str(tmp_path / "c.jsonl"))
    assert [(r["id"], r["labels"]["is_relevant"]) for r in corpora.parse_corpus(lines).collect()] == [("1", True), ("2", False)]
    long = corpora.annotations_long(corpora.parse_annotations(lines), "a").where("dimension = 'direction'").collect()
    assert [(r["item_id"], r["label"]) for r in long] == [("1", "alcista"), ("2", None)]
    (tmp_path / "p.json").write_text(json.dumps([{"portfolio_id": "P", "name": "n", "assets": [{"ticker": "A", "weight": 0.5}, {"ticker": "B"}]}]))
    flat = corpora.flatten_portfolios(corpora.read_portfolios(spark, str(tmp_path / "p.json"))).collect()
    assert [(r["pos"], r["ticker"], r["weight"]) for r in flat] == [(0, "A", 0.5), (1, "B", None)]
    corpora.write_predictions(rows([(1, "full"), (2, "rules")], "id int, variant string"), str(tmp_path / "out"))
    assert corpora.read_predictions(spark, str(tmp_path / "out"), "id int, variant string").where("variant = 'full'").first()["id"] == 1


def test_insert_if_absent_keeps_the_first(rows):
    batch = rows([("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z"), ("c", 4, "w")], "url string, id int, source string")
    store = rows([("b",), ("b",)], "url string")
    got = {r["url"]: r["source"] for r in storage.insert_if_absent(batch, store, "url", ["id"]).collect()}
    assert got == {"a": "y", "c": "w"}
    stats = {r["source"]: (r["saved"], r["duplicates"]) for r in storage.ingest_statistics(batch, store, "url", ["id"], "source").collect()}
    assert stats == {"x": (0, 1), "y": (1, 0), "z": (0, 1), "w": (1, 0)}


def test_upserts(rows):
    votes = rows([(1, 1, True, "good", dt.datetime(2024, 1, 1), 1), (1, 1, False, "bad", dt.datetime(2024, 1, 2), 2)],
                 "alert_id int, user_id int, useful boolean, comment string, voted_at timestamp, vote_id int")
    r = storage.upsert_feedback(votes).first()
    assert (r["useful"], r["comment"], r["created_at"], r["updated_at"]) == (False, "bad", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2))


def test_upsert_rewrites_only_touched_buckets(spark, rows, tmp_path):
    path, ddl = str(tmp_path / "t"), "k int, at int, v string"
    def combine(df):
        return storage.latest_per_key(df, ["k"], ["at"]).select("k", "at", "v")

    storage.upsert(rows([(k, 1, "old") for k in range(200)], ddl), path, ["k"], combine, buckets=16)
    before = {str(f) for f in (tmp_path / "t").rglob("*.parquet")}
    storage.upsert(rows([(3, 2, "new"), (3, 0, "late"), (900, 1, "added")], ddl), path, ["k"], combine, buckets=16)
    after = {str(f) for f in (tmp_path / "t").rglob("*.parquet")}
    got = {r["k"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert got == {k: "old" for k in range(200)} | {3: "new", 900: "added"}
    assert len(before & after) >= 14


def _latest(df):
    return storage.latest_per_key(df, ["k"], ["at"]).select("k", "at", "v")


VERSIONED = "k int, at int, v string"


def test_merged_versions_rewrite_only_touched_buckets_and_grow(spark, rows, tmp_path):
    path, schema = str(tmp_path / "t"), rows([], VERSIONED).schema
    merge = lambda data: storage.merge_version(rows(data, VERSIONED), path, ["k"], _latest, rows_per_bucket=20)
    held = lambda: {r["k"]: r["v"] for r in storage.current_rows(spark, path, schema).collect()}
    assert merge([]) == 0 and held() == {}
    assert merge([(k, 1, "old") for k in range(200)] + [(None, 1, "no key")]) == 1
    before = {str(f) for f in (tmp_path / "t" / "rows").rglob("*.parquet")}
    assert merge([(3, 2, "new"), (3, 0, "late"), (900, 1, "added"), (None, 2, "still none")]) == 2
    added = {f for f in (tmp_path / "t" / "rows").rglob("*.parquet") if str(f) not in before}
    assert {f.parent.parent.name for f in added} == {"version=2"} and len({f.parent.name for f in added}) <= 3
    expected = {k: "old" for k in range(200)} | {3: "new", 900: "added", None: "still none"}
    assert held() == expected
    assert merge([]) == 2
    merge([(k, 1, "more") for k in range(1000, 1300)])  # the stored rows outgrow the buckets
    merge([(5, 9, "after")])
    assert held() == expected | {k: "more" for k in range(1000, 1300)} | {5: "after"}
    commit = storage._last_commit(spark, path)
    assert len(commit.folders) == 32 and sum(commit.sizes) == 502 and set(commit.folders) == {4}
    assert merge([(5, 10, "last")]) == 5 and sorted(set(storage._last_commit(spark, path).folders)) == [4, 5]


def test_a_merge_that_dies_leaves_the_table_as_it_was(spark, rows, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "t"), rows([], VERSIONED).schema
    held = lambda: {r["k"]: r["v"] for r in storage.current_rows(spark, path, schema).collect()}
    storage.merge_version(rows([(1, 1, "a"), (2, 1, "b")], VERSIONED), path, ["k"], _latest)
    batch = rows([(1, 2, "changed"), (3, 1, "c")], VERSIONED)

    def lost(df):
        return _latest(df).withColumn("v", F.when(F.col("k") == 3, F.raise_error(F.lit("executor lost"))).otherwise(F.col("v")))

    with pytest.raises(Exception, match="executor lost"):
        storage.merge_version(batch, path, ["k"], lost)
    assert held() == {1: "a", 2: "b"}

    def dies(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as patch:
        patch.setattr(storage, "_write_commit", dies)
        with pytest.raises(RuntimeError):
            storage.merge_version(rows([(2, 7, "never committed")], VERSIONED), path, ["k"], _latest)
    assert held() == {1: "a", 2: "b"}
    assert storage.merge_version(batch, path, ["k"], _latest) == 2 == storage.merge_version(rows([], VERSIONED), path, ["k"], _latest)
    assert held() == {1: "changed", 2: "b", 3: "c"}


def test_append_and_purge(spark, rows, tmp_path):
    path, ddl = str(tmp_path / "news"), "url string, id int"
    rows([("a", 1)], ddl).write.parquet(path)
    storage.append_absent(rows([("a", 2), ("b", 4), ("b", 3)], ddl), path, "url", ["id"])
    assert sorted((r["url"], r["id"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]
    name = f"purged_{tmp_path.name.replace('-', '_')}"
    dated = rows([(k, dt.date(2024, 1, 1 + k)) for k in range(5)], "id int, day date")
    dated.write.partitionBy("day").saveAsTable(name)
    assert storage.purge_before(spark, name, "day", dt.date(2024, 1, 3)) == ["2024-01-01", "2024-01-02"]
    assert sorted(r["id"] for r in spark.table(name).collect()) == [2, 3, 4]
    spark.sql(f"DROP TABLE {name}")


def test_append_alerts_partitions_by_day(spark, rows, tmp_path):
    alerts = rows([(1, False, dt.datetime(2024, 1, 1, 5)), (2, True, dt.datetime(2024, 1, 1, 6)), (3, False, dt.datetime(2024, 1, 2))],
                  "id int, is_duplicate boolean, created_at timestamp")
    for _ in range(2):
        storage.append_alerts(alerts, str(tmp_path / "a"))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "a")).collect()) == [1, 1, 3, 3]
    assert (tmp_path / "a" / "created_date=2024-01-02").exists()


def test_edit_assets(rows):
    portfolios = rows([("P", [("A", 0.5), ("B", 0.5)]), ("Q", [("A", 1.0)])], "portfolio_id string, assets array<struct<ticker:string,weight:double>>")
    adds = rows([("P", ("C", 0.1))], "portfolio_id string, asset struct<ticker:string,weight:double>")
    drops = rows([("P", "A")], "portfolio_id string, ticker string")
    got = {r["portfolio_id"]: ([a["ticker"] for a in r["assets"]], r["updated_at"] is not None) for r in
           storage.edit_assets(portfolios, adds, drops, now()).collect()}
    assert got == {"P": (["B", "C"], True), "Q": (["A"], False)}


def test_batch_scorer_builds_once_per_task(spark):
    def make():
        calls = []

        def score(pdf):
            calls.append(1)
            return pdf.assign(n=len(calls))

        return score

    out = scoring_tables.batch_score(spark.range(10).coalesce(1), make, "id bigint, n int").collect()
    assert len(out) == 10 and {r["n"] for r in out} == {1}


# --- Suitability -----------------------------------------------------------------------------------

HOLDING = "portfolio_id string, asset_id bigint, weight double, sector string, country string"


def test_profiles(rows):
    answers = rows([("u", "q1_horizon", "q1_a"), ("u", "q3_loss_reaction", "q3_b"), ("u", "q8_max_loss", "zz"), ("u", "q10_sectors", "q10_a, q10_h,q10_c"),
                    ("v", "q9_esg", "q9_b")], "user_id string, question_id string, option_id string")
    got = {r["user_id"]: r for r in advisor.investor_profiles(answers).collect()}
    assert got["u"]["risk_score"] == round((5 * 1.5 + 25 * 2.0) / 3.5) and got["u"]["risk_profile"] == "muy_conservador"
    assert got["u"]["horizon"] == "corto_plazo" and got["u"]["sector_preferences"] == ["Technology", "Energy"] and got["u"]["loss_tolerance_pct"] == 15.0
    assert got["v"]["risk_score"] == 50 and got["v"]["esg_preference"] and got["v"]["horizon"] == "medio_plazo"


def test_portfolio_analysis(rows):
    held = rows([("P", 1, 0.8, "tech", "usa"), ("P", 2, 0.2, "Energy", "Spain"), ("E", 1, 0.0, None, None), ("E", 2, 0.0, "tech", "usa")], HOLDING)
    profiles = rows([("P", "agresivo"), ("E", "nonsense")], "portfolio_id string, risk_profile string")
    base = advisor.composition(held)
    hhi = {r["portfolio_id"]: r["hhi"] for r in advisor.concentration(base).collect()}
    assert hhi["P"] == pytest.approx(0.68) and hhi["E"] == pytest.approx(0.5)
    sectors = advisor.sector_allocation(base, profiles)
    mine = {r["category"]: (r["current_pct"], r["ideal_pct"], r["diff_pct"], r["status"]) for r in sectors.where("portfolio_id = 'P'").collect()}
    assert mine["Technology"] == (80.0, 30.0, 50.0, "sobreexpuesto") and mine["Healthcare"] == (0.0, 15.0, -15.0, "infraexpuesto")
    equal = {r["category"]: (r["current_pct"], r["ideal_pct"]) for r in sectors.where("portfolio_id = 'E'").collect()}
    assert equal["Technology"] == (50.0, 20.0) and equal["Other"] == (50.0, 5.0)
    score = {r["portfolio_id"]: r["diversification_score"] for r in advisor.diversification(base).collect()}
    assert score["P"] == round(2 / 15 * 30 + 0.32 * 30 + 2 / 6 * 20 + 2 / 4 * 20)
    rules = {(r["portfolio_id"], r["rule"]) for r in advisor.warnings(base, profiles, sectors).collect()}
    assert {("P", "few_assets"), ("P", "concentration"), ("P", "over_sectors")} <= rules and ("P", "under_sectors") not in rules
    recs = advisor.recommendations(held, base, profiles, sectors, advisor.region_allocation(base, profiles)).where("portfolio_id = 'P'").collect()
    kinds = {(r["rule"], r["asset_id"], r["sector"]) for r in recs}
    assert ("sector_over", 1, "Technology") in kinds and ("position_cap", 1, "tech") in kinds and not any(r["rule"] == "hold" for r in recs)


# --- Streams ----------------------------------------------------------------------------------------

def limited(items, cap):
    """Sequential model of the anchored-hour limiter."""
    start, count, out = None, 0, []
    for ident, at, duplicate in sorted(items, key=lambda x: (x[1], x[0])):
        if start is None or (at - start).total_seconds() > 3600:
            start, count = at, 0
        if count >= cap:
            continue
        out.append(ident)
        count += not duplicate
    return out


def land(spark, rows_, schema, path, name):
    spark.createDataFrame(rows_, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def test_limiter_stream_over_several_batches(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    items = [(i, base + dt.timedelta(seconds=(i * 541) % 40000 if i < 60 else 40000 + i * 13), i % 7 == 0) for i in range(120)]
    items.sort(key=lambda x: (x[1], x[0]))
    mixed = items[40:80] + items[:40] + items[80:]  # the first hours arrive late
    schema = "alert_id bigint, created_at timestamp, is_duplicate boolean, k int"
    source = str(tmp_path / "in")
    for n in range(3):
        land(spark, [(*x, 1) for x in mixed[n * 40:(n + 1) * 40]], schema, source, f"part{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
    run = closed(spark, stream, tmp_path, lambda s: state.limit_stream(s, "k", cap=2), "created_at")
    assert sorted(r["alert_id"] for r in run.collect()) == sorted(limited(items, 2))
    table = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(source)
    assert sorted(r["alert_id"] for r in limiter.first_per_anchored_hour(table, "k", cap=2).collect()) == sorted(limited(items, 2))


def closed(spark, stream, tmp_path, build, time_col):
    """Run a stream to the end of its input and close it."""
    out, end = str(tmp_path / "out"), str(tmp_path / "closing")
    result = build(jobs.with_closing(stream, end))
    jobs.append_to(result, out).awaitTermination()
    jobs.close(spark, end, stream.schema, time_col)
    jobs.append_to(result, out).awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{out}/rows")


def test_two_alerts_in_reversed_order_both_pass(spark, tmp_path):
    schema = "alert_id bigint, created_at timestamp, is_duplicate boolean, k int"
    late, early = (2, dt.datetime(2024, 1, 1, 9), False, 1), (1, dt.datetime(2024, 1, 1, 4), False, 1)
    land(spark, [late], schema, str(tmp_path / "in"), "p0")
    land(spark, [early], schema, str(tmp_path / "in"), "p1")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    run = closed(spark, stream, tmp_path, lambda s: state.limit_stream(s, "k", cap=1), "created_at")
    assert sorted(r["alert_id"] for r in run.collect()) == [1, 2]


def test_idle_keys_keep_no_vectors(spark, tmp_path):
    schema = "id bigint, k string, at timestamp, vector array<double>"
    day = lambda n: dt.datetime(2024, 1, n)
    land(spark, [(1, "idle", day(1), [1.0, 0.0]), (2, "busy", day(1), [1.0, 0.0])], schema, str(tmp_path / "in"), "p0")
    land(spark, [(3, "busy", day(20), [0.0, 1.0])], schema, str(tmp_path / "in"), "p1")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    flags = state.flag_duplicates_stream(stream, "k", "id", ("at", "id"), 0.9, ttl_days=3, lateness="1 day")
    jobs.append_to(flags, str(tmp_path / "out")).awaitTermination()
    held = spark.read.format("statestore").option("path", str(tmp_path / "out" / "_stream")).option("stateVarName", "kept").load()
    assert held.where("key.k = 'idle'").count() == 0
    kept = spark.read.format("statestore").option("path", str(tmp_path / "out" / "_stream")).option("stateVarName", "waiting").load()
    assert kept.where("key.k = 'busy'").count() == 1  # still within the lateness


def test_ingest_keeps_late_rows_aside(spark, tmp_path):
    schema = "url string, published_at timestamp"
    run = jobs.ingest_batch(str(tmp_path / "s"), "2 days")
    first = spark.createDataFrame([("a", dt.datetime(2024, 1, 10)), ("a", dt.datetime(2024, 1, 9)), ("b", dt.datetime(2024, 1, 8))], schema)
    second = spark.createDataFrame([("a", dt.datetime(2024, 1, 10)), ("c", dt.datetime(2024, 1, 9)), ("d", dt.datetime(2024, 1, 2))], schema)
    for batch, ident in ((first, 0), (second, 1), (second, 1)):
        run(batch, ident)
    read = lambda part: sorted((r["url"], r["published_at"].day) for r in spark.read.schema(schema).parquet(str(tmp_path / "s" / part)).collect())
    assert read("rows") == [("a", 9), ("b", 8), ("c", 9)] and read("late") == [("d", 2)]


def test_a_batch_opens_only_folders_that_may_hold_its_urls(spark, rows, tmp_path, monkeypatch):
    """Later batches open no more than earlier ones, however many are stored; replays change nothing."""
    schema, opened = "url string, published_at timestamp", []
    read = DayStore.rows
    monkeypatch.setattr(DayStore, "rows", lambda self, folders: opened.append(list(folders)) or read(self, folders))
    run = jobs.ingest_batch(str(tmp_path / "s"), "2 days")

    def day(n):
        at = dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
        return rows([(f"u{n}-{k}", at + dt.timedelta(hours=k)) for k in range(20)] + [(f"u{n - 1}-3", at), (f"u{n - 5}-3", at), (None, at), ("never", None)], schema)

    def stored():
        return sorted((str(r["url"]), str(r["published_at"]), r["batch"]) for r in spark.read.parquet(str(tmp_path / "s" / "rows")).collect())

    for n in range(8):
        run(day(n), n)
    assert [len(o) for o in opened[3:6]] == [len(o) for o in opened[5:8]] and max(len(o) for o in opened) <= 4
    assert all((dt.date(2024, 1, 1) + dt.timedelta(days=n) - d).days <= 2 or d == dt.date(1970, 1, 1) for n, o in enumerate(opened) for d, _ in o)
    before = stored()
    assert sum(u == "never" for u, _, _ in before) == 1 and sum(u == "u2-3" for u, _, _ in before) == 2  # remembered for two days, not for five
    run(day(7), 7)
    assert stored() == before


def test_filters_never_miss_a_key(spark, rows, tmp_path):
    from pyspark.sql.types import StructType

    schema = "url string, published_at timestamp"
    store = DayStore(spark, str(tmp_path / "s"), StructType.fromDDL(schema), "published_at", "url", 100)
    at = dt.datetime(2024, 3, 1)
    for n in range(3):
        store.write(rows([(f"{n}/{k}", at + dt.timedelta(days=k % 2)) for k in range(300)], schema), n)
    days = store.mark(3)[1]
    assert days == [at.date(), at.date() + dt.timedelta(days=1)]
    assert store.folders(days, 3, rows([("1/4", at), ("1/6", at)], schema)) == [(days[0], 1)]
    assert store.folders(days, 3, rows([(f"x{k}", at) for k in range(3)], schema)) == []
    assert len(store.folders(days, 3, rows([(f"{n}/{k}", at) for n in range(3) for k in range(300)], schema))) == 6 == len(store.folders(days, 3))
    assert store.mark(0) == (None, []) and store.mark(9)[1] == days


def test_hourly_limiter_counts_what_is_stored(rows):
    at = dt.datetime(2024, 1, 1, 10)
    fresh = rows([(i, "p", at + dt.timedelta(minutes=i)) for i in range(5)] + [(9, "p", at + dt.timedelta(hours=1))], "id int, k string, at timestamp")
    stored = rows([(100, "p", at)], "id int, k string, at timestamp")
    assert sorted(r["id"] for r in limiter.first_per_hour(fresh, "k", "at", "id", 2).collect()) == [0, 1, 9]
    assert sorted(r["id"] for r in limiter.first_per_hour(fresh, "k", "at", "id", 2, stored).collect()) == [0, 9]


def test_alerting_replay_is_idempotent(spark, rows, tmp_path):
    assets = rows([("P", 0, "AAPL", "Apple Inc.", ["iPhone"], "Technology", "US")],
                  "portfolio_id string, pos bigint, ticker string, name string, aliases array<string>, sector string, country string")
    schema = "news_id bigint, title string, text string, source string, orgs array<string>, published_at timestamp"
    first = rows([(1, "t", "Apple lawsuit in court", "s", [], dt.datetime(2024, 1, 1)), (2, "t", "Nothing", "s", [], dt.datetime(2024, 1, 1))], schema)
    second = rows([(1, "t", "Apple lawsuit in court", "s", [], dt.datetime(2024, 1, 1)),
                   (3, "t", "iPhone recall and outage", "s", [], dt.datetime(2024, 1, 1, 1))], schema)
    path = str(tmp_path / "store")
    run = jobs.alerting_batch(path, assets)
    for batch, ident in ((first, 0), (first, 0), (second, 1), (second, 1)):
        run(batch, ident)
    stored = sorted((r["news_id"], r["event_type"], r["batch"]) for r in spark.read.parquet(f"{path}/rows").collect())
    assert stored == [(1, "litigio", 0), (3, "incidencia_operativa", 1)]


def test_open_hours_are_visible_and_corrected(spark, tmp_path):
    schema, base = "created_at timestamp, event_type string", dt.datetime(2024, 1, 1)
    source, path = str(tmp_path / "in"), str(tmp_path / "out")

    def minutes(*values):
        return [(base + dt.timedelta(minutes=m), "a") for m in values]

    def counters():
        return {r["interval_start"].hour: r["n"] for r in jobs.current_counters(spark, path).collect()}

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
        jobs.start_open_counters(stream, path, "3 hours").awaitTermination()

    land(spark, minutes(5, 10, 65), schema, source, "p0")
    run()
    assert counters() == {0: 2, 1: 1}  # both hours are open
    land(spark, minutes(70, 20), schema, source, "p1")  # one row is late
    run()
    assert counters() == {0: 3, 1: 2}
    land(spark, minutes(600, 6), schema, source, "p2")
    run()
    assert counters() == {0: 4, 1: 2, 10: 1}
    land(spark, minutes(601, 7), schema, source, "p3")  # too late to be counted
    run()
    assert counters() == {0: 4, 1: 2, 10: 2}
    before = counters()
    rows_ = spark.read.parquet(f"{path}/rows").where("batch = 2").drop("day", "batch")
    jobs._counted(path)(spark.createDataFrame(rows_.collect(), rows_.schema), 2)  # a replay
    assert counters() == before
    assert {r["interval_start"].hour for r in jobs.current_counters(spark, path, dt.date(2024, 1, 2)).collect()} == set()


def test_feed_files_are_landed_as_they_arrive(spark, tmp_path):
    feed, path = tmp_path / "feed", str(tmp_path / "out")
    feed.mkdir()

    def item(k, body="text", link=True):
        return f"<item><title>t{k}</title>{f'<link>http://x/{k}</link>' if link else ''}<pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate><description>{body}</description></item>"

    (feed / "good.xml").write_text(f"<rss><channel>{item(1)}{item(2)}</channel></rss>")
    (feed / "mixed.xml").write_text(f"<rss>{item(3)}<item><title>x</title><link>http://x/4</link><description>a <b>not closed</description></item>{item(5, link=False)}<item></item>{item(6, 'h' * 5000)}</rss>")
    (feed / "empty.xml").write_text("")

    def run():
        items = feeds.stream_rss(spark, str(feed), per_batch=1)
        jobs.start_landing(items, path, lambda good: feeds.rss_to_news(good, F.lit("desk"), now()), most_chars=1000).awaitTermination()
        news = sorted(r["url"] for r in spark.read.parquet(f"{path}/news").collect())
        return news, {r["fault"]: r["count"] for r in spark.read.parquet(f"{path}/faults").groupBy("fault").count().collect()}

    good, bad = run()
    assert good == ["http://x/1", "http://x/2", "http://x/3"] and bad == {"broken": 1, "unlinked": 1, "empty": 1, "huge": 1}
    broken = spark.read.parquet(f"{path}/faults").where("fault = 'broken'").first()
    assert "not closed" in broken["record"] and broken["file"].endswith("mixed.xml")
    (feed / "later.xml").write_text(f"<rss>{item(7)}</rss>")
    assert run() == ([*good, "http://x/7"], bad)


def test_ingest_stream_drops_repeated_urls(spark, tmp_path):
    schema = "url string, published_at timestamp"
    source = str(tmp_path / "in")
    land(spark, [("a", dt.datetime(2024, 1, 1)), ("b", dt.datetime(2024, 1, 1)), ("a", dt.datetime(2024, 1, 1, 2))], schema, source, "p0")
    land(spark, [("a", dt.datetime(2024, 1, 1, 5)), ("c", dt.datetime(2024, 1, 1, 6))], schema, source, "p1")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
    jobs.append_to(jobs.ingest(stream), str(tmp_path / "out")).awaitTermination()
    assert sorted(r["url"] for r in spark.read.schema(schema).parquet(str(tmp_path / "out" / "rows")).collect()) == ["a", "b", "c"]


def test_stored_alerts_keep_their_hour(rows):
    at = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)
    ddl = "alert_id bigint, k string, created_at timestamp, is_duplicate boolean"
    everything = rows([(m, "p", at(m), False) for m in (0, 10, 20, 59, 70, 80, 125)], ddl)
    whole = limiter.first_per_anchored_hour(everything, "k", cap=2)
    assert [r["alert_id"] for r in whole.orderBy("alert_id").collect()] == [0, 10, 70, 80]
    first = limiter.first_per_anchored_hour(everything.where("alert_id < 20"), "k", cap=2)
    later = limiter.first_per_anchored_hour(everything.where("alert_id >= 20"), "k", cap=2, stored=first)
    assert [r["alert_id"] for r in later.orderBy("alert_id").collect()] == [70, 80]


def test_alerts_in_batches_equal_alerts_at_once(spark, rows, tmp_path):
    assets = rows([("P", 0, "AAPL", "Apple Inc.", ["iPhone"], "Technology", "US")],
                  "portfolio_id string, pos bigint, ticker string, name string, aliases array<string>, sector string, country string")
    texts = ["Apple lawsuit in court", "Apple faces a lawsuit in court", "iPhone recall and outage", "Apple merger and acquisition", "Nothing"]
    news = rows([(i, "t", t, "s", [], dt.datetime(2024, 1, 1, 1, 10 * i)) for i, t in enumerate(texts)],
                "news_id bigint, title string, text string, source string, orgs array<string>, published_at timestamp")
    vectors = rows([(0, [1.0, 0.0]), (1, [0.99, 0.05]), (2, [0.0, 1.0]), (3, [-1.0, 0.2])], "news_id bigint, vector array<double>")
    held = rows([("P", "AAPL", 0, [0.6, 0.8])], "portfolio_id string, ticker string, pos bigint, vector array<double>")
    scores = {"vectors": vectors, "asset_vectors": held}
    whole = {(r["news_id"], r["is_duplicate"]) for r in jobs.alert_batch(news, assets, cap=2, **scores).collect()}
    assert (0, False) in whole and (1, True) in whole
    run = jobs.alerting_batch(str(tmp_path / "store"), assets, cap=2, **scores)
    for ident, part in enumerate(("news_id < 1", "news_id between 1 and 2", "news_id > 2")):
        run(news.where(part), ident)
    stored = spark.read.schema(jobs.ALERT_ROW).parquet(str(tmp_path / "store" / "rows"))
    assert {(r["news_id"], r["is_duplicate"]) for r in stored.collect()} == whole


class FakeHandle:
    """State variables in memory, which count the entries that are read, written and deleted."""

    def __init__(self):
        self.values, self.maps, self.timers, self.reads = {}, {}, set(), {}

    def getValueState(self, name, schema):
        values = self.values

        class Value:
            exists = staticmethod(lambda: name in values)
            get = staticmethod(lambda: values[name])
            update = staticmethod(lambda new: values.__setitem__(name, new))
            clear = staticmethod(lambda: values.pop(name))

        return Value()

    def getMapState(self, name, key, schema):
        own, reads = self.maps.setdefault(name, {}), self.reads

        class Map:
            @staticmethod
            def getValue(k):
                reads[name, k] = reads.get((name, k), 0) + 1
                return own.get(k)

            updateValue = staticmethod(own.__setitem__)
            removeKey = staticmethod(own.pop)

        return Map()

    def registerTimer(self, at):
        self.timers.add(at)


class At:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def played(processor, batches, lateness):
    """Rows per batch given to one key, timers fired as the watermark passes them; the results and the state."""
    handle, out = FakeHandle(), []
    processor.init(handle)
    for batch, watermark in batches:
        list(processor.handleInputRows(("k",), iter([batch]), At(0)))
        fired = sorted(t for t in handle.timers if t <= watermark)
        for t in fired:
            handle.timers.discard(t)
            out += list(processor.handleExpiredTimer(("k",), At(watermark), None))
    return pd.concat(out, ignore_index=True), handle


def test_waiting_rows_are_read_once():
    """State reads grow with the rows, whatever the number of buckets and batches, and nothing is left behind."""
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("alert_id bigint, created_at timestamp, is_duplicate boolean")
    reads = {}
    for size in (200, 400, 800):
        times = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.random.default_rng(5).permutation(size) * 1000, unit="s")
        rows_ = pd.DataFrame({"alert_id": range(size), "created_at": times, "is_duplicate": False})
        end = int(rows_["created_at"].max().timestamp() * 1000)
        parts = [rows_.iloc[k * size // 10:(k + 1) * size // 10] for k in range(10)]
        batches = [(p, 0) for p in parts] + [(rows_.iloc[:0], end * k // 4 + 10**12 * (k == 4)) for k in range(1, 5)]
        processor = state.AnchoredHourLimiter(schema, ["created_at", "alert_id"], 1, state.DAY)
        out, handle = played(processor, batches, 0)
        assert sorted(out["alert_id"]) == sorted(limited([(i, t.to_pydatetime(), False) for i, t in zip(rows_["alert_id"], rows_["created_at"])], 1))
        mine = [n for (name, _), n in handle.reads.items() if name == "waiting"]
        assert set(mine) == {1} and not handle.maps["waiting"] and "open" not in handle.values and "window" not in handle.values
        assert not {t for t in handle.timers if t <= end + 10**12}
        reads[size] = len(mine)
    assert reads[800] <= 4.5 * reads[200]


def test_duplicate_filter_reads_kept_vectors_once_a_task():
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("id bigint, at timestamp, vector array<double>")
    rng, n = np.random.default_rng(6), 300
    vectors = rng.normal(size=(n, 3))
    frame = pd.DataFrame({"id": range(n), "at": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="h"), "vector": list(vectors)})
    ends = [int((pd.Timestamp("2024-01-01") + pd.Timedelta(days=d)).timestamp() * 1000) for d in range(1, 30)]

    def filtered():
        return state.GreedyDuplicateFilter(schema, "id", ["at", "id"], 0.97, 50, 20, 5 * state.DAY, state.DAY)

    out, handle = played(filtered(), [(frame, 0)] + [(frame.iloc[:0], e) for e in ends], 0)
    whole, _ = played(filtered(), [(frame, ends[-1])], 0)
    assert out.sort_values("id").reset_index(drop=True).equals(whole.sort_values("id").reset_index(drop=True))
    assert not any(name == "kept" for name, _ in handle.reads)  # remembered by the task
    assert not handle.maps["kept"] and "filled" not in handle.values  # all expired
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    seconds = np.arange(n) * 3600.0
    expected = similarity.greedy_filter(np.zeros((0, 3)), np.zeros(0), unit, seconds, 0.97, 50, 20, 5 * state.DAY)[1]
    assert out.sort_values("id")["is_duplicate"].tolist() == expected.tolist()
    # a new task finds the same vectors in the state
    first, second = filtered(), filtered()
    half = 7 * 24  # no row of the second part is behind the watermark
    handle = FakeHandle()
    first.init(handle)
    got = []
    for processor, part, e in ((first, frame.iloc[:half], ends[6]), (second, frame.iloc[half:], ends[-1])):
        processor.init(handle)
        list(processor.handleInputRows(("k",), iter([part]), At(0)))
        got += list(processor.handleExpiredTimer(("k",), At(e), None))
    assert pd.concat(got).sort_values("id")["is_duplicate"].tolist() == expected.tolist()
    assert {c for (name, _), c in handle.reads.items() if name == "kept"} == {1}


def test_retention_beside_a_running_ingest(spark, rows, tmp_path):
    path, ddl = str(tmp_path / "ingest"), "url string, published_at timestamp"
    schema = rows([], ddl).schema
    run, store = jobs.ingest_batch(path, "2 days"), jobs.news_store(spark, path, schema, "2 days")
    assert store.purge_before(dt.date(2024, 2, 1)) == []
    for batch in range(4):
        run(rows([(f"u{batch}-{k}", dt.datetime(2024, 1, 1 + 3 * batch, k)) for k in range(3)] + [(f"undated{batch}", None)], ddl), batch)
    held = lambda: {r["url"] for r in spark.read.schema(schema).parquet(f"{path}/rows").collect()}
    assert len(held()) == 16
    assert store.purge_before(dt.date(2024, 1, 1)) == []
    # the days of the two newest marks stay whatever the date asked for: a batch or its replay may open them
    assert store.purge_before(dt.date(2024, 2, 1)) == [dt.date(2024, 1, 1), dt.date(2024, 1, 4)]
    left = {f"u{b}-{k}" for b in (2, 3) for k in range(3)} | {f"undated{b}" for b in range(4)}
    assert held() == left and store.purge_before(dt.date(2024, 2, 1)) == []
    last = rows([(f"u3-{k}", dt.datetime(2024, 1, 10, k)) for k in range(3)] + [("undated3", None)], ddl)
    run(last, 3)  # a replay
    assert held() == left
    run(rows([("u3-1", dt.datetime(2024, 1, 11)), ("new", dt.datetime(2024, 1, 11))], ddl), 4)
    assert held() == left | {"new"}


def folder_tables(spark, folder):
    """A small set of tables, each a folder of several files; documents repeat passages that name watched assets."""
    import __spark_entry__

    passages = [(i, " ".join(f"word{(i * 31 + k * 7) % 50}x" for k in range(12)).replace("0", "o").translate(str.maketrans("123456789", "abcdefghi"))) for i in range(8)]
    spark.createDataFrame(passages, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    words = "Quiebra, fraude, investigación, multa, demanda, sanción, bankruptcy, fraud, lawsuit."
    spark.createDataFrame([(i, f"{passages[i % 4][1]}. {words}", "en", "web", 30) for i in range(8)],
                          "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(8)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, [1.0, float(i)], i % 4) for i in range(8)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([(i, dt.datetime(2024, 1, 1, i), 1, "error", 90.0, '{"k": 50}') for i in range(8)],
                          "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return __spark_entry__.queries(), str(folder)


def test_ingest_of_a_table_in_several_files(spark, tmp_path):
    """A stream over a table that is a folder of files reads all of them; it read nothing and left no rows."""
    queries, folder = folder_tables(spark, tmp_path)
    assert queries["H6_continuous_ingest"](spark, folder).count() == 4


def test_alerting_of_tables_in_several_files(spark, tmp_path):
    queries, folder = folder_tables(spark, tmp_path)
    assert queries["H7_continuous_alerting"](spark, folder).count() > 0


def test_recommendations_work_out_their_rules_once(rows):
    """The rules, and with them the holdings, were worked out again to find the portfolios that no rule concerns."""
    held = rows([("P", 1, "One", 90.0, "tech", "usa"), ("P", 2, "Two", 10.0, "Energy", "Spain")],
                "portfolio_id string, asset_id bigint, name string, weight double, sector string, country string")
    profiles = rows([("P", "moderado")], "portfolio_id string, risk_profile string")
    base = advisor.composition(held)
    sectors, regions = advisor.sector_allocation(base, profiles), advisor.region_allocation(base, profiles)
    found = advisor.recommendations(held, base, profiles, sectors, regions)
    assert "contains(" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert ("position_cap", 1) in {(r["rule"], r["asset_id"]) for r in found.collect()}


def test_limiter_state_does_not_grow_with_keys(monkeypatch):
    """Keys of a slot share their entries; every key had its own, so state calls grew with the keys."""
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("alert_id bigint, created_at timestamp, is_duplicate boolean, k string")
    size, base = 3000, pd.Timestamp("2024-01-01")
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"alert_id": range(size), "created_at": base + pd.to_timedelta(rng.integers(0, 5 * 86400, size), unit="s"),
                          "is_duplicate": rng.random(size) < 0.2, "k": [None if i % 200 == 0 else f"key{i % 200}" for i in range(size)]})
    expected = sorted(i for _, own in frame.groupby("k", dropna=False) for i in limited(
        [(r.alert_id, r.created_at.to_pydatetime(), r.is_duplicate) for r in own.itertuples()], 1))
    for held in (state.HELD_ROWS, 500):  # all days together, and in pieces
        monkeypatch.setattr(state, "HELD_ROWS", held)
        processor = state.AnchoredHourLimiter(schema, ["created_at", "alert_id"], 1, state.DAY, "k")
        days = [int((base + pd.Timedelta(days=d)).timestamp() * 1000) for d in (2, 3, 30)]
        out, handle = played(processor, [(frame.iloc[:2000], 0), (frame.iloc[2000:], 0)] + [(frame.iloc[:0], d) for d in days], 0)
        assert sorted(out["alert_id"]) == expected
        assert len(handle.reads) <= 10 and not handle.maps["waiting"] and "open" not in handle.values and "window" not in handle.values


def test_limiter_stream_of_null_keys_and_large_ids(spark, tmp_path):
    schema, big = "alert_id bigint, created_at timestamp, is_duplicate boolean, k bigint", 2**60
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    items = [(big + 1, at(1), False, big + 1), (big + 2, at(2), False, big + 2), (big + 3, at(3), False, big + 2), (None, at(4), True, None),
             (5, at(5), False, None), (6, at(6), False, None), (0, at(7), False, 0)]
    land(spark, items, schema, str(tmp_path / "in"), "p0")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    run = closed(spark, stream, tmp_path, lambda s: state.limit_stream(s, "k", cap=1), "created_at")
    assert run.schema.names == ["alert_id", "created_at", "is_duplicate", "k"]
    assert {(r.alert_id, r.k) for r in run.collect()} == {(big + 1, big + 1), (big + 2, big + 2), (None, None), (5, None), (0, 0)}
