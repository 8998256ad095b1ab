import hashlib
import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from foliowire import domain
from foliowire.functions import scoring, text, vectors
from foliowire.operators import gates, impact


def values(df):
    return [tuple(r) for r in df.collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, cleaned", [
    ("<p>Hello <b>world</b></p>", "Hello world"), ("see https://a.b/c?d=1 now", "see now"), ("a  \n\t b", "a b"), ("", ""),
    ("x 　y", "x y"), ("<a href='http://x.y'>t</a>http://q", "t"),
])
def test_clean(spark, raw, cleaned):
    assert one(spark, text.clean(F.lit(raw))) == cleaned


def test_full_text_and_hash(spark):
    assert one(spark, text.full_text(F.lit("T"), F.lit(None).cast("string"), F.lit("Body. "))) == "T. . Body"
    assert one(spark, text.full_text(F.lit(""), F.lit(""), F.lit(""))) == ""
    assert one(spark, text.content_hash(F.lit("a"), F.lit(None), F.lit("c"))) == hashlib.sha256(b"a  c").hexdigest()


def test_strip_accents_matches_decomposition(spark):
    samples = ["Telefónica S.A.", "ßäÖ ñ ç É", "ﬁnance ½ Ǆ", "élève", "Ελλάδα", "Ёлка", "plain", "ｆｕｌｌ", "…™"]
    expected = ["".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)) for s in samples]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    assert [r[0] for r in df.select(text.strip_accents(F.col("s"))).collect()] == expected


@pytest.mark.parametrize("name, canonical", [
    ("Apple Inc.", "apple"), ("Banco Santander, S.A.", "banco santander"), ("The Coca-Cola Company", "coca cola"), ("Nestlé AG", "nestle"), ("", ""),
    ("Inc.", ""), ("東京 Holdings", "東京"),
])
def test_canonical_name(spark, name, canonical):
    assert one(spark, text.canonical_name(F.lit(name))) == canonical


def test_language_vote(spark):
    spanish = "de la el en que los otros"
    assert one(spark, text.vote_language(F.lit(spanish))) == "es"
    assert one(spark, text.vote_language(F.lit("de la el en que otros"))) == "en"
    assert one(spark, text.vote_language(F.lit("x " * 50 + spanish))) == "en"


def test_mined_organisations(spark):
    body = "The Fed met. Goldman Sachs and Morgan\nStanley; Goldman Sachs again, Élite Group Plc caféApple Pie"
    assert one(spark, text.mined_organisations(F.lit(body))) == ["Goldman Sachs", "Morgan\nStanley", "Group Plc"]


def test_a_run_of_capitalised_words_may_be_of_any_length(rows):
    """A run of some 1500 words overflowed the stack of its task."""
    got = rows([(40_000,), (3,)], "n int").select("n", text.mined_organisations(F.repeat(F.lit("Casa  Verde "), F.col("n")), None, squeezed=True).alias("found")).collect()
    assert {r["n"]: r["found"] for r in got} == {n: [" ".join(["Casa Verde"] * n)] for n in (40_000, 3)}


def test_capitalised_runs_end_where_a_search_that_gives_back_words_ends(rows):
    pieces = [*["Ab", "Cde", " "] * 3, "F", "g", "É", "é", "\u0301", "_", "7", ".", " ", " ", "\n ", "\u00a0", "\u2003"]
    draw = random.Random(5)
    texts = ["".join(draw.choices(pieces, k=draw.randint(0, 14))) for _ in range(20_000)]
    # a combining mark continues a word here, as in Spark; for \w of Python it does not
    word = re.compile(r"(?<![\w\u0301])([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)(?![\w\u0301])")
    expected = {k: word.findall(t) for k, t in enumerate(texts)}
    got = rows(list(enumerate(texts)), "id int, t string").select("id", text.capitalised_runs(F.col("t")).alias("runs")).collect()
    assert {r["id"]: r["runs"] for r in got} == expected and sum(map(len, expected.values())) > 500


@pytest.mark.parametrize("raw, date", [
    ("2024-03-05T10:00:00Z", "2024-03-05"), ("2024-03-05 10:00:00.5+00:00", "2024-03-05"), ("2024-03-05", "2024-03-05"),
    ("not a date", None), (None, None), ("2024-13-05T00:00:00Z", None),
])
def test_event_date(spark, raw, date):
    got = one(spark, text.event_date(F.lit(raw).cast("string")))
    assert (str(got) if got else None) == date


@pytest.mark.parametrize("raw, default, number", [
    ("1.23456", 0.0, 1.2346), ("NaN", 0.0, 0.0), ("Infinity", 0.0, 0.0), ("-Infinity", -1.0, -1.0), (None, 0.0, 0.0), ("text", 5.0, 5.0), ("NaN", None, None),
])
def test_safe_float(spark, raw, default, number):
    assert one(spark, scoring.safe_float(F.lit(raw).cast("string"), default)) == number


def test_bands(spark):
    scores = [0.8, 0.6, 0.4, 0.2, 0.0, 0.79]
    assert [one(spark, scoring.severity_label(F.lit(s))) for s in scores] == ["muy_alta", "alta", "media", "baja", "muy_baja", "alta"]
    cars = [0.001, 0.01, 0.02, 0.05, 0.1, 0.005, 1.5]
    assert [one(spark, scoring.abs_car_label(F.lit(c))) for c in cars] == ["muy_baja", "baja", "media", "alta", "muy_alta", "baja", "muy_alta"]
    assert one(spark, scoring.expected_abs_car(F.lit("muy_alta"))) == pytest.approx(0.09)
    assert one(spark, scoring.change_pct(F.lit(110.0), F.lit(100.0))) == 10.0
    assert one(spark, scoring.change_pct(F.lit(110.0), F.lit(0.0))) == 0.0
    assert one(spark, scoring.change_pct(F.lit(110.0), F.lit(None).cast("double"))) == 0.0


def test_cosine(spark):
    def cos(a, b):
        return one(spark, vectors.cosine(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))

    assert cos([1.0, 2.0], [1.0, 2.0]) == pytest.approx(1.0)
    assert cos([1.0, 0.0], [0.0, 1.0]) == 0.0
    assert cos([1.0, 0.0], [-1.0, 0.0]) == -1.0
    assert cos([0.0, 0.0], [1.0, 0.0]) == 0.0


@pytest.mark.parametrize("answer, parsed", [
    ('{"event_type": "otro"}', True), ('```json\n{"event_type": "otro"}\n```', True), ('Here: {"event_type": "otro"} done', True),
    ("nothing here", False), ("", False), ('<think>{"no": 1}</think> {"event_type": "otro"}', True), ("{broken", False),
])
def test_extract_json(spark, answer, parsed):
    got = one(spark, F.get_json_object(impact.extract_json(F.lit(answer)), "$.event_type"))
    assert (got == "otro") is parsed


def impact_row(rows, sentiment, conf, event, event_conf, relevance, assets):
    df = rows([(sentiment, conf, event, event_conf, relevance, assets)],
              "sentiment string, sentiment_confidence double, event_type string, event_confidence double, relevance double, matched_assets array<string>")
    return impact.estimate_impact(df).first()


def test_impact_estimate(rows):
    r = impact_row(rows, "positive", 0.9, "resultados_empresariales", 0.8, 0.9, ["AAPL"])
    assert r["direction"] == "alcista" and r["severity"] == pytest.approx(0.6 * 0.97 * 1.1, abs=1e-4)
    assert r["confidence"] == pytest.approx(0.3 * 0.9 + 0.4 * 0.8 + 0.3 * 0.9, abs=1e-4)
    assert impact_row(rows, "negative", 0.9, "litigio", 0.8, 0.9, ["A"])["direction"] == "bajista"
    assert impact_row(rows, "neutral", 0.5, "nowhere", 0.1, 0.1, [])["direction"] == "neutral"
    one_asset, five = (impact_row(rows, "negative", 0.9, "ciberincidente", 0.9, 0.9, [str(i) for i in range(n)])["severity"] for n in (1, 5))
    assert five > one_asset and five == 1.0


def test_merge_clamps_severity_and_guards_direction(rows):
    base = rows([(1, 0.5, "media", "alcista", 0.7), (2, 0.5, "media", "alcista", 0.7), (3, 0.5, "media", "alcista", 0.7)],
                "id int, severity double, severity_label string, direction string, confidence double")
    given = rows([(1, 0.9, "bajista", 0.5), (2, 0.1, "bajista", 0.9)], "id int, severity double, direction string, confidence double")
    got = {r["id"]: r for r in impact.merge_analyses(base, given, ["id"]).collect()}
    assert got[1]["severity"] == 0.7 and got[1]["direction"] == "alcista" and got[1]["confidence"] == pytest.approx(0.6)
    assert got[2]["severity"] == 0.3 and got[2]["direction"] == "bajista" and got[2]["severity_label"] == "baja"
    assert got[3]["severity"] == 0.5 and not got[3]["enhanced"] and got[3]["severity_raw"] is None


def test_validate_analysis(rows):
    df = rows([("boom", "up", "1.7", None), ("litigio", "bajista", "-3", "0.12345")], "event_type string, direction string, severity string, confidence string")
    assert values(impact.validate_analysis(df)) == [("otro", "neutral", 1.0, 0.5), ("litigio", "bajista", 0.0, 0.1235)]


def test_keyword_ties_take_the_first_event(rows):
    df = rows([("the deal and the lawsuit",), ("nothing",), ("CEO board executive appointed resign",)], "text string")
    got = [(r["event_type"], round(r["event_confidence"], 4)) for r in impact.classify_by_keywords(df, "text").collect()]
    assert got == [("litigio", 0.45), ("otro", 0.1), ("cambio_directivo", 0.85)]


def test_gates(rows):
    scored = rows([(1, 0.6, ["A"]), (2, 0.4, ["A"]), (3, 0.4, ["A"]), (4, 0.4, []), (5, 0.2, [])], "id int, relevance double, matched_assets array<string>")
    verdicts = rows([(2, True, 0.7, ["B", "A"]), (3, False, 0.9, ["B"]), (5, True, 0.9, ["B"])],
                    "id int, is_relevant boolean, relevance_score double, affected_assets array<string>")
    kept = {r["id"]: (r["relevance"], r["matched_assets"]) for r in gates.rescue_borderline(scored, verdicts, ["id"]).collect()}
    assert kept == {1: (0.6, ["A"]), 2: (0.7, ["A", "B"])}


def test_pretty_label_and_age(spark):
    assert one(spark, text.pretty_label(F.lit("fusion_adquisicion USA"))) == "Fusion Adquisicion USA"
    now = F.to_timestamp(F.lit("2024-01-10 12:00:00"))
    ages = ["2024-01-10 11:59:30", "2024-01-10 11:30:00", "2024-01-10 02:00:00", "2024-01-07 12:00:00", "2023-12-01 08:05:00"]
    got = [one(spark, text.age_label(F.to_timestamp(F.lit(a)), now)) for a in ages]
    assert got == ["Ahora", "Hace 30m", "Hace 10h", "Hace 3d", "2023-12-01 08:05"]


def test_constants_are_consistent():
    assert set(domain.IMPACT_PRIORS) == set(domain.EVENT_TYPES) == set(domain.EVENT_TEXT)
    assert all(math.isclose(sum(v.values()), 100) for table in (domain.IDEAL_SECTORS, domain.IDEAL_REGIONS) for v in table.values())
