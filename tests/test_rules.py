"""Hand-written rule tables: input -> expected."""

import pytest
from pyspark.sql import functions as F

from presswire.functions import headlines as H
from presswire.functions import keywords, labels, numeric, packed, urls, vectors


def apply(spark, rule, values, schema="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {schema}")
    return [r[0] for r in df.orderBy("i").select(rule(F.col("v")).alias("out")).collect()]


def check(spark, rule, table, schema="string"):
    assert apply(spark, rule, list(table), schema) == list(table.values())


def test_headline_from_url(spark):
    base = "https://www.example.com/"
    check(spark, H.headline_from_url, {
        None: None,
        "": None,
        base + "index": None,
        base + "news/1234567890": None,
        base + "a/article-12ab34cd": None,
        base + "12ab34cd-12ab-more-words-here-now": None,
        base + "2024/01/global-markets-rally-after-central-bank-decision-100001.html":
            "global markets rally after central bank decision",
        base + "20240115-storm-hits-coastal-towns-hard": "storm hits coastal towns hard",
        base + "peace%20talks-resume-in-geneva%2Dcity": "peace talks resume in geneva city",
        base + "peace+talks+resume+after+summit": None,
        base + "growth-hits-5%-this-year-again": "growth hits 5% this year again",
        base + "flood-warning-issued-for-valleys;jsessionid=1?x=y#z": "flood warning issued for valleys",
        base + "alpha-beta-gamma-delta-one/delta-gamma-beta-alpha-two": "delta gamma beta alpha two",
        base + "élections-générales-en-france": "élections générales en france",
        "http://[broken/some-words-in-a-long-title-here": None,
        base + "two-words/": None,
        base + "some-nice-title_here.php": "some nice title here",
    })


def test_clean_headline(spark):
    check(spark, H.clean_headline, {
        None: None,
        "": None,
        "too short": None,
        "peace agreement signed between neighbouring states today":
            "Peace Agreement Signed Between Neighbouring States Today",
        "...Leaders meet in Geneva for the new border talks 20240115":
            "Leaders Meet in Geneva for the New Border Talks",
        "presidentSays the economy will grow next year": "President Says the Economy Will Grow Next Year",
        "Storm hits coastal towns across region of an": "Storm Hits Coastal Towns Across Region",
        "Growth rises 6 5 percent in northern cities": "Growth Rises 6.5 Percent in Northern Cities",
        "U S officials confirm new trade agreement": "Us Officials Confirm New Trade Agreement",
        "Breaking news from the capital about the vote count": None,
        "Minister says the military could": None,
        "Police arrest five suspects after the bank Mur": "Police Arrest Five Suspects After the Bank",
        "Parliament votes on the new budget Presidentf": "Parliament Votes on the New Budget",
        "The governmentAposs new plan for schools": "The Government 's New Plan for Schools",
        "market " * 20: " ".join(["Market"] * 14),
        "x " * 6000: None,
        "Straße ßau wird in der großen Stadt gebaut": "Straße Ssau Wird in Der Großen Stadt Gebaut",
    })


def test_segment_score(spark):
    check(spark, lambda c: H.segment_score(c), {
        None: 0, "1234 5678 90": 0, "one two three four five": 73, "alpha beta gamma": 31,
        "global news": 15, "headline": 0,
    })


def test_quality_and_keys(spark):
    got = apply(spark, lambda c: numeric.stable_round(H.headline_quality(c, F.lit("https://www.bbc.com/x"))), [
        "", "Peace Agreement Signed Between Neighbouring States", "Short One", "Bnzqvyw5 Xes7 Tiqkizlx Go There Now",
        "Live Updates From the Region as Talks Go On",
    ])
    assert got == [0.0, 0.95, 0.55, 0.35, 0.65]
    check(spark, H.dedupe_key, {"Snow Expected Across Much Uk Today Now": "expected across much uk today",
                                "Single": "single", None: None})
    check(spark, H.garbage_words, {"Bnzqvyw5 Xes7 Brrrrt fine": 3, "all good words": 0, "": 0})
    check(spark, H.title_case, {"THE end OF a story": "The End of a Story"})


def test_urls(spark):
    check(spark, urls.host, {"https://www.bbc.com/a": "www.bbc.com", "/only/path": "", "mailto:x": ""})
    check(spark, urls.path, {"https://h/a/b;p=1?q#f": "/a/b", "a b/c d": "a b/c d"})
    check(spark, urls.percent_decode, {"a+b%20c": "a+b c", "100%": "100%", "%zz": "%zz"})


def test_packed_fields(spark):
    tone = lambda c: F.array(*packed.parse_tone(c).values())
    check(spark, tone, {
        None: [0.0, 0.0, 0.0], "": [0.0, 0.0, 0.0], "bad": [0.0, 0.0, 0.0], "1.5,x,2": [0.0, 0.0, 0.0],
        "1.5": [1.5, 0.0, 0.0], "-1.5,2,3e1,x": [-1.5, 2.0, 30.0], "1.5d,1,1": [0.0, 0.0, 0.0],
    })
    gcam = lambda c: F.array(*[packed.emotion_value(packed.gcam_pairs(c), x) for x in ("c9.1", "c9.2", "c9.3", "c9.4")])
    check(spark, gcam, {
        None: [0.0] * 4,
        "wc:1,c9.1:2,c9.1:5,c9.2:1:2,c9.3:x,c9.4:0.5": [5.0, 0.0, 0.0, 0.5],
        "c9.1:5,c9.1:y": [5.0, 0.0, 0.0, 0.0],
    })
    check(spark, packed.parse_themes, {
        None: "", "": "", "A,1;TERROR,5; LEADER ,2;XX,1;ABC;ABC": "TERROR,LEADER,ABC,ABC",
        ";".join(f"THEME{i},1" for i in range(12)): ",".join(f"THEME{i}" for i in range(12)),
    })
    check(spark, packed.humanize_theme, {
        None: None, "": None, "TAX_FNCACT_PRESIDENT": "Finance", " terror": "Security", "WB_2024_roads": "2024 Roads",
        "XY": None, "A_VERY_LONG_THEME_NAME_INDEED": None, "o_neil's": "O Neil'S",
    })


def test_labels(spark):
    scores = [None, float("nan"), -8.0, -7.9, -3.0, -1.0, 0.0, 1.0, 4.9, 5.0]
    assert apply(spark, labels.impact_label, scores, "double") == [
        "Neutral", "Neutral", "🔴 Severe Crisis", "🔴 Major Conflict", "🟠 Rising Tensions", "🟡 Minor Dispute",
        "⚪ Neutral", "🟢 Cooperation", "🟢 Partnership", "✨ Major Agreement"]
    assert apply(spark, labels.sentiment_category, [None, -5.0, -5.1, 1.9, 2.0, 5.0], "double") == [
        "Very Positive", "Negative", "Very Negative", "Neutral", "Positive", "Very Positive"]
    assert apply(spark, labels.tone_flag, [None, 0.0, -4.1, -4.0, 2.1], "double") == ["⚪", "⚪", "🔴", "🟡", "🟢"]
    assert apply(spark, labels.severity_tag, [None, -7.0, -4.0, -2.0, 5.0, 0.0], "double") == [
        "", "severe crisis", "crisis", "negative", "positive", ""]
    assert apply(spark, labels.sentiment_status, [None, -2.1, -2.0, 0.0, 2.0], "double") == [
        "STABLE", "ELEVATED", "MODERATE", "STABLE", "POSITIVE"]
    assert apply(spark, labels.mood_label, [None, -3.1, 3.0], "double") == ["Neutral", "Very Negative", "Very Positive"]
    df = spark.createDataFrame([(0.0, 0.0), (None, 2.0), (None, None), (1.0, 3.0)], "a double, b double")
    got = df.select(labels.dominant_emotion({"fear": F.col("a"), "anger": F.col("b")})).collect()
    assert [r[0] for r in got] == ["fear", "anger", None, "anger"]


def test_rounding(spark):
    assert apply(spark, lambda c: numeric.round_half_away(c, 2), [1.005, -0.125, 2.675, -0.001, None], "double") == [
        1.0, -0.13, 2.68, 0.0, None]
    assert apply(spark, numeric.to_double, ["1", " 2.5 ", "1e3", "1_0", "x", "", None, "1.5d"]) == [
        1.0, 2.5, 1000.0, None, None, None, None, None]


def test_search_terms(spark):
    check(spark, keywords.query_keywords, {
        "latest peace agreement news": ["peace", "agreement"],
        "What is THE border-security plan?": ["bordersecurity", "plan"],
        "a b cd": [],
        " ".join(f"word{i}" for i in range(12)): [f"word{i}" for i in range(12)],
        None: None,
    })
    check(spark, lambda q: keywords.query_keywords(q, 3), {"one two three four five": ["one", "two", "three"]})


def test_cosine(spark):
    rows = [([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [0.0, 3.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = [r[0] for r in df.select(vectors.cosine_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(1.0), pytest.approx(0.0), None, None]
