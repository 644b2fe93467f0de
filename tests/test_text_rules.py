"""Text, relevance and safety rules on synthetic cases."""

import pytest
from pyspark.sql import functions as F

from beaconry import dims
from beaconry.functions import text as ft
from beaconry.operators import relevance, rules, text
from beaconry.operators import warnings_archive as wa
from beaconry.operators.geo import edges_of


def one(spark, column, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("HTTP://User:pw@News.Example.ORG.:80/a?utm_source=x&b=2&&a=1#top", "http://news.example.org/a?a=1&b=2"),
        ("https://example.org", "https://example.org/"),
        ("https://example.org:8443/x?GCLID=1", "https://example.org:8443/x"),
        ("https://example.org/app#!/route", "https://example.org/app#!/route"),
        ("https://[2001:DB8::1]:443/", "https://[2001:db8::1]/"),
        ("https://example.org:/x", "https://example.org/x"),
    ],
)
def test_canonical_url(spark, raw, expected):
    canonical = text.canonical_url(F.col("v"))["canonical"]
    assert one(spark, canonical, raw) == expected
    assert one(spark, canonical, expected) == expected


@pytest.mark.parametrize(("raw", "why"), [("ftp://a.org/", "scheme"), ("http:///x", "host"), ("http://a.org:99999/", "unparseable"), ("http://a.org:x/", "unparseable"), ("mailto:a@b.org", "scheme")])
def test_rejected_url(spark, raw, why):
    assert one(spark, text.canonical_url(F.col("v"))["reason"], raw) == why


@pytest.mark.parametrize(
    ("link", "expected"),
    [("/x", "https://a.org/x"), ("y?p=1", "https://a.org/f/y?p=1"), ("../z", "https://a.org/z"), ("//b.org/q", "https://b.org/q"), ("?k=2", "https://a.org/f/feed.xml?k=2"), ("./w/", "https://a.org/f/w/")],
)
def test_resolve_link(spark, link, expected):
    assert one(spark, text.resolve_link(F.lit("https://a.org/f/feed.xml"), F.col("v")), link) == expected


def test_fold_and_squash(spark):
    folded = ft.fold(ft.squash(F.col("v")))
    assert one(spark, folded, "  İran \tIRAN  ırak Ağrı Straße ə ﬁ") == "iran iran irak agri strasse e fi"
    assert one(spark, ft.squash(F.col("v")), "é  x") == "é x"


def test_markup_and_excerpt(spark):
    page = '<p>One&nbsp;&eacute;</p><script>var a="</p>";</script>two<br/>three &amp;lt; <b>fo</b>ur<!-- x -->'
    assert one(spark, ft.strip_markup(F.col("v")), page) == "One é two three &lt; four"
    assert one(spark, ft.excerpt(F.col("v"), 20), "aaaa bbbb cccc dddd eeee") == "aaaa bbbb cccc…"
    assert one(spark, ft.excerpt(F.col("v"), 10), "abcdefghijklmnop") == "abcdefghi…"


def test_dates(spark):
    parsed = F.date_format(text.parse_date(F.col("v")), "yyyy-MM-dd HH:mm:ss")
    for raw, expected in (("Wed, 03 Jan 2024 10:00:00 +0300", "2024-01-03 07:00:00"), ("2024-01-03T10:00:00Z", "2024-01-03 10:00:00"), ("3 Jan 2024 10:00:00 GMT", "2024-01-03 10:00:00"), ("soon", None)):
        assert one(spark, parsed, raw) == expected


VOCABULARY = relevance.Vocabulary(
    {"alpha": ["red lake", "red lake north", "delta*"], "beta": ["blue hill"]},
    {"move": ["march*"], "shut": ["closed"]},
    {"region": 0.5, "topic": 0.5, "title": 1.0, "text": 0.4, "feed_region": 0.5}, 0.5, 0.1, ("old red lake",),
)


def assess(spark, title, body, prior=None):
    rows = spark.createDataFrame([(title, body, prior)], "title string, text string, feed_region string")
    return relevance.outcome(relevance.score(rows, VOCABULARY), VOCABULARY.threshold, VOCABULARY.margin).first()


def test_relevance_cases(spark):
    assert assess(spark, "Red Lake closed", "").score == 1.0
    assert assess(spark, "x", "red lake closed").score == 0.4 and assess(spark, "x", "red lake closed").borderline
    assert assess(spark, "Red Lake", "nothing").score == 0.0  # region without topic
    assert assess(spark, "closed", "nothing").score == 0.0  # topic without region
    assert assess(spark, "closed", "", "beta").score == 0.75  # feed prior
    assert assess(spark, "old red lake closed", "").region is None  # blanked before region matching
    assert assess(spark, "x", "deltas deltawing marched").terms == ["deltas", "deltawing"]  # one prefix, two strings
    assert assess(spark, "redlake closed", "").region is None  # word bounded
    assert assess(spark, "x", "red lake north closed").terms == ["red lake north"]  # longest first


def test_safety_order_and_counts(spark):
    fence = edges_of(spark.createDataFrame([(1, 0, [(10.0, 10.0), (12.0, 10.0), (12.0, 12.0), (10.0, 12.0)])], "poly_id int, ring_id int, points array<struct<lon:double,lat:double>>"))
    cases = [
        ("adsb", "0x4A0000", None, 50.0, 5.0, "protected_block"), ("ADSB ", "4a1000", None, 50.0, 5.0, None), ("adsb", "~4a000", None, 50.0, 5.0, "invalid_address"),
        ("adsb", "4b0000", None, None, None, "missing_position"), ("ais", None, "399123456", 50.0, 5.0, "protected_code"), ("ais", None, "003991234", 50.0, 5.0, "protected_code"),
        ("ais", None, "111399123", 50.0, 5.0, "protected_code"), ("ais", None, "970123456", 50.0, 5.0, "invalid_station"), ("ais", None, "201123456", 50.0, 5.0, None),
        ("signal", None, None, None, None, None), ("signal", None, None, 50.0, None, "invalid_position"), ("signal", None, None, 95.0, 5.0, "invalid_position"),
        ("signal", None, None, float("nan"), 5.0, "invalid_position"), ("signal", None, None, 11.0, 11.0, "in_fence"), ("signal", None, None, 12.1, 11.0, "in_fence"), ("signal", None, None, 12.6, 11.0, None),
    ]
    rows = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(cases)], "id int, kind string, hex_id string, station_id string, lat double, lon double")
    blocks = dims.table(spark, dims.PROTECTED_BLOCKS, "first int, last int")
    judged = rules.safety_reasons(rows, blocks, dims.PROTECTED_CODES, fence, 23.5, dims.KINDS_WITH_POSITION)
    assert {r.id: r.reason for r in judged.collect()} == {i: c[5] for i, c in enumerate(cases)}
    assert sum(r.n for r in rules.reason_counts(judged).collect()) == len(cases)


def test_warning_positions_and_activity(spark):
    message = "AREA 41-15.60N 007-30.90W 41 15.60 N 007 30.90 W 4115,60N/00730,90W 41-15-36N 007-30-55W 95-00N 010-00E"
    found = one(spark, wa.positions_of(F.col("v")), message)
    assert [(p.lat, p.lon) for p in found] == [(41.26, -7.515), (41.26, -7.515278)]
    assert one(spark, wa.activity_of(F.col("v"), dims.ACTIVITIES), "night drill after target practice") == "shooting"
    assert one(spark, wa.cancellation_only(F.col("v")), "CANCEL NAVWARN 12/24.") is True
    assert one(spark, wa.cancellation_only(F.col("v")), "IN POSITION X. CANCEL 12/24.") is False


def test_strict_refuses_the_batch(spark):
    rows = spark.createDataFrame([(1, "https://a"), (2, "ftp://a")], "id int, url string")
    findings = rules.validate(rows, "id", {"url": "url like 'http%'"})
    assert [tuple(r) for r in findings.collect()] == [(2, "url")]
    with pytest.raises(rules.RefusedBatch):
        rules.strict(rows, findings)


def test_places_are_read_from_their_parts(spark):
    exact = ["36.8021 N", "36,8021°N x", "at 7.123 e.", "36° 48' N", "36 °48′", "grid 37S DH 1234 5678", "37SDH12", "(37S DH1234)"]
    loose = ["36.80 N", "1234.567 N", "36.8021 North", "v36.8021 N", "36° N", "° 48'", "36° x 48'", "37S", "37S DI 12", "37I DH 12", "137S DH 12", "37S DH 1", "", "plain 3.14159"]
    rows = spark.createDataFrame([(t, True) for t in exact] + [(t, False) for t in loose], "t string, want boolean")
    assert [r.t for r in rows.where(text.names_a_place(F.col("t")) != F.col("want")).collect()] == []


def test_headings_are_told_by_their_words(spark):
    good = wa.heading_of(F.split(F.col("v"), " "))
    found = one(spark, good, "x zczc fa07 101530 utc mar 24LIME rest")
    assert (found.station, found.subject, found.serial, found.time, found.month, found.year, found.text) == ("F", "A", "07", "101530", "MAR", "24", "zczc fa07 101530 utc mar 24")
    for other in ("ZCZC FA0 101530 UTC MAR 24", "ZCZC FA07 10153 UTC MAR 24", "ZCZC FA07 101530 GMT MAR 24", "ZCZC FA07 101530 UTC MARCH 24", "ZCZC FA07", "FA07 101530 UTC MAR 24", ""):
        assert one(spark, good, other) is None


def test_entity_names_become_numbers(spark):
    from beaconry.sources.feeds import _numeric_entities

    for raw, expected in (("a&eacute;b &amp; &lt;&nosuch; &Eacute &;& x", "a&#233;b &amp; &lt;&nosuch; &Eacute &;& x"), ("plain", "plain"), ("&nbsp;", "&#160;")):
        assert one(spark, _numeric_entities(F.col("v")), raw) == expected


def test_references_without_a_semicolon_stay(spark):
    assert one(spark, ft.strip_markup(F.col("v")), "a&amp b &notit; &copy; &amp;lt; &#65; &#x42; &eacute;") == "a&amp b &notit; © &lt; A B é"
