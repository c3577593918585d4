import hashlib
import hmac
import math
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fixed
from tidemark.functions import patterns, privacy, sentiment, text, times


def test_mask_keeps_mails_and_takes_accented_handles(each):
    texts = ["hi @Ann_B see https://a.b/c NOT ok!", "mail me@site.org", "@é and @x@y", "HTTPS://A.B www.c.d end", "x@y @@z"]
    assert each(text.mask_text, texts) == [
        "hi @user see http NOT ok!", "mail me@site.org", "@user and @user@y", "http http end", "x@y @@z"]


def test_light_clean_decodes_in_order_and_collapses_space(each):
    texts = ["Never board with @carl_9 again!! https://q.rs/t &amp; so on", "p &amp;gt; q", "\n one \t  two ", ""]
    assert each(text.light_clean, texts) == ["Never board with @user again!! http & so on", "p > q", "one two", ""]


def test_topic_view_drops_stop_words_and_short_words(each):
    assert each(text.topic_tokens, ["A slow tram", "we were on the slow tram", "o'clock trams 9x"]) == [
        ["slow", "tram"], ["slow", "tram"], ["o'clock", "trams"]]


def test_dedupe_key_is_unicode(each):
    assert each(text.dedupe_key, ["The game, was FUN!", "café—Été", "...", "a_b"]) == ["the game was fun", "café été", "", "a_b"]


def test_blank(each):
    assert each(text.is_blank, ["", " \t\n ", None, "x", " x"]) == [True, True, True, False, False]


def test_english(each):
    cases = ["this is fine", "das ist gut", "это the", "12 34", "", "THE café", "then theory"]
    assert each(text.is_english, cases) == [True, False, False, False, False, True, False]
    assert each(lambda c: text.is_english(c, min_hits=2), ["the cat", "the the cat"]) == [False, True]


def test_spam(each):
    tags = " ".join(f"#tag{i}" for i in range(6))
    cases = {tags: True, "#one #two": False, "bitcoin for free": False, "free and easy bitcoin": True, "carefree bitcoin": False,
             "http http http": True, "http http": False, "please follow me, then retweet": True, "a quiet walk": False}
    assert each(text.is_spam, list(cases)) == list(cases.values())


def test_confounders(spark):
    df = spark.createDataFrame([(" two  words #x #y @user http",)], "text string")
    row = df.select(*[c.alias(n) for n, c in text.confounders(F.col("text")).items()]).first()
    assert row.asDict() == {"length_words": 6, "has_link": 1, "has_mention": 1, "hashtags": 2}


def test_author_hash(spark):
    names = ["Bob", " bob ", "", None, "  ", "x", "Élan"]
    df = spark.createDataFrame(list(enumerate(names)), "i int, a string")
    rows = df.select("i", privacy.hash_author(F.col("a"), "k").alias("h"),
                     privacy.hash_author_native(F.col("a"), "k").alias("n")).orderBy("i").collect()
    want = hmac.new(b"k", b"bob", hashlib.sha256).hexdigest()[:16]
    assert [r.h for r in rows][:5] == [want, want, "", "", ""]
    assert len(rows[5].h) == 16 and all(r.h == r.n for r in rows)


def test_salt_is_not_in_the_plan(spark):
    df = spark.createDataFrame([("a",)], "a string").select(privacy.hash_author(F.col("a"), "s3cret-salt"))
    assert "s3cret" not in df._jdf.queryExecution().toString()


def test_times_of_mixed_layouts_are_utc(spark, each):
    cases = {
        "2022-10-26 23:59": "2022-10-26 23:59:00", "2022-10-27T00:00:00Z": "2022-10-27 00:00:00",
        "2022-10-27T02:00:00+02:00": "2022-10-27 00:00:00", "2022-10-27T02:00:00+0200": "2022-10-27 00:00:00",
        "2022-10-27": "2022-10-27 00:00:00", "2022/10/27 01:02:03": "2022-10-27 01:02:03",
        "Thu Oct 27 01:02:03 +0000 2022": "2022-10-27 01:02:03", "Thu, 27 Oct 2022 01:02:03 +0000": "2022-10-27 01:02:03",
        "10/27/2022": "2022-10-27 00:00:00", "2022-10-27 01:02:03.5": "2022-10-27 01:02:03.5", "Oct 27, 2022": "2022-10-27 00:00:00",
        "not a time": None, "": None, "2022-13-45": None, "12:30": None,
    }
    try:
        for zone in ("UTC", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = each(lambda c: F.unix_micros(times.parse_time(c)), list(cases))
            want = [None if v is None else int(datetime.fromisoformat(v).replace(tzinfo=timezone.utc).timestamp() * 1e6)
                    for v in cases.values()]
            assert got == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_period_edge_is_utc_midnight(spark, kind):
    df = spark.createDataFrame([("2022-10-26 23:59:59",), ("2022-10-27 00:00:00",)], "t string")
    df = df.select(F.col("t").cast(kind).alias("created_at"))
    rows = times.assign_period(df, date(2022, 10, 27)).orderBy("created_at").collect()
    assert [r.period for r in rows] == ["pre", "post"]


#: points by hand: a valence times 1.5 in capitals, 1.3 behind an intensifier, -0.74 behind a negator, 0.5 before
#: and 1.5 behind "but", and 0.292 for each of up to three exclamation marks in the direction of the sum
GOOD, BAD = fixed.VALENCE["good"], fixed.VALENCE["bad"]
POINTS = {
    "": 0, "!!": 0, "tram": 0, "good": GOOD, "GOOD": GOOD, "a GOOD tram": 1.5 * GOOD, "very good": 1.3 * GOOD, "not good": -0.74 * GOOD,
    "not a very good tram": -0.74 * 1.3 * GOOD, "good!": GOOD + 0.292, "good!!!!!": GOOD + 3 * 0.292, "bad!!": BAD - 2 * 0.292,
    "good but bad": 0.5 * GOOD + 1.5 * BAD, "bad but good but good": 0.5 * BAD + 3 * GOOD, "good good": 2 * GOOD, "über-good": GOOD,
}


def test_lexicon_points_by_hand(each):
    got = each(sentiment.lexicon_compound, list(POINTS))
    for value, (post, points) in zip(got, POINTS.items()):
        assert value == pytest.approx(points / math.sqrt(points * points + 15), abs=1e-12), post


def test_lexicon_rules(each):
    score = sentiment.lexicon_compound
    plain, more = each(score, ["a good ride", "a good good ride"])
    assert -1 < plain < more < 1
    labels = each(lambda c: sentiment.label_from_compound(score(c)), ["good ride", "the tram leaves at six", "bad ride"])
    assert labels == ["positive", "neutral", "negative"]


def test_label_bounds_are_inclusive(spark):
    df = spark.createDataFrame([(0.05,), (-0.05,), (0.0499,), (None,)], "c double")
    assert [r[0] for r in df.select(sentiment.label_from_compound(F.col("c"))).collect()] == ["positive", "negative", "neutral", None]


def test_label_maps(each):
    assert each(sentiment.source_label, ["0", "2", "4", "7", None]) == ["negative", "neutral", "positive", None, None]
    assert [sentiment.normalize_label(x) for x in ("LABEL_0", " label_1", "LABEL_2", "Positive", "neg")] == [
        "negative", "neutral", "positive", "positive", "negative"]
    with pytest.raises(ValueError):
        sentiment.normalize_label("joy")


def test_word_boundaries(each):
    inside = ["bandage", "turban", "a husband", "caravans"]
    assert each(patterns.pattern_flag, inside) == [False] * len(inside)
    assert each(patterns.pattern_flag, ["éban", "ban!", "_ban", "one ban."]) == [False, True, False, True]


def test_match_lists_categories_and_terms(one):
    match = one(patterns.pattern_match, "Banned on Monday, BANNED again; my tweet was removed, so much for free speech")
    assert match.flagged and match.categories == ["account_action", "content_action", "policy_and_speech"]
    assert match.terms == ["banned", "tweet was removed", "free speech"]
    chosen = patterns.choose_categories(["verification"])
    assert one(lambda c: patterns.pattern_flag(c, chosen), "everyone buys blue checks") is True
    assert one(patterns.pattern_match, "a ferry at dawn").categories == []
    with pytest.raises(ValueError):
        patterns.choose_categories(["spam"])
