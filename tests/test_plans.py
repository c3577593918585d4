import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fixed
from tidemark.operators.filters import apply_filters, text_facts
from tidemark.operators import scorers
from tidemark.operators.scorers import AnalyzerScorer, LexiconScorer, ModelScorer, build_scorer, error_counts, without_errors
from tidemark.operators.tables import wrong_flags
from tidemark.plans.analyze import analyze, flag_posts, score
from tidemark.plans.prepare import prepare
from tidemark.plans.validate import validate_patterns
from tidemark.functions.patterns import pattern_flag
from tidemark.sources import readers, sinks
from tidemark.sources.schema import SchemaError, validate_posts

#: (period, kind, tone) -> posts. Talk of moderation goes from 20 of 500 to 50 of 500 and is negative in 8, then 35 of
#: them; trams are negative in half, ferries in a quarter of all posts of either period, and trams double.
COUNTS = {
    ("pre", "talk", "negative"): 8, ("pre", "talk", "positive"): 6, ("pre", "talk", "neutral"): 6,
    ("post", "talk", "negative"): 35, ("post", "talk", "positive"): 8, ("post", "talk", "neutral"): 7,
    ("pre", "tram", "negative"): 75, ("pre", "tram", "positive"): 40, ("pre", "tram", "neutral"): 35,
    ("post", "tram", "negative"): 150, ("post", "tram", "positive"): 80, ("post", "tram", "neutral"): 70,
    ("pre", "ferry", "negative"): 84, ("pre", "ferry", "positive"): 146, ("pre", "ferry", "neutral"): 100,
    ("post", "ferry", "negative"): 38, ("post", "ferry", "positive"): 70, ("post", "ferry", "neutral"): 42,
}
SENTENCES = {
    ("talk", "negative"): "they banned my account and it is awful", ("talk", "positive"): "my account was banned and that is great",
    ("talk", "neutral"): "they banned the account at noon",
    ("tram", "negative"): "this tram to the depot is awful", ("tram", "positive"): "this tram to the depot is great",
    ("tram", "neutral"): "the tram is at the depot",
    ("ferry", "negative"): "that ferry across the strait was awful", ("ferry", "positive"): "that ferry across the strait was great",
    ("ferry", "neutral"): "the ferry is on the strait",
}
FIRST_DAY = {"pre": "2021-03-0", "post": "2023-04-0"}


def study_rows():
    rows = []
    for (period, kind, tone), n in COUNTS.items():
        for i in range(n):
            to = "@ann_lee " if i % 10 == 0 else ""
            rows.append((f"{period}-{kind}-{tone}-{i}", f"{to}{SENTENCES[kind, tone]}, says number {period}{i}",
                         f"{FIRST_DAY[period]}{1 + i % 9}T0{i % 10}:30:00+00:00", f"author {i % 90}", str(int(kind == "talk")), tone))
    return rows + [
        (f"{period}-copy-{i}", "we sell and buy old tickets", f"{day}1T00:00:00+00:00", f"seller {period}", "0", "neutral")
        for period, day in FIRST_DAY.items() for i in range(12)]


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("raw") / "posts")
    schema = "post_id string, text string, created_at string, author string, true_moderation string, true_sentiment string"
    spark.createDataFrame(study_rows(), schema).write.option("header", True).option("escape", '"').csv(path)
    posts = readers.read_csv_posts(spark, path, "salt", source="study")
    sample, manifest = prepare(posts, n_per_period=480, seed=11)
    return sample, manifest, score(sample, build_scorer("lexicon"))


@pytest.fixture(scope="module")
def results(study):
    return analyze(study[2], n_topics=6, n_boot=100)


def test_prepare(study):
    sample, manifest, _ = study
    row = manifest.first()
    assert row.rows_per_period["pre"] == row.rows_per_period["post"] == row.n_per_period == 480
    assert row.filters["rows_in"] == 1024 and row.filters["rows_out"] == 1000
    assert row.filters["removed"] == {"repeated_author_text": {"pre": 12, "post": 12}}
    assert row.sources_per_period == {"pre": {"study": 480}, "post": {"study": 480}}
    assert row.date_range["pre"]["first"] < "2022-10-27" < row.date_range["post"]["first"] and row.cutoff == "2022-10-27"
    assert sample.count() == 960 and sample.filter("text like '%@ann%'").count() == 0
    assert sample.columns == ["post_id", "text", "created_at", "source", "author_hash", "true_moderation", "true_sentiment", "period"]


def test_prepare_does_not_depend_on_partitioning(spark, study):
    sample = study[0]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        again, _ = prepare(sample.drop("period").repartition(5), n_per_period=200, seed=3)
        ids = {r.post_id for r in again.select("post_id").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    first, _ = prepare(sample.drop("period"), n_per_period=200, seed=3)
    assert ids == {r.post_id for r in first.select("post_id").collect()} and len(ids) == 400


def test_analysis_finds_the_effects(results):
    share = results["moderation_share"].first()
    assert share.post > share.pre and share.diff_low > 0
    assert results["moderation_negative_share"].first()["diff"] > 0
    adjusted = results["negative_share_topic_adjusted"].first()
    assert adjusted.crude_diff > adjusted.standardized_diff and adjusted.ci_low < adjusted.standardized_diff < adjusted.ci_high
    truth = results["check_against_truth"].first()
    assert truth.moderation_precision > 0.95 and truth.moderation_recall > 0.95 and truth.sentiment_accuracy > 0.85
    assert [r.term for r in results["regression_negative"].collect()] == ["intercept", "post", "moderation", "post_x_moderation"]
    assert results["posts"].agg(F.sum("posts")).first()[0] == 960
    assert results["scorer_errors_excluded"].count() == 0 and results["scorer"].first().scorer == "lexicon"
    shares = results["sentiment_shares"].collect()
    assert len(shares) == 6 and sum(r.share for r in shares) == pytest.approx(2)
    topics = results["topic_prevalence"].collect()
    assert sum(r.pre_share for r in topics) == pytest.approx(1) and [r.topic for r in topics] == sorted(r.topic for r in topics)
    assert len(results["topics"].first().top_words) == 8


def test_report_and_scores_on_disk(spark, study, results, tmp_path):
    sinks.write_report(results, str(tmp_path))
    sinks.write_prepared(study[0], study[1], str(tmp_path))
    sinks.write_scores(study[2], str(tmp_path))
    row = spark.read.json(str(tmp_path / "report" / "sentiment_chi_square")).first()
    assert row.dof == 2 and 0 <= row.p_value <= 1
    assert spark.read.json(str(tmp_path / "manifest")).first().filters.rows_in == 1024
    scores = spark.read.parquet(str(tmp_path / "scores"))
    assert "text" not in scores.columns and scores.count() == 960


def test_scorer_errors_are_counted_and_excluded(study):
    scored = study[2]
    bad = F.col("post_id").isin([r.post_id for r in scored.orderBy("post_id").limit(10).collect()])
    broken = scored.withColumns({"sentiment": F.when(~bad, F.col("sentiment")), "status": F.when(bad, "error").otherwise("ok")})
    got = analyze(broken, n_topics=4, n_boot=20)
    assert got["scorer_errors_excluded"].agg(F.sum("errors")).first()[0] == 10
    assert got["posts"].agg(F.sum("posts")).first()[0] == 950
    assert {r.sentiment for r in got["sentiment_shares"].collect()} == set(fixed.SENTIMENTS)


def test_model_scorer_marks_a_failing_batch(spark):
    def toy_model():
        def predict(texts):
            if any("boom" in text for text in texts):
                raise RuntimeError("out of memory")
            good = np.array([0.8 if "good" in text else 0.1 for text in texts])
            return np.column_stack([0.9 - good, np.full(len(texts), 0.1), good])
        return predict

    rows = [(i, "boom" if i == 5 else "good" if i % 2 else "bad", None if i == 3 else 2**60 + i) for i in range(12)]
    df = spark.createDataFrame(rows, "i int, text string, big bigint").coalesce(1)
    scored = ModelScorer(toy_model, ["LABEL_0", "LABEL_1", "LABEL_2"], batch_size=4).score(df)
    assert scored.columns == ["i", "text", "big", "sentiment", "compound", "status"]
    got = {r.i: r for r in scored.collect()}
    assert [got[i].status for i in range(12)] == ["ok"] * 4 + ["error"] * 4 + ["ok"] * 4
    assert got[5].sentiment is None and got[5].compound is None and got[4].sentiment is None
    assert got[1].sentiment == "positive" and got[1].compound == pytest.approx(0.7) and got[0].sentiment == "negative"
    assert got[3].big is None and got[11].big == 2**60 + 11
    with_period = scored.withColumn("period", F.lit("pre"))
    assert error_counts(with_period).first().errors == 4 and without_errors(with_period).count() == 8
    with pytest.raises(ValueError):
        ModelScorer(toy_model, ["joy"])


@pytest.mark.parametrize("rows_at_once", [10_000, 7])
def test_batches_do_not_depend_on_partitions(spark, rows_at_once):
    def load():
        def predict(texts):
            if any("boom" in text for text in texts):
                raise RuntimeError("out of memory")
            return np.tile([0.1, 0.2, 0.7], (len(texts), 1))
        return predict

    rows = [(f"p{i:04d}", "boom" if i in (70, 400) else "fine") for i in range(500)] + [(None, "boom"), ("p0003", "twice")]
    df = spark.createDataFrame(rows, "post_id string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_at_once)
    try:
        failed = [sorted(str(r.post_id) for r in ModelScorer(load, ["negative", "neutral", "positive"], 64).score(df.repartition(n)).where("status = 'error'").collect())
                  for n in (1, 8, 200)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert failed[0] == failed[1] == failed[2]
    # the null id comes first and the repeated one counts: batches of 64 from 0, 64 and 384
    numbered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert failed[0] == sorted(str(r[0]) for b in range(8) if any(t == "boom" for _, t in numbered[64 * b:64 * b + 64]) for r in numbered[64 * b:64 * b + 64])


@pytest.mark.parametrize("shared", [0, 40, 1_500])
def test_texts_move_once_in_whole_batches(spark, monkeypatch, shared):
    """Before, a sorted table of all posts with their texts was written and dealt out again by batches."""
    from pathlib import Path

    def load():
        def predict(texts):
            if any("boom" in text for text in texts):
                raise RuntimeError("out of memory")
            return np.tile([0.1, 0.2, 0.7], (len(texts), 1))
        return predict

    monkeypatch.setattr(scorers, "RANGE_POSTS", 128, raising=False)
    rows = [(None if i < 3 else "q" if 700 <= i < 700 + shared else f"p{i:04d}", f"boom {i}" if i % 211 == 5 else f"fine {i * 7919 % 2_500}") for i in range(2_500)]
    df = spark.createDataFrame(rows, "post_id string, text string")
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    scored = ModelScorer(load, ["negative", "neutral", "positive"], 16).score(df.repartition(3))
    made = [spark.read.parquet(str(d)).columns for d in folder.iterdir() if d not in before]
    got = sorted((tuple(r) for r in scored.where("status = 'error'").select("post_id", "text").collect()), key=str)
    # only where many posts share an id, texts are sorted before they are dealt
    assert any("text" in columns for columns in made) == (shared > 1_000)
    numbered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    batches = [numbered[a:a + 16] for a in range(0, len(numbered), 16)]
    assert got == sorted((r for b in batches if any("boom" in t for _, t in b) for r in b), key=str)
    sizes = [r["count"] for r in scored.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2_500 and len(sizes) > 10 and max(sizes) <= 512


def test_analyzer_scorer(spark):
    df = spark.createDataFrame([("good",), ("x",), ("bad",)], "text string")
    scorer = AnalyzerScorer(lambda: lambda text: {"good": 0.5, "bad": -0.05}.get(text, 0.0))
    assert [r.sentiment for r in scorer.score(df).collect()] == ["positive", "neutral", "negative"]
    with pytest.raises(ImportError):
        build_scorer("vader")
    with pytest.raises(ValueError):
        build_scorer("bert")


def test_scores_need_no_exchange(spark):
    df = spark.createDataFrame([("they BANNED it, great!",)], "text string")
    scored = score(df, LexiconScorer())
    row = scored.first()
    assert (row.moderation, row.moderation_categories, row.sentiment, row.scorer) == (1, "account_action", "positive", "lexicon")
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
    assert score(spark.createDataFrame([("calm",)], "text string"), LexiconScorer()).first().moderation_categories == ""


def test_scores_of_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("banned again, awful",), ("great day",)], "text string").write.parquet(source)
    stream = spark.readStream.schema("text string").parquet(source)
    query = score(stream, LexiconScorer()).writeStream.format("memory").queryName("scored_stream").trigger(
        availableNow=True).start()
    query.awaitTermination(120)
    rows = {r.text: r for r in spark.table("scored_stream").collect()}
    assert rows["banned again, awful"].moderation == 1 and rows["great day"].sentiment == "positive"


def test_pattern_check(spark, tmp_path):
    path = tmp_path / "check.csv"
    yes = ["she got banned last night", "my tweet was removed", "they suspended my account", "so much for free speech", "a blue check costs money"]
    no = ["a turban and a bandage", "the cabana is open", "he removed the lid", "urbane people", "the bandage was removed slowly", "a husband at home"]
    path.write_text("text,label\n" + "".join(f"{t},{int(t in yes)}\n" for t in yes + no))
    checked = readers.read_check_set(spark, str(path))
    got = {r.flag: r for r in validate_patterns(checked).collect()}
    ours, base = got["patterns"], got["substring_baseline"]
    assert (ours.tp, ours.fp, ours.fn) == (5, 0, 0) and base.fp >= 4
    assert ours.n == checked.count() and ours.precision_low < ours.precision <= ours.precision_high
    wrong = wrong_flags(checked, pattern_flag(F.col("text")))
    assert wrong.filter("kind = 'false_positive'").count() == ours.fp


def test_pattern_check_edges(spark, tmp_path):
    none = spark.createDataFrame([("calm", 1), ("x", 0)], "text string, label int")
    row = validate_patterns(none).filter("flag = 'patterns'").first()
    assert row.precision is None and row.precision_low is None and row.recall == 0 and row.f1 == 0
    for content in ("text,label\nx,2\n", "text,label\nx,\n", "text\nx\n"):
        path = tmp_path / f"check{len(content)}.csv"
        path.write_text(content)
        with pytest.raises(ValueError):
            readers.read_check_set(spark, str(path))


def test_flag_posts(spark):
    df = spark.createDataFrame([("my account got suspended",)], "text string")
    row = flag_posts(df).first()
    assert row.flagged and row.categories == ["account_action"] and row.terms == ["account got suspended"]
    assert json.loads(flag_posts(df).toJSON().first())["flagged"] is True


def test_prepare_checks_posts_in_the_scan_of_the_rules(spark, tmp_path):
    schema = "post_id string, text string, created_at timestamp, source string, author_hash string"
    day = {"pre": datetime(2021, 5, 1), "post": datetime(2023, 5, 1)}
    rows = [(f"{p}{i}", f"that is the story of {p} and number {i}", day[p], "s", f"a{i}") for p in day for i in range(6)]
    # a blank post may lack a time and may share an id
    blank = [("pre0", " ", None, "s", "b"), ("x", None, None, "s", "b")]
    path = str(tmp_path / "posts")
    spark.createDataFrame(rows + blank, schema).write.parquet(path)
    posts = spark.read.parquet(path)
    sample, manifest = prepare(posts, n_per_period=4, seed=2)
    checked, from_checked = prepare(validate_posts(posts), n_per_period=4, seed=2, validated=True)
    assert sorted(sample.collect()) == sorted(checked.collect()) and sample.count() == 8
    assert manifest.first() == from_checked.first() and manifest.first().filters.rows_in == 12
    for bad in ([("pre1", "it is the other text", day["pre"], "s", "c")], [("y", "it is a text without a time", None, "s", "c")]):
        with pytest.raises(SchemaError):
            prepare(posts.union(spark.createDataFrame(bad, schema)), n_per_period=4)
    with pytest.raises(SchemaError):
        prepare(posts.drop("author_hash"))


def test_filters_on_facts_need_no_text(spark):
    texts = ["that is the story of one", "THAT is the story of one!", "", None, "quiero comer ahora mismo algo rico", "it was the end of that"] * 3
    df = spark.createDataFrame([(f"p{i:02d}", t, f"a{i % 4}", "pre") for i, t in enumerate(texts)], "post_id string, text string, author_hash string, period string")
    whole = apply_filters(df, max_copies=2, keep=["post_id"])
    facts = df.withColumns(text_facts(F.col("text"))).drop("text")
    slim = apply_filters(facts, max_copies=2, keep=["post_id"])
    for name in ("survivors", "removed", "totals"):
        assert sorted(getattr(whole, name).collect()) == sorted(getattr(slim, name).collect())
