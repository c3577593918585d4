"""One query per operator over the given tables. Every query reads its tables whole.

``documents`` serve as posts: the language stands in for the author, so copies share one, and the day is a
fixed function of the id. The corpus holds almost none of the default lexicon and pattern words, so the queries
pass word lists of its own next to the defaults. Doubles are rounded here, at the boundary, and nowhere else.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fixed
from tidemark.functions import patterns, privacy, sentiment, text, times
from tidemark.functions.intervals import wilson
from tidemark.operators import bootstrap, quantiles, regression, sampling, scorers, tables, topics
from tidemark.operators.filters import apply_filters
from tidemark.plans.analyze import analyze, flag_posts, score
from tidemark.plans.prepare import prepare
from tidemark.plans.validate import validate_patterns
from tidemark.sources import readers, sinks
from tidemark.sources.schema import drop_blank, post_violations
from tidemark.sizes import spread
from tidemark.storage import work_path

SALT = "public-test-salt"
EVENTS_CUTOFF = date(2024, 1, 16)
COPIES = 2
PER_PERIOD = 300
PER_PARTITION = 50_000  # posts that a query asks one task to read
ALL_POSTS = 10**9  # studies use every post that the rules keep, as many in both periods
VALENCE = {
    "that": 1.1, "with": -1.3, "this": 0.7, "are": -0.9, "was": -0.4, "der": 0.5, "la": -0.6, "best": 3.2,
    "worthless": -2.8, "pathetic": -2.4, "stupid": -2.6, "idiot": -2.9, "trash": -2.2,
}
NEGATORS = ("no", "of", "de")
INTENSIFIERS = ("the", "to", "is")
CATEGORIES = {
    "insult": ("worthless", "pathetic", "stupid", "idiots?", "trash(?:ed|y)?"),
    "function": ("th(?:at|is) (?:on|in|the)", "with[- ]?the", "by the"),
    "rights": ("licen[cs]e(?:d|s)?", "copyright"),
}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def posts(spark: SparkSession, folder: str, texts: bool = True) -> DataFrame:
    """The post view. Queries that work on texts use all cores, also where the table is one small file."""
    documents = table(spark, folder, "documents")
    day = F.expr("TIMESTAMP_NTZ '2021-06-01 00:00:00' + make_dt_interval(CAST(doc_id * 37 % 1000 AS INT))")
    return (spread(documents, "doc_id") if texts else documents).select(
        F.concat("source", F.lit(":"), F.col("doc_id").cast("string")).alias("post_id"), "text",
        day.alias("created_at"), "source", F.col("lang").alias("author_hash"), "doc_id", "lang")


def dated(spark: SparkSession, folder: str, texts: bool = True) -> DataFrame:
    return times.assign_period(posts(spark, folder, texts))


def labelled(spark: SparkSession, folder: str, texts: bool = True) -> DataFrame:
    """Posts with their labels. One label per document at most, so the join keeps the rows of the labels."""
    return dated(spark, folder, texts).join(table(spark, folder, "labels"), "doc_id")


def study_posts(spark: SparkSession, folder: str) -> DataFrame:
    return posts(spark, folder).select(*fixed.POST_COLUMNS)


def in_partitions(df: DataFrame, parts: int) -> DataFrame:
    """The rows in ``parts`` partitions, or so many times more that ``parts`` of them hold ``PER_PARTITION`` rows each."""
    return df.repartition(parts * max(1, -(-df.count() // PER_PARTITION)))


def r6(column: Column) -> Column:
    return F.round(column, 6) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    doubles = {f.name for f in df.schema if f.dataType.simpleString() == "double"}
    return df.select(*[r6(F.col(name)).alias(name) if name in doubles else F.col(name) for name in df.columns])


def with_but(column: str = "text") -> Column:
    """The corpus has no "but"; one of its words becomes it."""
    return F.replace(F.col(column), F.lit(" from "), F.lit(" but "))


def corpus_compound(column: Column) -> Column:
    return sentiment.lexicon_compound(column, VALENCE, NEGATORS, INTENSIFIERS)


def corpus_scorer() -> scorers.LexiconScorer:
    return scorers.LexiconScorer(VALENCE, NEGATORS, INTENSIFIERS)


# --- text, time, privacy --------------------------------------------------------------------


@query
def mask_text(spark, folder):
    links = F.concat("text", F.lit(" see @"), "lang", F.lit("_x and HTTPS://a.b/"), "source")
    return posts(spark, folder).select("post_id", text.mask_text(links).alias("masked"))


@query
def light_clean(spark, folder):
    marked = F.concat(F.lit(" \t"), "text", F.lit(" &amp;lt; &gt;\n www.a.b "))
    return posts(spark, folder).select("post_id", text.light_clean(marked).alias("light"))


@query
def topic_tokens(spark, folder):
    tokens = text.topic_tokens(F.col("text"))
    return posts(spark, folder).select(
        "post_id", F.size(tokens).cast("bigint").alias("n"), F.array_join(tokens, " ").alias("tokens"))


@query
def dedupe_key(spark, folder):
    return posts(spark, folder).select("post_id", text.dedupe_key(F.col("text")).alias("key"))


@query
def hash_author(spark, folder):
    author = F.concat(F.lit(" "), F.upper("lang"), F.lit("-"), (F.col("doc_id") % 97).cast("string"))
    blank_some = F.when(F.col("doc_id") % 11 != 0, author)
    return posts(spark, folder, texts=False).select("post_id", privacy.hash_author(blank_some, SALT).alias("author_hash"))


@query
def parse_times(spark, folder):
    stamp = F.col("created_at")
    layouts = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy", "'on' yyyy"]
    written = F.date_format(stamp, layouts[0])
    for at, layout in enumerate(layouts[1:], 1):
        written = F.when(F.col("doc_id") % 5 == at, F.date_format(stamp, layout)).otherwise(written)
    return posts(spark, folder, texts=False).select("post_id", F.unix_seconds(times.parse_time(written)).alias("seconds"))


@query
def period_counts(spark, folder):
    return dated(spark, folder, texts=False).groupBy("period").agg(F.count("*").alias("n"))


@query
def english_and_spam(spark, folder):
    loud = F.concat("text", F.when(F.col("doc_id") % 7 == 0, " Win a nice new NFT").when(
        F.col("doc_id") % 7 == 1, " follow back or DM").when(F.col("doc_id") % 7 == 2, " click the link, earn$5").when(
        F.col("doc_id") % 7 == 3, " http http HTTP").otherwise(" freely bitcoin"))
    return posts(spark, folder).select(
        "post_id", text.is_english(F.col("text")).alias("english"),
        text.is_english(F.col("text"), min_hits=5).alias("english_5"), text.is_spam(F.col("text")).alias("spam"),
        text.is_spam(loud).alias("spam_loud"))


@query
def confounder_features(spark, folder):
    features = text.confounders(text.mask_text(F.col("text")))
    return posts(spark, folder).select(
        "post_id", *[column.cast("bigint").alias(name) for name, column in features.items()])


# --- sources and sinks ----------------------------------------------------------------------


def _labels_file(spark: SparkSession, folder: str) -> str:
    """The documents written the way the labelled corpus comes: no header, latin-1, zone name, everything quoted."""
    path = work_path(spark, "corpus")
    joined = posts(spark, folder).join(table(spark, folder, "labels"), "doc_id", "left")
    target = F.coalesce((F.col("quality") * 4 + F.col("toxic")).cast("string"), F.lit("2"))
    joined.select(
        target.alias("target"), F.col("doc_id").cast("string").alias("id"),
        F.date_format("created_at", "EEE MMM dd HH:mm:ss 'PDT' yyyy").alias("date"), F.lit("NO_QUERY").alias("flag"),
        F.col("lang").alias("user"), F.translate("text", "\n", " ").alias("text"),
    ).write.option("encoding", "ISO-8859-1").option("escape", '"').option("quoteAll", True).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


@query
def read_labelled_corpus(spark, folder):
    read = readers.read_labelled_csv(spark, _labels_file(spark, folder), SALT)
    return read.select("post_id", "text", F.unix_seconds("created_at").alias("seconds"), "source", "author_hash", "source_label")


def _chunk_file(spark: SparkSession, folder: str) -> str:
    path = work_path(spark, "chunk")
    turns = table(spark, folder, "conversations")
    turns.select("text", F.lit("2023-05-01T10:00:00Z").alias("datetime"), F.col("role").alias("username"),
                 F.concat_ws("-", "conv_id", "turn").alias("uri")).write.parquet(path)
    return path


@query
def read_parquet_chunk(spark, folder):
    read = readers.read_parquet_posts(spark, _chunk_file(spark, folder), SALT)
    return read.select(F.substring_index("post_id", ":", -1).alias("uri"), "text",
                       F.unix_seconds("created_at").alias("seconds"), "author_hash")


def _own_file(spark: SparkSession, folder: str) -> str:
    path = work_path(spark, "own")
    table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("post_id"), "text", F.col("lang").alias("author"),
        F.lit("2022-11-05 08:30:00").alias("created_at"), (F.col("doc_id") % 2).cast("string").alias("true_moderation"),
    ).write.option("header", True).option("escape", '"').option("quoteAll", True).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


@query
def read_own_csv(spark, folder):
    read = readers.read_csv_posts(spark, _own_file(spark, folder), SALT, source="own")
    return read.select("post_id", "text", F.unix_seconds("created_at").alias("seconds"), "source", "author_hash", "true_moderation")


@query
def read_csv_without_ids(spark, folder):
    """Posts of a CSV whose records hold quoted line breaks, quotes and commas; ids come from file and line."""
    path = work_path(spark, "lines")
    broken = F.concat(F.col("lang"), F.lit(' "said",\n\n"'), F.col("text"), F.lit('"\n'))
    table(spark, folder, "documents").select(broken.alias("text"), F.lit("2022-11-05 08:30:00").alias("created_at")).write.option(
        "header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.read_csv_posts(spark, path, SALT, source="lines").groupBy("text").agg(
        F.count("*").alias("posts"), F.count_distinct("post_id").alias("ids"), F.unix_seconds(F.max("created_at")).alias("seconds"))


@query
def union_of_sources(spark, folder):
    specs = [f"csv={_own_file(spark, folder)}", f"x_parquet={_chunk_file(spark, folder)}",
             f"sentiment140={_labels_file(spark, folder)}"]
    kind = F.when(F.col("source").startswith("x_"), "parquet").when(F.col("source") == "sentiment140", "labelled")
    return readers.read_sources(spark, specs, SALT).groupBy(kind.otherwise("own").alias("kind")).agg(
        F.count("*").alias("posts"), F.count("source_label").alias("labels"),
        F.count("true_moderation").alias("truths"), F.count_distinct("author_hash").alias("authors"))


@query
def post_checks(spark, folder):
    """Violations in a copy of the posts with blank texts, missing times and repeated ids."""
    broken = posts(spark, folder).select(
        (F.col("doc_id") % 900).cast("string").alias("post_id"),
        F.when(F.col("doc_id") % 50 == 0, " \n\t").otherwise(F.col("text")).alias("text"),
        F.when(F.col("doc_id") % 31 != 0, F.col("created_at")).alias("created_at"), "source", "author_hash")
    return post_violations(broken)


@query
def prepared_round_trip(spark, folder):
    path = work_path(spark, "prepared")
    sample, manifest_row = prepare(study_posts(spark, folder), n_per_period=ALL_POSTS, max_copies=COPIES)
    sinks.write_prepared(sample, manifest_row, path)
    return sinks.read_prepared(spark, path).select("post_id", "text", "period", "source", "author_hash")


@query
def scores_without_text(spark, folder):
    path = work_path(spark, "scores")
    sinks.write_scores(score(dated(spark, folder).drop("doc_id", "lang"), corpus_scorer(), CATEGORIES), path)
    return rounded(spark.read.parquet(f"{path}/scores").drop("created_at"))


@query
def report_round_trip(spark, folder):
    path = work_path(spark, "report")
    scored = score(dated(spark, folder), corpus_scorer(), CATEGORIES)
    sinks.write_report({"sentiment_shares": tables.sentiment_shares(scored)}, path)
    return rounded(spark.read.schema(
        "period string, sentiment string, count bigint, share double, ci_low double, ci_high double"
    ).json(f"{path}/report/sentiment_shares"))


# --- quality rules and sampling -------------------------------------------------------------


@query
def drop_blank_posts(spark, folder):
    blanked = posts(spark, folder).withColumn("text", F.when(F.col("doc_id") % 9 == 0, " \n").otherwise(F.col("text")))
    return drop_blank(blanked).groupBy("lang").agg(F.count("*").alias("n"))


@query
def filter_report(spark, folder):
    return apply_filters(dated(spark, folder), COPIES, keep=["post_id"]).removed


@query
def filter_totals(spark, folder):
    return apply_filters(dated(spark, folder), COPIES, keep=["post_id"]).totals


@query
def filtered_posts(spark, folder):
    return apply_filters(dated(spark, folder), COPIES).survivors.select("post_id", "period", "lang", "text")


@query
def filter_report_missing_authors(spark, folder):
    """Two thirds of the authors and every eleventh text are missing; every fifth document carries one and the same text."""
    frame = dated(spark, folder).withColumns({
        "text": F.when(F.col("doc_id") % 5 == 0, "It is the same text").when(F.col("doc_id") % 11 != 0, F.col("text")),
        "author_hash": F.when(F.col("doc_id") % 3 == 0, F.col("lang"))})
    result = apply_filters(frame, COPIES, keep=["post_id"])
    rows = result.totals.select(F.inline(F.array(
        F.struct(F.lit("rows in").alias("rule"), F.lit("all").alias("period"), F.col("rows_in").alias("removed")),
        F.struct(F.lit("rows out").alias("rule"), F.lit("all").alias("period"), F.col("rows_out").alias("removed")))))
    return result.removed.unionByName(rows)


@query
def filter_report_hot_text(spark, folder):
    """Every third document carries one and the same text, every sixth an empty one."""
    hot = F.when(F.col("doc_id") % 6 == 0, "").when(F.col("doc_id") % 3 == 0, "It is the HOT text!").otherwise(F.col("text"))
    frame = dated(spark, folder).withColumns({
        "text": hot, "author_hash": F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("lang"))})
    return apply_filters(frame, COPIES, keep=["post_id"]).removed


@query
def balanced_sample(spark, folder):
    return sampling.balanced_periods(dated(spark, folder, texts=False), PER_PERIOD).select("post_id", "period")


@query
def stratified_sample(spark, folder):
    return sampling.balanced_periods(dated(spark, folder, texts=False), 75, stratify="lang").select("post_id", "period", "lang")


@query
def single_sample(spark, folder):
    return sampling.sample_posts(table(spark, folder, "events"), 777, seed=3, id_col="event_id").select("event_id", "event_type")


@query
def sortedness_of_languages(spark, folder):
    return rounded(sampling.sortedness(table(spark, folder, "documents"), "lang", ["doc_id"]))


@query
def sortedness_of_events(spark, folder):
    return rounded(sampling.sortedness(table(spark, folder, "events"), "event_type", ["ts", "event_id"]))


# --- sentiment and patterns -----------------------------------------------------------------


@query
def lexicon_scores(spark, folder):
    frame = posts(spark, folder).withColumn("text", with_but())
    scored = corpus_scorer().score(frame)
    return scored.select("post_id", r6(F.col("compound")).alias("compound"), "sentiment", "status")


@query
def lexicon_scores_default(spark, folder):
    scored = scorers.LexiconScorer().score(posts(spark, folder))
    return scored.select("post_id", r6(F.col("compound")).alias("compound"), "sentiment")


@query
def sentiment_shares(spark, folder):
    return rounded(tables.sentiment_shares(score(dated(spark, folder), corpus_scorer(), CATEGORIES)))


@query
def pattern_match(spark, folder):
    flagged = flag_posts(posts(spark, folder), "text", CATEGORIES)
    return flagged.select("post_id", "flagged", F.array_join("categories", ";").alias("categories"),
                          F.array_join("terms", ";").alias("terms"))


@query
def default_flags(spark, folder):
    spiced = F.concat("text", F.when(F.col("doc_id") % 5 == 0, " Free speech").when(
        F.col("doc_id") % 5 == 1, " bananas, urban").when(F.col("doc_id") % 5 == 2, " BANNED!").otherwise(""))
    return posts(spark, folder).select(
        "post_id", patterns.pattern_flag(spiced).alias("flagged"), patterns.substring_flag(spiced).alias("naive"),
        F.array_join(patterns.matched_categories(spiced), ";").alias("categories"))


@query
def flag_check(spark, folder):
    checked = labelled(spark, folder).select("text", F.col("toxic").alias("label"))
    return rounded(validate_patterns(checked, CATEGORIES))


@query
def wrong_flags(spark, folder):
    checked = labelled(spark, folder)
    wrong = tables.wrong_flags(checked, patterns.pattern_flag(F.col("text"), CATEGORIES), label="toxic")
    return wrong.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query
def model_scorer_errors(spark, folder):
    """A stand-in model that fails on every batch of sixteen posts in which a text has a certain word."""
    def load():
        def predict(texts):
            if any("pathetic" in item for item in texts):
                raise RuntimeError("no memory")
            good = np.array([0.7 if len(item) % 2 else 0.1 for item in texts])
            return np.column_stack([0.8 - good, np.full(len(texts), 0.2), good])

        return predict

    scored = scorers.ModelScorer(load, ["negative", "neutral", "positive"], batch_size=16).score(dated(spark, folder))
    return rounded(scored.groupBy("period", "status", "sentiment").agg(
        F.count("*").alias("n"), F.sum("compound").alias("compound")))


@query
def analyzer_scores(spark, folder):
    def make():
        return lambda item: (len(item) % 21 - 10) / 20.0

    scored = scorers.AnalyzerScorer(make).score(dated(spark, folder))
    return rounded(scored.groupBy("period", "sentiment").agg(F.count("*").alias("n"), F.sum("compound").alias("compound")))


# --- tables and tests -----------------------------------------------------------------------


def event_periods(spark: SparkSession, folder: str) -> DataFrame:
    return times.assign_period(table(spark, folder, "events"), EVENTS_CUTOFF, "ts")


@query
def contingency(spark, folder):
    levels = ["click", "error", "never", "view"]
    return tables.contingency(event_periods(spark, folder), "period", "event_type", levels)


@query
def contingency_wide(spark, folder):
    return tables.contingency_wide(event_periods(spark, folder), "period", "event_type", ["click", "error", "view"])


@query
def chi_square(spark, folder):
    return rounded(tables.chi_square(tables.contingency(event_periods(spark, folder), "period", "event_type")))


@query
def chi_square_users(spark, folder):
    return rounded(tables.chi_square(tables.contingency(event_periods(spark, folder), "event_type", "user_id"))).drop("p_value")


@query
def event_share_intervals(spark, folder):
    counts = event_periods(spark, folder).groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("period") == "post").alias("x"))
    low, high = wilson(F.col("x"), F.col("n"))
    return rounded(counts.select("event_type", "n", "x", low.alias("ci_low"), high.alias("ci_high")))


@query
def event_value_quantiles(spark, folder):
    found = quantiles.exact_quantiles(event_periods(spark, folder), "value", bootstrap.QUANTILES, by=["period"])
    return rounded(found.select("period", F.col("quantiles")[0].alias("low"), F.col("quantiles")[1].alias("high")))


@query
def moderation_share_diff(spark, folder):
    return rounded(tables.share_difference(labelled(spark, folder, texts=False), F.col("toxic")))


@query
def negative_share_inside(spark, folder):
    toxic = labelled(spark, folder, texts=False).filter("toxic = 1")
    return rounded(tables.share_difference(toxic, (F.col("quality") == 0).cast("int")))


@query
def mean_differences_text(spark, folder):
    return rounded(tables.mean_differences(dated(spark, folder), text.confounders(F.col("text"))))


@query
def mean_differences_events(spark, folder):
    features = {"value": F.col("value"), "user": F.col("user_id"), "flat": F.lit(1)}
    return rounded(tables.mean_differences(event_periods(spark, folder), features))


@query
def standardized_diff(spark, folder):
    frame = labelled(spark, folder, texts=False).withColumn("poor", (F.col("quality") == 0).cast("int"))
    return rounded(bootstrap.standardized_difference(frame, "poor", "lang", n_boot=0))


@query
def standardized_diff_sources(spark, folder):
    """Some strata occur in one period only."""
    frame = labelled(spark, folder, texts=False).withColumns({
        "poor": (F.col("quality") == 0).cast("int"), "spot": F.concat_ws("/", "source", "lang")})
    return rounded(bootstrap.standardized_difference(frame, "poor", "spot", n_boot=0))


@query
def topic_prevalence_point(spark, folder):
    return rounded(bootstrap.topic_prevalence(dated(spark, folder, texts=False), "lang", n_boot=0))


@query
def logit_saturated(spark, folder):
    post = (F.col("period") == "post").cast("int")
    frame = labelled(spark, folder, texts=False).select(
        (F.col("quality") == 0).cast("int").alias("poor"), post.alias("post"), F.col("toxic"),
        (post * F.col("toxic")).alias("post_x_toxic"))
    fitted = regression.logistic_regression(frame, "poor", ["post", "toxic", "post_x_toxic"])
    return fitted.select("term", *[F.round(name, 4).alias(name) for name in ("coef", "se", "z", "odds_ratio")])


@query
def truth_check(spark, folder):
    scored = score(labelled(spark, folder), corpus_scorer(), CATEGORIES).withColumns({
        "true_moderation": F.col("toxic").cast("string"),
        "true_sentiment": F.when(F.col("quality") == 0, "negative").otherwise("positive")})
    return rounded(tables.truth_check(scored))


# --- topics ---------------------------------------------------------------------------------


@query
def vocabulary(spark, folder):
    terms = posts(spark, folder).select(topics.words_and_pairs(topics.vocabulary_tokens(F.col("text"))).alias("terms"))
    words = topics.vocabulary(terms, terms.count())
    return rounded(words.select("term", "documents", "idf"))


@query
def tfidf_top_terms(spark, folder):
    weights = topics.tfidf(posts(spark, folder), keep=["lang"])
    sums = weights.groupBy("lang", "term").agg(r6(F.sum("weight")).alias("weight"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("weight"), "term"))
    return sums.withColumn("rank", rank.cast("bigint")).filter("rank <= 10")


@query
def tfidf_repeated_ids(spark, folder):
    """Every post of a language has the same id, and most terms are rarer than those that tasks look up."""
    shared = posts(spark, folder).select(F.col("lang").alias("post_id"), "text")
    weights = topics.tfidf(shared, head_terms=8_192, piece=8_192).withColumnRenamed("post_id", "lang")
    return weights.groupBy("lang").agg(
        F.count("*").alias("entries"), F.countDistinct("term").alias("terms"), r6(F.sum("weight")).alias("weight"),
        r6(F.sum(F.col("weight") * F.col("weight"))).alias("posts"))


def language_model(spark: SparkSession, folder: str) -> topics.TopicModel:
    return topics.fit_topics(dated(spark, folder), 4, keep=["post_id", "lang", "period"])


@query
def topic_words(spark, folder):
    words = language_model(spark, folder).describe()
    return words.select("topic", "label", F.array_join("top_words", " / ").alias("top_words"))


@query
def topic_assignment(spark, folder):
    return language_model(spark, folder).assign().groupBy("topic", "lang").agg(F.count("*").alias("posts"))


@query
def topic_assignment_again(spark, folder):
    """Per language, the posts that get the topic of the fit when they come again as new posts."""
    model = language_model(spark, folder)
    again = model.assign(dated(spark, folder).select("post_id", "text"), keep=["post_id"]).select("post_id", F.col("topic").alias("fresh"))
    return model.assign().join(again, "post_id").where(F.col("topic") == F.col("fresh")).groupBy("lang").agg(F.count("*").alias("posts"))


@query
def topic_of_own_words(spark, folder):
    """Each topic's top words as a post, and how many topics such posts get: every topic its own."""
    model = language_model(spark, folder)
    words = model.describe().select("topic", F.array_join("top_words", " ").alias("text")).withColumnRenamed("topic", "described")
    found = model.assign(words)
    return found.agg(F.count("*").alias("topics"), F.sum((F.col("described") == F.col("topic")).cast("long")).alias("found"))


@query
def topic_loss_falls(spark, folder):
    """A fit with half of the vocabulary as rare terms: losses fall, end by the rule, and weights solve their equations."""
    model = topics.fit_topics(dated(spark, folder), 4, keep=["post_id"], head_terms=16_384, piece=8_192, tolerance=1e-2)
    gains = -np.diff(model.losses)
    gram = model.loadings.sums(lambda h: h.T @ h)

    def residual(cross: np.ndarray) -> np.ndarray:
        w = topics.least_squares_weights(cross, gram)
        slope = w @ gram - cross  # zero where a weight is positive, not negative elsewhere
        return np.stack([np.abs(np.where(w > 1e-6, slope, np.minimum(slope, 0))).max(axis=1)], axis=1)

    worst = model.posts.rows(model.loadings, residual).agg(F.count("*").alias("posts"), F.max(F.get("weights", F.lit(0))).alias("worst"))
    return worst.select(
        "posts", F.lit(bool((gains >= 0).all())).alias("falls"), F.lit(bool(gains[-1] <= 1e-2 * gains[0])).alias("ended"),
        (F.col("worst") < 1e-6).alias("solved"))


@query
def topic_purity(spark, folder):
    """Whether at least 95 % of the posts of a language share a topic that no other language has most."""
    counts = language_model(spark, folder).assign().groupBy("lang", "topic").agg(F.count("*").alias("n"))
    by_lang = counts.groupBy("lang").agg(F.sum("n").alias("posts"), F.max_by("topic", "n").alias("topic"), F.max("n").alias("n"))
    alone = F.count("*").over(W.partitionBy("topic")) == 1  # one row per language
    return by_lang.select("lang", "posts", ((F.col("n") >= 0.95 * F.col("posts")) & alone).alias("pure"))


@query
def topic_assignment_new_posts(spark, folder):
    turns = table(spark, folder, "conversations")
    return language_model(spark, folder).assign(turns).groupBy("topic", "role").agg(F.count("*").alias("turns"))


@query
def topic_prevalence(spark, folder):
    return rounded(bootstrap.topic_prevalence(language_model(spark, folder).assign()))


@query
def standardized_diff_bootstrap(spark, folder):
    frame = labelled(spark, folder, texts=False).withColumn("poor", (F.col("quality") == 0).cast("int"))
    return rounded(bootstrap.standardized_difference(frame, "poor", "lang"))


@query
def topic_prevalence_interval(spark, folder):
    """Whether the bootstrap bounds of every language lie where the variance of two multinomial shares puts them."""
    strata = dated(spark, folder, texts=False).select("period", F.col("lang").alias("topic"))
    sizes = strata.groupBy("period").agg(F.count("*").alias("n")).groupBy().pivot("period", ["pre", "post"]).agg(F.first("n"))
    rows = bootstrap.topic_prevalence(strata, n_boot=500).crossJoin(F.broadcast(sizes))
    error = F.sqrt(sum(F.col(f"{p}_share") * (1 - F.col(f"{p}_share")) / F.col(p) for p in ("pre", "post")))
    near = sum((F.abs(F.col(c) - F.col("diff") - sign * 1.96 * error) <= error).cast("int")
               for c, sign in (("diff_low", -1), ("diff_high", 1))) == 2
    return rows.select("topic", near.alias("as_theory"))


@query
def scorer_error_counts(spark, folder):
    """A model whose batches of 64 fail where they hold a certain word: every failing batch is counted whole, in however
    many partitions the posts come."""
    def load():
        def predict(texts):
            if any("pathetic" in item for item in texts):
                raise RuntimeError("no memory")
            return np.tile([0.2, 0.3, 0.5], (len(texts), 1))

        return predict

    model = scorers.ModelScorer(load, ["negative", "neutral", "positive"], batch_size=64)
    frame = dated(spark, folder).select("period", "post_id", "text")
    counts = [scorers.error_counts(model.score(in_partitions(frame, parts))) for parts in (1, 8, 50)]
    return counts[0].intersectAll(counts[1]).intersectAll(counts[2])


# --- jobs -----------------------------------------------------------------------------------


def study(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    sample, manifest_row = prepare(study_posts(spark, folder), n_per_period=ALL_POSTS, max_copies=COPIES)
    return score(sample, corpus_scorer(), CATEGORIES), manifest_row


@query
def prepare_manifest(spark, folder):
    _, row = study(spark, folder)
    removed = F.array_sort(F.transform(F.map_entries("filters.removed"), lambda rule: F.concat_ws(
        " ", rule["key"], F.coalesce(rule["value"]["pre"], F.lit(0)), F.coalesce(rule["value"]["post"], F.lit(0)))))
    sources = F.transform(F.array_sort(F.map_entries(F.col("sources_per_period")["pre"])),
                          lambda entry: F.concat_ws(" ", entry["key"], entry["value"]))
    return row.select(
        "cutoff", F.col("n_per_period").cast("bigint").alias("n_per_period"),
        F.col("rows_per_period")["pre"].alias("pre"), F.col("rows_per_period")["post"].alias("post"),
        F.substring(F.col("date_range")["pre"]["first"], 1, 10).alias("first_day"),
        F.substring(F.col("date_range")["post"]["last"], 1, 10).alias("last_day"),
        F.col("filters.rows_in").alias("rows_in"), F.col("filters.rows_out").alias("rows_out"),
        F.array_join(removed, ";").alias("removed"), F.array_join(sources, ";").alias("pre_sources"))


@query
def study_shares(spark, folder):
    scored, _ = study(spark, folder)
    return rounded(tables.sentiment_shares(scored))


@query
def study_report(spark, folder):
    """One-row results of the analysis side by side."""
    scored, _ = study(spark, folder)
    results = analyze(scored, only=("sentiment_chi_square", "moderation_share"))
    chi = results["sentiment_chi_square"].select("chi2", "dof", "p_value", "cramers_v", F.lit(1).alias("_one"))
    share = results["moderation_share"].select("pre", "post", "diff", "diff_low", "diff_high", F.lit(1).alias("_one"))
    return rounded(chi.join(share, "_one").drop("_one"))


def study_result(spark: SparkSession, folder: str, *names: str, n_boot: int = 100) -> list[DataFrame]:
    scored, _ = study(spark, folder)
    results = analyze(scored, n_topics=4, n_boot=n_boot, only=names)
    return [rounded(results[name]) for name in names]


@query
def study_post_counts(spark, folder):
    return study_result(spark, folder, "posts")[0]


@query
def study_confounders(spark, folder):
    return study_result(spark, folder, "confounders_smd")[0]


@query
def study_inside_chi_square(spark, folder):
    """The sentiment of posts in which a category matches, by period. The number of labels that occur varies with the
    tables, and SQL has a tail for two degrees of freedom only: see ``study_report`` for the p-value."""
    return study_result(spark, folder, "moderation_sentiment_chi_square")[0].select("chi2", "dof", "cramers_v")


@query
def study_inside_share(spark, folder):
    found, = study_result(spark, folder, "moderation_negative_share")
    return found.select("pre", "post", "diff", "diff_low", "diff_high")


@query
def study_errors(spark, folder):
    """Scores that fail for one post in seven, as the analysis counts and leaves them out."""
    scored, _ = study(spark, folder)
    bad = F.crc32("post_id") % 7 == 0
    broken = scored.withColumns({"sentiment": F.when(~bad, F.col("sentiment")), "status": F.when(bad, "error").otherwise("ok")})
    results = analyze(broken, only=("posts", "scorer_errors_excluded"))
    return results["posts"].join(results["scorer_errors_excluded"], "period")


@query
def study_truth_check(spark, folder):
    """The check against known labels as part of the analysis; a post's truth comes with its text."""
    frame = labelled(spark, folder)
    scored = score(frame, corpus_scorer(), CATEGORIES).withColumns({
        "true_moderation": F.col("toxic").cast("string"),
        "true_sentiment": F.when(F.col("quality") == 0, "negative").otherwise("positive")})
    return rounded(analyze(scored, only=("check_against_truth",))["check_against_truth"])


@query
def study_topics(spark, folder):
    """All tables that need the topics: whether shares add up, a difference lies in its bounds, words are as many as asked for."""
    scored, _ = study(spark, folder)
    results = analyze(scored, n_topics=4, n_boot=200, only=("topics", "topic_prevalence", "negative_share_topic_adjusted", "regression_negative"))
    inside = (F.col("diff_low") <= F.col("diff")) & (F.col("diff") <= F.col("diff_high"))
    shares = results["topic_prevalence"].agg(
        r6(F.sum("pre_share")).alias("pre_share"), r6(F.sum("post_share")).alias("post_share"), r6(F.sum("diff")).alias("diff"),
        F.sum((~inside).cast("bigint")).alias("outside"), F.sum((F.col("label") == "").cast("bigint")).alias("unnamed"))
    words = results["topics"].agg(F.count("*").alias("topics"), F.sum(F.size("top_words")).cast("bigint").alias("words"))
    terms = results["regression_negative"].agg(F.array_join(F.sort_array(F.collect_list("term")), " ").alias("terms"))
    crude = rounded(results["negative_share_topic_adjusted"]).select("crude_diff")
    one = F.lit(1).alias("_one")
    out = shares.select("*", one)
    for part in (words, terms, crude):
        out = out.join(part.select("*", one), "_one")
    return out.drop("_one")


@query
def logit_score_equations(spark, folder):
    """A regression on a continuous and two other predictors: what is left of its score equations, which end at zero, and
    the same for the sum of expected outcomes."""
    frame = labelled(spark, folder).select(
        (F.col("quality") == 0).cast("int").alias("poor"), F.log(F.length("text") + 1).alias("size"),
        (F.col("period") == "post").cast("int").alias("post"), F.col("toxic").cast("int").alias("toxic"))
    names = ["size", "post", "toxic"]
    beta = {r.term: r.coef for r in regression.logistic_regression(frame, "poor", names, distinct_rows=False).collect()}
    linear = sum((F.col(name) * beta[name] for name in names), F.lit(beta["intercept"]))
    left = F.col("poor") - 1 / (1 + F.exp(-linear))
    return frame.agg(
        F.count("*").alias("posts"), F.sum("poor").alias("poor"), (F.round(F.sum(left), 3) + 0.0).alias("intercept"),
        *[(F.round(F.sum(left * F.col(name)), 3) + 0.0).alias(name) for name in names])


@query
def study_regression(spark, folder):
    return study_result(spark, folder, "regression_negative")[0]


@query
def study_adjusted_difference(spark, folder):
    return study_result(spark, folder, "negative_share_topic_adjusted", n_boot=200)[0]
