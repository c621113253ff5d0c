"""The registered queries: one per operator, over the forum derived from the given tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forum_signals.functions import matching, special, text
from forum_signals.functions.casts import safe_int
from forum_signals.functions.lexicon import CATEGORY_PREFIX, PHRASES
from forum_signals.operators import concreteness, flags, model, rates, sampling, stats, topics
from forum_signals.plans import jobs
from forum_signals.session import scratch_path
from forum_signals.sources import dump
from forum_signals.sources import schemas
from forum_signals.sources.tables import read_table, register_views, row_counts, write_report, write_table
from verification import forum_tables
from verification.base import dump_folder, forum, fresh_workspace, norms, workspace
from verification.phrases import TEST_SETTINGS as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MIN_SUPPORT = 480
WORD_SLOT = tuple(p for group in PHRASES.values() for p in group if "{word}" in p)
GAP_SLOT = tuple(p for group in PHRASES.values() for p in group if "{gap}" in p)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles to a fixed number of digits, so that engines can be compared."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def digest(column: Column | str) -> Column:
    return F.md5(column).alias("digest")


def row_digest(*columns: str) -> Column:
    """One digest of several columns, nulls told apart from texts."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])).alias("digest")


def placed(report: DataFrame) -> DataFrame:
    """A report as read back, with the position of each line in its (single) file."""
    return report.withColumn("place", (F.monotonically_increasing_id() + 1).cast("int"))


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return placed(spark.read.option("header", "true").schema(schema).csv(path))


# A. Sources, sinks, tables


@query
def a1_scan_dump_rows(spark, sf_dir):
    rows = dump.read_dump(spark, dump_folder(spark, sf_dir))["posts"]
    return rows.select("Id", "PostTypeId", "ParentId", digest("Body"), "Title", "Tags", "CreationDate", "Score")


@query
def a2_attributes_to_columns(spark, sf_dir):
    found = dump.read_dump(spark, dump_folder(spark, sf_dir))
    named = found["tags"].select(F.col("Id").cast("bigint").alias("Id"), F.col("TagName").alias("Text"), F.col("Count").alias("Score"))
    return found["comments"].unionByName(named, allowMissingColumns=True)


@query
def a3_safe_int(spark, sf_dir):
    kind = F.col("event_type")
    raw = (
        F.when(kind == "view", F.concat(F.lit("  "), "user_id", F.lit(" ")))
        .when(kind == "click", F.concat(F.lit("+"), "user_id"))
        .when(kind == "error", F.col("props"))
        .when(kind == "signup", F.col("value").cast("string"))
        .otherwise((F.col("event_id") * 1000003).cast("string"))
    )
    events = forum_tables.load(spark, sf_dir, "events")
    return events.select(
        "event_id", safe_int(raw, "int").alias("as_int"), safe_int(raw, "bigint", 0).alias("as_bigint_or_zero"),
        safe_int(raw, "tinyint", 0).alias("as_tinyint_or_zero"),
    )


@query
def a4_enforced_schema(spark, sf_dir):
    merged = workspace(spark, sf_dir).posts
    stored = write_table(merged, scratch_path(spark, "typed"), schemas.POSTS.schema)
    kinds = dict(stored.dtypes)
    counts = stored.agg(*[F.count(c).alias(c) for c in stored.columns])
    long = counts.unpivot([], stored.columns, "column_name", "n_present")
    kind = F.create_map(*[F.lit(v) for pair in kinds.items() for v in pair])
    return long.withColumn("data_type", kind[F.col("column_name")])


@query
def a5_pick_dump_files(spark, sf_dir):
    return row_counts(dump.read_dump(spark, dump_folder(spark, sf_dir)))


@query
def a6_parquet_sink(spark, sf_dir):
    return write_table(forum(spark, sf_dir).comments, scratch_path(spark, "comments"))


@query
def a7_parquet_source(spark, sf_dir):
    posts = read_table(spark, workspace(spark, sf_dir).path("posts"), schemas.POSTS.schema)
    return posts.groupBy("PostTypeId").agg(
        F.count("*").alias("n_posts"), F.count("ParentId").alias("n_parents"), F.sum("Score").alias("total_score")
    )


@query
def a8_create_or_replace_table(spark, sf_dir):
    path, tables = scratch_path(spark, "replaced"), forum(spark, sf_dir)
    write_table(tables.answers.select(F.col("answer_id").alias("id"), F.col("score").alias("points")), path)
    return write_table(tables.questions.select(F.col("question_id").alias("id"), "raw_tags"), path)


@query
def a9_named_views(spark, sf_dir):
    tables = forum(spark, sf_dir)
    register_views({"questions": tables.questions, "answers": tables.answers})
    return spark.sql(
        "SELECT q.question_id, count(a.answer_id) AS n_answers, max(a.score) AS best_score "
        "FROM questions q LEFT JOIN answers a ON a.question_id = q.question_id GROUP BY q.question_id"
    )


@query
def a10_csv_report(spark, sf_dir):
    path = scratch_path(spark, "report")
    write_report(rates.rate_per_topic(forum(spark, sf_dir).topic_counts), path)
    return rounded(read_report(spark, path, "topic string, n_questions bigint, n_miscomm bigint, miscomm_rate double"))


@query
def a11_word_norms(spark, sf_dir):
    return rounded(forum_tables.norms(spark, sf_dir))


@query
def a12_discover_categories(spark, sf_dir):
    flagged = forum(spark, sf_dir).question_miscomm
    names = matching.category_columns(flagged)
    totals = flagged.agg(*[F.count_if(F.col(c)).alias(c) for c in names])
    return totals.unpivot([], names, "column_name", "n_flagged")


@query
def a13_row_counts(spark, sf_dir):
    t = forum(spark, sf_dir)
    return row_counts(
        {
            "posts": t.posts, "comments": t.comments, "tags": t.tags, "questions": t.questions, "answers": t.answers,
            "comments_enriched": t.comments_enriched, "question_tags": t.question_tags,
        }
    )


# B. Projections, filters, predicates


@query
def b1_questions(spark, sf_dir):
    return forum(spark, sf_dir).questions


@query
def b2_answers(spark, sf_dir):
    return forum(spark, sf_dir).answers


@query
def b3_root_question(spark, sf_dir):
    return model.post_roots(forum(spark, sf_dir).posts)


@query
def b4_comments_with_root(spark, sf_dir):
    return model.with_root_question(forum(spark, sf_dir).comments_enriched).select("comment_id", "question_id")


@query
def b5_titled_questions(spark, sf_dir):
    return sampling.titled(forum(spark, sf_dir).questions).select("question_id", "title")


@query
def b6_flags_as_numbers(spark, sf_dir):
    flag = F.col(matching.HAS_MISCOMM)
    return forum(spark, sf_dir).question_miscomm.select(
        "question_id", rates.as_int(flag).alias("flagged"), rates.negated_int(flag).alias("not_flagged")
    )


@query
def b7_minimum_support(spark, sf_dir):
    return topics.supported_tags(forum(spark, sf_dir).all_question_tags, MIN_SUPPORT)


@query
def b8_flagged_only(spark, sf_dir):
    flagged = forum(spark, sf_dir).answers_flagged
    return flags.flagged_only(flagged, "cat_epistemic").select("answer_id", "question_id")


# C. Joins


@query
def c1_comments_with_posts(spark, sf_dir):
    return forum(spark, sf_dir).comments_enriched


@query
def c2_top_tag_pairs(spark, sf_dir):
    return forum(spark, sf_dir).question_tags


@query
def c3_tags_with_flags(spark, sf_dir):
    t = forum(spark, sf_dir)
    return rates.tagged_flags(t.question_tags, t.question_miscomm)


@query
def c4_tags_with_titles(spark, sf_dir):
    t = forum(spark, sf_dir)
    return sampling.tags_with_titles(t.question_tags, t.questions).select("question_id", "tag", digest("title"))


@query
def c5_token_norms(spark, sf_dir):
    return rounded(concreteness.matched_tokens(forum(spark, sf_dir).questions, norms(spark, sf_dir), []))


# D. Aggregations


@query
def d1_question_flags(spark, sf_dir):
    return forum(spark, sf_dir).question_miscomm


@query
def d2_flag_prevalence(spark, sf_dir):
    return rounded(flags.flag_prevalence(forum(spark, sf_dir).question_miscomm))


@query
def d3_tag_counts(spark, sf_dir):
    return topics.tag_counts(forum(spark, sf_dir).question_tags)


@query
def d4_distinct_tags(spark, sf_dir):
    return topics.distinct_tag_count(forum(spark, sf_dir).all_question_tags)


@query
def d5_rate_per_tag(spark, sf_dir):
    return rounded(rates.rate_per_topic(forum(spark, sf_dir).topic_counts))


@query
def d6_rate_per_tag_category(spark, sf_dir):
    return rounded(rates.rate_per_topic_category(forum(spark, sf_dir).topic_counts))


@query
def d7_global_summary(spark, sf_dir):
    t = forum(spark, sf_dir)
    return rounded(rates.global_summary(t.question_miscomm, t.posts, t.comments, t.tags))


@query
def d8_global_by_category(spark, sf_dir):
    return rounded(rates.global_rate_per_category(forum(spark, sf_dir).question_miscomm))


@query
def d9_contingency(spark, sf_dir):
    return rates.contingency_per_topic(forum(spark, sf_dir).topic_counts)


@query
def d10_contingency_by_category(spark, sf_dir):
    return rates.contingency_per_topic_category(forum(spark, sf_dir).topic_counts)


def _concreteness(spark, sf_dir):
    t = forum(spark, sf_dir)
    return concreteness.concreteness_per_topic(
        t.question_tags, t.questions, norms(spark, sf_dir), S, scratch_path(spark, "concreteness")
    )


def _stability(spark, sf_dir):
    t = forum(spark, sf_dir)
    return concreteness.sample_stability(t.question_tags, t.questions, norms(spark, sf_dir), S, scratch_path(spark, "stability"))


@query
def d11_concreteness_per_tag(spark, sf_dir):
    return rounded(_concreteness(spark, sf_dir))


@query
def d12_stability_summary(spark, sf_dir):
    return rounded(concreteness.stability_summary(_stability(spark, sf_dir)))


@query
def d13_score_range(spark, sf_dir):
    return rounded(concreteness.score_range(_concreteness(spark, sf_dir)))


# E. Sort, limit, top-k, sampling


@query
def e1_top_tags(spark, sf_dir):
    return topics.top_tags(forum(spark, sf_dir).all_question_tags, S.top_n)


@query
def e2_top_supported_tags(spark, sf_dir):
    return topics.top_tags(forum(spark, sf_dir).question_tags, S.stability_tags, S.min_questions)


@query
def e3_title_sample(spark, sf_dir):
    t = forum(spark, sf_dir)
    tags = topics.tag_counts(t.question_tags)
    folder = scratch_path(spark, "sample")
    sample = sampling.sample_titles(t.question_tags, t.questions, tags, S.sample_size, S.seed, folder)
    return sample.select("tag", "question_id", digest("title"))


@query
def e4_repeated_samples(spark, sf_dir):
    return rounded(_stability(spark, sf_dir))


@query
def e5_ordered_outputs(spark, sf_dir):
    """The lines of reports in the order in which their files have them."""
    t, work = forum(spark, sf_dir).stored(), jobs.Workspace(spark, scratch_path(spark, "job"), S)
    counts = write_table(t.topic_counts, scratch_path(spark, "counts"))
    rate, cells = "n_questions bigint, n_miscomm bigint, miscomm_rate double", "n_miscomm bigint, n_no_miscomm bigint, n_total bigint"
    jobs.report_topic_rates(work, counts)
    jobs.report_contingency(work, counts)
    jobs.report_global_categories(work, t.question_miscomm)
    reports = {
        "rates": ("track_a_tags", f"topic string, {rate}"),
        "sizes": ("contingency_tags", f"topic string, {cells}"),
        "rates_by_category": ("track_a_tags_by_category", f"topic string, category string, {rate}"),
        "categories": ("global_summary_by_category", "category string, total_questions bigint"),
    }
    merged = None
    for name, (file, schema) in reports.items():
        one = placed(work.load_report(file, schema))
        shown = [F.col(c) if c in one.columns else F.lit(None).cast("string").alias(c) for c in ("topic", "category")]
        one = one.select(F.lit(name).alias("report"), *shown, "place")
        merged = one if merged is None else merged.unionByName(one)
    return merged


# F. Set operations


@query
def f1_union_flags(spark, sf_dir):
    t = forum(spark, sf_dir)
    merged = flags.union_flags(t.answers_flagged, t.comments_flagged)
    return merged.groupBy("question_id").agg(
        F.count("*").alias("n_texts"), F.count_if(matching.HAS_MISCOMM).alias("n_flagged")
    )


@query
def f2_stack_categories(spark, sf_dir):
    long = rates.contingency_per_topic_category(forum(spark, sf_dir).topic_counts)
    return long.select("topic", "category", "n_miscomm")


# G. Text functions


def _bodies(spark, sf_dir, fn):
    answers = forum(spark, sf_dir).answers
    return answers.select("answer_id", fn(F.col("body")).alias("t")).select("answer_id", F.length("t").alias("n"), digest("t"))


@query
def g1_unescape_entities(spark, sf_dir):
    return _bodies(spark, sf_dir, text.unescape_entities)


@query
def g2_drop_code_blocks(spark, sf_dir):
    return _bodies(spark, sf_dir, text.drop_code_blocks)


@query
def g3_drop_code_spans(spark, sf_dir):
    return _bodies(spark, sf_dir, text.drop_code_spans)


@query
def g4_strip_tags(spark, sf_dir):
    return _bodies(spark, sf_dir, text.strip_tags)


@query
def g5_collapse_whitespace(spark, sf_dir):
    return _bodies(spark, sf_dir, text.collapse_whitespace)


@query
def g6_html_to_text(spark, sf_dir):
    return forum(spark, sf_dir).answers.select("answer_id", text.html_to_text(F.col("body")).alias("prose"))


@query
def g7_detect_categories(spark, sf_dir):
    found = matching.detect_categories(F.col("Text"))
    return forum(spark, sf_dir).comments.select("Id", *[c.alias(CATEGORY_PREFIX + name) for name, c in found.items()])


@query
def g8_contains_miscomm(spark, sf_dir):
    return forum(spark, sf_dir).comments.select("Id", matching.contains_miscomm(F.col("Text")).alias("has_miscomm"))


@query
def g9_flag_answers(spark, sf_dir):
    return forum(spark, sf_dir).answers_flagged


@query
def g10_flag_comments(spark, sf_dir):
    return forum(spark, sf_dir).comments_flagged


@query
def g11_slot_patterns(spark, sf_dir):
    prose = forum(spark, sf_dir).answers.select("answer_id", text.html_to_text(F.col("body")).alias("t"))
    return prose.select(
        "answer_id",
        matching.matches(F.col("t"), WORD_SLOT).alias("word_slot"),
        matching.matches(F.col("t"), GAP_SLOT).alias("gap_slot"),
    )


@query
def g12_parse_tags(spark, sf_dir):
    parsed = forum(spark, sf_dir).questions.select("question_id", text.parse_tags(F.col("raw_tags")).alias("t"))
    return parsed.select("question_id", F.size("t").alias("n_tags"), F.array_join("t", "|").alias("tags"))


@query
def g13_explode_tags(spark, sf_dir):
    return forum(spark, sf_dir).all_question_tags


@query
def g14_tokenize(spark, sf_dir):
    docs = forum_tables.load(spark, sf_dir, "documents")
    words = docs.select("doc_id", text.tokenize(F.col("text")).alias("t"))
    return words.select("doc_id", F.size("t").alias("n_tokens"), digest(F.array_join("t", " ")))


@query
def g15_score_titles(spark, sf_dir):
    t = forum(spark, sf_dir)
    titles = t.question_tags.join(t.questions.select("question_id", "title"), "question_id")
    return rounded(concreteness.score_titles(titles, norms(spark, sf_dir), ["tag"]))


# H. Statistics


def _counts(spark, sf_dir):
    """The topic counts as the statistics job reads them: a written table."""
    return write_table(forum(spark, sf_dir).topic_counts, scratch_path(spark, "counts"))


def _contingency(spark, sf_dir):
    return rates.contingency_per_topic(_counts(spark, sf_dir))


def _by_category(spark, sf_dir):
    return rates.contingency_per_topic_category(_counts(spark, sf_dir))


def _pairwise(spark, sf_dir):
    t = forum(spark, sf_dir).stored()
    return stats.pairwise(rates.contingency_per_topic(t.topic_counts), rates.global_rate(t.question_miscomm), S.alpha)


@query
def h1_descriptive(spark, sf_dir):
    return rounded(stats.descriptive(_contingency(spark, sf_dir)))


@query
def h2_global_test(spark, sf_dir):
    return rounded(stats.homogeneity_test(_contingency(spark, sf_dir)))


@query
def h3_test_per_category(spark, sf_dir):
    return rounded(stats.homogeneity_test(_by_category(spark, sf_dir), "category"))


@query
def h4_profile_test(spark, sf_dir):
    return rounded(stats.profile_test(_by_category(spark, sf_dir)))


@query
def h5_pairwise_test(spark, sf_dir):
    columns = ("topic", "n_miscomm", "n_no_miscomm", "n_total", "estimate", "z", "p_value", "ci_lower", "ci_upper")
    return rounded(_pairwise(spark, sf_dir).select(*columns))


@query
def h6_adjusted_p(spark, sf_dir):
    return rounded(_pairwise(spark, sf_dir).select("topic", "p_value", "p_adj"))


@query
def h7_direction(spark, sf_dir):
    return _pairwise(spark, sf_dir).select("topic", "significant", "direction")


@query
def h8_odds_ratios(spark, sf_dir):
    fitted = stats.logistic(_contingency(spark, sf_dir))
    return rounded(fitted.select("term", "odds_ratio", "std_error", "statistic", "p_value", "p_adj"))


@query
def h9_profile_limits(spark, sf_dir):
    return rounded(stats.logistic(_contingency(spark, sf_dir)).select("term", "conf_low", "conf_high"), 8)


def _correlation(spark, sf_dir):
    scores = write_table(_concreteness(spark, sf_dir), scratch_path(spark, "scores"))
    return stats.rank_correlation(scores, rates.rate_per_topic(_counts(spark, sf_dir)))


@query
def h10_rank_correlation(spark, sf_dir):
    return rounded(_correlation(spark, sf_dir).select("track", "rho", "n_topics"))


@query
def h11_rank_correlation_p(spark, sf_dir):
    return rounded(_correlation(spark, sf_dir))


@query
def h12_chi_square_tail(spark, sf_dir):
    """log10 of tail probabilities, also of statistics far beyond what the tables give."""
    t = forum(spark, sf_dir).stored()
    counts = write_table(t.topic_counts, scratch_path(spark, "counts"))
    cells = rates.contingency_per_topic_category(counts)
    tests = stats.homogeneity_test(cells, "category").select("category", "df", "statistic")
    profile = stats.profile_test(cells).select(F.lit("all").alias("category"), "df", F.col("chi2").alias("statistic"))
    overall = stats.homogeneity_test(rates.contingency_per_topic(counts))
    larger = overall.select("df", "statistic", F.explode(F.array(*map(F.lit, (10, 100, 1000)))).alias("k")).select(
        F.concat(F.lit("times "), "k").alias("category"), "df", F.col("statistic") * F.col("k")
    )
    tail = special.chi_square_log_p("statistic", "df") / math.log(10)
    return rounded(tests.union(profile).union(larger).select("category", "df", tail.alias("log10_p")), 6)


@query
def h13_pairwise_by_category(spark, sf_dir):
    t = forum(spark, sf_dir).stored()
    tests = stats.pairwise_by_category(
        rates.contingency_per_topic_category(t.topic_counts), rates.global_rate_per_category(t.question_miscomm), S.alpha
    )
    return rounded(tests)


# K. Jobs


@query
def k1_ingest(spark, sf_dir):
    work = jobs.Workspace(spark, scratch_path(spark, "job"), S)
    jobs.ingest(work, dump_folder(spark, sf_dir))
    merged = None
    for name in ("posts", "comments", "tags"):
        table = work.table(name)
        others = [c for c in table.columns if c != "Id"]
        one = table.select(F.lit(name).alias("table_name"), F.col("Id").cast("bigint").alias("Id"), row_digest(*others))
        merged = one if merged is None else merged.unionByName(one)
    return merged


@query
def k2_model(spark, sf_dir):
    jobs.build_model(fresh_workspace(spark, sf_dir))
    merged = None
    for name in ("questions", "answers", "comments_enriched"):
        view = spark.table(name)
        one = view.select(F.lit(name).alias("table_name"), F.col(view.columns[0]).alias("id"), row_digest(*view.columns[1:]))
        merged = one if merged is None else merged.unionByName(one)
    return merged


@query
def k3_detect(spark, sf_dir):
    return jobs.detect(fresh_workspace(spark, sf_dir))


@query
def k4_topics(spark, sf_dir):
    work = fresh_workspace(spark, sf_dir)
    jobs.assign_topics(work)
    report = placed(work.load_report("tag_counts", "tag string, n_questions bigint"))
    pairs = work.table("question_tags").select(F.lit("question_tags").alias("source"), "question_id", "tag")
    return pairs.unionByName(report.withColumn("source", F.lit("tag_counts")), allowMissingColumns=True)


def _counted(spark, sf_dir):
    work = fresh_workspace(spark, sf_dir)
    jobs.detect(work)
    jobs.assign_topics(work)
    return work, jobs.count_topics(work)


def _stack(work, reports: dict[str, str]) -> DataFrame:
    """Several reports of a job as ``report, topic, category, ...`` rows, as read back."""
    merged = None
    for name, schema in reports.items():
        one = work.load_report(name, schema).withColumn("report", F.lit(name))
        merged = one if merged is None else merged.unionByName(one, allowMissingColumns=True)
    return merged


@query
def k5_rates(spark, sf_dir):
    work, counts = _counted(spark, sf_dir)
    jobs.report_rates(work, counts)
    topic = "topic string, n_questions bigint, n_miscomm bigint, miscomm_rate double"
    overall = "total_questions bigint, total_miscomm bigint, global_miscomm_rate double"
    reports = {
        "track_a_tags": topic,
        "track_a_tags_by_category": topic.replace("string,", "string, category string,", 1),
        "global_summary_by_category": f"category string, {overall}",
        "global_summary": overall.replace(
            "bigint,", "bigint, total_answers bigint, total_comments bigint, total_tags bigint,", 1
        ),
    }
    return rounded(_stack(work, reports))


@query
def k6_contingency(spark, sf_dir):
    work, counts = _counted(spark, sf_dir)
    jobs.report_contingency(work, counts)
    cells = "n_miscomm bigint, n_no_miscomm bigint, n_total bigint"
    return _stack(
        work,
        {
            "contingency_tags": f"topic string, {cells}",
            "contingency_tags_by_category": f"topic string, category string, {cells}",
        },
    )


@query
def k7_concreteness(spark, sf_dir):
    work = fresh_workspace(spark, sf_dir)
    jobs.assign_topics(work)
    jobs.report_concreteness(work, norms(spark, sf_dir))
    schema = "topic string, n_sampled bigint, n_words_matched bigint, concreteness_score double"
    return rounded(placed(work.load_report("topic_abstractness_tags", schema)))


@query
def k8_stability(spark, sf_dir):
    work = fresh_workspace(spark, sf_dir)
    jobs.assign_topics(work)
    jobs.report_stability(work, norms(spark, sf_dir))
    schema = "tag string, sample_size int, run int, n_words_matched bigint, concreteness_score double"
    return rounded(placed(work.load_report("sample_stability", schema)))


PAIRS = (
    "topic string, n_miscomm bigint, n_no_miscomm bigint, n_total bigint, p_value double, estimate double, ci_lower double, "
    "ci_upper double, p_adj double, significant boolean, direction string"
)


@query
def k9_statistics(spark, sf_dir):
    work, counts = _counted(spark, sf_dir)
    jobs.report_concreteness(work, norms(spark, sf_dir))
    jobs.report_statistics(work, counts)
    reports = {
        "stats_tags_descriptive": "topic string, n_miscomm bigint, n_no_miscomm bigint, n_total bigint, "
        "miscomm_rate double, ci_lower double, ci_upper double",
        "stats_tags_global_test": "test string, statistic double, df int, p_value double, cramers_v double",
        "stats_tags_by_category_global_test": "category string, test string, statistic double, df int, "
        "p_value double, cramers_v double",
        "stats_tags_profile_test": "track string, chi2 double, df int, p_value double, cramers_v double, n_topics int, n_cats int",
        "stats_tags_pairwise": PAIRS,
        "stats_tags_pairwise_by_category": f"category string, {PAIRS}",
        "stats_tags_logistic": "term string, odds_ratio double, std_error double, statistic double, p_value double, "
        "conf_low double, conf_high double, p_adj double",
        "stats_tags_abstractness": "track string, rho double, p_value double, n_topics int",
    }
    return rounded(_stack(work, reports).withColumns({c: F.round(c, 8) for c in ("conf_low", "conf_high")}))


