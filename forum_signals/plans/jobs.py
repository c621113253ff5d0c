"""The user-level jobs. Each reads the tables of earlier jobs and writes its own.

Stage results are written tables in the work folder: a later job, or a rerun after lost
executors, starts from them and never repeats the text matching.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forum_signals.operators import concreteness, flags, model, rates, stats, topics
from forum_signals.settings import DEFAULTS, AnalysisSettings
from forum_signals.sources import dump
from forum_signals.sources.schemas import DUMP_TABLES
from forum_signals.sources.tables import (
    read_table,
    register_views,
    row_counts,
    save_bucketed,
    write_report,
    write_table,
)

# Published headers of the logistic report that are awkward as column names.
LOGISTIC_HEADER = {"std_error": "std.error", "p_value": "p.value", "conf_low": "conf.low", "conf_high": "conf.high"}

SCHEMAS = {t.table: t.schema for t in DUMP_TABLES}
KEYED_BY_QUESTION = frozenset({"question_miscomm", "question_tags"})


@dataclass
class Workspace:
    """Where tables and reports live (a folder every executor can reach).

    With ``buckets`` the tables keyed by question are kept in the session's catalog, bucketed
    by question, so that the joins of later jobs need no shuffle.
    """

    spark: SparkSession
    folder: str
    settings: AnalysisSettings = DEFAULTS
    buckets: int = 0
    table_prefix: str = "forum_"

    def path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/parquet/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        if self.buckets and name in KEYED_BY_QUESTION:
            return self.spark.table(self.table_prefix + name)
        return read_table(self.spark, self.path(name), SCHEMAS.get(name))

    def save(self, name: str, df: DataFrame) -> DataFrame:
        if self.buckets and name in KEYED_BY_QUESTION:
            return save_bucketed(df, self.table_prefix + name, "question_id", self.buckets, self.path(name))
        # Posts are laid out by type: a scan of answers then skips the bodies of questions.
        return write_table(df, self.path(name), SCHEMAS.get(name), "PostTypeId" if name == "posts" else None)

    def scratch(self, name: str) -> str:
        """A folder for intermediate tables of one job; a rerun overwrites it."""
        return f"{self.folder.rstrip('/')}/scratch/{name}"

    def report(self, name: str, df: DataFrame, columns: dict[str, str] | None = None) -> None:
        write_report(df, f"{self.folder.rstrip('/')}/results/{name}.csv", columns)

    def load_report(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder.rstrip('/')}/results/{name}.csv"
        return self.spark.read.option("header", "true").schema(schema).csv(path)

    # Base tables and the views over them.

    @property
    def posts(self) -> DataFrame:
        return self.table("posts")

    @property
    def comments(self) -> DataFrame:
        return self.table("comments")

    @property
    def tags(self) -> DataFrame:
        return self.table("tags")

    @property
    def questions(self) -> DataFrame:
        return model.questions(self.posts)

    @property
    def answers(self) -> DataFrame:
        return model.answers(self.posts)


def ingest(work: Workspace, dump_folder: str, whole: bool = False) -> dict[str, DataFrame]:
    """Dump XML to typed Parquet tables; files that are missing are skipped. ``whole`` is for files whose comments hold rows."""
    return {name: work.save(name, df) for name, df in dump.read_dump(work.spark, dump_folder, whole).items()}


def build_model(work: Workspace) -> DataFrame:
    """Register the base tables and the three views; return their row counts."""
    tables = {
        "posts": work.posts,
        "comments": work.comments,
        "tags": work.tags,
        "questions": work.questions,
        "answers": work.answers,
        "comments_enriched": model.comments_enriched(work.comments, work.posts),
    }
    register_views(tables)
    return row_counts({name: tables[name] for name in ("questions", "answers", "comments_enriched")})


def detect(work: Workspace) -> DataFrame:
    """Flag all answers and comments, then reduce to one row per question."""
    answered = work.save("answers_flagged", flags.flag_answers(work.answers))
    commented = work.save("comments_flagged", flags.flag_comments_of(work.comments, work.posts))
    return work.save("question_miscomm", flags.question_miscomm(answered, commented))


def assign_topics(work: Workspace) -> DataFrame:
    """Question-tag pairs of the most frequent tags, and the tag frequencies."""
    pairs = work.save("all_question_tags", topics.explode_tags(work.questions))
    kept = work.save("question_tags", topics.keep_top_tags(pairs, work.settings.top_n))
    work.report("tag_counts", topics.tag_counts(kept).orderBy(F.desc("n_questions"), "tag"))
    return kept


def count_topics(work: Workspace) -> DataFrame:
    """The one join of flags and tags; both the rates and the contingency tables use it."""
    tagged = rates.tagged_flags(work.table("question_tags"), work.table("question_miscomm"))
    return work.save("topic_counts", rates.topic_counts(tagged, work.settings.min_questions))


def report_rates(work: Workspace, counts: DataFrame) -> None:
    question_flags = work.table("question_miscomm")
    work.report("global_summary", rates.global_summary(question_flags, work.posts, work.comments, work.tags))
    report_global_categories(work, question_flags)
    report_topic_rates(work, counts)


def report_global_categories(work: Workspace, question_flags: DataFrame) -> None:
    by_category = rates.global_rate_per_category(question_flags)
    work.report("global_summary_by_category", rates.by_category_order(by_category))


def report_topic_rates(work: Workspace, counts: DataFrame) -> None:
    work.report("track_a_tags", rates.rate_per_topic(counts))
    by_category = rates.rate_per_topic_category(counts)
    work.report("track_a_tags_by_category", rates.by_category_order(by_category, "topic"))


def report_contingency(work: Workspace, counts: DataFrame) -> None:
    work.report("contingency_tags", rates.contingency_per_topic(counts))
    by_category = rates.contingency_per_topic_category(counts)
    work.report("contingency_tags_by_category", by_category.orderBy("category", F.desc("n_total"), "topic"))


def report_concreteness(work: Workspace, norms: DataFrame) -> DataFrame:
    """Concreteness per topic; returns the range of the scores."""
    scores = concreteness.concreteness_per_topic(
        work.table("question_tags"), work.questions, norms, work.settings, work.scratch("concreteness")
    )
    scores = work.save("topic_abstractness_tags", scores)
    work.report("topic_abstractness_tags", scores.orderBy("topic"))
    return concreteness.score_range(scores)


def report_stability(work: Workspace, norms: DataFrame) -> DataFrame:
    """Scores of repeated samples; returns mean and deviation per tag and size."""
    runs = concreteness.sample_stability(
        work.table("question_tags"), work.questions, norms, work.settings, work.scratch("stability")
    )
    runs = work.save("sample_stability", runs)
    work.report("sample_stability", runs.orderBy("tag", "sample_size", "run"))
    return concreteness.stability_summary(runs)


def report_statistics(work: Workspace, counts: DataFrame) -> None:
    alpha = work.settings.alpha
    contingency = rates.contingency_per_topic(counts)
    by_category = rates.contingency_per_topic_category(counts)
    question_flags = work.table("question_miscomm")
    scores = work.table("topic_abstractness_tags")
    work.report("stats_tags_descriptive", stats.descriptive(contingency))
    work.report("stats_tags_global_test", stats.homogeneity_test(contingency))
    work.report("stats_tags_by_category_global_test", stats.homogeneity_test(by_category, "category"))
    work.report("stats_tags_profile_test", stats.profile_test(by_category))
    pairs = stats.pairwise(contingency, rates.global_rate(question_flags), alpha)
    work.report("stats_tags_pairwise", pairs.drop("z"))
    within = stats.pairwise_by_category(by_category, rates.global_rate_per_category(question_flags), alpha)
    work.report("stats_tags_pairwise_by_category", within.drop("z"))
    work.report("stats_tags_logistic", stats.logistic(contingency), LOGISTIC_HEADER)
    work.report("stats_tags_abstractness", stats.rank_correlation(scores, rates.rate_per_topic(counts)))


def run_all(work: Workspace, dump_folder: str, norms: DataFrame) -> None:
    """The whole study, phase by phase."""
    ingest(work, dump_folder)
    build_model(work)
    detect(work)
    assign_topics(work)
    counts = count_topics(work)
    report_rates(work, counts)
    report_contingency(work, counts)
    report_concreteness(work, norms)
    report_stability(work, norms)
    report_statistics(work, counts)
