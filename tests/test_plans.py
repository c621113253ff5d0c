"""Plan properties that keep the jobs affordable on very large forums."""

import re

import pytest
from pyspark.sql import functions as F

from forum_fixture import forum
from forum_signals.functions import matching, text
from forum_signals.operators import flags, model, sampling, topics
from forum_signals.plans.forum import Forum
from forum_signals.sources.schemas import COMMENTS, POSTS, TAGS
from forum_signals.sources.tables import row_counts, write_table


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The literal forum as Parquet, with broadcast joins off as for large tables."""
    folder, small = tmp_path_factory.mktemp("stored"), forum(spark)
    tables = Forum(
        write_table(small.posts, f"{folder}/posts", POSTS.schema, "PostTypeId"),
        write_table(small.comments, f"{folder}/comments", COMMENTS.schema),
        write_table(small.tags, f"{folder}/tags", TAGS.schema),
        small.settings,
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield tables
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_matched_once_and_never_shuffled(stored):
    plan = physical(stored.question_miscomm)
    pattern = re.escape(matching.ascii_regex(matching.ALL_PHRASES))
    assert len(re.findall(pattern, plan)) == 2  # once for answers, once for comments
    # Below every exchange the rows are already aggregated flags or narrow post columns.
    for part in plan.split("Exchange hashpartitioning")[1:]:
        line = part.split("\n")[1]
        assert "partial_max" in line or "Body" not in line and "Text" not in line
    assert plan.count("partial_max(has_miscomm") == 2


def test_a_condition_on_a_flag_repeats_no_cleaning(stored):
    """The plan stays as long as without the condition; pushed down, it held the cleaning once per use of its steps."""
    flagged = stored.answers_flagged
    plan, chosen = (physical(df) for df in (flagged, flags.flagged_only(flagged, "cat_epistemic").select("answer_id")))
    assert 0 < chosen.count(text.CODE_BLOCK) <= plan.count(text.CODE_BLOCK)
    assert len(chosen) <= len(plan)


def test_jobs_never_shuffle_the_text_of_linked_comments(stored):
    """Counting the view moves ids only, and the flags of linked comments are moved in place of their text."""
    counted = physical(row_counts({"comments_enriched": model.comments_enriched(stored.comments, stored.posts)}))
    flagged = physical(flags.flag_comments_of(stored.comments, stored.posts))
    for plan in (counted, flagged):
        assert "Join" in plan and "Exchange hashpartitioning" in plan
        schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
        assert ["Text" in s for s in schemas if "PostId" in s] == [plan is flagged]
        for part in plan.split("Exchange hashpartitioning")[1:]:
            columns = re.search(r"Project \[(.*)\]", part.split("\n")[1])
            assert columns and not re.search(r"\b[Tt]ext#\d+(,|$| AS text)", columns.group(1))


def test_scans_read_only_needed_columns(stored):
    plan = physical(stored.question_miscomm)
    schemas = sorted(re.findall(r"ReadSchema: struct<([^>]*)>", plan))
    assert schemas == ["Id:bigint,ParentId:bigint", "ParentId:bigint,Body:string", "PostId:bigint,Text:string"]
    kinds = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert any("PostTypeId" in k and "= 2" in k for k in kinds) and any("IN (1,2)" in k for k in kinds)
    tags = physical(stored.all_question_tags)
    assert re.findall(r"ReadSchema: struct<([^>]*)>", tags) == ["Id:bigint,Tags:string"]


def test_top_tags_never_sort_everything(stored):
    plan = physical(topics.keep_top_tags(stored.all_question_tags, 3))
    assert "TakeOrderedAndProject(limit=3" in plan and "GlobalLimit" not in plan


def test_nothing_is_broadcast_unmeasured(stored, tmp_path):
    """With Spark's own decision switched off, no join of tags, titles and samples is a broadcast."""
    many = topics.tag_counts(stored.all_question_tags)
    drawn = sampling.sample_titles(stored.all_question_tags, stored.questions, many, 3, "s", str(tmp_path))
    frames = (topics.keep_top_tags(stored.all_question_tags, 1), sampling.add_titles(drawn.select("question_id", "tag"), stored.questions))
    for frame in frames:
        assert "Broadcast" not in physical(frame)


def test_one_aggregate_feeds_both_long_tables(stored):
    from forum_signals.operators import rates

    plan = physical(rates.rate_per_topic_category(stored.topic_counts))
    assert plan.count("SortMergeJoin") == 3  # comments with posts, tags with the top list, tags with flags
    assert "Expand" in plan


def test_hot_post_is_split_by_the_adaptive_join(spark, tmp_path):
    """One post holds most comments: its join partition is split, and no row is lost."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    n = 40_000
    posts = spark.range(1, 2001).select(
        F.col("id").alias("Id"), F.lit(1).cast("byte").alias("PostTypeId"), F.lit(None).cast("long").alias("ParentId")
    )
    hot = F.when(F.col("id") % 3 != 0, F.lit(7)).otherwise(F.col("id") % 2000 + 1)
    comments = spark.range(n, numPartitions=16).select(
        F.col("id").alias("Id"), hot.alias("PostId"), F.concat(F.lit("is this for "), F.sha2(F.col("id").cast("string"), 512)).alias("Text")
    )
    posts, comments = write_table(posts, f"{tmp_path}/p"), write_table(comments, f"{tmp_path}/c")
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        flagged = flags.flag_comments_of(comments, posts)
        assert write_table(flagged, f"{tmp_path}/out").count() == n
        executed = flagged._jdf.queryExecution().executedPlan()
        flagged.collect()
        assert "skew=true" in executed.toString().replace("isSkew=true", "skew=true") or "skewed" in executed.toString()
        per_question = flags.question_miscomm_of(posts, comments, model.answers(posts.withColumn("Body", F.lit(""))
            .withColumn("CreationDate", F.lit("")).withColumn("Score", F.lit(0))))
        assert per_question.where("cat_scope_ambiguity").count() == per_question.count()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
