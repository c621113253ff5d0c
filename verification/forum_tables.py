"""A forum derived from the given tables, over whole tables and whole texts.

orders      -> questions (title: opening user turn of a conversation, whose other turns are comments; tags: segment,
               status, nation)
lineitem    -> short answers with markup, an encoded tag and a code block that must not match
documents   -> long answers
pages       -> answers of raw HTML, some without a parent, some with an unknown parent
supplier    -> posts that are neither question nor answer
events      -> comments on questions, answers, other posts and missing posts
conversations -> comments on questions, answers and other posts
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forum_signals.functions.text import tokenize
from forum_signals.operators.topics import explode_tags, tag_counts
from forum_signals.operators.model import questions as question_view
from forum_signals.plans.forum import Forum
from forum_signals.sources.norms import clean_norms
from forum_signals.sources.schemas import COMMENTS, POSTS, TAGS, enforce
from verification.phrases import SPLICED, TEST_SETTINGS

# Identifier ranges of the derived posts.
TURN, WIKI, DOCUMENT, PAGE, ELSEWHERE = (k * 10**12 for k in (1, 2, 4, 5, 9))
LINE = 10**18


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt evenly over the cores: a file may hold all its rows in one block, which one task would read and match."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def hash_number(key: Column) -> Column:
    """The first eight hex digits of md5 as a number: the same in every engine."""
    return F.conv(F.substr(F.md5(key), F.lit(1), F.lit(8)), 16, 10).cast("bigint")


def phrase(key: Column) -> Column:
    """One of the spliced phrases, or '' for half of the keys."""
    index = hash_number(key) % (2 * len(SPLICED)) + 1
    return F.coalesce(F.get(F.array(*[F.lit(p) for p in SPLICED]), index.cast("int") - 1), F.lit(""))


def key(prefix: str, *parts: Column | str) -> Column:
    return F.concat_ws(":", F.lit(prefix), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])


def iso(timestamp: Column) -> Column:
    return F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSS")


def question_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations")
    openings = turns.where((F.col("turn") == 0) & (F.col("role") == "user")).select(
        F.col("conv_id").alias("opening"), F.col("text").alias("Title")
    )
    n_conversations = turns.agg(F.max("conv_id") + 1).scalar()
    orders = load(spark, sf_dir, "orders").withColumn("opening", F.col("o_orderkey") % n_conversations)
    tags = F.concat(
        F.lit("<"), F.lower("c_mktsegment"), F.lit("><status-"), F.lower("o_orderstatus"),
        F.lit("><nation-"), F.col("c_nationkey"), F.lit(">"),
    )
    return (
        orders.join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(openings, "opening", "left")
        .select(
            (F.col("o_orderkey") * 10).alias("Id"),
            F.lit(1).alias("PostTypeId"),
            F.lit(None).cast("bigint").alias("ParentId"),
            F.concat(F.lit("<p>how do i "), "o_orderpriority", F.lit("</p>")).alias("Body"),
            "Title",
            F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", tags).alias("Tags"),
            iso(F.col("o_orderdate")).alias("CreationDate"),
            F.floor(F.col("o_totalprice") / 1000).alias("Score"),
            F.col("c_nationkey").alias("AnswerCount"),
            F.floor("o_totalprice").alias("ViewCount"),
        )
    )


def _reply(**columns: Column) -> list[Column]:
    blank = {
        "Title": F.lit(None).cast("string"), "Tags": F.lit(None).cast("string"),
        "CreationDate": F.lit(None).cast("string"), "Score": F.lit(0), "AnswerCount": F.lit(0), "ViewCount": F.lit(0),
    }
    return [{**blank, **columns}[f.name].alias(f.name) for f in POSTS.schema]


def line_key() -> Column:
    """Order and line number as one number; several lines of the table can share it."""
    return F.col("l_orderkey") * 10 + F.col("l_linenumber")


def line_id() -> Column:
    return LINE + line_key() * 10**9 + F.col("l_partkey") * 10**4 + F.col("l_suppkey")


def line_answers(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    """Every line of the table is an answer to its order's question.

    Where texts are read, both sides of the join are dealt by part: names are coded so well in the file that Spark would
    broadcast twenty times its threshold through the driver.
    """
    lines, parts = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    lines = lines.join(parts.hint("merge") if dealt else parts, F.col("l_partkey") == F.col("p_partkey"))
    body = F.concat(
        F.lit("<p>"), "p_name", F.lit(" &amp; "), "p_type", F.lit(" List&lt;which one&gt; "),
        phrase(key("a", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")),
        F.lit("</p><pre><code>how do i</code></pre>"),
    )
    return lines.select(
        *_reply(
            Id=line_id(), PostTypeId=F.lit(2), ParentId=F.col("l_orderkey") * 10, Body=body,
            CreationDate=iso(F.col("l_shipdate")), Score=F.floor("l_quantity"),
        )
    )


def document_answers(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    body = F.concat(F.lit("<div>"), "text", F.lit(" "), phrase(key("d", "doc_id")), F.lit("</div>"))
    docs = load(spark, sf_dir, "documents")
    return (spread(docs, "doc_id") if dealt else docs).select(
        *_reply(
            Id=DOCUMENT + F.col("doc_id"), PostTypeId=F.lit(2), ParentId=F.col("doc_id") * 10, Body=body,
            Score=F.col("n_chars"),
        )
    )


def page_answers(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    parent = (
        F.when(F.col("url").like("http:%"), None)
        .when(F.col("url").like("%.org/%"), ELSEWHERE + F.col("page_id"))
        .otherwise(F.col("page_id") * 10)
    )
    body = F.concat("html", F.lit("<p>"), phrase(key("p", "page_id")), F.lit("</p>"))
    pages = load(spark, sf_dir, "pages")
    return (spread(pages, "page_id") if dealt else pages).select(
        *_reply(Id=PAGE + F.col("page_id"), PostTypeId=F.lit(2), ParentId=parent, Body=body)
    )


def wiki_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "supplier").select(
        *_reply(
            Id=WIKI + F.col("s_suppkey"), PostTypeId=F.lit(4), ParentId=F.lit(None).cast("bigint"), Body=F.col("s_name")
        )
    )


def posts(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    """All posts. ``dealt`` moves the answers' rows evenly over the cores first, which pays only where their texts are worked on."""
    answers = [f(spark, sf_dir, dealt) for f in (line_answers, document_answers, page_answers)]
    parts = [question_posts(spark, sf_dir), *answers, wiki_posts(spark, sf_dir)]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return enforce(merged, POSTS.schema)


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    event_target = (
        F.when(kind.isin("view", "signup"), F.col("event_id") * 10)
        .when(kind == "error", WIKI + F.col("user_id"))
        .otherwise(F.coalesce("first_line", LINE + F.col("line")))
    )
    lines = load(spark, sf_dir, "lineitem").groupBy(line_key().alias("line")).agg(F.min(line_id()).alias("first_line"))
    events = load(spark, sf_dir, "events").withColumn("line", F.col("event_id") * 10 + 1 + F.col("user_id") % 7)
    from_events = events.join(lines, "line", "left").select(
        F.col("event_id").alias("Id"),
        event_target.alias("PostId"),
        F.concat_ws(" ", "event_type", "props", phrase(key("c", "event_id"))).alias("Text"),
        iso(F.col("ts")).alias("CreationDate"),
        F.floor("value").alias("Score"),
    )
    turn_target = (
        F.when(F.col("role") == "user", F.col("conv_id") * 10)
        .when(F.col("role") == "assistant", DOCUMENT + F.col("conv_id"))
        .otherwise(WIKI + F.col("conv_id"))
    )
    from_turns = spread(load(spark, sf_dir, "conversations"), "conv_id").select(
        (TURN + F.col("conv_id") * 1000 + F.col("turn")).alias("Id"),
        turn_target.alias("PostId"),
        F.concat_ws(" ", "text", phrase(key("t", "conv_id", "turn"))).alias("Text"),
        F.lit(None).cast("string").alias("CreationDate"),
        F.col("turn").alias("Score"),
    )
    return enforce(from_events.unionByName(from_turns), COMMENTS.schema)


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tag_counts(explode_tags(question_view(question_posts(spark, sf_dir))))
    numbered = counts.select(
        (hash_number(F.col("tag")) % 1_000_000_007).alias("Id"),
        F.col("tag").alias("TagName"),
        F.col("n_questions").alias("Count"),
    )
    return enforce(numbered, TAGS.schema)


def norm_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``Word, Conc, position``: each word of the documents twice, some unrated."""
    docs = spread(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    words = docs.select(F.explode(F.array_distinct(tokenize(F.col("text")))).alias("w")).distinct()
    bucket = hash_number(F.col("w"))
    first = F.struct(F.upper("w").alias("Word"), (1 + bucket % 401 / 100).alias("Conc"), F.lit(1).alias("position"))
    second = F.struct(
        F.col("w").alias("Word"),
        F.when(bucket % 5 != 0, 1 + F.floor(bucket / 7) % 401 / 100).alias("Conc"),
        F.lit(2).alias("position"),
    )
    return words.select(F.inline(F.array(first, second)))


def norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_norms(norm_rows(spark, sf_dir), "Word", "Conc", F.col("position"))


def forum(spark: SparkSession, sf_dir: str) -> Forum:
    return Forum(posts(spark, sf_dir), comments(spark, sf_dir), tags(spark, sf_dir), TEST_SETTINGS)
