"""How the registered queries get their base tables from the given ones."""

import os
import re

import pytest
from pyspark.sql import functions as F

from forum_signals.functions import text
from forum_signals.operators.model import linkable_roots
from forum_signals.session import shared_dir
from verification import base, forum_tables

SF_DIR = os.environ.get("FORUM_CHECK_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def scanned(df):
    """The given tables that a plan reads, with repeats."""
    plan = df._jdf.queryExecution().optimizedPlan()
    files = [str(leaf) for leaf in re.findall(r"Relation \[([^\]]*)\]", plan.toString())]
    return [re.match(r"[a-z]+_?", f).group(0) for f in files]


def test_a_query_reads_only_the_tables_of_its_rows(spark):
    """Tags come from orders, customers and titles: no answer is read, and no base table is written first."""
    folder = f"{shared_dir(spark)}/forum_signals"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    tags = base.forum(spark, SF_DIR).all_question_tags
    assert not [r for r in scanned(tags) if r.startswith(("l_", "doc", "page", "p_", "s_"))]
    after = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert not [name for name in after - before if name.startswith("forum-")]


def test_a_stored_table_has_the_derived_rows(spark):
    work = base.BaseWorkspace(spark, f"{shared_dir(spark)}/derived-test", base.TEST_SETTINGS, sf_dir=SF_DIR)
    derived = work.posts
    assert not work.saved
    work.path("posts")
    assert work.saved == {"posts"} and work.posts.columns == derived.columns
    assert work.posts.exceptAll(derived).isEmpty() and derived.exceptAll(work.posts).isEmpty()


def test_norms_read_the_documents_once(spark):
    """And cut them at what is no letter, several times as fast as extracting each run of letters."""
    norms = forum_tables.norms(spark, SF_DIR)
    assert scanned(norms) == ["doc_"]
    assert "regexp_extract_all" not in norms._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_at_the_ends(spark):
    texts = spark.createDataFrame([("",), ("--",), ("a",), ("1a B2",), ("İx K",), (None,)], "t string")
    found = [r[0] for r in texts.select(text.tokenize(F.col("t"))).collect()]
    assert found == [[], [], ["a"], ["a", "b"], ["i", "x", "k"], []]


def moved(df):
    """Whether a plan moves rows of a table before it reads them."""
    return "RepartitionByExpression" in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("source", [base.forum, base.fresh_workspace])
def test_rows_are_dealt_only_where_their_texts_are_read(spark, source):
    tables = source(spark, SF_DIR)
    assert moved(tables.answers)
    assert not moved(linkable_roots(tables.posts))
    assert not moved(tables.posts.where("PostTypeId = 2").agg(F.count("*")))


def test_undealt_posts_are_the_same_rows(spark):
    dealt, undealt = (forum_tables.posts(spark, SF_DIR, dealt=d) for d in (True, False))
    assert dealt.schema == undealt.schema
    assert dealt.exceptAll(undealt).isEmpty() and undealt.exceptAll(dealt).isEmpty()


def test_parts_of_answers_are_never_broadcast(spark):
    """However small their file is."""
    plan = forum_tables.line_answers(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
