"""A tiny forum of literals with every odd case of the data model."""

from forum_signals.functions.lexicon import CATEGORY_COLUMNS
from forum_signals.plans.forum import Forum
from forum_signals.settings import AnalysisSettings
from forum_signals.sources.schemas import COMMENTS, POSTS, TAGS

SETTINGS = AnalysisSettings(
    top_n=3, min_questions=2, sample_size=2, stability_sizes=(1, 2, 5), stability_runs=3, stability_tags=2, seed="t"
)


def post(id, kind, parent=None, body=None, title=None, tags=None):
    return (id, kind, parent, body, title, tags, "2020-01-01T00:00:00.000", 0, 0, 0)


POST_ROWS = [
    post(1, 1, body="<p>do you mean this?</p>", title="Red apple tree", tags="<a><b>"),  # bodies of questions are not read
    post(2, 1, title="Abstract idea", tags="<a><c>"),
    post(3, 1, title=None, tags="<a>"),
    post(4, 1, title="Lonely apple", tags="<a><d>"),  # no answer, no comment
    post(5, 1, title="Apple idea", tags=None),
    post(6, 1, title="Other apple", tags="<b><c>"),
    post(11, 2, 1, "<p>I see now</p><code>how do i</code>"),
    post(12, 2, 1, "<p>fine</p>"),
    post(13, 2, 2, "<p>nothing</p>"),
    post(14, 2, None, "<p>how do I start</p>"),  # parent unknown
    post(15, 2, 99, "<p>in what units</p>"),  # parent not in the dump
    post(16, 2, 3, None),
    post(17, 2, 6, "<p>ok</p>"),
    post(21, 4, None, "wiki"),
    post(22, 0, None, None),
]
COMMENT_ROWS = [
    (101, 1, "fine", None, 0),
    (102, 13, "are you sure about that", None, 0),  # on an answer of question 2
    (103, 21, "do you mean all", None, 0),  # on neither question nor answer
    (104, 77, "do you mean all", None, 0),  # on a missing post
    (105, None, "do you mean all", None, 0),
    (106, 3, None, None, 0),
    (107, 5, "which part", None, 0),
    (108, 14, "which one", None, 0),  # on an answer without a known question
    (109, 6, "if by a\nb you mean", None, 0),  # raw text: a line break stops the gap, "you mean" still counts
]


def forum(spark, settings=SETTINGS):
    return Forum(
        spark.createDataFrame(POST_ROWS, POSTS.schema),
        spark.createDataFrame(COMMENT_ROWS, COMMENTS.schema),
        spark.createDataFrame([(1, "a", 4), (2, "b", 2)], TAGS.schema),
        settings,
    )


def flagged_names(row):
    return {c.removeprefix("cat_") for c in CATEGORY_COLUMNS if row[c]}
