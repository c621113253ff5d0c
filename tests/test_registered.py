"""Registered queries beside their SQL, on the smallest tables.

FORUM_CHECK=all runs all of them (some minutes); by default one per family is run.
"""

import os

import pytest

from verification.check import compare, views
from verification.oracle import ORACLE
from verification.queries import QUERIES

SF_DIR = os.environ.get("FORUM_CHECK_DIR", "/root/testdata/sf0.001")
FAMILIES = (
    "a1_scan_dump_rows", "b1_questions", "c1_comments_with_posts", "d6_rate_per_tag_category", "e4_repeated_samples",
    "f1_union_flags", "g9_flag_answers", "h13_pairwise_by_category", "k6_contingency",
)
CHOSEN = sorted(QUERIES) if os.environ.get("FORUM_CHECK") == "all" else FAMILIES

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return views(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    families = {letter: sum(n.startswith(letter) for n in QUERIES) for letter in "abcdefghk"}
    assert families == {"a": 13, "b": 8, "c": 5, "d": 13, "e": 5, "f": 2, "g": 15, "h": 13, "k": 9}


@pytest.mark.parametrize("name", CHOSEN)
def test_same_rows_as_sql(spark, duck, name):
    equal, message = compare(spark, duck, name, QUERIES[name], ORACLE[name], SF_DIR)
    assert equal, message


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).columns == ["topic", "n_questions", "n_miscomm", "miscomm_rate"]
    assert set(contract.oracle_sql()) <= set(contract.queries())
