"""Sentences typed by hand with the categories they belong to, independent of the lexicon's code.

If a phrase of the lexicon were lost or misread, the SQL side would not notice; these do.
"""

import pytest
from pyspark.sql import functions as F

from forum_signals.functions import matching

SENTENCES = {
    "comprehension_failure": (["Sorry, I don't understand the second step.", "Okay I finally get it, thanks!"], ["You meant well.", "I don't under stand it."]),
    "intent_confusion": (["What is grep used for here?", "What are you trying to do with that loop?"], ["What were you trying to do?", "The point is moot."]),
    "terminology": (["What does idempotent mean?", "what is meant by back-pressure"], ["What does it all really mean?", "The mean of it is 3."]),
    "referential": (["Which thing do you call the root?", "what are you referring to"], ["Switch one off.", "I was referring to it."]),
    "missing_info": (["You left out the stack trace.", "Where is your definition of main?"], ["You left it out.", "Where was the code?"]),
    "contradiction": (["But above you wrote something else.", "That contradicts the manual."], ["Above you see it.", "It is a contradiction."]),
    "pragmatic_tone": (["Was that sarcasm?", "You cannot be serious."], ["That was a joke.", "This is a serious bug."]),
    "actionability": (["How would I start the server?", "what should do the trick"], ["How is it done?", "Do what you should."]),
    "scope_ambiguity": (["In what scenario does it fail?", "Under what circumstances?"], ["In which scenario?", "This applies to all."]),
    "quantifier_distribution": (["Does this include the end of the range?", "Is it shared?"], ["It includes the end.", "It was shared."]),
    "logical_structure": (["How is this grouped?", "Which operator takes precedence?"], ["How was this grouped?", "It takes precedence."]),
    "epistemic": (["Can I assume that the list is sorted?", "What makes you think so?"], ["I assume that.", "It makes you think."]),
    "comparison_measurement": (["Faster relative to what?", "In what units is that?"], ["More than that.", "In units of ten."]),
}


@pytest.mark.parametrize("category", list(SENTENCES))
def test_category(spark, category):
    hits, misses = SENTENCES[category]
    found = matching.detect_categories(F.col("t"))
    assert set(found) == set(SENTENCES)
    rows = spark.createDataFrame([(t,) for t in hits + misses], "t string").select("t", found[category].alias("f")).collect()
    assert {r.t: r.f for r in rows} == {**dict.fromkeys(hits, True), **dict.fromkeys(misses, False)}
