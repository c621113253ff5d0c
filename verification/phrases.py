"""Phrases spliced into the test tables' invented prose, which holds no dialogue of its own."""

from forum_signals.settings import AnalysisSettings

# Two hits and one near miss per category, in category order.
SPLICED = (
    "what do you mean by that", "i see now", "i see nowhere",
    "what is build.sh trying to do", "what's the point of it", "what is the pointless thing",
    "what does non-null mean", "what is meant by idempotent", "what does it really mean",
    "which part", "what is foo referring to", "which parts",
    "you didn't mention the version", "can you post your code", "can you post a screenshot",
    "but earlier you said otherwise", "wait, did not you just say so", "wait, you just said",
    "was that a joke", "i'm totally serious", "i'm very serious",
    "how do i start", "what am i supposed to do", "how does it start",
    "is this for all", "in what context", "is this form for",
    "does each call of it return a row", "is it the same per item", "per item and overall",
    "which operator takes precedence", "is this and or or", "which takes precedence",
    "are you sure about this", "can we safely assume it", "are you sure it works",
    "faster than what", "in what units", "in what unit",
)

# Cut-offs for the small test tables.
TEST_SETTINGS = AnalysisSettings(
    top_n=20, min_questions=5, sample_size=20, stability_sizes=(5, 10, 20), stability_runs=3, stability_tags=5, seed="s"
)
