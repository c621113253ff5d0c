"""Phrase lexicon: thirteen kinds of miscommunication and the phrases that signal them.

Each phrase is a regular-expression fragment that is matched case-insensitively between
word boundaries. Two slots may appear in a fragment:

``{word}``  one word: letters/digits with inner hyphens or apostrophes
``{gap}``   1 to 80 characters on one line, as few as possible

``matching`` turns the fragments into Spark column expressions.
"""

from __future__ import annotations

# Fixed value: the published bound of a gap.
MAX_GAP = 80

# The published categories and phrases, in published order.
PHRASES: dict[str, tuple[str, ...]] = {
    "comprehension_failure": (
        r"you mean",
        r"i don't understand",
        r"i'm not sure if you",
        r"i'm not sure what you",
        r"i'm confused by what you",
        r"i can't tell if",
        r"what do you mean by\s+{gap}",
        r"i (kind of|sort of) (get|understand)",
        r"this is (a bit|kind of|somewhat) confusing",
        r"i'm not totally sure",
        r"let me rephrase",
        r"what i meant (was|is)",
        r"that came out wrong",
        r"i should have said",
        r"but that's what i'm asking",
        r"i misunderstood",
        r"i (took|interpreted) that as",
        r"i read that as",
        r"i thought you meant",
        r"if by\s+{gap}\s+you mean",
        r"if you mean",
        r"do you mean",
        r"are you (saying|meaning)",
        r"so you're saying",
        r"i see now",
        r"i understand now",
        r"that makes sense now",
        r"okay i get it now",
        r"i finally see",
        r"i finally understand",
        r"that finally makes sense",
        r"okay i finally get it",
        r"that clears it up",
    ),
    "intent_confusion": (
        r"what is\s+{gap}\s+trying to do",
        r"what is\s+{word}\s+(?:for|used for)",
        r"what are you trying to (do|say)",
        r"what(?: is|'s) the (point|reason|reasoning|purpose)\s+{gap}",
        r"i thought that's what you",
    ),
    "terminology": (
        r"what does\s+{word}\s+mean",
        r"what is\s+{word}\s+supposed to mean",
        r"i'm confused as to what\s+{word}\s+means",
        r"what is meant by\s+{word}",
        r"what do you mean by\s+{word}",
    ),
    "referential": (
        r"which (one|part|thing)",
        r"what are you referring to",
        r"what does\s+{word}\s+refer to",
        r"what is\s+{word}\s+referring to",
        r"what (is|are) that",
    ),
    "missing_info": (
        r"you (didn't|did not) (say|mention|include)",
        r"you forgot to (say|explain|specify|state|write|mention|show)",
        r"you left out",
        r"there's no (info|information|details|detail)",
        r"you (haven't|have not) (shown|provided|included|explained|mentioned)",
        r"can you (show|provide|include|share|post) (the|your)",
        r"what (error|output|result|version) (are|do|did) you",
        r"where (is|are) (the|your) (error|output|code|definition|declaration)",
    ),
    "contradiction": (
        r"but (earlier|before|above|previously) you (said|wrote|mentioned)",
        r"but how does that relate to",
        r"isn't that not what you want",
        r"but you just said",
        r"that's not what you (just )?said",
        r"wait[,]? (didn't|did not) you (just )?say",
        r"you're contradicting",
        r"that contradicts",
        r"that's the opposite of what you",
        r"that conflicts with (what you|your)",
    ),
    "pragmatic_tone": (
        r"i can't tell if you're (serious|joking)",
        r"was that (sarcasm|a joke)",
        r"are you (being )?serious",
        r"you (can't|cannot) be serious",
        r"are you joking",
        r"i'm (being |totally |completely )?serious",
        r"this is (a genuine|an honest) question",
        r"i'm not (trying to be |being )?sarcastic",
    ),
    "actionability": (
        r"what (should|am i supposed to) do",
        r"how (do|am i supposed to|would i)",
    ),
    "scope_ambiguity": (
        r"does this apply to",
        r"are we talking about",
        r"is this for",
        r"do you mean (?:all|some|any|one|now|generally|in general)",
        r"does this apply to (?:all|everything|every case)",
        r"are you talking about (?:all|every case|a specific case)",
        r"which ones exactly",
        r"in what (context|scenario|case|situation)",
        r"under what (conditions|circumstances)",
        r"is this (always|only|sometimes) (true|the case|applicable)",
        r"for (all|every|any|which) (cases?|scenarios?)",
    ),
    "quantifier_distribution": (
        r"do(?:es)? (?:you|this|that|it) mean (?:each|every|all|both|any|one|a specific one)",
        r"are you saying (?:each|every|all|both|any|one|a specific one)",
        r"does (?:each|every) {gap} (?:have|get|need|return|contain|use)",
        r"is (?:this|that|it) (?:shared|common to all|per item|per element|inclusive|exclusive)",
        r"does (?:this|that|it) include {gap}",
        r"does this include the end",
        r"does this mean (?:every|all|any|only one|a specific)",
        r"should (?:all|every|any|only one|a specific) {gap} (?:be|have|get|return|contain|use|match)",
        r"do(?:es)? (?:you|this|that|it) mean {gap} (?:per item|per element|per row|per object|overall|total|collectively)",
        r"is (?:this|that|it) {gap} (?:per item|per element|per row|per object|overall|total|collectively)",
        r"(?:per item|per element|per row|per object) or (?:overall|total|collectively)",
        r"(?:overall|total|collectively) or (?:per item|per element|per row|per object)",
    ),
    "logical_structure": (
        r"do(?:es)? (?:you|this|that|it) mean both {gap} and {gap}",
        r"are you saying {gap} applies to both",
        r"how is this grouped",
        r"what applies to what",
        r"which has (priority|precedence)",
        r"does (this|that|it) apply to (both|all|each)",
        r"how (do|does) (these|this) (group|nest|combine|associate)",
        r"which {word} (takes?|ha(?:s|ve)) (priority|precedence|effect)",
        r"is (?:this|that|it) (?:and|or) or (?:and|or)",
        r"what's the (grouping|nesting|evaluation order)",
    ),
    "epistemic": (
        r"do we know that",
        r"are we assuming",
        r"are you assuming",
        r"is this guaranteed",
        r"do you mean if it is known to be",
        r"is it (assumed|known)",
        r"can (we|you|i) (safely )?assume",
        r"is it safe to assume",
        r"how (do|did) you know",
        r"what makes you (think|say|believe|assume)",
        r"are you sure (that|about|of|this)",
        r"is (that|this|it) (always|necessarily|definitely) (true|the case|correct)",
        r"can (we|you|i) be sure",
    ),
    "comparison_measurement": (
        r"than what",
        r"compared to what",
        r"relative to what",
        r"more than what",
        r"what units is",
        r"in what units",
    ),
}

CATEGORY_NAMES: tuple[str, ...] = tuple(PHRASES)
CATEGORY_PREFIX = "cat_"
CATEGORY_COLUMNS: tuple[str, ...] = tuple(CATEGORY_PREFIX + name for name in CATEGORY_NAMES)
