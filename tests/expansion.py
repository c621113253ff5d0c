"""Sample texts from lexicon fragments, and the plain Python form of their patterns."""

import re

from forum_signals.functions.lexicon import MAX_GAP, PHRASES

WORD = r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*"


def python_pattern(phrases):
    filled = (p.replace("{word}", WORD).replace("{gap}", f".{{1,{MAX_GAP}}}?") for p in phrases)
    return re.compile("|".join(rf"\b{p}\b" for p in filled), re.IGNORECASE)


PYTHON_PATTERNS = {name: python_pattern(phrases) for name, phrases in PHRASES.items()}


def expand(fragment):
    """Every text a fragment stands for, with one sample word or gap in each slot."""
    group = re.search(r"\((?:\?:)?([^()]*)\)(\?)?", fragment)
    if group:
        for option in group.group(1).split("|") + ([""] if group.group(2) else []):
            yield from expand(fragment[: group.start()] + option + fragment[group.end() :])
        return
    optional = re.search(r"(\[,\]|\w)\?", fragment)
    if optional:
        for option in (optional.group(1).strip("[]"), ""):
            yield from expand(fragment[: optional.start()] + option + fragment[optional.end() :])
        return
    yield fragment.replace("{word}", "foo-bar's").replace("{gap}", "a.b c").replace(r"\s+", " ")
