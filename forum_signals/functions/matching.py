"""The phrase lexicon as Spark expressions.

Regular expressions dominate the cost of the whole analysis, so three things keep them cheap
without changing any result:

* one expression with all phrases finds the first phrase of a text, if there is any; if no other begins
  after it, the thirteen category expressions are tried at that one place, and else from there on;
* phrases are grouped by first word, so that most word starts are dismissed after one letter;
* plain ASCII texts use Java's own word boundary; only the others need the Unicode one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forum_signals.functions.lexicon import CATEGORY_PREFIX, MAX_GAP, PHRASES
from forum_signals.functions.text import ASCII_SPACE, UNICODE_SPACE, is_ascii

HAS_MISCOMM = "has_miscomm"

GAP = rf".{{1,{MAX_GAP}}}?"
# Possessive, so that a long chain "a-a-a-..." is scanned without recursion. Blanks follow the
# slot inside a phrase; at the end of a phrase the first run of letters already decides.
INNER_WORD = r"[A-Za-z0-9]++(?:[-'][A-Za-z0-9]++)*+"
FINAL_WORD = r"[A-Za-z0-9]+"

_LETTER = r"[\p{L}\p{N}_]"
UNICODE_START = rf"(?<!{_LETTER})"
UNICODE_BOUNDARY = rf"(?:(?<={_LETTER})(?!{_LETTER})|(?<!{_LETTER})(?={_LETTER}))"

ALL_PHRASES: tuple[str, ...] = tuple(phrase for group in PHRASES.values() for phrase in group)


def _fill(phrase: str, space: str) -> str:
    if phrase.endswith("{word}"):
        phrase = phrase.removesuffix("{word}") + FINAL_WORD
    phrase = re.sub(r"\((?!\?)", "(?:", phrase)
    return phrase.replace("{word}", INNER_WORD).replace("{gap}", GAP).replace(r"\s", space)


def _openings(fragment: str) -> list[str]:
    """The fragment once per option of a group it starts with, so that it starts with a letter."""
    group = re.match(r"\(\?:([^()]*)\)", fragment)
    return [option + fragment[group.end() :] for option in group.group(1).split("|")] if group else [fragment]


def _by_first_word(fragments: Iterable[str]) -> tuple[str, str]:
    """The first letters, and one alternation with shared first letters and first words."""
    by_word: dict[str, list[str]] = {}
    for fragment in (opened for f in fragments for opened in _openings(f)):
        word = re.match(r"[a-z']+(?= )", fragment)
        by_word.setdefault(word.group(0) if word else "", []).append(fragment)
    by_letter: dict[str, list[str]] = {}
    for word, members in by_word.items():
        if word:
            rest = "|".join(member[len(word) + 1 :] for member in members)
            by_letter.setdefault(word[0], []).append(f"{word[1:]} (?:{rest})")
        else:
            for member in members:
                by_letter.setdefault(member[0], []).append(member[1:])
    alternation = "|".join(f"{letter}(?:{'|'.join(rests)})" for letter, rests in by_letter.items())
    return "".join(by_letter), alternation


def ascii_regex(phrases: Iterable[str]) -> str:
    """For 7-bit text: case-insensitive, ``.`` stops at a line feed only."""
    letters, body = _by_first_word(_fill(p, ASCII_SPACE) for p in phrases)
    return rf"(?id)\b(?=[{letters}])(?:{body})\b"


def unicode_regex(phrases: Iterable[str]) -> str:
    """For any text: Unicode case, blanks and word boundaries."""
    letters, body = _by_first_word(_fill(p, UNICODE_SPACE) for p in phrases)
    return rf"(?iud)(?=[{letters}]){UNICODE_START}(?:{body}){UNICODE_BOUNDARY}"


def _at_beginning(regex: str) -> str:
    """The regex for the beginning of a text only; Java then tries no other place."""
    flags, rest = re.match(r"(\(\?[a-z]+\))(.*)", regex, re.S).groups()
    return rf"{flags}\A{rest}"


def _either(ascii_only: Column, make: Callable[[Callable[[Iterable[str]], str]], Column]) -> Column:
    """What ``make`` builds with the expressions for 7-bit text, or with those for any text."""
    return F.when(ascii_only, make(ascii_regex)).otherwise(make(unicode_regex))


def matches(text: Column, phrases: Iterable[str], ascii_only: Column | None = None) -> Column:
    """True where any of ``phrases`` occurs in ``text``."""
    phrases = tuple(phrases)
    ascii_only = is_ascii(text) if ascii_only is None else ascii_only
    return _either(ascii_only, lambda regex: text.rlike(regex(phrases)))


def begins_with(text: Column, phrases: Iterable[str], ascii_only: Column) -> Column:
    """True where ``text`` begins with any of ``phrases``."""
    phrases = tuple(phrases)
    return _either(ascii_only, lambda regex: text.rlike(_at_beginning(regex(phrases))))


def from_first_phrase(text: Column, ascii_only: Column) -> Column:
    """The text from its first phrase of any category on, or ''."""
    return _either(ascii_only, lambda regex: F.regexp_extract(text, regex(ALL_PHRASES) + "(?s:.*)", 0))


def contains_miscomm(text: Column) -> Column:
    """True where any phrase of any category occurs; a missing text has none."""
    return matches(F.coalesce(text, F.lit("")), ALL_PHRASES)


def detect_categories(text: Column) -> dict[str, Column]:
    """One boolean column per category, keyed by category name."""
    text = F.coalesce(text, F.lit(""))
    return {name: matches(text, phrases) for name, phrases in PHRASES.items()}


def with_flags(texts: DataFrame, text: Column, keep: Iterable[str]) -> DataFrame:
    """``keep`` columns, ``has_miscomm`` and one ``cat_*`` column per category.

    Each step is its own projection, so that Catalyst computes the cleaned text, the ASCII
    test and the search for the first phrase once per row. A phrase begins where the text from the
    first one on begins, or after its first character, so nothing before that can change a category.

    The text from the first phrase on comes from a generator of one row, which a condition on a flag stops at. Pushed further
    down it would hold the whole cleaning once for every place where a step names it: tens of megabytes of plan.
    """
    keep, ascii_only, rest = list(keep), F.col("_ascii"), F.col("_rest")
    cleaned = texts.select(*keep, F.coalesce(text, F.lit("")).alias("_text"))
    gated = cleaned.select(*keep, "_text", is_ascii(F.col("_text")).alias("_ascii"))
    opened = gated.select(*keep, "_ascii", F.explode_outer(F.array(from_first_phrase(F.col("_text"), ascii_only))).alias("_rest"))
    found = opened.select(*keep, "_ascii", "_rest", (rest != "").alias(HAS_MISCOMM))
    # cut after its first character the rest may begin within a word: that finds too much, never too little
    later = matches(F.substr(rest, F.lit(2)), ALL_PHRASES, ascii_only)
    found = found.select(*found.columns, F.when(F.col(HAS_MISCOMM), later).otherwise(False).alias("_several"))
    flags = [
        F.when(~F.col(HAS_MISCOMM), False)
        .when(F.col("_several"), matches(rest, phrases, ascii_only))
        .otherwise(begins_with(rest, phrases, ascii_only))
        .alias(CATEGORY_PREFIX + name)
        for name, phrases in PHRASES.items()
    ]
    return found.select(*keep, HAS_MISCOMM, *flags)


def flag_columns(flagged: DataFrame) -> list[str]:
    """``has_miscomm`` and the category columns present in a flagged table."""
    return [HAS_MISCOMM, *category_columns(flagged)]


def category_columns(flagged: DataFrame) -> list[str]:
    """Category columns are discovered from the schema, so a changed lexicon needs no edit."""
    return [c for c in flagged.columns if c.startswith(CATEGORY_PREFIX)]
