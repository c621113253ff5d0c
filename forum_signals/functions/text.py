"""Text functions on columns: HTML to prose, tag strings to arrays, prose to tokens."""

from __future__ import annotations

from collections.abc import Iterable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as whitespace in 7-bit text, and in any text (Java's \s is narrower).
ASCII_SPACE = r"[\t-\r\x1c-\x20]"
UNICODE_SPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# The entities that nearly all forum bodies are limited to. The ampersand is
# decoded last, so that "&amp;lt;" becomes "&lt;" and not "<".
COMMON_ENTITIES: dict[str, str] = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&#39;": "'",
    "&nbsp;": "\xa0",
    "&amp;": "&",
}

# The entities that markup itself needs; most bodies with an ampersand hold no other.
MARKUP_ENTITIES = ("&lt;", "&gt;", "&amp;")

# An ampersand that starts something other than such an entity, or a common one, or plain text.
_BEYOND_MARKUP = r"&(?!(?:lt|gt|amp);|[\t\n\f <&;]|\z)"
_OTHER_ENTITY = r"&(?!(?:lt|gt|quot|#39|nbsp|amp);|[\t\n\f <&;]|\z)"
# The forms of a reference (after its ampersand), as the HTML standard has them.
_REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# Numbers that the HTML standard replaces by the characters of an old code page, and names without ";".
_OLD_NUMBERS = {0: "\ufffd", 13: "\r"} | {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
_SHORT_NAMES = {name: char for name, char in html5.items() if not name.endswith(";")}
_LONGEST_SHORT = max(map(len, _SHORT_NAMES))


def unescape_common(text: Column, entities: Iterable[str] = tuple(COMMON_ENTITIES)) -> Column:
    """Decode only the common entities, or some of them (the ampersand last)."""
    for entity in entities:
        text = F.replace(text, F.lit(entity), F.lit(COMMON_ENTITIES[entity]))
    return text


def _table(values: dict, key: str = "string") -> Column:
    """A constant map. Two joined texts make it, so that the plan holds two literals and not thousands."""
    keys, chars = ("\x01".join(map(str, column)) for column in (values.keys(), values.values()))
    return F.map_from_arrays(F.split(F.lit(keys), "\x01", -1).cast(f"array<{key}>"), F.split(F.lit(chars), "\x01", -1))


def _character(number: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def _numeric(reference: Column) -> Column:
    """The text of ``#65;`` or ``#x41``."""
    digits = F.regexp_replace(F.regexp_replace(F.lower(reference), "[#;]", ""), "^(x?)0+(?=.)", "$1")
    is_hex = F.startswith(digits, F.lit("x"))
    shown = F.when(is_hex, F.substr(digits, F.lit(2))).otherwise(digits)
    # anything longer is beyond the last code point
    number = F.when(F.length(shown) <= 7, F.when(is_hex, F.conv(shown, 16, 10)).otherwise(shown).cast("int"))
    beyond = number.isNull() | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    # Code points that stand for no character.
    nothing = (
        number.between(0x1, 0x8) | (number == 0xB) | number.between(0xE, 0x1F) | (number == 0x7F)
        | number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(0xFFFE) == 0xFFFE)
    )
    old = F.try_element_at(_table(_OLD_NUMBERS, "int"), number)
    return F.when(old.isNotNull(), old).when(beyond, "\ufffd").when(nothing, "").otherwise(_character(number))


def _named(reference: Column) -> Column:
    """The text of ``copy;``, or of the longest name without ";" that it begins with, or NULL."""
    names = _table(_SHORT_NAMES)
    candidates = [F.try_element_at(_table(html5), reference)]
    for length in range(_LONGEST_SHORT, 1, -1):
        char = F.try_element_at(names, F.substr(reference, F.lit(1), F.lit(length)))
        shorter = F.length(reference) > length
        candidates.append(F.when(shorter, F.concat(char, F.substr(reference, F.lit(length + 1)))))
    return F.coalesce(*candidates)


def _decode_after_ampersand(part: Column) -> Column:
    reference = F.regexp_extract(part, _REFERENCE, 1)
    rest = F.substr(part, F.length(reference) + 1)
    plain = F.concat(F.lit("&"), reference)
    char = F.when(F.startswith(reference, F.lit("#")), _numeric(reference)).otherwise(F.coalesce(_named(reference), plain))
    return F.when(reference == "", F.concat(F.lit("&"), part)).otherwise(F.concat(char, rest))


def _unescape_any(text: Column) -> Column:
    """Decode every reference: the text is cut at its ampersands, and each part decodes its beginning."""
    parts = F.split(text, "&", -1)
    decoded = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), _decode_after_ampersand)
    return F.concat(F.get(parts, F.lit(0)), F.array_join(decoded, ""))


def unescape_entities(text: Column) -> Column:
    """Decode every HTML entity once, as the HTML standard does; a missing text gives ''.

    Texts without an ampersand are left alone, those with the common entities only take a few replacements.
    """
    text = F.coalesce(text, F.lit(""))
    beyond = F.when(text.rlike(_OTHER_ENTITY), _unescape_any(text)).otherwise(unescape_common(text))
    decoded = F.when(text.rlike(_BEYOND_MARKUP), beyond).otherwise(unescape_common(text, MARKUP_ENTITIES))
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


# The study's expressions for code and for tag names.
CODE_BLOCK = "(?is)<pre><code>.*?</code></pre>"
CODE_SPAN = "(?is)<code>.*?</code>"
TAG_NAME = "<([^>]+)>"


def drop_code_blocks(text: Column) -> Column:
    return F.regexp_replace(text, CODE_BLOCK, " ")


def drop_code_spans(text: Column) -> Column:
    return F.regexp_replace(text, CODE_SPAN, " ")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]*>", " ")


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def collapse_whitespace(text: Column) -> Column:
    """Single blanks, none at the ends. Plain ASCII texts are spared the larger class, and a single blank is no match."""
    plain, other = (F.regexp_replace(text, rf"{space}(?:{space}+|(?<! ))", " ") for space in (ASCII_SPACE, UNICODE_SPACE))
    return F.trim(F.when(is_ascii(text), plain).otherwise(other))


def markup_to_text(decoded: Column) -> Column:
    """Prose of an already entity-decoded body: no code, no tags, single blanks."""
    return collapse_whitespace(strip_tags(drop_code_spans(drop_code_blocks(decoded))))


def html_to_text(body: Column) -> Column:
    """Prose of a post body. Entities are decoded first, so an encoded tag is dropped too."""
    return markup_to_text(unescape_entities(body))


def parse_tags(raw_tags: Column) -> Column:
    """``<a><b>`` as an array of names; missing or empty gives an empty array."""
    names = F.regexp_extract_all(raw_tags, F.lit(TAG_NAME), F.lit(1))
    return F.coalesce(names, F.array().cast("array<string>"))


def tokenize(text: Column) -> Column:
    """Lower-case runs of a-z; missing gives an empty array."""
    words = F.array_remove(F.split(F.lower(text), "[^a-z]+", -1), "")
    return F.coalesce(words, F.array().cast("array<string>"))
