"""Text functions: every one is a built-in column expression, none runs Python per row."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestat.functions.spaces import NOT_WHITE, OTHER_WHITE, WHITE, WHITE_CHARACTERS

# Fixed values.
MISSING_LABEL = "(manquant)"
BOOLEAN_WORDS = (
    "0", "1", "oui", "non", "o", "n", "true", "false", "vrai", "faux", "yes", "no", "y", "t", "f",
)
NULL_SENTINELS = ("na", "n/a", "nan", "null", "none", "nc", "n.c.", "-", "?", ".")

_COMBINING_FIRST, _COMBINING_LAST = 0x300, 0x36F
_HANGUL_FIRST, _HANGUL_LAST = 0xAC00, 0xD7A3


def blank_to_null(col: Column) -> Column:
    """Text of ``col`` where an empty or all-blank cell is NULL; other cells are untouched."""
    text = col.cast("string")
    return F.when(text.rlike(NOT_WHITE), text)


@lru_cache(maxsize=1)
def _folding_tables() -> tuple[str, str, str, dict[str, str]]:
    """Compatibility decomposition without diacritics, derived from the Unicode database.

    Returns (characters, their one-character replacements, characters to delete, expansions).
    Hangul syllables stay composed: their decomposition is one-to-one, so keys compare alike.
    """
    source, target, dropped, expanded = [], [], [], {}
    for code in range(0x80, 0x110000):
        if 0xD800 <= code <= 0xDFFF or _HANGUL_FIRST <= code <= _HANGUL_LAST:
            continue
        char = chr(code)
        folded = "".join(
            c
            for c in unicodedata.normalize("NFKD", char)
            if not _COMBINING_FIRST <= ord(c) <= _COMBINING_LAST
        )
        if folded == char:
            continue
        if not folded:
            dropped.append(char)
        elif len(folded) == 1:
            source.append(char)
            target.append(folded)
        else:
            expanded[char] = folded
    return "".join(source), "".join(target), "".join(dropped), expanded


@lru_cache(maxsize=1)
def _expansion_class() -> str:
    """Regular-expression class of the characters that fold to several characters."""
    codes = sorted(ord(c) for c in _folding_tables()[3])
    ranges, start, previous = [], codes[0], codes[0]
    for code in codes[1:] + [None]:
        if code is None or code != previous + 1:
            ranges.append(f"\\x{{{start:x}}}-\\x{{{previous:x}}}")
            start = code
        previous = code
    return r"[[^\x00-\x7f]&&[" + "".join(ranges) + "]]"


def _fold(col: Column) -> Column:
    """Compatibility decomposition, diacritics removed, every white space a plain space.

    Printable ASCII takes a short path.
    """
    source, target, dropped, expanded = _folding_tables()
    white = "".join(c for c in WHITE_CHARACTERS if c not in source)
    # One literal holds the whole table, cut at private-use characters.
    written = "\ue001".join(f"{char}\ue000{text}" for char, text in expanded.items())
    table = F.str_to_map(F.lit(written), F.lit("\ue001"), F.lit("\ue000"))
    spelled_out = F.array_join(
        F.transform(F.split(col, ""), lambda ch: F.coalesce(table[ch], ch)), ""
    )
    whole = F.when(col.rlike(_expansion_class()), spelled_out).otherwise(col)
    folded = F.translate(whole, source + white + dropped, target + " " * len(white))
    return F.when(col.rlike(r"[^\x20-\x7e]"), folded).otherwise(col)


def normalize_text(col: Column) -> Column:
    """Comparison key: lower case, no diacritics, single spaces; blanks are NULL."""
    key = _fold(F.lower(F.trim(blank_to_null(col), F.lit(WHITE_CHARACTERS))))
    return F.when(key.contains("  "), F.regexp_replace(key, " {2,}+", " ")).otherwise(key)


def as_modality(col: Column) -> Column:
    """Any type as a text modality, absence being a modality of its own."""
    return F.coalesce(col.cast("string"), F.lit(MISSING_LABEL))


def is_boolean_word(key: Column) -> Column:
    """Whether a normalised value is one of the usual spellings of a boolean."""
    return key.isin(*BOOLEAN_WORDS)


def is_null_sentinel(key: Column) -> Column:
    """Whether a normalised value is an absence written in full."""
    return key.isin(*NULL_SENTINELS)


def trailing_unit(col: Column) -> Column:
    """Non-numeric suffix glued to a value, NULL when there is none."""
    return F.nullif(F.regexp_extract(col, rf"([^\d,. {OTHER_WHITE}]+){WHITE}*$", 1), F.lit(""))


def has_unit(col: Column) -> Column:
    return trailing_unit(col).isNotNull()


def whole_pattern(col: Column) -> Column:
    """Shape of a value as a regular expression: digit and letter runs with their length.

    Runs are cut by inserting a separator wherever the character class changes, so the work is
    proportional to the text and stays inside the JVM.
    """
    # Private-use characters stand for the classes and the cuts; literals keep their own.
    digit, letter, cut = "\ue000", "\ue001", "\ue002"
    classes = F.regexp_replace(F.regexp_replace(col, r"\d", digit), r"\p{L}", letter)
    runs = F.split(F.regexp_replace(classes, r"(?s)(.)(?!\1)", "$1" + cut), cut)

    def written(run: Column) -> Column:
        first = F.substring(run, 1, 1)
        size = F.length(run)
        token = (
            F.when(first == digit, F.lit(r"\d"))
            .when(first == letter, F.lit(r"\w"))
            .when(first.rlike(r"^[()\[\]{}?*+\-|^$\\.&~# \t\n\r\x0b\x0c]$"), F.concat(F.lit("\\"), first))
            .otherwise(first)
        )
        return F.when(size == 0, F.lit("")).when(size == 1, token).otherwise(
            F.concat(token, F.lit("{"), size.cast("string"), F.lit("}"))
        )

    return F.array_join(F.transform(runs, written), "")


def shown_pattern(shape: Column, max_length: int = 48) -> Column:
    """A shape short enough to read. Count and group on the whole shape: shortened ones can coincide."""
    return F.when(F.length(shape) <= max_length, shape).otherwise(
        F.concat(F.substring(shape, 1, max_length), F.lit("…"))
    )


def generalize_pattern(col: Column, max_length: int = 48) -> Column:
    """Shape of a value, shortened for display."""
    return shown_pattern(whole_pattern(col), max_length)


def variant_table(vocabulary: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """Spelling → canonical label, from a vocabulary written canonical label → spellings."""
    return {spelling: label for label, spellings in vocabulary.items() for spelling in spellings}


def recode_value(col: Column, vocabulary: Mapping[str, Sequence[str]]) -> Column:
    """Synonyms replaced by their canonical label; unknown values pass through."""
    table = variant_table(vocabulary)
    if not table:
        return col
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(lookup[col], col)
