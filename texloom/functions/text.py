"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space, as in Python's ``str.isspace``; explicit, since engines' ``\s`` differ.
WHITE = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A number (group 1) or a word (group 2).
NUMBER_OR_WORD = r"(\p{Nd}+[-–.]?\p{Nd}*)|([\p{L}\p{N}_]+)"


def strip(c: Column) -> Column:
    """Without white space at either end, of whatever kind."""
    return F.regexp_replace(c, f"^[{WHITE}]+|[{WHITE}]+$", "")


def is_blank(c: Column) -> Column:
    return c.rlike(f"^[{WHITE}]*$")


def lines(c: Column) -> Column:
    """The lines of a text that aren't blank, stripped; null for a null text."""
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")


def raw_lines(c: Column) -> Column:
    """The lines of a text that aren't blank, each with its line break."""
    return F.filter(F.regexp_extract_all(c, F.lit("([^\n]*\n|[^\n]+)"), 1), lambda x: ~is_blank(x))


def fingerprint(c: Column) -> Column:
    """MD5, in hex, of the lines that aren't blank with their line breaks: equal for texts that differ in blank lines only."""
    return F.md5(F.array_join(raw_lines(c), ""))


def words(c: Column) -> Column:
    """Parts of a text between white space."""
    return F.filter(F.split(c, f"[{WHITE}]+"), lambda x: x != "")


def numbers_and_words(c: Column) -> tuple[Column, Column]:
    """How many numbers and how many words a sentence has."""
    numbers = F.size(F.filter(F.regexp_extract_all(c, F.lit(NUMBER_OR_WORD), 1), lambda x: x != ""))
    others = F.size(F.filter(F.regexp_extract_all(c, F.lit(NUMBER_OR_WORD), 2), lambda x: x != ""))
    return numbers, others


def keeps_sentence(c: Column, min_words: int, max_ratio: float) -> Column:
    """Whether a sentence has enough words, and not too many numbers for them (a ratio of 0 or less: no such limit)."""
    long_enough = F.size(words(c)) >= min_words
    if max_ratio <= 0:
        return long_enough
    numbers, others = numbers_and_words(c)
    return long_enough & (others > 0) & (numbers <= others * F.lit(max_ratio))


def id_from_path(c: Column) -> Column:
    """The name of a file without its folders and all of its suffixes."""
    return F.regexp_extract(c, r"([^/]+?)(?:\.[^/.]+)*$", 1)


def clean_name(c: Column) -> Column:
    """A source's or dataset's name as it should have been spelled: lower case, joined by ``_``."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")
