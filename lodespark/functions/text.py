"""Text functions as Spark columns. Lengths and places count code points."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All line breaks of Unicode text, white space at either end, and the breaks after a sentence.
BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SENTENCE_END = "(?<=[.!?…。])(?U:\\s+)"
HEADING = "^(#{1,6})(?U:\\s+)(.*)$"
WORD = "[0-9A-Za-z가-힣]+"
_WORD = re.compile(WORD)
NUMBER = "[0-9]+(?:[.,][0-9]+)?"
CITATION = "\\[([0-9]+)\\]"


def strip(x: Column) -> Column:
    """Without Unicode white space at either end; trim() alone knows only the space character."""
    return F.btrim(x, F.lit(SPACE))


def lines(x: Column) -> Column:
    """Lines of a text, without the empty one after a final break."""
    parts = F.split(x, BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def sentences(x: Column) -> Column:
    """Stripped sentences that aren't empty; a line break ends a sentence, a point within a number doesn't."""
    found = F.flatten(F.transform(lines(x), lambda one: F.split(strip(one), SENTENCE_END)))
    return F.filter(F.transform(found, strip), lambda s: s != "")


def words(x: Column) -> Column:
    """Word tokens: runs of digits, Latin letters and Hangul syllables, lower-cased after they were found."""
    return F.transform(F.regexp_extract_all(x, F.lit(WORD), F.lit(0)), lambda w: F.lower(w))


def word_list(text: bytes) -> list[str]:
    """The same of a UTF-8 text within a task. Of the characters in words only A-Z have a lower case, so these can be lowered first."""
    return _WORD.findall(text.lower().decode("utf-8", "replace"))


def prefix_of(section: Column) -> Column:
    return F.when(section != "", F.concat(F.lit("["), section, F.lit("] "))).otherwise(F.lit(""))


def sections(x: Column) -> Column:
    """array<struct<title, body>> of a markdown text: the text before the first heading has no title, and
    headings without a body are left out. Sections start where a line is a heading, so the text is split
    there and each part gives its own first line away."""
    plain = F.regexp_replace(F.concat(F.lit("\n"), x), BREAK, "\n")
    parts = F.split(plain, "\\n(?=#{1,6}(?U:[\\s&&[^\\n]]))", -1)

    def one(part: Column, i: Column) -> Column:
        first = F.substring_index(part, "\n", 1)
        is_heading = (i > 0) & first.rlike(HEADING)
        title = F.when(is_heading, strip(F.regexp_extract(first, HEADING, 2))).otherwise(F.lit(""))
        body = F.when(is_heading, F.substring(part, F.length(first) + 2, F.length(part))).otherwise(part)
        return F.struct(title.alias("title"), strip(body).alias("body"))

    return F.filter(F.transform(parts, one), lambda s: s["body"] != "")


def citations(x: Column) -> Column:
    """Numbers in brackets; one too large for a BIGINT is null."""
    return F.transform(F.regexp_extract_all(x, F.lit(CITATION), F.lit(1)), lambda c: c.try_cast("bigint"))


def without_citations(x: Column) -> Column:
    return F.regexp_replace(x, CITATION, "")


def numbers(x: Column) -> Column:
    """Numbers of a text outside citations."""
    return F.regexp_extract_all(without_citations(x), F.lit(NUMBER), F.lit(0))


def slices(x: Column, size: Column | int) -> Column:
    """A text in parts of ``size`` characters."""
    n = F.lit(size) if isinstance(size, int) else size
    return F.when(F.length(x) > 0, F.transform(F.sequence(F.lit(0), F.length(x) - 1, n), lambda i: F.substring(x, i + 1, n))).otherwise(F.array().cast("array<string>"))


def first_line(x: Column, size: int = 60) -> Column:
    """The first line of a stripped text, cut at ``size`` characters and stripped again."""
    return strip(F.substring(F.coalesce(F.get(lines(strip(x)), F.lit(0)), F.lit("")), 1, size))


def preview(x: Column, size: int = 120) -> Column:
    one = F.replace(x, F.lit("\n"), F.lit(" "))
    return F.when(F.length(one) > size, F.concat(F.substring(one, 1, size), F.lit("…"))).otherwise(one)


def blank_to_null(x: Column) -> Column:
    return F.when(strip(x) != "", x)
