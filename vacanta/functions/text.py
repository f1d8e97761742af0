"""Text column expressions (JVM-side, no Python UDFs)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ------------------------------------------------------------
# Invisible characters removed by the text repair: U+200B, U+200E, U+200F,
# U+2060, U+FEFF. U+200D (zero-width joiner, used inside emoji) is kept.
INVISIBLE_CLASS = "[\\x{200B}\\x{200E}\\x{200F}\\x{2060}\\x{FEFF}]"
# Whitespace as Python's str patterns define it (``\s`` = str.isspace): tab, LF, VT,
# FF, CR, the four information separators U+001C..U+001F, space, NEL, NBSP,
# U+1680, U+2000..U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
WHITESPACE_CLASS = ("[\\x{9}-\\x{D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
                    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]")
# ------------------------------------------------------------------------------
CASED_CLASS = "[\\p{Lu}\\p{Ll}\\p{Lt}]"
# The same two sets as plain characters, for ``translate``.
INVISIBLES = "\u200b\u200e\u200f\u2060\ufeff"
WHITESPACES = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
               + "\u2028\u2029\u202f\u205f\u3000")


def repair(c: Column) -> Column:
    """Drop zero-width characters, collapse whitespace runs to one space, trim.

    One ``translate`` drops the ones and makes the others spaces; the pattern for runs is
    tried on the few values that have two spaces side by side."""
    spaced = F.translate(c, WHITESPACES + INVISIBLES, " " * len(WHITESPACES))
    return F.trim(F.when(F.contains(spaced, F.lit("  ")), F.regexp_replace(spaced, " +", " ")).otherwise(spaced))


def python_title(c: Column) -> Column:
    """Python ``str.title``: a cased character is upper-cased when the character
    before it is not cased, lower-cased otherwise (unlike ``initcap``, which only
    looks at spaces).

    The string is split into maximal runs of cased / uncased characters; each
    cased run becomes upper(first) + lower(rest) and uncased runs are kept --
    one regex split per value instead of a regex per character."""
    runs = F.regexp_extract_all(c, F.lit(f"({CASED_CLASS}+|[^\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+)"), 1)
    fixed = F.transform(runs, lambda t: F.when(
        F.upper(t) != F.lower(t),
        F.concat(F.upper(t.substr(F.lit(1), F.lit(1))), F.lower(t.substr(F.lit(2), F.length(t))))).otherwise(t))
    return F.array_join(fixed, "")


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace (Python's set)."""
    return F.regexp_replace(c, f"^{WHITESPACE_CLASS}+|{WHITESPACE_CLASS}+$", "")


def collapse_ws(c: Column) -> Column:
    """Python ``re.sub(r'\\s+', ' ', s)``."""
    return F.regexp_replace(c, WHITESPACE_CLASS + "+", " ")


def leading_letters(c: Column) -> Column:
    """Leading ASCII letters of a string, null when there are none."""
    return F.nullif(F.regexp_extract(c, "^([A-Za-z]+)", 1), F.lit(""))


def contains_ci(c: Column, pattern: str) -> Column:
    """Case-insensitive regex search, null-safe (null text never matches)."""
    return F.coalesce(c.rlike("(?i)" + pattern), F.lit(False))
