"""Text functions on columns. Unicode classes are spelled out, as engines differ on the short forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word characters, white space and line ends as Python has them (fixed patterns, alike in Java's and RE2's syntax).
WORD = r"[\p{L}\p{N}_]+"
GAP = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{GAP}]+"
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
PIECE = f"[{GAP}]*[^{GAP}]+|[{GAP}]+"


def nothing_null(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lines(text: Column) -> Column:
    """All lines; a line end at the very end opens no further line, and an empty text has none."""
    return F.element_at(F.transform(F.array(F.split(text, LINE_END, -1)), lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a)), 1)


def words(text: Column) -> Column:
    """What white space separates."""
    return F.filter(F.split(text, WS, -1), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def pieces(text: Column) -> Column:
    """Words with the white space before them; together they are the text."""
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}|{WS}$", "")


def normalised(text: Column) -> Column:
    """LF line ends, at most one empty line in a row, single blanks, bare ends."""
    text = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\t"), F.lit(" "))
    return stripped(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " "))


def strided_sample(text: Column, size: int, parts: int, above: int = 0) -> Column:
    """`parts` slices of `size` code points at equal strides, an empty line between them; texts of `above` code points or
    fewer stay whole."""
    n = F.char_length(text)
    step = F.floor(n / parts).cast("int")
    cut = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.substring(text, i * step + 1, F.lit(size))), "\n\n")
    return F.when(n > above, cut).otherwise(text)


def repetition(text: Column, n: int = 4) -> Column:
    """One less the share of different n-word windows, to four places; 0 for texts of fewer words."""
    def share(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.element_at(F.transform(F.array(windows), lambda x: F.round(1 - F.size(F.array_distinct(x)) / F.size(x), 4)), 1)

    return F.element_at(F.transform(F.array(words(text)), lambda w: F.when(F.size(w) < n, F.lit(0.0)).otherwise(share(w))), 1)
