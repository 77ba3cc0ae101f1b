"""Line-first cleaning: rules per line, then documents that lose too much text are rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP_CHARS, WORD_GAP, read, text_of

#: Fixed patterns of the line rules.
#: punctuation: the line must end a sentence, of whatever script; any closing quotes and brackets may follow
MARKS_OF_END = r".!?\x{2026}\x{3002}\x{ff01}\x{ff0e}\x{ff1f}\x{ff61}\x{964}\x{965}\x{61f}\x{6d4}\x{589}\x{1362}\x{1367}\x{17d4}\x{104b}\x{203c}\x{2047}\x{2048}\x{2049}"
CLOSERS = r"\x22')\]\x{bb}\x{ab}\x{201d}\x{2019}\x{201c}\x{2018}\x{203a}\x{300d}\x{300f}\x{3011}\x{ff09}\x{200f}\x{200e}"
ENDS = f"[{MARKS_OF_END}:;][{CLOSERS}]*$"
#: How many code points of a line's end are looked at first; only where these are closers alone does the whole line decide.
TAIL = 4
ALL_CLOSERS = f"^[{CLOSERS}]+$"
#: the start of a line to its last sentence end, if one is inside it (for tails, see cleaned)
HEAD = f"^([^\\n]*[{MARKS_OF_END}][{CLOSERS}]*)[\\x20\\x09-\\x0D][^\\n]*$"
#: symbols and marks that prose holds few of
SOME_MARK = r"[#*$%&|<>!~^=_{}\x{2022}\x{bb}\x{203a}]"
MARKS = r"[^#*$%&|<>!~^=_{}\x{2022}\x{bb}\x{203a}]+"
#: navigation: menus and breadcrumbs
NAV = r"(?i)^(home|menu|log ?in|log ?out|sign ?in|sign ?up|register|search|next|previous|prev|back|top|share|print|read more|load more|show more|skip to (main )?content|contact( us)?|about( us)?|site ?map|faq|help)([ |/>\x{2022}\x{bb}\x{203a}:.!-]+(home|menu|log ?in|log ?out|sign ?in|sign ?up|register|search|next|previous|prev|back|top|share|print|contact|about|us|site ?map|faq|help|more))*[ .!:\x{bb}\x{203a}>]*$"
#: boilerplate: notices that sites repeat
BOILERPLATE = r"(?i)(^|[^A-Za-z])(lorem ipsum|enable javascript|javascript (is|must be) (disabled|enabled|required)|cookie (policy|settings|consent)|we use cookies|uses cookies|privacy policy|terms of (use|service)|all rights reserved|click here to|subscribe to our newsletter|sign up for our newsletter|follow us on (facebook|twitter|instagram|x\b)|share (this|on) (facebook|twitter|page))"
MARKS_PER_WORD, LOST = 0.25, 0.3
MIN_WORDS, REPEATED_PERCENT = 50, 50
CAPS_LEAST = 12


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's variable holds it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _length(x: Column) -> Column:
    return F.char_length(x)


def unfinished(line: Column) -> Column:
    """Whether a line does not end a sentence."""
    return _let(F.substring(line, -TAIL, TAIL), lambda end: ~(end.rlike(ENDS) | (end.rlike(ALL_CLOSERS) & line.rlike(ENDS))))


def line_fails(line: Column, tails: bool = False) -> Column:
    """Whether a line (with a word in it) fails one of the rules, as long as its ends are bare of gaps. With tails, a line that
    holds a sentence end does not fail for its unfinished last sentence."""
    words = F.size(F.split(line, WORD_GAP))
    marks = _length(F.regexp_replace(line, MARKS, ""))  # a search first, as it makes no new text, and few lines hold any
    upper, lower = _length(F.regexp_replace(line, r"\P{Lu}+", "")), _length(F.regexp_replace(line, r"\P{Ll}+", ""))
    return (
        (unfinished(line) & ~line.rlike(HEAD) if tails else unfinished(line))
        | (line.rlike(SOME_MARK) & (marks > F.lit(MARKS_PER_WORD) * words))
        | (line.rlike(f"^(?:\\P{{Lu}}*+\\p{{Lu}}){{{CAPS_LEAST}}}") & (upper > lower))
        | line.rlike(NAV)
        | line.rlike(BOILERPLATE)
    )


def windows(hashes: str) -> Column:
    """A 64-bit hash for each three-word window, from the column of the words' hashes."""
    n = F.size(hashes)
    each = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.get(hashes, i - 1), F.get(hashes, i), F.get(hashes, i + 1)))
    return F.when(n < 3, F.array().cast("array<bigint>")).otherwise(each)


def repeated_words(three: str) -> Column:
    """How many words lie in a three-word window that the text holds twice or more, from the column of its windows' hashes.

    Sorting (hash, place) brings equal windows together; in the order of places, each such window adds the words that the one before it
    doesn't cover. Most texts repeat none, which a count of different hashes tells first.
    """
    def places(h: Column) -> Column:
        return _let(
            F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
            lambda s: F.sort_array(F.transform(F.filter(s, lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False))), lambda e: e["i"])),
        )

    def covered(p: Column) -> Column:
        return F.when(F.size(p) == 0, F.lit(0)).otherwise(
            F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-9).alias("at")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["at"])).alias("n"), i.alias("at")))["n"])

    return F.when(F.size(F.array_distinct(three)) == F.size(three), F.lit(0)).otherwise(_let(places(F.col(three)), covered))


def cleaned(docs: DataFrame, tails: bool = False) -> DataFrame:
    """All columns of docs, prefixed columns of the cleaning after them; columns of docs with a name that starts with q_ raise ValueError.

    A text is cut into lines at \\n. A line that holds a word goes if it doesn't end a sentence, holds more than
    MARKS_PER_WORD marks a word, is mostly capitals, is a menu, or is a notice that sites repeat; lines without words
    neither fail nor count. A document is rejected by the method if its failed lines hold more than LOST of the code
    points of all lines with words. Base rules: under MIN_WORDS words, or more than REPEATED_PERCENT percent of the
    words in repeated three-word windows.

    Adds q_words, q_word_chars, q_symbols, q_dup_lines, q_repeat_words (long), q_base_failed, q_kept (boolean), q_lines,
    q_failed_lines (long), q_text (the text without failed lines). Null and empty texts have no words, fail
    the base and keep their q_text (null or empty). Rows are judged one by one, so ties and repeated rows don't matter.
    Nothing is shuffled.

    With tails, a line that only lacks the end of its last sentence is cut after the sentence before, and what is cut counts as
    lost; a line without a sentence end goes whole, as it does by the rules of OP2_SQL.
    """
    if clash := [c for c in docs.columns if c.lower().startswith("q_")]:
        raise ValueError(f"columns named as those of the cleaning: {clash}")
    text = text_of()
    d = docs.withColumn("q_all", F.split(text, "\n"))
    d = d.withColumn("q_list", F.transform("q_all", lambda x: F.btrim(x, F.lit(GAP_CHARS))))
    bare = F.btrim(text, F.lit(GAP_CHARS))
    d = d.withColumn("q_word_list", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_GAP)))
    # Each step is a column of its own: what stands at the top of a plan is compiled, what stands in a lambda isn't.
    d = d.withColumn("q_hash", F.transform("q_word_list", lambda x: F.xxhash64(x)))
    d = d.withColumn("q_three", windows("q_hash"))
    d = d.withColumn("q_bad", F.transform("q_list", lambda x: F.when(x == "", F.lit(False)).otherwise(line_fails(x, tails))))
    whole = F.lit(True)
    if tails:
        cut = lambda x, bad: F.when(~bad & (x != "") & unfinished(x), F.regexp_replace(x, HEAD, "$1"))
        d = d.withColumn("q_cut", F.zip_with("q_list", "q_bad", cut))
        whole = F.forall("q_cut", lambda x: x.isNull())
    with_word = F.filter("q_all", lambda x: F.btrim(x, F.lit(GAP_CHARS)) != "")
    d = d.withColumn("q_words", F.size("q_word_list").cast("long"))
    d = d.withColumn("q_word_chars", _length(F.array_join("q_word_list", "")).cast("long"))
    d = d.withColumn("q_symbols", _length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"))
    d = d.withColumn("q_with", with_word).withColumn("q_dup_lines", (F.size("q_with") - F.size(F.array_distinct("q_with"))).cast("long"))
    d = d.withColumn("q_repeat_words", repeated_words("q_three").cast("long"))
    d = d.withColumn("q_lines", F.size(F.filter("q_list", lambda x: x != "")).cast("long"))
    d = d.withColumn("q_failed_lines", F.size(F.filter("q_bad", lambda x: x)).cast("long"))
    count = lambda keep: F.aggregate(F.zip_with("q_list", "q_bad", lambda x, bad: F.when(keep(bad), _length(x)).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)
    d = d.withColumn("q_chars", count(lambda bad: F.lit(True))).withColumn("q_lost", count(lambda bad: bad))
    if tails:
        d = d.withColumn("q_lost", F.col("q_lost") + F.aggregate(F.zip_with("q_list", "q_cut", lambda x, c: F.coalesce(_length(x) - _length(c), F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x))
        d = d.withColumn("q_all", F.zip_with("q_all", "q_cut", lambda x, c: F.coalesce(c, x)))
    d = d.withColumn("q_base_failed", (F.col("q_words") < MIN_WORDS) | (F.col("q_repeat_words") * 100 > F.col("q_words") * REPEATED_PERCENT))
    d = d.withColumn("q_kept", ~F.col("q_base_failed") & (F.col("q_lost") <= F.col("q_chars") * F.lit(LOST)))
    d = d.withColumn("q_text", F.when((F.col("q_failed_lines") == 0) & whole, F.col("text")).otherwise(F.array_join(F.filter("q_all", lambda x, i: ~F.get("q_bad", i)), "\n")))
    return d.drop("q_all", "q_list", "q_bad", "q_word_list", "q_hash", "q_three", "q_with", "q_cut")


def good_documents(docs: DataFrame) -> DataFrame:
    """The kept documents without their failed lines and unfinished ends of lines (see tails in cleaned), in the columns of docs; n_chars, if
    there, counts the new text.

    Null, empty and short texts fail the base and go. Rows are judged one by one: null or repeated doc_ids and repeated rows don't matter, and
    other columns stay as they are, whatever their names. An empty table gives no rows."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # so that no column's name meets one of the cleaning
    renamed = docs.select(*[F.col(f"`{c}`").alias("text" if c == "text" else n) for c, n in names.items()])
    # A filter on what is computed would be moved below it and make it all twice; one on a column that isn't deterministic stays.
    d = cleaned(renamed, tails=True).withColumn("q_kept", F.col("q_kept") & (F.monotonically_increasing_id() >= 0)).filter("q_kept")
    new = {"text": F.col("q_text"), "n_chars": F.char_length("q_text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return d.select(*[(new[c] if c in new else F.col(n)).alias(c) for c, n in names.items()])


def op2_linefirst(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cleaned(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", *[F.col(f"q_{c}").alias(n) for c, n in (
        ("words", "n_words"), ("word_chars", "word_chars"), ("symbols", "n_symbols"), ("dup_lines", "n_dup_lines"), ("repeat_words", "n_repeat_words"),
        ("base_failed", "base_failed"), ("kept", "kept"), ("lines", "n_lines"), ("failed_lines", "n_failed_lines"))])


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
OP2_SQL = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), tri AS (
  SELECT id, i, [w[i], w[i + 1], w[i + 2]] AS x FROM d, unnest(range(1, len(w) - 1)) u(i)
), dup AS (SELECT id, i FROM tri QUALIFY count(*) OVER (PARTITION BY id, x) > 1
), rep AS (SELECT id, count(DISTINCT i + k)::BIGINT AS n FROM dup, range(3) r(k) GROUP BY id
), lines AS (SELECT id, k, l[k] AS raw, {_TRIM.format('l[k]')} AS line FROM (SELECT id, string_split(t, chr(10)) AS l FROM d), unnest(range(1, len(l) + 1)) u(k)
), judged AS (
  SELECT id, k, raw, length(line) AS n,
    NOT regexp_matches(line, {_q(ENDS)})
    OR length(regexp_replace(line, {_q(MARKS)}, '', 'g')) > {MARKS_PER_WORD}::DOUBLE * len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'))
    OR (length(regexp_replace(line, '\\P{{Lu}}+', '', 'g')) >= {CAPS_LEAST} AND length(regexp_replace(line, '\\P{{Lu}}+', '', 'g')) > length(regexp_replace(line, '\\P{{Ll}}+', '', 'g')))
    OR regexp_matches(line, {_q(NAV)})
    OR regexp_matches(line, {_q(BOILERPLATE)}) AS bad
  FROM lines WHERE line <> ''
), by_doc AS (
  SELECT id, count(*) AS n_lines, count(*) FILTER (bad) AS n_failed, sum(n) AS chars, coalesce(sum(n) FILTER (bad), 0) AS lost, count(*) - count(DISTINCT raw) AS dup FROM judged GROUP BY id
), f AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    coalesce(chars, 0) AS chars, coalesce(lost, 0) AS lost, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_failed, 0)::BIGINT AS n_failed_lines
  FROM d LEFT JOIN rep USING (id) LEFT JOIN by_doc USING (id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEATED_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEATED_PERCENT} * n_words) AND lost <= chars * {LOST}::DOUBLE AS kept, n_lines, n_failed_lines
FROM f
"""

QUERIES = {"op2_linefirst": op2_linefirst}
ORACLES = {"op2_linefirst": OP2_SQL}
