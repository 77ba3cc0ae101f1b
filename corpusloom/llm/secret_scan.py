"""Secret scans over a ledger of content-addressed blobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, read, text_of, written

RULES_VERSION = "rules-1"
KINDS = ("assign", "access", "hex")
#: Fixed patterns. kind: (what a text must hold to be searched at all, the pattern, the group whose length counts, the least length).
#: The failing matches of `assign` use up text, so its pattern takes any length and short ones are dropped after.
#: `access` and `hex` match maximal runs: asking for the length in the pattern finds the same spans.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = {
    "assign": (r"""(?i)(?:passw|secret|token|api_?key)[a-z]*["']?\x20*[:=]""", ASSIGN, 2, 6),
    "access": ("AKIA", r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24}", r"[0-9a-f]{24,}", 0, 24),
    # what the method adds to the base
    "github": ("gh[pousr]_", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    "jwt": (r"eyJ[A-Za-z0-9_-]", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 29),
    "private_key": ("-----BEGIN", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 27),
    "slack": ("xox[abprs]-", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
}
ALL_KINDS = (*KINDS, *[k for k in RULES if k not in KINDS])
SPAN = "struct<start:int,kind:int,end:int>"


#: Matches that are gone through at once; what is found in a run is put together once, so long key files don't cost the square of their matches.
RUN = 128


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's variable holds it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spans_of(text: Column, kind: str) -> Column:
    """Spans (start, kind's number, end; code points, end exclusive) of one rule, leftmost first, not overlapping.

    What split() leaves between matches and the matches themselves follow each other; their lengths add up to places. The steps are cut into runs
    of RUN: sums of runs give where each run starts, and each run lists its own spans.
    """
    needs, pattern, group, least = RULES[kind]
    n = ALL_KINDS.index(kind)
    length = lambda x: F.char_length(x)
    gaps = F.transform(F.split(text, pattern, -1), length)
    full = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), length)
    part = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), length) if group else full
    steps = F.arrays_zip(gaps.alias("gap"), full.alias("full"), part.alias("part")) if group else F.transform(F.arrays_zip(gaps.alias("gap"), full.alias("full")), lambda s: F.struct(s["gap"].alias("gap"), s["full"].alias("full"), s["full"].alias("part")))
    none = F.array().cast(f"array<{SPAN}>")

    def step(a: Column, s: Column) -> Column:
        start = a["at"] + s["gap"]
        end = start + F.coalesce(s["full"], F.lit(0))
        one = F.array(F.struct(start.alias("start"), F.lit(n).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(s["part"] >= least, F.concat(a["found"], one)).otherwise(a["found"]).alias("found"))

    def run(steps: Column, at: Column) -> Column:
        return F.aggregate(steps, F.struct(at.alias("at"), none.alias("found")), step, lambda a: a["found"])

    def in_runs(steps: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / RUN).cast("int")), lambda i: F.slice(steps, i * RUN + 1, RUN))
        held = lambda r: F.aggregate(r, F.lit(0), lambda a, s: a + s["gap"] + F.coalesce(s["full"], F.lit(0)))
        starts = lambda r: F.aggregate(
            F.transform(r, held), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
            lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"])
        return _let(runs, lambda r: F.flatten(F.zip_with(r, starts(r), run)))

    found = _let(steps, lambda s: F.when(F.size(s) <= RUN, run(s, F.lit(0))).otherwise(in_runs(s)))
    return F.when(text.rlike(needs), found).otherwise(none)


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """From blob, text: blob and found, all spans by start, then kind as listed in ALL_KINDS; blobs without are left out."""
    d = blobs.select("blob", *[spans_of(F.col("text"), k).alias(k) for k in ALL_KINDS])
    d = d.filter(reduce(lambda a, b: a | b, [F.size(k) > 0 for k in ALL_KINDS]))
    return d.select("blob", F.sort_array(F.concat(*ALL_KINDS)).alias("found"))


class BlobLedger:
    """Which (blob, rule version) pairs are scanned, and what was found: two tables, each with a folder of Parquet for every batch.

    seen: blob, rules, batch; findings: blob, rules, batch, found. Tables are read by the folders that they have at that time, never by the one
    above them: Spark takes two reads of one path for the same, even if a batch has come between. A batch is written to `findings` first and to `seen`
    after it, and findings count only if their batch is in `seen`: a run that dies between is scanned again, and its
    findings are never read twice.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        batches = sorted(x.getPath().toString() for x in fs.listStatus(path)) if fs.exists(path) else []
        if not batches:
            return self.spark.range(0).select(F.from_json(F.lit("{}"), schema).alias("x")).select("x.*")
        return self.spark.read.schema(schema).parquet(*batches)

    def seen(self, rules: str) -> DataFrame:
        return self._read("seen", "blob string, rules string, batch string").filter(F.col("rules") == rules)

    def findings(self, rules: str) -> DataFrame:
        """blob, found; each blob once: of batches that overlapped and both scanned it, the least counts."""
        f = self._read("findings", f"blob string, rules string, batch string, found array<{SPAN}>").filter(F.col("rules") == rules)
        return f.join(self.seen(rules).groupBy("blob").agg(F.min("batch").alias("batch")), ["blob", "batch"], "left_semi").select("blob", "found")

    def scan(self, versions: DataFrame, rules: str = RULES_VERSION) -> DataFrame:
        """Scans what is new in versions (path long, text) and returns versions without text, with blob (SHA-256 of the text in UTF-8) and found,
        an array of spans (empty: none).

        A blob is read from one path alone, the least; the ledger drops blobs that it has seen under `rules` before any text
        moves. Null text: empty, as is its blob. Null path: a path like others, before all. Repeated rows stay repeated. An empty table gives no rows.
        Other columns stay, but for those named blob or found, whose place the result's own take.
        """
        text = text_of()
        rest = [c for c in versions.columns if c not in ("text", "blob", "found")]
        v = versions.withColumn("blob", F.sha2(text.cast("binary"), 256))
        path = F.coalesce(F.col("path"), F.lit(-(1 << 63)).cast("long"))
        ids = written(v.select(*rest, "blob"), "blob-ids")
        new = ids.groupBy("blob").agg(F.min(path).alias("at")).join(self.seen(rules), "blob", "left_anti")
        new = written(new, "blob-new")
        # SHA-256 is taken again here rather than kept with the text: hashing costs less than moving texts twice.
        source = versions.filter(text != "").select(path.alias("at"), F.sha2(text.cast("binary"), 256).alias("blob"), F.col("text"))
        fresh = scan_blobs(source.join(new, ["blob", "at"], "left_semi")).dropDuplicates(["blob"])
        batch = fresh_path(self.spark, "b").rpartition("/")[2]
        fresh.select("blob", F.lit(rules).alias("rules"), F.lit(batch).alias("batch"), "found").write.parquet(f"{self.path}/findings/{batch}")
        new.select("blob", F.lit(rules).alias("rules"), F.lit(batch).alias("batch")).write.parquet(f"{self.path}/seen/{batch}")
        none = F.array().cast(f"array<{SPAN}>")
        return ids.join(self.findings(rules), "blob", "left").withColumn("found", F.coalesce("found", none))


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns from `found`."""
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    show = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("found", lambda s: s["kind"] < len(KINDS))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == ALL_KINDS.index(k))).cast("long")
    return found.select(
        *[c for c in found.columns if c not in ("found", "blob")], *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.transform(base, show), ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("found", show), ",").alias("spans"))


def op8_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans all documents through one ledger in two batches, as two commits of a history bring them: doc_id is the path, its text the version.
    The second batch scans only blobs that the first didn't hold; each batch's findings are joined back to its paths."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("path"), "text")
    ledger = BlobLedger(spark, fresh_path(spark, "ledger"))
    in_first = F.xxhash64("path") < 0
    first, second = (ledger.scan(batch) for batch in (docs.filter(in_first), docs.filter(~in_first)))
    return digests(first.union(second).withColumnRenamed("path", "doc_id"))


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _any_case("api") + "_?" + _any_case("key")
_SQL_RULES = {**{k: (r[1], r[2], r[3]) for k, r in RULES.items()}, "assign": (f"({_KEYS})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6)}


def _sql_kind(i: int, kind: str) -> str:
    pattern, group, least = _SQL_RULES[kind]
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""
  SELECT doc_id, id, {i} AS k, '{kind}' AS kind, sum(gap + coalesce(lag_full, 0)) OVER w AS start, sum(gap + coalesce(lag_full, 0)) OVER w + n AS end, part >= {least} AS good
  FROM (SELECT doc_id, id, j, length(gaps[j]) AS gap, length(fulls[j]) AS n, length(parts[j]) AS part, CASE WHEN j > 1 THEN length(fulls[j - 1]) END AS lag_full
    FROM (SELECT doc_id, id, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}, 0) AS fulls, regexp_extract_all(t, {p}, {group}) AS parts FROM d), unnest(range(1, len(fulls) + 1)) u(j))
  WINDOW w AS (PARTITION BY id ORDER BY j ROWS UNBOUNDED PRECEDING)"""


OP8_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS id, coalesce(text, '') AS t FROM documents
), s AS ({" UNION ALL ".join(_sql_kind(i, k) for i, k in enumerate(ALL_KINDS))}
), a AS (
  SELECT id, count(*) FILTER (k = 0) AS a0, count(*) FILTER (k = 1) AS a1, count(*) FILTER (k = 2) AS a2,
    string_agg(kind || ':' || start::BIGINT || ':' || "end"::BIGINT, ',' ORDER BY start, k) FILTER (k < 3) AS base,
    string_agg(kind || ':' || start::BIGINT || ':' || "end"::BIGINT, ',' ORDER BY start, k) AS spans
  FROM s WHERE good GROUP BY id
)
SELECT doc_id, coalesce(a0, 0)::BIGINT AS n_assign, coalesce(a1, 0)::BIGINT AS n_access, coalesce(a2, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (id)
"""

QUERIES = {"op8_ledger": op8_ledger}
ORACLES = {"op8_ledger": OP8_SQL}
