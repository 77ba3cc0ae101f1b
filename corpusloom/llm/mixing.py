"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import HASH_SPACE, alone, bucket_count, own_names, read, seeded, text_of, word_count, written

SEED = "mix-11"
WEIGHTS = (5, 2, 1)
#: The targets need at most one round of resharing for each weight class, as all sources of a weight reach the
#: ceiling in the order of size over weight; the level of the ceiling is found in closed form instead (see targets).
SHARE, CEILING = 1.5, 2.0
#: Grades of documents: BASE for one word, one more for each doubling of the words, GRADES times at most.
BASE, GRADES = 12, 12
#: A document of over a PART-th of what a source leaves to sampling is a long one.
PART = 64
#: Rows of the table of grades by source up to which tables of sources are sent to all executors (a few hundred bytes a row).
FEW = 20_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """From source, source_size: target (double) of each source.

    Sources by code point, null last, weigh weights[0], weights[1], ... over and over. They share `share` times all
    words by weight; no target passes `ceiling` times the source's size, and what that frees is shared again by weight
    until none is above. That fixpoint is min(ceiling * size, level * weight) with one level for all: sources reach the
    ceiling in the order of size / weight, so running sums over that order give the level without a loop.
    The table has a row for each source; its windows run on these sums, not on documents.
    """
    k = len(weights)
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % k + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(ceiling))
    tight = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = tight.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    t = (
        t.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("w_rest", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("level", (F.col("budget") - F.col("capped")) / F.col("w_rest"))
        # the first source in tight order that stays under its ceiling sets the level for all after it
        .withColumn("open", F.col("level") * F.col("w") <= F.col("cap"))
    )
    t = t.withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), "source", "level"))).over(every)["level"])
    return t.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("w"))).alias("target"))


def copies_by_length(groups: DataFrame) -> DataFrame:
    """From source, target, grade, words (the words of a source's documents of each grade): expected, the copies that a document of the
    grade is expected to get, so that a source's copies hold `target` words.

    Copies are in proportion to the grade and no more than CEILING. The level is found as in targets: grades reach the ceiling from the
    highest on, so running sums over grades give it. A source has GRADES + 1 grades at most.
    """
    down = W.partitionBy("source").orderBy(F.desc("grade")).rowsBetween(W.unboundedPreceding, -1)
    up = W.partitionBy("source").orderBy("grade").rowsBetween(W.unboundedPreceding, 0)
    t = groups.withColumn("full", F.coalesce(F.sum("words").over(down), F.lit(0))).withColumn("weighed", F.sum(F.col("words") * F.col("grade")).over(up))
    t = t.withColumn("level", (F.col("target") - F.col("full") * F.lit(CEILING)) / F.col("weighed"))
    open_ = F.col("level") * F.col("grade") <= F.lit(CEILING)
    t = t.withColumn("level", F.max(F.when(open_, F.struct("grade", "level"))).over(W.partitionBy("source"))["level"])
    expected = F.when(F.col("level").isNull(), F.lit(CEILING)).otherwise(F.least(F.lit(CEILING), F.col("level") * F.col("grade")))
    return t.withColumn("expected", expected).drop("full", "weighed", "level")


def pareto_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, seed: str = SEED, row: str | None = None) -> DataFrame:
    """How many copies of each document the mix takes.

    A document's expected copies r are in proportion to its grade, which rises with its length: BASE, and one more for each doubling of
    its words, GRADES times at most (a document of 4,096 words is expected twice as often as one of a single word); no document is expected
    over CEILING times, and the copies expected in a source hold the target's words. The document gets floor(r) certain copies, and p = r - floor(r)
    is left to sampling: its random odds u / (1 - u) over its inclusion odds p / (1 - p) are its Pareto rank q, and the documents of
    smallest rank are taken. The sample's size is fixed in words, the `rest` of the target that certain copies leave open:

    - A long document, of over rest / PART words, is taken as long as the long ones before it and half of itself lie within the words
      that long ones are expected to hold. So what they hold differs from that by half of one at most.
    - The others are taken while they fit into what then is left.
    - One document more is taken, or left out again, if that brings the sum nearer to the rest: the one by which it comes nearest.

    A document of more words than the rest is not sampled. Ties of q stand by the hash, doc_id (null last), size.
    Ranks run over (source, long or not). Running sums come from cells of equal expected size: F, the mean of the grades'
    distribution functions of q, is uniform over a source whatever its odds are, so cells of F are even, and only a cell is sorted by one task.

    Returns doc_id, size, source_size, target, taken, source, copies, and the column `row` if named. Null text: size 0. Null source: a source
    of its own, last. Null doc_ids are told apart by the text; rows equal in all of these are taken alike in any order.
    Documents without words take nothing, and have no copies. An empty table gives no rows. Columns besides doc_id, source, text and row are not read.
    """
    size = word_count(text_of())
    rid = F.col(f"`{row}`").cast("long") if row else F.monotonically_increasing_id()
    base = written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"),
        seeded(seed, F.col("doc_id"), F.md5(text_of().cast("binary"))).alias("h"), rid.alias("row"),
    ), "mix")
    out = _copies(base, weights, share)
    names = ["doc_id", "size", "source_size", "target", "taken", "source", "copies"]
    return out.select(*names, F.col("row").alias(row)) if row else out.select(*names)


def _grade(size: Column) -> Column:
    return F.lit(BASE) + F.least(F.length(F.bin(size)) - 1, F.lit(GRADES))


def _copies(base: DataFrame, weights: tuple[int, ...], share: float) -> DataFrame:
    cells = bucket_count(base.count())
    base = base.withColumn("grade", _grade(F.col("size")))
    groups = written(base.groupBy("source", "grade").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")), "mix-grades")  # a few rows for each source
    few = groups.count() <= FEW
    by_source = lambda rows, table, keys=("source",): _with(rows, F.broadcast(table) if few else table, list(keys))
    plan = targets(groups.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share).withColumn("target", F.round("target", 6))
    live = by_source(groups.filter("words > 0"), plan)
    live = copies_by_length(live).withColumn("whole", F.floor("expected").cast("long")).withColumn("p", F.least(F.col("expected") - F.col("whole"), F.lit(1 - 1e-12)))
    live = live.withColumn("odds", F.when(F.col("p") > 0, F.col("p") / (1 - F.col("p"))))
    # what a source leaves to sampling, and its grades' distribution functions
    rest = live.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("words"))).alias("rest"), F.sum(F.when(F.col("p") > 0, F.col("n"))).alias("n_open"),
        F.array_sort(F.collect_list(F.when(F.col("p") > 0, F.struct("grade", "odds", "n")))).alias("grades"))
    plan = written(by_source(plan, rest), "mix-plan")
    live = written(live.select("source", "grade", "whole", "p", "odds"), "mix-expected")
    rows = by_source(by_source(base, plan), live, ("source", "grade"))
    u = (F.col("h") + F.lit(0.5)) / F.lit(float(HASH_SPACE))
    drawn = (F.col("p") > 0) & (F.col("size") > 0) & (F.col("size") <= F.col("rest"))
    rows = rows.withColumn("q", F.when(drawn, (u / (1 - u)) / F.col("odds")))
    at = lambda q: F.aggregate("grades", F.lit(0.0), lambda a, g: a + g["n"] * (q * g["odds"] / (1 + q * g["odds"]))) / F.col("n_open")
    rows = rows.withColumn("cell", F.least(F.floor(at(F.col("q")) * cells), F.lit(cells - 1)).cast("long")).drop("grades", "n_open")
    rows = rows.withColumn("long", F.col("size") * PART > F.col("rest"))
    rows = written(rows, "mix-ranks")
    open_ = rows.filter("q is not null").select("source", "long", "cell", "q", "h", "doc_id", "size", "row", "rest", "p")
    sums = _summed(open_)
    hope = open_.groupBy("source").agg(F.round(F.sum(F.when(F.col("long"), F.col("p") * F.col("size"))), 3).alias("hope"))
    sums = by_source(sums, hope)
    sums = written(sums.withColumn("in_long", F.col("long") & (F.col("sum") * 2 - F.col("size") <= F.col("hope") * 2)), "mix-sums")
    held = sums.groupBy("source").agg(F.coalesce(F.sum(F.when(F.col("in_long"), F.col("size"))), F.lit(0)).alias("held"))
    sums = by_source(sums, held).withColumn("fits", F.col("in_long") | (~F.col("long") & (F.col("sum") <= F.col("rest") - F.col("held"))))
    gap = sums.groupBy("source").agg((F.first("rest") - F.coalesce(F.sum(F.when(F.col("fits"), F.col("size"))), F.lit(0))).alias("gap"))
    near = F.abs(F.col("gap") - F.when(F.col("fits"), -F.col("size")).otherwise(F.col("size")))
    sums = by_source(sums, written(gap, "mix-gap"))
    last = sums.filter(near < F.abs("gap")).groupBy("source").agg(F.min(F.struct(near.alias("near"), "q", "h", F.col("doc_id").isNull().alias("no_id"), "doc_id", "size", "row")).alias("last"))
    swap = last.select("source", F.col("last.row").alias("last_row"))
    taken = by_source(sums, swap).filter(F.col("fits") != F.coalesce(F.col("row") == F.col("last_row"), F.lit(False))).select(F.col("row").alias("__row"))
    rows = rows.join(taken, F.col("row") == F.col("__row"), "left")
    copies = F.when(F.col("size") > 0, F.coalesce("whole", F.lit(0)) + F.col("__row").isNotNull().cast("long")).otherwise(0).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), "source", copies.alias("copies"), "row")


def _summed(rows: DataFrame) -> DataFrame:
    """Adds sum, the running sum of size in each (source, long) by rank, from sums by cell and an order within each cell."""
    run = W.partitionBy("source", "long").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cell = rows.groupBy("source", "long", "cell").agg(F.sum("size").alias("in_cell"))
    cell = cell.withColumn("before", F.coalesce(F.sum("in_cell").over(run), F.lit(0))).drop("in_cell")
    own = W.partitionBy("source", "long", "cell").orderBy("q", "h", F.col("doc_id").asc_nulls_last(), "size", "row")
    rows = _with(rows, cell, ["source", "long", "cell"])
    return rows.withColumn("sum", F.col("before") + F.sum("size").over(own.rowsBetween(W.unboundedPreceding, 0))).drop("before")


def _with(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys of which the first may be null. The table is a summary of the rows; unless it comes marked as few rows, Spark sends it to
    all executors only under its own size threshold, and else splits the large source's partitions at run time."""
    t = table.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in table.columns if c not in keys])
    on = F.col(keys[0]).eqNullSafe(F.col(f"__{keys[0]}"))
    for k in keys[1:]:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return rows.join(t, on, "left").drop(*[f"__{k}" for k in keys])


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, with all their columns: each row as often as pareto_mix takes it (0 to 2 times), so the words of the
    result are those that it says. Rows are told apart by a number, written with them: repeated rows and null or repeated doc_ids need no
    key. Documents without words are not in the mix. Inner columns take names that docs doesn't have. An empty table gives no rows."""
    row, copies = own_names(docs, "mix_row", "mix_copies")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")  # the numbers must not change between uses
    taken = alone(docs.sparkSession, "mix-taken", lambda: pareto_mix(rows, row=row, **how).filter("copies > 0").select(row, F.col("copies").alias(copies)))
    # By sorted rows at every size: which rows are taken is a table that grows with the documents, so it is sent nowhere whole.
    out = rows.join(taken.hint("merge"), row).withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix(read(spark, sf_dir, "documents"))


_FIX = "".join(f"""
, f{i} AS (SELECT *, CASE WHEN hit THEN cap ELSE w * (budget - coalesce(sum(cap) FILTER (hit) OVER (), 0)) / nullif(sum(w) FILTER (NOT hit) OVER (), 0) END AS share{i} FROM h{i})
, h{i + 1} AS (SELECT source, source_size, w, cap, budget, hit OR share{i} > cap AS hit FROM f{i})""" for i in range(40))

OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))), 1, 15))::BIGINT AS h
  FROM documents
), b AS (SELECT *, {BASE} + least(length(bin(size)) - 1, {GRADES}) AS grade, row_number() OVER () AS id FROM d
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), h0 AS (
  SELECT source, source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w,
    2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget, false AS hit FROM s
){_FIX}
, t AS (SELECT source, source_size, round(CASE WHEN hit THEN cap ELSE share39 END, 6) AS target FROM f39
), g AS (SELECT b.source, grade, target, sum(size) AS words FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source GROUP BY ALL HAVING sum(size) > 0
), l AS (SELECT *, (target - 2.0::DOUBLE * coalesce(sum(words) OVER (PARTITION BY source ORDER BY grade DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(words * grade) OVER (PARTITION BY source ORDER BY grade ROWS UNBOUNDED PRECEDING) AS lv FROM g
), e AS (SELECT *, coalesce(least(2.0::DOUBLE, arg_max(lv, grade) FILTER (lv * grade <= 2.0::DOUBLE) OVER (PARTITION BY source) * grade), 2.0::DOUBLE) AS r FROM l
), p AS (SELECT *, floor(r) AS whole, r - floor(r) AS p FROM e
), r AS (SELECT source, any_value(target) - sum(whole * words) AS rest FROM p GROUP BY source
), q AS (
  SELECT b.*, source_size, t.target, coalesce(p.whole, 0) AS whole, rest, p, (p > 0 AND size > 0 AND size <= rest) IS TRUE AS drawn, size * {PART} > rest AS long,
    (((h + 0.5::DOUBLE) / 1152921504606846976::DOUBLE) / (1 - (h + 0.5::DOUBLE) / 1152921504606846976::DOUBLE)) / (p / (1 - p)) AS odds_ratio
  FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source LEFT JOIN p ON b.source IS NOT DISTINCT FROM p.source AND b.grade = p.grade LEFT JOIN r ON b.source IS NOT DISTINCT FROM r.source
), u AS (SELECT *, sum(size) OVER (PARTITION BY source, long, drawn ORDER BY odds_ratio, h, doc_id, size, id ROWS UNBOUNDED PRECEDING) AS upto, round(sum(p * size) FILTER (drawn AND long) OVER (PARTITION BY source), 3) AS hope FROM q
), v AS (SELECT *, drawn AND long AND upto * 2 - size <= hope * 2 AS in_long FROM u
), w AS (SELECT *, in_long OR (drawn AND NOT long AND upto <= rest - coalesce(sum(size) FILTER (in_long) OVER (PARTITION BY source), 0)) AS fits FROM v
), x AS (SELECT *, rest - coalesce(sum(size) FILTER (fits) OVER (PARTITION BY source), 0) AS gap FROM w
), y AS (SELECT *, abs(gap - CASE WHEN fits THEN -size ELSE size END) AS near FROM x
), z AS (SELECT *, drawn AND near < abs(gap) AND row_number() OVER (PARTITION BY source, drawn AND near < abs(gap) ORDER BY near, odds_ratio, h, doc_id NULLS LAST, size, id) = 1 AS turned FROM y
), c AS (SELECT *, CASE WHEN size > 0 THEN whole + (fits <> turned)::INT ELSE 0 END::BIGINT AS copies FROM z)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, source, copies FROM c
"""

QUERIES = {"op9_pareto": op9_pareto}
ORACLES = {"op9_pareto": OP9_SQL}
