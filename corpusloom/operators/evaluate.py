"""Metrics of a language model over tables of (logits, target)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A

IGNORE = -100
#: A benchmark takes (rows, logits, target) and returns one row of metrics.
Benchmark = Callable[[DataFrame, str, str], DataFrame]


def negative_log_likelihood(logits: Column, target: Column) -> Column:
    return A.log_sum_exp(logits) - F.get(logits, target)


def perplexity(rows: DataFrame, logits: str, target: str, ignore: int = IGNORE) -> DataFrame:
    """loss, perplexity, n_tokens over rows whose target isn't `ignore`; nulls where there are none."""
    kept = rows.filter(F.col(target) != ignore).select(negative_log_likelihood(F.col(logits), F.col(target)).alias("nll"))
    return kept.agg(F.avg("nll").alias("loss"), F.exp(F.avg("nll")).alias("perplexity"), F.count(F.lit(1)).alias("n_tokens"))


def _share(hit: Column, target: Column, masked: bool, ignore: int) -> Column:
    """Ignored positions count as misses, or not at all if masked."""
    value = F.coalesce(hit & (target != ignore), F.lit(False)).cast("int")
    return F.avg(F.when(target != ignore, value) if masked else value)


def top_k_accuracy(rows: DataFrame, logits: str, target: str, k: int = 5, ignore: int = IGNORE, masked: bool = False, name: str = "accuracy") -> DataFrame:
    """Share of rows where fewer than k elements pass the target's (equal ones before it count as passing)."""
    t = F.col(target)
    passed = F.size(F.filter(F.transform(logits, lambda v, i: (v > F.get(logits, t)) | ((v == F.get(logits, t)) & (i < t))), lambda x: x))
    return rows.agg(_share(passed < k, t, masked, ignore).alias(name))


def suite(rows: DataFrame, logits: str, target: str, ignore: int = IGNORE) -> DataFrame:
    """Perplexity, top-1 and top-5 in one pass over the rows."""
    t = F.col(target)
    passed = F.size(F.filter(F.transform(logits, lambda v, i: (v > F.get(logits, t)) | ((v == F.get(logits, t)) & (i < t))), lambda x: x))
    nll = F.when(t != ignore, negative_log_likelihood(F.col(logits), t))
    return rows.agg(F.avg(nll).alias("loss"), F.exp(F.avg(nll)).alias("perplexity"), F.count(nll).alias("n_tokens"), _share(passed < 1, t, False, ignore).alias("top1"), _share(passed < 5, t, False, ignore).alias("top5"))


def nonfinite(rows: DataFrame, array: str) -> DataFrame:
    bad = F.size(F.filter(array, lambda v: F.isnan(v) | (F.abs(v) == float("inf"))))
    return rows.agg(F.sum(bad).cast("long").alias("n_nonfinite"))


def nucleus(rows: DataFrame, key: str, logits: str, p: float, temperature: float = 1.0) -> DataFrame:
    """key, token, prob of the tokens kept: by falling probability, as long as the sum before a token is p or less."""
    if not 0 < p <= 1:
        raise ValueError("0 < p <= 1")
    probs = rows.select(key, A.softmax(F.col(logits), temperature).alias("p"))
    order = A.by_size(F.col("p"))
    # the running sum stays in the row: no shuffle
    cum = F.aggregate(order, F.struct(F.lit(0.0).alias("s"), F.array().cast("array<struct<token:int,prob:double>>").alias("kept")), lambda a, x: F.struct(
        (a["s"] + x["v"]).alias("s"), F.when(a["s"] <= p, F.concat(a["kept"], F.array(F.struct(x["i"].alias("token"), x["v"].alias("prob"))))).otherwise(a["kept"]).alias("kept")), lambda a: a["kept"])
    return probs.select(key, F.explode(cum).alias("x")).select(key, "x.token", "x.prob")


def drawn(rows: DataFrame, key: str, probs: Column, uniform: Column) -> DataFrame:
    """key, token: the inverse of the running sum at a uniform number."""
    place = F.aggregate(probs, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("i")), lambda a, p: F.struct((a["s"] + p).alias("s"), F.when(a["s"] + p <= uniform, a["i"] + 1).otherwise(a["i"]).alias("i")), lambda a: a["i"])
    return rows.select(key, F.least(place, F.size(probs) - 1).alias("token"))


def sampler(logits: Column, seen: Column | None = None, temperature: float = 1.0, top_k: int | None = None, top_p: float | None = None, penalty: float = 1.0) -> Column:
    """The distribution to draw from. The penalty comes first; then temperature 0, top-k, top-p, plain temperature: the first that is asked for
    rules (top-k and top-p don't combine; 0 asks for neither)."""
    if temperature < 0 or penalty < 1 or (top_p is not None and not 0 <= top_p <= 1) or (top_k is not None and top_k < 0):
        raise ValueError("temperature >= 0, penalty >= 1, top_k >= 0 and 0 <= top_p <= 1")
    if penalty > 1 and seen is None:
        raise ValueError("a penalty needs the ids that were seen")
    x = A.penalised(logits, seen, penalty) if penalty > 1 else logits
    if temperature == 0:
        return A.softmax(x, 0)
    if top_k:
        return A.top_k_distribution(x, top_k, temperature)
    return A.top_p_distribution(x, top_p, temperature) if top_p else A.softmax(x, temperature)


#: The decodes of the protocol (temperature, top-p, repetition penalty).
DECODES = ((0.0, None, 1.0), (0.8, 0.9, 1.0), (0.8, 0.9, 1.2))


def decode_grid(prompts: DataFrame, decodes: tuple[tuple[float, float | None, float], ...] = DECODES) -> DataFrame:
    """Every prompt once for each decode: the columns of prompts, decode_no, temperature, top_p, repetition_penalty."""
    each = F.array(*[F.struct(F.lit(i).alias("decode_no"), F.lit(t).cast("double").alias("temperature"), F.lit(p).cast("double").alias("top_p"), F.lit(r).cast("double").alias("repetition_penalty")) for i, (t, p, r) in enumerate(decodes)])
    return prompts.withColumn("_d", F.explode(each)).select(*prompts.columns, "_d.*")


def embedded(seqs: DataFrame, key: str, ids: str, table: DataFrame, id: str, vec: str) -> DataFrame:  # noqa: A002
    """key, pos, token, vec: the vector of every id of a sequence, by a join on the id. An id that the table doesn't hold fails the job."""
    tokens = seqs.select(F.col(key).alias("_key"), F.posexplode(ids).alias("pos", "token"))
    found = tokens.join(table.select(F.col(id).alias("token"), F.col(vec).alias("vec")), "token", "left")
    held = F.when(F.col("vec").isNotNull(), F.col("vec")).otherwise(F.raise_error(F.concat(F.lit("no vector for id "), F.coalesce(F.col("token").cast("string"), F.lit("null")))).cast(dict(table.dtypes)[vec]))
    return found.select(F.col("_key").alias(key), "pos", "token", held.alias("vec"))


def attention(rows: DataFrame, group: str, pos: str, vec: str, key: str | None = None, value: str | None = None) -> DataFrame:
    """Causal attention of each group's vectors (queries `vec`; keys and values too unless named): group, pos, out. A group's pairs are made, so groups
    must be small by nature, as a context window is."""
    own = F.col(group).alias("_g")
    q = rows.select(own, F.col(pos).alias("_i"), F.col(vec).alias("_q"))
    k = rows.select(own, F.col(pos).alias("_j"), F.col(key or vec).alias("_k"), F.col(value or vec).alias("_v"))
    dot = F.aggregate(F.zip_with("_q", "_k", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v) / F.sqrt(F.size("_q"))
    pairs = q.join(k, "_g").filter("_j <= _i").select("_g", "_i", F.struct(F.col("_j").alias("j"), dot.alias("s"), F.col("_v").alias("v")).alias("_c"))
    ctx = pairs.groupBy("_g", "_i").agg(F.array_sort(F.collect_list("_c")).alias("_c"))
    p = A.softmax(F.transform("_c", lambda x: x["s"]))
    mixed = F.transform(F.sequence(F.lit(0), F.size(F.element_at("_c", 1)["v"]) - 1), lambda d: A.total(F.zip_with("_c", "_p", lambda x, w: F.get(x["v"], d) * w)))
    return ctx.withColumn("_p", p).select(F.col("_g").alias(group), F.col("_i").alias(pos), mixed.alias("out"))


#: Matrices of a block, as lists of rows: of queries, keys, values, the heads' output, and the gated layer's gate, value and output.
BLOCK = ("q", "k", "v", "o", "gate", "value", "out")


def block_forward(rows: DataFrame, group: str, pos: str, vec: str, weights: dict[str, list[list[float]]]) -> DataFrame:
    """group, pos, out: one block over each group's vectors: x + o attention(rotated q n, rotated k n, v n) with n the normalised x, then that plus the gated layer of
    its normalised self. The weights go into the plan, so layers must be small; one head."""
    if missing := sorted(set(BLOCK) - set(weights)):
        raise ValueError(f"missing matrices: {missing}")
    m = {k: F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in weights[k]]) for k in BLOCK}
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    n = rows.select(F.col(group).alias("_g"), F.col(pos).alias("_at"), F.col(vec).alias("_x"), A.rms_norm(F.col(vec)).alias("_n"))
    n = n.select("_g", "_at", "_x", A.rotated(A.linear(F.col("_n"), m["q"]), F.col("_at")).alias("_a"), A.rotated(A.linear(F.col("_n"), m["k"]), F.col("_at")).alias("_b"), A.linear(F.col("_n"), m["v"]).alias("_w"))
    h = attention(n, "_g", "_at", "_a", "_b", "_w").join(n.select("_g", "_at", "_x"), ["_g", "_at"])
    h = h.select("_g", "_at", plus("_x", A.linear(F.col("out"), m["o"])).alias("_h"))
    return h.select(F.col("_g").alias(group), F.col("_at").alias(pos), plus("_h", A.swiglu(A.rms_norm(F.col("_h")), m["gate"], m["value"], m["out"])).alias("out"))


def model_forward(seqs: DataFrame, key: str, ids: str, table: DataFrame, id: str, vec: str, layers: list[dict[str, list[list[float]]]], head: list[list[float]]) -> DataFrame:  # noqa: A002
    """key, pos, logits of every id of a sequence: its vector by the table, through the blocks of `layers` and a last norm, times the head."""
    x = embedded(seqs, key, ids, table, id, vec).select(key, "pos", F.col("vec").alias("out"))
    for weights in layers:
        x = block_forward(x, key, "pos", "out", weights)
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in head])
    return x.select(key, "pos", A.linear(A.rms_norm(F.col("out")), rows).alias("logits"))


def quantised_layers(weights: DataFrame, layer: str, row: str, vec: str, bits: int = 8, group: int = 128, per_channel: bool = True, symmetric: bool = True) -> DataFrame:
    """Every matrix of a table of weights (layer, row, vec), quantised: layer, row, scale, zero, q; with 4 bits a row for each group of a row (g) and q packed. In 8 bits the
    scale is that of the row, or of the layer, whose range comes from partial sums."""
    if bits not in (4, 8):
        raise ValueError("4 or 8 bits")
    rows = weights.select(F.col(layer).alias("layer"), F.col(row).alias("row"), F.col(vec).cast("array<double>").alias("x"))
    if bits == 4:
        each = rows.select("layer", "row", F.posexplode(A.int4_groups(F.col("x"), group)).alias("g", "s"))
        return each.select("layer", "row", "g", F.col("s.scale").alias("scale"), F.lit(0).alias("zero"), A.packed_nibbles(F.col("s.q")).alias("q"))
    rows = rows.withColumn("lo", F.array_min("x")).withColumn("hi", F.array_max("x"))
    if not per_channel:
        ends = rows.groupBy("layer").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))  # a row for each layer
        rows = rows.drop("lo", "hi").join(ends, "layer")
    if symmetric:
        most = F.greatest(F.abs("lo"), F.abs("hi"))
        scale, zero = F.when(most == 0, F.lit(1.0)).otherwise(most) / 127.0, F.lit(0)
    else:
        scale, zero = A.affine(F.col("lo"), F.col("hi"))
    rows = rows.withColumn("scale", scale).withColumn("zero", zero)
    return rows.select("layer", "row", "scale", "zero", A.int8(F.col("x"), F.col("scale"), F.col("zero")).alias("q"))
