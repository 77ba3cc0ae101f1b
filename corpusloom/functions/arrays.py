"""Functions on arrays of doubles: distributions, quantisation and layers without weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def rounded(v: Column, places: int) -> Column:
    """v to so many places as SQL engines on C's doubles have it: halves of v * 10^places go away from zero, and a small negative number becomes -0.0
    (Spark's round gives 0.0); what isn't finite stays."""
    by = F.lit(10.0**places)
    up = lambda y, r: F.when(F.abs(y - r) == 0.5, y + F.signum(y) * 0.5).otherwise(r)
    out = let(v * by, lambda y: let(F.rint(y), lambda r: up(y, r) / by))
    return let(out, lambda o: F.when(F.isnan(o) | (F.abs(o) == float("inf")), v).otherwise(o))


def argmax(x: Column) -> Column:
    """Place (from 0) of the largest element, the first of equal ones."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def log_sum_exp(x: Column) -> Column:
    return let(F.array_max(x), lambda m: m + F.log(total(F.transform(x, lambda v: F.exp(v - m)))))


def softmax(x: Column, temperature: float = 1.0) -> Column:
    """Probabilities; at temperature 0 all of it falls on the first largest element."""
    if temperature == 0:
        return F.transform(x, lambda v, i: F.when(i == argmax(x), 1.0).otherwise(0.0))
    if temperature < 0:
        raise ValueError("temperature must not be negative")
    return let(F.array_max(x), lambda m: let(F.transform(x, lambda v: F.exp((v - m) / temperature)), lambda e: let(total(e), lambda s: F.transform(e, lambda v: v / s))))


def by_size(x: Column) -> Column:
    """(value, place) from the largest value on, equal values by place."""
    return F.transform(F.array_sort(F.transform(x, lambda v, i: F.struct((-v).alias("n"), i.alias("i")))), lambda s: F.struct((-s["n"]).alias("v"), s["i"].alias("i")))


def top_k_distribution(x: Column, k: int, temperature: float = 1.0) -> Column:
    """softmax of what is no smaller than the k-th largest element; k beyond the length keeps all."""
    if k <= 0:
        raise ValueError("k must be positive")
    floor = F.element_at(F.sort_array(x, asc=False), F.least(F.lit(k), F.size(x)))
    return let(floor, lambda f: let(F.array_max(x), lambda m: let(
        F.transform(x, lambda v: F.when(v >= f, F.exp((v - m) / temperature)).otherwise(0.0)), lambda e: let(total(e), lambda s: F.transform(e, lambda v: v / s)))))


def top_p_distribution(x: Column, p: float, temperature: float = 1.0) -> Column:
    """softmax of the likeliest elements whose probabilities before each sum to p or less (the one that crosses p stays), equal ones by place."""
    if not 0 < p <= 1:
        raise ValueError("0 < p <= 1")

    def kept(probs: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
        n = F.aggregate(by_size(probs), zero, lambda a, e: F.struct((a["s"] + e["v"]).alias("s"), F.when(a["s"] <= p, a["n"] + 1).otherwise(a["n"]).alias("n")), lambda a: a["n"])
        places = let(n, lambda n: F.transform(F.slice(by_size(probs), 1, n), lambda e: e["i"]))
        return let(places, lambda at: F.transform(probs, lambda v, i: F.when(F.array_contains(at, i), v).otherwise(0.0)))

    return let(let(softmax(x, temperature), kept), lambda e: let(total(e), lambda s: F.transform(e, lambda v: v / s)))


def penalised(x: Column, seen: Column, penalty: float) -> Column:
    """Positive elements at seen places over the penalty, others there times it; penalties of 1 or less change nothing."""
    if penalty <= 1:
        return x
    return F.transform(x, lambda v, i: F.when(F.array_contains(seen, i), F.when(v > 0, v / penalty).otherwise(v * penalty)).otherwise(v))


def rms_norm(x: Column, eps: float = 1e-6) -> Column:
    return let(F.sqrt(total(F.transform(x, lambda v: v * v)) / F.size(x) + eps), lambda r: F.transform(x, lambda v: v / r))


def rotated(x: Column, position: Column, base: float = 10_000.0) -> Column:
    """Rotary positions: element i of the first half pairs with element i of the second."""
    half = F.floor(F.size(x) / 2).cast("int")
    angle = lambda i: position * F.pow(F.lit(base), -(i.cast("double") / half))
    return F.transform(x, lambda v, i: F.when(
        i < half, v * F.cos(angle(i)) - F.get(x, i + half) * F.sin(angle(i))).otherwise(v * F.cos(angle(i - half)) + F.get(x, i - half) * F.sin(angle(i - half))))


def silu(x: Column) -> Column:
    return F.transform(x, lambda v: v / (1 + F.exp(-v)))


def linear(x: Column, weights: Column) -> Column:
    """weights (an array of rows) times x; rows of another length than x raise an error."""
    dot = lambda row: F.when(F.size(row) == F.size(x), total(F.zip_with(row, x, lambda a, b: a * b))).otherwise(F.raise_error(F.lit("width of weights and input differ")).cast("double"))
    return F.transform(weights, dot)


def swiglu(x: Column, gate: Column, value: Column, out: Column) -> Column:
    """out (silu(gate x) * (value x)): the gated layer, its three matrices given as arrays of rows."""
    return let(F.zip_with(silu(linear(x, gate)), linear(x, value), lambda g, v: g * v), lambda h: linear(h, out))


def kept_last(x: Column, n: int) -> Column:
    return F.when(F.size(x) > n, F.slice(x, -n, n)).otherwise(x)


def clamped(v: Column, lo: int, hi: int) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), v)).cast("int")


def affine(lo: Column, hi: Column) -> tuple[Column, Column]:
    """Scale and zero point that map [lo, hi] onto -128 to 127; an empty range has the scale 1."""
    scale = F.when(hi == lo, F.lit(1.0)).otherwise((hi - lo) / 255.0)
    return scale, clamped(-128 - F.rint(lo / scale), -128, 127)


def int8(x: Column, scale: Column, zero: Column) -> Column:
    return F.transform(x, lambda v: clamped(F.rint(v / scale + zero), -128, 127))


def int4_groups(x: Column, group: int) -> Column:
    """Symmetric four-bit groups: array of (scale, q), the last group filled up with zeros."""
    if group % 2:
        raise ValueError("a group needs an even size")
    n = F.ceil(F.size(x) / group).cast("int")

    def one(g: Column) -> Column:
        part = F.slice(x, g * group + 1, group)
        full = F.concat(part, F.array_repeat(F.lit(0.0), group - F.size(part)))
        return let(F.array_max(F.transform(part, lambda v: F.abs(v))), lambda m: let(
            F.when(m == 0, F.lit(1.0)).otherwise(m / 7.0), lambda s: F.struct(s.alias("scale"), F.transform(full, lambda v: clamped(F.rint(v / s), -8, 7)).alias("q"))))

    return F.transform(F.sequence(F.lit(0), n - 1), one)


def packed_nibbles(q: Column) -> Column:
    """Two four-bit values a byte (as int 0 to 255), the earlier one in the low half."""
    return F.transform(F.sequence(F.lit(0), (F.size(q) / 2).cast("int") - 1), lambda i: F.get(q, i * 2).bitwiseAND(15).bitwiseOR(F.shiftleft(F.get(q, i * 2 + 1).bitwiseAND(15), 4)))


def unpacked_nibbles(packed: Column) -> Column:
    sign = lambda v: F.when(v > 7, v - 16).otherwise(v)
    return F.flatten(F.transform(packed, lambda b: F.array(sign(b.bitwiseAND(15)), sign(F.shiftright(b, 4).bitwiseAND(15)))))
