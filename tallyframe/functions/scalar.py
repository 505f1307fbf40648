"""Scalar expressions: bucketing, hashing, sampling and distances. All are column expressions (whole-stage code)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of numbers that count as numeric; anything else is a category.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: A prime below 2 ** 31: hashes stay in 64-bit integers and are the same in any SQL engine.
PRIME = 2147483647


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(text: Column | str) -> Column:
    """The text as a double, or null if it isn't spelled as a number. NaN and Infinity count as spelled by the JVM."""
    t = F.trim(col(text))
    return F.when(t.rlike(NUMBER) | t.isin("NaN", "Infinity", "-Infinity", "+Infinity"), t.try_cast("double"))


def is_number(text: Column | str) -> Column:
    return number(text).isNotNull()


def java_hash(text: Column | str) -> Column:
    """String.hashCode as an int in a bigint: 31 h + c over UTF-16 units, wrapped to 32 bits."""
    t = col(text)
    point = lambda i: F.ascii(F.substr(t, i, F.lit(1))).cast("bigint")
    step = lambda h, u: F.pmod(h * 31 + u, F.lit(1 << 32))

    def add(h: Column, i: Column) -> Column:
        c = point(i)
        pair = step(step(h, F.lit(0xD800) + F.floor((c - 0x10000) / 0x400)), F.lit(0xDC00) + F.pmod(c - 0x10000, F.lit(0x400)))
        return F.when(c < 0x10000, step(h, c)).otherwise(pair)

    # One byte is its own hash; bytes only are read one after the other, other characters by their places.
    ascii_only = F.aggregate(F.split(t, ""), F.lit(0).cast("bigint"), lambda h, c: step(h, F.ascii(c).cast("bigint")))
    any_text = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), F.lit(0).cast("bigint"), add)
    size = F.octet_length(t)
    h = F.when(size == 0, F.lit(0).cast("bigint")).when(size == 1, F.ascii(t).cast("bigint")).when(size == F.length(t), ascii_only).otherwise(any_text)
    return F.when(t.isNotNull(), F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h))


def bucketize(x: Column | str, bounds: Column) -> Column:
    """The first bound that isn't below x; above all of them, or NaN, the last. No bounds: x itself."""
    value = col(x)
    up = F.array_min(F.filter(bounds, lambda b: value <= b))
    return F.when(bounds.isNull() | (F.size(bounds) == 0), value).otherwise(F.coalesce(F.when(~F.isnan(value), up), F.element_at(bounds, -1)))


def bucketize_fixed(x: Column | str, bounds: list[float]) -> Column:
    """As bucketize with the same bounds for all rows: comparisons in compiled code, halving the bounds. Null stays null."""
    value, bounds = col(x), sorted(bounds)
    if not bounds:
        return value

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(float(bounds[low]))
        mid = (low + high) // 2
        return F.when(value <= bounds[mid], search(low, mid)).otherwise(search(mid + 1, high))

    return F.when(F.isnan(value), F.lit(float(bounds[-1]))).when(value.isNotNull(), search(0, len(bounds) - 1))


def bucket_or_hash(text: Column | str, bounds: Column) -> Column:
    """A number bucketed (itself without bounds); anything else by its string hash. The number is read once, for all bounds."""
    read = F.transform(F.array(number(text)), lambda v: F.coalesce(bucketize(v, bounds), java_hash(text).cast("double")))
    return F.get(read, F.lit(0))


def number_or_hash(text: Column | str) -> Column:
    return F.coalesce(number(text), java_hash(text).cast("double"))


def bucket_to_string(text: Column | str, bounds: Column) -> Column:
    """Bounded numbers as the text of their bucket; all else stays as it is."""
    bounded = bounds.isNotNull() & (F.size(bounds) > 0) & is_number(text)
    return F.when(bounded, bucketize(number(text), bounds).cast("string")).otherwise(col(text))


def positive_modulus(i: Column | str, m: int | Column) -> Column:
    return F.pmod(col(i).bitwiseAND(F.lit(PRIME)), F.lit(m) if isinstance(m, int) else m)


def string_key(text: Column | str) -> Column:
    """A string as an integer below PRIME: the first 32 bits of its MD5."""
    return F.pmod(F.conv(F.substring(F.md5(col(text)), 1, 8), 16, 10).cast("bigint"), F.lit(PRIME))


def draw_key(text: Column | str) -> Column:
    """A string as an integer of 60 bits, the first of its MD5: an order that is random and the same in any SQL engine."""
    return F.conv(F.substring(F.md5(col(text)), 1, 15), 16, 10).cast("bigint")


def spread(k: Column | str, a: Column | int, b: Column | int) -> Column:
    """(a k + b) mod PRIME: pairwise independent for random a, b."""
    lit = lambda x: F.lit(x).cast("bigint") if isinstance(x, int) else x
    return F.pmod(lit(a) * col(k) + lit(b), F.lit(PRIME))


def coefficients(seed: int) -> tuple[int, int]:
    """The a and b of hash function ``seed``: a fixed multiplicative sequence."""
    a = (48271 * (seed + 1) * (seed + 7) + 1013904223) % PRIME
    return max(a, 1), (69621 * (seed + 3) * (seed + 11) + 12345) % PRIME


def uniform(k: Column | str, seed: int) -> Column:
    """A reproducible number in (0, 1) for an integer below PRIME. A public seed gives no privacy."""
    a, b = coefficients(seed)
    return (spread(spread(k, a, b), b | 1, a) + 0.5) / float(PRIME)


def laplace(u: Column | str, b: float | Column, mean: float = 0.0) -> Column:
    """Laplace noise of scale b from a uniform number by the inverse distribution; none for b = 0."""
    x = col(u) - 0.5
    return F.lit(mean) - F.lit(b) * F.signum(x) * F.log(1 - 2 * F.abs(x))


def cauchy(u: Column | str, scale: float | Column = 1.0, median: float = 0.0) -> Column:
    return F.lit(median) + F.lit(scale) * F.tan(math.pi * (col(u) - 0.5))


def euclidean(a: Column | str, b: Column | str) -> Column:
    """Distance of two arrays; an error if their lengths differ."""
    a, b = col(a), col(b)
    d = F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x))
    return F.when(F.size(a) == F.size(b), d).otherwise(F.raise_error(F.lit("arrays of different length")))


def clamp(x: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.least(col(x), F.lit(high)), F.lit(low))


def prior_probability(count: Column | str, total: Column | str) -> Column:
    """count / total; 0 without a total or count."""
    return F.coalesce(col(count) / F.nullif(col(total), F.lit(0.0)), F.lit(0.0))


def probability_deviation(p: Column | str, n: Column | str, b: float = 0.0) -> Column:
    """Standard deviation of a share p of n; with noise of scale b > 0 in the counts."""
    p, n = col(p), col(n)
    return F.sqrt((n * p * (1 - p) + 2 * b * b) / (n * n))


def conditional_probability(count: Column | str, total: Column | str, prior: Column | float, *, b: float = 0.0, labels: int = 2, multiple: float = 1.0, total_criterion: bool = True, variance_criterion: bool = False) -> Column:
    """count / total where it means something, else the prior.

    The prior stands in without any count; if the total is below ``multiple`` deviations of the noise in it; and, on
    request, if the share is within ``multiple`` deviations of the prior.
    """
    c, t = col(count), col(total)
    prior = F.lit(prior) if not isinstance(prior, Column) else prior
    p = c / F.nullif(t, F.lit(0.0))
    out = F.when(t == 0, prior)
    if total_criterion:
        out = out.when(t < multiple * math.sqrt(2 * b * b * labels), prior)
    if variance_criterion:
        out = out.when(F.abs(p - prior) <= multiple * probability_deviation(p, t, b), prior)
    return out.otherwise(p)


# n-grams and feature hashing over arrays of strings

DELIMITER = "^"


def namespaced(namespace: Column | str, key: Column | str) -> Column:
    return F.concat(col(namespace), F.lit(DELIMITER), col(key))


def ngrams(namespace: Column, values: Column, n: int) -> Column:
    """Keys of the n-grams that begin at each value; those at the end are shorter."""
    if n < 1:
        raise ValueError("n must be positive")
    # Shifted copies side by side: nothing is evaluated again for each element.
    shifted = F.arrays_zip(*[F.slice(values, j + 1, F.greatest(F.size(values), F.lit(0))) for j in range(n)])
    # Missing ends are null, which array_join leaves out.
    joined = lambda z: F.array_join(F.array(*[z.getField(str(j)) for j in range(n)]), DELIMITER)
    return F.transform(shifted, lambda z: F.concat(namespace, F.lit(DELIMITER), joined(z), F.lit(DELIMITER)))


def hashed_feature(key: Column, bits: int) -> Column:
    """A feature's place below 2 ** bits."""
    return F.pmod(string_key(key), F.lit(1 << bits)).cast("double")


def feature_set(spaces: Column, ngram_sizes: dict[str, int], bits: int) -> Column:
    """The features of all namespaces as one array of (key, value).

    spaces: map of namespace to array of (key, value). A namespace with an n-gram size gives (namespace, place) for the
    n-gram of values from each value on, its place below 2 ** bits; any other gives its keys with the namespace before.
    """
    if any(n < 1 for n in ngram_sizes.values()):
        raise ValueError("n must be positive")
    pair = lambda key, value: F.struct(key.alias("key"), value.cast("double").alias("value"))

    def plain(e: Column) -> Column:
        return F.transform(e["value"], lambda f: pair(namespaced(e["key"], f["key"]), f["value"]))

    def of_entry(e: Column) -> Column:
        out = plain(e)
        for name, n in ngram_sizes.items():
            texts = F.transform(e["value"], lambda f: f["value"].cast("string"))
            grams = F.transform(ngrams(e["key"], texts, n), lambda k: pair(e["key"], hashed_feature(k, bits)))
            out = F.when(e["key"] == name, grams).otherwise(out)
        return out

    return F.flatten(F.transform(F.map_entries(spaces), of_entry))
