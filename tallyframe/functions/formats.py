"""Text of numbers. The compact form truncates step by step in binary floating point, so it is an Arrow UDF.

All numbers of a batch take each step together: digits are columns of an array, and what is cut off is a mask.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def compact(x: float, digits: int = 4, max_scale: int = 10) -> str:
    """A short text of a number that isn't negative: up to two truncated decimals from 1 on, else d.ddddE-n.

    A run of three or more equal digits at the end of the small form is shortened to two.
    """
    return compact_all(np.array([x], float), digits, max_scale)[0]


def compact_all(values: np.ndarray, digits: int = 4, max_scale: int = 10) -> list[str]:
    """The compact texts of numbers; of equal ones the text is made once."""
    x, which = np.unique(np.asarray(values, np.float64), return_inverse=True)
    out = np.full(len(x), "0", object)
    large = np.flatnonzero(x >= 1)
    whole = np.floor(x[large])
    tail, n = _digits(x[large] - whole, 2)
    more = x[large] > whole
    for k, w, t, c, m in zip(large.tolist(), whole.tolist(), tail.tolist(), n.tolist(), more.tolist(), strict=True):
        out[k] = f"{int(w)}.{''.join(map(str, t[:c]))}" if m else str(int(w))
    small = np.flatnonzero((x > 0) & (x < 1))
    y, scale = x[small].copy(), np.zeros(len(small), np.int64)
    for _ in range(max_scale):
        below = y < 1
        y[below] *= 10
        scale[below] += 1
    reached = y >= 1
    small, y, scale = small[reached], y[reached], scale[reached]
    lead = np.floor(y)
    tail, n = _digits(y - lead, digits)
    # How many digits at the end are the same.
    differs = (tail != np.take_along_axis(tail, n[:, None] - 1, 1)) & (np.arange(digits) < n[:, None])
    run = n - np.where(differs.any(1), digits - np.argmax(differs[:, ::-1], 1), 0)
    n = np.where(run > 2, n - run + 2, n)
    for k, w, t, c, s in zip(small.tolist(), lead.tolist(), tail.tolist(), n.tolist(), scale.tolist(), strict=True):
        out[k] = f"{int(w)}.{''.join(map(str, t[:c]))}E-{s}"
    return out[which].tolist()


def _digits(rest: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimals of fractions by truncation, and how many each has: at least one, none after it is used up."""
    out, n, rest = np.zeros((len(rest), most), np.int64), np.ones(len(rest), np.int64), rest.copy()
    for k in range(most):
        n[(rest > 0) & (k > 0)] = k + 1
        rest *= 10
        out[:, k] = np.floor(rest)
        rest -= out[:, k]
    return out, n


def compact_text(x: Column, digits: int = 4) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        known = s.notna().to_numpy()
        out = np.full(len(s), None, object)
        out[known] = compact_all(s.to_numpy(float)[known], digits)
        return pd.Series(out)

    return run(x)


def compact_array(xs: Column, digits: int = 4) -> Column:
    """The same for an array, in one batch call per array column."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        known = s.notna().to_numpy()
        parts = [np.asarray(v, float) for v in s[known]]
        ends = np.cumsum([len(v) for v in parts], dtype=np.int64)
        texts = compact_all(np.concatenate(parts), digits) if parts else []
        out = np.full(len(s), None, object)
        for k, a, b in zip(np.flatnonzero(known).tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            out[k] = texts[a:b]
        return pd.Series(out)

    return run(xs)


def scientific(x: Column) -> Column:
    """d.dddE<n>."""
    scale = F.floor(F.log10(F.abs(x)))
    return F.when(x == 0, "0.000E0").otherwise(F.format_string("%1.3fE%d", x / F.pow(F.lit(10.0), scale), scale))
