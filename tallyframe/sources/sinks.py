"""Text sinks: lines of vectors, discretized lines, percentile files and rows that go to several outputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import formats


def numbered(vector: Column, start: int | Column = 0) -> Column:
    """``0:v 1:v ...`` of an array of texts."""
    return F.array_join(F.transform(vector, lambda v, i: F.concat((i + start).cast("string"), F.lit(":"), v)), " ")


def vw_line(label: Column, vectors: list[tuple[Column, int]], digits: int = 4) -> Column:
    """``<label> |1 0:v 1:v |5 0:v ...``: a namespace per vector, named by the running length; vectors are (array of
    doubles, length)."""
    return vw_texts(label, [(formats.compact_array(v, digits), n) for v, n in vectors])


def vw_texts(label: Column, vectors: list[tuple[Column, int]]) -> Column:
    """The same of vectors whose numbers are texts already."""
    parts, offset = [label.cast("double").cast("string"), F.lit(" ")], 1
    for vector, size in vectors:
        places = [F.concat(F.lit(f"{i}:"), F.get(vector, F.lit(i))) for i in range(size)] if size <= 64 else None
        parts += [F.lit(f"|{offset} "), F.concat_ws(" ", *places) if places else numbered(vector), F.lit(" ")]
        offset += size
    return F.concat(*parts)


def vw_line_single(label: Column, vector: Column, digits: int = 4) -> Column:
    """``<label> |f f0:v f1:v``."""
    texts = formats.compact_array(vector, digits)
    return F.concat(label.cast("double").cast("string"), F.lit(" |f "), F.array_join(F.transform(texts, lambda v, i: F.concat(F.lit("f"), i.cast("string"), F.lit(":"), v)), " "))


def keep_original(line: Column, raw: Column, places: list[int] | None = None) -> Column:
    """The line with the original features, or those at the given places, in a namespace ``o``."""
    tokens = F.split(raw, " ")
    kept = F.array_join(F.array(*[F.get(tokens, F.lit(i)) for i in places]), " ") if places else raw
    return F.concat(line, F.lit(" |o "), kept)


def discretized_line(label: Column, features: Column) -> Column:
    return F.concat(label.cast("double").cast("string"), F.lit(" |f "), F.array_join(features, " "))


def percentile_line(feature: Column, bounds: Column) -> Column:
    return F.concat(feature.cast("string"), F.lit(" | "), F.array_join(F.transform(bounds, lambda b: b.cast("string")), " "))


def write_text(rows: DataFrame, path: str, *, compressed: bool = True, mode: str = "overwrite") -> None:
    """rows of one string column, gzipped unless told otherwise."""
    rows.write.mode(mode).option("compression", "gzip" if compressed else "none").text(path)


@dataclass(frozen=True)
class Route:
    """An output, which rows go there, and their line."""

    output: str
    condition: Column
    line: Column


def write_fan_out(rows: DataFrame, routes: list[Route], path: str) -> None:
    """One pass over rows that writes each to all outputs that want it: lines below ``path``/output=<name>, gzipped.

    A condition that is null is false. An output without rows has no folder. A task keeps all outputs' files open, so that
    lines needn't be sorted by output, which would spill them all.
    """
    if len({r.output for r in routes}) != len(routes):
        raise ValueError("outputs need different names")
    targets = F.array(*[F.when(r.condition, F.struct(F.lit(r.output).alias("output"), r.line.alias("value"))) for r in routes])
    sent = rows.select(F.inline_outer(F.array_compact(targets))).where("output is not null")  # outer: targets are made once
    conf, key = rows.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(key, None)
    conf.set(key, max(len(routes) + 1, int(before or 0)))  # at as many open files as this, a task sorts the rest
    try:
        sent.write.mode("overwrite").partitionBy("output").option("compression", "gzip").text(path)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)
