"""Text sources: lines with a label, optional weight and features after a bar; delimited files; sniffed gzip.

Everything but reading sniffed files is column expressions over ``spark.read.text``. A dense line is
``<label> [weight] |[namespace] v v k:v ...``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import scalar as S

#: A bar with what is glued to it parts label and features.
BAR = r"\|\S*"
EMPTY_BOUNDS = "array<double>"
#: Features of a line up to which each place is an expression of its own.
UNROLLED = 64


def dealt(rows: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores (one row group, a few small files), dealt round to all of them.

    What follows is bound by the CPU; a table with splits enough is left as it is, without a shuffle. For scans only:
    the splits are counted without running anything.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


#: Bytes of a plain file that one task reads, and of a block in memory.
RANGE_BYTES = 64 << 20
BLOCK_BYTES = 1 << 20


def lines(spark: SparkSession, path: str, *, sniff: bool = False) -> DataFrame:
    """(value) of each line. Gzip is known by its extension, or with ``sniff`` by the first two bytes of each file.

    Sniffed files are read in blocks, plain ones by ranges of bytes, so that no task holds a file, whatever its size;
    a gzip file is one stream by nature. Bytes that aren't UTF-8 are replaced, a carriage return before a line's end is cut.
    """
    if not sniff:
        return spark.read.text(path)
    files = spark.read.format("binaryFile").load(path)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(RANGE_BYTES).cast("long")))
    # Paths and lengths alone: contents are opened in the tasks.
    ranges = files.select("path", starts.alias("start")).repartition(spark.sparkContext.defaultParallelism * 4, "path", "start")
    bounds = RANGE_BYTES, BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, place = pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
                with fs.open_input_file(place) as f:
                    for found in _range_lines(f, start, *bounds):
                        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["value"])

    return ranges.mapInArrow(run, "value string")


def _range_lines(f, start: int, size: int, block: int) -> Iterator[list[str]]:
    """Lines of a file that begin in a range of its bytes, a block at a time; all lines of a gzip file belong to its first range."""
    packed = f.read_at(2, 0) == b"\x1f\x8b"
    if packed and start:
        return
    carried, end = b"", None if packed else start + size
    # From the byte before: a line begins here only if that ends one.
    at = f.seek(max(0, start - 1)) if not packed else f.seek(0)
    skipping = start > 0
    for data in _unpacked(f, block) if packed else iter(lambda: f.read(block), b""):
        if skipping:
            cut = data.find(b"\n")
            at += len(data) if cut < 0 else cut + 1
            if cut < 0:
                continue
            data, skipping = data[cut + 1 :], False
            if end is not None and at >= end:
                return
        rows = (carried + data).split(b"\n")
        carried = rows.pop()
        if end is not None:  # where each line begins: those from end on are the next range's
            out = []
            for r in rows:
                if at >= end:
                    carried = b""
                    break
                out.append(r)
                at += len(r) + 1
            yield [_line(r) for r in out]
            if at >= end:
                return
        elif rows:
            yield [_line(r) for r in rows]
    if carried and not skipping:
        yield [_line(carried)]


def _line(data: bytes) -> str:
    return data.removesuffix(b"\r").decode("utf-8", "replace")


def _unpacked(f, block: int) -> Iterator[bytes]:
    """The bytes of a gzip stream of one or more members, a bounded block at a time."""
    z, rest = zlib.decompressobj(31), b""
    while True:
        ended = not rest and not (rest := f.read(block))
        # What is consumed but not yet given comes at the end.
        out = z.flush() if ended else z.decompress(rest, block)
        rest = z.unconsumed_tail
        if out:
            yield out
        if z.eof:
            rest, z = z.unused_data.lstrip(b"\0"), zlib.decompressobj(31)
        if ended and not rest:
            return


def percentiles(rows: DataFrame) -> dict[int, list[float]]:
    """Bounds by feature of lines ``<index> | b b ...``, ascending; of a repeated index the last line counts.

    A percentile file has one line per feature, so it is collected."""
    out = {}
    for r in rows.select("value").collect():
        head, _, tail = r["value"].partition("|")
        if head.strip():
            out[int(head)] = sorted(float(x) for x in tail.split())
    return out


def bounds_literal(by_feature: dict[int, list[float]]) -> Column:
    """The bounds as a map literal."""
    if not by_feature:
        return F.lit(None).cast("map<int,array<double>>")
    return F.create_map(*[x for i, b in sorted(by_feature.items()) for x in (F.lit(i), F.array(*[F.lit(v) for v in b]) if b else F.array().cast(EMPTY_BOUNDS))])


def bounds_of(by_feature: dict[int, list[float]], i: Column) -> Column:
    return F.try_element_at(bounds_literal(by_feature), i.cast("int")) if by_feature else F.lit(None).cast(EMPTY_BOUNDS)


def _tokens(text: Column) -> Column:
    """Tokens between white space; what the bare trim leaves at the ends is cut before the split."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(bare != "", F.split(bare, r"\s+")).otherwise(F.array().cast("array<string>"))


def _checked(ok: Column, value: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit(message + ": "), F.col("value"))))


def _head(pieces: Column) -> tuple[Column, Column]:
    head = _tokens(F.get(pieces, F.lit(0)))
    ok = F.size(head).isin(1, 2)
    label = _checked(ok, F.get(head, F.lit(0)).try_cast("double"), "one label and at most a weight are wanted")
    return label, F.get(head, F.lit(1)).try_cast("double")


def parse_dense(rows: DataFrame, feature_count: int, by_feature: dict[int, list[float]] | None = None) -> DataFrame:
    """rows (value, ...) with label, weight, features (doubles) and raw, the trimmed text after the bar.

    A feature's place is its position, whatever key it has; missing ones are 0. Numbers are bucketed where the
    feature has bounds, other text is hashed. More features than feature_count, or no bar, are errors.
    """
    pieces = F.split("value", BAR)
    label, weight = _head(pieces)
    tokens = _tokens(F.get(pieces, F.lit(1)))
    out = rows.select("*", label.alias("label"), weight.alias("weight"), tokens.alias("_t"), F.size(pieces).alias("_n"), F.trim(F.get(pieces, F.lit(1))).alias("raw"))
    if feature_count <= UNROLLED:  # a column for each place: compiled code, and each token is read once
        bounds = by_feature or {}
        at = [F.substring_index(F.get("_t", F.lit(i)), ":", -1) for i in range(feature_count)]
        out = out.select("*", *[x.alias(f"_x{i}") for i, x in enumerate(at)])
        out = out.select("*", *[S.number(f"_x{i}").alias(f"_v{i}") for i in range(feature_count)])
        each = [F.coalesce(S.bucketize_fixed(f"_v{i}", bounds.get(i, [])), S.java_hash(f"_x{i}").cast("double"), F.lit(0.0)) for i in range(feature_count)]
        padded = F.array(*each)
    else:
        value = lambda t, i: S.bucket_or_hash(F.substring_index(t, ":", -1), bounds_of(by_feature or {}, i))
        padded = F.slice(F.concat(F.transform("_t", value), F.array_repeat(F.lit(0.0), feature_count)), 1, feature_count)
    ok = (F.col("_n") == 2) & (F.size("_t") <= feature_count)
    return out.select(*rows.columns, "label", "weight", _checked(ok, padded, "a line has another shape").alias("features"), "raw")


def parse_strings(rows: DataFrame, feature_count: int, by_feature: dict[int, list[float]] | None = None) -> DataFrame:
    """As parse_dense with string features: an integer key is the place, missing ones are "", categories stay."""
    pieces = F.split("value", BAR)
    label, weight = _head(pieces)
    tokens = _tokens(F.get(pieces, F.lit(1)))

    def entry(t: Column, i: Column) -> Column:
        keyed = F.instr(t, ":") > 0
        place = F.when(keyed, F.substring_index(t, ":", 1).try_cast("int")).otherwise(i)
        text = F.when(keyed, F.substring_index(t, ":", -1)).otherwise(t)
        return F.struct(place.alias("i"), S.bucket_to_string(text, bounds_of(by_feature or {}, place)).alias("v"))

    entries = F.transform(tokens, entry)
    at = lambda n: F.coalesce(F.get(F.transform(F.filter(F.col("_e"), lambda e: e["i"] == n), lambda e: e["v"]), F.lit(0)), F.lit(""))
    out = rows.select("*", label.alias("label"), weight.alias("weight"), entries.alias("_e"), F.trim(F.get(pieces, F.lit(1))).alias("raw"))
    return out.select(*rows.columns, "label", "weight", F.array(*[at(n) for n in range(feature_count)]).alias("features"), "raw")


def parse_namespaced(rows: DataFrame, by_feature: dict[int, list[float]] | None = None) -> DataFrame:
    """rows with label and namespaces: map<string, array<struct<k, v>>>.

    A part that begins with a blank has the namespace "". Parts of one namespace are joined in order. A bare token's
    key is its position in the joined namespace and its value is bucketed; k:v keeps its key and isn't bucketed.
    """
    parts = F.split("value", r"\|")
    label, _ = _head(parts)
    named = F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p: F.struct(F.when(p.rlike(r"^\s"), "").otherwise(F.get(F.split(F.trim(p), r"\s+"), F.lit(0))).alias("ns"), F.when(p.rlike(r"^\s"), _tokens(p)).otherwise(F.slice(_tokens(p), 2, 1 << 30)).alias("t")),
    )

    def feature(t: Column, i: Column) -> Column:
        keyed = F.instr(t, ":") > 0
        bare = S.bucket_or_hash(t, bounds_of(by_feature or {}, i))
        return F.struct(F.when(keyed, F.substring_index(t, ":", 1)).otherwise(i.cast("string")).alias("k"), F.when(keyed, S.number_or_hash(F.substring_index(t, ":", -1))).otherwise(bare).alias("v"))

    joined = lambda n: F.flatten(F.transform(F.filter("_n", lambda x: x["ns"] == n), lambda x: x["t"]))
    out = rows.select("*", label.alias("label"), named.alias("_n")).withColumn("_names", F.array_distinct(F.transform("_n", lambda x: x["ns"])))
    spaces = F.map_from_entries(F.transform("_names", lambda n: F.struct(n.alias("key"), F.transform(joined(n), feature).alias("value"))))
    return out.withColumn("namespaces", spaces).drop("_n", "_names")


def namespaced_features(parsed: DataFrame, *kept: str) -> DataFrame:
    """What parse_namespaced gives as rows (kept..., ns, k, v), one for each feature.

    Outer generators: inner ones have their input tested for emptiness, and the whole parse for that a second time,
    where the rows are scanned.
    """
    spaces = parsed.select(*kept, F.explode_outer("namespaces").alias("ns", "fs")).where("ns is not null")
    return spaces.select(*kept, "ns", F.inline_outer("fs")).where("k is not null")


def criteo(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """Tab-separated label and ``columns`` features: label 1 stays, all else is -1; an empty or missing field is 0.0."""
    fields = F.split("value", "\t")
    value = lambda i: F.coalesce(F.nullif(F.get(fields, F.lit(i)), F.lit("")), F.lit("0.0"))
    return spark.read.text(path).select(F.when(F.get(fields, F.lit(0)) == "1", 1.0).otherwise(-1.0).alias("label"), F.array(*[value(i) for i in range(1, columns + 1)]).alias("features"))


def movies(spark: SparkSession, path: str) -> DataFrame:
    """(movieId, title, genres) of a CSV with a header; genres are an array, empty where none are listed."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', schema="movieId string, title string, genres string")
    return rows.withColumn("genres", F.when(F.col("genres") == "(no genres listed)", F.array().cast("array<string>")).otherwise(F.split("genres", r"\|")))


def ratings(spark: SparkSession, path: str) -> DataFrame:
    """(userId, movieId, rating as it is written, timestamp) of a CSV with a header."""
    return spark.read.csv(path, header=True, schema="userId string, movieId string, rating string, timestamp bigint")


def synthetic_lines(spark: SparkSession, rows: int, features: int, *, namespaces: int = 1, keys: bool = False, seed: int = 1) -> DataFrame:
    """Lines of random whole numbers, a function of row and seed."""
    value = lambda n, f: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(n), F.lit(f)), F.lit(1000)).cast("string")
    spaces = []
    for n in range(namespaces):
        tokens = [F.concat(F.lit(f"k{f}:"), value(n, f)) if keys else value(n, f) for f in range(features)]
        spaces.append(F.concat(F.lit(f"|n{n} " if namespaces > 1 else "| "), F.array_join(F.array(*tokens), " ")))
    return spark.range(rows).select(F.concat(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2)).cast("string"), F.lit(" "), F.concat_ws(" ", *spaces)).alias("value"))
