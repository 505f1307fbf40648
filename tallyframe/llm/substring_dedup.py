"""Repeated passages, located by sharded Aho-Corasick automata and removed from all documents but the first.

Words are runs of bytes other than ASCII white space, unchanged; a window is WINDOW consecutive words of one
document. Each window has one anchor, the GRAM-word gram in it with the smallest hash, so equal windows have equal
anchors, and only one gram in five is one.

0. Copies: of equal texts the smallest id represents all; the others lose every word if they have a window. Only
   representatives go on.
1. Recurring passages: anchors that occur in more than one document (a hash, so only a filter: it can let too
   much through, never too little).
2. Pieces: from every document, the runs of windows around a recurring anchor, as texts of at most 2 * WINDOW words.
   Equal pieces are merged before they are moved, with the smallest and largest id that hold them. A frequent phrase
   inside differing text would make one unbounded group: an anchor that occurs more than HOT_PIECES times has a piece
   for each window, and these are dealt to parts of the anchor by their own hash, so that equal ones still meet.
3. Automata: pieces are dealt to shards by anchor and part, so that all pieces that can share a window meet. A shard
   confirms which passages recur (whole pieces where an anchor has one, else single windows), compiles them into
   one automaton over its own word codes, each with the smallest id of a document that has it, and streams the
   pieces through it: every occurrence is located, compared word by word.
4. Documents: located windows return to their documents, by the piece; a word covered by a window that a
   document with a smaller id has too goes.

The texts are dealt by id in one exchange that all steps reuse.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm import textbytes as tb
from tallyframe.llm.spark import read, written

WINDOW = 13
GRAM = 5
SHARD_PIECES = 20_000
HOT_PIECES = 2048


def _anchors(w: tb.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window in the chunk: its first word, its anchor's first word; and the gram hashes."""
    g, _ = w.grams(w.hashes(), GRAM)
    n = len(w.start) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), g
    least, at = g[:n].copy(), np.arange(n)
    for j in range(1, WINDOW - GRAM + 1):
        here = g[j : j + n]
        better = here < least
        least = np.where(better, here, least)
        at = np.where(better, np.arange(j, j + n), at)
    whole = np.arange(n) + WINDOW <= np.repeat(w.first[1:], w.counts)[:n]
    # 48 bits are enough for a filter, and are what is moved.
    return np.flatnonzero(whole), at[whole], g >> np.uint64(16)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, ..., copy): the anchors of those that have an id and are no copies, with how often each occurs.

    Rows are left out here, so that no filter or pruning is pushed below the exchange of the texts.
    """
    for batch in batches:
        copy = pc.fill_null(batch.column(batch.num_columns - 1), False)
        batch = batch.select([0, 1]).filter(pc.and_(batch.column(0).is_valid(), pc.invert(copy)))
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for i, j, data, at in tb.chunks(batch.column(1)):
            w = tb.words(data, at, tb.PLAIN)
            _, where, g = _anchors(w)
            where = np.unique(where)
            text = np.searchsorted(w.first, where, "right") - 1
            anchor = g[where]
            order = np.lexsort((anchor, text))
            text, anchor = text[order], anchor[order]
            new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])))) if len(anchor) else np.empty(0, int)
            times = np.diff(np.append(new, len(anchor))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(anchor[new].view(np.int64)), pa.array(ids[i:j][text[new]].astype(np.int64)), pa.array(times)], ["anchor", "id", "times"])


def _canonical(w: tb.Words, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words with one space after each, and where each begins."""
    size = w.end - w.start + 1
    at = np.concatenate(([0], np.cumsum(size)))
    source = np.arange(at[-1]) - np.repeat(at[:-1] - w.start, size)
    out = data[np.minimum(source, len(data) - 1)]
    out[at[1:] - 1] = 0x20
    return out, at


def _piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, ..., recurring anchors, those of them that are hot with their number of parts)."""
    for batch in batches:
        ids, texts, known, hot = batch.column(0), batch.column(1), batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
        for i, j, data, at in tb.chunks(texts):
            w = tb.words(data, at, tb.PLAIN)
            windows, where, g = _anchors(w)
            if not len(windows):
                continue
            text = np.searchsorted(w.first, windows, "right") - 1
            runs = np.flatnonzero(np.concatenate(([True], (where[1:] != where[:-1]) | (text[1:] != text[:-1]))))
            ends = np.append(runs[1:], len(windows))
            of, anchor = text[runs].astype(np.uint64), g[where[runs]]
            lists = known.slice(i, j - i)
            recurring = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            size = np.diff(lists.offsets.to_numpy(zero_copy_only=False))
            spread = np.uint64(0x9E3779B97F4A7C15)
            hit = np.flatnonzero(np.isin(tb.mix(anchor + of * spread), tb.mix(recurring + np.repeat(np.arange(j - i, dtype=np.uint64), size) * spread)))
            if not len(hit):
                continue
            parts = _parts(hot.slice(i, j - i), anchor[hit], of[hit])
            # A hot anchor's run of windows is a piece for each of them.
            each = np.where(parts > 1, ends[hit] - runs[hit], 1)
            nth = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
            hit, parts, many = np.repeat(hit, each), np.repeat(parts, each), np.repeat(parts > 1, each)
            first = windows[runs[hit] + nth]
            last, doc = np.where(many, first, windows[ends[hit] - 1]) + WINDOW, text[runs[hit]]
            canonical, begins = _canonical(w, data)
            length = begins[last] - 1 - begins[first]
            edge = np.concatenate(([0], np.cumsum(length)))
            gathered = canonical[np.arange(edge[-1]) - np.repeat(edge[:-1] - begins[first], length)]
            pieces = pa.Array.from_buffers(pa.binary(), len(hit), [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(gathered)])
            yield pa.RecordBatch.from_arrays([pa.array(anchor[hit].view(np.int64)), ids.slice(i, j - i).take(pa.array(doc)), pa.array((first - w.first[doc]).astype(np.int32)), pieces, pa.array(parts.astype(np.int32))], ["anchor", "id", "start", "piece", "parts"])


def _parts(lists: pa.Array, anchor: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The number of parts of each (anchor, row). lists: by row, the hot anchors and their parts."""
    out = np.ones(len(anchor), np.int64)
    entries = lists.flatten()
    if len(entries):
        size = np.diff(lists.offsets.to_numpy(zero_copy_only=False))
        spread = np.uint64(0x9E3779B97F4A7C15)
        key = tb.mix(entries.field(0).to_numpy(zero_copy_only=False).view(np.uint64) + np.repeat(np.arange(len(lists), dtype=np.uint64), size) * spread)
        order = np.argsort(key)
        mine = tb.mix(anchor + of * spread)
        at = np.minimum(np.searchsorted(key[order], mine), len(key) - 1)
        out = np.where(key[order][at] == mine, entries.field(1).to_numpy(zero_copy_only=False)[order][at], 1)
    return out


def _shard(groups: list[list[tuple[bytes, int, int, int]]], shift: int = 0) -> tuple[list[int], list[list[int]]]:
    """groups: by anchor, (piece, key, first id, last id). The keys, and the first ids of the windows of each piece."""
    codes: dict[bytes, int] = {}
    automaton = ahocorasick.Automaton()
    owner: dict[str, int] = {}
    streams = []
    for group in groups:
        spelled = []
        for piece, key, first, last in group:
            s = "".join([chr(codes.setdefault(x, len(codes) + 1 if len(codes) < 0xD7FF else len(codes) + 0x801)) for x in piece.split(b" ")])
            spelled.append((s, key, first, last))
        streams += spelled
        if len(group) == 1:
            s, _, first, _ = spelled[0]
            automaton.add_word(s, (len(s), first))
            continue
        owner.clear()
        again = set()
        for s, _, first, last in spelled:
            for k in range(len(s) - WINDOW + 1):
                x = s[k : k + WINDOW]
                o = owner.get(x)
                if o is None:
                    owner[x] = first
                else:
                    again.add(x)
                    if first < o:
                        owner[x] = first
                    continue
                if last >> shift > first >> shift:
                    again.add(x)
        for x in again:
            automaton.add_word(x, (WINDOW, owner[x]))
    automaton.make_automaton()
    none = np.iinfo(np.int64).max
    keys, owners = [], []
    for s, key, _, _ in streams:
        found = [none] * (len(s) - WINDOW + 1)
        for end, (size, first) in automaton.iter(s):
            for k in range(end + 1 - size, end + 2 - WINDOW):
                if first < found[k]:
                    found[k] = first
        keys.append(key)
        owners.append(found)
    return keys, owners


def _locate(shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (anchor, part, piece, key, first id, last id), with those of an anchor's part together: for each piece, by key, the first id of each of its windows."""
        groups: list[list[tuple[bytes, int, int, int]]] = []
        held, group = 0, None

        def done() -> pa.RecordBatch:
            keys, owners = _shard(groups, shift)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(owners, pa.list_(pa.int64()))], ["key", "owners"])

        for batch in batches:
            for anchor, part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (anchor, part) != group:
                    if held >= SHARD_PIECES:
                        yield done()
                        groups, held = [], 0
                    groups.append([])
                    group = anchor, part
                groups[-1].append(tuple(row))
                held += 1
        if groups:
            yield done()

    return run


INTEGERS = ("tinyint", "smallint", "int", "bigint")


def _keyed(documents: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, int]:
    """documents, the column of whole numbers that names its rows, and how many bits of it don't count when ids are compared.

    Whole-number ids that stand for one text each are that column themselves. Otherwise it is a further column, last:
    the place of the id in the order of its type, above the place of the text among those of the id. Rows of equal id
    and text share it; where the id is null it is null.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    known = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.md5(text).alias("same"))
    if documents.schema[id_col].dataType.simpleString() in INTEGERS:
        several = known.groupBy("id").agg(F.min("same").alias("s0"), F.max("same").alias("s1")).where("s0 <> s1")
        if several.limit(1).isEmpty():
            return documents, id_col, 0
    spark = documents.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(known.distinct().repartitionByRange(n, "id", "same").withColumn("part", F.spark_partition_id()), "id-ranges")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row a range
    inside = F.row_number().over(Window.partitionBy("part").orderBy("id", "same")) - 1
    places = written(ranged.withColumn("inside", inside).join(F.broadcast(before), "part").select("id", "same", (F.col("before") + F.col("inside")).alias("place")), "id-places")
    firsts = places.groupBy("id").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    most = firsts.agg(F.max("n").alias("n"), F.max("first").alias("first")).first()
    shift = max(0, (most["n"] or 1) - 1).bit_length()
    if (most["first"] or 0).bit_length() + shift > 62:
        raise ValueError("too many texts for one id")
    keys = places.join(firsts, "id").select(F.col("id").alias("_i"), F.col("same").alias("_s"), (F.shiftleft("first", shift) + F.col("place") - F.col("first")).alias("_k"))
    name = "_key"
    while name in documents.columns:
        name += "_"
    out = documents.join(keys, (documents[id_col] == keys["_i"]) & (F.md5(F.coalesce(documents[text_col], F.lit(""))) == keys["_s"]), "left")
    return out.select(*[documents[c] for c in documents.columns], keys["_k"].alias(name)), name, shift


def _with_hits(documents: DataFrame, id_col: str, text_col: str, shift: int) -> tuple[DataFrame, list[str]]:
    """(id, text, other columns as x0, x1, ..., sorted starts of windows that an earlier document has).

    Ids name texts; they are compared without their lowest ``shift`` bits.
    """
    others = [c for c in documents.columns if c not in (id_col, text_col)]
    spark = documents.sparkSession
    smaller = lambda a, b: F.shiftright(a, shift) < F.shiftright(b, shift) if shift else F.col(a) < F.col(b) if isinstance(a, str) else a < F.col(b)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows without an id are dealt by their texts. The key is never null: a filter on nulls, pushed under one exchange only, would keep it from being reused.
    base = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(id_col).cast("long"), -1 - F.pmod(F.xxhash64(text_col), F.lit(1 << 40)), F.lit(-1)).alias("key"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(others)])
    dealt = base.repartition(n, "key")
    # Copies: (key, id of the first of the equal texts), from the ids and digests alone.
    digests = base.where("id is not null and text is not null").select("key", F.md5("text").alias("same"))
    first = digests.groupBy("same").agg(F.min("key").alias("i0"), F.max("key").alias("i1")).where(smaller("i0", "i1")).select("same", "i0")
    copies = digests.join(first, "same").where(smaller("i0", "key")).select("key", F.lit(True).alias("copy")).distinct()
    marked = dealt.join(copies, "key", "left")
    rows = marked.select("id", "text", "key", *[c for c in base.columns if c not in ("id", "text", "key")], "copy").mapInArrow(_anchor_rows, "anchor long, id long, times int").where("anchor is not null and id is not null")
    parts = (1 + F.floor(F.sum("times") * (WINDOW - GRAM + 1) / HOT_PIECES)).cast("int")
    # Written: the join with it then has two exchanges of its own, whose hot anchors are split.
    recurring = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.when(F.sum("times") > HOT_PIECES, parts).alias("parts")).where("n > 1").select("anchor", "parts")
    recurring = written(recurring, "recurring-anchors")
    hot = F.collect_set(F.when(F.col("parts").isNotNull(), F.struct("anchor", "parts")))
    by_document = rows.join(recurring, "anchor").groupBy("id").agg(F.collect_set("anchor").alias("anchors"), hot.alias("hot"))
    pieces = dealt.join(by_document.withColumnRenamed("id", "key"), "key").select(*base.columns, "anchors", "hot").mapInArrow(_piece_rows, "anchor long, id long, start int, piece binary, parts int").where("id is not null")
    distinct = pieces.groupBy("anchor", "piece", "parts").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    distinct = distinct.select("anchor", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("piece"), "parts").cast("int")).otherwise(0).alias("part"), "piece", F.xxhash64("anchor", "piece").alias("key"), "first", "last")
    located = distinct.repartition(n, "anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(_locate(shift), "key long, owners array<long>")
    hits = pieces.select("id", "start", F.xxhash64("anchor", "piece").alias("key")).join(located, "key")
    starts = F.filter(F.transform("owners", lambda o, k: F.when(smaller(o, "id"), F.col("start") + k)), lambda x: x.isNotNull())
    hits = hits.select("id", starts.alias("starts")).where("size(starts) > 0").groupBy("id").agg(F.sort_array(F.flatten(F.collect_list("starts"))).alias("starts"))
    # A copy has the starts [-1]: all windows.
    out = marked.join(hits.withColumnRenamed("id", "key"), "key", "left").withColumn("starts", F.when(F.col("id").isNotNull(), F.when(F.col("copy"), F.array(F.lit(-1))).otherwise(F.col("starts"))))
    return out.select(*[c for c in base.columns if c != "key"], "starts"), others


def _removed(w: tb.Words, starts: pa.Array, i: int) -> np.ndarray:
    """Which words of the chunk are covered; starts: of row i and on."""
    edge = np.zeros(len(w.start) + 1, np.int64)
    for d in range(len(w.first) - 1):
        if starts[i + d].is_valid:
            s = np.unique(starts[i + d].values.to_numpy(zero_copy_only=False)) + w.first[d]
            if s[0] < w.first[d]:
                s = np.arange(w.first[d], w.first[d + 1])
            s = s[s + WINDOW <= w.first[d + 1]]
            np.add.at(edge, s, 1)
            np.add.at(edge, s + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        starts = batch.column(batch.num_columns - 1)
        for i, j, data, at in tb.chunks(batch.column(1)):
            w = tb.words(data, at, tb.PLAIN)
            gone = _removed(w, starts, i)
            sums = np.concatenate(([0], np.cumsum(gone)))
            kept = []
            if len(w.start):
                text, begins = _canonical(w, data)
                text = text[np.repeat(~gone, np.diff(begins))].tobytes()
                size = np.concatenate(([0], np.cumsum(np.where(gone, 0, np.diff(begins)))))
            for d in range(j - i):
                a, b = (int(size[w.first[d]]), int(size[w.first[d + 1]])) if len(w.start) else (0, 0)
                kept.append(hashlib.sha256(text[a : b - 1] if b > a else b"").hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(w.counts), pa.array(sums[w.first[1:]] - sums[w.first[:-1]]), pa.array(kept)], ["id", "n_words", "n_removed", "kept_sha256"])


def report(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row.

    A null text has no words. A row without an id is never smaller or larger than another: it loses nothing. Ids are
    of any type that has an order. Rows of one id with different texts are documents each, none smaller than another;
    repeated rows lose the same words. Other columns aren't looked at. An empty table gives an empty result. A text is
    read whole by one task.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    keyed, key, shift = _keyed(documents.select(id_col, text_col), id_col, text_col)
    found, others = _with_hits(keyed, key, text_col, shift)
    own = "x0" if others else "id"  # the id itself, where it isn't the key
    return found.select(F.col(own).cast(kind).alias("id"), "text", "starts").mapInArrow(_report, f"id {kind}, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("id", id_col)


def remove_repeats(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents with repeated passages cut from the texts, each with the white space after it; other columns as they are.

    Null, empty and other texts without a repeated window stay as they are, byte for byte. A row without an id loses
    nothing; rows of one id with different texts are documents each, none smaller than another; repeated rows lose the
    same words. Ids are of any type that has an order. Other columns may have any names. An empty table gives an empty
    result.
    """
    keyed, key, shift = _keyed(documents, id_col, text_col)
    found, others = _with_hits(keyed, key, text_col, shift)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = batch.column(batch.num_columns - 1)
            for i, j, data, at in tb.chunks(batch.column(1)):
                w = tb.words(data, at, tb.PLAIN)
                gone = _removed(w, starts, i)
                texts = []
                old = batch.column(1).slice(i, j - i)
                for d in range(j - i):
                    own = slice(w.first[d], w.first[d + 1])
                    if not gone[own].any():
                        texts.append(old[d].as_py())
                        continue
                    keep = np.ones(at[d + 1] - at[d], bool)
                    stop = np.append(w.start[own][1:], at[d + 1])
                    for a, b in zip((w.start[own][gone[own]] - at[d]).tolist(), (stop[gone[own]] - at[d]).tolist(), strict=True):
                        keep[a:b] = False
                    texts.append(data[at[d] : at[d + 1]][keep].tobytes().decode())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(texts, pa.string()), *[batch.column(k).slice(i, j - i) for k in range(2, batch.num_columns - 1)]], batch.schema.names[:-1])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields[:-1])
    out = found.mapInArrow(cut, shape).toDF(key, text_col, *others)
    return out.select(*[F.col(c).cast(documents.schema[c].dataType) for c in documents.columns])


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return report(read(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), firsts AS (
  SELECT s, min(doc_id) AS first FROM windows GROUP BY s
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (s) WHERE first < doc_id
), words AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
