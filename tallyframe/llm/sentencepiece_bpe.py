"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

A merge-type model joins neighbouring symbols, best score first and the leftmost of equals, until no join is in its
vocabulary. With merge-dropout a candidate that reaches the head of the agenda is skipped for good if its keyed
hash falls below ``dropout``: the key holds the seed, the document, the unit's place in it and spelling, and the
candidate's span in the unit. A document thus has the same segmentation wherever and however often it is encoded,
another seed gives another one, and every place of a word has a draw of its own (with ``variants``, one of so many
for each spelling). With dropout 0 the ids are those of the model's own library.

No piece holds a space after another character, so texts are cut into units before each run of spaces. Equal units
of a chunk are segmented once without dropout; a unit whose key skips none of the candidates met on that way has that
segmentation, and each of the others is segmented by its own key. Short units are merged together, one merge of each in a
round, on numpy arrays; long ones by a heap. Characters outside the vocabulary, and the model's own space mark,
become byte pieces, so that decoding gives back every byte of any text.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import textbytes as tb
from tallyframe.llm.spark import read

MARK = 0x2581
NONE = np.int32((1 << 21) - 1)
OTHER = np.int32((1 << 21) - 2)
LONG_UNIT = 48
DECODED = 1 << 20  # tokens spelled at a time
_NO_SPACE = np.arange(256) != 0x20
FAR = np.int32(2**31 - 1)


@dataclass
class Model:
    """Tables of a merge-type model: ids of characters, results and ranks of pairs, bytes of pieces."""

    of_char: np.ndarray  # by code point; OTHER where there is no piece
    pair: np.ndarray  # left << 21 | right, sorted
    merged: np.ndarray
    rank: np.ndarray  # of pieces: 0 is merged first; equal scores are equal
    byte_id: np.ndarray  # by byte
    spelled: np.ndarray  # bytes of all pieces
    spelled_at: np.ndarray

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of joined symbols, NONE where they don't join."""
        k = left.astype(np.int64) << 21 | right
        at = np.minimum(np.searchsorted(self.pair, k), len(self.pair) - 1)
        return np.where(self.pair[at] == k, self.merged[at], NONE)


def load(path: str) -> Model:
    """Reads a sentencepiece model file of type BPE with byte pieces and without normalisation."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    normal = {p: i for i, p in enumerate(pieces) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
    mark = chr(MARK)
    if any(mark in p.lstrip(mark) for p in normal):
        raise ValueError("a piece holds a space after another character; units can't be cut at spaces")
    of_char = np.full(0x110000, OTHER, np.int32)
    for p, i in normal.items():
        if len(p) == 1:
            of_char[ord(p)] = i
    of_char[0x20], of_char[MARK] = of_char[MARK], OTHER
    pairs = {normal[p[:k]] << 21 | normal[p[k:]]: i for p, i in normal.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal}
    keys = np.array(sorted(pairs), np.int64)
    scores = np.array([sp.get_score(i) for i in range(n)])
    order = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
    byte_id = np.zeros(256, np.int32)
    spelled = []
    for i, p in enumerate(pieces):
        if sp.is_byte(i):
            byte_id[int(p[3:5], 16)] = i
            spelled.append(bytes([int(p[3:5], 16)]))
        else:
            spelled.append(p.replace(mark, " ").encode() if p in normal else b"")
    return Model(of_char, keys, np.array([pairs[k] for k in keys.tolist()], np.int32), order, byte_id, np.frombuffer(b"".join(spelled), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in spelled]))))


def _skipped(key: np.ndarray, start: np.ndarray, end: np.ndarray, limit: np.uint64) -> np.ndarray:
    return tb.mix(key + start.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + end.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) < limit


def _merge_heap(m: Model, ids: np.ndarray, key: np.uint64, limit: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """One unit by an agenda: ids and starts of its symbols in the end."""
    n = len(ids)
    sym, nxt, prv = ids.tolist(), [*range(1, n), n], [-1, *range(n - 1)]
    end = list(range(1, n + 1))
    agenda: list[tuple[int, int, int, int, int]] = []

    def add(i: np.ndarray, j: np.ndarray) -> None:
        a, b = np.array([sym[x] for x in i]), np.array([sym[x] for x in j])
        got = m.join(a, b)
        stop = np.array([end[x] for x in j])
        ok = (got != NONE) & ~_skipped(np.full(len(got), key), np.array(i), stop, limit)
        for k in np.flatnonzero(ok).tolist():
            heapq.heappush(agenda, (int(m.rank[got[k]]), int(i[k]), int(j[k]), int(got[k]), int(stop[k])))

    if n > 1:
        add(np.arange(n - 1), np.arange(1, n))
    alive = [True] * n
    while agenda:
        _, i, j, got, stop = heapq.heappop(agenda)
        if not (alive[i] and alive[j] and nxt[i] == j and end[j] == stop):
            continue
        sym[i], alive[j], nxt[i], end[i] = got, False, nxt[j], end[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        for a, b in ((prv[i], i), (i, nxt[i])):
            if a >= 0 and b < n:
                add(np.array([a]), np.array([b]))
    keep = np.flatnonzero(alive)
    return np.array(sym, np.int32)[keep], keep


def _merge_rounds(m: Model, ids: np.ndarray, size: np.ndarray, key: np.ndarray, limit: np.uint64, met: list | None = None) -> np.ndarray:
    """ids: (units, width), NONE beyond size; returns which symbols stay, with ids changed in place.

    met: gets the candidates that were tried, as arrays of unit, start and end.
    """
    n, width = ids.shape
    wide = width + 1
    sym = np.full((n, wide), NONE, np.int32)
    sym[:, :width] = ids
    cell = np.arange(n * wide + 1)
    start = np.minimum(np.tile(np.arange(wide), n), np.repeat(size, wide)).astype(np.int32)
    start = np.append(start, 0)
    sym = np.append(sym.ravel(), NONE)  # the last cell stands for what is before a unit
    nxt = np.minimum(cell + 1, n * wide)
    prv = cell - 1
    prv[:-1:wide] = n * wide
    rank = np.full((n, wide), FAR, np.int32)
    got = m.join(sym[:-1], sym[nxt[:-1]])
    own = np.repeat(key, wide)
    follow = start[nxt[nxt[:-1]]]
    follow[wide - 2 :: wide] = 0
    stop = np.where(nxt[nxt[:-1]] % wide == 0, start[:-1], follow)
    ok = got != NONE
    at = np.flatnonzero(ok)
    if met is not None:
        met.append((at // wide, start[at], stop[at]))
    ok[at] = ~_skipped(own[at], start[at], stop[at], limit)
    flat = rank.ravel()
    flat[ok] = m.rank[got[ok]]
    got = np.append(got, NONE)
    flat = np.append(flat, FAR)
    alive = np.ones(n * wide + 1, bool)
    rows = np.arange(n)
    while len(rows):
        table = flat[:-1].reshape(n, wide)[rows]
        j = table.argmin(1)
        going = table[np.arange(len(rows)), j] < FAR
        rows, j = rows[going], j[going]
        p = rows * wide + j
        q = nxt[p]
        o = nxt[q]
        sym[p] = got[p]
        alive[q] = False
        flat[q] = FAR
        nxt[p] = o
        prv[o] = p
        before = prv[p]
        for a, b in ((before, p), (p, o)):
            g = m.join(sym[a], sym[b])
            r = np.where(g != NONE, m.rank[np.where(g != NONE, g, 0)], FAR)
            hit = np.flatnonzero(g != NONE)
            if met is not None:
                met.append((rows[hit], start[a[hit]], start[nxt[b[hit]]]))
            drop = _skipped(key[rows[hit]], start[a[hit]], start[nxt[b[hit]]], limit)
            r[hit[drop]] = FAR
            flat[a], got[a] = r, g
        flat[-1] = FAR
    ids[:] = sym[:-1].reshape(n, wide)[:, :width]
    return alive[:-1].reshape(n, wide)[:, :width] & (np.arange(width) < size[:, None])


def encode(m: Model, data: np.ndarray, at: np.ndarray, owner: np.ndarray, *, dropout: float, seed: int, variants: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a chunk and where each text's begin. owner: a 64-bit key of each text's document.

    A text longer than a chunk goes by pieces cut before spaces, where units begin, with equal results.
    """
    if len(at) == 2 and len(data) > tb.CHUNK_BYTES:
        runs, units = [], 0
        for a, b in tb.pieces(data, _NO_SPACE):
            ids, _, n = _encode(m, data[a:b], np.array([0, b - a]), owner, dropout, seed, variants, b"" if a else b" ", units)
            runs.append(ids)
            units += n
        ids = np.concatenate(runs)
        return ids, np.array([0, len(ids)])
    return _encode(m, data, at, owner, dropout, seed, variants, b" ", 0)[:2]


def _encode(m: Model, data: np.ndarray, at: np.ndarray, owner: np.ndarray, dropout: float, seed: int, variants: int | None, before: bytes, units: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Also the number of units; before: what goes before each text; units: how many of a text came before."""
    raw = data.tobytes()
    texts = [before + raw[a:b] if b > a else b"" for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    joined = b"".join(texts)
    cps = np.frombuffer(joined.decode().encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) for t in texts])
    lead = np.concatenate(([0], np.cumsum((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80)))
    borders = np.concatenate(([0], lead[ends])).astype(np.int64) if len(ends) else np.zeros(1, np.int64)
    if not len(cps):
        return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64), 0
    space = cps == 0x20
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[borders[:-1][borders[:-1] < len(cps)]] = True
    unit = np.flatnonzero(begins)
    size = np.diff(np.append(unit, len(cps)))
    first = np.searchsorted(unit, borders)
    of = np.repeat(np.arange(len(texts)), np.diff(first))
    powers = tb._power_tables(len(cps) + 1)
    prefix = np.zeros(len(cps) + 1, np.uint64)
    np.cumsum((cps.astype(np.uint64) + np.uint64(1)) * powers[0][: len(cps)], out=prefix[1:])
    spelled = tb.mix((prefix[unit + size] - prefix[unit]) * powers[1][unit])
    limit = np.uint64(min(int(dropout * 2.0**64), 2**64 - 1))
    if limit:
        place = np.arange(len(unit)) - first[of] + units
        draw = tb.mix(owner[of] + tb.mix(np.full(1, seed, np.uint64)) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        if variants is not None:
            draw %= np.uint64(variants)
        key = tb.mix(spelled + (draw + np.uint64(1)) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))
    else:
        key = spelled
    if limit and variants is None:
        tokens, counts, which = _segment_each(m, cps, unit, size, spelled, key, limit)
    else:
        _, one, which = np.unique(key, return_index=True, return_inverse=True)
        tokens, counts = _segment(m, cps, unit[one], size[one], key[one], limit)
    token_at = np.concatenate(([0], np.cumsum(counts)))
    n = counts[which]
    total = np.concatenate(([0], np.cumsum(n)))
    ids = tokens[np.arange(total[-1]) - np.repeat(total[:-1] - token_at[which], n)]
    return ids, total[first], len(unit)


def _segment_each(m: Model, cps: np.ndarray, unit: np.ndarray, size: np.ndarray, spelled: np.ndarray, key: np.ndarray, limit: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _segment for all units with a key each; also which of the segmentations is each unit's."""
    own = size > LONG_UNIT
    short = np.flatnonzero(~own)
    _, one, of = np.unique(spelled[short], return_index=True, return_inverse=True)
    one = short[one]
    met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    tokens, counts = _segment(m, cps, unit[one], size[one], key[one], np.uint64(0), met) if len(one) else (np.empty(0, np.int32), np.empty(0, np.int64))
    if met:
        row, start, end = (np.concatenate(x) for x in zip(*met, strict=True))
        order = np.argsort(row, kind="stable")
        start, end = start[order], end[order]
        tried = np.bincount(row, minlength=len(one))
        begin = np.cumsum(tried) - tried
        # Some units at a time: long texts of one chunk have no bound.
        for k in range(0, len(short), 100_000):
            here, mine = short[k : k + 100_000], of[k : k + 100_000]
            n = tried[mine]
            at = np.arange(int(n.sum())) + np.repeat(begin[mine] - (np.cumsum(n) - n), n)
            hit = _skipped(np.repeat(key[here], n), start[at], end[at], limit)
            own[np.repeat(here, n)[hit]] = True
    which = np.zeros(len(unit), np.int64)
    which[short] = of
    others = np.flatnonzero(own)
    if len(others):
        which[others] = len(one) + np.arange(len(others))
        more, each = _segment(m, cps, unit[others], size[others], key[others], limit)
        tokens, counts = np.concatenate((tokens, more)), np.concatenate((counts, each))
    return tokens, counts, which


def _segment(m: Model, cps: np.ndarray, unit: np.ndarray, size: np.ndarray, key: np.ndarray, limit: np.uint64, met: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units, one after the other, and how many each has. met: as in _merge_rounds, of short units."""
    symbols, starts, owners = [], [], []
    widths = [4, 8, 12, 16, 24, 32, LONG_UNIT]
    for low, high in zip([0, *widths[:-1]], widths, strict=True):
        chosen = np.flatnonzero((size > low) & (size <= high))
        for k in range(0, len(chosen), 20_000):
            own = chosen[k : k + 20_000]
            column = np.arange(high)
            where = np.minimum(unit[own][:, None] + column, len(cps) - 1)
            ids = np.where(column < size[own][:, None], m.of_char[cps[where]], NONE).astype(np.int32)
            tried: list | None = None if met is None else []
            alive = _merge_rounds(m, ids, size[own], key[own], limit, tried)
            if tried:
                met.extend((own[r], a, b) for r, a, b in tried)
            r, c = np.nonzero(alive)
            symbols.append(ids[r, c])
            starts.append(unit[own][r] + c)
            owners.append(own[r])
    for u in np.flatnonzero(size > LONG_UNIT).tolist():
        ids, c = _merge_heap(m, m.of_char[cps[unit[u] : unit[u] + size[u]]], key[u], limit)
        symbols.append(ids)
        starts.append(unit[u] + c)
        owners.append(np.full(len(ids), u))
    sym, start, own = np.concatenate(symbols), np.concatenate(starts), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    sym, start, own = sym[order], start[order], own[order]
    other = np.flatnonzero(sym == OTHER)
    if len(other):
        spelled = [chr(c).encode() for c in cps[start[other]].tolist()]
        width = np.ones(len(sym), np.int64)
        width[other] = [len(x) for x in spelled]
        out = np.repeat(sym, width)
        out[out == OTHER] = m.byte_id[np.frombuffer(b"".join(spelled), np.uint8)]
        sym, own = out, np.repeat(own, width)
    return sym, np.bincount(own, minlength=len(unit))


def decode(m: Model, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The texts of token runs at[i]:at[i + 1]."""
    begins, size = m.spelled_at[ids], m.spelled_at[ids + 1] - m.spelled_at[ids]
    total = np.concatenate(([0], np.cumsum(size)))
    runs = []
    for k in range(0, len(ids), DECODED):
        here, first = slice(k, k + DECODED), total[min(k + DECODED, len(ids))] - total[k]
        runs.append(m.spelled[np.arange(first) - np.repeat(total[:-1][here] - total[k] - begins[here], size[here])].tobytes())
    out = b"".join(runs)
    edge = total[at].tolist()
    return [out[a + 1 : b] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _owner(ids: pa.Array) -> np.ndarray:
    """A key of each document's id, whatever its type."""
    w = [int.from_bytes(hashlib.blake2b(repr(x).encode(), digest_size=8).digest(), "little") for x in ids.to_pylist()]
    return np.array(w, np.uint64)


def tokenize(documents: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", dropout: float = 0.1, seed: int = 1, variants: int | None = None, prefix: str = "") -> DataFrame:
    """documents with ``token_ids`` and ``n_tokens`` (their names after ``prefix``), which replace columns so named.

    Null and empty texts have no tokens. Repeated rows get equal ids. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(load(model_path))
    names = [f"{prefix}token_ids", f"{prefix}n_tokens"]
    kept = [c for c in documents.columns if c not in names]
    slim = documents.select(*kept)
    i_at, t_at = kept.index(id_col), kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in tb.chunks(batch.column(t_at)):
                ids, edge = encode(shared.value, data, at, _owner(batch.column(i_at).slice(i, j - i)), dropout=dropout, seed=seed, variants=variants)
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in batch.columns], pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids)), pa.array(np.diff(edge))], [*kept, *names])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields)
    return slim.mapInArrow(run, f"{shape}, `{names[0]}` array<int>, `{names[1]}` long")


def detokenize(tokens: DataFrame, model_path: str, *, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """tokens with the decoded text as a further (or replaced) column; null ids have a null text."""
    shared = tokens.sparkSession.sparkContext.broadcast(load(model_path))
    kept = [c for c in tokens.columns if c != text_col]
    at = kept.index(ids_col)
    slim = tokens.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                lists = part.column(at)
                size = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
                texts = decode(shared.value, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(([0], np.cumsum(size))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([t.decode() if x.is_valid else None for t, x in zip(texts, lists, strict=True)], pa.string())], [*kept, text_col])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields)
    return slim.mapInArrow(run, f"{shape}, `{text_col}` string")


def model_path() -> str:
    """Where the installed public model is; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Per document: tokens with merge-dropout, digests of the ids and of the decoded text, and whether it is the text."""
    path = model_path()
    tokens = tokenize(read(spark, sf_dir, "documents").select("doc_id", "text"), path)
    ids = F.sha2(F.array_join("token_ids", ","), 256).alias("ids_sha256")
    back = detokenize(tokens, path)
    return back.select("doc_id", "n_tokens", ids, F.sha2("decoded", 256).alias("decoded_sha256"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("lossless"))
