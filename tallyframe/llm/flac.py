"""FLAC: a lossless media column of 8-bit samples, its checks, and PCM blocks with sample offsets.

A payload is cut into frames of BLOCK samples, coded and decoded many frames at a time on numpy arrays. The encoder
takes the cheapest of a constant, a fixed predictor of order 0 or 1, a second-order linear predictor (``linear``)
and the plain samples; residuals are Rice-coded. The decoder reads these subframes (fixed orders 0 to 4, linear
predictors of any order), finds frames by their sync code, header checksum and number, and verifies the CRC-8 and
CRC-16 of every frame and the MD5 of the stream. A seek table has a point for every SEEK frames.

Bytes become samples by a fixed map that gives frequent bytes of text small samples (an APPLICATION block names
it): text isn't a wave, and what it gains comes from that order, not from prediction.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import textbytes as tb
from tallyframe.llm.spark import new_path, read

BLOCK = 192
SEEK = 64
RUN = 2048  # frames coded or decoded at a time
PCM_SAMPLES = 4096
RATE = 8000
MAP = b"tfm1"
#: Bytes by falling frequency in text; the rest follow in their own order.
FREQUENT = b" etnhaoridsu\xc3lcm.fg,bqp\xa9vyzk"


def _crc_table(bits: int, polynomial: int) -> np.ndarray:
    out = []
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ polynomial if c >> (bits - 1) else c << 1
            c &= (1 << bits) - 1
        out.append(c)
    return np.array(out, np.uint16)


CRC8, CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)
_ORDER = np.array([*FREQUENT, *(b for b in range(256) if b not in FREQUENT)], np.uint8)
_RANKED = np.arange(256)
#: Rank r is the sample with zigzag code r: 0, -1, 1, -2, ...
TO_SAMPLE = np.empty(256, np.int8)
TO_SAMPLE[_ORDER] = np.where(_RANKED % 2, -(_RANKED + 1) // 2, _RANKED // 2)
TO_BYTE = np.empty(256, np.uint8)
TO_BYTE[TO_SAMPLE.view(np.uint8)] = np.arange(256)


def _crc(data: np.ndarray, start: np.ndarray, size: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Checksums of data[start:start + size], all runs at once."""
    crc = np.zeros(len(start), np.uint16)
    order = np.argsort(-size, kind="stable")
    at, left = start[order], size[order]
    c = np.zeros(len(start), np.uint16)
    wide = table is CRC16
    longest = int(left[0]) if len(left) else 0
    alive = np.searchsorted(-left, -np.arange(longest), "left")  # runs longer than i come first
    for i in range(longest):
        n = alive[i]
        b = data[at[:n] + i]
        c[:n] = (c[:n] << np.uint16(8)) ^ table[(c[:n] >> np.uint16(8)) ^ b] if wide else table[c[:n] ^ b]
    crc[order] = c
    return crc


def _number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the extended UTF-8 coding: (bytes, sizes)."""
    size = np.select([n < 1 << 7, n < 1 << 11, n < 1 << 16, n < 1 << 21, n < 1 << 26], [1, 2, 3, 4, 5], 6)
    out = np.zeros((len(n), 6), np.uint8)
    for s in np.unique(size).tolist():
        k = size == s
        for j in range(s):
            part = n[k] >> (6 * (s - 1 - j))
            out[k, j] = part if s == 1 else (part & ((1 << (7 - s)) - 1) | (0xFF00 >> s & 0xFF)) if j == 0 else part & 0x3F | 0x80
    return out, size


def _second_order(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Least-squares coefficients of order 2 for each frame, as 8-bit integers with the shift."""
    a, b, c = x[:, 1:-1].astype(float), x[:, :-2].astype(float), x[:, 2:].astype(float)
    aa, bb, ab, ac, bc = (a * a).sum(1), (b * b).sum(1), (a * b).sum(1), (a * c).sum(1), (b * c).sum(1)
    det = aa * bb - ab * ab
    safe = np.where(np.abs(det) > 1e-6, det, 1)
    f = np.stack([np.where(np.abs(det) > 1e-6, (ac * bb - bc * ab) / safe, 0), np.where(np.abs(det) > 1e-6, (bc * aa - ac * ab) / safe, 0)], 1)
    return np.clip(np.rint(f * 64), -128, 127).astype(np.int64), 6


def encode_frames(samples: np.ndarray, numbers: np.ndarray, linear: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """samples: (frames, BLOCK) int8. All frames' bytes, and where each begins."""
    x = samples.astype(np.int16)
    f = len(x)
    one = np.zeros_like(x)
    one[:, 1:] = x[:, 1:] - x[:, :-1]
    options = [(0, x, 8), (1, one, 9)]
    if linear:
        coefficients, shift = _second_order(x)
        two = np.zeros_like(x)
        two[:, 2:] = x[:, 2:] - ((coefficients[:, :1] * x[:, 1:-1] + coefficients[:, 1:] * x[:, :-2]) >> shift)
        options.append((2, two, 32))
    cost, rice, codes = [], [], []
    for warm, r, _ in options:
        z = ((r << 1) ^ (r >> 15)).astype(np.uint16)
        z[:, :warm] = 0
        n = BLOCK - warm
        bits = np.stack([(z >> k).sum(1, dtype=np.int64) + n * (k + 1) for k in range(8)], 1)
        k = bits.argmin(1)
        extra = 8 * warm + 10 + (4 + 5 + 16 if warm == 2 else 0)
        cost.append(bits[np.arange(f), k] + extra)
        rice.append(k)
        codes.append(z)
    cost.append(np.full(f, 8 * BLOCK))  # verbatim
    cost.append(np.where((x == x[:, :1]).all(1), 8, 1 << 30))  # constant
    best = np.stack(cost, 1).argmin(1)
    body = np.stack(cost, 1)[np.arange(f), best]
    verbatim, constant = len(options), len(options) + 1
    coded, size = _number(numbers)
    head = 4 + size + 1
    length = head + 1 + (body + 7) // 8 + 2
    at = np.concatenate(([0], np.cumsum(length)))
    bits = np.zeros(int(at[-1]) * 8, np.uint8)
    base = (at[:-1] + head + 1) * 8  # after the subframe's header

    def put(where: np.ndarray, value: np.ndarray, width: int) -> None:
        for b in range(width):
            bits[where + b] = (value >> (width - 1 - b)) & 1

    for o, (warm, _, _) in enumerate(options):
        k = np.flatnonzero(best == o)
        if not len(k):
            continue
        put((at[:-1] + head)[k] * 8, np.full(len(k), (0b001000 | warm if warm < 2 else 0b100001) << 1), 8)
        for j in range(warm):
            put(base[k] + 8 * j, x[k, j].astype(np.int64) & 0xFF, 8)
        cursor = base[k] + 8 * warm
        if warm == 2:
            put(cursor, np.full(len(k), 7), 4)
            put(cursor + 4, np.full(len(k), shift), 5)
            for j in range(2):
                put(cursor + 9 + 8 * j, coefficients[k, j] & 0xFF, 8)
            cursor = cursor + 25
        put(cursor, np.zeros(len(k), np.int64), 6)
        put(cursor + 6, rice[o][k], 4)
        cursor = cursor + 10
        z, p = codes[o][k][:, warm:].astype(np.int64), rice[o][k][:, None]
        width = (z >> p) + 1 + p
        stop = cursor[:, None] + np.cumsum(width, 1) - 1 - p
        bits[stop] = 1
        for b in range(int(p.max())):
            rows = np.flatnonzero(p[:, 0] > b)
            bits[stop[rows] + 1 + b] = (z[rows] >> (p[rows] - 1 - b)) & 1
    out = np.packbits(bits)
    k = np.flatnonzero(best == verbatim)
    out[(at[:-1] + head)[k]] = 0b000001 << 1
    out[((at[:-1] + head + 1)[k][:, None] + np.arange(BLOCK))] = samples[k].view(np.uint8)
    k = np.flatnonzero(best == constant)
    out[(at[:-1] + head + 1)[k]] = samples[k, 0].view(np.uint8)
    for j, b in enumerate((0xFF, 0xF8, 0x10, 0x02)):
        out[at[:-1] + j] = b
    for j in range(6):
        k = np.flatnonzero(size > j)
        out[at[:-1][k] + 4 + j] = coded[k, j]
    out[at[:-1] + head - 1] = _crc(out, at[:-1], head - 1, CRC8)
    check = _crc(out, at[:-1], length - 2, CRC16)
    out[at[1:] - 2], out[at[1:] - 1] = check >> 8, check & 0xFF
    return out, at


def stream_header(samples: np.ndarray, frame_at: np.ndarray) -> bytes:
    """Everything before the frames. frame_at: where each frame begins, and the end."""
    n = len(samples)
    size = np.diff(frame_at)
    packed = RATE << 44 | 0 << 41 | 7 << 36 | n
    info = struct.pack(">HH", BLOCK, BLOCK) + int(size.min()).to_bytes(3, "big") + int(size.max()).to_bytes(3, "big") + packed.to_bytes(8, "big") + hashlib.md5(samples.tobytes()).digest()
    points = b"".join(struct.pack(">QQH", BLOCK * i, int(frame_at[i]), BLOCK) for i in range(0, len(size), SEEK))
    blocks = [(0, info), (2, MAP), (3, points)]
    return b"fLaC" + b"".join(bytes([k | 0x80 * (i == len(blocks) - 1)]) + len(b).to_bytes(3, "big") + b for i, (k, b) in enumerate(blocks))


def encode(payloads: list[bytes], linear: bool = False) -> list[bytes]:
    """FLAC streams of payloads whose sizes are positive multiples of BLOCK."""
    data = np.frombuffer(b"".join(payloads), np.uint8)
    frames = np.array([len(p) // BLOCK for p in payloads])
    first = np.concatenate(([0], np.cumsum(frames)))
    samples = TO_SAMPLE[data]
    number = np.arange(first[-1]) - np.repeat(first[:-1], frames)
    parts, at = [], np.zeros(1, np.int64)
    for k in range(0, len(number), RUN):  # long payloads have no bound
        out, own = encode_frames(samples.reshape(-1, BLOCK)[k : k + RUN], number[k : k + RUN], linear)
        parts.append(out.tobytes())
        at = np.concatenate((at, at[-1] + own[1:]))
    raw = b"".join(parts)
    return [stream_header(samples[a * BLOCK : b * BLOCK], at[a : b + 1] - at[a]) + raw[at[a] : at[b]] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _metadata(stream: bytes) -> tuple[int, int, bytes, bytes, np.ndarray]:
    """(where frames begin, samples, MD5, the name of the sample map, seek points)."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, samples, digest, name, points, last = 4, 0, b"", b"", np.empty((0, 3), np.int64), False
    while not last:
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        block = stream[at + 4 : at + 4 + size]
        if kind == 0:
            samples, digest = int.from_bytes(block[10:18], "big") & ((1 << 36) - 1), block[18:34]
        elif kind == 2:
            name = block[:4]
        elif kind == 3:
            points = np.array([struct.unpack(">QQH", block[i : i + 18]) for i in range(0, size, 18)], np.int64)
        at += 4 + size
    return at, samples, digest, name, points


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """The samples of each stream. Raises ValueError where a checksum, number or digest is wrong."""
    meta = [_metadata(s) for s in streams]
    body = np.frombuffer(b"".join(s[m[0] :] for s, m in zip(streams, meta, strict=True)) + bytes(16), np.uint8)
    edge = np.concatenate(([0], np.cumsum([len(s) - m[0] for s, m in zip(streams, meta, strict=True)])))
    wanted = np.array([-(-m[1] // BLOCK) for m in meta])
    if any(m[1] % BLOCK for m in meta):
        raise ValueError("a stream's last block is short")
    start, number, head = _frames(body, edge, wanted)
    end = np.append(start[1:], edge[-1])
    first = np.concatenate(([0], np.cumsum(wanted)))
    stored = body[end - 2].astype(np.uint16) << np.uint16(8) | body[end - 1]
    if len(start) and ((_crc(body, start, end - start - 2, CRC16) != stored).any() or (number != np.arange(first[-1]) - np.repeat(first[:-1], wanted)).any()):
        raise ValueError("a frame's checksum or number is wrong")
    runs = []
    for k in range(0, len(start), RUN):
        a, b = int(start[k]), int(end[min(k + RUN, len(start)) - 1])
        runs.append(_subframes(body[a : b + 16], (start + head)[k : k + RUN] - a))
    x = np.concatenate(runs) if runs else np.empty((0, BLOCK), np.int8)
    out = [x[a:b].reshape(-1) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    for s, m in zip(out, meta, strict=True):
        if hashlib.md5(s.tobytes()).digest() != m[2]:
            raise ValueError("a stream's digest is wrong")
    return out


def _frames(body: np.ndarray, edge: np.ndarray, wanted: np.ndarray, begin_at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, numbers and header sizes of the frames of all streams, which begin with frame 0 or with ``begin_at``."""
    at = np.flatnonzero((body[:-16] == 0xFF) & (body[1:-15] == 0xF8) & (body[2:-14] == 0x10) & (body[3:-13] == 0x02))
    lead = body[at + 4]
    size = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC], [1, 2, 3, 4, 5], 6)
    number = np.where(size == 1, lead, lead & (0x7F >> size)).astype(np.int64)
    for j in range(1, 6):
        k = size > j
        number[k] = number[k] << 6 | body[at[k] + 4 + j] & 0x3F
    good = _crc(body, at, 4 + size, CRC8) == body[at + 4 + size]
    at, size, number = at[good], size[good], number[good]
    of = np.searchsorted(edge, at, "right") - 1
    count = np.bincount(of, minlength=len(wanted)) if len(at) else np.zeros(len(wanted), int)
    if (count != wanted).any():  # a frame's own bytes look like a header: take those that end a whole frame
        keep = np.ones(len(at), bool)
        for d in np.flatnonzero(count != wanted).tolist():
            own = np.flatnonzero(of == d)
            keep[own] = False
            base = 0 if begin_at is None else int(begin_at[d])
            nth, begin = base, None
            for k in own.tolist():
                whole = begin is None or _crc(body, np.array([begin]), np.array([at[k] - begin]), CRC16)[0] == 0
                if number[k] == nth and whole:
                    keep[k], nth, begin = True, nth + 1, at[k]
            if nth - base != wanted[d]:
                raise ValueError("a stream has missing frames")
        at, size, number = at[keep], size[keep], number[keep]
    return at, number, 4 + size + 1


def _subframes(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The samples of the subframes at the given bytes."""
    n = len(at)
    out = np.zeros((n, BLOCK), np.int64)
    kind = body[at] >> 1
    k = np.flatnonzero(kind == 0)
    out[k] = body[at[k] + 1].view(np.int8)[:, None]
    k = np.flatnonzero(kind == 1)
    out[k] = body[(at[k] + 1)[:, None] + np.arange(BLOCK)].view(np.int8)
    coded = np.flatnonzero(kind > 1)
    if ((kind[coded] < 8) | (kind[coded] > 12) & (kind[coded] < 32)).any():
        raise ValueError("a subframe of a reserved kind")
    if not len(coded):
        return out.astype(np.int8)
    bits = np.unpackbits(body)
    ones = np.flatnonzero(bits)
    following = np.full(len(bits) + 1, len(bits), np.int64)
    following[ones] = ones
    following = np.minimum.accumulate(following[::-1])[::-1]
    window = np.zeros(len(body), np.uint32)
    for j in range(4):
        window[: len(body) - j] |= body[j:].astype(np.uint32) << np.uint32(24 - 8 * j)

    def take(where: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        return (window[where >> 3].astype(np.int64) >> (32 - (where & 7) - width)) & ((1 << np.asarray(width)) - 1)

    order = np.where(kind[coded] < 32, kind[coded] - 8, (kind[coded] & 31) + 1).astype(np.int64)
    cursor = (at[coded] + 1) * 8
    for j in range(int(order.max())):
        k = np.flatnonzero(order > j)
        out[coded[k], j] = take(cursor[k] + 8 * j, 8).astype(np.uint8).view(np.int8)
    cursor = cursor + 8 * order
    linear = np.flatnonzero(kind[coded] >= 32)
    weights = np.zeros((len(linear), 32), np.int64)
    if len(linear):
        precision, shift = take(cursor[linear], 4) + 1, take(cursor[linear] + 4, 5)
        cursor[linear] += 9
        for j in range(int(order[linear].max())):
            k = np.flatnonzero(order[linear] > j)
            w = take(cursor[linear[k]], precision[k])
            weights[k, j] = w - ((w >> (precision[k] - 1)) << precision[k])
            cursor[linear[k]] += precision[k]
    if take(cursor, 6).any():
        raise ValueError("residuals in several partitions aren't written here")
    rice = take(cursor + 6, 4)
    cursor = cursor + 10
    stop = np.zeros((len(coded), BLOCK), np.int64)
    quotient = np.zeros((len(coded), BLOCK), np.int64)
    steps = [np.flatnonzero(order <= i) if i < order.max() else slice(None) for i in range(BLOCK)]
    for i in range(BLOCK):
        k = steps[i]
        s = following[cursor[k]]
        quotient[k, i] = s - cursor[k]
        stop[k, i] = s
        cursor[k] = s + 1 + rice[k]
    z = quotient << rice[:, None] | take(np.minimum(stop + 1, (len(body) - 1) * 8), rice[:, None])
    r = (z >> 1) ^ -(z & 1)
    live = np.arange(BLOCK) >= order[:, None]
    x = np.where(live, r, out[coded])
    for o in range(1, 5):
        k = np.flatnonzero((kind[coded] == 8 + o))
        if len(k):
            x[k] = _integrate(x[k], o)
    for i in range(BLOCK) if len(linear) else ():
        k = np.flatnonzero(order[linear] <= i)
        past = np.stack([x[linear[k], max(i - 1 - j, 0)] for j in range(int(order[linear].max()))], 1)
        x[linear[k], i] += (past * weights[k, : past.shape[1]]).sum(1) >> shift[k]
    out[coded] = x
    return out.astype(np.int8)


def _integrate(x: np.ndarray, order: int) -> np.ndarray:
    """Samples from warm-up samples and residuals of a fixed predictor: the difference of that order, undone."""
    warm = x[:, :order].copy()
    for o in range(order, 0, -1):
        x = x.copy()
        x[:, o - 1] = np.diff(warm, n=o - 1, axis=1)[:, 0]
        x[:, o - 1 :] = np.cumsum(x[:, o - 1 :], axis=1)
    x[:, :order] = warm
    return x


def padded(data: bytes) -> bytes:
    n = max(1, -(-len(data) // BLOCK)) * BLOCK
    return data + b" " * (n - len(data))


def store(rows: DataFrame, path: str, *, id_col: str = "doc_id", data_col: str = "text", linear: bool = False) -> DataFrame:
    """Writes (id, n_bytes, media) of every row as Parquet and returns it read again. Null data count as empty."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in tb.chunks(batch.column(1), 1 << 19):
                raw = data.tobytes()
                own = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array(encode([padded(x) for x in own], linear), pa.binary())], ["id", "n_bytes", "media"])

    rows.select(F.col(id_col).alias("id"), F.col(data_col).alias("data")).mapInArrow(run, f"id {kind}, n_bytes long, media binary").write.parquet(path)
    return rows.sparkSession.read.parquet(path).withColumnRenamed("id", id_col)


def read_samples(stream: bytes, first: int, count: int) -> np.ndarray:
    """The samples from ``first`` on, decoded from the seek point before them; the frames read are verified."""
    begin, total, _, _, points = _metadata(stream)
    count = max(0, min(count, total - first))
    if not count:
        return np.empty(0, np.int8)
    of = np.searchsorted(points[:, 0], [first, first + count - 1], "right") - 1
    stop = points[of[1] + 1, 1] if of[1] + 1 < len(points) else len(stream) - begin
    body = np.frombuffer(stream[begin + points[of[0], 1] : begin + stop] + bytes(16), np.uint8)
    edge = np.array([0, len(body) - 16])
    wanted = -(-(min(total, int(points[of[1] + 1, 0]) if of[1] + 1 < len(points) else total) - int(points[of[0], 0])) // BLOCK)
    start, number, head = _frames(body, edge, np.array([wanted]), np.array([points[of[0], 0] // BLOCK]))
    end = np.append(start[1:], edge[1])
    if _crc(body, start, end - start, CRC16).any():
        raise ValueError("a frame's checksum is wrong")
    skip = first - int(points[of[0], 0])
    return _subframes(body, start + head).reshape(-1)[skip : skip + count]


def blocks(x: np.ndarray, size: int = PCM_SAMPLES) -> Iterator[tuple[int, np.ndarray]]:
    """PCM blocks of a stream's samples with their sample offsets."""
    for o in range(0, len(x), size):
        yield o, x[o : o + size]


def _decoded(column: pa.Array) -> Iterator[tuple[int, int, list[bytes], list[np.ndarray]]]:
    for i, j, data, at in tb.chunks(column, 1 << 19):
        raw = data.tobytes()
        streams = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield i, j, streams, decode(streams)


def pcm_blocks(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media", block_samples: int = PCM_SAMPLES) -> DataFrame:
    """(id, sample_offset, samples, pcm) of verified blocks of at most block_samples samples; pcm is one signed byte per sample.

    Null media have no blocks; repeated rows have theirs each. An empty table gives none; a damaged stream is an error.
    """
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            for i, j, _, found in _decoded(batch.column(1)):
                rows = [(k, o, x.tobytes()) for k, y in zip(range(i, j), found, strict=True) for o, x in blocks(y, block_samples)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int64()), pa.array([len(r[2]) for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["id", "sample_offset", "samples", "pcm"])

    return media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, f"id {kind}, sample_offset long, samples long, pcm binary").withColumnRenamed("id", id_col)


def _feature(pcm: list[tuple[int, np.ndarray]]) -> str:
    """Peak, energy and changes of sign of the samples, and the sample offset of the loudest PCM block (the first of equals)."""
    peak, energy, crossings, last, loudest = 0, 0, 0, None, (-1, 0)
    for offset, x in pcm:
        v = x.astype(np.int64)
        own = int((v * v).sum())
        peak, energy = max(peak, int(np.abs(v).max())), energy + own
        crossings += int(((v[1:] < 0) != (v[:-1] < 0)).sum()) + int(last is not None and (last < 0) != (v[0] < 0))
        last, loudest = v[-1], (own, offset) if own > loudest[0] else loudest
    return f"peak={peak};energy={energy};crossings={crossings};loudest={loudest[1]}"


def features(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, pcm_blocks), all from the stored bytes.

    The streams are verified, decoded and cut into PCM blocks, and everything is computed from those. Null media have
    nulls; repeated rows have a row each. An empty table gives none; a damaged stream is an error.
    """
    kind = media.schema[id_col].dataType.simpleString()
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_blocks"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            none = batch.filter(batch.column(2).is_null())
            if none.num_rows:
                yield pa.RecordBatch.from_arrays([none.column(0), none.column(1), *[pa.nulls(none.num_rows, k) for k in kinds]], names)
            batch = batch.filter(batch.column(2).is_valid())
            for i, j, streams, found in _decoded(batch.column(2)):
                columns: list[list] = [[] for _ in kinds]
                for s, x in zip(streams, found, strict=True):
                    pcm = list(blocks(x))
                    digest, tail = hashlib.sha256(), b""
                    for _, y in pcm:
                        data = TO_BYTE[y.view(np.uint8)].tobytes()
                        digest.update(data)
                        tail = (tail + data[-16:])[-16:]
                    row = (pcm[-1][0] + len(pcm[-1][1]), digest.hexdigest(), zlib.crc32(tail), len(s), hashlib.sha256(s).hexdigest(), _feature(pcm), len(pcm))
                    for c, v in zip(columns, row, strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    shape = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_blocks long"
    return media.select(F.col(id_col).alias("id"), "n_bytes", F.col(media_col).alias("media")).mapInArrow(run, shape).withColumnRenamed("id", id_col)


def op8_flac(spark, sf_dir: str) -> DataFrame:
    return features(store(read(spark, sf_dir, "documents"), new_path(spark, "flac"), linear=True))
