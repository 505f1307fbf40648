"""Aligning two tokenizers over a corpus: which ids of one stand where ids of the other stand, and in how many documents.

Both tokenizations spell the same bytes. Where tokens of both end they cut the text into groups; every pair of ids in a
group is a link. A link is one integer, the first id above the second. Tasks count the documents of their pairs with
``np.unique``; the partial counts are sorted by range over the whole cluster, equal keys are added up, and each range
becomes a shard of two sorted arrays in the shared folder. Lookups map the shards into memory and search them.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import textbytes as tb
from tallyframe.llm.spark import new_path, read, written

#: Fixed value: how byte-level BPE files of this kind split a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of such a length overflows the stack of one splitter; the other library splits those texts.
LONG_SPACE = re.compile(r"\s{1000}")
#: Longer texts (in characters) are encoded by pieces cut before a space between two words, with equal ids.
PIECE_CHARS = 1 << 18
#: Groups of more links are counted by their distinct ids.
DENSE_LINKS = 1024
#: Pairs that are expanded, or distinct keys that a task holds, at a time.
BLOCK_PAIRS = 1 << 20
HELD_KEYS = 1 << 21


def byte_alphabet() -> dict[str, int]:
    """Characters of byte-level vocabularies and their bytes: visible Latin-1 ones stand for themselves, the others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Pair:
    """The two tokenizers as read from their files: small enough to be sent to every worker."""

    json_text: str
    model: bytes

    @functools.cached_property
    def a_bytes(self) -> list[bytes]:
        spec = json.loads(self.json_text)
        alphabet = byte_alphabet()
        out = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items() if all(c in alphabet for c in t)}
        # Added tokens are never made from text; their ids have no bytes.
        return [out.get(i, b"") for i in range(max(out) + 1)]

    @functools.cached_property
    def _ranked(self):
        """A faster encoder of the same vocabulary, if the merges are ranked by the ids that they make."""
        import tiktoken

        spec = json.loads(self.json_text)
        vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        if any(vocab["".join(m)] != 256 + k for k, m in enumerate(merges)):
            return None
        ranks = {b: i for i, b in enumerate(self.a_bytes[: 256 + len(merges)])}
        return tiktoken.Encoding(f"own-{hashlib.sha256(self.json_text.encode()).hexdigest()[:8]}", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def _plain(self):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        out = Tokenizer.from_str(self.json_text)
        out.encode_special_tokens = True
        return out

    @functools.cached_property
    def _pieces(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.model)

    @functools.cached_property
    def b_bytes(self) -> list[bytes]:
        sp = self._pieces
        return [bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]

    @functools.cached_property
    def cuttable(self) -> bool:
        """Whether no piece goes on after a space that follows a word."""
        return not any(" " in b.lstrip(b" ").decode("utf-8", "replace") for b in self.b_bytes)

    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array([len(b) for b in self.a_bytes], np.int64), np.array([len(b) for b in self.b_bytes], np.int64)

    @property
    def shift(self) -> int:
        """Bits of an id of B in a packed pair."""
        return max(1, (len(self.b_bytes) - 1).bit_length())

    def __getstate__(self):
        return {"json_text": self.json_text, "model": self.model}

    def encode_a(self, text: str) -> list[int]:
        if self._ranked is None or LONG_SPACE.search(text):
            return self._plain.encode(text, add_special_tokens=False).ids
        return self._ranked.encode_ordinary(text)

    def encode_b(self, text: str) -> list[int]:
        return self._pieces.encode(text, num_threads=1)

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both; none if the text is null or empty or if the bytes of one aren't those of a space and the text."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        if not text:
            return none
        a, b = [], []
        for k, piece in enumerate(self.cut(text)):
            # All but the first begin with the space that B adds by itself.
            a.append(np.array(self.encode_a(piece if k else " " + piece), np.int64))
            b.append(np.array(self.encode_b(piece[1:] if k else piece), np.int64))
        a, b = np.concatenate(a), np.concatenate(b)
        data = b" " + text.encode()
        if any(b"".join(map(table.__getitem__, ids.tolist())) != data for table, ids in ((self.a_bytes, a), (self.b_bytes, b))):
            return none
        return a, b

    def cut(self, text: str) -> list[str]:
        if len(text) <= PIECE_CHARS or not self.cuttable:
            return [text]
        out, at = [], 0
        between = re.compile(r"(?<=\S) (?=\S)")
        while len(text) - at > PIECE_CHARS:
            found = between.search(text, at + PIECE_CHARS)
            if not found:
                break
            out.append(text[at : found.start()])
            at = found.start()
        return [*out, text[at:]]


def tokenizers(json_path: str, model_path: str) -> Pair:
    """A byte-level BPE of a JSON file and a SentencePiece model with byte fallback."""
    with open(json_path, encoding="utf-8") as f, open(model_path, "rb") as g:
        return Pair(f.read(), g.read())


_ready: dict[str, Pair] = {}


def _here(pair: Pair) -> Pair:
    """One copy for each worker, with its encoders built once."""
    name = hashlib.sha256(pair.json_text.encode() + pair.model).hexdigest()
    return _ready.setdefault(name, pair)


def _width(n: int) -> str:
    return "<u2" if n <= 1 << 16 else "<u4"


def encode_pair(documents: DataFrame, pair: Pair, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, a, b): the ids of both tokenizers as little-endian integers of 2 bytes, or 4 for vocabularies over 65,536.

    Null and empty texts, and those whose bytes a tokenizer doesn't keep, have none. Repeated rows have rows each; an
    empty table gives an empty result; other columns aren't read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(pair)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _here(shared.value)
        wide = _width(len(p.a_bytes)), _width(len(p.b_bytes))
        for batch in batches:
            for i, j, _, _ in tb.chunks(batch.column(1)):
                both = [p.encode(t) for t in batch.column(1).slice(i, j - i).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *[pa.array([x[k].astype(wide[k]).tobytes() for x in both], pa.binary()) for k in (0, 1)]], ["id", "a", "b"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, a binary, b binary")


@dataclass
class Groups:
    """Tokens of some documents, one after the other, and their groups. first: of each group, and the end of the last."""

    a: np.ndarray
    b: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    a_first: np.ndarray
    b_first: np.ndarray
    document: np.ndarray  # of each group

    @property
    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        return np.diff(self.a_first), np.diff(self.b_first)

    def links(self, shift: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | int]]:
        """(documents, packed pairs, how often each is meant), in blocks; all links are in one of them."""
        n_a, n_b = self.sizes
        dense = n_a * n_b > DENSE_LINKS
        each = np.where(dense, 0, n_b)[self.a_group]
        upto = np.cumsum(each)
        at = 0
        while at < len(each):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK_PAIRS, "right")))
            n = each[at:end]
            group = np.repeat(self.a_group[at:end], n)
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            yield self.document[group], (np.repeat(self.a[at:end], n) << shift) | self.b[self.b_first[group] + inside], 1
            at = end
        for g in np.flatnonzero(dense).tolist():
            a, times_a = np.unique(self.a[self.a_first[g] : self.a_first[g + 1]], return_counts=True)
            b, times_b = np.unique(self.b[self.b_first[g] : self.b_first[g + 1]], return_counts=True)
            step = max(1, BLOCK_PAIRS // len(b))
            for k in range(0, len(a), step):
                keys = ((a[k : k + step] << shift)[:, None] | b[None, :]).ravel()
                yield np.full(len(keys), self.document[g]), keys, (times_a[k : k + step][:, None] * times_b[None, :]).ravel()

    def texts(self, spelled: list[bytes], n_a_ids: int, n_b_ids: int, documents: int) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` for each document. spelled: ids of A with a comma, with a bar, ids of B with a comma, with a semicolon."""
        last_a, last_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        last_a[self.a_first[1:] - 1] = last_b[self.b_first[1:] - 1] = True
        order = np.empty(len(self.a) + len(self.b), np.int64)
        order[np.arange(len(self.a)) + self.b_first[self.a_group]] = self.a + np.where(last_a, n_a_ids, 0)
        order[np.arange(len(self.b)) + self.a_first[self.b_group + 1]] = self.b + 2 * n_a_ids + np.where(last_b, n_b_ids, 0)
        groups = np.searchsorted(self.document, np.arange(documents + 1))
        edge = (self.a_first + self.b_first)[groups].tolist()
        names = list(map(spelled.__getitem__, order.tolist()))
        return [b"".join(names[i:j])[:-1] for i, j in zip(edge[:-1], edge[1:], strict=True)]


def group(a_ids: np.ndarray, b_ids: np.ndarray, a_at: np.ndarray, a_length: np.ndarray, b_length: np.ndarray) -> Groups:
    """a_at: where the documents' ids begin in a_ids, and the end of the last. Both spell the same bytes of each document."""
    a_end, b_end = np.cumsum(a_length[a_ids]), np.cumsum(b_length[b_ids])
    common = np.intersect1d(a_end, b_end, assume_unique=False)
    a_group, b_group = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
    edges = np.concatenate(([0], a_end))[a_at]
    document = np.searchsorted(edges, common, "left") - 1
    count = lambda g: np.concatenate(([0], np.cumsum(np.bincount(g, minlength=len(common))))).astype(np.int64)
    return Groups(a_ids, b_ids, a_group, b_group, count(a_group), count(b_group), document)


def _batches(batch: pa.RecordBatch, pair: Pair) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, ids of A and B, where the rows' ids begin in each) of runs of rows."""
    wide = _width(len(pair.a_bytes)), _width(len(pair.b_bytes))
    for i, j, data, at in tb.chunks(batch.column(1)):
        other, b_at = tb.raw(batch.column(2).slice(i, j - i))
        yield i, j, data.view(wide[0]).astype(np.int64), other.view(wide[1]).astype(np.int64), at // int(wide[0][2]), b_at // int(wide[1][2])


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


@dataclass
class Shards:
    """Where the sorted counts are. first: smallest key of each; best: by id of A, its pairs' highest count."""

    paths: list[str]
    first: np.ndarray
    best: np.ndarray

    def __post_init__(self):
        self._open: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def __getstate__(self):
        return {"paths": self.paths, "first": self.first, "best": self.best, "_open": {}}

    def _mapped(self, path: str) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts of a shard. A file that isn't in a local or mounted folder is first copied, and leaves no trace."""
        if path not in self._open:
            url = urlparse(path)
            if url.scheme in ("", "file"):
                data = np.memmap(unquote(url.path), "<i8", "r")
            else:
                fs, name = pyarrow.fs.FileSystem.from_uri(path)
                with tempfile.TemporaryFile() as copy, fs.open_input_stream(name) as source:
                    while block := source.read(1 << 22):
                        copy.write(block)
                    copy.flush()
                    data = np.memmap(copy, "<i8", "r")
            half = len(data) // 2
            self._open[path] = data[:half], data[half:]
        return self._open[path]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Of distinct keys in order; all are in a shard."""
        out = np.empty(len(keys), np.int64)
        edge = np.searchsorted(keys, self.first).tolist() + [len(keys)]
        for path, i, j in zip(self.paths, edge[:-1], edge[1:], strict=True):
            if i < j:
                known, counts = self._mapped(path)
                at = np.searchsorted(known, keys[i:j])
                out[i:j] = counts[at]
        return out


def count_pairs(tokens: DataFrame, pair: Pair, *, held_keys: int = HELD_KEYS) -> Shards:
    """Counts of documents by pair, from rows of encode_pair, as shards in the shared folder.

    Every row counts as a document. held_keys bounds what a task holds before it hands partial counts on.
    """
    spark = tokens.sparkSession
    shared = spark.sparkContext.broadcast(pair)
    folder = new_path(spark, "pair-shards")
    shift = pair.shift
    bits = shift + max(1, (len(pair.a_bytes) - 1).bit_length())

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _here(shared.value)
        lengths = p.lengths()
        keys, counts, held = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            k, n = _added(np.concatenate(keys), np.concatenate(counts))
            for at in range(0, len(k), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(k[at : at + (1 << 16)]), pa.array(n[at : at + (1 << 16)])], ["key", "n"])

        for batch in batches:
            for _, _, a, b, a_at, _ in _batches(batch, p):
                met = np.empty(0, np.int64)  # document and pair, once each
                for document, key, _ in group(a, b, a_at, *lengths).links(shift):
                    met = np.unique(np.concatenate((met, (document.astype(np.int64) << bits) | key)))
                k, n = np.unique(met & ((1 << bits) - 1), return_counts=True)
                keys.append(k)
                counts.append(n.astype(np.int64))
                held += len(k)
                if held > 2 * held_keys:
                    k, n = _added(np.concatenate(keys), np.concatenate(counts))
                    keys, counts, held = [k], [n], len(k)
                    if held > held_keys:
                        yield from out()
                        keys, counts, held = [], [], 0
        if held:
            yield from out()

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key, and all of a key in one task."""
        fs, below = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(below, recursive=True)
        name = f"{uuid.uuid4().hex}.i8"
        best = np.zeros(len(_here(shared.value).a_bytes), np.int64)
        n, first, tail_key, tail_n = 0, None, None, 0
        with tempfile.TemporaryFile() as sums, fs.open_output_stream(f"{below}/{name}", compression=None) as out:

            def put(keys: np.ndarray, counts: np.ndarray) -> None:
                nonlocal n, first
                if len(keys):
                    out.write(keys.astype("<i8").tobytes())
                    sums.write(counts.astype("<i8").tobytes())
                    np.maximum.at(best, keys >> shift, counts)
                    n, first = n + len(keys), int(keys[0]) if first is None else first

            for batch in batches:
                if not batch.num_rows:
                    continue
                keys, counts = _added(batch.column(0).to_numpy(), batch.column(1).to_numpy())
                if tail_key == keys[0]:
                    counts[0] += tail_n
                elif tail_key is not None:
                    put(np.array([tail_key]), np.array([tail_n]))
                put(keys[:-1], counts[:-1])
                tail_key, tail_n = int(keys[-1]), int(counts[-1])
            if tail_key is not None:
                put(np.array([tail_key]), np.array([tail_n]))
            sums.seek(0)
            while block := sums.read(1 << 22):
                out.write(block)
        if n:
            ids = np.flatnonzero(best)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([first]), pa.array([n]), pa.array([ids.astype("<i8").tobytes()]), pa.array([best[ids].astype("<i8").tobytes()])], ["path", "first", "n", "ids", "best"])
        else:
            fs.delete_file(f"{below}/{name}")

    # Written, because ranges are found by a scan of their own.
    parts = written(tokens.select("id", "a", "b").mapInArrow(partial, "key long, n long"), "pair-counts")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = written(parts.repartitionByRange(ranges, "key").sortWithinPartitions("key").mapInArrow(shard, "path string, first long, n long, ids binary, best binary"), "pair-index")
    # A row for each range; their ids of A overlap at the borders only, so that they are as many as the vocabulary has.
    rows = shards.orderBy("first").collect()
    best = np.zeros(len(pair.a_bytes), np.int64)
    for r in rows:
        np.maximum.at(best, np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["best"], "<i8"))
    return Shards([r["path"] for r in rows], np.array([r["first"] for r in rows], np.int64), best)


def pair_table(spark: SparkSession, shards: Shards, pair: Pair) -> DataFrame:
    """(a, b, n): all pairs with the number of documents that hold them."""
    shift = pair.shift
    paths = spark.createDataFrame([(p,) for p in shards.paths], "path string").repartition(max(1, len(shards.paths)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                keys, counts = Shards([path], np.zeros(1, np.int64), np.zeros(0, np.int64))._mapped(path)
                for i in range(0, len(keys), 1 << 16):
                    k = keys[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(k >> shift), pa.array(k & ((1 << shift) - 1)), pa.array(np.array(counts[i : i + (1 << 16)]))], ["a", "b", "n"])

    return paths.mapInArrow(run, "a long, b long, n long")


_ALIGNED = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(tokens: DataFrame, shards: Shards, pair: Pair) -> DataFrame:
    """Rows of encode_pair as (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), by the counts of shards.

    The shards must be of a corpus that holds these documents. Without tokens all are 0 and the digest is "".
    """
    spark = tokens.sparkSession
    both = spark.sparkContext.broadcast((pair, shards))
    shift = pair.shift

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, counted = both.value
        p = _here(p)
        lengths = p.lengths()
        n_a_ids, n_b_ids = len(p.a_bytes), len(p.b_bytes)
        spelled = [b"%d%s" % (i, end) for n, ends in ((n_a_ids, (b",", b"|")), (n_b_ids, (b",", b";"))) for end in ends for i in range(n)]
        for batch in batches:
            for i, j, a, b, a_at, b_at in _batches(batch, p):
                n = j - i
                g = group(a, b, a_at, *lengths)
                n_links, n_best, total = (np.zeros(n, np.int64) for _ in range(3))
                for document, key, times in g.links(shift):
                    known, of = np.unique(key, return_inverse=True)
                    count = counted.counts(known)
                    top = count == counted.best[known >> shift]
                    np.add.at(n_links, document, times)
                    np.add.at(n_best, document, times * top[of])
                    np.add.at(total, document, times * count[of])
                texts = g.texts(spelled, n_a_ids, n_b_ids, n)
                digests = [hashlib.sha256(t).hexdigest() if t else "" for t in texts]
                columns = [np.diff(a_at), np.diff(b_at), np.bincount(g.document, minlength=n), n_links, n_best, total]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), *[pa.array(c.astype(np.int64)) for c in columns], pa.array(digests, pa.string())], ["id", *(c.split(" ")[0] for c in _ALIGNED.split(", "))])

    kind = tokens.schema["id"].dataType.simpleString()
    return tokens.select("id", "a", "b").mapInArrow(run, f"id {kind}, {_ALIGNED}")


def paths() -> tuple[str, str]:
    """Where the installed public vocabularies are; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    pair = tokenizers(*paths())
    tokens = written(encode_pair(read(spark, sf_dir, "documents"), pair), "token-pairs")
    return align(tokens, count_pairs(tokens, pair), pair).withColumnRenamed("id", "doc_id")
