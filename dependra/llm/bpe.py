"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A piece (one match of the splitting pattern) starts as its bytes. Leaf i of a segment tree holds the rank of
the pair that starts at live position i, joined with i itself, so the root is the leftmost pair of minimum
rank. A merge closes the right partner's leaf and renews the leaves of the position and of its live left
neighbour: three point updates of logarithmic cost. Pieces of up to 64 bytes are merged many at a time, one
tree per row of a matrix; longer ones have a tree of their own. Pieces seen lately are kept in a bounded
table of each worker.

Edge cases: a null or empty text has no ids and decodes to nothing; decoding joins the bytes of the ids, so
it gives back any text exactly; an id outside the vocabulary raises ``KeyError``.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._common import LONGEST_CACHED, prepare, refuse_clash, table

CACHE = 300_000  #: pieces that a worker remembers
CHUNK = 1 << 21  #: characters of text whose pieces are held at once
WIDTHS = (8, 16, 32, 64)  #: bytes of the matrix forms
ROWS = 8192  #: pieces merged at once
NONE = np.iinfo(np.int64).max


class Codec:
    """Ranks of a vocabulary and the pattern that splits a text into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[int(k)] for k in self.pair_keys], np.int64)
        self.first = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.cache: dict[str, tuple[int, ...]] = {}

    @classmethod
    def from_file_bytes(cls, content: bytes, pattern: str) -> Codec:
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}, pattern)

    # one piece, its own tree
    def merge_one(self, piece: bytes) -> list[int]:
        n = len(piece)
        size = 1 << max(1, (n - 1).bit_length())
        tok = [int(self.first[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none = 1 << 62
        tree = [none] * (2 * size)
        get = self.pairs.get

        def leaf(i: int) -> int:
            j = after[i]
            rank = get(tok[i] << 32 | tok[j]) if j < n else None
            return none if rank is None else rank * size + i

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                tree[i] = a if a < b else b
                i >>= 1

        for i in range(n - 1):
            tree[size + i] = leaf(i)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        while tree[1] < none:
            rank, i = divmod(tree[1], size)
            j = after[i]
            k = after[j]
            tok[i], after[i] = rank, k
            if k < n:
                before[k] = i
            put(j, none)
            tok[j] = -1
            put(i, leaf(i))
            if (p := before[i]) >= 0:
                put(p, leaf(p))
        return [t for t in tok if t >= 0]

    # many pieces of up to ``width`` bytes, one tree a row
    def merge_rows(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        m = len(pieces)
        size = np.array([len(p) for p in pieces], np.int64)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(m, width)
        tok = self.first[raw]
        col = np.arange(width + 1)
        after = np.broadcast_to(col[1:], (m, width)).copy()
        before = np.broadcast_to(col[:-1] - 1, (m, width)).copy()
        live = col[:-1] < size[:, None]
        tree = np.full((m, 2 * width), NONE, np.int64)
        ok = col[1:-1] < size[:, None]
        rows, at = np.nonzero(ok)
        tree[rows, width + at] = self._leaves(tok[rows, at], tok[rows, at + 1], at, width)
        node = width
        while node > 1:
            half = node >> 1
            tree[:, half:node] = np.minimum(tree[:, node : 2 * node : 2], tree[:, node + 1 : 2 * node : 2])
            node = half
        rows = np.nonzero(tree[:, 1] < NONE)[0]
        while len(rows):
            top = tree[rows, 1]
            i, rank = top % width, top // width
            j = after[rows, i]
            k = after[rows, j]
            tok[rows, i] = rank
            after[rows, i] = k
            live[rows, j] = False
            inside = k < size[rows]
            before[rows[inside], k[inside]] = i[inside]
            value = np.full(len(rows), NONE, np.int64)
            value[inside] = self._leaves(rank[inside], tok[rows[inside], k[inside]], i[inside], width)
            self._put(tree, rows, j, NONE, width)
            self._put(tree, rows, i, value, width)
            p = before[rows, i]
            left = p >= 0
            if left.any():
                r, p = rows[left], p[left]
                self._put(tree, r, p, self._leaves(tok[r, p], rank[left], p, width), width)
            rows = rows[tree[rows, 1] < NONE]
        return [tuple(t[v].tolist()) for t, v in zip(tok, live)]

    def _leaves(self, a, b, at, width):
        key = a << 32 | b
        i = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[i] == key, self.pair_ranks[i] * width + at, NONE)

    @staticmethod
    def _put(tree, rows, at, value, width):
        node = at + width
        tree[rows, node] = value
        node = node >> 1
        while width > 1:
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node = node >> 1
            width >>= 1

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode pieces into the table of this worker."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for text in pieces:
            piece = text.encode("utf-8", "replace")
            if (rank := self.ranks.get(piece)) is not None:
                self.cache[text] = (rank,)
            elif len(piece) > WIDTHS[-1]:
                self.cache[text] = tuple(self.merge_one(piece))
            else:
                by_width.setdefault(next(w for w in WIDTHS if len(piece) <= w), []).append((text, piece))
        for width, own in by_width.items():
            for s in range(0, len(own), ROWS):
                part = own[s : s + ROWS]
                self.cache.update(zip((t for t, _ in part), self.merge_rows([p for _, p in part], width)))

    def encode_all(self, texts: list[str]) -> Iterable[list[int]]:
        """The ids of each text, in order."""
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) <= CHUNK):
                size += len(texts[end])
                end += 1
            found = [self.pattern.findall(t) for t in texts[start:end]]
            if len(self.cache) > CACHE:
                self.cache.clear()
            new = set(chain.from_iterable(found)).difference(self.cache)
            self.learn(new)
            get = self.cache.__getitem__
            for pieces in found:
                yield list(chain.from_iterable(map(get, pieces)))
            for piece in new:
                if len(piece) > LONGEST_CACHED:
                    del self.cache[piece]
            start = end

    def encode(self, text: str) -> list[int]:
        return next(iter(self.encode_all([text])))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(content: bytes, pattern: str) -> Codec:
    """The codec of a rank file's content, built once a worker."""
    key = (hashlib.sha256(content).hexdigest(), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec.from_file_bytes(content, pattern)
    return _CODECS[key]


def _each(batches, cast, pattern, text, emit, names):
    import pyarrow as pa

    c = codec(cast.value, pattern)
    for b in batches:
        texts = [t or "" for t in b.column(text).to_pylist()]
        rows = [emit(c, ids) for ids in c.encode_all(texts)]
        kept = [b.column(n) for n in b.schema.names if n != text]
        new = [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(names)]
        yield pa.RecordBatch.from_arrays(kept + new, [n for n in b.schema.names if n != text] + [n for n, _ in names])


def encode(docs: DataFrame, ranks_path: str, pattern: str, emit: Callable | None = None, columns: list[tuple[str, str]] | None = None, text: str = "text") -> DataFrame:
    """The other columns of ``docs`` and, of each whole text, ``ids`` (array<int>), or the ``columns`` (name and
    Arrow type) that ``emit(codec, ids)`` gives. The rank file is read on the driver and broadcast."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_type
    from pyspark.sql.types import StructField, StructType

    spark = docs.sparkSession
    prepare(spark)
    with open(ranks_path, "rb") as f:
        cast = spark.sparkContext.broadcast(f.read())
    if emit is None:
        emit, columns = _ids, [("ids", pa.list_(pa.int32()))]
    refuse_clash(docs.drop(text), [n for n, _ in columns])
    schema = StructType([f for f in docs.schema if f.name != text] + [StructField(n, from_arrow_type(t)) for n, t in columns])
    return docs.mapInArrow(lambda it: _each(it, cast, pattern, text, emit, columns), schema)


def _ids(_: Codec, ids: list[int]) -> tuple:
    return (ids,)


def _digests(c: Codec, ids: list[int]) -> tuple:
    return (
        len(ids),
        hashlib.sha256(" ".join(map(c.text_of.__getitem__, ids)).encode()).hexdigest(),
        hashlib.sha256(c.decode(ids)).hexdigest(),
    )


def decode(rows: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """``rows`` with the bytes of their ids; a null list gives null."""
    refuse_clash(rows, [column])
    prepare(rows.sparkSession)
    with open(ranks_path, "rb") as f:
        cast = rows.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("binary")
    def apply(lists: pd.Series) -> pd.Series:
        c = codec(cast.value, pattern)
        return pd.Series([None if v is None else c.decode(map(int, v)) for v in lists], dtype=object)

    return rows.withColumn(column, apply(F.col(ids)))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    import pyarrow as pa

    columns = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, _digests, columns)
