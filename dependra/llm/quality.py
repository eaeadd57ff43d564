"""Quality by nearest-neighbour voting in a latent semantic space.

A text becomes the counts of its token shapes (letter case, digits, punctuation, runs shortened), of shape
pairs, and of a few coarse measures of length and repetition, hashed to a fixed width, damped, weighted by inverse document frequency and scaled to length one. A truncated singular value
decomposition of a bounded sample of labelled rows gives the latent space. The sample's vectors are
broadcast (``SAMPLE * RANK`` floats: the proven size bound); each document's exact cosine with all of them
is computed in blocks as matrix products, and its ``NEIGHBOURS`` nearest vote with their similarity.

Edge cases: a null or empty text has no direction and gets the sample's share of label 1, as does every
text when there are no usable labels; rows and other columns pass through as they are.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._common import LONGEST_CACHED, fold_of, labelled_sample, prepare, refuse_clash, table

WIDTH = 2048  #: hashed features
RANK = 48  #: latent dimensions
SAMPLE = 4000  #: most labelled rows that are learned from
NEIGHBOURS = 15
SHARPNESS = 8.0  #: power of the similarity in a vote
THRESHOLD = 0.7
BLOCK = 256
ITERATIONS = 24
CACHE = 100_000  #: tokens that a worker remembers


def shape(token: str) -> str:
    """Upper and lower case letters and digits as A, a and 0, runs of one sign shortened to two at most."""
    out = []
    for ch in token:
        c = "0" if ch.isdigit() else ("A" if ch.isupper() else "a") if ch.isalpha() else ch
        if out and out[-1] == c and (c in "Aa0" or len(out) > 1 and out[-2] == c):
            continue
        out.append(c)
    return "".join(out)


def _slot(kind: str, what: str) -> int:
    return zlib.crc32(f"{kind}\x00{what}".encode("utf-8", "surrogatepass")) % WIDTH


class Slots(dict):
    """(shape number, feature slots) of tokens seen lately; cleared when full."""

    def __missing__(self, token):
        if len(self) >= CACHE:
            self.clear()
        s = shape(token)
        v = (zlib.crc32(s.encode("utf-8", "surrogatepass")), _slot("s", s))
        if len(token) <= LONGEST_CACHED:
            self[token] = v
        return v


_SLOTS = Slots()


def features(text: str) -> np.ndarray:
    """Hashed counts of one whole text, damped."""
    x = np.zeros(WIDTH, np.float32)
    tokens = text.split()
    if not tokens:
        return x
    found = list(map(_SLOTS.__getitem__, tokens))
    n = len(tokens)
    ids, at = np.array(found, np.int64).T
    x += np.bincount(at, minlength=WIDTH).astype(np.float32)
    pairs = (ids[:-1] * 31 + ids[1:]) % 1_000_003 % WIDTH
    x += 0.5 * np.bincount(pairs, minlength=WIDTH).astype(np.float32)
    x = np.sqrt(x / n)
    distinct = len(set(tokens)) / math.sqrt(n)
    for kind, value in (("length", math.log2(n + 1)), ("distinct", 2 * math.log2(distinct + 0.1)), ("line", math.log2(n / (1 + text.count("\n")) + 1)), ("letters", math.log2(len(text) / n + 1) * 2)):
        x[_slot(kind, str(int(value)))] += 0.3
    return x


@dataclass
class QualityModel:
    idf: np.ndarray | None
    basis: np.ndarray | None
    vectors: np.ndarray | None
    labels: np.ndarray | None
    prior: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.idf) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def votes(self, texts: list[str]) -> np.ndarray:
        """Scores of texts, a block of cosines at a time."""
        out = np.full(len(texts), self.prior)
        if self.basis is None:
            return out
        for start in range(0, len(texts), BLOCK):
            x = np.stack([features(t) for t in texts[start : start + BLOCK]])
            cosines = self.latent(x) @ self.vectors.T
            k = min(NEIGHBOURS, cosines.shape[1])
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(cosines, near, 1), 1e-6).astype(float) ** SHARPNESS
            score = (w * self.labels[near]).sum(1) / w.sum(1)
            live = x.any(1)
            out[start : start + BLOCK][live] = score[live]
        return out


def _encode(batches):
    import pyarrow as pa

    for b in batches:
        x = [features(t or "") for t in b.column("text").to_pylist()]
        at = [np.nonzero(v)[0].astype("<i4") for v in x]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("y"), pa.array([i.tobytes() for i in at], pa.binary()), pa.array([v[i].astype("<f4").tobytes() for v, i in zip(x, at)], pa.binary())], ["doc_id", "y", "at", "value"]
        )


def fit(sample: DataFrame) -> QualityModel:
    """Learn from ``doc_id, text, y`` rows, which are a bounded sample: only their sparse features reach the driver."""
    prepare(sample.sparkSession)
    rows = sample.select("doc_id", "text", "y").mapInArrow(_encode, "doc_id long, y int, at binary, value binary").collect()
    rows = sorted((r for r in rows if r["at"]), key=lambda r: (r.doc_id, r.y))
    if len(rows) < 2:
        return QualityModel(None, None, None, None, 1.0 if not rows else float(rows[0].y))
    y = np.array([r.y for r in rows], np.float64)
    x = [(np.frombuffer(r["at"], "<i4"), np.frombuffer(r["value"], "<f4")) for r in rows]
    idf = np.log((1 + len(x)) / (1 + np.bincount(np.concatenate([at for at, _ in x]), minlength=WIDTH))).astype(np.float32) + 0.1
    gram = np.zeros((WIDTH, WIDTH), np.float32)
    for block in _dense(x):  # a few rows at a time: the driver holds the sample sparse
        block *= idf
        block /= np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-12)
        gram += block.T @ block
    basis = leading(gram, min(RANK, len(rows)))
    model = QualityModel(idf, basis, None, y, float(y.mean()))
    model.vectors = np.concatenate([model.latent(block) for block in _dense(x)])
    return model


def leading(gram: np.ndarray, rank: int) -> np.ndarray:
    """Leading eigenvectors of a Gram matrix by subspace iteration from a fixed start: a narrow block beside the matrix is all it holds."""
    y = np.random.default_rng(0).standard_normal((len(gram), min(len(gram), rank + 32))).astype(np.float32)
    for _ in range(ITERATIONS):
        y, _ = np.linalg.qr(gram @ y)
    _, turn = np.linalg.eigh((y.T @ (gram @ y)).astype(np.float64))
    return np.ascontiguousarray(y @ turn[:, ::-1][:, :rank].astype(np.float32))


def _dense(x: list[tuple[np.ndarray, np.ndarray]]):
    """Sparse rows (slots, values) as matrices of ``BLOCK`` rows."""
    for start in range(0, len(x), BLOCK):
        part = x[start : start + BLOCK]
        out = np.zeros((len(part), WIDTH), np.float32)
        for row, (at, value) in zip(out, part):
            row[at] = value
        yield out


def score(docs: DataFrame, model: QualityModel, text: str = "text", column: str = "quality_score") -> DataFrame:
    """``docs`` with the score column, from whole texts, without a shuffle; a column of its name is an error, others pass through."""
    refuse_clash(docs, [column])
    spark = docs.sparkSession
    prepare(spark)
    cast = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def vote(texts: pd.Series) -> pd.Series:
        return pd.Series(cast.value.votes([t or "" for t in texts]))

    return docs.withColumn(column, vote(F.col(text)))


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> QualityModel:
    """Fit on labelled rows outside the held-out fold (crc32 of the id modulo 4 is 2)."""
    return fit(labelled_sample(docs, labels, "quality", fold_of(F.col("doc_id"), 4) != 2, bound))


def op9_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model, column="score").select(
        "doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
