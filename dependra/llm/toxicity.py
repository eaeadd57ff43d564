"""Toxicity by maximum-scoring segments.

Every token gets a log-odds score, toxic against other text. The class counts carry Dirichlet priors that
back off from the word to its first six, five and four characters, so inflected or unseen forms of a known
stem are scored by the stem. A linear scan finds all maximal-scoring segments of a text (disjoint, each of
positive score, none extendable). Under ordinary text the best score of a text of n tokens follows an
extreme-value law with parameters lambda and K, fitted on training texts that are not toxic, with tables
that have not seen them; a segment's normalised score is ``lambda * S - ln(K * n)`` and its E-value ``exp``
of minus that. The significant segments of a text are summed and a logistic curve maps the sum to 0..1.

Edge cases: a null or empty text has no segment and gets the score of a text without evidence; nulls,
repeated rows and other columns pass through; with no usable labels every score is the neutral prior.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._common import LONGEST_CACHED, fold_of, labelled_sample, prepare, refuse_clash, table

LEVELS = (0, 6, 5, 4)  #: whole word, then prefixes
PRIOR = 10.0  #: documents that a level's class shares count beside those of the next finer level
LEAST = 3  #: documents that a table entry needs
DRIFT = 1.0  #: taken off every token, so that ordinary text scores below zero
FOLDS = 4  #: parts of the sample; law and curve are fitted on texts that the table in use has not seen
SAMPLE = 20_000  #: most labelled rows that are learned from: they bound the table of every model too
CACHE = 100_000  #: tokens that a worker remembers, of all models that it uses at a time
_EDGE = string.punctuation + "«»“”„‘’…–—¡¿"


def parts(word: str):
    """(level, part) of a word, from the whole word to its shortest prefix."""
    return [(n, word[:n] if n else word) for n in LEVELS if len(word) > n]


def document_parts(batches):
    """Of (text, y) batches: a row (level, part, y, n) for each table entry and class y met, with its number of documents."""
    import pyarrow as pa

    for b in batches:
        counts: list[dict[tuple[int, str], int]] = [{} for _ in range(2 * FOLDS)]
        for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
            words = {w for t in set((text or "").lower().split()) if (w := t.strip(_EDGE))}
            own = counts[y]
            for k in {p for w in words for p in parts(w)}:
                own[k] = own.get(k, 0) + 1
        for y, own in enumerate(counts):
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in own], pa.int32()), pa.array([k[1] for k in own], pa.string()), pa.array([y] * len(own), pa.int32()), pa.array(own.values(), pa.int64())], ["level", "part", "y", "n"]
            )


def maximal_segments(scores) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end exclusive, score) of a sequence, in linear time.

    Candidate segments are kept with the running total before (left) and after (right) them. A new
    positive element merges backwards with the nearest candidate whose left total is smaller than its own,
    as long as the right total of that candidate is smaller too.
    """
    found: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total after, the nearest earlier one with a smaller total before
    totals = list(accumulate(scores))
    for i in [i for i, s in enumerate(scores) if s > 0]:
        total = totals[i]
        before = total - scores[i]
        start, j = i, len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append((start, i + 1, before, total, j))
                break
            start, _, before, _, link = found[j]
            del found[j:]
            j = link
    return [(a, b, after - before) for a, b, before, after, _ in found]


class TokenScores(dict):
    """Scores of tokens seen lately; cleared when full."""

    def __init__(self, rule, most):
        self.rule, self.most = rule, most

    def __missing__(self, token):
        if len(self) >= self.most:
            self.clear()
        s = self.rule(token)
        if len(token) <= LONGEST_CACHED:
            self[token] = s
        return s


@dataclass
class ToxicityModel:
    """``index``: by level, the number of each table entry; ``odds``: its score, not a number if the entry does not
    count; lam, log_k: extreme-value law; curve: logistic."""

    index: dict[int, dict[str, int]] | None = None
    odds: np.ndarray | None = None
    lam: float = 1.0
    log_k: float = 0.0
    curve: tuple[float, float] = (0.0, 0.0)
    significant: float = math.log(100.0)  # an E-value of 0.01
    cache: int = CACHE

    def __post_init__(self):
        self._seen = TokenScores(self.token_score, self.cache)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_seen"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def token_score(self, token: str) -> float:
        """The score of the finest table entry that covers the token."""
        w = token.strip(_EDGE)
        if self.index:
            for n in LEVELS:
                if len(w) > n and (i := self.index[n].get(w[:n] if n else w)) is not None and (s := float(self.odds[i])) == s:
                    return s
        return -DRIFT

    def scores_of(self, text: str) -> list[float]:
        """Token scores; the k-th occurrence of a token that speaks for toxicity counts a k-th part, since words come in bursts."""
        tokens = text.lower().split()
        scores = list(map(self._seen.__getitem__, tokens))
        times: dict[str, int] = {}
        for i in [i for i, s in enumerate(scores) if s > 0]:
            times[tokens[i]] = k = times.get(tokens[i], 0) + 1
            scores[i] /= k
        return scores

    def segments(self, text: str) -> list[tuple[int, int, float]]:
        """Significant maximal segments: first and last-plus-one token and normalised score, best first."""
        s = self.scores_of(text)
        if not s:
            return []
        base = self.log_k + math.log(len(s))
        return sorted(((a, b, v) for a, b, raw in maximal_segments(s) if (v := self.lam * raw - base) > self.significant), key=lambda x: -x[2])

    def probability(self, total: float) -> float:
        a, b = self.curve
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, a + b * math.log1p(total)))))


def index_of(levels: list[int], parts: list[str]) -> tuple[dict[int, dict[str, int]], np.ndarray]:
    """By level, the number of each entry; and for each entry the number of the next coarser one, -1 without one."""
    index: dict[int, dict[str, int]] = {n: {} for n in LEVELS}
    for i, (level, part) in enumerate(zip(levels, parts)):
        index[level][part] = i
    parents = np.full(len(parts), -1, np.int64)
    for i, (level, part) in enumerate(zip(levels, parts)):
        for n in LEVELS[1:]:
            if n < (level or len(part)) and (up := index[n].get(part[:n])) is not None:
                parents[i] = up
                break
    return index, parents


def log_odds(levels: np.ndarray, parents: np.ndarray, counts: np.ndarray, n0: float, n1: float) -> np.ndarray:
    """Log-odds of each entry with ``counts`` (documents of class 0, of class 1) against the base rate; not a number without documents.

    The class shares of an entry have a Dirichlet prior of mass ``PRIOR`` around those of the next coarser entry.
    """
    base = n1 / (n0 + n1)
    share = np.full(len(levels) + 1, base)  # the last is what parent -1 means
    for level in reversed(LEVELS):
        at = np.flatnonzero(levels == level)
        share[at] = (counts[at, 1] + PRIOR * share[parents[at]]) / (counts[at].sum(1) + PRIOR)
    share = share[:-1]
    odds = np.log(share / (1.0 - share)) - math.log(base / (1.0 - base))
    return np.where(counts.sum(1) > 0, np.clip(odds, -1.0, 8.0) - DRIFT, np.nan)


def _lambda_of(scores: np.ndarray) -> float:
    """The positive root of E[exp(lambda s)] = 1 over ordinary tokens."""
    if not len(scores) or scores.max() <= 0 or scores.mean() >= 0:
        return 1.0
    lo, hi = 1e-3, 4.0
    f = lambda x: float(np.mean(np.exp(x * scores)) - 1.0)
    if f(hi) < 0:
        return hi
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Ridge logistic regression by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    ridge = np.diag([1e-6, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge, a.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def fit_law(model: ToxicityModel, evidence: list[tuple[int, float, float]], token_scores: np.ndarray) -> None:
    """Lambda from ordinary tokens, K from the best scores of ordinary texts (n, best raw score)."""
    model.lam = _lambda_of(token_scores)
    v = np.array([model.lam * best - math.log(n) for n, best, y in evidence if not y and n])
    model.log_k = float(v.mean() - 0.5772156649) if len(v) else 0.0


def _observe(casts, batches):
    """Of (text, y, fold) batches: y, tokens and best raw score under the fold's model; with the batch's last row a
    histogram of ordinary token scores."""
    import pyarrow as pa

    models = casts.value
    for b in batches:
        ys, ns, tops, hist = b.column("y").to_pylist(), [], [], np.zeros(len(_MIDS), np.int64)
        for text, y, fold in zip(b.column("text").to_pylist(), ys, b.column("fold").to_pylist()):
            s = models[fold].scores_of(text or "")
            ns.append(len(s))
            tops.append(max((x for _, _, x in maximal_segments(s)), default=0.0))
            if not y:
                hist += np.histogram(s, _EDGES)[0]
        if ys:
            last = [None] * (len(ys) - 1) + [hist.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(ns, pa.int64()), pa.array(tops, pa.float64()), pa.array(last, pa.list_(pa.int64()))], ["y", "n", "best", "hist"])


def _weigh(casts, batches):
    """Of (text, y, fold) batches: y and the evidence of each text, the sum of its significant segments under the fold's model and law."""
    import pyarrow as pa

    models = casts.value
    for b in batches:
        ys = b.column("y").to_pylist()
        sums = [sum(v for _, _, v in models[fold].segments(text or "")) for text, fold in zip(b.column("text").to_pylist(), b.column("fold").to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(sums, pa.float64())], ["y", "evidence"])


_EDGES = np.linspace(-1.1005, 8.0005, 181)
_MIDS = (_EDGES[1:] + _EDGES[:-1]) / 2


def fit(sample: DataFrame) -> ToxicityModel:
    """Learn from ``doc_id, text, y`` rows, which are a bounded sample. Counts are summed on the executors."""
    spark = sample.sparkSession
    prepare(spark)
    sample = sample.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int"))
    totals = np.zeros((2, FOLDS))
    for r in sample.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n")).collect():
        totals[r.y, r.fold] = r.n
    model = ToxicityModel()
    if not (totals.sum(1) > 0).all():
        return model
    counts = sample.select("text", (F.col("y") + 2 * F.col("fold")).cast("int").alias("y")).mapInArrow(document_parts, "level int, part string, y int, n long")
    each = [f"c{k}" for k in range(2 * FOLDS)]
    c0, c1 = (sum(F.col(f"c{k + 2 * f}") for f in range(FOLDS)) for k in (0, 1))
    found = (
        counts.groupBy("level", "part").agg(*[F.sum(F.when(F.col("y") == k, F.col("n")).otherwise(0)).alias(c) for k, c in enumerate(each)])
        .where(c0 + c1 >= LEAST).select("level", "part", *each).toArrow()
    )
    levels = found["level"].to_numpy()
    index, parents = index_of(levels.tolist(), found["part"].to_pylist())
    grid = np.stack([found[c].to_numpy() for c in each], 1).astype(float).reshape(len(levels), FOLDS, 2)
    del found

    def table(seen: list[int]) -> np.ndarray:
        return log_odds(levels, parents, grid[:, seen].sum(1), *(totals[:, seen].sum(1) + 0.5))

    model.index, model.odds = index, table(list(range(FOLDS)))
    apart = [ToxicityModel(index, table([k for k in range(FOLDS) if k != f]), cache=CACHE // FOLDS) for f in range(FOLDS)]
    cast = spark.sparkContext.broadcast(apart)
    rows = sample.select("text", "y", "fold")
    seen = rows.mapInArrow(lambda it: _observe(cast, it), "y int, n long, best double, hist array<long>").collect()
    cast.unpersist()
    hist = np.sum([r.hist for r in seen if r.hist], axis=0)
    tokens = np.repeat(_MIDS, np.ceil(hist / max(1, np.sum(hist) / 10**5)).astype(int)) if np.sum(hist) else np.zeros(0)
    fit_law(model, [(r.n, r.best, r.y) for r in seen], tokens)
    for m in apart:
        m.lam, m.log_k = model.lam, model.log_k
    cast = spark.sparkContext.broadcast(apart)
    # two numbers a labelled row, in an order that tasks do not decide
    x = sorted((r.evidence, r.y) for r in rows.mapInArrow(lambda it: _weigh(cast, it), "y int, evidence double").collect())
    cast.unpersist()
    model.curve = _logistic(np.array([math.log1p(v) for v, _ in x]), np.array([float(y) for _, y in x]))
    return model


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", prefix: str = "tox_") -> DataFrame:
    """``docs`` with ``{prefix}score``, ``{prefix}segments`` (array of start, end, score), whole texts, no shuffle.

    Columns of those names are an error, all others pass through.
    """
    refuse_clash(docs, [f"{prefix}score", f"{prefix}segments", "__tox"])
    spark = docs.sparkSession
    prepare(spark)
    cast = spark.sparkContext.broadcast(model)

    @F.pandas_udf("score double, segments array<struct<first:int,last:int,score:double>>")
    def apply(texts: pd.Series) -> pd.DataFrame:
        m = cast.value
        out, spans = [], []
        for t in texts:
            found = m.segments(t) if t else []
            out.append(m.probability(sum(v for _, _, v in found)))
            spans.append([{"first": a, "last": b - 1, "score": v} for a, b, v in found])
        return pd.DataFrame({"score": out, "segments": spans})

    got = docs.withColumn("__tox", apply(F.col(text)))
    return got.withColumn(f"{prefix}score", F.col("__tox.score")).withColumn(f"{prefix}segments", F.col("__tox.segments")).drop("__tox")


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> ToxicityModel:
    """Fit on labelled rows outside the held-out fold (crc32 of the id modulo 5 is 0)."""
    return fit(labelled_sample(docs, labels, "toxic", fold_of(F.col("doc_id"), 5) != 0, bound))


def op1_toxicity_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("tox_score").alias("score"),
        (F.col("tox_score") >= 0.5).cast("int").alias("predicted"), F.size("tox_segments").cast("long").alias("n_segments"),
    )
