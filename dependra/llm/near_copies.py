"""Near copies by the exact similarity of shingle sets; fingerprints and min-hash bands only search for candidates.

The similarity of two texts is the Jaccard coefficient of their sets of word shingles, taken as 64-bit
hashes; words are those of :mod:`simhash`. Texts of equal sets are one class. Candidates are classes that
the byte-position index of :mod:`simhash` links, and classes that share a band of ``ROWS`` min-hashes, of
``BANDS``. Two sets of similarity 0.8 differ in some ten of 64 fingerprint bits: the index alone, which must
ask for few bits to keep its posting lists short, finds about one in thirty of such pairs and nearly all from
0.95 on. The bands find the rest: they miss a pair of similarity 0.8 with a probability of 0.0002.
Within a connected group of candidates all pairs are compared by their whole sets; links below the given
similarity are dropped. Groups of over ``MOST`` classes are first compared with one of their classes, and
what this leaves to compare meets block by block; no class is dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import simhash
from ._common import join_by_weight, materialize, prepare, refuse_clash, rows_in

SIMILARITY = 0.8
BANDS = 22
ROWS = 5
MOST = 512  #: classes of a group, or of a block of one, that one task compares
CHUNK = 1 << 10  #: hashes at a time, so that their products stay in the processor's cache

_rng = np.random.default_rng(1)
_TIMES = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; a text without words has the one shingle of no words."""
    return _distinct(simhash.gram_hashes(text, words))


def _distinct(each: np.ndarray) -> np.ndarray:
    return np.unique(each) if len(each) else np.array([xxhash.xxh64_intdigest(b"", simhash.SEED)], np.uint64)


def bands(hashes: np.ndarray) -> np.ndarray:
    """One signed key for each band of min-hashes."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for s in range(0, len(hashes), CHUNK):
        np.minimum(low, (hashes[s : s + CHUNK, None] * _TIMES + _PLUS).min(0), out=low)
    return np.array([xxhash.xxh64_intdigest(low[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64)


def forest(sets: Sequence[np.ndarray], similarity: float, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (index, index) that connect what links of at least ``similarity`` connect, fewer than sets; with ``side`` only pairs across it count."""
    sizes = np.array([len(x) for x in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(len(codes), bool)
    left, out = np.ones(len(sets), bool), []
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first], frontier = False, [first]
        while frontier and left.any():
            x = frontier.pop()
            own = codes[starts[x] : starts[x] + sizes[x]]
            mark[own] = True
            both = np.add.reduceat(mark[codes], starts, dtype=np.int64)
            mark[own] = False
            hit = left & (both >= similarity * (sizes + sizes[x] - both))
            if side is not None:
                hit &= side != side[x]
            left &= ~hit
            found = np.flatnonzero(hit).tolist()
            out.extend((x, y) for y in found)
            frontier.extend(found)
    return out


def _sets(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column]


def _candidates(classes: DataFrame, bits: int) -> DataFrame:
    """``class, root`` of the classes (class, fp, bands, copies) that some candidate links with another."""
    index = materialize(classes.select("class", F.explode("bands").alias("band")), "bands")
    buckets = materialize(index.groupBy("band").agg(F.min("class").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    total = buckets.agg(F.sum("n")).first()[0] or 0
    star = join_by_weight(index, buckets, ["band"], "n", total).select(F.col("class").alias("a"), "b").where("a <> b")
    # a fingerprint stands for the smallest of its classes, and the others are linked with that
    by_print = classes.groupBy("fp").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n"), F.min("class").alias("b"))
    by_print = materialize(by_print, "fingerprints")
    same = join_by_weight(classes.select("class", "fp"), by_print.where("n > 1").select("fp", "n", "b"), ["fp"], "n", classes.count()).select(F.col("class").alias("a"), "b").where("a <> b")
    met = materialize(simhash.links(by_print.select(F.lit(0).alias("seed"), "fp", "copies"), bits).select("a", "b"), "met")
    links = met.count()

    def named(edges: DataFrame, end: str) -> DataFrame:
        """``edges`` with the class of a fingerprint in place of the fingerprint; some have very many links."""
        degrees = edges.groupBy(end).agg(F.count(F.lit(1)).alias("n"))
        right = degrees.join(by_print.select(F.col("fp").alias(end), F.col("b").alias("class")), end)
        return join_by_weight(edges, materialize(right, "ends"), [end], "n", links).drop(end).withColumnRenamed("class", end)

    far = named(materialize(named(met, "a"), "met"), "b")
    roots = simhash.components(star.unionByName(same).unionByName(far))
    return classes.select("class").join(roots.withColumnRenamed("node", "class"), "class")


def _large_groups(large: DataFrame, similarity: float, most: int) -> DataFrame:
    """Links of groups (root, n, class, set) of over ``most`` classes.

    Classes like their group's smallest are linked with it, which connects them all. What is left are pairs of
    a near and a far class, and pairs of far classes; both are compared block by block.
    """
    pivots = large.groupBy("root").agg(F.min("class").alias("pivot"), F.first("n").alias("n"))
    pivots = pivots.join(large.select(F.col("class").alias("pivot"), F.col("set").alias("pivot_set")), "pivot")
    pivots = materialize(pivots.select("root", "pivot", "pivot_set", "n"), "pivots")
    total = pivots.agg(F.sum("n")).first()[0] or 0

    @F.pandas_udf("boolean")
    def like(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(_sets(a), _sets(b)):
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(bool(both >= similarity * (len(x) + len(y) - both)))
        return pd.Series(out, dtype=bool)

    met = join_by_weight(large.drop("n"), pivots, ["root"], "n", total)
    rows = materialize(met.withColumn("near", like("set", "pivot_set")).drop("pivot_set"), "near")
    star = rows.where("near and class <> pivot").select(F.col("class").alias("a"), F.col("pivot").alias("b"))
    sizes = rows.groupBy("root").agg(F.count_if("near").alias("n_near"), F.count_if(~F.col("near")).alias("n_far"), F.count(F.lit(1)).alias("n")).where("n_far > 0")
    sizes = materialize(sizes, "sizes")
    total = sizes.agg(F.sum("n")).first()[0]
    if not total:
        return star
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / most)).cast("int")
    rows = join_by_weight(rows.drop("pivot"), sizes, ["root"], "n", total)
    rows = rows.withColumn("nb", blocks("n_near")).withColumn("fb", blocks("n_far")).withColumn("block", F.pmod(F.xxhash64("class"), F.when(F.col("near"), F.col("nb")).otherwise(F.col("fb"))).cast("int"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1)).alias("other")
    own = ["root", "class", "set"]
    mixed = rows.where("near").select(*own, F.lit(0).alias("side"), F.col("block").alias("i"), upto("fb")).withColumnRenamed("other", "j").unionByName(
        rows.where("not near").select(*own, F.lit(1).alias("side"), F.col("block").alias("j"), upto("nb")).withColumnRenamed("other", "i")
    ).withColumn("kind", F.lit(0))
    far = rows.where("not near").select(*own, "block", upto("fb")).select(
        *own, (F.col("block") > F.col("other")).cast("int").alias("side"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.lit(1).alias("kind")
    )

    def between(pdf: pd.DataFrame) -> pd.DataFrame:
        same = bool(pdf.kind.iloc[0]) and pdf.i.iloc[0] == pdf.j.iloc[0]
        return _links(pdf, forest(_sets(pdf["set"]), similarity, None if same else pdf.side.to_numpy()))

    return star.unionByName(mixed.unionByName(far).groupBy("root", "kind", "i", "j").applyInPandas(between, "a long, b long"))


def _links(pdf: pd.DataFrame, pairs) -> pd.DataFrame:
    ab = pdf["class"].to_numpy(np.int64)[np.array(pairs, np.int64).reshape(-1, 2)]
    return pd.DataFrame({"a": ab[:, 0], "b": ab[:, 1]})


def keep_one(docs: DataFrame, words: int = 5, bits: int = simhash.BITS, similarity: float = SIMILARITY, most: int | None = None) -> DataFrame:
    """``docs`` with one row of each component of texts of at least ``similarity``: that of the smallest id.

    Of rows that repeat the smallest id the first stays; rows without an id stay only if their component has no
    other. Null counts as empty, and texts without words equal each other. Rows are numbered in a table that is
    written once, so each later reading sees the same numbers whatever the cluster does. Texts are not exchanged:
    those of candidates alone are described, where they lie, by their shingle sets.
    """
    refuse_clash(docs, ["__row", "__near"])
    spark, most = docs.sparkSession, most or MOST
    prepare(spark)

    @F.pandas_udf("fp long, bands array<long>, digest binary")
    def describe(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            each = simhash.gram_hashes(t, words)
            own = _distinct(each)
            out.append((int(simhash.majority(each).view(np.int64)), bands(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest()))
        return pd.DataFrame(out, columns=["fp", "bands", "digest"])

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, words).tobytes() for t in texts], dtype=object)

    stored = materialize(docs.withColumn("__near", describe("text")).withColumn("__row", F.monotonically_increasing_id()), "numbered")
    rows = stored.select("__row", F.col("doc_id").cast("long").alias("doc_id"), "__near.*")
    # a null id comes after all others
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("best")
    classes = rows.groupBy("digest").agg(F.min("__row").alias("class"), best, F.count(F.lit(1)).alias("copies"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands"))
    classes = materialize(classes.drop("digest"), "classes")
    groups = materialize(_candidates(classes, bits), "candidates")
    sizes = materialize(groups.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    members = materialize(join_by_weight(groups, sizes.select("root", F.col("n").alias("w"), "n"), ["root"], "w", total), "members")
    sets = rows_in(stored.select(F.col("__row").alias("class"), "text"), members.select("class"), "class").select("class", packed("text").alias("set"))
    members = materialize(sets.join(members.hint("shuffle_hash"), "class").select("root", "n", "class", "set"), "sets")

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        return _links(pdf, forest(_sets(pdf["set"]), similarity))

    found = members.where(F.col("n") <= most).groupBy("root").applyInPandas(within, "a long, b long")
    large = members.where(F.col("n") > most)
    if sizes.where(F.col("n") > most).count():
        found = found.unionByName(_large_groups(large, similarity, most))
    roots = simhash.components(found).withColumnRenamed("node", "class")
    kept = classes.select("class", "best").join(roots, "class", "left").groupBy(F.coalesce("root", "class").alias("root")).agg(F.min("best")["__row"].alias("__row")).select("__row")
    return rows_in(stored.select(*docs.columns, "__row"), kept).select(docs.columns)
