"""SimHash near-duplicates through a byte-position inverted index.

Fingerprints: of all word shingles of a text (repeats included) the 64-bit hashes vote bit by bit. Two
fingerprints of at most d differing bits share at least 8 - d of their eight positional bytes. With m =
min(3, 8 - d) the index therefore holds, for each fingerprint, the values at every m of the first 8 - (8 - d) + m
positions: a pair that shares 8 - d bytes shares at least m among those. Within a posting list the shared
positional bytes of pairs are tallied, those below the guaranteed 8 - d are dropped and the rest verified by
their differing bits.

Equal fingerprints are one class from the start, so copies never form pairs. Lists of up to ``TALLY``
members are tallied pair by pair, many lists at once. A longer list is searched breadth first from its
smallest member: whoever is reached leaves the list, so a list of near copies costs about its length and
yields a spanning forest, never all pairs. In lists over ``MOST``
members those near a pivot are linked with it, and what this leaves to compare is cut into blocks, which
meet in tasks of bounded size; no member is dropped. Components
grow from the forests by alternating large-star and small-star steps on checkpointed tables.

Words are split at ASCII white space after lower-casing A-Z. Texts of fewer words than a shingle have one
shingle, their whole sequence; null, empty and blank texts have the zero fingerprint, linked like any other.
Rows whose id is null are in a class, but do not name a component unless all of it is null; repeated rows
share their class.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._common import HOT_SHARE, join_by_weight, materialize, prepare, refuse_clash, rows_in, table

WORDS = 4
SEED = 42
BITS = 4
MOST = 512  #: members of a posting list that one task takes
TALLY = 24  #: members of a list whose pairs are all tallied
CHUNK = 1 << 16
SPREAD = 48  #: least number of files that the index is built from


def gram_hashes(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The 64-bit hashes of a whole text's shingles in their order, none without words."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])
    last = ends[words - 1 :] if len(tokens) >= words else ends[-1:]
    h = xxhash.xxh64_intdigest
    return np.concatenate([
        np.array([h(joined[a:b], seed) for a, b in zip(starts[s : s + CHUNK][: n - s].tolist(), last[s : s + CHUNK].tolist())], np.uint64) for s in range(0, n, CHUNK)
    ])


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint of one whole text, as an unsigned integer."""
    return int(majority(gram_hashes(text, words, seed)))


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits that are set in over half of the hashes."""
    votes = np.zeros(64, np.int64)
    for s in range(0, len(hashes), CHUNK):
        votes += np.unpackbits(hashes[s : s + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(votes * 2 > len(hashes)).view(">u8")[0].astype(np.uint64)


def fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS, seeds: Sequence[int] = (SEED,), column: str = "fp") -> DataFrame:
    """``docs`` with ``column``, an array of one signed 64-bit fingerprint for each seed; other columns pass through, one of that name is an error."""
    refuse_clash(docs, [column])
    prepare(docs.sparkSession)
    seeds = tuple(seeds)

    @F.pandas_udf("array<long>")
    def apply(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array([fingerprint(t, words, s) for s in seeds], np.uint64).view(np.int64) for t in texts])

    return docs.withColumn(column, apply(F.col(text)))


def position_sets(bits: int) -> list[tuple[int, ...]]:
    """Sets of byte positions of which two fingerprints of at most ``bits`` differing bits share one whole."""
    shared = 8 - bits
    if shared < 1:
        raise ValueError("more than 7 differing bits leave no shared byte for certain")
    m = min(3, shared)
    return list(combinations(range(8 - shared + m), m))


def _index(classes: DataFrame, bits: int) -> DataFrame:
    """``seed, fp, copies, set, bytes``: each fingerprint under every position set; ``set`` counts the seed in."""
    sets = position_sets(bits)
    keys = []
    for number, positions in enumerate(sets):
        mask = sum(0xFF << (8 * p) for p in positions)
        mask -= (mask >> 63) << 64  # as a signed long
        keys.append(F.struct((F.col("seed") * len(sets) + number).alias("set"), F.col("fp").bitwiseAND(F.lit(mask)).alias("bytes")))
    return classes.select("seed", "fp", "copies", F.explode(F.array(*keys)).alias("key")).select("seed", "fp", "copies", "key.set", "key.bytes")


def _near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Which of ``b`` link with ``a``: count filter over shared positional bytes, then the differing bits."""
    x = (a ^ b).view(np.uint64)
    shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)
    out = shared >= 8 - bits
    out[out] = np.bitwise_count(x[out]) <= bits
    return out


def forest(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links (member, member) that connect what is connected within one list, fewer than members."""
    left = np.unique(fps)
    out = []
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            a = frontier.pop()
            hit = _near(a, left, bits)
            if hit.any():
                found = left[hit]
                left = left[~hit]
                out.extend((int(a), int(b)) for b in found)
                frontier.extend(found)
    return out


def bridges(a: np.ndarray, b: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links between two blocks that connect what their mutual links connect, fewer than members: a search across both from each part."""
    left, out = [np.unique(a), np.unique(b)], []
    while len(left[0]) and len(left[1]):
        frontier, left[0] = [(0, left[0][0])], left[0][1:]
        while frontier:
            side, x = frontier.pop()
            others = left[1 - side]
            hit = _near(x, others, bits)
            if hit.any():
                left[1 - side] = others[~hit]
                out.extend((int(y), int(x)) if side else (int(x), int(y)) for y in others[hit])
                frontier.extend((1 - side, y) for y in others[hit])
    return out


_LINKS = "seed int, a long, b long"


def _short_lists(rows: np.ndarray, bits: int, most: int) -> pd.DataFrame:
    """Links of whole lists, from rows (set, bytes, seed, fp) sorted by list: lists of up to ``TALLY`` members all at once, shift by shift."""
    key, seed, fp = rows[:, :2], rows[:, 2], rows[:, 3]
    starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)])) if len(rows) else np.empty(0, np.int64)
    sizes = np.diff(np.concatenate([starts, [len(fp)]]))
    out = []
    ends = np.repeat(starts + sizes, sizes)
    at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= TALLY), sizes))
    for shift in range(1, TALLY):
        at = at[at + shift < ends[at]]
        if not len(at):
            break
        hit = at[_near(fp[at], fp[at + shift], bits)]
        out.append(np.column_stack([seed[hit], fp[hit], fp[hit + shift]]))
    for i in np.flatnonzero((sizes > TALLY) & (sizes <= most)):
        out.append(_frame(forest(fp[starts[i] : starts[i] + sizes[i]], bits), int(seed[starts[i]])).to_numpy())
    return pd.DataFrame(np.concatenate(out) if out else np.empty((0, 3), np.int64), columns=["seed", "a", "b"])


def _frame(pairs, seed: int) -> pd.DataFrame:
    ab = np.array(pairs, np.int64).reshape(-1, 2)
    return pd.DataFrame({"seed": np.full(len(ab), seed, np.int64), "a": ab[:, 0], "b": ab[:, 1]})


def links(classes: DataFrame, bits: int = BITS, most: int = MOST) -> DataFrame:
    """``seed, a, b``: links that span, for each seed, the components of its distinct fingerprints (rows seed, fp, copies)."""
    # few files would make few tasks of the index's many rows
    parts = max(SPREAD, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    classes = materialize(classes.repartition(parts, "fp"), "spread")
    index = _index(classes, bits)
    lists = index.groupBy("set", "bytes").agg(F.count(F.lit(1)).alias("members"), F.max(F.struct("copies", "fp"))["fp"].alias("pivot")).where(F.col("members") > most)
    lists = materialize(lists.withColumn("weight", F.col("members")), "lists")
    total = classes.count() * len(position_sets(bits))

    def stream(batches):
        rest = np.empty((0, 4), np.int64)
        for pdf in batches:
            rows = np.concatenate([rest, pdf[["set", "bytes", "seed", "fp"]].to_numpy(np.int64)])
            last = int(np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(1)).max(initial=-1)) + 1 if len(rows) else 0
            # of a list that may go on, no more is held than shows that it is too long for this way
            rest = rows[last : last + most + 1]
            yield _short_lists(rows[:last], bits, most)
        yield _short_lists(rest, bits, most)

    # lists of over a thousandth of the rows, fewer than a thousand, are not dealt to one task at all
    hot = lists.where(F.col("members") * HOT_SHARE > total).select("set", "bytes")
    flat = index.join(F.broadcast(hot), ["set", "bytes"], "left_anti").select("set", "bytes", "seed", "fp")
    out = flat.repartition("set", "bytes").sortWithinPartitions("set", "bytes").mapInPandas(stream, _LINKS)
    if lists.count():
        large = materialize(join_by_weight(index.drop("copies"), lists, ["set", "bytes"], "weight", total), "large")
        out = out.unionByName(_large_lists(large, bits, most))
    return out.distinct()


def _large_lists(large: DataFrame, bits: int, most: int) -> DataFrame:
    """Links of lists (set, bytes, seed, fp, members, pivot) that are too long for a task.

    Members near their list's pivot are linked with it, which connects them all. What is left are pairs of
    a near and a far member, and pairs of far members; both are compared block by block.
    """
    key = ["set", "bytes"]
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot"))) <= bits
    large = large.withColumn("near", near)
    star = large.where("near and fp <> pivot").select("seed", F.col("pivot").alias("a"), F.col("fp").alias("b"))
    sizes = large.groupBy(*key).agg(F.count_if("near").alias("n_near"), F.count_if(~F.col("near")).alias("n_far"), F.count(F.lit(1)).alias("weight")).where("n_far > 0")
    sizes = materialize(sizes, "sizes")
    total = sizes.agg(F.sum("weight")).first()[0]
    if not total:
        return star
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / most)).cast("int")
    rows = join_by_weight(large.drop("pivot", "members"), sizes, key, "weight", total)
    rows = rows.withColumn("nb", blocks("n_near")).withColumn("fb", blocks("n_far")).withColumn("block", F.pmod(F.xxhash64("fp"), F.when(F.col("near"), F.col("nb")).otherwise(F.col("fb"))).cast("int"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1)).alias("other")
    own = [*key, "seed", "fp"]
    mixed = rows.where("near").select(*own, F.lit(0).alias("side"), F.col("block").alias("i"), upto("fb")).withColumnRenamed("other", "j").unionByName(
        rows.where("not near").select(*own, F.lit(1).alias("side"), F.col("block").alias("j"), upto("nb")).withColumnRenamed("other", "i")
    ).withColumn("kind", F.lit(0))
    far = rows.where("not near").select(*own, "block", upto("fb")).select(
        *own, (F.col("block") > F.col("other")).cast("int").alias("side"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.lit(1).alias("kind")
    )

    def between(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (np.unique(pdf.fp[pdf.side == s].to_numpy(np.int64)) for s in (0, 1))
        if pdf.kind.iloc[0] and pdf.i.iloc[0] == pdf.j.iloc[0]:
            return _frame(forest(a, bits), int(pdf.seed.iloc[0]))
        return _frame(bridges(a, b, bits), int(pdf.seed.iloc[0]))

    return star.unionByName(mixed.unionByName(far).groupBy(*key, "kind", "i", "j").applyInPandas(between, _LINKS))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b): root is the smallest node of its component.

    Alternating large-star and small-star steps; each step is a table in the shared folder.
    """
    both = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        two = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _lowest(two, F.least("a", "m")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "large")
        small = _lowest(large, F.col("m")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        both = materialize(small, "edges")
        now = both.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components have not settled")
    return both.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(both.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _lowest(edges: DataFrame, m) -> DataFrame:
    """``a, b, m``: each edge with the smallest neighbour of ``a``; nodes of very many edges make no large task."""
    low = materialize(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", m), "lowest")
    total = low.agg(F.sum("n")).first()[0] or 0
    return join_by_weight(edges, low, ["a"], "n", total)


def classes_of(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """``fps, component_id, n`` (rows) for rows (doc_id, fps): components of fingerprints under one or more seeds.

    ``fps`` holds one fingerprint for each seed; the class of a row is the array itself.
    """
    first = rows.groupBy("fps").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    width = rows.select(F.max(F.size("fps"))).first()[0] or 0
    # of one seed the fingerprint is its own node, of several a hash of class or (seed, fingerprint)
    node = F.col if width == 1 else (lambda c: F.xxhash64("seed", F.lit("fp"), F.col(c)))
    first = materialize(first.withColumn("class", F.col("fps")[0] if width == 1 else F.xxhash64("fps")), "classes")
    if not width:
        return first.select("fps", F.col("first").alias("component_id"), F.col("copies").alias("n"))
    each = first.select("class", "copies", F.posexplode("fps").alias("seed", "fp"))
    distinct = materialize(each.groupBy("seed", "fp").agg(F.sum("copies").alias("copies")), "fingerprints")
    found = links(distinct, bits).select(node("a").alias("a"), node("b").alias("b"))
    if width > 1:
        found = found.unionByName(each.select(F.col("class").alias("a"), node("fp").alias("b")))
    roots = components(found).withColumnRenamed("node", "class")
    named = materialize(first.join(roots, "class", "left").select("fps", "first", "copies", F.coalesce("root", "class").alias("root")), "named")
    ids = materialize(named.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("w")), "ids")
    total = ids.agg(F.sum("w")).first()[0] or 0
    return join_by_weight(named, ids, ["root"], "w", total).select("fps", "component_id", F.col("copies").alias("n"))


def near_duplicates(docs: DataFrame, words: int = WORDS, seeds: Sequence[int] = (SEED,), bits: int = BITS) -> DataFrame:
    """``doc_id, fps, component_id`` for each row of ``docs`` (doc_id, text)."""
    prepare(docs.sparkSession)
    rows = materialize(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), words=words, seeds=seeds, column="fps").select("doc_id", "fps"), "fps")
    classes = materialize(classes_of(rows, bits), "components")
    return join_by_weight(rows, classes, ["fps"], "n", rows.count())


def keep_one(docs: DataFrame, words: int = WORDS, seeds: Sequence[int] = (SEED,), bits: int = BITS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, of rows that repeat it the first.

    Rows are numbered in a table that is written once, so each later reading sees the same numbers whatever the
    cluster does. Only fingerprints and ids are exchanged; the kept rows are taken by a bit map of their numbers.
    """
    refuse_clash(docs, ["__row", "__fps"])
    prepare(docs.sparkSession)
    stored = materialize(fingerprints(docs, words=words, seeds=seeds, column="__fps").withColumn("__row", F.monotonically_increasing_id()), "numbered")
    rows = stored.select("__row", F.col("doc_id").cast("long").alias("doc_id"), F.col("__fps").alias("fps"))
    classes = materialize(classes_of(rows, bits), "components")
    met = join_by_weight(rows, classes, ["fps"], "n", rows.count())
    # a null id comes after all others
    first = F.min_by("__row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row"))
    by = F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("fps")).alias("fps"))
    kept = met.withColumn("by", by).groupBy("by").agg(first.alias("__row")).select("__row")
    return rows_in(stored, kept).select(docs.columns)


def op4_simhash_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex(F.col("fps")[0]), 16, "0")).alias("fingerprint"), "component_id")
