"""Exact deduplication behind a two-pass Bloom filter, with DataFrame functions alone.

Pass one hashes every normalised text to ``HASHES`` bit positions and counts the rows of each position
before and after a small exchange of (position, count) rows. Positions met by two or more rows make up a
Bloom filter of possibly repeated hashes; it is a bit map of at most ``MOST_BITS`` bits, whatever the input
(the proven size bound of its broadcast). Pass two tests every row: one position that was met once proves
a text unique, and the row passes straight through. Only the rest is exchanged and grouped by SHA-256.

Larger inputs than the filter is made for raise its false positive rate; more rows are then exchanged,
and results stay whole. Groups that hold over a thousandth of the compared rows number at most a thousand;
they are joined by broadcast, the others by exchange, so no task gets a hot group.

Texts are equal when identical after lower-casing A-Z. Null counts as empty; empty texts equal each other.
Of equal texts the row of the largest id stays; a null id is smaller than any other; of rows that repeat
text and id, one stays (``kept``), chosen by the row order of the input files. An empty table gives no
rows. Columns of the input pass through; those named like a new one are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ._common import bit_is_set, bitmap_of, bitmap_word, join_by_weight, lower_az, materialize, refuse_clash, table

HASHES = 2
MOST_BITS = 1 << 28
WORD = 1 << 15  #: bits of one row of Spark's bit maps


def filter_bits(rows: int) -> int:
    """A power of two of 16 positions a row, between 2**16 and the bound."""
    return min(MOST_BITS, max(1 << 16, 1 << (16 * max(1, rows) - 1).bit_length()))


def _positions(digest: Column, bits: int) -> list[Column]:
    """Bit positions of a hex digest, from disjoint parts of it."""
    return [F.conv(F.substring(digest, 1 + 14 * i, 14), 16, 10).cast("long").bitwiseAND(F.lit(bits - 1)) for i in range(HASHES)]


def repeat_filter(digests: DataFrame, digest: str, bits: int) -> DataFrame:
    """``word, map``: the bit map of the positions that two or more rows share."""
    each = digests.select(F.explode(F.array(*[F.struct(F.lit(i).alias("h"), p.alias("p")) for i, p in enumerate(_positions(F.col(digest), bits))])).alias("x"))
    often = each.groupBy("x.h", "x.p").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return often.groupBy("h", bitmap_word(F.col("p")).alias("word")).agg(bitmap_of(F.col("p")).alias("map"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` (its text only if asked for) with ``keep_id, group_size, kept, text_sha256``."""
    refuse_clash(docs, ["keep_id", "group_size", "kept", "text_sha256", "__row", "__hit"])
    rows = docs.withColumn("text_sha256", F.sha2(lower_az(F.col(text)).cast("binary"), 256))
    if not keep_text:
        rows = rows.drop(text)
    rows = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "digests")
    n = rows.count()
    bits = filter_bits(n)
    repeats = materialize(repeat_filter(rows, "text_sha256", bits), "bloom")
    tested = rows
    hit = F.lit(True)
    for i, p in enumerate(_positions(F.col("text_sha256"), bits)):
        # at most bits / 2**15 rows of 4 KiB
        words = repeats.where(F.col("h") == i).select(F.col("word").alias(f"__w{i}"), F.col("map").alias(f"__m{i}"))
        tested = tested.join(F.broadcast(words), bitmap_word(p) == F.col(f"__w{i}"), "left")
        hit = hit & bit_is_set(F.col(f"__m{i}"), p)
    tested = tested.withColumn("__hit", hit).drop(*[f"__{k}{i}" for k in "wm" for i in range(HASHES)])
    alone = tested.where(~F.col("__hit")).select(
        "*", F.col(doc_id).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
    )
    some = tested.where("__hit")
    groups = materialize(
        some.groupBy("text_sha256").agg(F.max(F.struct(F.col(doc_id).alias("id"), F.col("__row").alias("row"))).alias("best"), F.count(F.lit(1)).alias("group_size")), "groups"
    )
    compared = groups.agg(F.sum("group_size")).first()[0] or 0
    facts = groups.select("text_sha256", F.col("best.id").alias("keep_id"), "group_size", F.col("best.row").alias("__best"), F.col("group_size").alias("__n"))
    joined = join_by_weight(some, facts, ["text_sha256"], "__n", compared)
    joined = joined.withColumn("kept", F.col("__row") == F.col("__best")).drop("__best")
    return alone.unionByName(joined).drop("__row", "__hit")


def op5_bloom_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
