"""Shared plumbing of the text operators: code shipping, shared storage, small native expressions."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
_SHIPPED = "_dependra_llm_shipped"
SAMPLE_PARTS = 24
MAP_BYTES = 1 << 25  #: most bytes of bit maps of row numbers that are broadcast
LONGEST_CACHED = 64  #: characters of a token that workers may keep in a cache, so that its size in bytes is bounded


def prepare(spark: SparkSession) -> None:
    """Make this package importable on executors: an archive that the driver serves."""
    sc = spark.sparkContext
    if getattr(sc, _SHIPPED, False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(os.path.realpath(tempfile.mkdtemp(prefix="dependra-"))) / "dependra_src.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(target))
    setattr(sc, _SHIPPED, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where none is named, a session of one machine (tests, a laptop) takes a folder of its own; on a cluster
    that is an error, since executors would write to disks that nobody else reads.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="dependra-checkpoints-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the running stage alone, and what is expensive
    (tokenizing, hashing) is not run again by each later use.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/dependra-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(text: Column) -> Column:
    """Null as empty, A-Z to a-z, every other character as it is."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as remainder 0 of an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, bound: int) -> DataFrame:
    """At most ``bound`` labelled training rows, as a broadcast join of their ids with ``docs``.

    ``keep`` says over ``doc_id`` which rows may be learned from. The sample is a hash order of ids, so it
    neither depends on partitions nor on row order. Ids with contradicting or null labels are left out.
    Of rows that repeat an id the one of the smallest text hash (ties: the smaller text) is taken, so rows are
    bounded too. Only (id, label) pairs of the bounded sample reach the driver. Returns ``doc_id, text, y``, written
    once: later passes read the sample and not the documents.
    """
    spark = docs.sparkSession
    pairs = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & keep)
        .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y2"))
        .where("y = y2")
    )
    n = pairs.count()
    order = F.xxhash64(F.lit("sample"), "doc_id")
    if n > bound:
        share = bound / n
        pairs = pairs.where(F.pmod(order, F.lit(1 << 30)) < int((1 << 30) * share))
    rows = sorted((r.h, r.doc_id, r.y) for r in pairs.select(order.alias("h"), "doc_id", "y").collect())[:bound]
    ids = spark.createDataFrame([(d, y) for _, d, y in rows] or [], "doc_id long, y int")
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    one = met.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.min("y").alias("y"))
    # dealt over tasks by number, since a few texts may hold most of the sample's characters
    return materialize(one.repartition(SAMPLE_PARTS, "doc_id"), "sample")


def refuse_clash(df: DataFrame, new) -> None:
    """An error where ``df`` has a column named like one that an operator adds (Spark ignores letter case)."""
    have = {c.lower() for c in df.columns}
    if clash := sorted(c for c in new if c.lower() in have):
        raise ValueError(f"columns named {clash} are there already; rename them first")


def rows_in(stored: DataFrame, chosen: DataFrame, row: str = "__row", both: bool = False):
    """The rows of ``stored`` whose number ``row`` is in ``chosen``, without an exchange of ``stored``; with ``both`` the others too.

    The chosen numbers become bit maps of 2**15 positions, one bit a row where numbers follow one another.
    Up to ``MAP_BYTES`` of them are broadcast and each row is tested in place; more go by exchange.
    """
    maps = materialize(chosen.groupBy(bitmap_word(F.col(row)).alias("__word")).agg(bitmap_of(F.col(row)).alias("__map")), "rows")
    if maps.count() * 4096 > MAP_BYTES:
        numbers = chosen.select(row).distinct().hint("shuffle_hash")
        inside, others = stored.join(numbers, row, "left_semi"), stored.join(numbers, row, "left_anti")
    else:
        met = stored.join(F.broadcast(maps), bitmap_word(F.col(row)) == F.col("__word"), "left")
        hit = bit_is_set(F.col("__map"), F.col(row))
        inside, others = met.where(hit).drop("__word", "__map"), met.where(~hit).drop("__word", "__map")
    return (inside, others) if both else inside


def bitmap_word(position: Column) -> Column:
    """The row of a bit map, 2**15 positions each, that holds a position."""
    return F.bitmap_bucket_number(position)


def bitmap_of(position: Column) -> Column:
    """Aggregate: the bit map of the positions of one row."""
    return F.bitmap_construct_agg(F.bitmap_bit_position(position))


def bit_is_set(bitmap: Column, position: Column) -> Column:
    """Whether a position's bit is set; false without a bit map."""
    at = F.bitmap_bit_position(position)
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))


HOT_SHARE = 1000
HOT_ROWS = 10_000  #: fewer rows of a key make no task large, whatever their share


def join_by_weight(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """Join with ``right``, whose key is unique and whose ``weight`` is the key's number of rows in ``left``.

    Keys of more than a thousandth of ``total`` rows (and more than ``HOT_ROWS``) number fewer than a thousand:
    they are joined by broadcast, whose size is thus bounded. Every other key goes by exchange, and none of those
    can make a task large. ``left`` is read twice, if there are such keys, and should be a table, as should
    ``right``. ``weight`` is dropped.
    """
    others = [c for c in right.columns if c not in on and c != weight]
    heavy = (F.col(weight) * HOT_SHARE > F.lit(int(total))) & (F.col(weight) > HOT_ROWS)
    if total <= HOT_ROWS or right.where(heavy).isEmpty():
        return left.join(right.drop(weight), on, how)
    hot = right.where(heavy).drop(weight).withColumn("__heavy", F.lit(True))
    met = left.join(F.broadcast(hot), on, "left")
    rest = met.where(F.col("__heavy").isNull()).drop("__heavy", *others).join(right.where(~heavy).drop(weight), on, how)
    return met.where("__heavy").drop("__heavy").unionByName(rest)
