"""Best-fit packing of token sequences with certified bin counts.

Documents become token ids with an end id; only those longer than a sequence are cut, into full pieces
after a shorter first one. Full pieces are sequences by themselves. The other pieces are dealt evenly to
groups of bounded size, and each group is packed by best-fit decreasing over its residual spaces.

A dual-feasible-function bound certifies each group: for every threshold t up to half a sequence, pieces
longer than L - t count as whole sequences, pieces shorter than t as nothing, the rest by length; the largest rounded-up sum is a lower bound of any packing. A
group whose bin count exceeds its bound has a gap. Groups with gaps give up the pieces of their bins that
are not full; these are dealt anew into mixed groups, packed again, and the outcome is kept where it takes
fewer bins than before. Rounds end when no gap is left, none was closed, or after ``ROUNDS``.

Edge cases: null and empty texts hold the end id alone and are one piece of length 1; repeated rows are
pieces of their own; an empty table gives no rows. Offsets are gapless from 0 within a sequence.
Other columns of the pieces pass through; one named ``row`` or like a new one is an error.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._common import materialize, prepare, refuse_clash, table

LENGTH = 1024
END_ID = 2
GROUP = 6_000  #: pieces packed by one task: bounds its memory
ROUNDS = 3
ID_BITS = 24  #: bins of a group, so that a sequence id is (round, group, bin)


class Tokens:
    """Ids of the ``tokenizers`` vocabulary.

    Its rank file holds the same vocabulary, and tiktoken gives the same ids several times faster. The one
    difference is the special token's own string in a text; such texts go through ``tokenizers`` itself.
    """

    def __init__(self, json_bytes: bytes, rank_bytes: bytes | None, pattern: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_buffer(json_bytes)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if rank_bytes is not None:
            import base64
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in rank_bytes.splitlines() if x.strip())}
            self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")


_TOKENS: dict[str, Tokens] = {}


def tokens_of(content: tuple[bytes, bytes | None, str]) -> Tokens:
    key = hashlib.sha256(content[0]).hexdigest()
    if key not in _TOKENS:
        _TOKENS[key] = Tokens(*content)
    return _TOKENS[key]


def cuts(total: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``total`` ids."""
    if total <= length:
        return [(0, total)]
    first = total % length or length
    return [(0, first)] + [(s, length) for s in range(first, total, length)]


def _pieces(batches, cast, length: int, end_id: int):
    import pyarrow as pa

    t = tokens_of(cast.value)
    end = np.array([end_id], "<u4")
    for b in batches:
        out = ([], [], [], [], [])
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            ids = np.concatenate([t.ids(text or ""), end]).astype("<u4")
            for n, (start, size) in enumerate(cuts(len(ids), length)):
                for column, v in zip(out, (doc_id, n, start, size, zlib.crc32(ids[start : start + size].tobytes()))):
                    column.append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"]
        )


def pieces(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str = "", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every whole text of ``docs`` (doc_id, text)."""
    prepare(docs.sparkSession)
    content = tuple(open(p, "rb").read() if p else None for p in (json_path, ranks_path))
    cast = docs.sparkSession.sparkContext.broadcast((*content, pattern))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda it: _pieces(it, cast, length, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def best_fit_decreasing(sizes: np.ndarray, length: int) -> np.ndarray:
    """Bin numbers of the sizes. Open bins are stacked by residual space; a bit set finds the tightest that fits."""
    bins = np.empty(len(sizes), np.int64)
    stacks: list[list[int]] = [[] for _ in range(length + 1)]
    spaces = 0  # bit r: a bin with r left
    n = 0
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        fit = spaces >> s
        if fit:
            r = s + (fit & -fit).bit_length() - 1
            b = stacks[r].pop()
            if not stacks[r]:
                spaces &= ~(1 << r)
        else:
            r, b = length, n
            n += 1
        bins[i] = b
        if left := r - s:
            stacks[left].append(b)
            spaces |= 1 << left
    return bins


def lower_bound(sizes: np.ndarray, length: int) -> int:
    """The best of the threshold family of dual feasible functions, over the histogram of the sizes."""
    count = np.bincount(sizes.astype(np.int64), minlength=length + 1)[: length + 1]
    many, mass = np.cumsum(count), np.cumsum(count * np.arange(length + 1))
    best = -(-int(mass[-1]) // length)
    for t in range(1, length // 2 + 1):
        large = int(many[-1] - many[length - t])  # longer than length - t
        middle = int(mass[length - t] - mass[t - 1])  # from t to length - t
        best = max(best, large + -(-middle // length))
    return best


def _pack(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """One group: new bins, kept only if fewer than the bins that its pieces came in."""
    pdf = pdf.sort_values(["length", "row"], ascending=[False, True], kind="stable").reset_index(drop=True)
    sizes = pdf.length.to_numpy(np.int64)
    bins = best_fit_decreasing(sizes, length)
    bound = lower_bound(sizes, length)
    number = (pdf.deal.to_numpy(np.int64) << ID_BITS) + bins
    used = int(bins.max()) + 1
    if pdf.seq.notna().all() and pdf.seq.nunique() <= used:
        number, used = pdf.seq.to_numpy(np.int64), int(pdf.seq.nunique())
    fill = pd.Series(sizes).groupby(number).transform("sum").to_numpy()
    return pd.DataFrame({"row": pdf.row, "length": sizes, "seq": number, "open": (fill < length) if used > bound else np.zeros(len(pdf), bool), "gap": used - bound})


def _deal(rows: DataFrame, groups: int, round_: int, length: int) -> DataFrame:
    """Pack rows (row, length, seq) in ``groups`` mixed groups; pieces of one old bin stay together."""
    unit = F.coalesce("seq", "row")
    deal = F.lit(round_ << 32).cast("long") + F.pmod(F.xxhash64(F.lit(round_), unit), F.lit(groups))
    return rows.select("row", "length", "seq", deal.alias("deal")).groupBy("deal").applyInPandas(lambda pdf: _pack(pdf, length), "row long, length long, seq long, open boolean, gap long")


def pack(found: DataFrame, length: int = LENGTH, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """``found`` (as of :func:`pieces`, extra columns allowed) with ``sequence_id`` and ``offset``."""
    refuse_clash(found, ["row", "sequence_id", "offset"])
    found = materialize(found.withColumn("row", F.monotonically_increasing_id()), "pieces")
    whole = F.col("length") >= length
    full = found.where(whole).select("row", "length", F.col("row").alias("seq"))
    rest = found.where(~whole).select("row", "length", F.lit(None).cast("long").alias("seq"))
    settled, n = [], rest.count()
    for round_ in range(1, rounds + 1):
        packed = materialize(_deal(rest, max(1, -(-n // group)), round_, length), "packed")
        state = packed.agg(F.count_if("open").alias("open"), F.count(F.lit(1)).alias("n")).first()
        last = round_ == rounds or not state.open or state.n <= group
        settled.append(packed.where(~F.col("open") | F.lit(last)).select("row", "length", "seq"))
        if last:
            break
        rest, n = packed.where("open").select("row", "length", "seq"), state.open
    bins = settled[0]
    for more in settled[1:]:
        bins = bins.unionByName(more)
    # the top bit of a full piece's number keeps it apart from (round, group, bin) numbers
    placed = bins.withColumn("sequence_id", F.col("seq")).unionByName(full.withColumn("sequence_id", F.col("seq").bitwiseOR(F.lit(1 << 62)))).select("row", "sequence_id", "length")
    offsets = _offsets(placed)
    return found.join(offsets, "row").drop("row")


def _offsets(placed: DataFrame) -> DataFrame:
    """Places within a sequence: a sum over its pieces, which are at most as many as it has tokens."""
    from pyspark.sql import Window

    w = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "row").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("row", "sequence_id", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long").alias("offset"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """The production packing: the public byte-level vocabulary, sequences of 1024 tokens."""
    import public_tokenizers as p

    return pack(pieces(docs, p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN))


def op7_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
