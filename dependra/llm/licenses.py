"""Licence notices: exact phrases, and short notices with a bounded number of edits.

A text is lower-cased (A-Z only) and cut into words of digits, a-z and everything beyond ASCII; the words
joined by single spaces are the searched form. Exact places are those where a phrase's words stand
consecutively. For the fuzzy search each notice of e allowed edits is cut into e + 1 seeds: by the
pigeonhole principle one of them stands unchanged in every match. Each place of a seed gives a window, in
which the ``regex`` library's bounded-error matching verifies the edits; hits start and end at word bounds.

Edge cases: null counts as empty, which has no words, no places, empty label lists, null first and last
word and score 0. Very long texts are searched whole. Rows and other columns pass through;
columns named like a new one are an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import regex
from pyspark.sql import DataFrame, SparkSession

from ._common import prepare, refuse_clash, table

#: Exact phrases of the base search and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Short notices of the fuzzy search: text, label, allowed edits.
NOTICES = (
    ("under the mit license", "mit", 2),
    ("permission is hereby granted free of charge", "mit", 4),
    ("apache license version 2", "apache-2", 2),
    ("gnu general public license", "gpl", 2),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("mozilla public license", "mpl", 2),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("under the bsd license", "bsd", 1),
    ("creative commons attribution noncommercial", "cc-by-nc", 3),
    ("boost software license", "boost", 2),
    ("eclipse public license", "epl", 2),
    ("all rights reserved", "all-rights-reserved", 1),
)
#: bytes that are no part of a word become spaces
_TO_SPACE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def normal_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().translate(_TO_SPACE).split()


def seeds(notice: str, edits: int) -> list[tuple[int, str]]:
    """``edits`` + 1 parts of a notice with their places."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:]) if a < b]


@dataclass(frozen=True)
class Hit:
    label: str
    first: int  # words from 0
    last: int
    edits: int


class Scanner:
    def __init__(self, base=BASE, notices=NOTICES):
        self.base = [(f" {p} ".encode(), label, len(p.split())) for p, label in base]
        self.notices = [
            (n, label, e, [(o, s.encode()) for o, s in seeds(n, e)], regex.compile(rf"(?e)(?<=^| )(?:{regex.escape(n, special_only=True)}){{e<={e}}}(?=$| )"))
            for n, label, e in notices
        ]

    def scan(self, text: str):
        """Number of words, exact places (label, first word, last word) and fuzzy hits of one whole text."""
        words = normal_words(text)
        if not words:
            return 0, [], []
        joined = b" " + b" ".join(words) + b" "
        exact = []
        for phrase, label, n in self.base:
            at, before, first = joined.find(phrase), 0, 0
            while at >= 0:
                first += joined.count(b" ", before, at)
                before = at
                exact.append((label, first, first + n - 1))
                at = joined.find(phrase, at + 1)
        return len(words), exact, list(self._fuzzy(joined))

    def _fuzzy(self, joined: bytes):
        for notice, label, e, parts, pattern in self.notices:
            windows = []
            for offset, seed in parts:
                at = joined.find(seed)
                while at >= 0:
                    windows.append((max(0, at - offset - e - 1), min(len(joined), at - offset + len(notice) + e + 1)))
                    at = joined.find(seed, at + 1)
            done, before, spaces = 0, 0, 0
            for a, b in merged(windows):
                if b - a < len(notice) - e:
                    continue
                # whole words at both ends, so that no character is cut
                a = joined.rfind(b" ", 0, a + 1) + 1
                b = (joined.find(b" ", b - 1) + 1 or len(joined) + 1) - 1
                window = joined[a:b].decode("utf-8", "replace").strip(" ")
                spaces += joined.count(b" ", before, a)
                before, base = a, spaces - 1
                for m in pattern.finditer(window):
                    first = base + window.count(" ", 0, m.start())
                    last = first + m.group().count(" ")
                    if first >= done:
                        done = last + 1
                        yield Hit(label, first, last, sum(m.fuzzy_counts))


def merged(windows):
    """Overlapping windows as one, in order."""
    out = []
    for a, b in sorted(windows):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _each(batches, text, notices):
    import pyarrow as pa

    s = Scanner(notices=notices)
    for b in batches:
        rows = [s.scan(t or "") for t in b.column(text).to_pylist()]
        n = pa.array([r[0] for r in rows], pa.int64())
        exact = pa.array([[{"label": x, "first": f, "last": l} for x, f, l in r[1]] for r in rows], pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())])))
        fuzzy = pa.array([[{"label": h.label, "first": h.first, "last": h.last, "edits": h.edits} for h in r[2]] for r in rows], pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("edits", pa.int32())])))
        keep = [i for i, c in enumerate(b.schema.names) if c != text]
        yield pa.RecordBatch.from_arrays([b.column(i) for i in keep] + [n, exact, fuzzy], [b.schema.names[i] for i in keep] + ["lic_words", "lic_exact", "lic_hits"])


def scan(docs: DataFrame, text: str = "text", notices=NOTICES) -> DataFrame:
    """The other columns of ``docs`` with ``lic_words``, ``lic_exact`` (spans) and ``lic_hits`` (spans with edits)."""
    refuse_clash(docs.drop(text), ["lic_words", "lic_exact", "lic_hits"])
    prepare(docs.sparkSession)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text)
    schema = (kept + ", " if kept else "") + "lic_words long, lic_exact array<struct<label:string,first:bigint,last:bigint>>, lic_hits array<struct<label:string,first:bigint,last:bigint,edits:int>>"
    return docs.mapInArrow(lambda it: _each(it, text, notices), schema)


def op6_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    got = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = F.array_sort(F.array_distinct(F.concat(F.transform("lic_exact", lambda h: h["label"]), F.transform("lic_hits", lambda h: h["label"]))))
    base = F.array_sort(F.array_distinct(F.transform("lic_exact", lambda h: h["label"])))
    return got.select(
        "doc_id", F.col("lic_words").alias("n_words"), F.size("lic_exact").cast("long").alias("n_base"),
        F.array_min(F.transform("lic_exact", lambda h: h["first"])).alias("first_word"),
        F.array_max(F.transform("lic_exact", lambda h: h["first"])).alias("last_word"),
        F.concat_ws(",", base).alias("base_labels"), F.concat_ws(",", labels).alias("labels"),
        F.when(F.size("lic_exact") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("lic_hits", lambda h: 1.0 / (1.0 + h["edits"]))), F.lit(0.0))).alias("score"),
    )
