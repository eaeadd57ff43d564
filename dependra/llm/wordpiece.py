"""Word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie of initial pieces with a second root for continuation pieces. Every node has a
failure link, and beside it the *number* of pieces that are settled when the link is taken, so a word's
greedy longest-match length comes out of one pass over its characters without a piece being built.

Words are cut at white space, and punctuation signs are words of their own; letters are lower-cased first.
A word that the vocabulary cannot spell counts as one unknown token. Edge cases: a null or empty text has
no words and no tokens; other columns pass through, and those named like a new one are an error; a vocabulary without pieces makes every word unknown.
"""

from __future__ import annotations

import re
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._common import LONGEST_CACHED, prepare, refuse_clash, table

CACHE = 200_000
_CUT = re.compile(r"[^\W_]+|[^\w\s]|_")


class Automaton:
    """``step``: (node, character) -> node; ``fail`` (-1: none) and ``popped`` by node. 0 and 1 are the roots."""

    def __init__(self, initial: set[str], continuation: set[str]):
        step: dict[tuple[int, str], int] = {}
        ends: set[int] = set()
        parent, letter, size = [-1, -1], ["", ""], 2
        for root, words in ((0, initial), (1, continuation)):
            for word in sorted(words):
                node = root
                for ch in word:
                    child = step.get((node, ch))
                    if child is None:
                        child = step[(node, ch)] = size
                        parent.append(node)
                        letter.append(ch)
                        size += 1
                    node = child
                if node > 1:
                    ends.add(node)
        children: list[list[int]] = [[] for _ in range(size)]
        for (node, _), child in step.items():
            children[node].append(child)
        fail, popped = [-1] * size, [0] * size
        todo = deque(children[0] + children[1])
        while todo:
            v = todo.popleft()
            todo.extend(children[v])
            if v in ends:
                fail[v], popped[v] = 1, 1
                continue
            z, n = fail[parent[v]], popped[parent[v]]
            while z >= 0 and (z, letter[v]) not in step:
                n += popped[z]
                z = fail[z]
            if z >= 0:
                fail[v], popped[v] = step[(z, letter[v])], n
        self.step, self.fail, self.popped = step, fail, popped

    def length(self, word: str) -> int:
        """Number of pieces of a word; 0 if it cannot be spelt."""
        step, fail, popped = self.step, self.fail, self.popped
        node = n = 0
        for ch in word:
            while (child := step.get((node, ch))) is None:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return 0
            node = child
        while node != 1:
            n += popped[node]
            node = fail[node]
            if node < 0:
                return 0
        return n


def pieces_of(model_path: str) -> tuple[set[str], set[str]]:
    """Initial and continuation pieces of a sentence-piece vocabulary: those with its space mark, and the rest.

    Control, unknown and byte pieces are left out, and so is what is not lower case.
    """
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model_path)
    initial, continuation = set(), set()
    for i in range(p.get_piece_size()):
        if p.is_control(i) or p.is_unknown(i) or p.is_byte(i):
            continue
        piece = p.id_to_piece(i)
        word = piece.removeprefix("▁")
        if word and "▁" not in word and word == word.lower():
            (initial if piece != word else continuation).add(word)
    # a sign that may continue a word may also start one
    initial |= {w for w in continuation if len(w) == 1}
    return initial, continuation


class Counter(dict):
    """(words, tokens, unknown) of whitespace-separated tokens seen lately; cleared when full."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, token):
        if len(self) >= CACHE:
            self.clear()
        words = _CUT.findall(token)
        lengths = [self.automaton.length(w) for w in words]
        v = (len(words), sum(max(1, x) for x in lengths), sum(x == 0 for x in lengths))
        if len(token) <= LONGEST_CACHED:
            self[token] = v
        return v

    def count(self, text: str) -> tuple[int, int, int]:
        tokens = text.lower().split()
        if not tokens:
            return 0, 0, 0
        return tuple(map(sum, zip(*map(self.__getitem__, tokens))))


_COUNTERS: dict[int, Counter] = {}


def count_tokens(docs: DataFrame, initial: set[str], continuation: set[str], text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with ``{prefix}n_words``, ``{prefix}n_tokens``, ``{prefix}n_unknown`` of each whole text; no shuffle."""
    refuse_clash(docs, [prefix + n for n in ("n_words", "n_tokens", "n_unknown")] + ["__wp"])
    spark = docs.sparkSession
    prepare(spark)
    cast = spark.sparkContext.broadcast((sorted(initial), sorted(continuation)))
    key = hash((tuple(sorted(initial)), tuple(sorted(continuation))))

    @F.pandas_udf("n_words long, n_tokens long, n_unknown long")
    def apply(texts: pd.Series) -> pd.DataFrame:
        if key not in _COUNTERS:
            _COUNTERS[key] = Counter(Automaton(*map(set, cast.value)))
        c = _COUNTERS[key]
        return pd.DataFrame([c.count(t or "") for t in texts], columns=["n_words", "n_tokens", "n_unknown"])

    got = docs.withColumn("__wp", apply(F.col(text)))
    for name in ("n_words", "n_tokens", "n_unknown"):
        got = got.withColumn(prefix + name, F.col(f"__wp.{name}"))
    return got.drop("__wp")


def op3_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, *pieces_of(public_tokenizers.path("piece_bpe_32k.model"))).drop("text")
