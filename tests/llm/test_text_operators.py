import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers as P
from dependra.llm import _common, bpe, exact_dedup, licenses, line_dedup, packing, quality, simhash, topk, toxicity, wordpiece
from dependra.llm._common import join_by_weight

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and long texts, ties, repeated rows, a null id."""
    long = "word " * 30000 + "under the mit license " + "x" * 5000
    texts = [None, "", "   \n\t ", "The MIT License", "Same line here today.\nsame LINE", "Same line here today.\nsame LINE", "same line HERE today.\nsame line", long, "é漢😀\u0000 <|endoftext|>", "a\n\nb\n"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(4, texts[4], None, None, None), (None, "Same line here today.\nsame LINE", None, None, 3), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(40)] + [(None, 1, 1), (3, None, None), (5, 0, 1)], "doc_id long, quality int, toxic int")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# toxicity
def brute_segments(scores):
    """All maximal segments by the definition: split off the best, earliest and shortest first, and recurse."""
    best, at = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-12:
                best, at = total, (i, j + 1)
    if at is None:
        return []
    i, j = at
    return brute_segments(scores[:i]) + [(i, j, best)] + [(a + j, b + j, s) for a, b, s in brute_segments(scores[j:])]


def test_maximal_segments():
    rng = random.Random(3)
    for _ in range(400):
        s = [rng.choice([-3, -1, -0.5, 1, 2, 4.25]) + rng.random() / 64 for _ in range(rng.randint(0, 14))]
        got = sorted(toxicity.maximal_segments(s))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in sorted(brute_segments(s))]


def test_toxicity_held_out(spark, small):
    got = toxicity.op1_toxicity_segments(spark, small).toPandas()
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert ((got.score >= 0.5).astype(int) == got.predicted).all()
    train = spark.read.parquet(small.replace("sf0.001", "sf0.01") + "/documents.parquet")
    lab = spark.read.parquet(small.replace("sf0.001", "sf0.01") + "/labels.parquet")
    scored = toxicity.score(train, toxicity.train(train, lab)).join(lab, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).toPandas()
    assert ((scored.tox_score >= 0.5).astype(int) == scored.toxic).mean() > 0.93


def test_toxicity_edges(spark, odd, labels):
    for lab in (labels, labels.limit(0)):
        got = toxicity.score(odd, toxicity.train(odd, lab))
        assert got.count() == odd.count() and set(odd.columns) < set(got.columns)
        assert got.where("tox_score is null or tox_score < 0 or tox_score > 1").count() == 0
    assert toxicity.score(odd.limit(0), toxicity.ToxicityModel()).count() == 0


# quality
def test_quality_held_out_and_edges(spark, small, odd, labels):
    big = small.replace("sf0.001", "sf0.01")
    docs, lab = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    got = quality.op9_quality_neighbours(spark, big).join(lab, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    for l in (labels, labels.limit(0)):
        x = quality.score(odd, quality.train(odd, l))
        assert x.count() == odd.count() and x.where("quality_score is null").count() == 0
    assert docs.count() == 1000


def test_long_tokens_are_read_whole(spark):
    assert quality.shape("ab" * 40 + "12" + "Q") == "a0A" and quality.shape("ab" * 40) == "a"
    m = toxicity.ToxicityModel()
    m.scores_of("x" * 100 + " y")
    assert set(m._seen) == {"y"}


def test_sample_is_bounded_by_rows(spark):
    from dependra.llm._common import labelled_sample

    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "two"), (3, "three"), (None, "x")], "doc_id long, text string")
    lab = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "doc_id long, y int")
    got = labelled_sample(docs, lab, "y", F.lit(True), 3).collect()
    assert len(got) <= 3 and len({r.doc_id for r in got}) == len(got)
    one = [labelled_sample(docs.repartition(k), lab.where("doc_id = 1"), "y", F.lit(True), 2).collect() for k in (1, 7)]
    assert len(one[0]) == 1 and one[0] == one[1]


def test_table_entries_back_off_to_the_next_coarser():
    words = ["insulting", "insults", "insu", "calm", "weatherman"]
    entries = sorted({e for w in words for e in toxicity.parts(w)})
    levels, parts_ = [e[0] for e in entries], [e[1] for e in entries]
    index, parents = toxicity.index_of(levels, parts_)
    up = {entries[i]: entries[p] if p >= 0 else None for i, p in enumerate(parents)}
    assert up[(0, "insulting")] == (6, "insult") and up[(6, "insult")] == (5, "insul") and up[(5, "insul")] == (4, "insu") and up[(4, "insu")] is None
    assert up[(0, "insu")] is None and up[(0, "calm")] is None and all(index[n][p] == i for i, (n, p) in enumerate(entries))
    counts = np.array([(3.0, 5.0) if p.startswith("insu") else (4.0, 0.0) for _, p in entries])
    got = dict(zip(entries, toxicity.log_odds(np.array(levels), parents, counts, 20.0, 10.0)))
    q = base = 10.0 / 30.0
    for e in ((4, "insu"), (5, "insul"), (6, "insult"), (0, "insulting")):
        q = (5.0 + toxicity.PRIOR * q) / (8.0 + toxicity.PRIOR)
        want = np.log(q / (1 - q)) - np.log(base / (1 - base))
        assert got[e] == pytest.approx(min(8.0, max(-1.0, want)) - toxicity.DRIFT)
    assert np.isnan(toxicity.log_odds(np.array([0]), np.array([-1]), np.zeros((1, 2)), 2.0, 1.0)[0])


def test_clashing_names_are_errors(spark, odd):
    pieces = wordpiece.pieces_of(P.path("piece_bpe_32k.model"))
    for call in (
        lambda: wordpiece.count_tokens(odd.withColumn("N_words", F.lit(1)), *pieces),
        lambda: simhash.fingerprints(odd.withColumn("fp", F.lit(1))),
        lambda: simhash.keep_one(odd.withColumn("__row", F.lit(1))),
        lambda: licenses.scan(odd.withColumn("lic_words", F.lit(1))),
        lambda: toxicity.score(odd.withColumn("tox_score", F.lit(1)), toxicity.ToxicityModel()),
        lambda: quality.score(odd.withColumn("quality_score", F.lit(1)), quality.QualityModel(None, None, None, None, 1.0)),
        lambda: packing.pack(odd.withColumn("row", F.lit(1))),
        lambda: exact_dedup.deduplicate(odd.withColumn("group_size", F.lit(1))),
    ):
        with pytest.raises(ValueError):
            call()


def test_neighbours_are_exact():
    rng = np.random.default_rng(0)
    v = rng.standard_normal((50, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    m = quality.QualityModel(np.ones(quality.WIDTH, np.float32), rng.standard_normal((quality.WIDTH, 4)).astype(np.float32), v.astype(np.float32), rng.integers(0, 2, 50).astype(float), 0.5)
    texts = ["one two", "A!! B!! c", "x | y | z 12"]
    z = m.latent(np.stack([quality.features(t) for t in texts])) @ v.T
    for row, got in zip(z, m.votes(texts)):
        near = np.argsort(-row)[: quality.NEIGHBOURS]
        w = np.maximum(row[near], 1e-6) ** quality.SHARPNESS
        assert got == pytest.approx((w * m.labels[near]).sum() / w.sum(), rel=1e-4)


# lines
def brute_lines(docs, copies=None):
    """The definition, over (id, text) pairs."""
    import math
    import re

    def template(line):
        line = re.sub(r"[ \t\r\f\x0b]+", " ", line)
        return re.sub(r"[^ \n]*[0-9][^ \n]*", "<*>", line).strip(" ")

    held = {}
    for i, t in docs:
        for line in {template(x) for x in (t or "").split("\n")}:
            if len(line.split(" ")) >= line_dedup.MIN_TOKENS:
                held.setdefault(line, set()).add(i)
    leaves = {}
    for line in held:
        tok = line.split(" ")
        leaves.setdefault((len(tok), tuple(tok[: line_dedup.DEPTH])), []).append(line)
    groups = {}
    for leaf, lines in leaves.items():
        often = Counter()
        for line in lines:
            for at in enumerate(line.split(" ")):
                often[at] += len(held[line])
        for line in lines:
            f = [often[at] for at in enumerate(line.split(" "))]
            least = sorted(f, reverse=True)[math.ceil(len(f) * line_dedup.SIMILARITY) - 1]
            groups.setdefault((leaf, tuple(at for at, n in zip(enumerate(line.split(" ")), f) if n >= least)), []).append(line)
    first = {}
    for (leaf, _), lines in groups.items():
        ids = set().union(*(held[x] for x in lines))
        if len(ids) >= (line_dedup.LONG_DOCS if leaf[0] > line_dedup.LONG else line_dedup.MIN_DOCS):
            first.update(dict.fromkeys(lines, min(ids)))
    size = lambda x: len(template(x).split(" ")) if template(x) else 0
    sizes = {i: sum(size(x) for x in (t or "").split("\n")) for i, t in docs}
    out = {}
    for i, t in docs:
        lost = Counter()
        for x in (t or "").split("\n"):
            if first.get(template(x), i) != i:
                lost[first[template(x)]] += size(x)
        n, to = max(((n, f) for f, n in lost.items()), default=(0, None))
        stays = copies is not None and lost and n >= copies * (sizes[i] + sizes[to] - n)
        out[i] = t if t is None or stays else "\n".join(x for x in t.split("\n") if first.get(template(x), i) == i)
    return out


@pytest.mark.parametrize("hot", [10_000, 0])
def test_line_dedup_against_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_ROWS", hot)
    rng = random.Random(1)
    names = ["Ann", "Bob", "Eve", "Max"]
    docs = []
    for i in range(60):
        lines = [f"Posted by {rng.choice(names)} on day {rng.randint(1, 30)} of the month", "all rights  reserved here", f"page {i} of 60 in this book"] + [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(4)]
        rng.shuffle(lines)
        docs.append((i, "\n".join(lines)))
    docs += [(100, None), (101, ""), (102, "\n")]
    passage = [" ".join(f"{rng.choice('abcdefgh')}{k}x" .replace(str(k), "qwertyuiop"[k % 10]) for k in range(60)) for _ in range(3)]
    docs += [(200 + k, f"{passage[k % 3]}\nown words {'abc'[k % 3]} of this {'xyz'[k // 3]} text") for k in range(6)]
    docs += [(210 + k, "\n".join([docs[0][1], passage[0], f"and more {'abc'[k]} of it all"])) for k in range(3)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for copies in (None, 0.8):
        got = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(df, copies=copies).collect()}
        assert got == brute_lines(docs, copies)


def dropped(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    return line_dedup.drop_recurring_lines(df, counts=True).agg(F.sum("n_dropped")).first()[0]


def test_variable_words_need_no_repeated_line(spark):
    names = [f"{a}{b}" for a in ("An", "Be", "Ci", "Do") for b in ("na", "no", "ra", "ro", "la")]
    edited = [f"This page was last edited by {n} today" for n in names]
    assert dropped(spark, edited) == 19
    assert dropped(spark, edited + [edited[0]] * 3) == 22
    # two wordings under the same leading tokens and of the same length, one with two fields
    other = [f"This page was printed for {n} in {m}" for n, m in zip(names, reversed(names))]
    assert dropped(spark, edited + other) == 38
    assert dropped(spark, ["one two three four five six", "one two three ten eleven twelve", "one two three red green blue"]) == 0


def test_line_dedup_clashes(spark, odd):
    for name in ("n_lines", "__ROW"):
        with pytest.raises(ValueError):
            line_dedup.drop_recurring_lines(odd.withColumn(name, F.lit(1)), counts=True)


def test_line_dedup_edges(spark, odd):
    got = line_dedup.drop_recurring_lines(odd, min_docs=2, counts=True)
    assert got.count() == odd.count() and set(odd.columns) < set(got.columns)
    assert got.where("text is null").count() == 2
    # the first document keeps its lines, rows that share its id too; a null id is never first
    assert got.where("doc_id = 4 and text = 'Same line here today.\nsame LINE'").count() == 2
    assert got.where("doc_id = 5").first().text == "same LINE"
    assert got.where("doc_id is null and text is not null").first().text == "same LINE"
    assert line_dedup.drop_recurring_lines(odd, min_docs=2, copies=0.5).where("doc_id = 5").first().text == "Same line here today.\nsame LINE"
    assert line_dedup.drop_recurring_lines(odd.limit(0)).count() == 0


# word pieces
def test_automaton_against_greedy_search():
    rng = random.Random(0)
    for _ in range(60):
        word = lambda n: "".join(rng.choice("abc") for _ in range(rng.randint(1, n)))
        first, rest = {word(4) for _ in range(6)}, {word(3) for _ in range(5)}
        a = wordpiece.Automaton(first, rest)
        for _ in range(60):
            w, i, n = word(9), 0, 0
            while i < len(w):
                j = next((j for j in range(len(w), i, -1) if w[i:j] in (rest if i else first)), None)
                if j is None:
                    n = 0
                    break
                i, n = j, n + 1
            assert a.length(w) == n


def test_wordpiece_edges(spark, odd):
    got = wordpiece.count_tokens(odd, *wordpiece.pieces_of(P.path("piece_bpe_32k.model")))
    assert got.count() == odd.count()
    assert rows_of(got.where("text is null or trim(text) = ''"), "n_tokens", "n_words") == [(0, 0)] * 3 or got.where("text is null").first().n_tokens == 0
    assert got.where("n_tokens < n_words").count() == 0
    assert wordpiece.count_tokens(odd, set(), set()).where("n_unknown <> n_words").count() == 0


# simhash
def brute_simhash(docs, words=4, seed=42):
    import xxhash

    out = {}
    for k, (i, t) in enumerate(docs):
        w = (t or "").encode().lower().split()
        if not w:
            out[k] = 0
            continue
        grams = [b" ".join(w[j : j + words]) for j in range(max(1, len(w) - words + 1))]
        votes = Counter(b for g in grams for b in range(64) if xxhash.xxh64_intdigest(g, seed) >> b & 1)
        out[k] = sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))
    return out


def brute_components(docs, fps, bits=4):
    n = len(docs)
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                parent[root(a)] = root(b)
    ids = {}
    for k, (i, _) in enumerate(docs):
        r = root(k)
        if i is not None:
            ids[r] = min(ids.get(r, i), i)
    return [(i, f"{fps[k]:016x}", ids.get(root(k))) for k, (i, _) in enumerate(docs)]


@pytest.mark.parametrize("most", [simhash.MOST, 3])
def test_simhash_against_brute_force(spark, odd, most, monkeypatch):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghij") * 2 for _ in range(200)) for _ in range(4)]
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    for i in range(100, 160):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = "zz"
        docs.append((i, " ".join(w)))
    monkeypatch.setattr(simhash.links, "__defaults__", (simhash.BITS, most))
    got = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = [(r.doc_id, f"{r.fps[0] & (1 << 64) - 1:016x}", r.component_id) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(brute_components(docs, brute_simhash(docs)), key=repr)


def test_links_of_planted_fingerprints(spark, monkeypatch):
    """Chains and blobs at the exact distance, in lists that are cut into blocks."""
    rng = random.Random(2)
    fps = []
    for _ in range(6):
        f = rng.getrandbits(64)
        for _ in range(25):
            fps.append(f)
            for b in rng.sample(range(64), rng.choice([1, 4, 5])):
                f ^= 1 << b
    docs = [(i, "") for i in range(len(fps))]
    want = {i: c for i, _, c in brute_components(docs, fps)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = spark.createDataFrame([(i, [f]) for i, f in enumerate(signed)], "doc_id long, fps array<long>")
    for most in (2, 5, 512):
        monkeypatch.setattr(simhash.links, "__defaults__", (simhash.BITS, most))
        got = join_by_weight(rows, simhash.classes_of(rows), ["fps"], "n", len(fps))
        assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_position_sets_miss_nothing():
    rng = random.Random(0)
    for bits in (3, 4, 6):
        sets = simhash.position_sets(bits)
        for _ in range(300):
            x = 0
            for b in rng.sample(range(64), bits):
                x |= 1 << b
            zero = {p for p in range(8) if not x >> (8 * p) & 0xFF}
            assert any(set(s) <= zero for s in sets)
    with pytest.raises(ValueError):
        simhash.position_sets(8)


def test_keep_one(spark, odd):
    got = simhash.keep_one(odd, 5, (42, 43), 6)
    assert got.columns == odd.columns
    assert rows_of(got.where("text like 'Same%' or text like 'same%'"), "doc_id") == [(4,)]
    assert got.where("text is null or trim(text) = '' or text rlike '^[ \\n\\t]*$'").count() == 1
    assert simhash.keep_one(odd.limit(0)).count() == 0


# exact dedup
def test_exact_dedup(spark, odd):
    got = exact_dedup.deduplicate(odd, keep_text=True)
    docs = [(r.doc_id, r.text) for r in got.collect()]
    norm = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    size = Counter(norm(t) for _, t in docs)
    best = {}
    for i, t in docs:
        if i is not None:
            best[norm(t)] = max(best.get(norm(t), i), i)
    for r in got.collect():
        assert r.group_size == size[norm(r.text)] and r.keep_id == best.get(norm(r.text))
        assert r.text_sha256 == hashlib.sha256(norm(r.text).encode()).hexdigest()
    kept = Counter(r.text_sha256 for r in got.collect() if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(size)
    assert exact_dedup.deduplicate(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.deduplicate(odd.withColumn("kept", F.lit(1)))


def test_exact_dedup_with_a_full_filter(spark, monkeypatch):
    """A filter that is much too small lets every row through, and results stay the same."""
    df = spark.createDataFrame([(i, f"text {i % 70}") for i in range(400)], "doc_id long, text string")
    want = rows_of(exact_dedup.deduplicate(df), "doc_id", "keep_id", "group_size", "kept")
    monkeypatch.setattr(exact_dedup, "filter_bits", lambda n: 64)
    assert rows_of(exact_dedup.deduplicate(df), "doc_id", "keep_id", "group_size", "kept") == want


# licences
def test_license_scan():
    s = licenses.Scanner()
    n, exact, hits = s.scan("Under the MIT License; x UNDER THE MIT LICENSE, CC-BY-NC 4.0")
    assert n == 14 and [e for e in exact if e[0] == "mit"] == [("mit", 0, 3), ("mit", 5, 8)] and ("cc-by-nc", 9, 11) in exact
    assert s.scan("cc by nc by nc")[1] == [("cc-by-nc", 0, 2)]
    assert s.scan("Überunder the mit license")[1] == []
    fuzzy = s.scan("it is undr the mit licence today")[2]
    assert [(h.label, h.first, h.last, h.edits) for h in fuzzy if h.label == "mit"] == [("mit", 2, 5, 2)]
    assert s.scan(None or "") == (0, [], [])


def test_notices_close_together_are_all_reported():
    hits = licenses.Scanner().scan("undr the mit license and under the mit license")[2]
    assert [(h.first, h.edits) for h in hits if h.label == "mit"] == [(0, 1), (5, 0)]


def test_fuzzy_search_finds_all_that_brute_force_finds():
    import regex

    rng = random.Random(7)
    notice, label, e = licenses.NOTICES[3]
    s = licenses.Scanner(notices=((notice, label, e),))
    for _ in range(150):
        w = list(notice)
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], [w[k], "q"], ["q"]])
        text = "some words " + "".join(w) + " and more"
        want = regex.search(rf"(?<=^| )(?:{notice}){{e<={e}}}(?=$| )", " ".join(x.decode() for x in licenses.normal_words(text)))
        assert bool(s.scan(text)[2]) == bool(want)


def test_license_edges(spark, odd):
    got = licenses.scan(odd)
    assert got.count() == odd.count()
    assert got.where("doc_id = 7").first().lic_exact[0].first == 30000
    assert licenses.scan(odd.limit(0)).count() == 0


# packing
def exact_bins(sizes, length):
    best = len(sizes)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        seen = set()
        for b in range(len(bins)):
            if bins[b] + sizes[k] <= length and bins[b] not in seen:
                seen.add(bins[b])
                bins[b] += sizes[k]
                place(k + 1, bins)
                bins[b] -= sizes[k]
        place(k + 1, bins + [sizes[k]])

    place(0, [])
    return best


def test_bounds_and_best_fit():
    rng = random.Random(4)
    for _ in range(60):
        sizes = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        x = np.array(sizes)
        opt, bins = exact_bins(sizes, 20), packing.best_fit_decreasing(x, 20)
        assert packing.lower_bound(x, 20) <= opt <= bins.max() + 1
        assert np.bincount(bins, weights=x).max() <= 20
    assert packing.cuts(5, 4) == [(0, 1), (1, 4)] and packing.cuts(8, 4) == [(0, 4), (4, 4)] and packing.cuts(3, 4) == [(0, 3)]


def check_packing(got, length):
    g = got.sort_values(["sequence_id", "offset"])
    assert ((g.groupby("sequence_id").length.cumsum() - g.length) == g.offset).all()
    assert g.groupby("sequence_id").length.sum().max() <= length


def test_packing(spark, odd, monkeypatch):
    from tokenizers import Tokenizer

    got = packing.pack_documents(odd.select("doc_id", "text"))
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for r in odd.collect():
        ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        want += [(r.doc_id, n, a, size, zlib.crc32(ids[a : a + size].tobytes())) for n, (a, size) in enumerate(packing.cuts(len(ids), 1024))]
    assert rows_of(got, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=repr)
    check_packing(got.toPandas(), 1024)
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_ids_are_those_of_the_library():
    """The fast way to the ids against ``tokenizers``: every code point, alone and among others, and whole documents."""
    import pyarrow.parquet as pq

    t = packing.Tokens(open(P.path("byte_bpe_50k.json"), "rb").read(), open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(points[i : i + 64]) for i in range(0, len(points), 64)] + ["a".join(points[i : i + 64]) + " " + " ".join(points[i : i + 64]) for i in range(0, len(points), 64)]
    texts += [x or "" for x in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()]
    for start in range(0, len(texts), 4096):
        part = texts[start : start + 4096]
        for text, want in zip(part, t.slow.encode_batch(part, add_special_tokens=False)):
            assert t.ids(text).tolist() == want.ids


def test_exchange_rounds(spark):
    rng = np.random.default_rng(0)
    sizes = np.concatenate([rng.integers(30, 45, 300), rng.integers(50, 58, 200), rng.integers(1, 9, 40)])
    found = spark.createDataFrame([(i, 0, 0, int(x), 0) for i, x in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    one = packing.pack(found, 100, group=60, rounds=1).toPandas()
    more = packing.pack(found, 100, group=60, rounds=3).toPandas()
    for x in (one, more):
        assert sorted(x.length) == sorted(sizes)
        check_packing(x, 100)
    assert more.sequence_id.nunique() <= one.sequence_id.nunique()


# byte-level BPE
@pytest.fixture(scope="module")
def codecs():
    import tiktoken

    content = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    return bpe.codec(content, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(codecs, odd):
    own, lib = codecs
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab cdeéß漢😀\n\t .,!-=#019'sTHE") * rng.choice([1, 1, 1, 2, 5, 70]) for _ in range(rng.randint(0, 30))) for _ in range(800)]
    texts += [r.text or "" for r in odd.collect()] + ["a" * 3000 + "thequick" * 50]
    for t, ids in zip(texts, own.encode_all(texts)):
        assert ids == lib.encode_ordinary(t)
        assert own.decode(ids) == t.encode()
    with pytest.raises(KeyError):
        own.decode([99999])


def test_bpe_frames(spark, odd, codecs):
    enc = bpe.encode(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    back = bpe.decode(enc, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert rows_of(back, "doc_id", "decoded") == sorted(((r.doc_id, bytearray((r.text or "").encode())) for r in odd.collect()), key=repr)
    assert bpe.encode(odd.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(odd.withColumn("ids", F.lit(1)), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


# top-k
def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.standard_normal((150, 6)) * 2) / 2
    x[100:] = x[:50]  # ties
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (220, [float("nan")] * 6), (240, [float("inf")] * 6), (260, []), (None, [1.0] * 6), (280, [1.0, 2.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 20)
    v = np.floor(x * 64).astype(int)
    want = []
    for q in range(0, 150, 20):
        s = v @ v[q]
        for k, i in enumerate(sorted((i for i in range(150) if i != q), key=lambda i: (-s[i], i))[:20]):
            want.append((q, k + 1, i, int(s[i])))
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)


def test_top_k_few_and_huge(spark):
    df = spark.createDataFrame([(0, [1e7, 1.0]), (1, [1e7, 2.0]), (2, [-1.0, 0.0]), (3, [1e11, 0.0])], "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") == 0, 20).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(3, (1 << 63) - 1), (1, (64 * 10**7) ** 2 + 64 * 128), (2, -64 * 64 * 10**7)]
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0
    df = spark.createDataFrame([(0, [2e12, 1.5]), (1, [0.0, 1.0]), (2, [-1e300, 0.0]), (3, [2e12, 0.0])], "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id").isin(0, 1), 20).collect()
    rows = [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: (r.query_id, r["rank"]))]
    assert rows == [(0, 1, 3, (1 << 63) - 1), (0, 2, 1, 96 * 64), (0, 3, 2, -(1 << 63)), (1, 1, 0, 96 * 64), (1, 2, 2, 0), (1, 3, 3, 0)]


def test_top_k_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "SAMPLE", 50)
    rng = np.random.default_rng(4)
    v = rng.integers(-300, 300, (300, 8))
    got = topk.top_k(spark.createDataFrame([(i, [float(c) / 64 for c in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>"), F.col("vec_id") % 4 == 0, 5)
    want = []
    for q in range(0, 300, 4):
        s = v @ v[q]
        want += [(q, k + 1, i, int(s[i])) for k, i in enumerate(sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:5])]
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)


def test_elimination_skips_candidates():
    rng = np.random.default_rng(1)
    x = (np.repeat(rng.standard_normal((8, 3)) * 300, 200, 0) + rng.standard_normal((1600, 3))).astype(np.int64)
    f = x.astype(float)
    space = topk.space_of(f[::3], float((f**2).sum(1).max()))
    tables = [space.distances(a, query) for a, query in ((f[::200], True), (f, False))]
    found, evaluated = topk.search_block(np.arange(8), f[::200], tables[0], np.arange(1600), f, tables[1], space, 5, step=32)
    assert evaluated < 8 * 1600 * 0.6
    # candidates that cannot reach a known k-th score are not evaluated in further blocks
    floors = np.array([scores[-1] for _, _, scores in found], float)
    again, fewer = topk.search_block(np.arange(8), f[::200], tables[0], np.arange(1600), f, tables[1], space, 5, floors, step=32)
    assert fewer <= evaluated and [list(r[2]) for r in again] == [list(r[2]) for r in found]
    for i, rows, scores in found:
        s = (x @ x[i * 200]).astype(float)
        s[i] = -np.inf
        assert list(scores) == sorted((s), reverse=True)[:5]


@pytest.mark.parametrize("least", [0, 20, 10_000])
def test_join_by_weight_is_a_join(spark, least, monkeypatch):
    monkeypatch.setattr(_common, "HOT_ROWS", least)
    left = spark.createDataFrame([(i, i % 7 if i % 2 else 0) for i in range(200)], "i int, k int")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("w"), F.max("i").alias("top"))
    assert rows_of(join_by_weight(left, right, ["k"], "w", 200), "i", "top") == rows_of(left.join(right, "k"), "i", "top")
    assert rows_of(join_by_weight(left, right, ["k"], "w", 200_000), "i", "top") == rows_of(left.join(right, "k"), "i", "top")
