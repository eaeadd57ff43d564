"""Line deduplication through a tree of log templates, with DataFrame functions alone.

White space is made uniform and every token with a digit becomes a variable field. A line's way in the tree
is its number of tokens and its first ``DEPTH`` tokens. A leaf holds several templates: at each position it is
counted how many (document, line) pairs of the leaf hold each token, and a line's template is made of its most
frequent tokens, as few as cover a share ``SIMILARITY`` of its positions, ties included; its other positions
are variable fields. Lines of one template thus agree in at least that share of all positions, and a field
that differs from line to line stays out of it, whether or not one exact line repeats. A template is recurring
when ``MIN_DOCS`` distinct documents hold lines of it, ``LONG_DOCS`` if its lines are longer than ``LONG``
tokens. Lines of recurring templates are dropped from every document but the first that holds the template
(smallest id).

Texts are read once for their lines' digests and stored with a row number; leaves that too few lines share are
set aside by a bit map. Tokens are taken, as 64-bit hashes, of the kinds of line in the other leaves alone, and
exchanged once, line by line. Keys that hold over a thousandth of all occurrences, fewer than a thousand, are joined by broadcast. Only texts that
lose lines are exchanged, by row number.

``copies`` leaves a document as it was if it is a copy of another one, which is for near-duplicate operators
to judge: if what it would lose to one document alone makes up at least the share ``copies`` of the tokens of
the two together. Lines of fewer than ``MIN_TOKENS`` tokens stay. Null texts stay null, empty ones empty. Rows
that share an id count as one document, and lose the same templates; a null id is an id of its own, and comes
last. Other columns pass through; those named like a new one are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ._common import HOT_ROWS, HOT_SHARE, bit_is_set, bitmap_of, bitmap_word, join_by_weight, materialize, refuse_clash, rows_in, table

DEPTH = 3
MIN_TOKENS = 3
MIN_DOCS = 3
LONG = 50  #: lines of more tokens are passages, which need fewer documents to be recurring
LONG_DOCS = 2
SIMILARITY = 0.75
LEAF_BITS = 1 << 24  #: of the bit map of leaves that enough lines share: 2 MiB


def templates(text: Column) -> Column:
    """The lines of a text with uniform white space and variable fields for tokens with a digit."""
    raw = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.when(raw.rlike(r"[\t\r\f\x0B]|  "), F.regexp_replace(raw, r"[ \t\r\f\x0B]+", " ")).otherwise(raw)
    # tried at token starts alone, and without backtracking
    masked = F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+", "<*>")).otherwise(plain)
    return F.transform(F.split(masked, "\n"), lambda line: F.trim(line))


def _tokens(line: Column) -> Column:
    return F.split(line, " ")


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def numbered_lines(docs: DataFrame, text: str, depth: int, min_tokens: int) -> DataFrame:
    """``docs`` with ``__row`` and ``__lines`` (size, line, leaf; line is null where it is too short): the one pass over all texts."""
    size = lambda x: F.when(x == "", 0).otherwise(F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1)
    sized = F.transform(templates(F.col(text)), lambda x: F.struct(x.alias("line"), size(x).alias("size")))
    lines = F.transform(sized, lambda x: F.struct(
        x["size"], F.when(x["size"] >= min_tokens, _digest(x["line"])).alias("line"), F.xxhash64(x["size"], F.substring_index(x["line"], " ", depth)).alias("leaf")
    ))
    return materialize(docs.withColumn("__lines", lines).withColumn("__row", F.monotonically_increasing_id()), "numbered")


def _needed(size: Column, min_docs: int, long_docs: int) -> Column:
    """Documents that make a template of lines of ``size`` tokens recurring."""
    return F.when(size > LONG, min(long_docs, min_docs)).otherwise(min_docs)


def _leaf_maps(leaves: DataFrame) -> DataFrame:
    """A bit map of the ``leaf`` numbers: at most LEAF_BITS / 2**15 rows of 4 KiB."""
    position = F.col("leaf").bitwiseAND(F.lit(LEAF_BITS - 1))
    return materialize(leaves.groupBy(bitmap_word(position).alias("__word")).agg(bitmap_of(position).alias("__map")), "leaves")


def _in_leaves(rows: DataFrame, maps: DataFrame) -> DataFrame:
    """The rows whose ``leaf`` is in the bit map, and by a shared bit some more; nothing is exchanged."""
    position = F.col("leaf").bitwiseAND(F.lit(LEAF_BITS - 1))
    met = rows.join(F.broadcast(maps), bitmap_word(position) == F.col("__word"))
    return met.where(bit_is_set(F.col("__map"), position)).drop("__word", "__map")


def _shared_leaves(stored: DataFrame, doc_id: str, min_docs: int, long_docs: int) -> DataFrame:
    """``__row, id, pos, size, line, leaf`` of the lines in leaves of enough lines."""
    each = stored.select("__row", F.col(doc_id).alias("id"), F.posexplode("__lines").alias("pos", "x")).select("__row", "id", "pos", "x.*").where("line is not null")
    enough = each.groupBy("size", "leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= _needed(F.col("size"), min_docs, long_docs))
    return materialize(_in_leaves(each, _leaf_maps(enough)), "shared")


def _templates_of(stored: DataFrame, text: str, lines: DataFrame, similarity: float) -> DataFrame:
    """``line, template`` of the kinds of line (leaf, line, n, rep, lines) of leaves that hold several (``lines``).

    Token hashes of a leaf meet in one task, each kind of line sent about once. Leaves of over a thousandth of
    the kinds, fewer than a thousand, go token by token instead.
    """
    taken = rows_in(stored.select("__row", text, F.col("__lines.leaf").alias("leaves"), F.col("__lines.line").alias("digests")), lines.select(F.col("rep.row").alias("__row")))
    each = taken.select(F.explode(F.arrays_zip(F.col("leaves").alias("leaf"), F.col("digests").alias("line"), templates(F.col(text)).alias("plain"))).alias("x")).select("x.*").where("line is not null")
    each = _in_leaves(each, _leaf_maps(lines)).select("leaf", "line", F.transform(_tokens(F.col("plain")), lambda t: F.xxhash64(t)).alias("tokens"))
    total = lines.count()
    large = (F.col("lines") * HOT_SHARE > total) & (F.col("lines") > HOT_ROWS)
    hot = lines.where(large).select("leaf").distinct()
    some = not hot.isEmpty()
    rest = each.join(F.broadcast(hot), "leaf", "left_anti") if some else each
    counts = lines.where(~large).select("leaf", "line", F.lit(None).cast("array<bigint>").alias("tokens"), "n")
    # one exchange, by leaf: what follows groups by more, which this serves too
    met = rest.withColumn("n", F.lit(None).cast("bigint")).unionByName(counts).repartition("leaf")
    kinds = met.groupBy("leaf", "line").agg(F.any_value("tokens", True).alias("tokens"), F.max("n").alias("n")).where("n is not null and tokens is not null")
    places = kinds.select("leaf", "line", "n", F.posexplode("tokens").alias("at", "token"))
    formed = _formed(places.withColumn("f", F.sum("n").over(Window.partitionBy("leaf", "at", "token"))), similarity)
    if some:
        own = lines.where(large).select("leaf", "line", "n").join(each.join(F.broadcast(hot), "leaf", "left_semi").groupBy("leaf", "line").agg(F.any_value("tokens").alias("tokens")), ["leaf", "line"])
        places = materialize(own.select("leaf", "line", "n", F.posexplode("tokens").alias("at", "token")), "tokens")
        # the count of a token that only one kind of line holds is that line's own
        often = places.groupBy("leaf", "at", "token").agg(F.sum("n").alias("f"), F.count(F.lit(1)).alias("w")).where("w > 1")
        counted = join_by_weight(places, materialize(often, "often"), ["leaf", "at", "token"], "w", places.count(), "left")
        formed = formed.unionByName(_formed(counted.withColumn("f", F.coalesce("f", "n")), similarity))
    return formed


def _formed(places: DataFrame, similarity: float) -> DataFrame:
    """``line, template`` from every kind of line's tokens (leaf, line, at, token) and their counts f."""
    each = places.groupBy("leaf", "line").agg(F.array_sort(F.collect_list(F.struct("at", "token", "f"))).alias("x"))
    rank = F.ceil(F.size("x") * similarity - 1e-9).cast("int")
    least = F.element_at(F.sort_array(F.col("x.f"), asc=False), rank)
    # bound as an array of one, so that the least count is taken once a line and not once a token
    kept = F.flatten(F.transform(F.array(least), lambda t: F.filter("x", lambda x: x["f"] >= t)))
    return each.select("line", _digest(F.concat_ws(",", F.col("leaf").cast("string"), kept.cast("string"))).alias("template"))


def dropped_lines(stored: DataFrame, doc_id: str, text: str, min_docs: int, long_docs: int, similarity: float, copies: float | None) -> DataFrame:
    """``__row, __lost`` (places of lines) of the rows of a :func:`numbered_lines` table that lose lines."""
    some = _shared_leaves(stored, doc_id, min_docs, long_docs)
    kinds = (
        some.groupBy("size", "leaf", "line", "id").agg(F.min(F.struct(F.col("__row").alias("row"), "pos")).alias("rep"), F.count(F.lit(1)).alias("rows"))
        .groupBy("size", "leaf", "line").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("rep"), F.sum("rows").alias("rows"))
    )
    kinds = materialize(kinds, "kinds")
    leaves = kinds.groupBy("size", "leaf").agg(F.sum("n").alias("docs"), F.count(F.lit(1)).alias("lines")).where(F.col("docs") >= _needed(F.col("size"), min_docs, long_docs))
    leaves = materialize(leaves.drop("docs").withColumn("w", F.col("lines")), "leaves")
    live = materialize(join_by_weight(kinds, leaves, ["size", "leaf"], "w", leaves.agg(F.sum("w")).first()[0] or 0), "live")
    found = _templates_of(stored, text, live.where("lines > 1"), similarity).unionByName(live.where("lines = 1").select("line", F.col("line").alias("template")))
    rows = live.agg(F.sum("rows")).first()[0] or 0
    named = materialize(live.select("line", "rows").join(found, "line"), "templates")
    held = materialize(join_by_weight(some.drop("leaf"), named, ["line"], "rows", rows), "held")
    recurring = held.groupBy("template", "id").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("rows")).groupBy("template").agg(
        F.max("size").alias("size"), F.count(F.lit(1)).alias("docs"), F.min("id").alias("first"), F.sum("rows").alias("rows")
    ).where(F.col("docs") >= _needed(F.col("size"), min_docs, long_docs))
    recurring = materialize(recurring.select("template", "first", "rows"), "recurring")
    lost = join_by_weight(held.drop("line"), recurring, ["template"], "rows", rows).where(~F.col("id").eqNullSafe(F.col("first")))
    by_first = lost.groupBy("__row", "first").agg(F.collect_list("pos").alias("lost"), F.sum("size").alias("shared"))
    by_row = by_first.groupBy("__row").agg(F.flatten(F.collect_list("lost")).alias("__lost"), F.max(F.struct("shared", "first")).alias("best"))
    by_row = materialize(by_row.select("__row", "__lost", "best.*"), "lost")
    return by_row.select("__row", "__lost") if copies is None else _without_copies(stored, doc_id, by_row, copies)


def _without_copies(stored: DataFrame, doc_id: str, by_row: DataFrame, copies: float) -> DataFrame:
    """``by_row`` (with first and shared: the document to which most is lost, and how many tokens) without rows that are copies."""
    sizes = stored.select("__row", F.col(doc_id).alias("first"), F.aggregate(F.col("__lines.size"), F.lit(0).cast("long"), lambda a, n: a + n).alias("size"))
    leaders = by_row.where("first is not null").groupBy("first").agg(F.count(F.lit(1)).alias("w"))
    leaders = materialize(sizes.groupBy("first").agg(F.max("size").alias("other")).join(leaders, "first"), "leaders")
    rows = by_row.count()
    met = join_by_weight(by_row.where("first is not null"), leaders, ["first"], "w", rows).join(sizes.select("__row", "size"), "__row")
    return met.where(F.col("shared") < (F.col("size") + F.col("other") - F.col("shared")) * copies).select("__row", "__lost")


def drop_recurring_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS,
    long_docs: int = LONG_DOCS, similarity: float = SIMILARITY, copies: float | None = None, counts: bool = False,
) -> DataFrame:
    """``docs`` with the recurring lines taken out of ``text``; with ``counts`` also ``n_lines`` and ``n_dropped``."""
    refuse_clash(docs, ["__row", "__lines", "__lost"] + (["n_lines", "n_dropped"] if counts else []))
    stored = numbered_lines(docs, text, depth, min_tokens)
    lost = materialize(dropped_lines(stored, doc_id, text, min_docs, long_docs, similarity, copies), "dropped")
    some, rest = rows_in(stored.drop("__lines"), lost, both=True)
    some = some.join(lost.hint("shuffle_hash"), "__row")
    lines = F.split(F.col(text), "\n")
    kept = F.filter(lines, lambda x, at: ~F.array_contains(F.col("__lost"), at))
    new, n = [F.array_join(kept, "\n").alias(text)], F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines")
    extra = [n, F.size("__lost").cast("long").alias("n_dropped")] if counts else []
    others = [n, F.lit(0).cast("long").alias("n_dropped")] if counts else []
    some = some.select(*[new[0] if c == text else F.col(c) for c in docs.columns], *extra)
    return rest.select(*docs.columns, *others).unionByName(some)


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return got.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars_kept"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


OP2_SQL = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
masked AS (
  SELECT doc_id, raw, pos, trim(regexp_replace(regexp_replace(raw, '[ \t\r\f\x0B]+', ' ', 'g'), '[^ \n]*[0-9][^ \n]*', '<*>', 'g'), ' ') AS line FROM lines),
counted AS (
  SELECT line, string_split(line, ' ') AS tokens, len(string_split(line, ' ')) AS size, string_split(line, ' ')[1:{DEPTH}] AS lead, count(DISTINCT doc_id) AS n FROM masked
  WHERE len(string_split(line, ' ')) >= {MIN_TOKENS} GROUP BY line),
leaf AS (SELECT size, lead FROM counted GROUP BY size, lead HAVING sum(n) >= {LONG_DOCS}),
token AS (
  SELECT line, size, lead, n, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM counted JOIN leaf USING (size, lead)),
often AS (SELECT line, size, lead, token, place, sum(n) OVER (PARTITION BY size, lead, place, token) AS f FROM token),
rated AS (SELECT *, list(f) OVER (PARTITION BY line) AS fs FROM often),
formed AS (
  SELECT line, size, lead, string_agg(place || ':' || token, ' ' ORDER BY place) AS template
  FROM rated WHERE f >= list_sort(fs, 'DESC')[CAST(ceil(size * {SIMILARITY} - 1e-9) AS BIGINT)] GROUP BY line, size, lead),
recurring AS (
  SELECT size, lead, template, min(doc_id) AS first_doc FROM masked JOIN formed USING (line) GROUP BY size, lead, template
  HAVING count(DISTINCT doc_id) >= CASE WHEN size > {LONG} THEN {LONG_DOCS} ELSE {MIN_DOCS} END),
firsts AS (SELECT line, first_doc FROM formed JOIN recurring USING (size, lead, template)),
flagged AS (
  SELECT m.doc_id, m.raw, m.pos, coalesce(f.first_doc <> m.doc_id, false) AS gone FROM masked m LEFT JOIN firsts f USING (line))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  CAST(length(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS BIGINT) AS n_chars_kept,
  sha256(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM flagged GROUP BY doc_id
"""
