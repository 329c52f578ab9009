"""Benchmark decontamination over a positional inverted index, in DataFrame functions only.

The index holds (term, document, position) postings of the terms that benchmark windows
use. A window is looked up from its two rarest terms: their postings, shifted back by the
offsets of the terms, meet where the window may start. The remaining terms are compared at
these places only, so postings of frequent words are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fillsight.session import materialize

WINDOW = 10
# Term tables up to this many rows are sent to the executors whole (about 100 bytes a row).
BROADCAST_ROWS = 200_000
_DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text, in order; NULL has none."""
    # texts of one byte per character take the fast lower(); others keep their capitals beyond A-Z
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    # the split pattern cannot see a delimiter that lower-casing removed: only letters change
    return F.coalesce(F.array_remove(F.split(low, _DELIMITERS), ""), F.array().cast("array<string>"))


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(window, terms, items): the different windows of all items, with the items that hold them.

    An item with fewer than ``size`` words, but not none, is one window; NULL texts have none.
    """
    w = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(size - 1), F.lit(1)))
    each = w.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, F.lit(size)))).alias("terms"))
    return each.groupBy("terms").agg(F.collect_set(F.col("item_id").cast("string")).alias("items")).withColumn(
        "window", F.sha2(F.array_join("terms", " "), 256)
    )


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def postings(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """(term, key, position, and the columns of ``terms``) for the words that are in ``terms``."""
    tokens = docs.select("key", F.posexplode(words(F.col("text"))).alias("position", "term"))
    return tokens.join(_sized(terms, n_terms), "term")


def candidates(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(key, starts): places where the two rarest terms of a window stand at its offsets.

    ``docs`` has key and text. Terms are counted over all of it; a window with a term that
    never occurs is gone at once.
    """
    used = materialize(found.select("window", F.posexplode("terms").alias("offset", "term")))
    vocabulary = materialize(used.select("term").distinct())
    n = vocabulary.count()
    tokens = docs.select(F.explode(words(F.col("text"))).alias("term"))
    count = tokens.join(_sized(vocabulary, n), "term", "left_semi").groupBy("term").agg(F.count("*").alias("count"))
    ranked = used.join(count, "term", "left").groupBy("window").agg(
        F.sort_array(F.collect_list(F.struct("count", "offset", "term"))).alias("by_count")
    )
    # sorting puts a NULL count, that is a term without postings, first
    ranked = ranked.where(F.col("by_count")[0]["count"].isNotNull())
    probes = materialize(
        ranked.select("window", F.size("by_count").alias("length"), F.posexplode(F.slice("by_count", 1, 2)).alias("rarity", "p"))
        .groupBy(F.col("p.term").alias("term"))
        .agg(F.collect_list(F.struct("window", F.col("p.offset").alias("offset"), F.least("length", F.lit(2)).alias("need"))).alias("uses"))
    )
    shifted = postings(docs, probes, probes.count()).select("key", "position", F.explode("uses").alias("u"))
    return (
        shifted.where(F.col("position") >= F.col("u.offset"))
        .groupBy("key", (F.col("position") - F.col("u.offset")).alias("start"), F.col("u.window").alias("window"))
        .agg(F.count("*").alias("n"), F.max("u.need").alias("need"))
        .where("n >= need")
        .select("key", "start", "window")
    )


def _key() -> Column:
    # by id and text, as rows may share an id or have none; rows of one key compare their own words
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text"))


def matches(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Columns of ``docs`` plus words and hits: array<struct<start, length, items>> of exact phrases."""
    found = materialize(windows(items, size))
    keyed = docs.withColumn("key", _key())
    near = candidates(keyed.select("key", "text"), found)
    known = _sized(found, found.count())
    phrases = near.join(known, "window").groupBy("key").agg(F.collect_list(F.struct("start", "terms", "items")).alias("near"))
    both = keyed.join(phrases, "key", "left").withColumn("words", words(F.col("text")))
    hits = F.expr(
        "transform(filter(coalesce(near, array()), c -> slice(words, c.start + 1, size(c.terms)) = c.terms),"
        " c -> struct(c.start AS start, size(c.terms) AS length, c.items AS items))"
    )
    return both.withColumn("hits", hits).drop("near", "key")


_COVERED = """aggregate(array_sort(transform(hits, h -> struct(h.start AS a, h.start + h.length AS b))),
    struct(0 AS n, 0 AS upto),
    (s, h) -> struct(int(s.n + greatest(0, h.b - greatest(h.a, s.upto))) AS n, int(greatest(s.upto, h.b)) AS upto),
    s -> s.n)"""


def report(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``.

    A word inside any occurrence of a window counts once. NULL and empty texts have no words;
    an empty benchmark, and items with NULL or empty texts, hit nothing; an item without an
    id hits words but is not listed. Columns beside doc_id and text are not read.
    """
    m = matches(docs.select("doc_id", "text"), items, size)
    m = m.withColumn("_items", F.array_sort(F.array_distinct(F.flatten(F.col("hits.items")))))
    return m.select(
        "doc_id", F.size("words").cast("bigint").alias("n_words"), F.expr(_COVERED).cast("bigint").alias("n_hit"),
        F.size("_items").cast("bigint").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, without an occurrence of a benchmark window."""
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return matches(packed, items, size).where(F.size("hits") == 0).select("row.*")


def proximity(docs: DataFrame, items: DataFrame, slop: int) -> DataFrame:
    """(doc_id, item_id): documents where all words of an item stand, in any order, within a span.

    The span may be ``slop`` positions longer than the number of different words. Positions of
    a document and item are scanned in order with the last place of every word so far.
    """
    wanted = items.select("item_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    need = wanted.groupBy("item_id").agg(F.count("*").alias("need"))
    terms = materialize(wanted.groupBy("term").agg(F.collect_list("item_id").alias("ids")))
    found = postings(docs.withColumn("key", F.col("doc_id")).select("key", "text"), terms, terms.count())
    per = (
        found.select("key", "position", "term", F.explode("ids").alias("item_id"))
        .groupBy("key", "item_id").agg(F.array_sort(F.collect_list(F.struct("position", "term"))).alias("p"))
        .join(need, "item_id").where(F.size(F.array_distinct("p.term")) == F.col("need"))
    )
    # each posting closes a span: the words from its position back to position - need - slop + 1
    close = F.expr(
        "exists(p, e -> size(array_distinct(transform(filter(p, f -> f.position <= e.position"
        f" AND f.position > e.position - need - {int(slop)}), f -> f.term))) = need)"
    )
    return per.where(close).select(F.col("key").alias("doc_id"), "item_id")
