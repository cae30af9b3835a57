"""Benchmark decontamination by winnowing, in DataFrame functions only.

A text's words are runs of digits, ASCII letters (A-Z lower-cased) and all
characters from U+0080 on. A benchmark item's windows are its runs of WINDOW
words; a shorter item that isn't empty is one window of its own length.

Winnowing: hash every run of k = 4 words and keep, for each window, the least
of its hashes. Equal windows have equal minima, so joining the minima of
documents and items finds every shared window (k + window places - 1 = WINDOW
words); a text has few distinct minima, so few rows. Hits are then extended:
each document place whose minimum was hit is written out as its whole window
and joined to the items' windows by the words themselves, which drops hash
collisions.

Only documents with a hit are joined back to their texts. The minima of the
benchmark are broadcast when counted at BROADCAST_ROWS or fewer; beyond that
the join shuffles, and Spark splits frequent minima. Fingerprints match on
lower() of each word alone (lower() of a running text depends on what stands
beside a word), which equal windows share too; the windows themselves are
compared with A-Z lower-cased only.

Null and empty texts have no words. A repeated row gives a repeated result. An
empty benchmark hits nothing. Null ids of documents are ids like others; an
item without an id hits words but has no name to be listed or counted. A text of
any length is read whole. Columns of the inputs with any other names don't matter.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowsql.llm.common import text_or_empty

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW, K = 8, 4
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _shift(array: str, by: int) -> Column:
    return F.slice(F.col(array), F.lit(by + 1), F.greatest(F.size(array) - by, F.lit(0)))


def _minima(df: DataFrame, lengths: list[int]) -> DataFrame:
    """df (with a column w of words in any case) with m<L> for each length L: for each place, the window's least k-gram hash."""
    both = lambda a, b: F.xxhash64(a, b)
    df = df.withColumn("g1", F.transform("w", lambda w: F.xxhash64(F.lower(w))))
    if max(lengths) > 1:
        df = df.withColumn("g2", F.zip_with("g1", _shift("g1", 1), both))
    if max(lengths) > 2:
        df = df.withColumn("g3", F.zip_with("g2", _shift("g1", 2), both)) if 3 in lengths else df
        df = df.withColumn("g4", F.zip_with("g2", _shift("g2", 2), both))
    for length in lengths:
        k = min(K, length)
        span = length - k + 1
        df = df.withColumn(f"m{length}", F.col(f"g{k}"))
        have = 1
        while have < span:
            step = min(have, span - have)
            df = df.withColumn(f"m{length}", F.zip_with(f"m{length}", _shift(f"m{length}", step), lambda a, b: F.least(a, b)))
            have += step
        places = F.greatest(F.size("w") - (length - 1), F.lit(0))
        df = df.withColumn(f"m{length}", F.slice(f"m{length}", F.lit(1), places))
    return df.drop("g1", "g2", "g3", "g4")


def _gram(at: Column, length: int) -> Column:
    return F.array_join(F.slice("w", at, F.lit(length)), " ")


def item_windows(bench: DataFrame, item_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """length, gram, items: each window of the benchmark with the items that hold it."""
    items = bench.select(F.col(item_col).cast("string").alias("item"), words_of(lowered(text_or_empty(text_col))).alias("w"))
    items = items.where("size(w) > 0").withColumn("length", F.least(F.size("w"), F.lit(window)))
    places = F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)
    grams = items.withColumn("at", F.explode(places)).select(
        "item", "length", F.array_join(F.slice("w", F.col("at"), F.col("length")), " ").alias("gram")
    )
    return grams.groupBy("length", "gram").agg(F.collect_set("item").alias("items"))


def hits(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """row_key, id, place (first word, from 1), length, items: each benchmark window in each document.

    row_key stands for a document's id and text; a repeated row counts once.
    """
    if window < K:
        raise ValueError(f"a window has {K} words at least")
    found = item_windows(bench, item_col, item_text_col, window)
    lengths = [r.length for r in found.select("length").distinct().collect()] or [window]  # window values at most
    keyed = _keyed(docs, id_col, text_col)

    text = found.withColumn("w", words_of(F.col("gram")))
    prints = None
    for length in lengths:
        part = _minima(text.where(F.col("length") == length), [length]).select(F.element_at(f"m{length}", 1).alias("mark"))
        prints = part if prints is None else prints.union(part)
    prints = prints.distinct()
    if prints.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        prints = F.broadcast(prints)

    marked = _minima(keyed.withColumn("w", F.regexp_extract_all("body", F.lit(ANY_CASE), F.lit(0))).select("row_key", "id", "w"), lengths)
    every = F.array_distinct(F.concat(*[F.col(f"m{n}") for n in lengths]))
    marks = marked.select("row_key", "id", F.explode(every).alias("mark"))
    near = marks.join(prints, "mark", "left_semi").groupBy("row_key", "id").agg(F.collect_set("mark").alias("marks"))
    near = near.select(F.col("row_key").alias("k"), F.col("id").alias("i"), "marks")

    whole = keyed.join(near, (F.col("row_key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i")))
    whole = _minima(whole.withColumn("w", words_of(lowered(F.col("body")))).drop("body"), lengths)
    def spots_of(length: int) -> Column:
        hit = F.transform(f"m{length}", lambda m, i: F.when(F.array_contains("marks", m), i + 1))
        return F.transform(
            F.filter(hit, lambda i: i.isNotNull()),
            lambda i: F.struct(i.alias("place"), F.lit(length).alias("length"), _gram(i, length).alias("gram")),
        )

    places = [spots_of(n) for n in lengths]
    spots = whole.select("row_key", "id", F.explode(F.concat(*places)).alias("s")).select("row_key", "id", "s.*")
    return spots.join(found, ["length", "gram"]).select("row_key", "id", "place", "length", "items").distinct()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body"))
    return rows.withColumn("row_key", F.xxhash64("id", "body"))


def annotate(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    min_items: int = 2,
) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    spots = hits(docs, bench, id_col, text_col, item_col, item_text_col, window)
    held = spots.groupBy("row_key", "id").agg(
        F.collect_set(F.struct("place", "length")).alias("spots"), F.collect_set("items").alias("items")
    )
    covered = F.array_distinct(
        F.flatten(F.transform("spots", lambda s: F.sequence(s["place"], s["place"] + s["length"] - 1)))
    )
    names = F.array_sort(F.array_distinct(F.flatten("items")))
    held = held.select(
        F.col("row_key").alias("k"), F.col("id").alias("i"), F.size(covered).cast("long").alias("hit"), names.alias("names")
    )
    rows = _keyed(docs, id_col, text_col).select("id", "row_key", F.size(words_of(F.lower("body"))).cast("long").alias("n_words"))
    out = rows.join(held, (F.col("row_key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i")), "left")
    n_items = F.coalesce(F.size("names"), F.lit(0)).cast("long")
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("hit", F.lit(0).cast("long")).alias("n_hit"),
        F.greatest(n_items, F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("names", ","), F.lit("")), 256).alias("items_sha256"),
        (n_items >= min_items).alias("contaminated"),
    )


def clean(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    short_items: int = 2,
) -> DataFrame:
    """The documents without benchmark text, with all their columns.

    One whole window of any item is enough for a document to go. Items shorter
    than a window (a phrase of a word or two stands in clean documents as well)
    count only where a document holds short_items of them.
    """
    spots = hits(docs, bench, id_col, text_col, item_col, item_text_col, window)
    held = spots.groupBy("row_key", "id").agg(F.max("length").alias("longest"), F.collect_set("items").alias("sets"))
    bad = held.where((F.col("longest") >= window) | (F.size(F.array_distinct(F.flatten("sets"))) >= short_items)).select(
        F.col("row_key").alias("__k"), F.col("id").alias("__i")
    )
    key = F.xxhash64(docs[id_col], text_or_empty(text_col))
    return docs.join(bad, (key == F.col("__k")) & docs[id_col].eqNullSafe(F.col("__i")), "left_anti")
