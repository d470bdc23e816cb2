"""Benchmark decontamination: a prefix-filtered set join of item windows with documents, in DataFrame functions alone.

A window of w words is contained only if all w are there, so the necessary prefix of its words, ordered by rarity in
the documents, is one word: the rarest. Windows and documents are joined on it; its place in the window gives the only
place where the window can begin (positional bound), which must leave room for the window (length bound); then the
words there are compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import ascii_lower, stored, whole

#: Rows of a side that is broadcast, at most; above, the join is shuffled and may be split where a word is hot.
BROADCAST_ROWS = 200_000
#: Tasks that the places of one word are dealt over where that join is shuffled.
SPREAD = 16


#: What lies between words, whatever the case of letters.
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def item_words(text: Column) -> Column:
    """Lower-cased words of digits, ASCII letters and all characters beyond ASCII; none for null."""
    return F.array_remove(F.split(ascii_lower(whole(text)), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def is_small(df: DataFrame, most: int | None = None) -> bool:
    """Whether df, a stored table, has at most `most` rows (BROADCAST_ROWS, where none is given)."""
    most = BROADCAST_ROWS if most is None else most
    return df.limit(most + 1).count() <= most


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """df, a stored table, with a broadcast hint if it has at most `most` rows."""
    return F.broadcast(df) if is_small(df, most) else df


def item_windows(items: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(windows: key, words; members: key, item): distinct windows of `size` words, or the whole item where it has fewer."""
    words = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), item_words(F.col(text_col)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(size - 1), F.lit(1)))
    cut = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words"))
    cut = cut.select(F.sha2(F.array_join("words", " "), 256).alias("key"), "words", "item").distinct()
    return cut.select("key", "words").distinct(), cut.select("key", "item")


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit (words inside any occurrence of a window), n_items, items_sha256, contaminated.

    Null and empty texts have no words and aren't hit; items without words have no windows; a null item id is named by
    the empty text. Every row is judged by its own text, whether its doc_id is null or another row's too. Empty tables on
    either side give no hits; other columns are ignored.
    """
    key = F.xxhash64(F.col(id_col).cast("long"), whole(F.col(text_col))).alias("dk")
    words = docs.select(key, item_words(F.col(text_col)).alias("w"))
    found, members = item_windows(items, size, item_col, item_text_col)
    found, members = stored(found, "item-windows"), stored(members, "item-members")
    vocabulary = small(stored(found.select(F.explode("words").alias("word")).distinct(), "item-words"))
    counts = words.select(F.explode_outer("w").alias("word")).join(vocabulary, "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    tokens = found.select("key", "words", F.posexplode("words").alias("at", "word")).join(counts, "word", "left")
    rarest = tokens.groupBy("key").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at")).alias("r"), F.first("words").alias("words"))
    probes = stored(rarest.where("r.n > 0").select("key", "words", "r.word", "r.at"), "item-prefixes")

    begin = F.col("i") - F.col("at")
    there = (begin >= 0) & (begin + F.size("words") <= F.size("w")) & (F.slice("w", begin + 1, F.size("words")) == F.col("words"))
    if is_small(probes):
        places = words.select("dk", "w", F.posexplode_outer("w").alias("i", "word"))  # outer: else a filter on w is added, which computes it twice
        met = places.join(F.broadcast(probes), "word")
    else:  # the exchange by word carries places alone, with a word's copies dealt over SPREAD tasks; texts meet the places that are left
        copy = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("copy")
        places = words.select("dk", F.posexplode("w").alias("i", "word")).withColumn("copy", F.pmod(F.col("i"), F.lit(SPREAD)))
        met = places.join(probes.select("word", "at", "key", "words", copy), ["word", "copy"]).where(begin >= 0).select("dk", "i", "at", "key", "words")
        met = stored(met, "item-places")
        texts = words.join(small(stored(met.select("dk").distinct(), "texts-with-places")), "dk", "left_semi").dropDuplicates(["dk"])
        met = met.join(texts, "dk")
    hits = met.where(there).select("dk", begin.alias("begin"), F.size("words").alias("n"), "key")
    hits = stored(hits.distinct(), "item-hits")
    spans = hits.groupBy("dk").agg(F.collect_set(F.struct("begin", "n")).alias("spans"))
    spans = spans.select(
        "dk",
        F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["begin"], s["begin"] + s["n"] - 1))))).cast("long").alias("n_hit"),
    )
    named = hits.select("dk", "key").distinct().join(small(members), "key").groupBy("dk").agg(F.array_sort(F.collect_set("item")).alias("items"))
    counted = F.size(F.array_remove(F.split(whole(F.col(text_col)), _BETWEEN), "")).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), counted.alias("n_words"), key)
    rows = rows.join(spans, "dk", "left").join(named, "dk", "left")
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )
