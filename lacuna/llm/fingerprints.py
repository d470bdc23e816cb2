"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions alone.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash space (FracMinHash), and in any case the
`floor_size` smallest, so that short documents keep all. It says up to which hash it is complete; two sketches are
compared up to the smaller of their bounds, whatever the documents' lengths, and sketches of parts merge by union.
Hashes are the first 16 hex digits of the shingle's MD5, compared as text: any SQL engine gets the same sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import ascii_lower, stored, whole

#: Above every hash: the bound of a sketch that keeps all.
COMPLETE = "g"


def words(text: Column) -> Column:
    """Lower-cased words between ASCII white space; none for null."""
    return F.array_remove(F.split(ascii_lower(whole(text)), "[\\x20\\x09-\\x0D]+"), "")


def with_sketch(df: DataFrame, text_col: str, out: str, shingle: int = 5, digits: str = "2", floor_size: int = 32) -> DataFrame:
    """df with the column `out`: struct(bound, hashes), hashes ascending and complete for all hashes <= bound.

    digits: the hash below which all are kept, as hex digits; "2" keeps an eighth. A text of fewer than `shingle` words
    is one shingle; a null or empty one has an empty, complete sketch. Each step is a column of its own, as it is used
    more than once.
    """
    w, found, below, hashes = (f"__{out}_{x}" for x in ("words", "found", "below", "hashes"))
    hashed = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(w) - F.lit(shingle - 1), F.lit(1))),
        lambda i: F.substring(F.md5(F.array_join(F.slice(F.col(w), i, shingle), " ")), 1, 16),
    )
    return (
        df.withColumn(w, words(F.col(text_col)))
        .withColumn(found, F.when(F.size(w) > 0, F.array_sort(F.array_distinct(hashed))).otherwise(F.array().cast("array<string>")))
        .withColumn(below, F.filter(found, lambda h: h < F.lit(digits)))
        .withColumn(hashes, F.when(F.size(below) < floor_size, F.slice(found, 1, floor_size)).otherwise(F.col(below)))
        .withColumn(
            out,
            F.struct(
                F.when(F.size(hashes) == F.size(found), F.lit(COMPLETE))
                .when(F.size(below) < floor_size, F.get(hashes, F.size(hashes) - 1))
                .otherwise(F.lit(digits))
                .alias("bound"),
                F.col(hashes).alias("hashes"),
            ),
        )
        .drop(w, found, below, hashes)
    )


def packed(sk: Column) -> Column:
    """The sketch with its hashes as bytes, eight for each, as it is sent through exchanges; in the same order as the sketches."""
    return F.struct(sk["bound"].alias("bound"), F.unhex(F.array_join(sk["hashes"], "")).alias("hashes"))


def with_unpacked(df: DataFrame, packed_col: str, out: str) -> DataFrame:
    """df with the column `out`: the sketch that `packed_col` holds. The hashes are a column of their own, as they are used more than once."""
    hashes = f"__{out}_hashes"
    made = df.withColumn(hashes, F.regexp_extract_all(F.lower(F.hex(F.col(packed_col)["hashes"])), F.lit("[0-9a-f]{16}"), F.lit(0)))
    return made.withColumn(out, F.struct(F.col(packed_col)["bound"].alias("bound"), F.col(hashes).alias("hashes"))).drop(hashes)


def fingerprint(sk: Column) -> Column:
    """The sketch as text."""
    return F.concat(sk["bound"], F.lit(":"), F.array_join(sk["hashes"], ","))


def _shared(a: Column, b: Column) -> tuple[Column, Column, Column]:
    bound = F.least(a["bound"], b["bound"])
    x, y = (F.filter(s["hashes"], lambda h: h <= bound) for s in (a, b))
    return F.size(F.array_intersect(x, y)), F.size(x), F.size(y)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches' shingle sets, 0 to 1; two empty ones are alike, 1."""
    common, x, y = _shared(a, b)
    return F.when(x + y == 0, F.lit(1.0)).otherwise(common / (x + y - common))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too; 0 where none of a's can be compared."""
    common, x, _ = _shared(a, b)
    return F.when(x == 0, F.lit(0.0)).otherwise(common / x)


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts together."""
    bound = F.least(a["bound"], b["bound"])
    hashes = F.filter(F.array_sort(F.array_union(a["hashes"], b["hashes"])), lambda h: h <= bound)
    return F.struct(bound.alias("bound"), hashes.alias("hashes"))


def next_ids(ids: DataFrame) -> DataFrame:
    """For distinct doc_id with n_chars: doc_id, n_chars, next_id, in descending order; after the last comes the first, null is the last.

    The ids, without texts, are sorted over range partitions and stored with their partition's number. The successor is
    a window within a partition; over partitions only their first ids are ordered, one row for each partition.
    """
    tasks = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("doc_id").desc_nulls_last()
    sorted_ids = stored(ids.repartitionByRange(tasks, order).withColumn("part", F.spark_partition_id()), "ordered-ids")
    in_part, parts = Window.partitionBy("part").orderBy(order), Window.orderBy("part")
    ranked = sorted_ids.withColumn("rank", F.row_number().over(in_part)).withColumn("after", F.lead(F.struct("doc_id")).over(in_part))
    firsts = ranked.where("rank = 1").select("part", F.struct("doc_id").alias("first"))
    firsts = firsts.select(
        "part",
        F.coalesce(F.lead("first").over(parts), F.first("first").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("then"),
    )
    return ranked.join(firsts, "part").select("doc_id", "n_chars", F.coalesce("after", "then")["doc_id"].alias("next_id"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's packed sketch beside its edited text and its successor's packed sketch: doc_id, n_chars, edited, own, following.

    Edited: the last third of the code points (rounded down) replaced by the first as many of the next document in
    descending doc_id. Each text is sketched once, before the one exchange that both joins read; only the beginning and
    the sketch travel to the neighbour. Rows that repeat a doc_id are kept; as a successor, the one with the greatest
    beginning stands for them.
    """
    # The keys of the joins are never null, and those of the aggregation between, so that its exchange serves the join too.
    key = lambda c, name: (F.coalesce(F.col(c), F.lit(0)).alias(name), F.isnull(c).alias(f"{name}_null"))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(F.col(text_col)).alias("text"))
    ids = docs.select("doc_id", F.char_length("text").alias("n_chars")).groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"))
    docs = with_sketch(docs.select("text", *key("doc_id", "k")), "text", "sketch")
    docs = docs.select("text", "k", "k_null", packed(F.col("sketch")).alias("own"))  # the same columns for both joins, or their exchanges would differ
    wanted = next_ids(ids).select(*key("next_id", "k"), *key("doc_id", "t"), F.expr("n_chars div 3").cast("int").alias("need"))
    sent = docs.join(wanted, ["k", "k_null"]).select("t", "t_null", F.expr("left(text, need)").alias("beginning"), F.col("own").alias("following"))
    sent = sent.groupBy("t", "t_null").agg(F.max(F.struct("beginning", "following")).alias("next"))
    both = docs.join(sent, (docs["k"] == sent["t"]) & (docs["k_null"] == sent["t_null"]), "left").withColumn("n_chars", F.char_length("text").cast("long"))
    return both.select(
        F.when(~F.col("k_null"), F.col("k")).alias("doc_id"),
        "n_chars",
        F.concat(F.expr("left(text, cast(n_chars - n_chars div 3 as int))"), F.expr("left(next.beginning, cast(n_chars div 3 as int))")).alias("edited"),
        "own",
        F.col("next.following").alias("following"),
    )


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the containments of the document in both.

    A null text is empty; an empty table gives no rows; with one document alone, it is its own successor; other columns
    are ignored.
    """
    rows = with_sketch(edited_pairs(docs, id_col, text_col), "edited", "changed")
    rows = with_unpacked(with_unpacked(rows, "own", "own_sketch"), "following", "next_sketch")
    own, changed, following = F.col("own_sketch"), F.col("changed"), F.col("next_sketch")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        fingerprint(own).alias("fingerprint"),
        fingerprint(changed).alias("edited_fingerprint"),
        likeness(own, changed).alias("near_edited"),
        likeness(own, following).alias("near_next"),
        containment(own, changed).alias("contained_in_edited"),
        containment(own, following).alias("contained_in_next"),
    )
