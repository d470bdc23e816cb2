"""Exact Jaccard join of word-shingle sets by vertical partitioning.

All shingles have one global order: by how common they are (from counts over all documents), then by hash. The order is
cut into fragments; a set's segment is what it has in a fragment. Two similar sets share shingles in their first
fragment, the necessary prefix, so pairs and their partial overlaps there come from equal prefix shingles; an upper
bound on the whole overlap leaves few of them. For those, each further fragment counts its partial overlap separately,
and the sum per pair decides.

Equal sets are one class, whatever their rows' ids. Only links that join different components are looked for: first
every set is held against the most central set of the prefix lists it is in, then what is in different components still
is paired in full. Pairs of the last kind leave their join only if bit signatures of both sets, whose difference is at
most that of the sets, allow the similarity: a dense group of n texts just below it costs comparisons, but no rows. So
a group of n copies costs about n rows, never n * n, and no component is missed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import stored, whole
from lacuna.llm.components import components
from lacuna.llm.decontamination import small
from lacuna.llm.shingles import mixed, shingle_sets

#: Buckets of the table of how common shingles are, and the parts in which it is summed. Fixed, so it can be sent to every task.
BUCKETS, SLICES = 1 << 22, 64
_SHIFT = np.uint64(42)
#: Bytes of segments that leave a task at once.
PART = 1 << 22
#: Fragments of the global order in which overlaps are counted.
FRAGMENTS = 4
#: Pairs of one set that share a copy of its segments.
DEALT = 64
#: Turns in which components are joined through their lists' central sets, before the rest is paired in full.
STAR_TURNS = 2
#: 64-bit words of a set's signature: each bit is the parity of how many shingles fall on it.
SIGNATURE = 8
BITS = [f"b{k}" for k in range(SIGNATURE)]


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(whole(F.col(text_col))).alias("tk"), whole(F.col(text_col)).alias("text"))


def common_classes(texts: DataFrame) -> np.ndarray:
    """For each bucket of shingle hashes, how far above the mean its count over all documents is: 0, or quarters of a doubling.

    Tasks count into a table of fixed size; its slices are summed in two levels, so no group grows with the input.
    """
    width = BUCKETS // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(BUCKETS, dtype=np.uint32)
        for batch in batches:
            held = [s for _, s in shingle_sets(batch.column(0))]
            if held:
                table += np.bincount((np.concatenate(held) >> _SHIFT).astype(np.int64), minlength=BUCKETS).astype(np.uint32)
        task = TaskContext.get().partitionId() % 1024
        parts = [zlib.compress(table[k * width : (k + 1) * width].tobytes(), 1) for k in range(SLICES)] if table.any() else []
        yield pa.RecordBatch.from_pydict({"slice": pa.array(range(len(parts)), pa.int32()), "task": pa.array([task] * len(parts), pa.int32()), "counts": pa.array(parts, pa.binary())})

    def summed(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, dtype=np.uint64)
        for x in group["counts"]:
            got = zlib.decompress(x)
            total += np.frombuffer(got, dtype=np.uint32 if len(got) == 4 * width else np.uint64)
        return pd.DataFrame({"slice": group["slice"].iloc[:1], "counts": [zlib.compress(total.tobytes(), 1)]})

    schema = "slice int, counts binary"
    parts = texts.select("text").mapInArrow(count, "slice int, task int, counts binary")
    parts = parts.groupBy("slice", "task").applyInPandas(summed, schema).groupBy("slice").applyInPandas(summed, schema)
    table = np.zeros(BUCKETS, dtype=np.float64)
    for r in parts.collect():  # 64 rows, whatever the input
        table[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(zlib.decompress(r["counts"]), dtype=np.uint64)
    mean = max(table.mean(), 1.0)
    return np.clip(4 * np.log2(np.maximum(table, mean) / mean), 0, 255).astype(np.uint8)


def ordered(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The set in the global order; hashes ascend."""
    return hashes[np.argsort(classes[(hashes >> _SHIFT).astype(np.int64)], kind="stable")]


def set_keys(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets have in common."""
    other = mixed(hashes ^ np.uint64(0x5851F42D4C957F2D))
    return int(hashes.sum(dtype=np.uint64).astype(np.int64)), int(other.sum(dtype=np.uint64).astype(np.int64))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Two sets differ in at least as many shingles as their signatures differ in bits."""
    odd = np.bincount((hashes >> np.uint64(55)).astype(np.int64), minlength=64 * SIGNATURE).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def sketched(texts: DataFrame, classes: np.ndarray, percent: int) -> DataFrame:
    """doc_id, tk, n, k1, k2, prefix, b0 ... of every row: set size, the set's keys, the necessary prefix in the global order, and the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = len(batch)
            n, k1, k2, prefix, bits = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64), [np.zeros(0, np.int64)] * m, np.zeros((SIGNATURE, m), np.int64)
            for i, s in shingle_sets(batch.column(2)):
                n[i] = len(s)
                k1[i], k2[i] = set_keys(s)
                prefix[i] = ordered(s, classes)[: len(s) - -(-percent * len(s) // 100) + 1].view(np.int64)
                bits[:, i] = signature(s)
            sizes = np.cumsum([0, *map(len, prefix)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(prefix) if m else np.zeros(0, np.int64)))
            columns = [*batch.columns[:2], pa.array(n), pa.array(k1), pa.array(k2), lists, *map(pa.array, bits)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tk", "n", "k1", "k2", "prefix", *BITS])

    return texts.mapInArrow(run, "doc_id long, tk long, n long, k1 long, k2 long, prefix array<long>, " + ", ".join(f"{b} long" for b in BITS))


def segments(texts: DataFrame, wanted: DataFrame, classes: np.ndarray) -> DataFrame:
    """v, fragment, segment of the wanted (v, k2, one: the row that stands for it): each set cut at the fragments' bounds, its hashes as bytes."""
    rare = FRAGMENTS - 1

    def made(out: tuple[list, list, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.binary()))], names=["v", "fragment", "segment"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(k).to_pylist() for k in (0, 1))
            out: tuple[list, list, list] = ([], [], [])
            held = 0
            for i, s in shingle_sets(batch.column(2)):
                if held > PART:
                    yield made(out)
                    out, held = ([], [], []), 0
                if set_keys(s) != (k1[i], k2[i]):
                    continue
                common = classes[(s >> _SHIFT).astype(np.int64)] > 0
                cut = np.where(common, rare, ((s >> np.uint64(32)) * np.uint64(rare) >> np.uint64(32)).astype(np.int64))
                held += 8 * len(s)
                for f in range(FRAGMENTS):
                    out[0].append(k1[i])
                    out[1].append(f)
                    out[2].append(s[cut == f].tobytes())
            yield made(out)

    wanted = small(wanted.select("v", "k2", F.col("one.tk").alias("t"), F.col("one.id").alias("id")))
    found = texts.join(wanted, (texts["tk"] == wanted["t"]) & texts["doc_id"].eqNullSafe(wanted["id"])).select("v", "k2", "text")
    return found.mapInArrow(run, "v long, fragment int, segment binary").dropDuplicates(["v", "fragment"])


def overlaps(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """(a, b, na, nb, common): partial overlaps of each pair, counted fragment by fragment and summed.

    A set that is held against many others, as the head of a star is, gets a copy of its segments for each DEALT of them, and its pairs are
    dealt over the copies: no task has all pairs of one set.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = [
                len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(shared, pa.int64())], names=["a", "b", "na", "nb", "shared"])

    busy = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / DEALT).cast("int").alias("copies")).where("copies > 1")
    busy = small(stored(busy, "busy-sets"))
    copies = F.coalesce("copies", F.lit(1))
    dealt = pairs.select("a", "b", "na", "nb").join(busy, "b", "left").withColumn("copy", F.pmod(F.xxhash64("a"), copies).cast("int")).drop("copies")
    x = held.select(F.col("v").alias("a"), "fragment", F.col("segment").alias("sa"))
    y = held.select(F.col("v").alias("b"), "fragment", F.col("segment").alias("sb")).join(busy, "b", "left")
    y = y.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies")
    both = dealt.join(x, "a").join(y, ["b", "fragment", "copy"]).select("a", "b", "na", "nb", "sa", "sb")
    return both.mapInArrow(count, "a long, b long, na long, nb long, shared long").groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("common"))


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links reach, its own included).

    Two sets link when 100 * common >= percent * union. Null and empty texts have no shingles and link with nothing.
    Every different text takes part in links by itself, whether its doc_id is null or another text's too; where no row of
    a component has an id, component_id is null. Other columns are ignored; an empty table gives no rows. Shingles and
    sets are told apart by 64-bit hashes.
    """
    ratio = F.lit(100 + percent)
    tail = lambda n: F.floor((F.lit(percent) * n + F.lit(99)) / 100) - 1  # noqa: E731  what of a set lies beyond its prefix
    like_sizes = F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")

    texts = texts_of(docs, id_col, text_col)
    classes = common_classes(texts)
    rows = stored(sketched(texts, classes, percent), "prefixes")
    kinds = rows.where("n > 0").groupBy(F.col("k1").alias("v"), "k2", "n")
    standing = F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id").alias("id"), "tk")
    sets = stored(kinds.agg(F.min(standing).alias("one"), *(F.min(b).alias(b) for b in BITS)), "classes")

    own = kinds.agg(F.first("prefix").alias("prefix")).select("v", "n", F.posexplode("prefix").alias("i", "token"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = own.repartition(tasks, "token")
    lists = own.groupBy("token").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = stored(own.join(lists, "token"), "shared-prefixes")  # only shingles that several sets have
    # How much a set has in common with others: the original of many altered copies stands out.
    central = stored(shared.groupBy("v").agg(F.max("n").alias("n"), (F.sum("size") / F.max(F.col("n") - tail(F.col("n")))).alias("pull")), "vertices")
    shared = shared.select("token", "v", "i")

    def possible(pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes and prefix overlap allow the similarity."""
        return pairs.where(like_sizes & (ratio * (F.col("c") + F.greatest(tail(F.col("na")), tail(F.col("nb")))) >= F.lit(percent) * (F.col("na") + F.col("nb"))))

    def screened(pairs: DataFrame) -> DataFrame:
        """Pairs whose signatures allow the similarity."""
        bits = small(sets.select("v", *BITS))
        for side in "ab":
            pairs = pairs.join(bits.select(F.col("v").alias(side), *(F.col(b).alias(f"{side}_{b}") for b in BITS)), side)
        return pairs.where(close).select("a", "b", "na", "nb")

    close = ratio * sum(F.bit_count(F.col(f"a_{b}").bitwiseXOR(F.col(f"b_{b}"))) for b in BITS) <= F.lit(100 - percent) * (F.col("na") + F.col("nb"))

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        """The pairs (a, b) that link, by their overlaps in every fragment."""
        ids = pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v"))).distinct()
        wanted = stored(sets.select("v", "k2", "one").join(ids, "v", "left_semi"), label + "-ids")
        found = overlaps(pairs, stored(segments(texts, wanted, classes), label + "-segments"))
        return stored(found.where(F.lit(100) * F.col("common") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b"), label + "-links")

    def in_components(links: DataFrame) -> DataFrame:
        """The lists that hold several components: token, v, i, n, pull, c."""
        placed = central.join(small(components(links)), "v", "left").withColumn("c", F.coalesce("c", "v"))
        marked = shared.join(small(stored(placed, "placed")), "v")
        several = marked.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("token")
        return stored(marked.join(several, "token", "left_semi"), "open-lists")

    # In each list every component's most central set is held against the list's. At first, of several lists the one that shares most.
    links, marked = None, shared.join(small(central), "v").withColumn("c", F.col("v"))
    for turn in range(STAR_TURNS):
        ones = marked.groupBy("token", "c").agg(F.max(F.struct("pull", "n", "v")).alias("r")) if turn else marked.select("token", F.struct("pull", "n", "v").alias("r"))
        heads = ones.groupBy("token").agg(F.max("r").alias("h"))
        star = ones.join(heads, "token").where("r.v <> h.v").groupBy(F.col("r.v").alias("a"), F.col("h.v").alias("b"), F.col("r.n").alias("na"), F.col("h.n").alias("nb"))
        star = star.agg(F.count(F.lit(1)).alias("c"))
        if turn:
            star = star.where(like_sizes)
        else:
            star = possible(star).groupBy("a").agg(F.max_by(F.struct("b", "na", "nb"), F.struct("c", "b")).alias("s")).select("a", "s.*")
        found = verified(stored(screened(star), f"star-pairs-{turn}"), f"star-{turn}")
        links = found if links is None else links.unionByName(found)
        marked = in_components(links)

    # Then all pairs across the components of a list. Two sets that share o shingles share one among the first n - o + 1
    # of each: for the smaller, that is a shorter prefix.
    least = lambda n: F.floor((F.lit(percent) * n + F.lit(99 + percent)) / F.lit(100 + percent))  # noqa: E731  o, of both sizes together
    marked = marked.join(small(sets.select("v", *BITS)), "v")
    side = lambda s: marked.select("token", F.col("v").alias(s), *(F.col(x).alias(f"{x}{s}") for x in "nic"), *(F.col(b).alias(f"{s}_{b}") for b in BITS))
    x, y = side("a").where(F.col("ia") <= F.col("na") - least(2 * F.col("na"))), side("b")
    smaller = (F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))
    near = (F.lit(100) * F.col("na") >= F.lit(percent) * F.col("nb")) & (F.col("ia") <= F.col("na") - least(F.col("na") + F.col("nb"))) & (F.col("ib") <= F.col("nb") - least(F.col("na") + F.col("nb")))
    across = (x["token"] == y["token"]) & (F.col("ca") != F.col("cb")) & smaller & near & close
    pairs = stored(x.join(y, across).select("a", "b", "na", "nb").distinct(), "candidates")
    ends = pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v"))).distinct()
    prefixes = rows.select(F.col("k1").alias("v"), "prefix").join(ends, "v", "left_semi").groupBy("v").agg(F.first("prefix").alias("prefix"))
    for s in "ab":
        pairs = pairs.join(prefixes.select(F.col("v").alias(s), F.col("prefix").alias(f"p{s}")), s)
    pairs = stored(possible(pairs.select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).alias("c"))), "cross-pairs")
    final = components(links.unionByName(verified(pairs, "cross")))

    placed = stored(sets.select("v", "k2", F.col("one.id").alias("id")).join(final, "v", "left").withColumn("c", F.coalesce("c", "v")), "placed-classes")
    named = placed.join(stored(placed.groupBy("c").agg(F.min("id").alias("component_id")), "named"), "c").select(F.col("v").alias("k1"), "k2", "component_id")
    where = rows.select("doc_id", F.col("n").alias("n_shingles"), "k1", "k2").join(named, ["k1", "k2"], "left")
    return where.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
