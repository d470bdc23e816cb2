"""The trie of all conversations' prefixes, with count-min screening of prefix digests.

A prefix is named by 128 bits that its turns' digests and places make, so a prefix of any length costs one row and texts
never move. A count-min sketch over the digests of all prefixes is merged from the tasks' counts and broadcast; its size
is bounded. Where the estimate is one the prefix has one member for certain: its node is emitted where it stands. Only
prefixes that may be shared are shuffled, and grouped exactly. More input than the sketch is made for means more rows
in the exact grouping, never another result.

No task needs a whole conversation: turns are dealt into blocks by range, and what a block takes from those before it
comes from a table of one row per conversation and block. A node's sums over its subtree are sums over its members:
a member adds the tokens of its deeper turns that another conversation stands for, and one leaf where it stands for one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import stored, whole

#: Hash rows of the sketch, and cells of a segment; a segment is 8 KB when merged.
HASHES, SEGMENT = 4, 1 << 16
#: Turns that are taken from the conversation that opens a hundred.
MOST_SHARED = 5
_NONE = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, block, i, a, b, chars): each turn's place i in its conversation, 128 bits of its digest, code points of its text.

    By turn, null first; equal turns by their digest; rows without conv_id belong to no conversation and are left out.
    A conversation lies in as many blocks as range partitions hold it.
    """
    role, text = whole(F.col(role_col)), whole(F.col(text_col))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    part = lambda k: F.conv(F.substring("digest", k, 16), 16, -10).cast("long")
    turns = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars"))
    turns = stored(turns.select("conv_id", "turn", part(1).alias("a"), part(17).alias("b"), "chars", F.monotonically_increasing_id().alias("row")), "turns")
    unsigned = lambda c: F.col(c).bitwiseXOR(F.lit(-(1 << 63)))
    order = [F.asc_nulls_first("turn"), unsigned("a").asc(), unsigned("b").asc(), F.asc("row")]
    placed = stored(turns.repartitionByRange(F.asc("conv_id"), *order).withColumn("block", F.spark_partition_id()), "turn-blocks")
    blocks = placed.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    local = placed.withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(*order)))
    return local.join(blocks.select("conv_id", "block", "before"), ["conv_id", "block"]).select("conv_id", "block", (F.col("before") + F.col("k") - 1).alias("i"), "a", "b", "chars")


def _mixed(place: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """Two numbers for a turn at a place of its conversation; a prefix's digest is the exclusive or of its turns'."""
    return F.xxhash64(place.cast("long"), a, b), F.xxhash64(b, a, place.cast("long"))


def rebuilt_prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prefixes, conversations) of the rebuilt conversations: the first h turns of conversation c - c % 100, then c's own after its first h; h = crc32(c) % 6.

    prefixes: conv_id, d (its length, from 1), p, q (its digest), p0, q0 (that of the prefix one turn shorter), chars (of
    its last turn), cum (of all its turns), last (it is the whole conversation). conversations: conv_id, n (its turns).
    """
    blocks = stored(turns.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first")), "conversation-blocks")
    own = blocks.groupBy("conv_id").agg(F.sum("n").alias("own"), F.count(F.lit(1)).alias("blocks"))
    opening = turns.where((F.col("conv_id") % 100 == 0) & (F.col("i") < MOST_SHARED))
    opening = opening.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("i", "a", "b", "chars"))).alias("opening"))  # MOST_SHARED turns at most
    each = own.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int"))
    each = each.withColumn("opener", F.col("conv_id") - F.col("conv_id") % 100).join(opening.withColumnRenamed("conv_id", "opener"), "opener", "left")
    nothing = F.array().cast(opening.schema["opening"].dataType)
    each = each.withColumn("head", F.when(F.col("h") > 0, F.slice(F.coalesce("opening", nothing), 1, F.greatest(F.col("h"), F.lit(1)))).otherwise(nothing))
    each = each.withColumn("k", F.size("head").cast("long")).withColumn("n", F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))

    def digest(turns: Column, lane: int) -> Column:
        return F.aggregate(turns, F.lit(0).cast("long"), lambda acc, t: acc.bitwiseXOR(_mixed(t["i"], t["a"], t["b"])[lane]))

    chars = lambda turns: F.aggregate(turns, F.lit(0).cast("long"), lambda acc, t: acc + t["chars"])
    each = each.select("conv_id", "blocks", "h", "k", "n", "head", digest(F.col("head"), 0).alias("hp"), digest(F.col("head"), 1).alias("hq"), chars(F.col("head")).alias("hc"))
    each = stored(each, "conversations")

    def opened(d: Column) -> Column:
        upto, less = F.slice("head", 1, d), F.filter("head", lambda t: t["i"] < d - 1)
        return F.struct(
            d.cast("long").alias("d"), digest(upto, 0).alias("p"), digest(upto, 1).alias("q"), digest(less, 0).alias("p0"), digest(less, 1).alias("q0"),
            F.element_at("head", d)["chars"].alias("chars"), chars(upto).alias("cum"), (d == F.col("n")).alias("last"),
        )

    heads = each.where("k > 0").select("conv_id", F.inline(F.transform(F.sequence(F.lit(1), F.col("k").cast("int")), opened)))

    known = blocks.select("conv_id", "block").join(each.drop("head"), "conv_id")
    rows = turns.join(known, ["conv_id", "block"]).where("i >= h").withColumn("d", F.expr("k + i - h + 1"))
    x, y = _mixed(F.col("d") - 1, F.col("a"), F.col("b"))
    upto = Window.partitionBy("conv_id", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("x", x).withColumn("y", y).select(
        "conv_id", "block", "blocks", "d", "x", "y", "chars", (F.col("d") == F.col("n")).alias("last"),
        F.expr("bit_xor(x)").over(upto).bitwiseXOR(F.col("hp")).alias("p"), F.expr("bit_xor(y)").over(upto).bitwiseXOR(F.col("hq")).alias("q"), (F.sum("chars").over(upto) + F.col("hc")).alias("cum"),
    )
    rows = stored(rows, "own-prefixes")
    long = rows.where("blocks > 1")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = long.groupBy("conv_id", "block").agg(F.expr("bit_xor(x)").alias("x"), F.expr("bit_xor(y)").alias("y"), F.sum("chars").alias("s"))
    carried = carried.select("conv_id", "block", *(F.coalesce(F.expr(f).over(before), F.lit(0)).alias(c) for f, c in (("bit_xor(x)", "cx"), ("bit_xor(y)", "cy"), ("sum(s)", "cs"))))
    long = long.join(carried, ["conv_id", "block"])
    long = long.withColumn("p", F.expr("p ^ cx")).withColumn("q", F.expr("q ^ cy")).withColumn("cum", F.expr("cum + cs")).select(rows.columns)
    tails = rows.where("blocks = 1").unionByName(long).select("conv_id", "d", "p", "q", F.expr("p ^ x").alias("p0"), F.expr("q ^ y").alias("q0"), "chars", "cum", "last")
    return heads.unionByName(tails), each.select("conv_id", "n")


@dataclass
class CountMin:
    """Which cells were hit twice or more, one bit each; a prefix one of whose cells was hit once has no other member."""

    width: int
    twice: np.ndarray

    def lone(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        out = np.zeros(len(p), dtype=bool)
        for cell in _cells(p, q, self.width):
            out |= (self.twice[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 0
        return out


def _cells(p: np.ndarray, q: np.ndarray, width: int) -> Iterator[np.ndarray]:
    p, q = p.astype(np.uint64), q.astype(np.uint64) | np.uint64(1)
    for k in range(HASHES):
        yield ((p + np.uint64(k) * q) % np.uint64(width)).astype(np.int64) + k * width


def count_min(prefixes: DataFrame, most_cells: int = 1 << 27, segment_cells: int = SEGMENT) -> CountMin:
    """The sketch of all (p, q) in prefixes: two cells of a hash row for each prefix, up to most_cells (then 4 * most_cells bits, 64 MB, in all).

    A task counts 2**18 prefixes at a time and sends, by segment, the cells that it hit once and those hit more often; a
    segment's counts are added in one task, and only whether they reach two is kept.
    """
    n = prefixes.count()
    width = max(segment_cells // HASHES, min(most_cells, 1 << (2 * n).bit_length()))

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for part in parts:
            held.append((part["p"].to_numpy(), part["q"].to_numpy()))
            size += len(part)
            if size >= 1 << 18:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    def packed(held: list) -> pd.DataFrame:
        p, q = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        cell, times = np.unique(np.concatenate(list(_cells(p, q, width))), return_counts=True)
        segment, start = np.unique(cell // segment_cells, return_index=True)
        places, often = (np.split(v, start[1:]) for v in ((cell % segment_cells).astype(np.uint16), times > 1))
        return pd.DataFrame({"segment": segment, "once": [x[~o].tobytes() for x, o in zip(places, often)], "more": [x[o].tobytes() for x, o in zip(places, often)]})

    def added(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        hits = np.zeros(segment_cells, dtype=np.uint8)
        for once, more in zip(part["once"], part["more"]):
            at = np.frombuffer(once, dtype=np.uint16)  # each cell at most once
            hits[at] = np.minimum(hits[at] + 1, 2)
            hits[np.frombuffer(more, dtype=np.uint16)] = 2
        return pd.DataFrame({"segment": [key[0]], "bits": [np.packbits(hits >= 2, bitorder="little").tobytes()]})

    merged = prefixes.select("p", "q").mapInPandas(counted, "segment long, once binary, more binary").groupBy("segment").applyInPandas(added, "segment long, bits binary")
    twice = np.zeros(HASHES * width // 8, dtype=np.uint8)
    for row in merged.toLocalIterator(prefetchPartitions=True):
        twice[row.segment * (segment_cells // 8) : (row.segment + 1) * (segment_cells // 8)] = np.frombuffer(row.bits, dtype=np.uint8)
    return CountMin(width, twice)


def screened(prefixes: DataFrame, sketch: CountMin) -> DataFrame:
    """prefixes with lone (no other conversation has this prefix, for certain) and lone0 (the same of the prefix one turn shorter; false at the root)."""
    held = prefixes.sparkSession.sparkContext.broadcast(sketch)

    @F.pandas_udf("lone boolean, lone0 boolean")
    def judge(p: pd.Series, q: pd.Series, p0: pd.Series, q0: pd.Series) -> pd.DataFrame:
        s = held.value
        return pd.DataFrame({"lone": s.lone(p.to_numpy(), q.to_numpy()), "lone0": s.lone(p0.to_numpy(), q0.to_numpy())})

    judged = prefixes.withColumn("judged", judge("p", "q", "p0", "q0"))
    return judged.select(*prefixes.columns, "judged.lone", (F.col("judged.lone0") & (F.col("d") > 1)).alias("lone0"))


def _digests_of_ends(ends: DataFrame) -> DataFrame:
    """(p, q, ends_sha256) of ends (p, q, conv_id): SHA-256 of each node's conv_ids, ascending, comma-joined.

    Ids are sorted by range and joined to pieces of text where they lie, so one node's ids may fill any number of tasks; the
    pieces of a node are then hashed one after the other, as SHA-256 asks, with nothing but the hash's state in memory.
    """

    def joined(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            key = part[["p", "q"]].to_numpy()
            cut = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1 if len(key) else np.zeros(0, dtype=int)
            begin = np.concatenate([[0], cut]).astype(int)
            if len(key):
                ids = part["conv_id"].to_numpy()
                yield pd.DataFrame({"p": key[begin, 0], "q": key[begin, 1], "first": ids[begin], "piece": [",".join(map(str, x.tolist())) for x in np.split(ids, cut)]})

    def hashed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for part in parts:
            out = []
            for p, q, piece in zip(part["p"].tolist(), part["q"].tolist(), part["piece"]):
                if (p, q) == now:
                    state.update(b"," + piece.encode())
                    continue
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = (p, q), hashlib.sha256(piece.encode())
            yield pd.DataFrame(out, columns=["p", "q", "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(*now, state.hexdigest())], columns=["p", "q", "ends_sha256"])

    pieces = ends.select("p", "q", "conv_id").repartitionByRange("p", "q", "conv_id").sortWithinPartitions("p", "q", "conv_id").mapInPandas(joined, "p long, q long, first long, piece string")
    return pieces.repartition("p", "q").sortWithinPartitions("p", "q", "first").mapInPandas(hashed, "p long, q long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, most_cells: int = 1 << 27, **columns: str) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations (see rebuilt_prefixes), the textless root included.

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256; p and q, the node's digest (0 at the root). Null roles and texts are empty; rows that are repeated are turns each; equal turns
    go by their digests; rows without conv_id are left out; an empty table has no conversation and no node, not even a root.
    Other columns are ignored. Prefixes are told apart by 128 bits.
    """
    turns = stored(numbered_turns(conversations, **columns), "numbered-turns")
    found, convs = rebuilt_prefixes(turns)
    prefixes = stored(found, "prefixes")
    rows = stored(screened(prefixes, count_min(prefixes, most_cells)), "screened")
    key = ["p", "q"]

    # what may be shared: grouped exactly, then each member learns whom its node is named after
    shared = rows.where(~F.col("lone"))
    nodes = stored(shared.groupBy("d", "p", "q", "p0", "q0", "lone0").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("last").cast("long")).alias("n_ends")), "shared-nodes")
    tops = rows.where(F.col("lone") & ~F.col("lone0") & (F.col("d") > 1)).select("p0", "q0")
    below = nodes.where(~F.col("lone0") & (F.col("d") > 1)).select("p0", "q0").unionByName(tops).groupBy("p0", "q0").agg(F.count(F.lit(1)).alias("n_children"))
    below = below.withColumnsRenamed({"p0": "p", "q0": "q"})
    named = nodes.join(below, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    named = stored(named, "named-nodes")
    members = stored(shared.select("conv_id", "p", "q", "chars", "cum", "last").join(named.select("p", "q", F.col("conv_id").alias("named"), "n_children"), key), "members")

    # of each conversation: the tokens down to its last turn that another stands for, and whether it stands for a leaf
    stands = members.groupBy("conv_id").agg(
        F.max(F.when(F.col("named") != F.col("conv_id"), F.col("cum"))).alias("borrowed"),
        F.max((F.col("last") & (F.col("n_children") == 0) & (F.col("named") == F.col("conv_id"))).cast("long")).alias("leaf"),
    )
    lone_ends = rows.where("last and lone").select("conv_id", F.lit(1).cast("long").alias("own_leaf"))
    each = convs.join(stands, "conv_id", "left").join(lone_ends, "conv_id", "left")
    each = stored(each.select("conv_id", "n", F.coalesce("borrowed", F.lit(0)).alias("borrowed"), F.greatest(F.coalesce("leaf", F.lit(0)), F.coalesce("own_leaf", F.lit(0))).alias("leaf")), "standing")

    sums = members.join(each, "conv_id").groupBy("p", "q").agg(F.sum("leaf").alias("n_leaves"), F.sum(F.greatest(F.col("borrowed") - F.col("cum") + F.col("chars"), F.lit(0))).alias("saved_tokens"))
    root = F.lit(0).cast("long")
    empty = each.where("n = 0").select(root.alias("p"), root.alias("q"), "conv_id")
    digests = _digests_of_ends(members.where("last").select("p", "q", "conv_id").unionByName(empty))

    # names of parents: of a shared parent by its digest, of a lone parent its only member; the root is named after the smallest conversation
    top = each.agg(F.min("conv_id").alias("top"), F.count(F.lit(1)).alias("convs"), F.sum("leaf").alias("leaves"), F.sum("borrowed").alias("saved")).where("convs > 0")
    parents = named.select(F.col("p").alias("p0"), F.col("q").alias("q0"), F.col("conv_id").alias("parent_conv_id"))
    under_root = F.col("d") == 1
    columns_of = lambda parent: ["conv_id", F.col("d").alias("depth"), parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "p", "q"]

    whole_nodes = named.join(sums, key).join(digests, key, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NONE)))
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    lone = rows.where("lone").select(
        "conv_id", "d", "p0", "q0", "lone0", "p", "q", one.alias("n_convs"), F.when(F.col("last"), zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"),
        F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(_NONE)).alias("ends_sha256"),
    )
    local = lone.where("lone0").select(*columns_of(F.col("conv_id")))
    other = whole_nodes.select(*lone.columns).unionByName(lone.where("not lone0"))
    alone = other.where("lone0").select(*columns_of(F.col("conv_id")))  # may be shared by the sketch, though its parent is not
    linked = other.where(~F.col("lone0") & ~under_root).join(parents, ["p0", "q0"]).select(*columns_of(F.col("parent_conv_id")))
    firsts = stored(other.where(under_root), "first-turns")
    first = firsts.crossJoin(F.broadcast(top)).select(*columns_of(F.col("top")))  # top is one row
    roots = top.crossJoin(firsts.agg(F.count(F.lit(1)).alias("n_children")))
    roots = roots.join(digests.where("p = 0 and q = 0").select("ends_sha256"), how="left").select(  # one row against one at most
        F.col("top").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("convs").alias("n_convs"), "n_children",
        F.when(F.col("n_children") == 0, one).otherwise(F.col("leaves")).alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"), root.alias("p"), root.alias("q"),
    )
    return local.unionByName(alone).unionByName(linked).unionByName(first).unionByName(roots)
