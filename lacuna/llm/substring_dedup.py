"""Exact removal of repeated substrings, by suffix arrays over the places that can repeat.

Every window of `length` bytes has an anchor that depends on its content alone: the leftmost place in it with the
smallest rolling hash, on which side of the window's middle it lies, and the hash of the bytes that all windows with
such an anchor share. Windows in a row with equal anchors form a fragment. Equal windows have equal anchors, so only
fragments whose anchor occurs again can hold repeats, and each anchor's fragments can be judged apart. Their suffix
array, by induced sorting, and permuted common prefixes tell which windows occur twice.

Equal fragments are one class, which enters the suffix array once; what is found holds for all, and of a class with two
places every window occurs twice. A line or phrase that is common but shorter than half a window shares no anchor, so no anchor gathers all its places.
Where a longer one lies in many differing surroundings, its anchor's fragments are too much for one array: their
windows are dealt by a 128-bit BLAKE2 digest of their bytes and counted, so equal windows meet and no task holds an anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import stored, whole
from lacuna.llm.decontamination import small
from lacuna.llm.shingles import mixed, powers, text_buffers
from lacuna.llm.suffixes import common_prefixes, suffix_array

#: Bytes of the rolling hash.
GRAM = 32
#: Bytes that one suffix array covers, and bytes of text that anchors are sought in at once.
BLOCK, STRETCH = 1 << 20, 1 << 18
#: Bits of a filter for each key, at least, and bits of a filter, at most (as 64-bit words by number, some 16 MB).
KEY_BITS, MOST_BITS = 8, 1 << 25
#: Bytes of one anchor's fragments that enter a suffix array, at most; above, their windows are counted one by one.
HOT = 1 << 18
_A, _B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_A1, _B1 = (pow(x, -1, 1 << 64) for x in (_A, _B))
_PLACE = np.uint64((1 << 24) - 1)


class _Sums:
    """Hashes of any stretches of a text, from running sums."""

    def __init__(self, data: np.ndarray, base: int, inverse: int):
        n = len(data)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, n))))
        self.inverse = powers(inverse, n + 1)

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * self.inverse[begin]


def fragments_of(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor, digest 1, digest 2, start, bytes, whether it may repeat in itself) of the fragments of one text: together they hold each of its windows once."""
    out: list[tuple[np.ndarray, ...]] = []
    n, reach = len(data), length - GRAM + 1
    for begin in range(0, n - length + 1, STRETCH):  # windows that begin in this stretch
        part = data[begin : min(n, begin + STRETCH + length - 1)]
        m = len(part)
        first, second = _Sums(part, _A, _A1), _Sums(part, _B, _B1)
        at = np.arange(m - GRAM + 1)
        lowest = (mixed(first(at, at + GRAM)) & ~_PLACE) | at.astype(np.uint64)
        width = 1
        while 2 * width <= reach:
            lowest = np.minimum(lowest[:-width], lowest[width:])
            width *= 2
        if width < reach:
            lowest = np.minimum(lowest[: len(lowest) - (reach - width)], lowest[reach - width :])
        windows = np.arange(len(lowest))
        place = (lowest & _PLACE).astype(np.int64)
        half = (length - GRAM) // 2
        late = place - windows >= half
        turn = np.concatenate(([True], (place[1:] != place[:-1]) | (late[1:] != late[:-1])))
        starts = np.flatnonzero(turn)
        p, side = place[starts], late[starts]
        shared = first(np.where(side, p - half, p), np.where(side, p + GRAM, p + length - half + 1))
        anchor = mixed((lowest[starts] & ~_PLACE) ^ mixed(shared) ^ np.where(side, np.uint64(0x27D4EB2F165667C5), np.uint64(0)))
        new = np.concatenate(([True], anchor[1:] != anchor[:-1]))
        joined = np.diff(np.concatenate((np.flatnonzero(new), [len(new)]))) > 1  # several places in a row share the anchor: it may repeat in itself
        starts, anchor = starts[new], anchor[new]
        ends = np.concatenate((starts[1:], [len(lowest)])) - 1 + length
        out.append((anchor, first(starts, ends) ^ mixed((ends - starts).astype(np.uint64)), second(starts, ends), starts + begin, ends - starts, joined))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.uint64),) * 3 + (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)


def find_fragments(texts: DataFrame, length: int) -> DataFrame:
    """anchor, d1, d2, dk, start, size, inner of all texts' fragments; texts: dk, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for low in range(0, len(ids), 512):
                got = [(ids[k], fragments_of(data[at[k] : at[k + 1]], length)) for k in range(low, min(low + 512, len(ids))) if at[k + 1] - at[k] >= length]
                if not got:
                    continue
                a, d1, d2, start, size, inner = (np.concatenate([g[1][j] for g in got]) for j in range(6))
                dk = np.repeat(np.array([g[0] for g in got], dtype=np.int64), [len(g[1][0]) for g in got])
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x.view(np.int64)) for x in (a, d1, d2)), pa.array(dk), pa.array(start), pa.array(size), pa.array(inner)],
                    names=["anchor", "d1", "d2", "dk", "start", "size", "inner"],
                )

    return texts.mapInArrow(run, "anchor long, d1 long, d2 long, dk long, start long, size long, inner boolean")


def split_by_keys(texts: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts whose dk may be in keys, texts whose dk is not), by a filter with one bit for each dk, which is broadcast, so that no text is shuffled for it.

    Keys is a stored table of different dk. The more of them beyond MOST_BITS / KEY_BITS, the more texts pass; none of the keys' is ever lost.
    """
    bits = max(64, min(MOST_BITS, 1 << (KEY_BITS * keys.count()).bit_length()))
    slot = F.pmod(F.col("dk"), F.lit(bits).cast("long"))
    words = keys.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word"))
    words = stored(words.agg(F.bit_or(F.expr("shiftleft(1L, int(slot & 63))")).alias("held")), "filter")
    marked = texts.withColumn("word", F.shiftright(slot, 6)).join(F.broadcast(words), "word", "left")
    held = F.coalesce(F.getbit("held", slot.bitwiseAND(F.lit(63))) == 1, F.lit(False))
    return marked.where(held).select(texts.columns), marked.where(~held).select(texts.columns)


def slice_fragments(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """anchor, d1, d2, twice, body of the chosen fragments (anchor, d1, d2, twice, dk, start, size), from their texts.

    No hint to broadcast the places: a text of any length holds any number of them, so Spark is to go by their bytes.
    """
    per_text = stored(chosen.groupBy("dk").agg(F.collect_list(F.struct("anchor", "d1", "d2", "twice", "start", "size")).alias("parts")), "chosen-by-text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch.column(0))
            lists = batch.column(1)
            bounds, fields = lists.offsets.to_numpy(), lists.values
            columns = [fields.field(k) for k in range(4)]
            start, size = (fields.field(k).to_numpy(zero_copy_only=False) for k in (4, 5))
            for k in range(len(batch)):
                text = data[at[k] : at[k + 1]]
                a, b = bounds[k], bounds[k + 1]
                bodies = pa.array([text[s : s + n].tobytes() for s, n in zip(start[a:b], size[a:b])], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in columns), bodies], names=["anchor", "d1", "d2", "twice", "body"])

    found = split_by_keys(texts, per_text)[0].join(per_text, "dk").dropDuplicates(["dk"]).select("text", "parts")  # equal rows hold the same
    return found.mapInArrow(run, "anchor long, d1 long, d2 long, twice boolean, body binary")


def repeats_in(bodies: list[bytes], twice: list[bool], length: int) -> list[np.ndarray]:
    """For each fragment, where windows begin that occur at another place too, by one suffix array over all of them; all do in one that is there twice."""
    parts: list[np.ndarray] = []
    begins, at = [], 0
    for body in bodies:
        begins.append(at)
        parts.append(np.frombuffer(body, np.uint8) + np.uint8(1))  # UTF-8 has no byte above 0xF4; 0 parts fragments
        parts.append(np.zeros(1, np.uint8))
        at += len(body) + 1
    text = np.concatenate(parts)
    order = suffix_array(text)
    agrees = common_prefixes(text, order)[order] >= length
    marked = np.zeros(len(text), dtype=bool)
    marked[order[agrees | np.concatenate((agrees[1:], [False]))]] = True
    return [np.arange(len(x) - length + 1) if two else np.flatnonzero(marked[b : b + len(x) - length + 1]) for b, x, two in zip(begins, bodies, twice)]


def hot_anchors(classes: DataFrame, most: int) -> DataFrame:
    """anchor of those whose classes (anchor, d1, d2, twice, one) have more than `most` bytes."""
    return classes.groupBy("anchor").agg(F.sum("one.size").alias("taken")).where(F.col("taken") > most).select("anchor")


def counted_windows(fragments: DataFrame, length: int) -> DataFrame:
    """anchor, d1, d2, from, to: what repeated_windows finds, by counting each window's digest; no two fragments have to meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["anchor", "d1", "d2", "n", "at", "window"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        for batch in batches:
            for a, d1, d2, two, body in zip(*(c.to_pylist() for c in batch.columns)):
                for low in range(0, len(body) - length + 1, 1 << 14):
                    places = range(low, min(low + (1 << 14), len(body) - length + 1))
                    digests = [hashlib.blake2b(body[k : k + length], digest_size=16).digest() for k in places]
                    columns = [[a] * len(places), [d1] * len(places), [d2] * len(places), [1 + two] * len(places), places, digests]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=names)

    windows = stored(fragments.mapInArrow(run, "anchor long, d1 long, d2 long, n int, at long, window binary"), "hot-windows")
    again = small(stored(windows.groupBy("window").agg(F.sum("n").alias("n")).where("n > 1").select("window"), "hot-again"))
    own = Window.partitionBy("anchor", "d1", "d2").orderBy("at")
    runs = windows.join(again, "window", "left_semi").select("anchor", "d1", "d2", "at", (F.col("at") - F.row_number().over(own)).alias("run"))
    runs = runs.groupBy("anchor", "d1", "d2", "run").agg(F.min("at").alias("from"), (F.max("at") + 1).alias("to"))
    return runs.select("anchor", "d1", "d2", "from", "to")


def repeated_windows(fragments: DataFrame, length: int, tasks: int) -> DataFrame:
    """anchor, d1, d2, spans: for each fragment with repeats, the runs (from, to) of window starts that repeat, ends exclusive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple] = []
        bodies: list[bytes] = []
        twice: list[bool] = []
        held = 0

        def judged() -> pa.RecordBatch:
            out = []
            for key, starts in zip(keys, repeats_in(bodies, twice, length)):
                if len(starts):
                    cut = np.flatnonzero(np.diff(starts) > 1)
                    lo, hi = starts[np.concatenate(([0], cut + 1))], starts[np.concatenate((cut, [len(starts) - 1]))] + 1
                    out.append({"anchor": key[0], "d1": key[1], "d2": key[2], "spans": [{"from": int(a), "to": int(b)} for a, b in zip(lo, hi)]})
            return pa.RecordBatch.from_pylist(out, schema=schema)

        schema = pa.schema([("anchor", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("spans", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))])
        for batch in batches:
            for a, d1, d2, two, body in zip(*(c.to_pylist() for c in batch.columns)):
                if keys and held >= BLOCK and a != keys[-1][0]:
                    yield judged()
                    keys, bodies, twice, held = [], [], [], 0
                keys.append((a, d1, d2))
                bodies.append(body)
                twice.append(two)
                held += len(body)
        if keys:
            yield judged()

    dealt = fragments.repartition(tasks, "anchor").sortWithinPartitions("anchor", "d1", "d2")
    return dealt.mapInArrow(run, "anchor long, d1 long, d2 long, spans array<struct<from:long, to:long>>")


def removed_spans(docs: DataFrame, length: int, most: int = HOT) -> DataFrame:
    """dk, spans: for each text (keyed by dk) with repeats, its byte ranges to remove, not merged yet."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = stored(find_fragments(docs, length), "fragments")
    again = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("inner").alias("inner")).where("n > 1 or inner").select("anchor")
    found = stored(found.join(again, "anchor", "left_semi"), "anchored-again")
    classes = found.groupBy("anchor", "d1", "d2").agg(F.min(F.struct("dk", "start", "size")).alias("one"), (F.count(F.lit(1)) > 1).alias("twice"))
    classes = stored(classes, "fragment-classes")
    hot = stored(hot_anchors(classes, most), "hot-anchors")
    bodies = lambda c: slice_fragments(docs, c.select("anchor", "d1", "d2", "twice", "one.*"))
    repeats = repeated_windows(bodies(classes.join(small(hot), "anchor", "left_anti")), length, tasks).select("anchor", "d1", "d2", F.explode("spans").alias("s")).select("anchor", "d1", "d2", "s.*")
    if hot.limit(1).count():
        repeats = repeats.unionByName(counted_windows(bodies(classes.join(small(hot), "anchor", "left_semi")), length))
    repeats = stored(repeats, "repeats")
    spans = found.join(repeats, ["anchor", "d1", "d2"])
    spans = spans.select("dk", (F.col("start") + F.col("from")).alias("from"), (F.col("start") + F.col("to") + F.lit(length - 1)).alias("to")).distinct()
    return spans.groupBy("dk").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("spans"))


def without_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (merged byte ranges), kept (the bytes left).

    A byte goes if a string of `length` bytes that covers it also begins anywhere else, in this or another text; matches
    never cross texts. Null and empty texts have nothing to remove; equal rows count as places of their own; an empty
    table gives no rows; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(F.col(text_col)).alias("text"))
    texts = texts.select("doc_id", F.xxhash64("doc_id", "text").alias("dk"), "text")
    spans = stored(removed_spans(texts.select("dk", "text"), length), "removed-spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])), pa.binary()]
        for batch in batches:
            data, at = text_buffers(batch.column(1))
            rows: list[list] = [[] for _ in names]
            for k, (doc_id, found) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                body = data[at[k] : at[k + 1]].tobytes()
                merged: list[list[int]] = []
                for s in found or ():
                    if merged and s["from"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["to"])
                    else:
                        merged.append([s["from"], s["to"]])
                edges = [0, *(x for s in merged for x in s), len(body)]
                kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))
                row = (doc_id, len(body), len(body) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), [{"from": a, "to": b} for a, b in merged], kept)
                for column, x in zip(rows, row):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds)], names=names)

    found, clean = split_by_keys(texts, spans)
    joined = found.join(spans, "dk", "left").unionByName(clean.withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)))
    return joined.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<from:long, to:long>>, kept binary")
