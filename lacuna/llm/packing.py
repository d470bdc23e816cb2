"""Packing into training sequences as vector bin packing.

Each example is a vector (tokens, segments, loss-bearing tokens); each sequence has a limit in every dimension. Among
the waiting examples that fit into what is left of the open sequence, the one with the largest dot product of its
vector and the remaining room goes in. Where cutting is allowed and none fits, the best one is cut to fill the rest.
Every partition packs its own rows as they stream by: no shuffle, and memory is bounded by the waiting list.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import whole


class Packer:
    """Places examples with the dot-product heuristic; `placed` holds (key, start, length, sequence, offset) of what is done."""

    def __init__(self, tokens: int = 1024, segments: int = 64, loss: int | None = None, waiting: int = 256, cut: bool = True):
        self.room = np.array([tokens, segments, loss or tokens], dtype=np.float64)
        self.cut, self.waiting = cut, waiting
        self.vectors = np.zeros((waiting, 3))
        self.items: list = [None] * waiting  # key, start
        self.n = 0
        self.sequence = 0
        self.left = self.room.copy()
        self.open: list = []
        self.placed: list = []

    def add(self, key, start: int, length: int, loss: int) -> None:
        while self.n == self.waiting:
            self._place()
        self.vectors[self.n] = length, 1, loss
        self.items[self.n] = key, start
        self.n += 1

    def _place(self) -> None:
        """Put at least one waiting example, or a part of one, into the open sequence, or close it."""
        while True:
            v = self.vectors[: self.n]
            fits = (v <= self.left).all(axis=1)
            score = (v / self.room) @ (self.left / self.room)
            last = self.cut and self.left[1] == 1 and self.left[0] > 0  # the last segment should fill what is left
            if fits.any() and not (last and (v[:, 0] > self.left[0]).any()):
                k = int(np.where(fits, score, -1).argmax())
                self._put(k, int(v[k, 0]), int(v[k, 2]))
                return
            if self.cut and self.left.min() >= 1:
                k = int(np.where(v[:, 0] > 0, score, -1).argmax())
                length = int(min(self.left[0], v[k, 0]))
                share = v[k, 2] / v[k, 0]
                if length * share > self.left[2]:
                    length = int(self.left[2] // share)
                if length > 0:
                    self._put(k, length, int(round(length * share)))
                    return
            self._close()

    def _put(self, k: int, length: int, loss: int) -> None:
        key, start = self.items[k]
        self.open.append((key, start, length))
        self.left -= (length, 1, loss)
        if length < self.vectors[k, 0]:
            self.items[k] = key, start + length
            self.vectors[k] -= (length, 0, loss)
        else:
            self.n -= 1
            self.items[k], self.vectors[k] = self.items[self.n], self.vectors[self.n]
            self.items[self.n] = None
        if self.left[0] < 1 or self.left[1] < 1:
            self._close()

    def _close(self) -> None:
        at = 0
        for key, start, length in self.open:
            self.placed.append((key, start, length, self.sequence, at))
            at += length
        if self.open:
            self.sequence += 1
        self.open, self.left = [], self.room.copy()

    def alone(self, key, start: int, length: int) -> None:
        """A piece that fills a whole sequence."""
        self.placed.append((key, start, length, self.sequence, 0))
        self.sequence += 1

    def finish(self) -> None:
        """Place all that wait. With cutting, what is left at the end goes into sequences whose lengths are powers of two."""
        while self.n:
            self._place()
        if self.cut and self.open:
            rest, self.open = self.open, []
            total = sum(x[2] for x in rest)
            while total:
                size = 1 << (total.bit_length() - 1)
                total -= size
                while size:
                    key, start, length = rest[0]
                    part = min(size, length)
                    self.open.append((key, start, part))
                    size -= part
                    if part == length:
                        rest.pop(0)
                    else:
                        rest[0] = key, start + part, length - part
                self._close()
        self._close()


#: Python's white space holds all of the patterns' and four control characters more, for which the full pattern is taken too.
_ADJACENT = re.compile(r"\s\s")


#: A run of the patterns' white space that is too long for their look-ahead, whose stack grows with it.
_LONG = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


class ByteEncoder:
    """Ids of a byte-level BPE tokenizer file, as little-endian unsigned 32-bit bytes.

    The file's vocabulary is run by tiktoken, which gives the same ids in a fraction of the time. Where no two white-space
    characters of any kind are adjacent, the pattern needs no look-ahead, which is faster still. A very long run of white space is cut out by
    hand: up to the character before the next word it is one piece, which the merges go through without any pattern.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, file: str):
        import tiktoken

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        made = lambda name, pattern: tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.any, self.single, self.one = made("any", self.PATTERN), made("single", self.PATTERN.replace(r"|\s+(?!\S)", "")), made("one", r"[\s\S]+")

    def __call__(self, text: str) -> bytes:
        if not _ADJACENT.search(text):
            return self._ids(self.single, text)
        at, out = 0, []
        for run in _LONG.finditer(text) if len(text) >= 4096 else ():
            end = run.end() - (run.end() < len(text))
            out += [self._ids(self.any, text[at : run.start()]), self._ids(self.one, text[run.start() : end])]
            at = end
        return b"".join([*out, self._ids(self.any, text[at:])])

    @staticmethod
    def _ids(encoding, text: str) -> bytes:
        return encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()


@lru_cache(2)
def _encoder(file: str) -> ByteEncoder:
    return ByteEncoder(file)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, n_loss long"


def pack_documents(
    docs: DataFrame,
    tokenizer_file: str,
    capacity: int = 1024,
    max_segments: int = 64,
    max_loss: int | None = None,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most `capacity` tokens, `max_segments` pieces, `max_loss` loss-bearing tokens.

    A document is its ids and then end_id; every id bears loss. Full sequences are cut off first, the rest is packed.
    Null and empty texts consist of end_id alone; repeated rows are packed each; an empty table gives no pieces; other
    columns are ignored. Sequence ids are unique over the table: the partition in the high bits, a count in the low 40.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base = _encoder(tokenizer_file), TaskContext.get().partitionId() << 40
        packer = Packer(capacity, max_segments, max_loss)
        end = np.array([end_id], dtype="<u4").tobytes()
        full = int(min(packer.room[0], packer.room[2]))

        def flushed() -> pa.RecordBatch:
            done, packer.placed = packer.placed, []
            rows = [(k[0], s, n, zlib.crc32(k[1][4 * (s - k[3]) : 4 * (s - k[3] + n)]), k[2], base + q, o, n) for k, s, n, q, o in done]
            columns = list(zip(*rows)) or [[]] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "n_loss"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                total, start = len(ids) // 4, 0
                while total - start >= full:
                    packer.alone((doc_id, ids, total, 0), start, full)
                    start += full
                if start < total:
                    packer.add((doc_id, ids[4 * start :], total, start), start, total - start, total - start)
                if len(packer.placed) >= 4096:
                    yield flushed()
        packer.finish()
        yield flushed()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(F.col(text_col)).alias("text")).mapInArrow(run, PIECES)


def pack_examples(
    examples: DataFrame, capacity: int = 1024, max_segments: int = 16, max_loss: int | None = None, id_col: str = "id", tokens_col: str = "n_tokens", loss_col: str = "n_loss"
) -> DataFrame:
    """Whole instruction examples, never cut: (id, length, n_loss, sequence_id, offset).

    An example beyond a limit by itself, or without a length, can't be placed: its sequence_id and offset are null, it isn't dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        packer = Packer(capacity, max_segments, max_loss, cut=False)

        def made(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "length", "n_loss", "sequence_id", "offset"])

        def flushed() -> pa.RecordBatch:
            done, packer.placed = packer.placed, []
            return made([(k[0], n, k[1], base + q, o) for k, _, n, q, o in done])

        for batch in batches:
            odd = []
            for key, n, loss in zip(*(c.to_pylist() for c in batch.columns)):
                loss = min(loss or 0, n or 0)
                if n is None or n < 0 or n > packer.room[0] or loss > packer.room[2]:
                    odd.append((key, n, loss, None, None))
                else:
                    packer.add((key, loss), 0, n, loss)
            yield made(odd)
            yield flushed()
        packer.finish()
        yield flushed()

    columns = [F.col(c).cast("long").alias(a) for c, a in ((id_col, "id"), (tokens_col, "length"), (loss_col, "n_loss"))]
    return examples.select(columns).mapInArrow(run, "id long, length long, n_loss long, sequence_id long, offset long")


def conversation_examples(turns: DataFrame, tokenizer_file: str, loss_role: str = "assistant", end_id: int = 0) -> DataFrame:
    """One instruction example per conversation: id, n_tokens, n_loss. A turn is its text's ids and then end_id; those of turns of loss_role bear loss.

    turns: conv_id, role, text. Null roles and texts are empty; turns without a conv_id are one example without an id; repeated turns count each; an
    empty table gives no examples; other columns are ignored. Only counts leave the tasks, and they are summed before the shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(tokenizer_file), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            lengths = [len(encode(text.as_py()) + end) // 4 for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths, pa.int64())], names=["id", "bears", "n"])

    own = turns.select(F.col("conv_id").cast("long").alias("id"), F.coalesce(F.col("role").cast("string") == loss_role, F.lit(False)).alias("bears"), whole(F.col("text")).alias("text"))
    counted = own.mapInArrow(count, "id long, bears boolean, n long")
    return counted.groupBy("id").agg(F.sum("n").alias("n_tokens"), F.sum(F.when(F.col("bears"), F.col("n")).otherwise(0)).alias("n_loss"))
