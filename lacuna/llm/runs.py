"""Periodic runs of words, by online dyadic square catching.

A completed block of B = 4, 8, 16, ... words whose start is a multiple of B carries a catcher for the periods from 2B to
4B-1: while words are appended, each suffix of B words that ends within the catcher's reach is compared with its block,
by fingerprints that double from level to level. A match is followed word by word to both sides; while its right side
is the last word it stays open, and each appended word advances it. Periods below 8 have one-word catchers that are
always open. A stretch of two periods or more is a square; squares of one period that touch are one stretch, and of
the stretches over one interval the smallest period is kept: these are the runs. Fingerprints only propose: every run
is compared word by word.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import whole

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Periods below this are followed at every word.
SHORT = 8
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def _equal_until(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements of a and b, of one length, are equal. Looks no further than twice as far as they are."""
    done, step = 0, 32
    while done < len(a):
        other = np.flatnonzero(a[done : done + step] != b[done : done + step])
        if len(other):
            return done + int(other[0])
        done, step = min(done + step, len(a)), step * 2
    return done


class Catchers:
    """Catches the runs of a growing text. Words are numbers; `extend` appends any number of them, one by one or all at once, to the same effect."""

    def __init__(self, least: int = 12):
        self.least = least
        self.ids = np.zeros(0, dtype=np.int64)
        self.prints: list[np.ndarray] = []  # by level k: fingerprints of the 2**k words from each place on
        self.broken = dict.fromkeys(range(1, SHORT), None)  # short period: last place that differs from the word one period before
        self.open: dict[int, int] = {}  # period: start of the stretch that the last word continues
        self.found: dict[tuple[int, int], int] = {}  # (start, end): smallest period

    def _report(self, start: int, end: int, period: int) -> None:
        if end - start >= max(self.least, 2 * period):
            known = self.found.get((start, end))
            self.found[start, end] = period if known is None else min(known, period)

    def extend(self, ids: np.ndarray) -> None:
        old = len(self.ids)
        self.ids = np.concatenate([self.ids, ids]) if old else np.asarray(ids, dtype=np.int64)
        n = len(self.ids)
        if n == old:
            return
        for period in self.broken:
            self._follow_short(period, old, n)
        for period, start in list(self.open.items()):
            more = _equal_until(self.ids[old:], self.ids[old - period : n - period])
            if old + more < n:
                del self.open[period]
                self._report(start, old + more, period)
        self._fingerprint(0, self.ids[old:].astype(np.uint64) * _ODD, old)
        for k in range(1, n.bit_length()):
            size, half = 1 << k, 1 << (k - 1)
            if 4 * size > n:
                break
            seen = len(self.prints[k]) if k < len(self.prints) else 0
            below = self.prints[k - 1]
            mixed = (below[seen : n - size + 1] ^ (below[seen : n - size + 1] >> np.uint64(29))) * _MIX + below[seen + half : n - size + 1 + half]
            self._fingerprint(k, mixed * _ODD, seen)
            if size >= SHORT // 2:
                self._catch(k, seen)

    def _fingerprint(self, k: int, new: np.ndarray, seen: int) -> None:
        new ^= new >> np.uint64(32)
        if k == len(self.prints):
            self.prints.append(new)
        else:
            self.prints[k] = np.concatenate([self.prints[k], new]) if seen else new

    def _follow_short(self, period: int, old: int, n: int) -> None:
        first = max(old, period)
        if first >= n:
            return
        last = period - 1 if self.broken[period] is None else self.broken[period]
        differ = np.flatnonzero(self.ids[first:n] != self.ids[first - period : n - period])
        if len(differ):
            ends = differ + first
            before = np.concatenate([[last], ends[:-1]])
            for k in np.flatnonzero(ends - before >= max(self.least, 2 * period) - period + 1):
                self._report(int(before[k]) - period + 1, int(ends[k]), period)
            last = int(ends[-1])
        self.broken[period] = last

    def _catch(self, k: int, seen: int) -> None:
        """Compares the suffixes from place `seen` on with the blocks whose catchers reach them."""
        size, prints = 1 << k, self.prints[k]
        first = max(seen // size, 2)  # rows of `size` suffixes, those from 2 * size on can be caught
        rows = -(-len(prints) // size)
        if first >= rows:
            return
        body = prints[first * size :]
        full = len(body) // size
        starts, ends = [], []
        for shift in (2, 3):  # a row is reached by the blocks two and three rows before
            skip = max(0, shift - first)  # rows that no block is far enough before
            grid = body[skip * size : full * size].reshape(-1, size)
            heads = prints[(first + skip - shift) * size :: size][: len(grid)]
            r, c = np.nonzero(grid == heads[:, None])
            starts.append((r + first + skip - shift) * size)
            ends.append((r + first + skip) * size + c)
            if len(body) > full * size and full >= skip:
                at = (first + full - shift) * size
                c = np.flatnonzero(body[full * size :] == prints[at])
                starts.append(np.full(len(c), at))
                ends.append((first + full) * size + c)
        s, j = np.concatenate(starts), np.concatenate(ends)
        fresh = j >= seen
        s, q = s[fresh], (j - s)[fresh]
        if len(s):
            self._match(s, q, size)

    def _match(self, s: np.ndarray, q: np.ndarray, size: int) -> None:
        n, ids = len(self.ids), self.ids
        if len(s) > 8:  # squares of a period that a known shorter one divides say nothing new
            order = np.argsort(s, kind="stable")
            s, q = s[order], q[order]
            gone = np.zeros(len(s), dtype=bool)
            now = [(a, b, p) for (a, b), p in self.found.items()] + [(a, n, p) for p, a in self.open.items()]
            now += [(last - p + 1, n, p) for p, last in self.broken.items() if last is not None]
            for a, b, p in now:
                if b - a >= 4 * size:
                    lo, hi = np.searchsorted(s, [a, b])
                    gone[lo:hi] |= (s[lo:hi] + q[lo:hi] + size <= b) & (q[lo:hi] % p == 0) & (q[lo:hi] > p)
            s, q = s[~gone], q[~gone]
        order = np.lexsort((s, q))
        period, end = 0, 0
        for a, p in zip(s[order].tolist(), q[order].tolist()):
            if p == period and a + p < end or self.open.get(p, n) <= a:
                continue  # within the stretch that was followed just now, or that is open
            period = p
            left = _equal_until(ids[:a][::-1], ids[p : a + p][::-1])
            end = a + size + p + _equal_until(ids[a + size : n - p], ids[a + size + p : n])
            if end == n:
                self.open[p] = a - left
            else:
                self._report(a - left, end, p)

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs of the words so far, by start, then period."""
        found, n = dict(self.found), len(self.ids)
        still = [(a, p) for p, a in self.open.items()] + [((p - 1 if last is None else last) - p + 1, p) for p, last in self.broken.items()]
        for a, p in still:
            if n - a >= max(self.least, 2 * p):
                found[a, n] = min(found.get((a, n), p), p)
        return sorted((a, b - a, p) for (a, b), p in found.items())


def runs_of(words: list[str], least: int = 12) -> list[tuple[int, int, int]]:
    """Runs of one text's words."""
    if len(words) < least:
        return []
    number: dict[str, int] = {}
    caught = Catchers(least)
    caught.extend(np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words)))
    return caught.runs()


def text_runs(text: Column, least: int = 12) -> Column:
    """struct(n_words, starts, lengths, periods, collapsed) of each text; null counts as empty.

    The three arrays list the runs by start, then period. collapsed: the words joined by one space, without those that any
    run holds after its first period.
    """

    @F.pandas_udf("n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed string")
    def find(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            words = WORD.findall(text)
            runs = runs_of(words, least)
            kept = words
            if runs:
                stays = np.ones(len(words), dtype=bool)
                for start, length, period in runs:
                    stays[start + period : start + length] = False
                kept = [words[i] for i in np.flatnonzero(stays)]
            rows.append((len(words), *([r[k] for r in runs] for k in range(3)), " ".join(kept)))
        return pd.DataFrame(rows, columns=["n_words", "starts", "lengths", "periods", "collapsed"])

    return find(whole(text))


def periodic_runs(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, runs (array of start, length, period; by start, then period) and collapsed.

    A run: consecutive words with smallest period `period`, at least max(least, 2 * period) long, that neither neighbour
    continues. Null and empty texts have no words, no runs and the empty text; repeated rows are judged each; an empty
    table gives an empty table; other columns are ignored. Nothing is shuffled; memory is that of one batch of texts.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), text_runs(F.col(text_col), least).alias("r"))
    run = lambda s, k: F.struct(s.alias("start"), F.get("r.lengths", k).alias("length"), F.get("r.periods", k).alias("period"))
    return found.select("doc_id", "r.n_words", F.transform("r.starts", run).alias("runs"), "r.collapsed")


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text, where the text of one id in ten is made periodic from some word on, as the registered query asks.

    h is the unsigned crc32 of the decimal id (a null id counts as the empty string), g its tenth. Where h ends in 0 and
    there are n > 0 words, word i >= a = g % n becomes word a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8).
    """
    h = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(whole(F.col(text_col)), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    base = docs.select(F.col(id_col).alias("doc_id"), whole(F.col(text_col)).alias("text"), h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    placed = base.withColumn("n", F.size("w")).withColumn("g", F.expr("h div 10")).withColumn("a", F.when(F.col("n") > 0, F.expr("g % n")))
    placed = placed.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    periodic = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return placed.select("doc_id", F.when(F.col("n") > 0, F.array_join(periodic, " ")).otherwise(F.col("text")).alias("text"))


def run_report(found: DataFrame) -> DataFrame:
    """The figures of periodic_runs: number of runs, the longest one, and digests of the runs and of the collapsed text."""
    by_length = F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", F.get(by_length, F.lit(0))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
