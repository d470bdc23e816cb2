"""Token counts by byte-pair merging over a heap and a linked list.

A text is cut where no vocabulary piece can reach across: before each run of word marks and at line ends. For each
chunk the lowest-ranked adjacent pair is popped again and again; the count is the number of initial symbols less the
merges, and a symbol that the vocabulary lacks counts as its UTF-8 bytes. Identifiers are never produced.
"""

from __future__ import annotations

import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import whole

MARK = "▁"
#: Chunks that a worker remembers at most; beyond that it starts afresh.
REMEMBERED = 1 << 20


def merged_count(symbols: str, rank: dict[str, int], known: frozenset | set | dict) -> int:
    """Tokens of one chunk: initial symbols less merges, unknown symbols as bytes."""
    n = len(symbols)
    part = list(symbols)
    if n > 1:
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(symbols[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, size = heappop(heap)
            left = part[i]
            if left is None or (j := after[i]) >= len(part) or len(left) + len(part[j]) != size:
                continue  # one of the two has been merged since
            part[i], part[j] = left + part[j], None
            n -= 1
            k = after[i] = after[j]
            if k < len(part):
                before[k] = i
                if (r := rank.get(part[i] + part[k])) is not None:
                    heappush(heap, (r, i, size + len(part[k])))
            if (h := before[i]) >= 0 and (r := rank.get(part[h] + part[i])) is not None:
                heappush(heap, (r, h, size + len(part[h])))
    return n + sum(len(p.encode()) - 1 for p in part if p is not None and p not in known)


class _Memo(dict):
    """Counts by chunk, computed when first met."""

    def __init__(self, count, prefix: str = ""):
        super().__init__()
        self.count, self.prefix = count, prefix

    def __missing__(self, chunk: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self[chunk] = self.count(self.prefix + chunk)
        return n


class PieceCounter:
    """Counts as the sentencepiece library does for a BPE model with byte fallback."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        scores = {
            model.id_to_piece(i): model.get_score(i)
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        }
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in scores.items()}
        if any("\n" in p or MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("a piece reaches over a word mark or a line end; this model can't be counted by chunks")
        count = lambda chunk: merged_count(chunk, self.rank, self.rank) if chunk else 0
        self.marked, self.bare = _Memo(count, MARK), _Memo(count)

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " " or " \n" in text or "\n " in text:
            lines = (MARK + text.replace(" ", MARK)).split("\n")
            return len(lines) - 1 + sum(map(self.bare.__getitem__, (c for x in lines for c in _CHUNK.findall(x))))
        total = text.count("\n")
        for k, line in enumerate(text.split("\n")):
            first, *rest = line.split(" ")
            total += self.bare[first] if k else self.marked[first]
            total += sum(map(self.marked.__getitem__, rest))
        return total


_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@lru_cache(2)
def _counter(model_file: str) -> PieceCounter:
    return PieceCounter(model_file)


def token_count(text: Column, model_file: str) -> Column:
    """Tokens of each text; null counts as empty, which has none. model_file: a sentencepiece BPE model on every node."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        counter = _counter(model_file)
        return pd.Series([counter(x) for x in texts], dtype="int64")

    return count(text)


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Null and empty texts have 0 tokens; repeated rows are counted each; an empty table gives an empty table; other
    columns are ignored. Nothing is shuffled.
    """
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.octet_length(whole(F.col(text_col))).cast("long").alias("n_bytes"),
        token_count(whole(F.col(text_col)), model_file).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
