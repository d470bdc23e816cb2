"""Quality by attention-based multiple-instance learning.

A text is a bag of passages; only the text has a label. Each passage's measurements (densities of pairs of character
classes, and how its words repeat) are encoded by one layer; gated attention, tanh times sigmoid, weighs the encoded
passages; the weighted sum of a text is scored by a logistic unit. All weights are learned from the texts' labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import stored, whole
from lacuna.llm.toxicity import fold

#: Words of a passage at least, and passages of a text at most: a longer text has longer passages, and is covered whole.
PASSAGE_WORDS, MOST_PASSAGES = 64, 128
#: Bytes that are measured together.
STRETCH = 1 << 21

_SPACE, _LINE = 3, 4
CLASSES = 12


def _class_table() -> np.ndarray:
    """The class of each byte: lower case, upper case, digit, blank, line end, stop, shout, bracket or quote, hyphen, other sign, lead byte, continuation byte."""
    table = np.full(256, 9, dtype=np.uint8)
    table[97:123], table[65:91], table[48:58] = 0, 1, 2
    table[[32, 9]], table[[10, 11, 12, 13]] = _SPACE, _LINE
    for k, signs in ((5, b".,;:"), (6, b"!?"), (7, b"'\"()[]{}<>"), (8, b"-")):
        table[list(signs)] = k
    table[128:192], table[192:256] = 11, 10
    return table


_CLASS = _class_table()
_ROOT = np.uint64(0x9E3779B97F4A7C15)
EXTRA = ("distinct_words", "distinct_pairs", "new_pairs", "same_as_before", "word_bytes", "word_bytes_spread", "capital_words", "log_words")
WIDTH = CLASSES * CLASSES + len(EXTRA)


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2**64, and of its inverse."""
    back = np.uint64(pow(int(_ROOT), -1, 1 << 64))
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, x))]) for x in (_ROOT, back))


def _share(flags: np.ndarray, passage: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.bincount(passage, flags, len(n)) / np.maximum(n, 1)


def _first_of_each(keys: np.ndarray) -> np.ndarray:
    """1 where a value stands for the first time."""
    out = np.zeros(len(keys))
    out[np.unique(keys, return_index=True)[1]] = 1
    return out


def _measure(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    kind = _CLASS[data]
    blank = (kind == _SPACE) | (kind == _LINE)
    begins = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    ends = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
    offset = np.concatenate([[0], np.cumsum([len(x) + 1 for x in raw])])
    following = np.append(kind[1:], np.uint8(_LINE))
    following[offset[1:] - 1] = _LINE  # nothing of the next text
    text = np.searchsorted(offset, begins, "right") - 1
    words = np.bincount(text, minlength=len(raw))
    size = np.maximum(PASSAGE_WORDS, -(-words // MOST_PASSAGES))
    bags = np.maximum(1, -(-words // size))
    base = np.concatenate([[0], np.cumsum(bags)])
    local = np.arange(len(begins)) - (np.cumsum(words) - words)[text]
    passage = base[text] + local // size[text]
    n = np.bincount(passage, minlength=base[-1])
    edge = np.zeros(base[-1] + 1, dtype=np.int64)  # where each passage's bytes begin
    first = np.flatnonzero(local % size[text] == 0)
    edge[passage[first]] = begins[first]
    edge[base[:-1]] = offset[:-1]
    edge[-1] = len(data)

    pairs = np.zeros((base[-1], CLASSES * CLASSES))
    mark = np.zeros(len(begins), dtype=np.uint64)  # of each word
    lo = 0
    while lo < base[-1]:
        hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + STRETCH, "right")) - 1)
        a, b = edge[lo], edge[hi]
        code = kind[a:b].astype(np.int64) * CLASSES + following[a:b]
        code += np.repeat(np.arange(hi - lo) * CLASSES**2, np.diff(edge[lo : hi + 1]))
        pairs[lo:hi] = np.bincount(code, minlength=(hi - lo) * CLASSES**2).reshape(hi - lo, -1)
        u, v = np.searchsorted(passage, [lo, hi])
        power, back = _powers(max(STRETCH * 2, 1 << int(b - a).bit_length()))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * power[: b - a])])
        mark[u:v] = (total[ends[u:v] - a] - total[begins[u:v] - a]) * back[begins[u:v] - a]
        lo = hi
    mark ^= mark >> np.uint64(31)
    mark *= _ROOT
    after = np.append(mark[1:], np.uint64(0))[: len(mark)]
    after[:-1][text[1:] != text[:-1]] = 0
    pair = mark * np.uint64(3) + (after ^ (after >> np.uint64(29)))
    p64, t64 = passage.astype(np.uint64) * _ROOT, text.astype(np.uint64) * _ROOT
    same = np.zeros(len(mark))
    same[1:] = (mark[1:] == mark[:-1]) & (passage[1:] == passage[:-1])
    length = (ends - begins).astype(float)
    mean = _share(length, passage, n)
    extra = [
        _share(_first_of_each(mark ^ p64), passage, n),
        _share(_first_of_each(pair ^ p64), passage, n),
        _share(_first_of_each(pair ^ t64), passage, n),
        _share(same, passage, n),
        np.log1p(mean),
        np.log1p(np.sqrt(np.maximum(_share(length**2, passage, n) - mean**2, 0))),
        _share(kind[begins] == 1, passage, n),
        np.log1p(n),
    ]
    density = np.sqrt(pairs / np.maximum(pairs.sum(1, keepdims=True), 1))
    return np.hstack([density, np.stack(extra, 1)]).astype(np.float32), bags


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Measurements of the passages of all texts, one below the other, and the number of each text's passages (1 for an empty text)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    parts, some, held = [], [], 0
    for k, x in enumerate(raw):
        some.append(x)
        held += len(x)
        if held >= STRETCH or k + 1 == len(raw):
            parts.append(_measure(some))
            some, held = [], 0
    if not parts:
        return np.zeros((0, WIDTH), dtype=np.float32), np.zeros(0, dtype=np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


@dataclass
class Bags:
    """The weights of the encoder (w, b), of the gated attention (v, u, t) and of the scoring unit (c, d)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def scores(self, texts: list[str]) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        x, n = passages(texts)
        return _forward(self.weights, (x - self.mean) / self.scale, n)["p"].astype(float)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(m: dict[str, np.ndarray], x: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """x: passages of all bags in order; n: passages of each bag, at least one."""
    at = np.cumsum(n) - n
    e = np.tanh(x @ m["w"] + m["b"])
    v, u = np.tanh(e @ m["v"]), _sigmoid(e @ m["u"])
    s = (v * u) @ m["t"]
    s = np.exp(s - np.repeat(np.maximum.reduceat(s, at), n))
    a = s / np.repeat(np.add.reduceat(s, at), n)
    z = np.add.reduceat(a[:, None] * e, at)
    return {"e": e, "v": v, "u": u, "a": a, "z": z, "p": _sigmoid(z @ m["c"] + m["d"][0])}


def _gradients(m: dict[str, np.ndarray], x: np.ndarray, n: np.ndarray, y: np.ndarray, ridge: float) -> dict[str, np.ndarray]:
    f = _forward(m, x, n)
    e, v, u, a = f["e"], f["v"], f["u"], f["a"]
    miss = (f["p"] - y) / len(y)
    dz = np.repeat(miss[:, None] * m["c"], n, axis=0)
    da = (e * dz).sum(1)
    ds = a * (da - np.repeat(np.add.reduceat(a * da, np.cumsum(n) - n), n))
    dg = ds[:, None] * m["t"]
    dv, du = dg * u * (1 - v * v), dg * v * u * (1 - u)
    de = (a[:, None] * dz + dv @ m["v"].T + du @ m["u"].T) * (1 - e * e)
    out = {"w": x.T @ de, "b": de.sum(0), "v": e.T @ dv, "u": e.T @ du, "t": (v * u).T @ ds, "c": f["z"].T @ miss, "d": np.array([miss.sum()])}
    return {k: g + ridge * m[k] if k in "wvuc" else g for k, g in out.items()}


def fit(x: np.ndarray, n: np.ndarray, y: np.ndarray, width: int = 24, gates: int = 12, rounds: int = 20, batch: int = 64, rate: float = 0.005, ridge: float = 1e-4) -> Bags:
    """Weights by Adam on the logistic loss; x, n as of `passages`, y the label of each text. The same input gives the same weights."""
    rng = np.random.default_rng(7)
    mean = x.mean(0) if len(x) else np.zeros(WIDTH, np.float32)
    scale = x.std(0) + 0.02 if len(x) else np.ones(WIDTH, np.float32)
    x = ((x - mean) / scale).astype(np.float32)
    drawn = lambda i, j: (rng.standard_normal((i, j)) / np.sqrt(i)).astype(np.float32)
    p = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    m = {"w": drawn(WIDTH, width), "b": np.zeros(width, np.float32), "v": drawn(width, gates), "u": drawn(width, gates), "t": np.zeros(gates, np.float32)}
    m |= {"c": np.zeros(width, np.float32), "d": np.array([np.log(p / (1 - p))], np.float32)}
    if not 0 < y.sum() < len(y):
        return Bags(mean, scale, m)  # one kind of label only: its share is every score
    m["t"] += drawn(gates, 1)[:, 0]
    m["c"] += drawn(width, 1)[:, 0]
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    at, step = np.cumsum(n) - n, 0
    steps = rounds * -(-len(y) // batch)
    for _ in range(rounds):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            some = order[lo : lo + batch]
            rows = np.repeat(at[some] - (np.cumsum(n[some]) - n[some]), n[some]) + np.arange(n[some].sum())
            step += 1
            pace = rate * (1 - step / (steps + 1))
            for k, g in _gradients(m, x[rows], n[some], y[some], ridge).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                m[k] = (m[k] - pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Bags(mean, scale, m)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 8_000, id_col: str = "doc_id", text_col: str = "text") -> Bags:
    """A model fitted on at most `sample_rows` labelled texts whose crc32(id) mod 4 is not 2: those whose hash of the id is smallest.

    labels: doc_id, quality (0 or 1; null is left out; of several for one id the largest counts). Every passage of a
    sampled text is used; a text has MOST_PASSAGES at most, so what reaches the driver is bounded by sample_rows.
    Without labels of both kinds every score is the share of ones (one half if there is no label).
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 4) != 2)).groupBy("doc_id").agg(F.max(F.col("quality").cast("double")).alias("y"))
    chosen = stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).withColumnRenamed("doc_id", "label_id"), "quality-labels")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(F.col(text_col)).alias("text"))
    rows = texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["label_id"]).select("doc_id", "text", "y")  # chosen has sample_rows rows at most
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # of several texts for one id, the smallest

    def measured(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x, n = passages(part["text"].tolist())
            cut = np.split(x.astype(np.float16), np.cumsum(n)[:-1]) if len(n) else []
            yield pd.DataFrame({"doc_id": part["doc_id"], "y": part["y"], "x": [c.tobytes() for c in cut]})

    got = rows.mapInPandas(measured, "doc_id long, y double, x binary").toPandas().sort_values("doc_id", kind="stable")
    bags = [np.frombuffer(b, dtype=np.float16).reshape(-1, WIDTH) for b in got["x"]]
    x = np.concatenate(bags).astype(np.float32) if bags else np.zeros((0, WIDTH), np.float32)
    return fit(x, np.array([len(b) for b in bags], dtype=np.int64), got["y"].to_numpy(dtype=float))


def quality_score(text: Column, model: Bags) -> Column:
    """Probability that each text's label is 1; null counts as empty. The model, some kilobytes, goes along with the function."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts.tolist()))

    return score(whole(text))


def score_quality(docs: DataFrame, model: Bags, id_col: str = "doc_id", text_col: str = "text", accept: float = 0.7) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 if score >= accept).

    Null and empty texts are one passage without words, and are scored too; repeated rows are scored each; an empty table
    gives an empty table; other columns are ignored. Nothing is shuffled.
    """
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col), 4) == 2).alias("held_out"), quality_score(F.col(text_col), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= accept).cast("int"))
