"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The words of the lexicon are learned from labelled texts by log-odds. A text's features are densities of lexicon words,
how near they stand to second persons, capitals, punctuation, and rates of obfuscated spellings. Trees are boosted on
the logistic loss; predictions for rows that a model hasn't seen give the isotonic map from margins to probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import stored, whole

#: Words of the second person in the corpus's languages, and digits or signs that stand for letters.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer sie ihnen tú ti usted ustedes vosotros vuestro".split())
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})
_EDGE = ".,;:!?\"'()[]{}<>#%&*$-_/|"
_ODD = re.compile(r"\S*[A-Za-z][0-9@$!*._-]+[A-Za-z]\S*")
NEAR = 6
FEATURES = (
    "strong_density", "strong_count", "weak_density", "distinct_strong", "near_second_person", "second_person_density", "capitals", "capital_words",
    "exclamations", "questions", "punctuation", "digits", "obfuscated_density", "odd_words", "log_words", "signs",
)


def features(text: str, strong: frozenset, weak: frozenset) -> list[float]:
    """FEATURES of one text; all are finite, also for the empty text."""
    raw = text.lower().split()
    words = [w.strip(_EDGE) for w in raw]
    n = max(len(words), 1)
    hits = [i for i, w in enumerate(words) if w in strong]
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = sum(any(abs(i - j) <= NEAR for j in second[max(0, k - 1) : k + 1]) for i, k in zip(hits, np.searchsorted(second, hits))) if hits and second else 0
    counts = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256) if text else np.zeros(256, dtype=np.int64)
    letters = max(int(counts[65:91].sum() + counts[97:123].sum()), 1)
    size = max(len(text), 1)
    odd = _ODD.findall(text.lower()) if counts[48:58].sum() or counts[[33, 36, 42, 46, 45, 64, 95]].sum() else []
    hidden = sum(w.strip(_EDGE) not in strong and w.strip(_EDGE).translate(LOOKALIKE) in strong for w in odd)
    shouted = sum(map(str.isupper, text.split())) if counts[65:91].sum() > 1 else 0
    return [
        (len(hits) + hidden) / n,
        np.log1p(len(hits) + hidden),
        sum(w in weak for w in words) / n if weak else 0.0,
        float(len({words[i] for i in hits})),
        near / max(len(hits), 1),
        len(second) / n,
        counts[65:91].sum() / letters,
        shouted / n,
        counts[33] / size,
        counts[63] / size,
        (counts[[44, 46, 58, 59]].sum()) / size,
        counts[48:58].sum() / size,
        hidden / n,
        len(odd) / n,
        np.log1p(len(words)),
        counts[[35, 36, 37, 38, 42, 124]].sum() / size,
    ]


@dataclass
class Trees:
    """Trees of one depth as arrays: at each level, a feature and a bound for every node; leaves hold margins."""

    start: float
    feature: np.ndarray  # trees x (2**depth - 1)
    bound: np.ndarray
    leaf: np.ndarray  # trees x 2**depth

    def margins(self, x: np.ndarray) -> np.ndarray:
        out, depth = np.full(len(x), self.start), int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        rows = np.arange(len(x))
        for f, b, v in zip(self.feature, self.bound, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > b[node])
            out += v[node - (2**depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 4.0, ridge: float = 2.0) -> Trees:
    """Newton boosting on the logistic loss over binned features; a split must leave `least` of curvature on either side."""
    p = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
    start = float(np.log(p / (1 - p)))
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for k in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], 1) if n else np.zeros((0, m), int)
    margin = np.full(n, start)
    fs, bs, vs = [], [], []
    offsets = np.arange(m) * bins
    for _ in range(trees if n and 0 < y.sum() < n else 0):
        q = 1 / (1 + np.exp(-margin))
        g, h = y - q, q * (1 - q)
        feature, bound, node = np.zeros(2**depth - 1, int), np.full(2**depth - 1, np.inf), np.zeros(n, int)
        for level in range(depth):
            width, base = 2**level, 2**level - 1
            at = ((node - base)[:, None] * (m * bins) + offsets + binned).ravel()
            G, H = (np.bincount(at, np.repeat(v, m), width * m * bins).reshape(width, m, bins).cumsum(2) for v in (g, h))
            tg, th = G[:, :, -1:], H[:, :, -1:]
            gain = G**2 / (H + ridge) + (tg - G) ** 2 / (th - H + ridge) - tg**2 / (th + ridge)
            gain[(least > H) | (least > th - H)] = -1
            flat = gain.reshape(width, -1)
            best = flat.argmax(1)
            for k in range(width):
                f, b = divmod(int(best[k]), bins)
                if flat[k, best[k]] > 1e-9 and b < len(cuts[f]):
                    feature[base + k], bound[base + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > bound[node])
        leaf = node - (2**depth - 1)
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        margin += value[leaf]
        fs.append(feature)
        bs.append(bound)
        vs.append(value)
    return Trees(start, np.array(fs).reshape(-1, 2**depth - 1).astype(int), np.array(bs).reshape(-1, 2**depth - 1), np.array(vs).reshape(-1, 2**depth))


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the monotone map from margins to probabilities, by pooling adjacent violators."""
    if not len(y):
        return np.array([0.0]), np.array([0.0])
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of y, weight, sum of margins
    for a, b in zip(margin[order], y[order]):
        blocks.append([b, 1.0, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], s)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


@dataclass
class Model:
    strong: frozenset
    weak: frozenset
    trees: Trees
    at: np.ndarray
    probability: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        margins = self.trees.margins(np.array([features(t, self.strong, self.weak) for t in texts], dtype=float))
        rank = 1 / (1 + np.exp(-margins))  # a thousandth of it keeps the order within a flat stretch
        return np.clip(0.999 * np.interp(margins, self.at, self.probability) + 0.001 * rank, 0.0, 1.0)


def fold(id_col: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model fitted on at most `sample_rows` labels outside fold 0: those whose hash of the id is smallest.

    labels: doc_id, toxic (0 or 1, null is left out; of several for one id the largest counts). Only words' counts and
    rows of sixteen numbers reach the driver. Without labels of both kinds every score is the share of toxic ones.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("double")).alias("y"))
    chosen = stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).withColumnRenamed("doc_id", "label_id"), "label-sample")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(F.col(text_col)).alias("text"))
    rows = texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["label_id"]).select("doc_id", "text", "y")  # chosen has sample_rows rows at most
    rows = stored(rows, "labelled-texts")

    word = F.explode(F.array_distinct(F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.btrim(w, F.lit(_EDGE)))))
    seen = rows.select("y", word.alias("word")).where("length(word) between 3 and 30").groupBy("word").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")).where("n >= 5")
    total = rows.agg(F.coalesce(F.sum("y"), F.lit(0.0)).alias("p"), F.count(F.lit(1)).alias("n")).first()
    rate = total["p"] / total["n"] if total["n"] else 0.0
    odds = F.log((F.col("pos") + 0.5) / (total["p"] + 1)) - F.log((F.col("n") - F.col("pos") + 0.5) / (total["n"] - total["p"] + 1))
    z = (F.col("pos") - F.col("n") * rate) / F.sqrt(F.col("n") * max(rate, 1e-9))
    lexicon = seen.select("word", odds.alias("odds"), z.alias("z")).where("odds > 1 and z > 3").orderBy(F.desc("z"), "word").limit(256).collect()
    strong, weak = (frozenset(r.word for r in lexicon if (r.odds > 2.5 and r.z > 5) == s) for s in (True, False))

    def measured(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"h": part["h"], "y": part["y"], "x": [features(t, strong, weak) for t in part["text"]]})

    got = rows.select(F.xxhash64("doc_id").alias("h"), "y", "text").mapInPandas(measured, "h long, y double, x array<double>").toPandas().sort_values("h", kind="stable")
    x, y, h = np.array(got["x"].tolist(), dtype=float).reshape(-1, len(FEATURES)), got["y"].to_numpy(), got["h"].to_numpy()
    unseen = np.zeros(len(y))
    for k in range(4):
        test = h % 4 == k
        unseen[test] = boost(x[~test], y[~test]).margins(x[test])
    return Model(strong, weak, boost(x, y), *isotonic(unseen, y))


def toxicity_score(text: Column, model: Model) -> Column:
    """Probability that each text is toxic; null counts as empty. The model, some kilobytes, goes along with the function."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts.tolist()))

    return score(whole(text))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. Null and empty texts are scored too; nothing is shuffled."""
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col)) == 0).alias("held_out"), toxicity_score(F.col(text_col), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
