"""Secret scanning: fixed patterns, and a linear-chain conditional random field that tags further secrets.

Tokens are tagged begin, inside or outside. Emissions are sums of weights of a token's own shape, of the shapes of the
two tokens before and the one after, and of features of the whole file; the best tag sequence is found by Viterbi. The
field is trained here, on a bounded sample of rows: on what the fixed patterns match there, and on the rows' own words
with made-up secrets set between them, announced in many ways or not at all, and with things that look like secrets and
are none. So it learns shapes and neighbourhoods that the patterns don't have.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import whole

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_TOKEN = re.compile(r"""[^\s"'`:=<>(){}\[\],;|]+|["'`:=<>(){}\[\],;|]""")
OUTSIDE, BEGIN, INSIDE = 0, 1, 2


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, where the secret itself starts) in order of start, then kind; leftmost and non-overlapping in each kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [("assign", *m.span(), m.start(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span(), m.start()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span(), m.start()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


# Features: each token has a few small numbers, which stand for weights in four places (itself, one and two before, one after).

_LENGTHS = (4, 8, 12, 16, 24)
_DELIMITERS = "\"'`:=<>(){}[],;|"
_N_LENGTH, _N_KIND = len(_LENGTHS) + 1, 9
_BASE = {"length": 0, "kind": _N_LENGTH, "digits": _N_LENGTH + _N_KIND, "turns": _N_LENGTH + _N_KIND + 4}
_OTHER = _N_LENGTH + _N_KIND + 4 + 4
HEXLIKE, JOINED, PATH, DOTTED, VARIED, KEYWORD, NAME_END, LINKING, MAIL, WORDY, DELIMITER = range(_OTHER, _OTHER + 11)
SHAPES = DELIMITER + len(_DELIMITERS)
PLACES = 4
FILE = 4
#: Parts of words that announce a secret, and words between those and the secret.
_KEYS = ("passw", "passphrase", "secret", "token", "apikey", "api_key", "access_key", "credential", "private", "auth", "bearer", "pwd")
_LINKS = frozenset(("is", "was", "to", "of", "as", "est", "es", "ist", "set"))
_RUNS = re.compile("[a-z]+")
_TURNS = re.compile(r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Z])(?=[a-z])")


def _names_secret(lower: str) -> bool:
    return any(k in lower for k in _KEYS)


def shape(token: str) -> tuple[int, ...]:
    """Indices of a token's shape features."""
    n = len(token)
    length = bisect_right(_LENGTHS, n)
    if token.isalpha() and token.islower() and n < 24:
        more = (KEYWORD,) if _names_secret(token) else (LINKING,) if token in _LINKS else ()
        return (length, _BASE["kind"], _BASE["digits"], *more)
    if token[-1] == "." and (word := token[:-1]).isalpha() and word.islower() and n < 24 and not _names_secret(word):
        return (length, _BASE["kind"], _BASE["digits"], NAME_END)
    digits = sum(c.isdigit() for c in token)
    letters = [c for c in token if c.isalpha()]
    upper = sum(c.isupper() for c in letters)
    if not letters:
        kind = 1 if digits else 2
    elif digits:
        kind = 3 if upper == 0 else 4 if upper == len(letters) else 5
    else:
        kind = 0 if upper == 0 else 6 if upper == len(letters) else 7 if upper == 1 and token[0].isupper() else 8
    share = digits / n
    out = [length, _BASE["kind"] + kind, _BASE["digits"] + (0 if not digits else 1 if share <= 0.2 else 2 if share <= 0.5 else 3)]
    if n >= 12 and re.fullmatch("[0-9a-fA-F]+", token):
        out.append(HEXLIKE)
    if n >= 8 and letters and digits:
        turns = len(_TURNS.findall(token)) / n
        out.append(_BASE["turns"] + (0 if turns <= 0.1 else 1 if turns <= 0.25 else 2 if turns <= 0.4 else 3))
    if n >= 8:
        out += [f for f, signs in ((JOINED, "_-"), (PATH, "/+"), (DOTTED, "."), (MAIL, "@")) if any(c in token[:-1] for c in signs)]
        if max(map(len, _RUNS.findall(token)), default=0) * 4 > n:
            out.append(WORDY)
    if n >= 12 and len(set(token)) >= 8 and digits:
        out.append(VARIED)
    if _names_secret(token.lower()):
        out.append(KEYWORD)
    if n == 1 and token in _DELIMITERS:
        out.append(DELIMITER + _DELIMITERS.index(token))
    elif token[-1] in ".!?":
        out.append(NAME_END)
    return tuple(out)


def file_features(text: str, n_tokens: int) -> list[int]:
    """Features of the whole text: assignments, a key word, digits, braces."""
    n = max(n_tokens, 1)
    return [k for k, on in enumerate((text.count("=") * 50 > n, _names_secret(text.lower()), sum(map(text.count, "0123456789")) * 20 > len(text), text.count("{") * 100 > n)) if on]


def tags_of(text: str) -> tuple[list[str], list[int], list[tuple[int, int]]]:
    """Tokens, the tags that the fixed patterns give, and the tokens' places."""
    secret = sorted((s, e) for _, _, e, s in base_spans(text))
    tokens, tags, places, k, last = [], [], [], 0, -1
    for m in _TOKEN.finditer(text):
        while k < len(secret) and secret[k][1] <= m.start():
            k += 1
        inside = k < len(secret) and m.end() > secret[k][0] and m.start() < secret[k][1]
        tags.append((INSIDE if last == k else BEGIN) if inside else OUTSIDE)
        last = k if inside else -1
        tokens.append(m[0])
        places.append(m.span())
    return tokens, tags, places


_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_MIXED = _LOWER + _UPPER + _DIGITS


def _letters(chance: random.Random, alphabet: str, low: int, high: int) -> str:
    """Random signs, with a digit among them at least."""
    got = chance.choices(alphabet, k=chance.randint(low, high))
    for k in chance.sample(range(len(got)), 1 + len(got) // 12):
        got[k] = chance.choice(_DIGITS)
    return "".join(got)


#: How made-up secrets look, by kind; the second value says whether one is a secret without any announcement.
MADE = {
    "chosen": (lambda c: c.choice((str.lower, str.title))("".join(c.choices(_LOWER, k=c.randint(4, 9)))) + c.choice(("", "!", "-", "_", "#")) + _letters(c, _DIGITS, 1, 4) + "".join(c.choices(_LOWER, k=c.choice((0, 0, 3)))), False),
    "lower": (lambda c: _letters(c, _LOWER + _DIGITS, 8, 40), False),
    "mixed": (lambda c: _letters(c, _MIXED, 10, 48), False),
    "long": (lambda c: _letters(c, _MIXED, 28, 64), True),
    "coded": (lambda c: _letters(c, _MIXED + "+/", 24, 64) + c.choice(("", "=", "==")), True),
    "prefixed": (lambda c: "".join(_letters(c, _LOWER, 2, 4).translate(str.maketrans(_DIGITS, "klmnopqrst")) + c.choice("_-") for _ in range(c.randint(1, 2))) + _letters(c, _MIXED, 16, 48), True),
    "dotted": (lambda c: ".".join(_letters(c, _MIXED + "_-", 16, 40) for _ in range(3)), True),
}
_NAMES = ("password", "Password", "passwd", "pwd", "PWD", "DB_PASSWORD", "passphrase", "secret", "client_secret", "SECRET_KEY", "token", "auth_token", "accessToken", "api_key", "API_KEY", "apikey", "access_key", "credential", "private_key")
_ANNOUNCED = (
    lambda n, v: [n, "=", *v], lambda n, v: [n, ":", *v], lambda n, v: [n, "=", '"', *v, '"'], lambda n, v: [n, ":", "'", *v, "'"], lambda n, v: ['"', n, '"', ":", '"', *v, '"'],
    lambda n, v: [n, "is", *v], lambda n, v: ["the", n, "is", *v], lambda n, v: [n, "was", "set", "to", *v], lambda n, v: ["Authorization", ":", "Bearer", *v], lambda n, v: ["Bearer", *v], lambda n, v: [n, *v], lambda n, v: ["<", n, ">", *v, "<", "/" + n, ">"],
)
#: Things that are no secrets, though they hold digits or signs, or follow a word that announces one.
_HARMLESS = (
    lambda c, w: [f"{c.randint(1900, 2099)}-{c.randint(1, 12):02d}-{c.randint(1, 28):02d}"], lambda c, w: [str(c.randint(10, 10**9))], lambda c, w: ["v" + ".".join(str(c.randint(0, 20)) for _ in range(3))],
    lambda c, w: ["https", ":", f"//{w}.org/{w}/{w}-{c.randint(1, 999)}.html"], lambda c, w: [f"{w}.{c.choice((w, ''))}{c.randint(1, 99)}@{w}{c.choice(('', c.randint(1, 99)))}.{c.choice(('', w + '.'))}com"], lambda c, w: [f"{w}_{c.randint(1, 2030)}.txt"], lambda c, w: [w + "".join(x.title() for x in c.choices((w, w[:6], "Name", "Item", "List"), k=c.randint(1, 3))) + str(c.randint(1, 99))],
    lambda c, w: [f"{w}-{w}-{w}"], lambda c, w: [w + w + w], lambda c, w: [c.choice(_NAMES), "is", w], lambda c, w: ["the", c.choice(_NAMES), w], lambda c, w: [c.choice(_NAMES), ":", w[:5]], lambda c, w: ["-" * c.randint(3, 30)],
    lambda c, w: [f"{c.randint(1, 999)}.{c.randint(100, 999)},{c.randint(10, 99)}"], lambda c, w: [f"{w.upper()}{c.randint(1, 99)}"], lambda c, w: [f"+{c.randint(1, 99)}-{c.randint(100, 999)}-{c.randint(1000000, 9999999)}"],
    lambda c, w: [f"{w}/{w}_{w}/{w}{c.randint(1, 99)}"], lambda c, w: ["#" + w + str(c.randint(1, 99))], lambda c, w: [w.upper() + "_" + w.upper()], lambda c, w: [f"{c.randint(0, 255)}.{c.randint(0, 255)}.{c.randint(0, 255)}.{c.randint(0, 255)}"],
)


def windows(text: str, seed: int, around: int = 5, most: int = 8, made: int = 0, kinds: tuple[str, ...] = tuple(MADE)) -> list[tuple[list[str], list[int], list[int]]]:
    """Training pieces of one text: the neighbourhoods of its secrets, the first `most` of them, and, if `made` isn't 0, pieces of other words.

    The latter are the text's beginning, the neighbourhoods of two tokens with digits, and `made` pieces each with a
    made-up secret or something harmless set between its words. The seed decides on all that is random.
    """
    tokens, tags, _ = tags_of(text)
    file, chance = file_features(text, len(tokens)), random.Random(seed)
    spots = [i for i, t in enumerate(tags) if t == BEGIN][:most]
    if made and tokens:
        spots += [0] + [i for i, t in enumerate(tokens) if tags[i] == OUTSIDE and any(c.isdigit() for c in t)][:2]
    out = [(tokens[a : i + around], tags[a : i + around], file) for i in spots if (a := max(0, i - around)) < len(tokens)]
    plain = [t for t in tokens if t.isalpha() and not _names_secret(t.lower())] if made else []
    for k in range(made if plain else 0):
        i = chance.randrange(len(tokens))
        before, after = ((tokens[max(0, i - around) : i], tags[max(0, i - around) : i]), (tokens[i : i + around], tags[i : i + around]))
        if k % 2:
            put = chance.choice(_HARMLESS)(chance, chance.choice(plain).lower()[:14])
            marks = [OUTSIDE] * len(put)
        else:
            make, alone = MADE[chance.choice(kinds)]
            value = _TOKEN.findall(make(chance))
            put = value if alone and chance.random() < 0.5 else chance.choice(_ANNOUNCED)(chance.choice(_NAMES), value)
            at = next(j for j in range(len(put)) if put[j : j + len(value)] == value)
            marks = [OUTSIDE] * at + [BEGIN] + [INSIDE] * (len(value) - 1) + [OUTSIDE] * (len(put) - at - len(value))
        out.append((before[0] + put + after[0], before[1] + marks + [OUTSIDE if t == INSIDE and not j else t for j, t in enumerate(after[1])], file))
    return out


class Field:
    """The conditional random field: weights (features x 3) and transitions (3 x 3)."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray):
        self.weights, self.transitions = weights, transitions
        a = transitions
        #: If outside beats both others by more than this at a token, no best path is elsewhere there.
        self.sure = max(a[x, y] + a[y, z] - a[x, 0] - a[0, z] for x in range(3) for y in (1, 2) for z in range(3))

    @staticmethod
    def fit(pieces: list[tuple[list[str], list[int], list[int]]], steps: int = 160, rate: float = 0.2, decay: float = 2e-5) -> Field:
        """Maximises the conditional likelihood of the pieces' tags by gradient steps with Adam; forward and backward sums over all pieces at once."""
        n_features = SHAPES * PLACES + FILE
        pieces = [p for p in pieces if p[0]]
        weights, a = np.zeros((n_features, 3)), np.zeros((3, 3))
        if not any(t for p in pieces for t in p[1]):  # nothing to learn from: tag nothing
            weights[:_N_LENGTH, OUTSIDE] = 5.0
            return Field(weights, a)
        longest, m = max(len(p[0]) for p in pieces), len(pieces)
        seen: dict[tuple[int, ...], int] = {(): 0}  # the shapes that occur; the first is that of no token
        ids, files = np.zeros((m, longest + 3), int), np.zeros((m, FILE))
        tags, mask = np.zeros((m, longest), int), np.zeros((m, longest), bool)
        for i, (tokens, tag, file) in enumerate(pieces):
            ids[i, 2 : 2 + len(tokens)] = [seen.setdefault(shape(t), len(seen)) for t in tokens]
            tags[i, : len(tokens)], mask[i, : len(tokens)], files[i, file] = tag, True, 1
        shapes = np.zeros((len(seen), SHAPES))
        for features, k in seen.items():
            shapes[k, list(features)] = 1
        at = [ids[:, 2 - back : 2 - back + longest] for back in (0, 1, 2, -1)]  # a token itself, the one before, that before it, the next
        truth = np.eye(3)[tags] * mask[..., None]
        pairs = mask[:, 1:] & mask[:, :-1]
        true_pairs = np.zeros((3, 3))
        np.add.at(true_pairs, (tags[:, :-1][pairs], tags[:, 1:][pairs]), 1)
        state = [(np.zeros_like(x), np.zeros_like(x)) for x in (weights, a)]
        three = lambda x: x[..., 0] + x[..., 1] + x[..., 2]
        total = mask.sum()
        for step in range(1, steps + 1):
            e = sum((shapes @ weights[SHAPES * p : SHAPES * (p + 1)])[at[p]] for p in range(PLACES)) + (files @ weights[SHAPES * PLACES :])[:, None]
            e, moves = np.exp(e - np.maximum(np.maximum(e[..., 0], e[..., 1]), e[..., 2])[..., None]), np.exp(a)
            forward, back, scale = np.zeros_like(e), np.ones_like(e), np.ones((m, longest, 1))
            for t in range(longest):  # each place's sums are scaled to 1
                x = e[:, t] * (forward[:, t - 1] @ moves if t else 1)
                scale[:, t, 0] = np.where(mask[:, t], three(x), 1)
                forward[:, t] = np.where(mask[:, t, None], x / scale[:, t], forward[:, t - 1])
            later = e / scale
            for t in range(longest - 2, -1, -1):
                back[:, t] = np.where(mask[:, t + 1, None], (later[:, t + 1] * back[:, t + 1]) @ moves.T, 1)
            marginal = forward * back * mask[..., None]
            both = moves * (forward[:, :-1].reshape(-1, 3).T @ (later * back * mask[..., None])[:, 1:].reshape(-1, 3))
            gap = truth - marginal
            own = [shapes.T @ np.stack([np.bincount(x.ravel(), gap[..., k].ravel(), len(seen)) for k in range(3)], 1) for x in at]
            slopes = np.concatenate([*own, files.T @ gap.sum(1)]) / total - decay * weights, (true_pairs - both) / total - decay * a
            for x, slope, (first, second) in zip((weights, a), slopes, state):
                first += 0.1 * (slope - first)
                second += 0.01 * (slope**2 - second)
                x += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        return Field(weights, a)

    def viterbi(self, e: np.ndarray) -> list[int]:
        """The best tags of a stretch that lies between tokens that are surely outside."""
        a = self.transitions
        score, back = e[0] + a[OUTSIDE], []
        for x in e[1:]:
            paths = score[:, None] + a
            back.append(paths.argmax(0))
            score = paths.max(0) + x
        best = [int((score + a[:, OUTSIDE]).argmax())]
        for b in reversed(back):
            best.append(int(b[best[-1]]))
        return best[::-1]


class Tagger:
    """Tags whole texts, many at once; emissions are looked up by token."""

    REMEMBERED = 1 << 20

    def __init__(self, field: Field):
        self.field = field
        self.of_shape = [field.weights[SHAPES * p : SHAPES * (p + 1)] for p in range(PLACES)]
        self.of_file = field.weights[SHAPES * PLACES :]
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[str, int] = {"": 0}
        self.by_shape: dict[tuple[int, ...], int] = {(): 0}
        self.rows = [np.zeros((PLACES, 3))]

    def _id(self, token: str) -> int:
        s = shape(token)
        k = self.by_shape.get(s)
        if k is None:
            k = self.by_shape[s] = len(self.rows)
            self.rows.append(np.stack([w[list(s)].sum(0) for w in self.of_shape]))
        self.ids[token] = k
        return k

    def secrets(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """Spans of each text that are tagged begin and inside."""
        if len(self.ids) > self.REMEMBERED:
            self._clear()
        get, made = self.ids.get, self._id
        ids, starts, bias = [0, 0], [], []
        for text in texts:
            tokens = _TOKEN.findall(text)
            starts.append(len(ids))
            bias.append(self.of_file[file_features(text, len(tokens))].sum(0))
            for t in tokens:
                k = get(t)
                ids.append(made(t) if k is None else k)
            ids += (0, 0)
        at, table = np.array(ids, dtype=np.int32), np.stack(self.rows)
        e = table[at, 0]
        e[1:] += table[at[:-1], 1]
        e[2:] += table[at[:-2], 2]
        e[:-1] += table[at[1:], 3]
        ends = np.array([*starts[1:], len(ids)]) - 2
        for s, n, b in zip(starts, ends, bias):
            e[s:n] += b
        open_ = e[:, 0] - e[:, 1:].max(1) <= self.field.sure
        open_[:2] = False
        for n in ends:
            open_[n : n + 2] = False
        edges = np.flatnonzero(np.diff(open_.astype(np.int8), prepend=0, append=0))
        tagged: dict[int, dict[int, int]] = {}
        for a, b in zip(edges[::2], edges[1::2]):
            tags = self.field.viterbi(e[a:b])
            if any(tags):
                k = int(np.searchsorted(starts, a, "right")) - 1
                tagged.setdefault(k, {}).update({int(a) - starts[k] + i: t for i, t in enumerate(tags) if t})
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        for k, tags in tagged.items():
            last = -2
            for i, m in enumerate(_TOKEN.finditer(texts[k])):
                if i in tags:
                    if tags[i] == INSIDE and last == i - 1:
                        out[k][-1] = out[k][-1][0], m.end()
                    else:
                        out[k].append(m.span())
                    last = i
        return out


def train_field(docs: DataFrame, sample_rows: int = 12_000, made_rows: int = 1_000, made: int = 8, kinds: tuple[str, ...] = tuple(MADE), id_col: str = "doc_id", text_col: str = "text") -> Field:
    """A field trained on at most `sample_rows` rows: those whose hash of id and text is smallest, so that the same table gives the same field.

    Only windows of some 20 tokens leave the tasks: around the first eight secrets of each row, and, for about
    `made_rows` of the rows, other words with `made` windows whose secrets and harmless things are made up, of the given
    kinds. The field is fitted to the first 2 * sample_rows windows, in order of the rows' hashes.
    """
    rows = docs.select(F.xxhash64(F.col(id_col).cast("string"), whole(F.col(text_col))).alias("h"), whole(F.col(text_col)).alias("text"))
    sample = rows.select("h").orderBy("h").limit(sample_rows).agg(F.max("h").alias("h"), F.count(F.lit(1)).alias("n")).first()
    if not sample["n"]:
        return Field.fit([])
    last, step = sample["h"], max(1, sample["n"] // made_rows)

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [(h, w) for h, text in zip(part["h"], part["text"]) for w in enumerate(windows(text, h, made=made if h % step == 0 else 0, kinds=kinds))]
            yield pd.DataFrame({"h": [h for h, _ in found], "i": [i for _, (i, _) in found], "tokens": [w[0] for _, (_, w) in found], "tags": [w[1] for _, (_, w) in found], "file": [w[2] for _, (_, w) in found]})

    schema = "h long, i int, tokens array<string>, tags array<int>, file array<int>"
    pieces = rows.where(F.col("h") <= F.lit(last)).orderBy("h").limit(sample_rows).mapInPandas(cut, schema).orderBy("h", "i").limit(2 * sample_rows).toPandas()
    pieces = pieces.sort_values(["h", "i"], kind="stable")
    return Field.fit([(list(t), list(g), list(f)) for t, g, f in zip(pieces["tokens"], pieces["tags"], pieces["file"])])


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_tagged long"


def scan_rows(ids: list, texts: list[str], tagger: Tagger) -> list[tuple]:
    """A RESULT row for each text. Tagged spans that touch a fixed one are left out, as it stays."""
    out = []
    for doc_id, text, tagged in zip(ids, texts, tagger.secrets(texts)):
        base = base_spans(text)
        more = [("crf", s, e) for s, e in tagged if not any(s < y and x < e for _, x, y, _ in base)]
        count = [sum(b[0] == k for b in base) for k in KINDS]
        joined = lambda spans: ",".join(f"{x[0]}:{x[1]}:{x[2]}" for x in spans)
        both = sorted([b[:3] for b in base] + more, key=lambda x: (x[1], (*KINDS, "crf").index(x[0])))
        out.append((doc_id, *count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(both), len(more)))
    return out


def scan_secrets(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """RESULT for each row of docs: counts and digest of the fixed patterns' spans, and all spans with the field's as kind crf.

    Null and empty texts have no spans; repeated rows are scanned each; an empty table gives no rows; other columns are
    ignored. The field, a few kilobytes, goes to the tasks with the function; nothing is shuffled.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(field)
        for part in parts:
            for k in range(0, len(part), 256):
                ids, texts = part["doc_id"].iloc[k : k + 256].astype("Int64").tolist(), part["text"].iloc[k : k + 256].tolist()
                yield pd.DataFrame(scan_rows(ids, texts, tagger), columns=[x.split()[0] for x in RESULT.split(", ")]).astype({"doc_id": "Int64"})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(F.col(text_col)).alias("text")).mapInPandas(run, RESULT)


def without_secrets(text, field: Field):
    """Column of texts with every fixed and tagged secret replaced by [SECRET]; null stays null."""

    @F.pandas_udf("string")
    def cleaned(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = Tagger(field)
        for part in parts:
            texts = [x or "" for x in part]
            out = []
            for text, tagged, given in zip(texts, (t for k in range(0, len(texts), 256) for t in tagger.secrets(texts[k : k + 256])), part):
                spans = sorted([(s, e) for _, _, e, s in base_spans(text)] + tagged)
                at, kept = 0, []
                for s, e in spans:
                    if s >= at:
                        kept += (text[at:s], "[SECRET]")
                    at = max(at, e)
                out.append(None if given is None else "".join(kept) + text[at:] if spans else text)
            yield pd.Series(out, dtype=object)

    return cleaned(text)
