"""Operators 11 to 13 against brute force, numeric gradients and held-out labels."""

import hashlib
import re
import zlib
from collections import defaultdict
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import prefix_trie, quality, queries, runs

SF = "/root/testdata/sf0.001"


def crc(x):
    return zlib.crc32(("" if x is None else str(x)).encode())


# 11: prefixes of conversations


def trie(rows):
    """Nodes by definition; rows: (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in turns.items():
        h = crc(c) % 6
        built[c] = turns.get(c - c % 100, [])[:h] + own[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    kids = defaultdict(int)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    ends = lambda k: ",".join(str(c) for c in members[k] if len(built[c]) == len(k))
    return sorted(
        (m[0], len(k), -1 if not k else members[k[:-1]][0], len(m), kids[k] if k in kids else 0, leaves[k], saved[k], hashlib.sha256(ends(k).encode()).hexdigest()) for k, m in list(members.items())
    )


def nodes(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, block int, d string")


def odd_rows():
    rng = np.random.default_rng(3)
    rows = []
    for c in [*range(0, 60), *range(100, 130), *range(350, 360), 10_007]:
        for t in range(int(rng.integers(1, 9))):
            rows.append((c, t, ["user", "assistant", None][t % 3], [f"t{t}", f"é{rng.integers(0, 2)}😀", None, ""][int(rng.integers(0, 4))]))
    rows += [(c, t, r, x) for c in (7, 8, 9) for _, t, r, x in [q for q in rows if q[0] == 3]]
    rows += [(5, None, "system", "first"), (5, None, None, None), (None, 1, "user", "nobody"), (20, 2, "user", "tie"), (20, 2, "user", "tie"), (20, 2, "b", "tie"), (101, 0, "us", "er"), (102, 0, "u", "ser")]
    return rows


def test_trie_against_brute_force(spark):
    rows = odd_rows()
    assert nodes(prefix_trie.prefix_trie(conversations(spark, rows))) == trie(rows)


def test_trie_with_a_full_sketch(spark, monkeypatch):
    """A sketch that is far too small screens nothing out, and changes nothing."""
    rows = odd_rows()
    monkeypatch.setattr(prefix_trie, "count_min", partial(prefix_trie.count_min, segment_cells=64))
    assert nodes(prefix_trie.prefix_trie(conversations(spark, rows), most_cells=16)) == trie(rows)


def test_trie_of_a_long_conversation_in_blocks(spark):
    """Most rows are two conversations, one a copy of the other but for its end; both lie in several blocks."""
    rows = [(c, t, "user", f"turn {t % 5}" if t < 390 else f"{c}") for c in (200, 400) for t in range(400)] + [(c, t, "user", f"{t}") for c in range(20) for t in range(3)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = prefix_trie.numbered_turns(conversations(spark, rows))
        assert turns.where("conv_id = 200").select("block").distinct().count() > 1
        assert nodes(prefix_trie.prefix_trie(conversations(spark, rows))) == trie(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_trie_of_turnless_and_no_conversations(spark):
    lone = next(c for c in range(101, 200) if crc(c) % 6 >= 1)  # without conversation 100 it has no turn left
    rows = [(lone, 0, "user", "gone")]
    assert nodes(prefix_trie.prefix_trie(conversations(spark, rows))) == trie(rows) and trie(rows)[0][1:6] == (0, -1, 1, 0, 1)
    assert prefix_trie.prefix_trie(conversations(spark, rows).limit(0)).count() == 0


def test_sketch_never_calls_a_shared_prefix_lone(spark):
    df = spark.range(3000).select(F.xxhash64(F.col("id") % 2000).alias("p"), F.xxhash64(F.lit(1), F.col("id") % 2000).alias("q"))
    got = df.toPandas()
    sketch = prefix_trie.count_min(df, segment_cells=1024)
    lone, twice = sketch.lone(got["p"].to_numpy(), got["q"].to_numpy()), got.duplicated(["p", "q"], keep=False).to_numpy()
    assert not (lone & twice).any() and (lone & ~twice).sum() > 900


# 12: quality by passages


def test_passages_cover_whole_texts():
    long = " ".join(f"w{i}" for i in range(quality.PASSAGE_WORDS * quality.MOST_PASSAGES * 2 + 5))
    texts = ["", " \n", "one", "a b " * 100, long, "x" * 5_000_000, "日本語 é " * 10]
    x, n = quality.passages(texts)
    assert len(x) == n.sum() and n[:3].tolist() == [1, 1, 1] and n[3] == 4 and quality.MOST_PASSAGES // 2 < n[4] <= quality.MOST_PASSAGES and np.isfinite(x).all()
    alone = [quality.passages([t])[0] for t in texts]
    assert np.allclose(np.concatenate(alone), x, atol=1e-6)
    words = np.expm1(x[:, -1])
    at = np.cumsum(n) - n
    assert np.allclose(np.add.reduceat(words, at), [len(t.split()) for t in texts], rtol=1e-3)


def test_repetition_measures():
    x, _ = quality.passages(["the " * 64, " ".join(f"w{i}" for i in range(64)), ("ab cd " * 64)])
    distinct, pairs, new, same = (x[:, -len(quality.EXTRA) + k] for k in range(4))
    assert distinct[0] < 0.02 and distinct[1] == 1 and same[0] > 0.98 and same[1] == 0 and pairs[2] < 0.1 and new[3] < 0.05


def test_gradients_of_the_attention():
    rng = np.random.default_rng(1)
    n = np.array([1, 4, 2, 7])
    x, y = rng.standard_normal((n.sum(), quality.WIDTH)), np.array([0.0, 1, 1, 0])
    m = {k: rng.standard_normal(s) * 0.3 for k, s in {"w": (quality.WIDTH, 5), "b": 5, "v": (5, 3), "u": (5, 3), "t": 3, "c": 5, "d": 1}.items()}
    loss = lambda m: -np.mean(y * np.log(p := quality._forward(m, x, n)["p"]) + (1 - y) * np.log(1 - p))
    found = quality._gradients(m, x, n, y, 0.0)
    for k, w in m.items():
        for at in [tuple(rng.integers(0, s) for s in w.shape) for _ in range(3)]:
            up, down = ({**m, k: w.copy()} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - found[k][at]) < 1e-6


def test_one_bad_passage_is_attended_to():
    """Texts differ in one passage of many; only attention tells them apart, and it lies on that passage."""
    rng = np.random.default_rng(2)
    words = [f"{a}{b}" for a in "kelmorta" for b in "aeiou"]
    clean = lambda: " ".join(rng.choice(words, 64))
    junk = " ".join(["@@##%%"] * 64)
    texts, y = [], []
    for k in range(240):
        parts = [clean() for _ in range(8)]
        if k % 2:
            parts[int(rng.integers(0, 8))] = junk
        texts.append("\n".join(parts))
        y.append(1.0 - k % 2)
    x, n = quality.passages(texts)
    model = quality.fit(x, n, np.array(y), rounds=30)
    assert ((model.scores(texts) > 0.5) == np.array(y)).all()
    inside = quality._forward(model.weights, (quality.passages([texts[1]])[0] - model.mean) / model.scale, np.array([8]))["a"]
    assert inside.argmax() == texts[1].split("\n").index(junk)


def test_quality_held_out(spark):
    got = queries.op12_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").toPandas()
    ones, zeros = got.score[got.quality == 1].to_numpy(), got.score[got.quality == 0].to_numpy()
    assert (ones[:, None] > zeros[None]).mean() > 0.97 and (got.predicted == got.quality).mean() > 0.95
    assert got.held_out.all() and all(crc(i) % 4 == 2 for i in got.doc_id)


def test_quality_of_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 1), (10, 0), (9, 0), (9, None), (None, 1), (10, 0)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    got = quality.score_quality(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    same = defaultdict(set)
    for r in got:
        same[r.doc_id].add(r.score)
    assert len(same[2]) == 1 and same[4] == same[5]
    assert quality.score_quality(none, model).count() == 0
    for other in (labels.limit(0), labels.where("quality = 1")):
        assert len({r.score for r in quality.score_quality(odd, quality.train(odd, other)).collect()}) == 1
    assert quality.score_quality(odd, quality.train(none, labels)).count() == odd.count()


# 13: runs of words


def brute_runs(w, least=12):
    found, n = {}, len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def some_words(rng):
    n, kinds = int(rng.choice([0, 5, 11, 12, 13, 40, 90, 200, 333])), int(rng.choice([1, 2, 3, 5, 50]))
    w = rng.integers(0, kinds, n)
    for _ in range(int(rng.integers(0, 4)) if n > 3 else 0):
        a = int(rng.integers(0, n))
        p, b = 1 + int(rng.integers(0, max(1, (n - a) // 2))), a + int(rng.integers(0, n - a))
        for i in range(a, b):
            w[i] = w[a + (i - a) % p]
    return w


@pytest.mark.parametrize("least", [12, 2, 20])
def test_runs_against_brute_force(least):
    rng = np.random.default_rng(least)
    for _ in range(200):
        w = some_words(rng)
        want = brute_runs(w.tolist(), least)
        assert runs.runs_of([str(x) for x in w], least) == want
        caught, at = runs.Catchers(least), 0
        most = int(rng.choice([1, 2, 9, 60]))
        while at < len(w):  # appended in pieces, or word by word
            step = int(rng.integers(1, most + 1))
            caught.extend(w[at : at + step])
            at += step
            if rng.random() < 0.02:
                assert caught.runs() == brute_runs(w[:at].tolist(), least)
        assert caught.runs() == want


def test_runs_of_long_texts():
    assert runs.runs_of(["a"] * 300_000) == [(0, 300_000, 1)]
    assert runs.runs_of(["a", "b", "c"] * 100_000) == [(0, 300_000, 3)]
    assert runs.runs_of([f"w{i}" for i in range(100_000)] * 2 + ["end"]) == [(0, 200_000, 100_000)]


def test_runs_query_against_brute_force(spark):
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    planted = 0
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = crc(doc_id), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        found, r = brute_runs(w), got[doc_id]
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (best[0] is not None and 1000 * best[1] // best[2] or None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest()
        gone = {i for a, b, c in found for i in range(a + c, a + b)}
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
    assert planted > 5


def test_runs_of_odd_tables(spark, odd, none):
    got = {r.doc_id: r for r in runs.periodic_runs(odd).collect()}
    assert [tuple(x) for x in got[10].runs] == [(0, 3000, 1)] and got[10].collapsed == "ab"
    assert got[4].n_words == got[5].n_words == got[6].n_words == 0 and got[4].collapsed == "" and got[4].runs == []
    assert runs.run_report(runs.periodic_runs(runs.with_planted_runs(odd))).count() == odd.count()
    assert runs.periodic_runs(runs.with_planted_runs(none)).count() == 0
    clash = odd.withColumns({"runs": F.lit(1), "w": F.lit(2), "h": F.lit("x")})
    assert runs.run_report(runs.periodic_runs(clash)).count() == odd.count()
