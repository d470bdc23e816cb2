"""The corpus operators against brute force, on small tables with odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from lacuna.llm import archives, decontamination, fingerprints, jaccard_join, packing, personal_data, secrets, substring_dedup, toxicity  # noqa: E402
from lacuna.llm.decontamination import contamination  # noqa: E402
from lacuna.llm.suffixes import common_prefixes, suffix_array  # noqa: E402
from lacuna.llm.token_counts import count_tokens  # noqa: E402

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def test_fingerprints(odd, none):
    got = fingerprints.fingerprint_documents(odd).collect()
    assert len(got) == odd.count() and fingerprints.fingerprint_documents(none).count() == 0
    same = {r.doc_id: r for r in got}
    assert same[1].fingerprint == same[2].fingerprint == same[None].fingerprint and same[4].fingerprint == same[5].fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got) and same[2].near_next == 1.0
    ordered = sorted({i: t for i, t in texts_of(odd) if i is not None}.items(), reverse=True)
    after = dict(zip([i for i, _ in ordered], [t for _, t in ordered[1:]]))
    for i, t in ordered[:-1]:
        k = len(t) // 3
        assert same[i].edited_sha256 == hashlib.sha256((t[: len(t) - k] + after[i][:k]).encode()).hexdigest()


def test_sketches_at_the_floor_and_as_bytes(spark):
    """A text with fewer hashes below the fraction than the floor keeps the floor's number; bytes give back every sketch."""
    texts = ["", "one two", *(" ".join(f"w{k}x{j}" for j in range(n + 4)) for k, n in enumerate((31, 32, 33, 200, 400)))]
    rows = fingerprints.with_sketch(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"), "text", "sk")
    rows = fingerprints.with_unpacked(rows.withColumn("bytes", fingerprints.packed(F.col("sk"))), "bytes", "back").orderBy("doc_id").collect()
    assert all(r["sk"] == r["back"] for r in rows)
    for r, text in zip(rows, texts):
        w = text.split()
        every = sorted({hashlib.md5(" ".join(w[i : i + 5]).encode()).hexdigest()[:16] for i in range(max(len(w) - 4, 1))}) if w else []
        below = [h for h in every if h < "2"]
        kept = below if len(below) >= 32 else every[:32]
        bound = fingerprints.COMPLETE if len(kept) == len(every) else "2" if len(below) >= 32 else kept[-1]
        assert (r["sk"]["bound"], r["sk"]["hashes"]) == (bound, kept)


def test_contamination(spark, odd, none):
    items = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(20, 35))), (2, "ONE two"), (3, None), (4, "")], "item_id long, text string")
    got = {r.doc_id: r for r in contamination(odd, items).collect()}
    assert got[1].n_hit == 15 and got[1].n_items == 1 and got[1].items_sha256 == hashlib.sha256(b"1").hexdigest()
    assert got[8].n_hit == got[7].n_hit == 2 and got[4].n_words == 0 and not got[9].contaminated
    assert contamination(none, items).count() == 0 and not contamination(odd, items.limit(0)).where("contaminated").count()


@pytest.mark.parametrize("most", [0, 200_000])
def test_contamination_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", most)  # 0: as if every side were too large to send
    rng = np.random.default_rng(2)
    between = (" ", ", ", "\n", " - ", "\u00a0")
    text = lambda n: "".join(f"{rng.choice(['Ab', 'c1', 'é', 'dd', 'E'])}{between[rng.integers(0, 4)]}" for _ in range(n))
    items = [(k, text(int(rng.integers(0, 16)))) for k in range(12)] + [(None, text(3)), (5, text(12)), (20, None), (21, "  ,")]
    whole_item = items[3][1]
    rows = [(k, text(int(rng.integers(0, 60))) + (whole_item if k % 7 == 0 else "")) for k in range(60)]
    rows += [(1, text(40)), (1, text(5)), (None, text(30)), (None, text(30)), (None, None), (70, ""), (3, rows[3][1]), (71, "AB c1 a" * 5)]

    def words(t):
        low = (t or "").translate({c: c + 32 for c in range(65, 91)})
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    wanted = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            wanted[tuple(w[k : k + 10])].add("" if i is None else str(i))
    want = Counter()
    for i, t in rows:
        w, hit, named = words(t), set(), set()
        for x, names in wanted.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    named |= names
        want[i, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)] += 1
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, word long, key string")
    got = contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in got.collect()) == want


def test_token_counts(odd, none):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=PIECES)
    got = count_tokens(odd, PIECES).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, len(model.encode(t))) for i, t in texts_of(odd))
    assert count_tokens(none, PIECES).count() == 0


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(BYTES)
    want = Counter((i, zlib.crc32(np.array([*model.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes())) for i, t in texts_of(odd))
    pieces = packing.pack_documents(odd, BYTES).collect()
    ids = {i: np.array([*model.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in texts_of(odd)}
    per_doc, per_sequence = Counter(), defaultdict(list)
    for p in pieces:
        assert zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) == p.ids_crc32
        per_doc[p.doc_id] += p.length
        per_sequence[p.sequence_id].append((p.offset, p.length))
    assert all(per_doc[i] == len(ids[i]) * sum(n for (j, _), n in want.items() if j == i) for i in ids)
    for parts in per_sequence.values():
        total = sum(n for _, n in parts)
        assert total <= 1024 and [o for o, _ in sorted(parts)] == list(np.cumsum([0, *(n for _, n in sorted(parts))])[:-1])
        assert total == 1024 or total & (total - 1) == 0
    assert packing.pack_documents(none, BYTES).count() == 0
    examples = spark.createDataFrame([(i, 100 + i % 400, 50) for i in range(200)] + [(900, 5000, 1), (901, None, None)], "id long, n_tokens long, n_loss long")
    placed = packing.pack_examples(examples, 1024, 4, 150).collect()
    assert len(placed) == 202 and {r.id for r in placed if r.sequence_id is None} == {900, 901}
    loads = defaultdict(lambda: [0, 0, 0])
    for r in placed:
        if r.sequence_id is not None:
            loads[r.sequence_id] = [a + b for a, b in zip(loads[r.sequence_id], (r.length, 1, r.n_loss))]
    assert all(a <= 1024 and b <= 4 and c <= 150 for a, b, c in loads.values())


def test_packing_of_conversations(spark):
    """Lengths and loss by the tokenizers library; every conversation once, within all three limits, and few sequences."""
    from tokenizers import Tokenizer

    from lacuna.llm import queries

    model, turns = Tokenizer.from_file(BYTES), spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    odd = [(-1, 0, "assistant", "hi " * 5000), (-2, 0, None, None), (-2, 0, "assistant", ""), (None, 1, "user", "who"), (None, 1, "user", "who"), (-3, None, "assistant", "😀 " * 400)]
    more = spark.createDataFrame([(*r, "x", 5) for r in odd], "conv_id long, turn long, role string, text string, id string, n long")
    want = defaultdict(lambda: [0, 0])
    for r in [*turns.collect(), *more.collect()]:
        n = len(model.encode(r.text or "", add_special_tokens=False).ids) + 1
        want[r.conv_id][0] += n
        want[r.conv_id][1] += n * (r.role == "assistant")
    examples = packing.conversation_examples(turns.unionByName(more, allowMissingColumns=True), BYTES)
    assert {r.id: [r.n_tokens, r.n_loss] for r in examples.collect()} == want
    loads = defaultdict(list)
    for r in packing.pack_examples(examples.coalesce(1), 4096, 16, 3072).collect():
        assert [r.length, r.n_loss] == want.pop(r.id)
        assert (r.sequence_id is None) == (r.length > 4096 or r.n_loss > 3072)
        if r.sequence_id is not None:
            loads[r.sequence_id].append((r.offset, r.length, r.n_loss))
    assert not want
    for parts in loads.values():
        ends = np.cumsum([0, *(n for _, n, _ in sorted(parts))])
        assert [o for o, _, _ in sorted(parts)] == list(ends[:-1]) and ends[-1] <= 4096 and len(parts) <= 16 and sum(x for _, _, x in parts) <= 3072
    used = [max(sum(n for _, n, _ in p) / 4096, len(p) / 16, sum(x for _, _, x in p) / 3072) for p in loads.values()]
    assert sum(u < 0.5 for u in used) <= 1
    assert queries.packing_conversations(spark, "/root/testdata/sf0.001").count() == turns.select("conv_id").distinct().count()
    assert packing.conversation_examples(turns.limit(0), BYTES).count() == 0


def test_packing_of_mixed_white_space():
    from tokenizers import Tokenizer

    model, encode = Tokenizer.from_file(BYTES), packing.ByteEncoder(BYTES)
    space = " \t\n\r\x0b\x0c\x1c\x1f\x85\u00a0\u1680\u2003\u2028\u202f\u3000"
    texts = ["one\t two", "one\u00a0 two", "a \u00a0b", "a\u3000 b", "a  b\tc", "a\r\nb", "a b\r\n\r\nc d", "x ", " x", ""]
    texts += [f"one{a}two{b}{c}three{b}" for a in space for b in space for c in ("", *space)]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == model.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_of_long_white_space(spark):
    """Runs of white space of any length and place are encoded as the tokenizers library does, and end no query."""
    from tokenizers import Tokenizer

    reference, ours = Tokenizer.from_file(BYTES), packing.ByteEncoder(BYTES)
    rng = np.random.default_rng(4)
    mixed = lambda n: "".join(rng.choice([" ", "\n", "\t", "\u00a0", "\u3000", "\r\n"], n))
    texts = [f"a{' ' * 5000}b", f"a{chr(10) * 5000}b c", f"x {mixed(9000)}end {mixed(5000)} two", f"x{mixed(20_000)}", f"{' ' * 4096}a  b", "q" + " " * 1_000_000 + "b", "\n" * 1_000_001, "\x1c" * 5000 + " " * 5000]
    for text in texts:
        assert np.frombuffer(ours(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids
    assert len(ours("w" + " " * 20_000_000 + " x")) == 4 * 20_000_002
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(99, "short")], "doc_id long, text string")
    got = packing.pack_documents(df, BYTES, 1024).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert len(got) == len(texts) + 1 and all(r.n == r.t for r in got)


def test_suffix_arrays():
    rng = np.random.default_rng(3)
    for k in range(60):
        t = rng.integers(1, 2 + k % 4, size=1 + k * 2).astype(np.uint8) if k % 3 else np.tile(rng.integers(1, 4, size=1 + k % 7), 20).astype(np.uint8)
        b = bytes(t)
        order = sorted(range(len(b)), key=lambda i: b[i:])
        got = suffix_array(t)
        assert list(got) == order
        lengths = common_prefixes(t, got)
        for x, y in zip(order, order[1:]):
            n = 0
            while y + n < len(b) and x + n < len(b) and b[x + n] == b[y + n]:
                n += 1
            assert lengths[y] == n


def test_substring_dedup(odd, none):
    rows = [(i, t.encode()) for i, t in texts_of(odd)]
    seen = Counter(b[k : k + 400] for _, b in rows for k in range(len(b) - 399))
    want = Counter()
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        want[i, len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    got = substring_dedup.without_repeats(odd)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == want
    assert substring_dedup.without_repeats(none).count() == 0


def test_substring_dedup_of_a_hot_anchor(spark, monkeypatch):
    rng = np.random.default_rng(5)
    noise = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    line, passage = noise(390), noise(430)
    rows = [(i, noise(300) + (passage if i % 5 == 0 else line) + noise(300)) for i in range(60)] + [(i, noise(80) * 12) for i in range(60, 64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fed, real, groups = [], substring_dedup.repeated_windows, Counter()
    monkeypatch.setattr(substring_dedup, "repeated_windows", lambda f, n, t: fed.append(f) or real(f, n, t))
    got = {r.dk: r.spans for r in substring_dedup.removed_spans(docs.selectExpr("doc_id dk", "text"), 400, 4096).collect()}
    for r in fed[0].collect():
        groups[r.anchor] += len(r.body)
    assert groups and max(groups.values()) <= 4096
    seen = Counter(t[k : k + 400] for _, t in rows for k in range(len(t) - 399))
    for i, t in rows:
        want = {k + j for k in range(len(t) - 399) if seen[t[k : k + 400]] > 1 for j in range(400)}
        assert {x for s in got.get(i, ()) for x in range(s["from"], s["to"])} == want


def test_substring_dedup_shuffles_texts_with_repeats_only(spark, monkeypatch):
    rng = np.random.default_rng(6)
    noise = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage = noise(420)
    rows = [(i, noise(500) + passage * (i % 50 == 7) + noise(200)) for i in range(300)]
    rows += [rows[7], rows[7], rows[8], (8, None), (None, ""), (None, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = Counter(t[k : k + 400] for _, t in rows if t for k in range(len(t) - 399))
    want = Counter((i, len({k + j for k in range(len(t or "") - 399) if seen[t[k : k + 400]] > 1 for j in range(400)})) for i, t in rows)
    for most in (1 << 25, 64):  # with 64 bits many texts pass that hold nothing
        parts, real = [], substring_dedup.split_by_keys
        with monkeypatch.context() as m:
            m.setattr(substring_dedup, "MOST_BITS", most)
            m.setattr(substring_dedup, "split_by_keys", lambda t, k: parts.append((k, *real(t, k))) or parts[-1][1:])
            got = substring_dedup.without_repeats(docs)
            assert Counter((r.doc_id, r.n_removed) for r in got.collect()) == want
        for keys, held, other in parts:
            assert held.join(keys, "dk", "left_semi").distinct().count() == keys.count() and not other.join(keys, "dk", "left_semi").count()
            assert held.count() + other.count() == len(rows) and (most == 64 or held.count() <= 60)


def test_personal_data(odd, none):
    got = {r.doc_id: r for r in personal_data.find_personal_data(odd).collect()}
    assert (got[11].n_email, got[11].n_ip, got[11].n_card, got[11].n_phone) == (1, 1, 1, 1)
    text = dict(texts_of(odd))[11]
    spans = [s.split(":") for s in got[11].spans.split(",")]
    assert [text[int(a) : int(b)] for _, a, b in spans[:4]] == ["a.b@c.de", "10.0.0.1", "4111 1111 1111 1111", "+1 (234) 555-6789"]
    assert got[4].spans == "" and personal_data.find_personal_data(none).count() == 0


def _luhn(digits):
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_base_spans_against_the_patterns_alone(spark):
    """Texts of random pieces; the contract's patterns by Python's engine, each match tested once and dropped if it fails."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    number = lambda t: re.sub("[^0-9]", "", t)
    valid = {
        "email": lambda t: True, "ip": lambda t: all(int(x) <= 255 for x in t.split(".")), "card": lambda t: 13 <= len(number(t)) <= 19 and _luhn(number(t)),
        "phone": lambda t: 9 <= len(number(t)) <= 15,
    }
    pieces = ["a", "b.c", "@", "@@", ".", "..", "%", "-", " ", "  ", "+", "(", ")", "1", "22", "333", "255", "256", "000", "4111 1111 1111 1111", "4111-1111-1111-111", "5500000000000004", "10.0.0.1", "x@y.z", "é", "😀", "\n", "٣", "+1 (234) 555", "6789"]
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(pieces, size=rng.integers(0, 40))) for _ in range(3000)] + ["1." * 40_000, "a@" * 40_000, "4" * 60_000, "+1 " * 30_000, "a.b@c.d" * 9_000]
    got = personal_data.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), support=10**6).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.doc_id]
        found = {k: [m.span() for m in re.finditer(p, t) if valid[k](m[0])] for k, p in patterns.items()} if len(t) < 5000 else None
        if found is None:
            continue  # such texts only have to end: the plain patterns take quadratic time on them
        base = ",".join(f"{k}:{a}:{b}" for k in patterns for a, b in found[k])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(found[k]) for k in patterns), t
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans == base, t


def _disclosed(rows, share=0.8, support=3):
    """Brute force over (doc_id, text): the terms' places by doc_id and text, with emails as the only values."""
    email = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    blank = lambda t: email.sub(lambda m: " " * len(m[0]), t)
    words = lambda t: [(m[0].lower(), m.span()) for m in re.finditer(r"[^\W\d_]+", blank(t))]
    values, terms, n = defaultdict(list), defaultdict(list), len(rows)
    for _, t in rows:
        for v in {x.lower() for x in email.findall(t)}:
            values[v].append(t)
        for w in {w for w, _ in words(t)}:
            terms[w].append(t)
    out = set()
    for v, has in values.items():
        for w, there in terms.items():
            both = [t for t in has if t in set(there)]
            if len(set(both)) >= support and len(has) < n and np.log2(len(both) * n / (len(there) * len(has))) >= share * np.log2(n / len(has)) - 1e-12:
                out.add(w)
    return {(i, t): sorted(p for w, p in words(t) if w in out) for i, t in rows}


def _term_spans(rows, found):
    text = dict(rows)
    return {(r.doc_id, text[r.doc_id]): sorted((int(x.split(":")[1]), int(x.split(":")[2])) for x in r.spans.split(",") if x.startswith("term:")) for r in found}


def test_terms_in_copied_groups(spark):
    texts = [f"Quillfeather wrote number{k} to ann@host.org about it" for k in range(3)]
    rows = [(c * 3 + k, t) for c in range(12) for k, t in enumerate(texts)] + [(1000 + k, f"nothing here to see {'abcdefghij'[k % 10]} about it") for k in range(400)]
    found = personal_data.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert _term_spans(rows, found) == _disclosed(rows)
    assert all(r.n_term >= 1 for r in found if r.doc_id < 36)


def test_terms_are_generalised_or_removed(spark, odd, none):
    """Beginnings, counts and texts against brute force: one term has a wide beginning, one has none, and words that disclose nothing stay."""
    rows = [(k, f"Quillfeather and Zyx sent no {'abcd'[k % 4]} to ann@host.org today") for k in range(8)] + [(20 + k, f"the quilt was {'pqrs'[k % 4]} today, quietly") for k in range(30)]
    rows += [(60 + k, f"a quiz was held {'abcd'[k % 4]} today") for k in range(40)] + [(200 + k, f"nothing {'klmn'[k % 4]} today") for k in range(300)] + [(900, "ZYX met quillfeather"), (None, "Zyx"), (901, None), (902, "")]
    texts, mail = [t or "" for _, t in rows], "ann@host.org"
    words = lambda t: {m[0].lower() for m in re.finditer(r"[^\W\d_]+", t.replace(mail, " "))}
    n, n_v = len(texts), sum(mail in t for t in texts)
    told = lambda has: sum(has(t) for t in texts if mail in t) * n / (sum(has(t) for t in texts) * n_v)
    limit = 2 ** (0.8 * np.log2(n / n_v))
    beside = {w for t in texts if mail in t for w in words(t)}
    disclosing = {w for w in beside if len({t for t in texts if mail in t and w in words(t)}) >= 3 and told(lambda t: w in words(t)) >= limit}  # noqa: B023
    shown = {}
    for w in disclosing:
        safe = [w[:k] for k in range(1, len(w)) if told(lambda t: any(x.startswith(w[:k]) for x in words(t))) < limit]  # noqa: B023
        shown[w] = safe[-1] + "*" if safe else ""
    assert shown["quillfeather"] == "quil*" and shown["zyx"] == "" and "today" not in shown
    want = {(i, re.sub(r"[^\W\d_]+", lambda m: shown.get(m[0].lower(), m[0]), (t or "").replace(mail, "\0")).replace("\0", "[email]")) for i, t in rows}
    got = personal_data.sanitise(spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string")).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.text) for r in got} == want
    of = {r.doc_id: r for r in got}
    assert (of[0].n_values, of[900].n_generalised, of[900].n_removed) == (1, 1, 1) and of[200].n_generalised + of[200].n_removed == 0
    assert personal_data.sanitise(none).count() == 0 and personal_data.sanitise(odd).count() == odd.count()
    long = "😀é fill " * 700  # spans within and across parts of 1024 code points
    got = personal_data.sanitise(spark.createDataFrame([(1, f"{long}a@b.cd {long}10.0.0.1{long[:1019]}x@y.zw" * 3)], "doc_id long, text string")).first()
    assert got.text == f"{long}[email] {long}[ip]{long[:1019]}[email]" * 3 and got.n_values == 9
    spans = personal_data.find_personal_data(odd).where("doc_id = 11").select("doc_id", "spans")
    text = odd.join(spans, "doc_id").select(personal_data.sanitised(F.col("text"), F.col("spans"))).first()[0]
    assert text == "mail [email] ip [ip] card [card] tel [phone] password = hunter22abc"


def test_terms_everywhere(spark):
    far = "the calm sea was over there and " * 6
    rows = [(k, f"李明 {far} Quillfeather {far} no{k} mail ann@host.org and {far} Ng quillfeather x{k}") for k in range(4)]
    rows += [(10, f"{far} then QUILLFEATHER came with Ng, not 李明."), (11, far), (12, None), (13, "")] + [(100 + k, far + f"and mail {k}") for k in range(300)]
    found = personal_data.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    rows = [(i, t or "") for i, t in rows]
    assert _term_spans(rows, found) == _disclosed(rows)
    text = dict(rows)
    got = {i: [text[i][a:b] for a, b in p] for (i, _), p in _term_spans(rows, found).items()}
    assert {"李明", "Quillfeather", "Ng", "quillfeather"} <= set(got[0]) and set(got[10]) == {"QUILLFEATHER", "Ng", "李明"} and got[11] == []


def test_secrets(odd, none):
    field = secrets.train_field(odd)
    got = {r.doc_id: r for r in secrets.scan_secrets(odd, field).collect()}
    text = dict(texts_of(odd))[11]
    m = re.search(r"password = hunter22abc", text)
    assert got[11].n_assign == 1 and f"assign:{m.start()}:{m.end()}" in got[11].spans and got[4].spans == ""
    assert secrets.scan_secrets(none, secrets.train_field(none)).count() == 0
    best = secrets.Field(np.zeros((secrets.SHAPES * secrets.PLACES + secrets.FILE, 3)), np.array([[1.0, 0, -2], [0, -1, 1], [0.5, 0, 0]]))
    e = np.random.default_rng(1).normal(size=(5, 3))
    from itertools import product

    score = lambda p: sum(e[i, x] for i, x in enumerate(p)) + sum(best.transitions[x, y] for x, y in zip((0, *p), (*p, 0)))
    assert tuple(best.viterbi(e)) == max(product(range(3), repeat=5), key=score)


def test_fixed_secrets_against_the_patterns_alone():
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    rng = np.random.default_rng(4)
    parts = ["password", "PassWD", "api_key", "APIKEY", "token", "secret", "=", ":", " ", "  ", "\"", "'", "\n", "AKIA", "A1B2C3D4E5F6G7H8", "abcdef", "0123456789ab", "fedcba98", "x", "é", "İ", "K", "ſecret", ".", "--", "日本"]
    for _ in range(3000):
        text = "".join(rng.choice(parts, size=rng.integers(0, 14)))
        want = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
        want += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
        assert [x[:3] for x in secrets.base_spans(text)] == sorted(want, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def test_field_finds_kinds_it_has_not_seen(spark):
    import random

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    base = [r.text for r in docs.where("length(text) > 300").orderBy("doc_id").limit(300).collect()]
    left_out = ("prefixed", "dotted", "coded")
    fields = {"some": secrets.train_field(docs, kinds=tuple(k for k in secrets.MADE if k not in left_out)), "all": secrets.train_field(docs)}
    chance = random.Random(8)
    plain = ["the password is required here", "see https://example.org/some/long-title-2023.html", "on 2023-11-05 we sold 12345678", "camelCaseName2 in report_2021.txt", "the token was lost in 1987"]
    known = ["Authorization: Bearer {}", "pwd = {}", "the password is {}", "'passphrase': '{}'", "DB_PWD=\"{}\""]
    for name, kinds in (("some", left_out), ("all", tuple(secrets.MADE))):
        tagger, found, said = secrets.Tagger(fields[name]), 0, 0
        for k, text in enumerate(base):
            kind = kinds[k % len(kinds)]
            value = secrets.MADE[kind][0](chance)
            put = known[k % len(known)].format(value)
            at = text.find(" ", len(text) // 2) + 1
            spans = tagger.secrets([text[:at] + put + " " + text[at:]])[0]
            s = at + put.index(value)
            found += any(a <= s and b >= s + len(value.rstrip("=")) for a, b in spans)  # padding may be left
            said += bool(tagger.secrets([text[:at] + plain[k % len(plain)] + " " + text[at:]])[0] and not secrets.base_spans(text))
        assert found >= 0.9 * len(base) and said <= 0.01 * len(base), (name, found, said)
    assert secrets.scan_secrets(docs, fields["all"]).where("n_tagged > 0").count() <= 5


def test_hex_without_digits():
    assert secrets.base_spans("ключ " + "f" * 24) == [("hex", 5, 29, 5)]


def test_field_of_dense_secrets_is_the_same_in_any_order(spark):
    rows = [(k, " ".join(f"password = hunter{k}x{j}abc" for j in range(8))) for k in range(60)]
    made = [secrets.train_field(spark.createDataFrame(r, "doc_id long, text string").repartition(n), 20) for r, n in ((rows, 1), (rows[::-1], 3))]
    assert np.array_equal(made[0].weights, made[1].weights)


def test_toxicity(spark, none):
    rows = [(i, ("you are a total fool and idiot " if i % 3 == 0 else "the sun is over the calm sea today ") * (1 + i % 4)) for i in range(300)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(5, None)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == 302 and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in got if r.held_out and r.doc_id < 300)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    empty = toxicity.train(none, labels.limit(0))
    assert toxicity.score_documents(none, empty).count() == 0


def test_boosting_and_isotonic_map(spark):
    """The calibrated score never falls as the raw one rises, copies score alike, and a table of one label or of odd columns is no error."""
    rows = [(i, ("you fool " if i % 2 else "calm sea ") * (1 + i % 7) + "today " * (i % 5)) for i in range(240)]
    docs = spark.createDataFrame([(i, t, "y", 0.5) for i, t in rows + rows[:10] + [(None, "you fool"), (500, "fool " * 60_000)]], "doc_id long, text string, toxic string, score double")
    noisy = spark.createDataFrame([(i, int((i % 2 == 1) != (i % 11 == 0)), "t") for i in range(240)], "doc_id long, toxic int, text string")
    got = toxicity.score_documents(docs, toxicity.train(docs, noisy)).collect()
    assert len(got) == 252 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by_text = defaultdict(set)
    for r in got:
        by_text[dict(rows).get(r.doc_id)].add(r.score)
    assert all(len(v) == 1 for t, v in by_text.items() if t)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert np.mean([r.predicted == r.doc_id % 2 for r in held]) > 0.9
    one = toxicity.train(docs, noisy.withColumn("toxic", F.lit(0)))
    assert all(0 <= r.score <= 1 for r in toxicity.score_documents(docs, one).collect())


def test_archives(spark):
    rows = [(1, "http://a", "x" * 2000), (2, "http://b", "x" * 2000), (3, "http://c", "é" * 10), (4, None, None), (5, "http://c", "é" * 10)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")
    got = {r.page_id: r for r in archives.archive_round_trip(pages).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None)}
    assert got[1].payload_bytes == 2000 and got[3].payload == "é" * 10 and got[1].payload_digest == hashlib.sha1(b"x" * 2000).hexdigest()
    assert archives.archive_round_trip(pages.limit(0)).count() == 0


def test_archives_with_null_and_repeated_ids(spark):
    long, other = "y" * 1500, "z" * 1200
    rows = [(None, long), (None, long), (7, long), (7, long), (3, long), (None, other), (None, None), (None, ""), (8, "s" * 999), (9, "s" * 999)]
    pages = spark.createDataFrame([(i, "http://p", t, "n", 1) for i, t in rows], "page_id long, url string, html string, record_type string, offset int")
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in archives.archive_round_trip(pages).collect())
    want = Counter()
    for i, t in rows:
        t = t or ""
        revisit = t == long and i != 7
        want[i, len(t), hashlib.sha1(t.encode()).hexdigest(), "revisit" if revisit else "response", 7 if revisit else None] += 1
    assert got == want


def test_zip64_directory(tmp_path):
    import io
    import zipfile

    buffer = io.BytesIO()
    limit, zipfile.ZIP64_LIMIT = zipfile.ZIP64_LIMIT, 100
    try:
        with zipfile.ZipFile(buffer, "w") as z:
            z.writestr("a", b"1" * 300)
            z.writestr("b", b"2" * 50)
    finally:
        zipfile.ZIP64_LIMIT = limit
    (tmp_path / "z").write_bytes(buffer.getvalue())
    from pyarrow import fs

    with fs.LocalFileSystem().open_input_file(str(tmp_path / "z")) as source:
        found = archives.zip_directory(source)
    data = buffer.getvalue()
    assert {n: data[a : a + k] for n, (_, a, k) in found.items()} == {"a": b"1" * 300, "b": b"2" * 50}


def test_jaccard_join(odd, none):
    rows = texts_of(odd)
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
        sets.setdefault(i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(odd).collect()}
    assert {i: n for i, (n, _) in got.items()} == {i: len(s) for i, s in sets.items()}
    assert [got[i][1] for i in (1, 2, None, 3, 4, 5, 7, 8)] == [1, 1, 1, 1, 4, 5, 7, 7]
    assert jaccard_join.near_duplicates(none).count() == 0


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def _components(rows):
    """Brute force: for each (doc_id, text) its set size and the smallest doc_id that links reach."""
    sets = {t: _shingles(t) for _, t in rows}
    distinct = [s for s in dict.fromkeys(sets.values()) if s]
    root = {s: s for s in distinct}

    def top(s):
        while root[s] is not s:
            root[s] = s = root[root[s]]
        return s

    for k, x in enumerate(distinct):
        for y in distinct[:k]:
            if 4 * max(len(x), len(y)) <= 5 * min(len(x), len(y)) and 100 * (n := len(x & y)) >= 80 * (len(x) + len(y) - n):
                root[top(x)] = top(y)
    least = {}
    for i, t in rows:
        if i is not None and sets[t]:
            r = top(sets[t])
            least[r] = min(i, least.get(r, i))
    return Counter((i, len(sets[t]), least.get(top(sets[t])) if sets[t] else i) for i, t in rows)


def test_jaccard_join_of_a_dense_group(spark):
    rng = np.random.default_rng(11)
    line = [f"w{k}" for k in rng.integers(0, 400, 130)]

    def altered(edits):
        words = list(line)
        for k in rng.integers(0, len(words), edits):
            words[k] = f"other{rng.integers(0, 3)}"
        return " ".join(words)

    rows = [(k, altered(int(rng.integers(1, 6)))) for k in range(900)]
    rows += [(None, altered(2)), (None, altered(1)), (7, "seven is the id of two texts here"), (7, altered(1)), (7, altered(1)), (None, None), (None, ""), (901, None)]
    rows += [(None, "texts without any id that are alike in all but the end of it x"), (None, "texts without any id that are alike in all but the end of it")] + [(950, altered(9))] * 3
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == _components(rows)


def test_components_of_a_hub_and_a_chain(spark, monkeypatch):
    from lacuna.llm import components

    monkeypatch.setattr(components, "small", lambda df: df)  # as if there were too many labels to send
    links = [(0, k) for k in range(1, 400)] + [(k, k + 1) for k in range(1000, 1060)] + [(1060, 399)]
    found = components.components(spark.createDataFrame(links, "a long, b long"))
    assert {r.v: r.c for r in found.collect()} == {k: 0 for k in [*range(400), *range(1000, 1061)]}


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        if k < len(pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes and out.count() <= docs.count()
        docs = out
    assert docs.count() > 0


def test_stages_with_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline as pipeline

    line = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    near = line("same", 80)
    rows = [(5, near), (None, near), (9, near.replace("same79", "other")), (9, line("nine", 30)), (9, line("nine", 30)), (None, line("single", 30)), (None, line("lone", 30))]
    rows += [(None, "x " + line("leak", 10)), (7, line("leak", 12)), (7, line("seven", 30)), (8, None), (None, None), (None, ""), (None, line("pair", 40)), (None, line("pair", 40) + " end")]
    docs = spark.createDataFrame([(i, t, "kept") for i, t in rows], "doc_id long, text string, lang string")
    spark.createDataFrame([(1, line("leak", 10))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    clean = pipeline.decontamination(spark, docs, str(tmp_path))
    assert clean.dtypes == docs.dtypes
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter((i, t) for i, t in rows if line("leak", 10) not in (t or ""))

    def shingles(t):
        w = (t or "").split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    distinct, group = sorted(set(rows), key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")), {}
    for x in distinct:
        group[x] = x
    for _ in distinct:
        for x in distinct:
            for y in distinct:
                a, b = shingles(x[1]), shingles(y[1])
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    group[x] = min(group[x], group[y], key=distinct.index)
    got = pipeline.near_duplicate(spark, docs, str(tmp_path))
    assert got.dtypes == docs.dtypes
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    pair = {(None, line("pair", 40)), (None, line("pair", 40) + " end")}  # no ids: either may stay
    assert max(kept.values()) == 1 and len(pair & kept.keys()) == 1
    assert kept.keys() - pair == {x for x in distinct if group[x] == x} - pair


def _odd_tables(spark, path, rows):
    """documents with columns named as the operators name theirs; labels and a benchmark beside them."""
    schema = "doc_id long, source string, lang string, text string, n_chars long, key long, w string, score double, component_id string, tokens long"
    spark.createDataFrame([(i, None, "en", t, None if t is None else len(t), 1, "w", None, "c", 3) for i, t in rows], schema).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 0.5, 1 if "vile" in (t or "") else 0, 1) for i, t in rows] + [(None, None, None, None)]
    spark.createDataFrame(labels if rows else [], "doc_id long, score double, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    leak = " ".join(f"leak{k}" for k in range(10))
    spark.createDataFrame([("b1", leak), ("b2", None), (None, "")] if rows else [], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def _odd_rows():
    word = lambda k: "".join("abcdefghij"[int(c)] for c in str(k))
    clean = [(k, " ".join(f"plain {word(k * 31 + j)} river" for j in range(12))) for k in range(60)]
    vile = [(100 + k, " ".join(f"you vile IDIOT {word(k * 17 + j)}!!" for j in range(12))) for k in range(40)]
    odd = [(200, None), (None, None), (201, ""), (None, " \n\t "), (202, "x" * 200_000), (203, "\u00a0 " * 60_000), (204, " ".join(f"long{word(j)}" for j in range(30_000))), (205, "password = hunter22abc9"), (205, "password = hunter22abc9"), (206, "leaks: " + " ".join(f"leak{k}" for k in range(10))), (None, "日本語 😀 " * 50)]
    return clean + vile + odd


def test_each_stage_over_odd_rows(spark, tmp_path):
    """Nulls in every column, empty, blank and very long texts, repeated rows and clashing names: each stage against its operator's own decision."""
    import corpus_pipeline as pipeline

    rows, sf = _odd_rows(), str(tmp_path)
    docs = _odd_tables(spark, sf, rows)
    left = lambda df: Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    stages = dict(pipeline.STAGES)

    kept = stages["toxicity"](spark, docs, sf)
    assert kept.columns == docs.columns
    scored = toxicity.score_documents(docs.select("doc_id", "text"), toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    toxic = {r.doc_id for r in scored.where("predicted = 1 and doc_id is not null").collect()}
    assert {i for i, t in rows if "vile" in (t or "")} == toxic & set(range(100, 140)) and not toxic & set(range(60))
    assert left(kept) == Counter(x for x in rows if x[0] is None or x[0] not in toxic)

    kept = stages["near_duplicates"](spark, docs, sf)
    assert kept.columns == docs.columns and max(left(kept).values()) == 1 and left(kept).keys() <= set(rows)
    kept = stages["decontamination"](spark, docs, sf)
    assert kept.columns == docs.columns and left(kept) == Counter(x for x in rows if x[0] != 206)

    clean = stages["secrets"](spark, docs, sf)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    got = {r.doc_id: r for r in clean.collect() if r.doc_id is not None}
    assert "hunter22abc9" not in got[205].text and got[200].n_chars is None and got[201].text == ""
    assert all(got[i].text == t for i, t in rows if i is not None and i < 60) and all(r.n_chars == len(r.text) for r in got.values() if r.text is not None)

    packed = stages["packing"](spark, docs, sf)
    per = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r.used == r.end <= 1024 for r in per)
    pieces = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("most")).collect()
    assert {r.doc_id for r in pieces} == {i for i, _ in rows} and all(r.n == r.most for r in pieces if r.doc_id is not None and r.doc_id != 205)


def test_pipeline_over_empty_tables(spark, tmp_path):
    import corpus_pipeline as pipeline

    docs = _odd_tables(spark, str(tmp_path), [])
    out = pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns) and docs.count() == 0
