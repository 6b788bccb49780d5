"""Operators 11 to 13 against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import divergence, super_kmers, vector_codes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, anchor string, term string, start int, p double"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, la, s, len(t or ""), "a", "t", 7, 0.5) for i, t, la, s in rows], COLUMNS).repartition(parts)


# ---------------------------------------------------------------- operator 11


def audit_rows():
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abÀßx") for _ in range(rnd.randint(1, 5))) for _ in range(60)]
    rows = []
    for i in range(240):
        lang, source = rnd.choice(["en", "de", None, "xx"]), rnd.choice(["s0", "s0", "s0", "s1", "S1", None, f"r{i % 9}"])
        if lang == "xx":  # a language in which no term is in ten documents
            rows.append((i, f"only{chr(97 + i % 26)}{chr(97 + i % 7)}", lang, source))
        else:
            shift = 20 * (source == "s1")
            rows.append((i, "".join(rnd.choice(words[shift : shift + 40]).title() + rnd.choice([" ", "1", ".\n", "-"]) for _ in range(rnd.randint(0, 40))), lang, source))
    rows += [(900, None, "en", "empty"), (901, "", "de", "empty"), (902, "12 3 !", "fr", "s0"), (903, "x", "fr", "s1"), (7, rows[7][1], rows[7][2], rows[7][3])]
    return [*rows, (None, "À" * 300 + " " + "ab " * 4000, "en", "s0")]


def audit_by_force(rows, least=10, k=10):
    counts, docs, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        per = {s: [counts[la, s][t] for t in kept] for la, s in groups if la == lang}
        whole = [sum(c) for c in zip(*per.values(), strict=True)] if kept else []
        p = lambda c: [1 + 10**9 * (x + 2) // (sum(c) + 2 * len(kept)) for x in c]  # noqa: E731, B023
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in per.items():
            pairs = sorted((-sum(map(f, p(c), p(o))), x.encode(), x) for x, o in per.items() if x != s)
            terms = sorted((-f(a, b), t.encode(), t) for t, n, a, b in zip(kept, c, p(c), p(whole), strict=True) if n and a > b)[:k]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, -v, i) for i, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "chunk"), [(48, 50_000), (2, 20)])
def test_audit(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(divergence.pair_values, "__defaults__", (block, chunk))
    rows = audit_rows()
    assert sorted(map(tuple, divergence.audit(frame(spark, rows)).collect())) == audit_by_force(rows)


def test_audit_of_nothing(spark):
    assert divergence.audit(frame(spark, [(1, "a", "en", "s")]).limit(0)).count() == 0
    assert divergence.audit(frame(spark, [(1, None, None, None)])).count() == 0


def test_audit_terms_of_many_rounds(spark):
    # each group has terms of hundreds of counts, so the search ends with buckets unseen and none of them may matter
    rnd = random.Random(3)
    rows = []
    for d in range(60):
        words = []
        for w in range(90):
            words += [f"t{chr(97 + w // 26)}{chr(97 + w % 26)}"] * max(1, int(rnd.paretovariate(0.7)) % 400 * (1 + (w % 5 == d % 4)))
        rows.append((d, " ".join(words), "en", f"s{d % 4}"))
    got = {tuple(r) for r in divergence.audit(frame(spark, rows)).collect()}
    assert got == set(audit_by_force(rows))


def test_terms_of_long_texts(monkeypatch):
    text = "Aé b" * 500 + " " + "c" * 900 + " dd" * 300
    want = divergence.terms_of(text)
    assert want == collections.Counter(x.encode() for x in TERM.findall(text.translate(LOWER)))
    monkeypatch.setattr(divergence, "PIECE", 64)
    assert divergence.terms_of(text) == want


# ---------------------------------------------------------------- operator 12


def passage_rows():
    rnd = random.Random(12)
    words = ["".join(rnd.choice("aeioulnrsté") for _ in range(rnd.randint(1, 8))) for _ in range(400)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage, other = say(70), say(50)
    texts = [say(rnd.randint(1, 200)) for _ in range(25)]
    texts += [texts[3], texts[5].replace(" ", "\n\t "), texts[7] + " tail", None, "", " \n ", "one"]
    texts += [say(i * 7) + " " + passage + " " + say(30) for i in range(12)]
    texts += [other, other + " x", "x " + other, say(30) + " " + other + " " + passage, passage.replace(" ", "  ", 9), other[:-1]]
    texts += ["a " * 120, "a " * 49, "a " * 50, "b a " * 60, "a b " * 55 + " c"]
    rows = [(i * 3 % 101, t, "en", "s") for i, t in enumerate(texts)]
    rows += [(5, say(60), "en", "s"), (5, passage + " again", "en", "s"), (None, passage, "en", "s"), rows[26], rows[26]]
    return rows


def passages_by_force(rows, window=50):
    least = {}
    split = [(-(2**63) if i is None else i, WORD.findall(t or "")) for i, t, *_ in rows]
    for i, w in split:
        for a in range(len(w) - window + 1):
            key = tuple(w[a : a + window])
            least[key] = min(i, least.get(key, i))
    out = []
    for (i, w), row in zip(split, rows, strict=True):
        gone = np.zeros(len(w), bool)
        for a in range(len(w) - window + 1):
            if least[tuple(w[a : a + window])] < i:
                gone[a : a + window] = True
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((row[0], len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [2000, 3, 1])
def test_super_kmers(spark, hot):
    rows = passage_rows()
    got = sorted(map(tuple, super_kmers.digests(frame(spark, rows), hot).collect()), key=str)
    want = passages_by_force(rows)
    assert got == want and sum(r[2] for r in want) > 1000


def test_super_kmers_of_long_texts(spark, monkeypatch):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdef") for _ in range(6)) for _ in range(500)]
    text = " ".join(rnd.choice(words) for _ in range(4000))
    data = np.frombuffer(text.encode(), np.uint8)
    monkeypatch.setattr(super_kmers, "SEGMENT", 900)
    windows = []
    for piece, before in super_kmers._pieces(None, data, np.array([0, len(data)])):
        r = super_kmers.super_kmers(piece, 8)
        windows += [(before + a + i, piece.packed(a + i, 1)) for a, n in zip(r["first"], r["windows"], strict=True) for i in range(n)]
    split = text.split(" ")
    assert windows == [(i, " ".join(split[i : i + 50]).encode()) for i in range(len(split) - 49)]
    n, gone, digest = super_kmers._digest(text, [{"start": 10, "end": 3000}, {"start": 2900, "end": 3100}])
    assert (n, gone) == (4000, 3090) and digest == hashlib.sha256(" ".join(split[:10] + split[3100:]).encode()).hexdigest()
    assert [len(list(super_kmers._pieces(None, np.full(5000, 97, np.uint8), np.array([0, 5000]))))] == [1]


def test_super_kmers_of_nothing_and_whole_columns(spark):
    docs = frame(spark, passage_rows())
    assert super_kmers.digests(docs.limit(0)).count() == 0
    assert super_kmers.remove(docs.limit(0)).count() == 0
    left = super_kmers.remove(docs)
    assert left.columns == docs.columns and left.count() == docs.count()
    again = super_kmers.spans(left.where("doc_id <> 5"))
    assert left.where("anchor = 'a' and term = 't' and start = 7").count() == docs.count()
    assert again.count() == 0


# ---------------------------------------------------------------- operator 13


def vector_rows(n=700, dims=8):
    rnd = np.random.default_rng(13)
    rows = [(int(i), [float(x) for x in np.round(rnd.normal(size=dims), 2)], int(i % 5) if i % 7 else None) for i in rnd.permutation(n)]
    rows += [(n + i, rows[0][1], 1) for i in range(200)]  # many copies, so entries tie
    rows += [(9001, None, 1), (9002, [1.0] * (dims - 1) + [None], 1), (9003, [float("nan")] * dims, 2), (9004, [float("-inf")] + [0.0] * (dims - 1), 2), (3, [0.25] * dims, 3), (3, [0.25] * dims, 3), (None, [0.5] * dims, 4)]
    return rows


def codes_by_force(rows, entries=256):
    kept = [(i, [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v], la) for i, v, la in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([r[1] for r in kept], np.int64).reshape(len(kept), 4, -1)
    books = [x[:entries, p].copy() for p in range(4)]
    near = lambda p: ((x[:, p, None] - books[p][None]) ** 2).sum(-1)
    for _ in range(4):
        for p in range(4):
            at = near(p).argmin(1)
            for e in set(at.tolist()):
                books[p][e] = [int(s) // int((at == e).sum()) for s in x[at == e, p].sum(0)]
    d = [near(p) for p in range(4)]
    code = ["".join(f"{d[p][i].argmin():02x}" for p in range(4)) for i in range(len(kept))]
    error = sum(dp.min(1) for dp in d)
    labels = collections.Counter()
    for (_, _, la), e in zip(kept, error, strict=True):
        labels[la] += int(e)
    sha = hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()
    return sorted(((r[0], c, int(e), labels[r[2]], sha) for r, c, e in zip(kept, code, error, strict=True)), key=str)


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("n", [700, 40])
def test_vector_codes(spark, n):
    rows = vector_rows(n) if n > 100 else vector_rows(n)[:n]
    docs = spark.createDataFrame(rows, VECTORS).withColumns({"v": F.lit("x"), "code": F.lit(1), "error": F.lit(2)}).repartition(5)
    assert sorted(map(tuple, vector_codes.compress(docs).collect()), key=str) == codes_by_force(rows)


def test_vector_codes_of_nothing_and_of_bad_vectors(spark):
    assert vector_codes.compress(spark.createDataFrame([], VECTORS)).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1)], VECTORS)).count() == 0
    for vectors in ([[1.0] * 6], [[1.0] * 8, [1.0] * 4], [[1e30] * 8]):
        with pytest.raises(Exception, match="multiple|length|in size"):
            vector_codes.compress(spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], VECTORS)).count()


def test_bounds_lose_no_nearest_entry():
    rnd = np.random.default_rng(1)
    for scale in (1, 50, 2**25):
        x = rnd.integers(-scale, scale, (500, 16))
        book = np.concatenate([rnd.integers(-scale, scale, (200, 16)), x[:40], x[:16]])
        d = ((x[:, None].astype(object) - book[None].astype(object)) ** 2).sum(-1) if scale > 50 else ((x[:, None] - book[None]) ** 2).sum(-1)
        entry, least = vector_codes.nearest(x, book)
        assert (entry == d.argmin(1)).all() and (least == d.min(1)).all()
