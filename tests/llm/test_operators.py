"""Operators on a small fixture with nulls, empty and long texts, ties, copies and extra columns, against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from sievework.llm import bpe_codec, fingerprints, fuzzy_lines, graph, html_text, jaccard_join, packing, passages, quality, regions, sharding, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make_texts() -> list:
    rnd = random.Random(4)
    words = ["".join(rnd.choice("aeioulnrstéß") for _ in range(rnd.randint(1, 8))) for _ in range(300)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base = [say(rnd.randint(1, 150)) + "." for _ in range(30)]
    passage = say(60)
    out = [None, "", " \n ", "one two", "ONE two", "a", *base, *base[:6], base[0] + " tail", base[1].replace(" ", "\n", 3), say(3000)]
    out += [say(20) + " " + passage + " " + say(20), passage, "x" * 450, say(10) + "\n" + passage + "\n" + say(12)]
    long_ = say(100).split(" ")
    for i in range(6):
        copy = list(long_)
        copy[i * 7] = "changed"
        out.append(" ".join(copy))
    return out


TEXTS = make_texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 4}", len(t or ""), -1, "s") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n long, slot string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def got(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_sharding(docs, empty):
    rows = got(sharding.shard(docs, shards=5))
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        data = (t or "").encode()
        assert (rows[i]["size"], rows[i]["text_crc32"]) == (len(data) + 16, zlib.crc32(data))
    sizes = [sum(r["size"] for r in rows.values() if r["shard"] == s) for s in range(5)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows.values())
    for s in range(5):
        slots = sorted(r["slot"] for r in rows.values() if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard(empty, shards=5).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, text in enumerate(TEXTS):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["piece"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert packing.pack_documents(empty).count() == 0


def test_patterns_use_every_piece():
    for seed in range(8):
        rng = np.random.default_rng(seed)
        counts = {int(k): int(v) for k, v in zip(*np.unique(rng.integers(1, 101, 400), return_counts=True), strict=True)}
        used: dict = {}
        found = packing.patterns(counts, 100)
        for lengths, m in found:
            assert sum(lengths) <= 100
            for n in lengths:
                used[n] = used.get(n, 0) + m
        assert used == counts
        assert sum(m for _, m in found) <= 1.08 * sum(n * c for n, c in counts.items()) / 100 + 1


def test_quality(docs, empty):
    rows = got(quality.judge(docs))
    for i, t in enumerate(TEXTS):
        words = WORD.findall(t or "")
        seen: dict = {}
        for k in range(len(words) - 7):
            seen.setdefault(tuple(words[k : k + 8]), []).append(k)
        cover = {p for v in seen.values() if len(v) > 1 for k in v for p in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(cover))
        assert r["base_failed"] == (len(words) < 20 or 100 * len(cover) > 30 * len(words))
        assert not (r["base_failed"] and r["kept"])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in rows.items() if r["kept"]}
    assert quality.judge(empty).count() == 0


def test_copies_do_not_reject_each_other(spark):
    rnd = random.Random(40)
    words = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 9))) for _ in range(600)]
    texts = [" ".join(rnd.choice(words) for _ in range(110)) for _ in range(40)]
    kept = lambda rows: {r["doc_id"] for r in quality.judge(spark.createDataFrame([(i, t, "en") for i, t in enumerate(rows)], "doc_id long, text string, lang string")).collect() if r["kept"]}
    alone = kept(texts)
    again = kept([*texts, *[texts[0]] * 9, texts[1].replace("e", "o", 1)])
    assert len(alone) > 35 and {0, 1} <= alone and again >= alone | set(range(40, 50))


def plain_costs(texts: list) -> dict:
    """Cost of each 5-gram of texts of one language, by the definition of modified Kneser-Ney smoothing; equal texts count once."""
    n, held = collections.Counter(), collections.Counter()
    for t in set(texts):
        grams = [t[i : i + 5] for i in range(len(t) - 4)]
        n.update(grams)
        held.update(set(grams))
    level = {g: c for g in n if (c := n[g] * (held[g] - quality.FAMILY) // held[g]) > 0}
    levels = []
    for _ in range(5):
        of = collections.Counter(level.values())
        n1, n2, n3, n4 = (max(1, of[i]) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        off = [min(max(x, 0), i) for i, x in enumerate([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])]
        total, freed = collections.Counter(), collections.Counter()
        for g, c in level.items():
            total[g[:-1]] += c
            freed[g[:-1]] += off[min(c, 3)]
        levels.append((level, off, total, freed))
        level = collections.Counter(g[1:] for g in level)

    def p(g):
        level, off, total, freed = levels[5 - len(g)]
        lower = p(g[1:]) if len(g) > 1 else 1 / (1 + len(level))
        c, context = level.get(g, 0), g[:-1]
        return (c - off[min(c, 3)]) / total[context] + freed[context] / total[context] * lower if total[context] else lower

    return {g: -math.log(max(p(g), 1e-12)) for g in n}


def test_perplexity_against_the_definition(spark, docs):
    some = docs.where("lang is not null")
    found = {(r["lang"], r["gram"]): r["cost"] for r in quality.costs(quality.count_grams(some)).collect()}
    rows = got(quality.judge(some))
    for lang in ("en", "de"):
        ids = [i for i in range(len(TEXTS)) if i % 3 == ("en", "de").index(lang)]
        plain = plain_costs([TEXTS[i] or "" for i in ids])
        assert {g for x, g in found if x == lang} == set(plain)
        assert all(abs(found[lang, g] - c) < 2e-6 for g, c in plain.items())
        mean = {i: sum(plain[t[k : k + 5]] for k in range(len(t) - 4)) / (len(t) - 4) for i in ids if len(t := TEXTS[i] or "") > 4}
        for i in ids:
            assert (rows[i]["perplexity"] is None) == (i not in mean)
            assert i not in mean or abs(math.log(rows[i]["perplexity"]) - mean[i]) < 1e-5
        clean = sorted(mean[i] for i in ids if not rows[i]["base_failed"])
        mid = clean[(len(clean) - 1) // 2]
        spread = max(quality.FLOOR, sorted(abs(x - mid) for x in clean)[(len(clean) - 1) // 2])
        for i in ids:
            wide = quality.WIDTH * spread + quality.SHORT / math.sqrt(max(1, rows[i]["word_chars"]))
            gap = abs(mean[i] - mid) - wide if i in mean else -1
            if abs(gap) > 1e-4:
                assert rows[i]["kept"] == (not rows[i]["base_failed"] and gap <= 0)


def test_html():
    page = "<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><div class='ad'>Buy this now today.</div><article><h1>Title &amp; more</h1><p>First <b>paragraph</b> of\n the text.<br><p>Second one here, long enough.</article><footer>&copy; us</footer>"
    tree = html_text.trained()[0]
    assert html_text.extract(page, tree) == "Title & more\n\nFirst paragraph of the text.\n\nSecond one here, long enough."
    assert html_text.extract("", tree) == ""
    x, y = html_text.labelled_table(html_text.labelled_pages(60, 99))
    assert ((html_text.predict(tree, x) >= 0.5) == (y > 0.5)).mean() > 0.97


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", None, 3), (2, None, "<p>x", 4), (2, None, "<p>x", 4)], "page_id long, url string, html string, text int")
    rows = html_text.main_texts(pages, html_text.trained()[0]).collect()
    assert len(rows) == 3 and {r["n_chars"] == len(r["text"]) for r in rows} == {True}


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = got(bpe_codec.encode(docs, path))
    for i, text in enumerate(TEXTS):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert (rows[i]["n_tokens"], rows[i]["ids"], rows[i]["decoded"]) == (len(ids), " ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False))
    rnd = random.Random(1)
    pool = "aàAΣσİıǅﬁé́ \t\n\x1c\x85\xa0　'sSt12٣²_!?<|>日한😀ẞß"
    odd = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40))) for _ in range(2000)] + ["x<|endoftext|>y <|startoftext|>", "aaaa" * 99, "ΟΔΟΣ"]
    for text, (n, ids, decoded) in zip(odd, bpe_codec.Codec(path).encode_batch(odd), strict=True):
        want = t.encode(text, add_special_tokens=False).ids
        assert (n, ids.decode(), decoded) == (len(want), " ".join(map(str, want)), t.decode(want, skip_special_tokens=False))
    assert bpe_codec.encode(empty, path).count() == 0


def test_fuzzy_lines(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("aeiourst") for _ in range(6)) for _ in range(200)]
    line = " ".join(rnd.choice(words) for _ in range(40))
    texts = [line + "\nalpha beta", "Alpha, beta 12!\n\n" + line + ".", "--\nother words here", None, "", line.replace(line[:6], line[:5] + "x", 1)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    rows = got(fuzzy_lines._without(df))
    assert rows[0]["text"] == texts[0] and rows[1]["text"] == "" and rows[2]["text"] == texts[2] and rows[3]["text"] is None and rows[5]["text"] == ""
    assert rows[1]["__n_removed"] == 2
    assert fuzzy_lines._without(df.limit(0)).count() == 0


def test_fingerprints(docs, empty):
    rows = got(fingerprints.edited_fingerprints(docs, part_bytes=2000))
    texts = [t or "" for t in TEXTS]
    for i, t in enumerate(texts):
        half = len(t) // 2
        edited = t[: len(t) - half] + texts[(i + 1) % len(texts)][:half]
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[i]["fingerprint"] == fingerprints.fingerprint(t) and 0 <= rows[i]["near_edited"] <= 1
    a = texts[8]
    assert fingerprints.likeness(fingerprints.fingerprint(a), fingerprints.fingerprint(a)) == 1.0
    b = a[:20] + "#" + a[20:]
    (start, end), *_ = fingerprints.diff(fingerprints.fingerprint(a), fingerprints.fingerprint(b))
    assert start <= 20 <= end
    assert fingerprints.edited_fingerprints(empty).count() == 0


def sets():
    out = []
    for t in TEXTS:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set())
    return out


def near_copies(n=60):
    """Copies of one text with up to a sixth of its shingles changed: many link only through others, many not at all."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("aeioulnrst") for _ in range(7))
    base = [word() for _ in range(160)]
    out = []
    for i in range(n):
        copy = list(base)
        for j in rnd.sample(range(160), i % 8):
            copy[j] = word()
        out.append(" ".join(copy))
    return out


def linked_sets(texts, k, percent):
    found = []
    for t in texts:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        found.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))
    for i, x in enumerate(found):
        for j, y in enumerate(found[:i]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return found, root


@pytest.mark.parametrize("block", [4, 512])
def test_jaccard_join(spark, empty, block, monkeypatch):
    monkeypatch.setattr(regions, "BLOCK", block)
    texts = [*TEXTS, *near_copies()]
    s, root = linked_sets(texts, 4, 85)
    rows = got(jaccard_join.join(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)))
    assert [(rows[i]["n_shingles"], rows[i]["component_id"]) for i in range(len(s))] == [(len(s[i]), root[i]) for i in range(len(s))]
    assert len(set(root[len(TEXTS) :])) > 5
    assert jaccard_join.join(empty).count() == 0


def test_keep_one_of_rows_that_share_an_id(spark):
    rows = [(5, "one two three four five six", 1), (5, "seven eight nine ten eleven twelve", 2), (7, "one two three four five six", 3), (5, "one two three four five six", 4), (None, "x", 5), (9, "", 6), (9, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, first int").withColumns({"tie": F.lit("mine"), "node": F.lit(1)})
    kept = jaccard_join.keep_one(df, 5, 80)
    assert kept.columns == df.columns
    found = kept.collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in found) == [(0, "x"), (5, rows[0][1]), (5, rows[1][1]), (9, ""), (9, "")]
    assert {r["tie"] for r in found} == {"mine"}


def test_components(spark):
    rnd = random.Random(2)
    links = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(45)]
    root = list(range(61))
    for a, b in links:
        low, high = sorted((root[a], root[b]))
        root = [low if r == high else r for r in root]
    rows = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in rows} == {i: r for i, r in enumerate(root) if r != i}


def test_toxicity(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("aeiourst") for _ in range(5)) for _ in range(100)]
    rows = []
    for i in range(300):
        w = [rnd.choice(words) for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            w[rnd.randrange(30)] = "dumbfool"
        rows.append((i, " ".join(w), int(bad)))
    df = spark.createDataFrame([*rows, (1000, None, None), (1001, "", None)], "doc_id long, text string, label int")
    model = toxicity.fit(df.select("doc_id", "text"), df.where("doc_id < 200").select("doc_id", "label"))
    out = got(toxicity.score(df.select("doc_id", "text"), model))
    assert all((out[i]["score"] >= 0.5) == bool(y) for i, _, y in rows[200:])
    assert out[1000]["score"] == out[1001]["score"] < 0.5
    assert toxicity.fit(df.limit(0).select("doc_id", "text"), df.limit(0).select("doc_id", "label")).features.size == 0


@pytest.mark.parametrize("hot", [1, 20_000])
def test_passages(docs, empty, hot):
    data = [(t or "").encode() for t in TEXTS]
    count: dict = {}
    for d in data:
        for k in range(len(d) - 199):
            count[d[k : k + 200]] = count.get(d[k : k + 200], 0) + 1
    rows = got(passages.digests(docs, hot))
    for i, d in enumerate(data):
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - 199):
            if count[d[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        assert (rows[i]["n_bytes"], rows[i]["n_removed"], rows[i]["n_spans"], rows[i]["kept_sha256"]) == (len(d), gone.sum(), spans, hashlib.sha256(kept).hexdigest())
    assert passages.digests(empty).count() == 0


def test_interval_expansion():
    rnd = random.Random(5)
    for least, letters in ((6, "ab"), (20, "abc")):
        for _ in range(20):
            base = "".join(rnd.choice(letters) for _ in range(3 * least))
            contexts = [("".join(rnd.choice(letters) for _ in range(rnd.randint(0, least))) + base[(a := rnd.randint(0, 2 * least)) : a + rnd.randint(least, 2 * least)]).encode() for _ in range(rnd.randint(1, 9))]
            count: dict = {}
            for c in contexts:
                for k in range(len(c) - least + 1):
                    count[c[k : k + least]] = count.get(c[k : k + least], 0) + 1
            want = [k + least <= len(c) and count[c[k : k + least]] > 1 for c in contexts for k in range(len(c))]
            assert passages.repeated(contexts, least).tolist() == want


def edits(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def edited(rnd, line, n):
    """The line after n edits that leave it normalised."""
    out = list(line)
    for _ in range(n):
        i, kind = rnd.randrange(1, len(out) - 1), rnd.randrange(3)
        if " " in out[i - 1 : i + 2]:
            continue
        out[i : i + 1] = [out[i], rnd.choice("aeioursté")] if kind == 0 else [rnd.choice("aeioursté")] if kind == 1 else []
    return "".join(out)


def fuzzy_pairs(n=400):
    """Lines of 10 characters and more, and edited versions of them that are similar."""
    rnd = random.Random(12)
    for _ in range(n):
        line = " ".join("".join(rnd.choice("aeiourstlndé") for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(3, 60)))
        other = edited(rnd, line, rnd.randint(1, max(1, len(line) // 10)))
        most = max(len(line), len(other)) // 10
        if line != other and edits(line, other) <= most:
            yield line, other


def line_keys(*texts):
    data = np.frombuffer("\n".join(texts).encode(), np.uint8)
    h = fuzzy_lines.hashed(data, np.array([0, len(data)]))
    assert len(h["id"]) == len(texts) and h["chars"].tolist() == [len(t) for t in texts]
    owner, key = fuzzy_lines.keys(h["blocks"], h["counts"], h["chars"], list(texts), h["rest"])
    return [set(key[owner == i].tolist()) for i in range(len(texts))]


def test_fuzzy_keys_meet():
    """Short lines always meet, and others with up to two changed words; with more changes recall falls (README)."""
    short, few, more = 0, [], []
    for line, other in fuzzy_pairs():
        x, y = line_keys(line, other)
        if max(len(line), len(other)) < fuzzy_lines.SHORT:
            short += 1
            assert x & y, (line, other)
        else:
            (few if edits(line, other) <= 2 else more).append(bool(x & y))
    assert short > 5 and len(few) > 20 and np.mean(few) >= 0.98 and np.mean(more) > 0.25
    x, y = (list(t) for t in zip(*fuzzy_pairs(100), strict=True))
    n, m = (np.array([len(t) for t in ts]) for ts in (x, y))
    assert fuzzy_lines.near(fuzzy_lines.signature(x).astype(np.int16), n, fuzzy_lines.signature(y).astype(np.int16), m).diagonal().all()


@pytest.mark.parametrize("words", [5, 8, 13, 25, 50])
def test_fuzzy_lines_with_one_changed_letter_meet(words):
    rnd = random.Random(words)
    met = []
    for _ in range(200):
        line = [("".join(rnd.choice("aeiourstlndm") for _ in range(rnd.randint(3, 9)))) for _ in range(words)]
        i = rnd.randrange(words)
        other = [*line[:i], "x" + line[i][1:], *line[i + 1 :]]
        x, y = line_keys(" ".join(line), " ".join(other))
        met.append(bool(x & y))
    assert np.mean(met) >= 0.99


def test_edits_by_diagonals():
    rnd = random.Random(31)
    for _ in range(150):
        x = "".join(rnd.choice("abé") for _ in range(rnd.randint(0, 30)))
        y = edited(rnd, x, rnd.randint(0, 8)) if len(x) > 3 else "".join(rnd.choice("ab") for _ in range(4))
        d = edits(x, y)
        assert [fuzzy_lines.within(x, y, most) for most in range(d + 2)] == [most >= d for most in range(d + 2)]
        a, b = fuzzy_lines.trimmed(x, y)
        assert edits(a, b) == d
    long_ = "".join(rnd.choice("abcdefgh ") for _ in range(200_000))
    assert fuzzy_lines.within(long_, long_[:70_000] + "x" + long_[70_001:150_000] + long_[150_003:], 20)


@pytest.mark.parametrize("block", [3, 512])
def test_fuzzy_lines_of_few_and_many_words(spark, block, monkeypatch):
    monkeypatch.setattr(regions, "BLOCK", block)
    pairs = [p for p in fuzzy_pairs(60) if max(map(len, p)) < 30 or edits(*p) <= 2]
    texts = [t for p in pairs for t in p]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            m = max(len(texts[i]), len(texts[j]))
            if abs(len(texts[i]) - len(texts[j])) <= m // 10 and edits(texts[i], texts[j]) <= m // 10:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert len(pairs) > 15
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = got(fuzzy_lines._without(df))
    assert [rows[i]["text"] for i in range(len(texts))] == [t if root[i] == i else "" for i, t in enumerate(texts)]


def test_fuzzy_lines_of_rows_that_share_an_id(spark):
    texts = [(1, "same line of several words here\nfirst tail"), (2, "own line that nobody else has\nsame line of several words here"), (2, "keep me unique\nthis is unique too delta"), (None, "a line under no id at all"), (2, None)]
    df = spark.createDataFrame([(i, t, 7, "x", "y") for i, t in texts], "doc_id long, text string, n_removed int, gone string, tie string")
    out = fuzzy_lines.remove(df)
    assert out.columns == df.columns
    found = sorted(((r["doc_id"] or 0, r["text"] or "") for r in out.collect()))
    assert found == sorted([(1, texts[0][1]), (2, "own line that nobody else has"), (2, texts[2][1]), (0, texts[3][1]), (2, "")])
    assert {(r["n_removed"], r["gone"], r["tie"]) for r in out.collect()} == {(7, "x", "y")}


def test_near_duplicates_of_the_pipeline(spark):
    import corpus_pipeline

    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("aeiourst") for _ in range(8))
    base = [word() for _ in range(1000)]
    tail = [word() for _ in range(300)]
    texts = [" ".join(base), " ".join(base + tail[:200]), " ".join(base + tail), "one two", "one two", None]
    rows = [*enumerate(texts), (None, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # 996 of 1196 shingles of five words are shared (0.83), 1196 of 1296 (0.92), 996 of 1296 (0.77)
    kept = corpus_pipeline.near_duplicates(spark, df, "").collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [0, 3, 5] and len(kept) == 4
    two = df.where("doc_id < 2")
    assert [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, two, "").collect()] == [0]
    assert len({r["component_id"] for r in jaccard_join.join(two).collect()}) == 2


@pytest.mark.parametrize("most", [0, 40])
def test_quality_beyond_the_broadcast_is_the_same(spark, docs, monkeypatch, most):
    short = [(900, None, None), (901, "", "xx"), (902, "abc", "yy"), (903, None, "xx")]
    some = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(short, "doc_id long, text string, lang string"))
    whole = got(quality.judge(some))
    monkeypatch.setattr(quality, "TURN", most)
    found = quality.model(some)
    assert found.rare is not None and (most == 0) == (len(found.keys) == 0) and len(found.keys) <= most
    again = got(quality.judge(some))
    assert len(again) == len(whole) == some.count()
    for i, r in whole.items():
        assert {**r.asDict(), "perplexity": 0} == {**again[i].asDict(), "perplexity": 0}
        assert again[i]["perplexity"] == pytest.approx(r["perplexity"], rel=1e-4) if r["perplexity"] else again[i]["perplexity"] is None
    assert all(whole[i]["base_failed"] and not whole[i]["kept"] for i in range(900, 904))
    assert {r["doc_id"] for r in quality.keep_good(some).collect()} == {i for i, r in again.items() if r["kept"]}


@pytest.mark.parametrize("before", ["", "<button>Share", "<select><option>One<option>Two", "<svg><path d=x>", "<svg/>", "<object data=x>", "<math><mi>x", "<canvas>none", "<button>Share</button>", "<svg><svg></svg></svg>"])
def test_html_without_end_tags(before):
    tree = html_text.trained()[0]
    page = "<html><head id='header'><meta charset=utf-8><title>T</title><style>p {}</style><body><nav><a href=/>Home</a></nav><article><h1>Title of it</h1>" + before + "<p>First paragraph of the text.<p>Second one here, long enough.</article><footer><button><div>Top</div></button>&copy; us</footer>"
    assert html_text.extract(page, tree) == "Title of it\n\nFirst paragraph of the text.\n\nSecond one here, long enough."
    assert html_text.extract(page.replace("<body>", ""), tree) == html_text.extract(page, tree)
    assert html_text.extract("<article><p>Some text that stays here.<script>var x = '<p>no</p>'", tree) == "Some text that stays here."


def test_pipeline_keeps_clashing_columns_and_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(77)
    words = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 9))) for _ in range(600)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    texts = [say(60) + "\n" + say(50) for _ in range(40)]
    passage = say(70)
    texts += [texts[0], texts[1].replace("e", "o", 1), say(40) + " " + passage + " " + say(40), say(45) + " " + passage + " " + say(30), "too short", "", None]
    mine = {"n_words": 777, "cost": 0.5, "n_removed": 5, "gone": "x", "found": "y", "tie": 3, "node": 4, "base_failed": True}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({k: F.lit(v) for k, v in mine.items()})
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        path = str(tmp_path / f"{n}-{name}")
        stage(spark, docs, "").write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == docs.columns, name
        assert {tuple(r[k] for k in mine) for r in after.collect()} == {tuple(mine.values())}, name
        docs = after
    left = got(docs)
    # of the copy and the near copy nothing is left, clean documents stand as they were, the passage goes from both
    assert 40 not in left and 41 not in left and not {44, 45, 46} & set(left)
    assert {0, 1} <= set(left)
    assert all(left[i]["text"] == texts[i] for i in range(40) if i in left) and len(left) > 35
    assert all(passage[20:-20] not in left[i]["text"] for i in (42, 43) if i in left)
    docs.limit(0).write.parquet(str(tmp_path / "none"))
    none = spark.read.parquet(str(tmp_path / "none"))
    assert all(stage(spark, none, "").count() == 0 for _, stage in corpus_pipeline.STAGES)
    (tmp_path / "sf").mkdir()
    docs.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "sf")).count() >= len(left)


def test_release_leaves_tables_of_others(spark):
    from sievework.llm.common import dropped, owned, release, written

    rows = spark.range(5)
    free = written(rows, "free")
    with owned("a"):
        mine = written(rows, "mine")
        with owned("b"):
            other = written(rows, "other")
        again = written(rows, "again")
    release(spark, "a")
    assert free.count() == other.count() == 5
    for gone in (mine, again):
        with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
            gone.count()
    dropped(other, mine)
    release(spark, "b")
    assert free.count() == 5


def test_quality_holds_few_bytes_as_strings_and_sends_the_model_once(docs, monkeypatch):
    import pyarrow as pa

    texts = ["a" * 150_000, "\u00e9" * 150_000, None, "b", "", "c" * 900_000, "d"]
    batch = pa.RecordBatch.from_pydict({"text": texts, "lang": ["x", None, "y", "z", "x", "x", "x"]})
    parts = list(quality._parts(iter([batch])))
    assert [t for _, part, _ in parts for t in part] == [t or "" for t in texts] and [x for _, _, langs in parts for x in langs] == ["x", "", "y", "z", "x", "x", "x"]
    assert all(len(part) == 1 or sum(len(t.encode()) for t in part) <= quality.BATCH <= 400_000 for _, part, _ in parts)
    calls, send = [], quality.sent
    monkeypatch.setattr(quality, "sent", lambda *a: calls.append(1) or send(*a))
    quality.keep_good(docs.limit(200)).count()
    assert len(calls) == 1


def test_fuzzy_keys_that_agree_in_their_leading_bits_only_are_no_region(spark):
    from sievework.llm.regions import once

    classes = fuzzy_lines.lines(spark.createDataFrame([(1, "one two three four five six seven eight nine"), (2, "one two three four five six seven eight ten")], "doc_id long, text string")).select("id", "chars", "blocks", "counts", "short", "rest")
    every = fuzzy_lines._members(classes)
    leading = every.selectExpr(f"shiftright(region, {fuzzy_lines.SPARE}) AS leading").distinct()
    assert sorted(map(tuple, fuzzy_lines._members(classes, leading).collect())) == sorted(map(tuple, every.collect()))
    several = every.groupBy("region").count().where("count > 1")
    assert once(every).count() == once(every.join(several, "region").drop("count")).count()
