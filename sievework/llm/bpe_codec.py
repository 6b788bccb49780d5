"""Operator 5: BPE encoding and decoding with batched numpy merge rounds.

A worker keeps what each white-space delimited chunk encodes to; the words that a batch brings anew are
merged together: their symbols lie in one flat array, a binary search over the sorted pair keys finds every
neighbouring pair's rank, and in each round the lowest-ranked pairs of every word are merged at once.

Nulls and empty texts have no ids and decode to the empty string. Texts are encoded whole, special tokens
in them as the library does. An empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from sievework.llm.common import table, texts_of

#: Entries that a worker's tables keep; what is beyond them is computed anew.
KEPT = 300_000
NONE = np.int64(2**62)
#: White space to str.split() but not to the pattern's \\s.
SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Codec:
    """Encoder and decoder of a byte-level BPE file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.added = added
        self.tokens = [""] * (max([*self.vocab.values(), *added.values()]) + 1)
        for token, i in [*self.vocab.items(), *added.items()]:
            self.tokens[i] = token
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern).findall
        symbols = byte_symbols()
        self.first = np.array([self.vocab[s] for s in symbols], np.int64)
        self.last = np.array([self.vocab[s + self.end] for s in symbols], np.int64)
        self.size = len(self.tokens)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([self.vocab[a] * self.size + self.vocab[b] for a, b in pairs], np.int64)
        made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.decimals = [b"%d " % i for i in range(self.size)]
        self.spaced = [t + " " for t in self.tokens]
        self.of_word: dict[str, tuple[bytes, str]] = {}
        self.of_chunk: dict[str, tuple[bytes, str]] = {}

    def merge(self, words: list[str]) -> tuple[list[int], np.ndarray]:
        """Ids of all words, one after the other, and how many each has; merged round by round in one flat array."""
        if not words:
            return [], np.zeros(0, np.int64)
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(x) for x in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        word = np.repeat(np.arange(len(raw)), sizes)
        ids = self.first[data]
        tail = np.cumsum(sizes) - 1
        ids[tail] = self.last[data[tail]]
        done_ids, done_word = [], []
        while len(ids):
            key = ids[:-1] * self.size + ids[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.rank[at], NONE)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(np.r_[rank, NONE], starts)
            lengths = np.diff(np.r_[starts, len(word)])
            ended = np.repeat(best == NONE, lengths)
            hit = np.r_[rank == np.repeat(best, lengths)[:-1], False] & ~ended
            # of touching hits (the same pair over a run of one symbol) every second one is taken, from the left
            where = np.flatnonzero(hit)
            if len(where):
                run = np.cumsum(np.r_[True, np.diff(where) > 1])
                nth = np.arange(len(where)) - np.r_[0, np.flatnonzero(np.diff(run)) + 1][run - 1]
                where = where[nth % 2 == 0]
                ids[where] = self.made[at[where]]
                keep = np.ones(len(ids), bool)
                keep[where + 1] = False
            else:
                keep = np.ones(len(ids), bool)
            done_ids.append(ids[ended])
            done_word.append(word[ended])
            keep &= ~ended
            ids, word = ids[keep], word[keep]
        flat, owner = np.concatenate(done_ids), np.concatenate(done_word)
        return flat[np.argsort(owner, kind="stable")].tolist(), np.bincount(owner, minlength=len(raw))

    def split(self, chunk: str) -> list[str]:
        """The words of a stretch of text without special tokens."""
        if chunk.isascii():
            return self.words(chunk.lower())
        chunk = unicodedata.normalize("NFC", chunk)
        return self.words("".join(map(str.lower, chunk)) if "Σ" in chunk else chunk.lower())

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))

    def chunks(self, text: str) -> list[str]:
        if SEPARATORS.search(text):
            return regex.split(r"\s+", text)
        return text.split()

    def learn(self, chunks: list[str]) -> dict[str, tuple[bytes, str]]:
        """Decimal ids and decoded text of each chunk, both ending in a space if there are any."""
        words = self.of_word
        parts = list(map(self.split, chunks))
        new = list({w for p in parts for w in p if w not in words})
        flat, sizes = self.merge(new)
        decimals, tokens = self.decimals, self.spaced
        found, start = {}, 0
        for w, end in zip(new, np.cumsum(sizes).tolist(), strict=True):
            ids = flat[start:end]
            found[w] = (b"".join([decimals[i] for i in ids]), "".join([tokens[i] for i in ids]))
            start = end
        if len(words) < KEPT:
            words.update(found)
            found = words
        else:
            found = _Either(found, words)
        return dict(zip(chunks, [found[p[0]] if len(p) == 1 else (b"".join([found[w][0] for w in p]), "".join([found[w][1] for w in p])) for p in parts], strict=True))

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[int, bytes, str]]:
        """For each text: how many ids, the ids as decimals joined by a space, and the decoded text."""
        known = self.of_chunk
        split, new = [], set()
        for text in texts:
            if self.special is not None and "<|" in text:
                # a special token stands between None and its text
                parts = []
                for i, piece in enumerate(self.special.split(text)):
                    parts += [None, piece] if i % 2 else self.chunks(piece)
                new.update(p for p in parts if p is not None)
            else:
                parts = self.chunks(text)
                new.update(parts)
            split.append(parts)
        fresh = self.learn([c for c in new if c not in known])
        if len(known) < KEPT:
            known.update(fresh)
            fresh = known
        else:
            fresh = _Either(fresh, known)
        for parts in split:
            if None in parts:
                found, special = [], False
                for p in parts:
                    if special or p is None:
                        if special:
                            found.append((self.decimals[self.added[p]], self.spaced[self.added[p]]))
                        special = not special
                    else:
                        found.append(fresh[p])
            else:
                found = [fresh[p] for p in parts]
            ids = b"".join([x[0] for x in found])
            yield ids.count(b" "), ids[:-1], "".join([x[1] for x in found])[:-1]


class _Either(dict):
    def __init__(self, own: dict, other: dict):
        super().__init__(own)
        self.other = other

    def __missing__(self, key: str) -> tuple[bytes, str]:
        return self.other[key]


def encode(docs: DataFrame, path: str, column: str = "text", keys: tuple[str, ...] = ("doc_id",), texts: bool = True) -> DataFrame:
    """`keys`, n_tokens, ids (decimals joined by a space) and decoded text; digests in their stead if not `texts`."""
    schema = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)
    kinds = [pa.int64(), *[pa.string()] * 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or Codec(path)
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                found = []
                for n, ids, decoded in codec.encode_batch(texts_of(part, column)):
                    found.append((n, ids.decode(), decoded) if texts else (n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()))
                made = [pa.array([x[i] for x in found], kinds[i]) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(k)) for k in keys], *made], [*keys, "n_tokens", "a", "b"])

    names = ("ids", "decoded") if texts else ("ids_sha256", "decoded_sha256")
    out = docs.select(*keys, column).mapInArrow(run, f"{schema}, n_tokens long, a string, b string")
    return out.withColumnsRenamed(dict(zip("ab", names, strict=True)))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), texts=False)


QUERIES = {"op5_bpe_codec": op5}
