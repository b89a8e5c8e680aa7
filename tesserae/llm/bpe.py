"""Byte-level BPE encoding and decoding by batched merge rounds in numpy.

The symbols of many distinct words lie in one flat array. In each round the lowest-ranked pair of every word
is merged wherever it stands; ranks of new pairs come from a binary search over the sorted pair keys of the
merge list. Words without a mergeable pair leave the array. A pair that holds a merged symbol ranks after the
merge that made the symbol, so merging all places of a pair at once equals merging one place at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, sha_hex

#: The split pattern and the printable stand-ins for bytes of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

NONE = np.int32(2**31 - 1)
_SHIFT = 20


def byte_chars() -> list[str]:
    """The character that stands for each byte."""
    rest = iter(range(256, 512))
    plain = set(PLAIN_BYTES)
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Merges:
    """A vocabulary: ids of single bytes, sorted pair keys with ranks and results, the bytes of each id."""

    def __init__(self, spec: dict):
        model, chars = spec["model"], byte_chars()
        vocab = model["vocab"]
        if model["type"] != "BPE" or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only a byte-level BPE without normaliser and prefix space is read")
        if any(t.get(flag) for t in spec.get("added_tokens", []) for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that strip spaces or must be single words are not read")
        if len(vocab) and max(vocab.values()) >= 1 << _SHIFT:
            raise ValueError(f"ids of {1 << _SHIFT} and more don't fit a pair's key")
        self.first = np.array([vocab[c] for c in chars], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] << _SHIFT | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], np.arange(len(key), dtype=np.int32)[order]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        code = {c: b for b, c in enumerate(chars)}
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))])
        self.pieces = [b""] * size
        for token, i in vocab.items():
            self.pieces[i] = bytes(code[c] for c in token) if all(c in code for c in token) else token.encode()
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for token, i in self.added.items():
            self.pieces[i] = token.encode()
        self.digits = [str(i).encode() for i in range(size)]

    @classmethod
    def load(cls, path: str) -> Merges:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << _SHIFT | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word; the words are whole, non-empty pretokens."""
        out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        if not words:
            return out
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.first[np.frombuffer(b"".join(words), np.uint8)]
        ids = np.arange(len(words))
        rank = np.full(len(sym), NONE, np.int32)
        rank[:-1] = self.rank(sym[:-1], sym[1:])
        rank[np.cumsum(sizes) - 1] = NONE
        while len(ids):
            starts = np.zeros(len(ids), np.int64)
            np.cumsum(sizes[:-1], out=starts[1:])
            least = np.minimum.reduceat(rank, starts)
            over = least == NONE
            if over.any():
                for w, s, n in zip(ids[over].tolist(), starts[over].tolist(), sizes[over].tolist(), strict=True):
                    out[w] = sym[s : s + n].copy()
                keep = np.repeat(~over, sizes)
                sym, rank, ids, sizes, least = sym[keep], rank[keep], ids[~over], sizes[~over], least[~over]
                if not len(ids):
                    break
            owner = np.repeat(np.arange(len(ids)), sizes)
            hit = np.flatnonzero(rank == least[owner])
            # of overlapping places, as in "aaa", every other one counts, from the left
            near = np.zeros(len(hit), bool)
            near[1:] = hit[1:] == hit[:-1] + 1
            if near.any():
                run = np.maximum.accumulate(np.where(near, 0, np.arange(len(hit))))
                hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sizes = sizes - np.bincount(owner[hit], minlength=len(ids))
            at = hit - np.arange(len(hit))
            sym, rank = sym[keep], rank[keep]
            ends = np.zeros(len(sym), bool)
            ends[np.cumsum(sizes) - 1] = True
            for place in (at, at[at > 0] - 1):
                inner = place[~ends[place]]
                rank[inner] = self.rank(sym[inner], sym[inner + 1])
                rank[place[ends[place]]] = NONE
        return out


class _Known(dict):
    """Values by word; words that have none yet are noted in ``fresh``."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> None:
        self.fresh.append(word)


class Encoder:
    """Encodes whole texts; remembers what it has made of the words it has met, at most about ``memory`` of them.

    value: what is made of a word's ids, and given back for each of its places.
    """

    def __init__(self, merges: Merges, value: Callable[[list[int]], object] = tuple, memory: int = 200_000):
        self.merges, self.value, self.memory, self.known = merges, value, memory, _Known()
        self.find = regex.compile(PATTERN).findall
        names = sorted(merges.added, key=len, reverse=True)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None
        self.names = tuple(names)

    def _words(self, text: str) -> list[str]:
        if self.parts is None or not any(n in text for n in self.names):
            return self.find(text)
        out: list[str] = []
        for k, part in enumerate(self.parts(text)):
            out += [part] if k % 2 else self.find(part)
        return out

    def encode(self, texts: list[str]) -> list[list]:
        """The values of the words of each text, in order."""
        if len(self.known) > self.memory:
            self.known = _Known()
        known, added, out, waiting = self.known, self.merges.added, [], []
        for text in texts:
            words, before = self._words(text), len(known.fresh)
            out.append(list(map(known.__getitem__, words)))
            if len(known.fresh) > before:
                waiting.append((len(out) - 1, words))
        fresh = list(dict.fromkeys(known.fresh))
        known.fresh = []
        plain = [w for w in fresh if w not in added]
        known.update((w, self.value([added[w]])) for w in fresh if w in added)
        for w, ids in zip(plain, self.merges.encode_words([w.encode() for w in plain]), strict=True):
            known[w] = self.value(ids.tolist())
        for k, words in waiting:
            out[k] = list(map(known.__getitem__, words))
        return out


def encode_batches(merges: Merges, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, ids and the text decoded from the ids, for batches of doc_id and text."""
    encoder = Encoder(merges)
    for batch in batches:
        texts = batch.column(1)
        sizes = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t.as_py() or "") for t in texts], out=sizes[1:])
        for i, j in chunks(sizes, 1 << 20):
            part = [t or "" for t in texts.slice(i, j - i).to_pylist()]
            ids = [[x for w in words for x in w] for words in encoder.encode(part)]
            decoded = [b"".join(map(merges.pieces.__getitem__, x)).decode("utf-8", "replace") for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``ids`` (array of int) and ``decoded`` (the text those ids stand for).

    Null text is empty and has no ids; other columns of docs are not looked at, whatever their names; repeated
    rows give repeated results; an empty table gives an empty one. path: a tokenizer file in the JSON format,
    read on the driver and sent to the executors (its size is that of the vocabulary, not of the data).
    Each task keeps one batch of text and a bounded memory of words.
    """
    merges = Merges.load(path)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: encode_batches(merges, batches), f"doc_id {kind}, ids array<int>, decoded string")


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """bpe_encode with its results as counts and digests, made in the same pass so that no ids leave the worker."""
    merges = Merges.load(path)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits, pieces = merges.digits, merges.pieces
        encoder = Encoder(merges, lambda ids: (len(ids), b",".join([digits[x] for x in ids]), b"".join([pieces[x] for x in ids])))
        for batch in batches:
            texts = batch.column(1)
            sizes = np.zeros(len(texts) + 1, np.int64)
            np.cumsum([len(t.as_py() or "") for t in texts], out=sizes[1:])
            for i, j in chunks(sizes, 1 << 20):
                counts, shas, decoded = [], [], []
                for words in encoder.encode([t or "" for t in texts.slice(i, j - i).to_pylist()]):
                    n, ids, raw = zip(*words, strict=True) if words else ((), (), ())
                    counts.append(sum(n))
                    shas.append(sha_hex(b",".join(ids)))
                    decoded.append(sha_hex(b"".join(raw).decode("utf-8", "replace").encode()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(digest, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
