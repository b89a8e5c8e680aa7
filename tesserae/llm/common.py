"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES, LONG_WORD = 1 << 19, 128


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir. In local mode, where none is set, a private one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = f"file://{tempfile.mkdtemp(prefix='tesserae-')}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """df written as Parquet (with these options) to the shared folder and read back, so that no later step computes it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tesserae-{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    other = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(other)


def sha_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; null is empty. Both count from 0."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P, _P_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_CACHE: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    size = 1 << max(16, int(n - 1).bit_length() if n else 0)
    if (base, size) not in _CACHE:
        for key in [k for k in _CACHE if k[0] == base]:
            del _CACHE[key]
        _CACHE[base, size] = _powers(base, size)
    return _CACHE[base, size][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def _lane(eight: np.ndarray, start: np.ndarray, left: np.ndarray) -> np.ndarray:
    return eight[start] & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * np.minimum(left, 8).astype(np.uint64)))


def _blake(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


#: Hashes of words that a worker has met, forgotten when they are too many.
_KNOWN: dict[bytes, int] = {}
_MOST_KNOWN = 1 << 18


def _known_blake(words: list[bytes]) -> np.ndarray:
    """_blake of each word, made once for words that come again and again."""
    found = list(map(_KNOWN.get, words))
    new = [k for k, h in enumerate(found) if h is None]
    if new:
        made = np.frombuffer(b"".join([hashlib.blake2b(words[k], digest_size=8).digest() for k in new]), "<u8")
        if len(_KNOWN) + len(new) > _MOST_KNOWN:
            _KNOWN.clear()
        for k, h in zip(new, made.tolist(), strict=True):
            found[k] = h
        _KNOWN.update((words[k], found[k]) for k in new[:_MOST_KNOWN] if len(words[k]) <= LONG_WORD)
    return np.array(found, np.uint64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """BLAKE2b, cut to 64 bits, of each span.

    Spans of up to LONG_WORD bytes are first told apart by a quick hash, so that BLAKE2b runs once for each of them. Other
    spans can share that quick hash by design; so each is compared with its representative, byte by byte, and hashed by
    itself where they differ.
    """
    size, raw = end - start, data.tobytes()
    if not len(size):
        return np.zeros(0, np.uint64)
    quick, eight = mix(size.astype(np.uint64) * np.uint64(_P)), _lanes(data)
    todo, at = np.flatnonzero((size > 0) & (size <= LONG_WORD)), 0
    while len(todo):
        left = size[todo] - at
        quick[todo] = mix((quick[todo] ^ _lane(eight, start[todo] + at, left)) * np.uint64(_P) + np.uint64(1))
        todo, at = todo[left > 8], at + 8
    alone = np.flatnonzero(size > LONG_WORD)
    quick[alone] = np.arange(len(alone), dtype=np.uint64)
    _, first, group = np.unique(quick, return_index=True, return_inverse=True)
    out = _known_blake([raw[s:e] for s, e in zip(start[first].tolist(), end[first].tolist(), strict=True)])[group]
    like = first[group]
    same = (size == size[like]) & (size <= LONG_WORD)
    todo, at = np.flatnonzero(same & (size > 0)), 0
    while len(todo):
        left = size[todo] - at
        equal = _lane(eight, start[todo] + at, left) == _lane(eight, start[like[todo]] + at, left)
        same[todo[~equal]] = False
        todo, at = todo[equal & (left > 8)], at + 8
    for k in np.flatnonzero(~same).tolist():
        out[k] = _blake(raw[start[k] : end[k]])
    return out


class Rolling:
    """Hashes of any substring of a byte array, from prefix sums modulo 2**64.

    Strings can be made whose hashes agree, so these only say where to look; what is equal is decided by other means.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * powers(_P, n), out=self.sums[1:])
        self.inverse = powers(_P_INV, n + 1)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def every(self, k: int, finish: bool = True) -> np.ndarray:
        """Of each k bytes; unfinished ones have good upper bits only."""
        out = self.sums[k:] - self.sums[:-k]
        out *= self.inverse[: len(out)]
        return mix(out) if finish else out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def lower_bytes(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def spans_of(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of True that bounds (offsets) don't cut."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def space_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return spans_of(~_SPACE[data], bounds)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

