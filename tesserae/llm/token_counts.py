"""Token counts by a tokenizer that is compiled to deterministic finite-state transducers.

Two transducers follow each other. The first reads character classes and marks where the split pattern cuts a text; it
has a dozen states and is compiled whole. The second reads the bytes between two cuts, and each of its transitions bears
the number of tokens by which the count of what was read so far changes (a byte may undo tokens). One of its states
holds, for every place behind from which a vocabulary entry may still be under way, the trie node reached, the last
token of the text before that place and its count relative to now; that is all that decides which token ends next,
because a token sequence is the encoding of its text exactly if no merge crosses a border of neighbouring tokens. States
and transitions of the second one are determined when a text first needs them and kept in a hash table of bounded size.

Texts lie end to end in flat arrays that are cut into chunks of equal length, read in step with each other. A chunk's
map from every state to the state after it is found for all chunks at once; maps compose by a parallel prefix scan,
which gives the state that every chunk begins in. Stretches without a cut that are longer than a chunk are cut as well:
their chunks are read from a guessed state (that after the bytes just before, which mostly settle it), and the maps so
found are composed from left to right, reading a chunk again where the guess was wrong.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Merges
from .common import chunks, text_buffers

#: Characters or bytes in a chunk; bytes before a chunk from which its first state is guessed; characters in a block.
SPAN, BEFORE, BLOCK = 256, 32, 1 << 20
#: States after which the table of the second transducer is begun anew, between two pieces of text.
MOST_STATES = 200_000

LETTER, DIGIT, SPACE, BLANK, OTHER, QUOTE, SHORT, R, V, E, L = range(11)
LETTERS = (LETTER, SHORT, R, V, E, L)
N_CLASSES, STAY = 11, 22


def character_classes() -> np.ndarray:
    """The class of every code point, as the split pattern tells characters apart."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT), (r"\s+", BLANK)):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            out[a : b + 1] = kind
    for letters, kind in ((" ", SPACE), ("'", QUOTE), ("stmd", SHORT), ("r", R), ("v", V), ("e", E), ("l", L)):
        out[[ord(c) for c in letters]] = kind
    return out


class Splitter:
    """The first transducer. Its output says whether a cut lies before the character (1), before the last one (2), or both."""

    START, WORD, NUMBER, MARKS, ONE_SPACE, ONE_BLANK, SPACES, BLANKS, TICK, TICK_R, TICK_V, TICK_L, DONE = range(13)

    def __init__(self) -> None:
        self.classes = character_classes()
        self.next, self.out = np.zeros((13, STAY + 1), np.uint8), np.zeros((13, STAY + 1), np.uint8)
        for q in range(13):
            for c in range(N_CLASSES):
                self.next[q, c], self.out[q, c] = self._step(q, c)
                # the first character of a text, after a text that ended in state q
                self.next[q, c + N_CLASSES], self.out[q, c + N_CLASSES] = self._fresh(c)
                self.out[q, c + N_CLASSES] |= 2 * (q in (self.TICK_R, self.TICK_V, self.TICK_L))
            self.next[q, STAY] = q

    def _fresh(self, c: int) -> tuple[int, int]:
        if c in LETTERS:
            return self.WORD, 1
        return {DIGIT: self.NUMBER, SPACE: self.ONE_SPACE, BLANK: self.ONE_BLANK, OTHER: self.MARKS, QUOTE: self.TICK}[c], 1

    def _step(self, q: int, c: int) -> tuple[int, int]:
        letter, mark, white = c in LETTERS, c in (OTHER, QUOTE), c in (SPACE, BLANK)
        if q in (self.ONE_SPACE, self.ONE_BLANK, self.SPACES, self.BLANKS):
            if white:
                return self.SPACES if c == SPACE else self.BLANKS, 0
            cut = 2 * (q in (self.SPACES, self.BLANKS))  # a longer run leaves its last character to what follows
            if q in (self.ONE_BLANK, self.BLANKS):
                return self._fresh(c)[0], cut | 1
            return self.WORD if letter else self.NUMBER if c == DIGIT else self.MARKS, cut
        if q == self.WORD and letter or q == self.NUMBER and c == DIGIT or q == self.MARKS and mark:
            return q, 0
        if q == self.TICK and mark:
            return self.MARKS, 0
        if q == self.TICK and c in (SHORT, R, V, L):
            return {SHORT: self.DONE, R: self.TICK_R, V: self.TICK_V, L: self.TICK_L}[c], 0
        if q in (self.TICK_R, self.TICK_V, self.TICK_L):
            if c == (L if q == self.TICK_L else E):
                return self.DONE, 0
            after, cut = self._step(self.WORD, c)  # no contraction: the letter begins a word
            return after, cut | 2
        return self._fresh(c)

    def cuts(self, classes: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        """The places of cuts (-1: before the last character of what came before), and the state at the end."""
        n = -(-len(classes) // SPAN)
        padded = np.full(n * SPAN, STAY, np.uint8)
        padded[: len(classes)] = classes
        steps = np.ascontiguousarray(padded.reshape(n, SPAN).T)
        maps = np.repeat(np.arange(13, dtype=np.uint8)[:, None], n, axis=1)
        for step in steps:
            maps = self.next[maps, step]
        reach = 1
        while reach < n:  # afterwards a map leads from the block's beginning to its chunk's end
            maps[:, reach:] = np.take_along_axis(maps[:, reach:], maps[:, :-reach], axis=0)
            reach *= 2
        now = np.empty(n, np.uint8)
        now[0], now[1:] = state, maps[state, :-1]
        said = np.empty_like(steps)
        for k, step in enumerate(steps):
            said[k] = self.out[now, step]
            now = self.next[now, step]
        said = said.T.reshape(-1)[: len(classes)]
        return np.union1d(np.flatnonzero(said & 1), np.flatnonzero(said & 2) - 1), int(maps[state, -1])


class Counter:
    """The second transducer: token counts of byte strings that the split pattern doesn't cut."""

    def __init__(self, merges: Merges):
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.made: dict[int, int] = {}
        for key, rank, made in zip(merges.keys.tolist(), merges.ranks.tolist(), merges.made[merges.ranks].tolist(), strict=True):
            a, b = key >> 20, key & (1 << 20) - 1
            if made in self.parts:
                raise ValueError("a vocabulary whose entries arise from two merges is not read")
            self.parts[made], self.rank[key], self.made[made] = (a, b), rank, rank
        if any(max(self.made.get(a, -1), self.made.get(b, -1)) >= self.made[t] for t, (a, b) in self.parts.items()):
            raise ValueError("a merge must rank after those that make its parts")
        entries = [*merges.first.tolist(), *self.parts]
        alone = merges.encode_words([merges.pieces[t] for t in entries])
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [False]
        for t, ids in zip(entries, alone, strict=True):
            if len(ids) == 1:  # others never stand in an encoding
                node = 0
                for byte in merges.pieces[t]:
                    self.inner[node] = True
                    after = self.child.get(node << 8 | byte)
                    if after is None:
                        after = self.child[node << 8 | byte] = len(self.token)
                        self.token.append(-1)
                        self.inner.append(False)
                    node = after
                self.token[node] = int(ids[0])
        self.met: dict[tuple[int, int], bool] = {}
        self.rims: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._begin()

    def _begin(self) -> None:
        self.opens: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        self._room(16)
        self._id(((0, -1, 0),))
        if len(self.met) > 4 * MOST_STATES:
            self.met = {}

    def _room(self, bits: int) -> None:
        self.bits, self.filled = bits, 0
        self.keys, self.after, self.emit = np.full(1 << bits, 0xFFFFFFFF, np.uint32), np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int16)

    def _id(self, opens: tuple) -> int:
        found = self.ids.get(opens)
        if found is None:
            found = self.ids[opens] = len(self.opens)
            self.opens.append(opens)
        return found

    def _rim(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols at a token's left (0) or right (1) end while it is merged, and the rank that consumes each."""
        found = self.rims.get((token, side))
        if found is None:
            found, symbol, until = [], token, 1 << 30
            while symbol >= 0:
                found.append((symbol, until))
                until = self.made.get(symbol, -1)
                symbol = self.parts[symbol][side] if symbol in self.parts else -1
            self.rims[token, side] = found
        return found

    def _stand(self, left: int, right: int) -> bool:
        """Whether the tokens may be neighbours: no merge crosses the border. Of equal ranks the left one comes first."""
        if left < 0:
            return True
        found = self.met.get((left, right))
        if found is None:
            found = True
            for x, until in self._rim(left, 1):
                for y, before in self._rim(right, 0):
                    rank = self.rank.get(x << 20 | y)
                    if rank is not None and rank < until and rank <= before:
                        found = False
            self.met[left, right] = found
        return found

    def _determine(self, state: int, byte: int) -> tuple[int, int]:
        """The state after one more byte, and by how much the count changes."""
        grown, token, change = [], -1, 0
        for node, last, n in self.opens[state]:
            child = self.child.get(node << 8 | byte)
            if child is not None:
                if token < 0 and self.token[child] >= 0 and self._stand(last, self.token[child]):
                    token, change = self.token[child], n + 1
                if self.inner[child]:
                    grown.append((child, last, n))
        return self._id((*((child, last, n - change) for child, last, n in grown), (0, token, 0))), change

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or the free place where it belongs."""
        slot = (keys * np.uint32(2654435769)) >> np.uint32(32 - self.bits)
        todo = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != 0xFFFFFFFF))
        while len(todo):
            slot[todo] = (slot[todo] + np.uint32(1)) & np.uint32((1 << self.bits) - 1)
            held = self.keys[slot[todo]]
            todo = todo[(held != keys[todo]) & (held != 0xFFFFFFFF)]
        return slot

    def _add(self, key: int, after: int, emit: int) -> None:
        if 2 * self.filled >= len(self.keys):
            held = self.keys != 0xFFFFFFFF
            old = self.keys[held].tolist(), self.after[held].tolist(), self.emit[held].tolist()
            self._room(self.bits + 1)
            for row in zip(*old, strict=True):
                self._add(*row)
        slot = (key * 2654435769 & 0xFFFFFFFF) >> 32 - self.bits
        while self.keys[slot] != 0xFFFFFFFF:
            slot = slot + 1 & (1 << self.bits) - 1
        self.keys[slot], self.after[slot], self.emit[slot] = key, after, emit
        self.filled += 1

    def _lookup(self, states: np.ndarray, read: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = states.astype(np.uint32) << np.uint32(8) | read
        slot = self._slots(keys)
        absent = self.keys[slot] != keys
        if absent.any():
            for key in np.unique(keys[absent]).tolist():
                self._add(key, *self._determine(key >> 8, key & 255))
            slot = self._slots(keys)
        return self.after[slot], self.emit[slot]

    def _read(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Reads many spans in step: the state after each and the change of its count."""
        order = np.argsort(start - end, kind="stable")
        at, size, now = start[order], (end - start)[order], states[order].astype(np.int32)
        count = np.zeros(len(order), np.int64)
        active = np.searchsorted(-size, -np.arange(1, size[0] + 1 if len(size) else 1), "right")
        for k, n in enumerate(active.tolist()):
            now[:n], emit = self._lookup(now[:n], data[at[:n] + k])
            count[:n] += emit
        after, counts = np.empty_like(now), np.empty_like(count)
        after[order], counts[order] = now, count
        return after, counts

    def _read_one(self, read: list[int], state: int) -> tuple[int, int]:
        count = 0
        for byte in read:
            key = state << 8 | byte
            slot = (key * 2654435769 & 0xFFFFFFFF) >> 32 - self.bits
            held = self.keys.item(slot)
            while held != key and held != 0xFFFFFFFF:
                slot = slot + 1 & (1 << self.bits) - 1
                held = self.keys.item(slot)
            if held == key:
                state, emit = self.after.item(slot), self.emit.item(slot)
            else:
                state, emit = self._determine(state, byte)
                self._add(key, state, emit)
            count += emit
        return state, count

    def _long(self, data: np.ndarray, start: int, end: int) -> int:
        """The count of a span of many chunks."""
        state, total = 0, 0
        for low in range(start, end, BLOCK):
            if len(self.opens) > MOST_STATES:
                opens = self.opens[state]
                self._begin()
                state = self._id(opens)
            a = np.arange(low, min(low + BLOCK, end), SPAN)
            b = np.minimum(a + SPAN, end)
            guess = self._read(data, np.maximum(a - BEFORE, start), a, np.zeros(len(a), np.int32))[0]
            guess[0] = state
            after, counts = self._read(data, a, b, guess)
            for k in range(len(a)):
                if guess[k] == state:
                    state, count = int(after[k]), int(counts[k])
                else:
                    state, count = self._read_one(data[a[k] : b[k]].tolist(), state)
                total += count
        return total

    def count(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of tokens of each span of bytes."""
        out, size = np.zeros(len(start), np.int64), end - start
        short = np.flatnonzero((size <= SPAN) & (size > 0))
        for i, j in chunks(np.concatenate([[0], np.cumsum(size[short])]), BLOCK):
            if len(self.opens) > MOST_STATES:
                self._begin()
            part = short[i:j]
            out[part] = self._read(data, start[part], end[part], np.zeros(len(part), np.int32))[1]
        for k in np.flatnonzero(size > SPAN).tolist():
            out[k] = self._long(data, int(start[k]), int(end[k]))
        return out


class TokenCounter:
    """Counts the tokens of whole texts under a byte-level BPE vocabulary."""

    def __init__(self, merges: Merges):
        self.split, self.counter = Splitter(), Counter(merges)
        names = sorted((n.encode() for n in merges.added), key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, names))) if names else None

    def _specials(self, raw: bytes, offsets: np.ndarray) -> np.ndarray:
        """Start and end of each special string inside a text."""
        if self.special is None or not self.special.search(raw):
            return np.zeros((0, 2), np.int64)
        found = [m.span() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for m in self.special.finditer(raw, a, b)]
        return np.array(found, np.int64).reshape(-1, 2)

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text; data are the UTF-8 bytes of all texts, offsets where they begin and end."""
        if not len(data):
            return np.zeros(len(offsets) - 1, np.int64)
        raw = data.tobytes()
        special = self._specials(raw, offsets)
        where = np.flatnonzero((data & 0xC0) != 0x80)
        kinds = self.split.classes[np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)]
        borders = np.unique(np.concatenate([offsets, special.ravel()]))
        kinds[np.searchsorted(where, borders[borders < len(data)])] += N_CLASSES
        kinds = np.append(kinds, np.uint8(OTHER + N_CLASSES))
        cuts, state = [], Splitter.START
        for k in range(0, len(kinds), BLOCK):
            found, state = self.split.cuts(kinds[k : k + BLOCK], state)
            cuts.append(found + k)
        bounds = np.append(where, len(data))[np.unique(np.concatenate(cuts))]
        start, end = bounds[:-1], bounds[1:]
        if len(special):
            inside = np.searchsorted(special[:, 0], start, "right") - 1
            plain = (inside < 0) | (start >= special[inside, 1])
            start, end = start[plain], end[plain]
        texts = np.searchsorted(offsets, start, "right") - 1
        out = np.zeros(len(offsets) - 1, np.int64)
        np.add.at(out, texts, self.counter.count(data, start, end))
        np.add.at(out, np.searchsorted(offsets, special[:, 0], "right") - 1, 1)
        return out


#: Compiled tokenizers of this worker, by their specification; kept over tasks, one at a time.
_COMPILED: dict[str, TokenCounter] = {}


def compiled(spec: str) -> TokenCounter:
    if spec not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[spec] = TokenCounter(Merges(json.loads(spec)))
    return _COMPILED[spec]


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_bytes of the text in UTF-8, n_tokens, and whether these are over the limit.

    path: a byte-level BPE tokenizer in the JSON format, read on the driver and sent to the executors (its size is that
    of the vocabulary). Its special strings inside texts are one token each. Null and empty texts have 0 bytes and 0
    tokens; texts of any length are counted whole; repeated rows and null ids give rows like others; an empty table
    gives an empty one; other columns are not looked at, whatever their names. Nothing is shuffled; a task holds one
    batch of texts, arrays of several times a piece of it (half a MB, or one longer text), and one bounded table.
    """
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    Counter(Merges(json.loads(spec)))  # a vocabulary that can't be compiled is refused here
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = compiled(spec)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in chunks(offsets):
                part = offsets[i : j + 1]
                n = counter.count(data[part[0] : part[-1]], part - part[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(part)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
