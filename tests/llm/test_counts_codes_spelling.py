"""Token counts, vector codes and spelling groups against the tokenizer library and brute force, and on odd tables."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tesserae.llm import spelling
from tesserae.llm.bpe import Merges
from tesserae.llm.common import chunks, text_buffers
from tesserae.llm.queries import tokenizer_path
from tesserae.llm.spelling import near_pairs, near_words, spelling_groups, vocabulary
from tesserae.llm.token_counts import TokenCounter, token_counts
from tesserae.llm.vector_codes import Block, _cut, books_digest, code_report, vector_codes

from ..oracle import SF


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def counter():
    return TokenCounter(Merges.load(tokenizer_path()))


def counted(counter, texts):
    data, offsets = text_buffers(pa.array(texts, pa.string()))
    out = []
    for i, j in chunks(offsets):
        part = offsets[i : j + 1]
        out += counter.count(data[part[0] : part[-1]], part - part[0]).tolist()
    return out


def test_counts_equal_the_library(counter, library):
    rng = random.Random(1)
    bits = ["a", "b", " ", "  ", "'", "'s", "'r", "'re", "'v", "'ve", "'l", "'ll", "\n", "\t", "1", "23", "é", "ß", "中", "!", "..", " ", "　", "\x1c", "\x85", "the", " The", "<|endoftext|>", "<|endo", "😀", "r", "e", "٣", "́", "aaaa", "----"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    texts += ["".join(rng.choice("abcdefghijklmnopABCDE0123456789") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    assert counted(counter, texts) == library(texts)


def test_counts_of_long_stretches(counter, library):
    rng = random.Random(2)
    texts = ["a" * 5000, "ab" * 3000, "é" * 2000, "-" * 3001, " " * 700 + "x", "'" * 999, "".join(rng.choice("ACGT") for _ in range(20000)), "".join(rng.choice("abcdefghij") for _ in range(60000)), "x" * 300_000]
    assert counted(counter, texts) == library(texts)


def test_table_of_states_is_begun_anew(library, monkeypatch):
    monkeypatch.setattr("tesserae.llm.token_counts.MOST_STATES", 300)
    monkeypatch.setattr("tesserae.llm.token_counts.BLOCK", 2048)
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefghij klmn'\n") for _ in range(rng.randint(0, 900))) for _ in range(60)] + ["".join(rng.choice("abcdefgh") for _ in range(9000))]
    assert counted(TokenCounter(Merges.load(tokenizer_path())), texts) == library(texts)


def test_token_counts_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(docs, tokenizer_path()).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    n = dict(zip(texts, library(list(texts.values())), strict=True))
    assert rows == {k: (len(t.encode()), n[k], n[k] > 512) for k, t in texts.items()}


def test_token_counts_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "x"), (2, "a b", "x"), (2, "a b", "x")], "doc_id long, text string, n_tokens string")
    rows = sorted(token_counts(docs, tokenizer_path(), limit=1).collect(), key=str)
    assert [tuple(r) for r in rows] == sorted([(1, 0, 0, False), (None, 0, 0, False), (2, 3, 2, True), (2, 3, 2, True)], key=lambda r: f"Row(doc_id={r[0]}")
    assert token_counts(docs.limit(0), tokenizer_path()).count() == 0


def lloyd(vectors, parts=16, entries=64, rounds=2):
    """(code, error) by id and the final codebooks."""
    ids = sorted(vectors)
    x = _cut(np.floor(np.array([vectors[i] for i in ids], float) * 256).astype(np.int64), parts)
    books = x[:entries].swapaxes(0, 1).copy()
    for r in range(rounds + 1):
        far = ((x[:, :, None, :] - books[None]) ** 2).sum(-1)
        near = far.argmin(2)
        if r < rounds:
            for p in range(parts):
                for e in range(books.shape[1]):
                    if (near[:, p] == e).any():
                        books[p, e] = x[near[:, p] == e, p].sum(0) // (near[:, p] == e).sum()
    return {i: (row.astype(np.uint8).tobytes().hex(), int(d)) for i, row, d in zip(ids, near, far.min(2).sum(1), strict=True)}, books


@pytest.mark.parametrize(("n", "width", "spread"), [(3000, 64, 0.1), (5000, 32, 0.006), (40, 16, 1.0), (1, 7, 1.0), (700, 48, 0.0)])
def test_codes_equal_brute_force(spark, n, width, spread):
    rng = np.random.default_rng(n)
    held = {int(k) * 3 - 50: v.tolist() for k, v in enumerate(rng.normal(0, spread, (n, width)))}
    table = spark.createDataFrame([(k, k % 3 if k % 7 else None, v) for k, v in held.items()], "vec_id long, label int, embedding array<double>").repartition(5)
    rows = code_report(table).collect()
    want, books = lloyd(held)
    assert {r["vec_id"]: (r["code"], r["error"]) for r in rows} == want and {r["codebooks_sha256"] for r in rows} == {books_digest(books)}
    totals = {}
    for k in held:
        totals[k % 3 if k % 7 else None] = totals.get(k % 3 if k % 7 else None, 0) + want[k][1]
    assert all(r["label_error"] == totals[r["vec_id"] % 3 if r["vec_id"] % 7 else None] for r in rows)


def test_whole_nodes_and_uncertain_leaves_sum_up():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 1, (300, 32)) for c in (-400, 0, 400)]).astype(np.int64)
    books = _cut(np.concatenate([x[[0, 300, 600, 600]], x[[1]]]), 16).swapaxes(0, 1)
    cut = _cut(x, 16)
    near = ((cut[:, :, None, :] - books[None]) ** 2).sum(-1).argmin(2)
    want = np.zeros((16, 5, 3), np.int64)
    for p in range(16):
        np.add.at(want[p], near[:, p], np.column_stack([cut[:, p], np.ones(len(x), np.int64)]))
    assert (Block(len(x), 32, Block.pack(x, 16), 16).sums(books) == want).all()


def test_codes_of_odd_rows(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, [0.5, -0.25]), (1, None, [0.5, -0.25]), (None, 2, [0.0, 1.0]), (3, 2, None), (4, 2, [nan, 0.0]), (5, 2, [inf, 0.0]), (6, 2, [None, 1.0]), (7, 2, []), (8, 2, [1.0, 2.0, 3.0]), (9, 2, [1e300, 0.0])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, code string")
    found = code_report(table).collect()
    assert sorted((str(r["vec_id"]) for r in found)) == ["1", "1", "7", "8", "9", "None"]
    assert all(len(r["code"]) == 32 and r["error"] == 0 for r in found)
    assert code_report(table.limit(0)).count() == 0
    coded, books = vector_codes(table, parts=1, entries=1, rounds=0)
    errors = {(r["vec_id"], r["width"]): r["error"] for r in coded.collect()}
    assert books[2].tolist() == [[[128, -64]]] and errors[(None, 2)] == 128**2 + 320**2
    monkeypatch.setattr("tesserae.llm.vector_codes.BROADCAST_LABELS", 0)
    joined = {(r["vec_id"], r["label_error"]) for r in code_report(table, parts=1, entries=1).collect()}
    monkeypatch.undo()
    assert joined == {(r["vec_id"], r["label_error"]) for r in code_report(table, parts=1, entries=1).collect()}


def edits(words):
    known, letters, out = set(words), set("".join(words)), set()
    for w in words:
        for i in range(len(w) + 1):
            tried = [w[:i] + c + w[i:] for c in letters] + [w[:i] + w[i + 1 :]] + [w[:i] + c + w[i + 1 :] for c in letters if i < len(w)]
            out |= {(w, x) for x in tried if x != w and x in known}
    return out


@pytest.mark.parametrize(("letters", "lengths", "n"), [("ab", (5, 9), 200), ("abc", (2, 7), 400), ("abàÿz", (5, 40), 300), ("a", (2, 60), 60)])
def test_searches_find_every_edit_once(letters, lengths, n):
    rng = random.Random(n)
    words = list({"".join(rng.choice(letters) for _ in range(rng.randint(*lengths))) for _ in range(n)})
    words = list(dict.fromkeys(words + [w[:2] + "z" + w[3:] for w in words[:40] if len(w) > 3]))
    for windows in (lambda m: ((0, m // 2), (m // 2, m)), lambda m: ((x, x + 1) for x in range(m))):
        pattern, a, b = map(np.array, zip(*((k, x, y) for k, w in enumerate(words) for x, y in windows(len(w))), strict=True))
        who, found, longer = near_words(words, pattern, a, b)
        pairs = [(words[pattern[i]], words[j], x) for i, j, x in zip(who, found, longer, strict=True)]
        both = [(x, y) for x, y, _ in pairs] + [(y, x) for x, y, more in pairs if more]
        assert len(both) == len(set(both)) and set(both) == edits(words)


@pytest.mark.parametrize("most_rows", [5, 40, 1 << 15])
def test_large_groups_are_dealt_anew(spark, most_rows):
    rng = random.Random(7)
    words = list({"commonprefix" + "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(400)} | {"".join(rng.choice("ab") for _ in range(rng.randint(2, 9))) for _ in range(200)})
    rows = near_pairs(spark.createDataFrame([(w, len(w)) for w in words], "word string, n long"), most_rows).collect()
    assert len(rows) == len({(r["word"], r["near"]) for r in rows}) and {(r["word"], r["near"]) for r in rows} == edits(words)
    assert all(r["near_n"] == len(r["near"]) for r in rows)


def test_batches_of_groups(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BATCH_ROWS", 20)
    words = [a + b + c + d + "xyz" for a in "abc" for b in "abc" for c in "abc" for d in "abc"]
    batch = pa.RecordBatch.from_pylist([{"key": hash((m, w[:h])), "word": w, "n": 1, "m": m, "a": h, "b": m} for w in words for m in (7,) for h in (3,)])
    batch = pa.Table.from_batches([batch]).sort_by("key").combine_chunks().to_batches()
    pieces = [p for t in batch for p in (t.slice(0, 7), t.slice(7, 30), t.slice(37))]
    pairs = [(r["word"], r["near"]) for out in spelling._found(iter(pieces)) for r in out.to_pylist()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {p for p in edits(words) if p[0][:3] == p[1][:3]}


def test_spelling_groups_by_brute_force(spark):
    rng = random.Random(11)
    base = ["Straßen", "colour", "Überall", "running", "colours", "aaaaaa"]
    docs = [(k, " ".join(rng.choice(base) for _ in range(rng.randint(0, 60))) + rng.choice(["", " colur colur colur", " runing-colourr", " x1y"])) for k in range(400)]
    count = {}
    for k, text in docs:
        for run in __import__("re").findall("[a-zÀ-ÿ]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)):
            h = zlib.crc32(f"{k}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run
            if len(word) >= 5:
                count[word] = count.get(word, 0) + 1
    count = {w: n for w, n in count.items() if n >= 3}
    near = {w: [] for w in count}
    for w, x in edits(list(count)):
        near[w].append(x)
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-count[x], x), default=None)
        form[w] = best if best and count[best] >= 2 * count[w] else None
    want = set()
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        want.add((w, form[w], root, count[w], len(near[w]), count[form[w]] if form[w] else None))
    rows = spelling_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows} == want and len(rows) == len(want) > 10


def test_spelling_of_odd_rows(spark):
    long = "q" * 70_000
    docs = spark.createDataFrame([(None, "hello hello hello"), (1, None), (2, ""), (3, "jello " * 7), (3, "jello " * 7), (4, f"{long} {long} {long}")], "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS word")
    rows = {r["word"]: r for r in spelling_groups(docs, every=1 << 40).collect()}
    assert set(rows) == {"hello", "jello", long}
    assert rows["hello"]["form"] == rows["hello"]["root"] == "jello" and rows["jello"]["n"] == 14 and rows[long]["n_near"] == 0
    assert spelling_groups(docs.limit(0)).count() == 0 and vocabulary(docs.limit(0)).count() == 0
