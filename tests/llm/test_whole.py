"""Cases that shortcuts would lose: clashing names, null ids, large ids, adversarial hashes, long broken pages."""

import hashlib
import time

import numpy as np
import pytest

from tesserae.llm import bpe, chat, html
from tesserae.llm.common import word_hashes
from tesserae.llm.decontaminate import decontaminate, find_contamination
from tesserae.llm.near_dedup import keep_one, near_duplicates
from tesserae.llm.queries import op2_toxicity
from tesserae.llm.toxicity import training_sample

PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_spans_are_removed_beside_a_column_of_that_name(spark):
    docs = spark.createDataFrame([(1, f"before {PASSAGE} after", 5, "k", 1)], "doc_id long, text string, spans int, items string, h int")
    bench = spark.createDataFrame([(None, PASSAGE), (3, "short item")], "item_id long, text string")
    for most in (0, 1 << 26):
        found = find_contamination(docs, bench, most_bytes=most).first()
        assert (found.n_hit, found["items"], found.contaminated) == (13, [None], True)
        got = decontaminate(docs, bench, "spans", most_bytes=most).first()
        assert (got.text.split(), got.spans, got["items"], got.h) == (["before", "after"], 5, "k", 1)


def test_windows_beyond_the_broadcast_size_are_joined(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words, rng.integers(0, 60))) for _ in range(60)]
    bench = [(i, " ".join(t.split()[:k])) for i, (t, k) in enumerate(zip(texts[::3], [1, 2, 3, 7, 13, 20] * 4, strict=False))]
    docs = spark.createDataFrame([(i % 50 if i % 7 else None, t or None) for i, t in enumerate(texts)] + [(1, texts[1])], "doc_id long, text string")
    bench = spark.createDataFrame(bench, "item_id long, text string")
    a, b = (sorted(map(str, find_contamination(docs, bench, most_bytes=m).collect())) for m in (0, 1 << 26))
    assert a == b and any("contaminated=True" in x for x in a)


def test_conversation_ids_beyond_doubles_stay_exact(spark):
    big = 2**53 + 1
    rows = [(None, 0, "user", "x"), (big, 0, "user", "hello"), (big, 1, "assistant", None), (big + 1, 0, "assistant", "<|im_end|>\n<|im_start|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    for keep in (True, False):
        got = {r.conv_id: r for r in chat.format_chat(df, keep).collect()}
        assert set(got) == {None, big, big + 1} and got[big].n_turns == 2
        assert got[big + 1].loss_sha256 == hashlib.sha256(rows[3][3].encode()).hexdigest()


def test_words_that_a_polynomial_hash_mixes_up_stay_apart(spark):
    a = thue_morse(1024)
    b = a.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}


def test_word_hashes_depend_on_the_bytes_alone():
    words = [b"", b"a", b"abcdefgh", b"abcdefghi", b"x" * 127, b"x" * 128, b"x" * 129, b"y" * 5000, b"abcdefgh\0", b"a"]
    sizes = np.cumsum([0, *map(len, words)])
    got = word_hashes(np.frombuffer(b"".join(words), np.uint8), sizes[:-1], sizes[1:])
    assert len(set(got.tolist())) == len(words) - 1 and got[1] == got[-1]
    for w, h in zip(words, got, strict=True):
        assert word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0] == h


def test_one_row_stays_of_rows_that_share_an_id(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "a"), (1, text, "a"), (1, "quite another text of some words here", "b"), (2, text, None), (None, text, "c"), (None, text, "c")]
    got = keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert [r.doc_id for r in got].count(1) == 1 and [r.doc_id for r in got].count(None) == 2 and 2 not in [r.doc_id for r in got]


@pytest.mark.parametrize("page, text", [("<a " * 350_000, None), ("<a x='" * 170_000, None), ("<a x=\"'>" * 130_001, None), ("<!" * 400_000, None), ("<p>x" + "<caption><div>" * 60_000, "x"), ("<b>" * 1_000_000 + "end", "end")])
def test_long_broken_pages_take_linear_time(page, text):
    begun = time.time()
    got = html.extract(page)
    assert time.time() - begun < 20
    assert text is None or got == text


def test_unended_tags_are_text():
    assert html.extract("1 <a href=x") == "1 <a href=x"
    assert html.extract("<p title='a>b'>x<i \">y</i>") == "xy"


def test_rowspans_of_any_height():
    page = "<table><tr><td rowspan=1500>a<td>b</tr>" + "<tr><td>c</tr>" * 1499 + "<tr><td>d<td>e</tr></table>"
    lines = html.extract(page).split("\n")
    assert lines[0] == "a  b" and set(lines[1:1500]) == {"   c"} and lines[1500] == "d  e"


def test_vocabularies_that_would_be_misread_are_refused():
    chars = bpe.byte_chars()
    spec = {"model": {"type": "BPE", "vocab": {c: i for i, c in enumerate(chars)}, "merges": []}, "pre_tokenizer": {"type": "ByteLevel"}, "added_tokens": [{"id": 256, "content": "<x>", "lstrip": True}]}
    with pytest.raises(ValueError):
        bpe.Merges(spec)
    spec["added_tokens"] = []
    spec["model"]["vocab"]["zz"] = 1 << 20
    with pytest.raises(ValueError):
        bpe.Merges(spec)


def test_the_sample_is_bounded_and_takes_no_order(spark):
    docs = spark.createDataFrame([(i, f"{'x' * 100}{i}") for i in range(40)] + [(1, "another text")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    rows = [sorted(map(tuple, training_sample(docs.repartition(k), labels, 100, 1 << 20).collect())) for k in (1, 7)]
    assert rows[0] == rows[1] and (1, "another text", 1) in rows[0]
    assert sum(len(r[1]) for r in training_sample(docs, labels, 100, 600).collect()) <= 600
    assert training_sample(docs, labels, 3, 1 << 20).count() == 6


def test_held_out_is_never_null(spark, tmp_path):
    spark.createDataFrame([(None, "a b"), (7, "a c")], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, 1)], "doc_id long, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert {r.doc_id: r.held_out is None for r in op2_toxicity(spark, f"file://{tmp_path}").collect()} == {None: False, 7: False}


def test_families_around_the_threshold_in_large_nodes(spark):
    """Families whose members are partly just below the threshold, and many texts that share a long common part."""
    rng = np.random.default_rng(11)
    words = np.array([f"v{i}" for i in range(4000)])
    texts = []
    for f in range(3):
        base = rng.choice(words, 120)
        for k in range(40):
            own = base.copy()
            cut = rng.integers(0, 45)
            own[120 - cut :] = rng.choice(words, cut)
            texts.append(" ".join(own))
    common = rng.choice(words, 40)
    texts += [" ".join(np.append(common, rng.choice(words, 80))) for _ in range(120)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_duplicates(df).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_short_lines_may_differ_by_fewer_edits(spark):
    """One edit from 10 characters on, two from 20 on, none below; and numbered lines of one template."""
    from tesserae.llm.lines import near_links

    rng = np.random.default_rng(8)
    lines = set()
    for n in [*range(5, 26)] * 3:
        s = "".join(rng.choice(list("abcd "), n)).strip()
        for _ in range(4):
            t = list(s)
            for _ in range(rng.integers(0, 3)):
                k = int(rng.integers(len(t))) if t else 0
                t[k : k + 1] = [[], ["z"], ["y", "x"]][rng.integers(3)]
            lines.add("".join(t))
    lines |= {f"order number {rng.integers(0, 10**5):08d} was shipped today" for _ in range(150)}
    lines = sorted(x for x in lines if x.strip())

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            row, before = [i], row
            for j, d in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != d)))
        return row[-1]

    pairs = sum(distance(a, b) <= min(2, min(len(a), len(b)) // 10) for i, a in enumerate(lines) for b in lines[i + 1 :] if abs(len(a) - len(b)) <= 2)
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert near_links(df).count() == pairs > 100
