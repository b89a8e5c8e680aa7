"""The training-data operators against brute force, and on odd tables."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.llm import bpe, chat, html, secrets, toxicity, vectors
from tesserae.llm.components import components
from tesserae.llm.decontaminate import decontaminate, find_contamination
from tesserae.llm.lines import dedup_lines, near_lines, near_links, within
from tesserae.llm.near_dedup import keep_one, near_duplicates
from tesserae.llm.queries import tokenizer_path
from tesserae.llm.suffixes import intervals, remove_repeats, suffix_array

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Null ids and texts, empty and long texts, ties, repeated rows, and columns whose names clash with the operators' own.
ODD = [(1, "one two three four five six", "en", "a", 27), (1, "one two three four five six", "en", "a", 27), (2, None, "en", None, None), (3, "", None, "a", 0), (None, "one two three four five six", "en", "a", 27), (4, "word " * 30_000, "en", "a", 1), (5, "\n\n  \n", "en", "a", 5), (6, "é ß 漢字 🎉 don't", "fr", "b", 9)]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, DOCS)
    return df.withColumns({c: F.lit(7) for c in ("id", "line", "h", "key", "score", "component_id", "kept", "label")})


def union_find(pairs, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(500, 560)] + [(900, j) for j in range(901, 980)] + [(7, 7)]
    links = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    want = union_find(pairs, {i for p in pairs for i in p})
    linked = {i for a, b in pairs if a != b for i in (a, b)}
    assert got == {i: want[i] for i in linked}
    assert components(links.limit(0)).count() == 0


# --- 1 lines


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_verification_is_the_edit_distance(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(400):
        a = "".join(rng.choice(list("abé"), rng.integers(0, 14)))
        b = list(a)
        for _ in range(rng.integers(0, 5)):
            k = rng.integers(0, len(b) + 1)
            if rng.random() < 0.4:
                b.insert(k, str(rng.choice(list("abé"))))
            elif b:
                b[min(k, len(b) - 1) :][:1] = []
                b = b[: min(k, len(b) - 1)] + b[min(k, len(b) - 1) + (rng.random() < 0.5) :]
        rows.append((a, "".join(b)))
    df = spark.createDataFrame(rows, "x string, y string")
    for edits in (1, 2, 3):
        assert all(r.near == (levenshtein(r.x, r.y) <= edits) for r in df.withColumn("near", F.expr(within("x", "y", edits))).collect())


def test_lines_match_brute_force(spark):
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("abcdefgh "), rng.integers(20, 60))).strip() + "x" * 20 for _ in range(40)]
    docs = []
    for d in range(60):
        lines = []
        for _ in range(6):
            s = list(base[rng.integers(len(base))])
            for _ in range(rng.integers(0, 4)):
                k = int(rng.integers(len(s)))
                s[k : k + 1] = [[], ["z"], [s[k], "q"]][rng.integers(3)]
            lines.append("".join(s))
        docs.append((d, "\n".join(lines)))
    # a segment that many lines share, so that the path of hot segments is taken
    docs += [(100 + i, "shared beginning of a line that is long " + "".join(rng.choice(list("klmnopqrst"), 12))) for i in range(60)]
    docs += [(200 + i, "shared beginning of a line that is long " + "aaaa" + "b" * i) for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lines = sorted({x for _, t in docs for x in t.split("\n")})
    pairs = [(a, b) for i, a in enumerate(lines) for b in lines[i + 1 :] if abs(len(a) - len(b)) <= 2 and levenshtein(a, b) <= 2]
    assert near_links(df).count() == len(pairs) > 20
    want = union_find(pairs, lines)
    first = {}
    for d, t in sorted(docs):
        for k, x in enumerate(t.split("\n")):
            first.setdefault(want[x], (d, k))
    links = Counter(x for p in pairs for x in p)
    text = {(d, k): x for d, t in docs for k, x in enumerate(t.split("\n"))}
    rows = near_lines(df).collect()
    assert len(rows) == len(text)
    for r in rows:
        x = text[r.doc_id, r.line_no]
        assert (r.class_doc_id, r.class_line_no) == first[want[x]] and r.n_links == links[x] and r.kept == (first[want[x]] == (r.doc_id, r.line_no))


def test_odd_lines(spark, odd):
    rows = near_lines(odd).collect()
    assert [r.kept for r in rows if r.doc_id == 1] == [True, True]
    assert [(r.class_doc_id, r.kept) for r in rows if r.doc_id is None] == [(1, False)]
    assert not [r for r in rows if r.doc_id in (2, 3, 5)]
    out = dedup_lines(odd)
    assert out.columns == odd.columns and {r.doc_id for r in out.collect()} == {1, 2, 3, 4, 5, 6}
    assert near_lines(odd.limit(0)).count() == 0 and dedup_lines(odd.limit(0)).count() == 0
    two = spark.createDataFrame([(2, "same line\nother", "en", "a", 15), (1, "same line", "en", "a", 9)], DOCS)
    assert {(r.doc_id, r.text, r.n_chars) for r in dedup_lines(two).collect()} == {(1, "same line", 9), (2, "other", 5)}


# --- 2 toxicity


def test_toxicity_learns_from_documents(spark, odd):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(600):
        s = [" ".join(rng.choice(words, 8)) for _ in range(rng.integers(1, 8))]
        if i % 3 == 0:
            s[rng.integers(len(s))] += " vile"
        texts.append(". ".join(s) + ".")
        labels.append(int(i % 3 == 0))
    model = toxicity.fit(texts[:400], labels[:400])
    df = spark.createDataFrame(list(enumerate(texts[400:])), "doc_id long, text string")
    rows = {r.doc_id: r for r in toxicity.score_toxicity(df, model).collect()}
    assert np.mean([rows[i].predicted == y for i, y in enumerate(labels[400:])]) > 0.98
    for i, text in enumerate(texts[400:]):
        for place in rows[i].offending:
            assert "vile" in text.encode()[place.start : place.end].decode()
    scored = toxicity.score_toxicity(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    assert {r.score for r in scored if r.doc_id in (2, 3)} == {0.0}
    assert toxicity.score_toxicity(odd.limit(0), model).count() == 0
    kept = toxicity.drop_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    for none in ([], [1, 1], [0, 0]):
        assert toxicity.fit(["a b"] * len(none), none).sentence_logits(toxicity.bags(np.frombuffer(b"a b.", np.uint8), np.array([0, 4]))).shape == (1,)


def test_toxicity_on_held_out_rows(spark):
    from tesserae.llm.queries import op2_toxicity

    sf = "/root/testdata/sf0.1"
    truth = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = op2_toxicity(spark, sf).where("held_out").join(truth, "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.95
    assert np.mean([r.predicted for r in rows if r.toxic]) > 0.8


# --- 3 vectors


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(60, 64))
    v = [c + rng.normal(size=64) * s for c in centre for s in (0, 0.1, 0.15, 0.2, 0.4)]
    v += [centre[0] + rng.normal(size=64) * 0.08 for _ in range(700)]  # one dense group
    rows = [(i, [float(x) for x in x], int(i % 2)) for i, x in enumerate(v)]
    rows += [(5000, None, 1), (5001, [0.0] * 64, 1), (5002, [float("nan"), *[1.0] * 63], 1), (5003, rows[0][1], None), (5004, [1.0], 0), (None, rows[0][1], 0), (5005, [1e30 * x for x in rows[0][1]], 0), (5006, [None, *[1.0] * 63], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit(1))
    good = [(i, np.array(e) / np.abs(e).max(), k) for i, e, k in rows if i is not None and e and len(e) == 64 and k is not None and None not in e and np.isfinite(e).all() and np.any(e)]
    m = np.array([e / np.linalg.norm(e) for _, e, _ in good])
    near = (m @ m.T >= 0.93) & (np.array([k for *_, k in good])[:, None] == np.array([k for *_, k in good])[None, :])
    np.fill_diagonal(near, False)
    ids = [i for i, *_ in good]
    root = union_find([(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True) if a < b], ids)
    degree = dict(zip(ids, near.sum(1).tolist(), strict=True))
    got = vectors.near_vectors(df).collect()
    assert len(got) == len(rows)
    found, all_links = sum(r.n_links for r in got), sum(degree.values())
    assert 0.99 * all_links <= found <= all_links
    assert np.mean([r.n_links == degree.get(r.vec_id, 0) and r.component_id == root.get(r.vec_id, r.vec_id) for r in got]) > 0.99
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]
    assert vectors.near_vectors(df.limit(0)).count() == 0
    twice = vectors.near_vectors(df.where("vec_id < 20").union(df.where("vec_id = 3"))).where("vec_id = 3").collect()
    assert len(twice) == 2 and twice[0] == twice[1]


def test_widths_are_kept_apart(spark):
    rows = [(1, [1.0], 0), (2, [2.0], 0), (3, [1.0, 0.0], 0), (4, [5.0, 0.1], 0), (5, [], 0), (6, [-1.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (0, 6)}


def test_big_buckets_are_compared_in_parts(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PART", 40)
    rng = np.random.default_rng(2)
    c = rng.normal(size=64)
    rows = [(i, [float(x) for x in c + rng.normal(size=64) * 0.1], 0) for i in range(300)]
    m = np.array([e for _, e, _ in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = (m @ m.T >= 0.93).sum(1) - 1
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert [got[i] for i in range(300)] == want.tolist()


# --- 4 decontamination


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_decontamination(spark, odd):
    long = " ".join(f"b{i}" for i in range(30))
    bench = spark.createDataFrame([(1, long.upper()), (2, "Tiny item"), (3, None), (4, "--"), (5, long), (6, "solo")], "item_id long, text string")
    docs = [(1, f"x {long} y"), (2, "a tiny, ITEM here and " + "z " * 100), (3, "b0 b1 b2"), (4, None), (5, ""), (6, f"{' '.join(long.split()[:13])}"), (7, "tiny tiny item item solo"), (None, long), (8, "É!" + long.replace(" ", "--"))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("w", F.lit(1))
    items = {i: words(t) for i, t in [(1, long), (2, "tiny item"), (5, long), (6, "solo")]}
    got = {r.doc_id: r for r in find_contamination(df, bench).collect()}
    for i, text in docs:
        w, hit, seen = words(text), set(), set()
        for item, b in items.items():
            n = min(13, len(b))
            grams = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)}
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    seen.add(item)
        r = got[i]
        assert (r.n_words, r.n_hit, list(r["items"])) == (len(w), len(hit), sorted(seen))
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
    assert {r.doc_id for r in decontaminate(df, bench).collect()} == {2, 3, 4, 5}
    cut = {r.doc_id: r.text for r in decontaminate(df, bench, remove="spans").collect()}
    assert words(cut[1]) == ["x", "y"] and words(cut[2])[:3] == ["a", "here", "and"] and words(cut[8]) == ["É".lower()] or words(cut[8]) == ["É"]
    assert cut[3] == "b0 b1 b2" and cut[4] is None
    assert find_contamination(odd, bench).count() == odd.count() and find_contamination(odd.limit(0), bench).count() == 0
    assert {r.n_hit for r in find_contamination(odd, bench.limit(0)).collect()} == {0}
    assert decontaminate(odd, bench).columns == odd.columns
    assert find_contamination(df, bench, most_bytes=0).where("contaminated").count() == find_contamination(df, bench).where("contaminated").count()


# --- 5 chat

PIECES = st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "<|nl|>", "<\\|im_end|>", "<\\\\|nl|>", "<", "|", "\\", "\n", "im_end", ">", "é", "x", "assistant"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES, PIECES, PIECES)
def test_chat_round_trip(role, text, other):
    shown = chat.render(role, text) + chat.render("user", other)
    assert chat.parse_all(shown) == [(role, text), ("user", other)]


def test_chat_table(spark):
    rows = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", None), (1, None, None, "first"), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit(9))
    got = {r.conv_id: r for r in chat.format_chat(df).collect()}
    assert set(got) == {1, 2, None} and got[1].n_turns == 3 and got[2].n_turns == 2
    assert got[1].turns_sha256 == hashlib.sha256("\nfirst\nuser\n\nassistant\nb<|im_end|>\n".encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(b"b<|im_end|>").hexdigest() and got[1].loss_chars == 11
    assert [chat.unescape(got[1].formatted[a:b]) for a, b in got[1].loss_spans] == ["b<|im_end|>"]
    assert got[1].formatted_chars == len(got[1].formatted)
    assert chat.format_chat(df.limit(0)).count() == 0
    short = {r.conv_id: r for r in chat.format_chat(df, keep_text=False).collect()}
    assert all(short[k].turns_sha256 == got[k].turns_sha256 for k in got)


# --- 6 HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>a<p>b", "a\n\nb"),
        ("x<br>y<br><br>z", "x\ny\n\nz"),
        ("<ul><li>a<li>b<ol start=3><li>c</ol></ul>", "- a\n- b\n  3. c"),
        ("<table><tr><th>k<th>value<tr><td>long key<td>v</table>", "k         value\nlong key  v"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<div hidden>no</div><p style='display: none'>no</p><script>var x='</p>'</script><style>p{}</style>yes", "yes"),
        ("<head><title>t</title></head><body>a &amp; b &lt;c&gt;</body>", "a & b <c>"),
        ("<pre>  k\n   l</pre>after", "  k\n   l\n\nafter"),
        ("a <b>b</b>  <i> c</i>", "a b c"),
        ("<!-- x --><!DOCTYPE html><p>1 < 2", "1 < 2"),
        ("<p title=it's>q</p><a href='x", "q\n\n<a href='x"),
        ("</p></div>t<td>u", "tu"),
        ("", ""),
        (None, ""),
    ],
)
def test_html(page, text):
    assert html.extract(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>so <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x=2</annotation></semantics></math>.", "so x=2."),
        ("<math><mtable><mtr><mtd>1</mtd><mtd>2</mtd></mtr><mtr><mtd>3</mtd><mtd>4</mtd></mtr></mtable></math>", "1 2\n3 4"),
        ("a<svg><title>t</title><desc>d</desc><style>s{}</style><defs><text>u</text></defs><path d='M0'/><text>North</text><text>So<tspan>uth</tspan></text><script>x</script></svg><desc>b", "a\nNorth\nSouth\nb"),
        ("hue: <select><option>red<option selected>blue<option>green</select>!", "hue: blue !"),
        ("<select><optgroup disabled><option>a<optgroup label=g><option>b</select>", "b"),
        ("<select><option disabled selected hidden>Choose<option>b</select>", "Choose"),
        ("<select><option>a<option label=Q>b<input><p>c", "a\n\nc"),
        ("<select multiple><optgroup label=g><option>a<option label=Q>b</select>c", "g\na\nQ\nc"),
        ("<p>x<textarea>\n1 &lt; 2\n  <b>3</textarea>y", "x 1 < 2\n  <b>3 y"),
        ("<select hidden><option>a</select><textarea style='display:none'>b</textarea><datalist><option>c</datalist>", ""),
    ],
)
def test_html_shows_formulas_labels_and_fields(page, text):
    assert html.extract(page) == text


def test_html_table(spark):
    rows = [(1, "<p>a</p>" * 3), (1, "<p>a</p>" * 3), (2, None), (None, "<b>x"), (3, "<div>" * 30_000 + "deep"), (4, "<a " * 2000)]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("clash"))
    got = [(r.page_id, r.text, r.n_lines) for r in html.extract_text(df).collect()]
    assert got[:4] == [(1, "a\n\na\n\na", 5), (1, "a\n\na\n\na", 5), (2, "", 0), (None, "x", 1)] and got[4][1] == "deep"
    assert html.extract_text(df.limit(0)).count() == 0


# --- 7 suffixes


def strip(texts, n=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + n] for b in raw for i in range(len(b) - n + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i] += 1
                gone[i + n] -= 1
        out.append(bytes(np.frombuffer(b, np.uint8)[np.cumsum(gone)[: len(b)] == 0]))
    return out


def test_repeats_match_brute_force(spark, odd, monkeypatch):
    rng = np.random.default_rng(7)
    text = lambda n: "".join(rng.choice(list("abcdé "), n))
    shared = [text(n) for n in (150, 199, 200, 230, 400, 900)]
    docs = [text(rng.integers(0, 400)) + "".join(shared[k] + text(30) for k in rng.integers(0, 6, 2)) for _ in range(40)]
    docs += ["ab" * 300, "x" * 700, docs[0], docs[0], None, "", shared[2], "\0" * 250 + text(50)]
    docs += [shared[3][:120] + text(200) for _ in range(30)]  # an anchor in many different places
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string").withColumn("body", F.lit(1))
    want = strip(docs)
    for most in (5000, 3):
        monkeypatch.setattr("tesserae.llm.suffixes.MOST_KINDS", most)
        got = {r.doc_id: r for r in remove_repeats(df).collect()}
        assert [bytes(got[i].kept) for i in range(len(docs))] == want
        for i, t in enumerate(docs):
            assert got[i].n_bytes == len((t or "").encode()) and got[i].n_removed == got[i].n_bytes - len(want[i]) == sum(b - a for a, b in got[i].spans)
    rows = remove_repeats(odd, digest=True).collect()
    assert len(rows) == odd.count() and remove_repeats(odd.limit(0)).count() == 0
    assert {r.n_removed for r in rows if r.doc_id in (2, 3)} == {0}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=40), min_size=1, max_size=4))
def test_suffix_array_sorts_suffixes(texts):
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    every = np.arange(len(data))
    rank, _, _ = suffix_array(data, offsets, every)
    suffix = [t[i:] for t in texts for i in range(len(t))]
    assert [suffix[i] for i in np.argsort(rank, kind="stable")] == sorted(suffix)


def test_intervals_nest():
    assert intervals(np.array([0, 2, 5, 5, 2, 0, 3]), 2) == [(1, 3, 5), (0, 4, 2), (5, 6, 3)]


# --- 8 near duplicates


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates_match_brute_force(spark, odd):
    rng = np.random.default_rng(4)
    vocabulary = [f"v{i}" for i in range(3000)]
    texts = []
    for _ in range(30):
        base = list(rng.choice(vocabulary, rng.integers(8, 120)))
        for _ in range(rng.integers(1, 6)):
            own = list(base)
            for k in rng.integers(0, len(own), rng.integers(0, 5)):
                own[k] = str(rng.choice(vocabulary))
            texts.append(" ".join(own))
    big = list(rng.choice(vocabulary, 150))  # a group in which not all pairs link
    for _ in range(350):
        own = list(big)
        for k in rng.integers(0, 150, rng.integers(0, 7)):
            own[k] = str(rng.choice(vocabulary))
        texts.append(" ".join(own))
    texts += [texts[0], texts[0].upper(), "", None, "just three words", "Just  three\twords", "a", " \n "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("node", F.lit(1))
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * (n := len(sets[i] & sets[j])) >= 75 * (len(sets[i]) + len(sets[j]) - n)]
    want = union_find(pairs, range(len(texts)))
    got = {r.doc_id: r for r in near_duplicates(df).collect()}
    for i, s in enumerate(sets):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), want[i], want[i] == i), i
    rows = near_duplicates(odd).collect()
    assert len(rows) == odd.count() and [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert near_duplicates(odd.limit(0)).count() == 0
    kept = keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1


# --- 9 secrets


def naive(text):
    out = []
    for kind, pattern, flags in (("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), ("access", r"AKIA[A-Z0-9]+", 0), ("hex", r"[0-9a-f]+", 0)):
        for m in re.finditer(pattern, text, flags):
            if {"assign": lambda m: len(m[1]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}[kind](m):
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda x: (x[0], ("assign", "access", "hex").index(x[2])))


SECRET = st.lists(st.sampled_from(["password", "PassWd", "api_key", "apikey", "ToKen", "ſecret", "=", ":", " ", '"', "'", "AKIA", "ABCD1234ABCD1234", "deadbeef" * 3, "abc", "x=y", "é", "\n", "zzzzzz"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(SECRET)
def test_base_spans(text):
    base, spans = secrets.scan(text)
    assert base == naive(text) and set(base) <= set(spans)


def test_lexer_and_table(spark, odd):
    text = 'greeting = "hello"\nk = "q8Z7xx12"\ndb_password = k + "yy99"\nauthToken: "9fK2lmQ0aa"\nname = "plain words here"'
    found = {text[a:b]: n for a, b, n, _ in secrets.lexed_spans(text)}
    assert found == {"q8Z7xx12": "db_password", "yy99": "db_password", "9fK2lmQ0aa": "authToken"}
    row = secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [f.name for f in row.found if f.kind == "lexed"] == ["db_password", "db_password", "authToken"] and row.n_assign == 1
    assert secrets.scan_secrets(odd).count() == odd.count() and secrets.scan_secrets(odd.limit(0)).count() == 0


def test_lexer_needs_no_quotes():
    for text in ("db_pwd = 9f8a7b6c5d4e", "mode: fast\nDB_PWD: 9f8a7b6c5d4e\n"):
        assert [text[a:b] for a, b, _, _ in secrets.lexed_spans(text)] == ["9f8a7b6c5d4e"]
        assert secrets.lexed_spans(text + "\nit's") == secrets.lexed_spans(text)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("client_passphrase=hunter2xyz", {"hunter2xyz": "client_passphrase"}),
        ("mode: x\nDB_PWD: Zk3a!bc-9 # live\r\n  credential = abcdefghijk,\n", {"Zk3a!bc-9": "DB_PWD", "abcdefghijk": "credential"}),
        ("A=1 DB_PWD=hunter2xyz B=2", {"hunter2xyz": "DB_PWD"}),
        ("A= DB_PWD=hunter2xyz", {"hunter2xyz": "DB_PWD"}),
        ("export client_credential=YWJjZGVmZ2hpagx=\nDB_PWD: YWJj=Zk3\n", {"YWJjZGVmZ2hpagx=": "client_credential", "YWJj=Zk3": "DB_PWD"}),
        ('pwd: str = "q8Z7xx12"', {"q8Z7xx12": "pwd"}),
        ('let passphrase: string = "q8Z7xx12";', {"q8Z7xx12": "passphrase"}),
        ("f(pwd: Optional[Dict[str, str]] | None = 'q8Z7xx12')", {"q8Z7xx12": "pwd"}),
        ("let pwd: &'static str = \"q8Z7xx12\";", {"q8Z7xx12": "pwd"}),
        ('else: pwd = "q8Z7xx12"', {"q8Z7xx12": "pwd"}),
        ('if pwd: name = "q8Z7xx12"', {}),
        ('base = "q8Z7xx12"\npwd = base', {"q8Z7xx12": "pwd"}),
        ("pwd = getpass.getpass('word 1')\npwd = ${DB_PWD}\npwd: string;\npwd = os.environ['X']", {}),
        ('credentials = {"pwd": "q8Z7xx12"}', {"q8Z7xx12": "pwd"}),
        ('pwd=hunter2xyz;authToken="9fK2lmQ0aa"', {'hunter2xyz;authToken="9fK2lmQ0aa"': "pwd", "9fK2lmQ0aa": "authToken"}),
    ],
)
def test_unquoted_and_declared(text, found):
    assert {text[a:b]: n for a, b, n, _ in secrets.lexed_spans(text)} == found


def test_long_values_are_scored():
    long = "q8Z7xx12" * 1000
    assert [(b - a, n) for a, b, n, _ in secrets.lexed_spans(f'credential = "{long}"')] == [(8000, "credential")]
    assert len(secrets.lexed_spans("pwd = " + " + ".join(f'"k{i}Zx"' for i in range(100)))) == 100
    text = 'k = "old8Z7xx"\n' + f'k = "{long}"\npwd = k\nk = f(1)\nclient_pwd = k\n'
    assert [(b - a, n) for a, b, n, _ in secrets.lexed_spans(text)] == [(8000, "pwd")]
    grown = 'k = "q8Z7xx12"\n' + "k = k + k\n" * 2000 + 'pwd = k + "y"\n'
    assert [grown[a:b] for a, b, _, _ in secrets.lexed_spans(grown)] == ["q8Z7xx12", "y"]


# --- 10 BPE


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path()), bpe.Encoder(bpe.Merges.load(tokenizer_path()))


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(["aaaa", " ", "\n", "<|endoftext|>", "'ll", "'S", "é", "漢", "12", " the", " ", "\x85", "ing"]), max_size=15).map("".join)))
def test_bpe_equals_the_library(tokenizer, text):
    library, own = tokenizer
    ids = [x for w in own.encode([text])[0] for x in w]
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert b"".join(own.merges.pieces[i] for i in ids).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


def test_bpe_table(spark, odd, tokenizer):
    library = tokenizer[0]
    long = "ab" * 20_000
    df = odd.unionByName(spark.createDataFrame([(9, long, "en", "a", 1)], DOCS), allowMissingColumns=True)
    for r in bpe.bpe_encode(df, tokenizer_path()).collect():
        assert library.decode(r["ids"], skip_special_tokens=False) == r.decoded
    whole = {r.doc_id: r for r in bpe.bpe_digests(df, tokenizer_path()).collect()}
    ids = library.encode(long, add_special_tokens=False).ids
    assert whole[9].n_tokens == len(ids) and whole[9].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert whole[2].n_tokens == 0 and whole[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.bpe_encode(odd.limit(0), tokenizer_path()).count() == 0
