"""Assignments that one line of name and value doesn't show, comments, time in proportion, and a whole query's digests."""

import hashlib
import re
import time

import pytest

from tesserae.llm.queries import op9_secret_scan
from tesserae.llm.secrets import base_spans, comments, lexed_spans, scan

from ..oracle import SF

FORMS = {
    'cfg["db_pwd"] = "q8Z7xx12aa"': ["q8Z7xx12aa"],
    "cfg['a']['db_pwd'] = 'q8Z7xx12aa'": ["q8Z7xx12aa"],
    'user, pwd = "bob", "q8Z7xx12aa"': ["q8Z7xx12aa"],
    'pwd = ("q8Z7"\n       "xx12aa99")': ["q8Z7", "xx12aa99"],
    'pwd = "q8Z7" + \\\n   "xx12aa99"': ["q8Z7", "xx12aa99"],
    'pwd = "q8Z7" +\n   "xx12aa99"': ["q8Z7", "xx12aa99"],
    'pwd = "q8Z7xx"\npwd += "12aa99"': ["q8Z7xx", "12aa99"],
    'const pwd string = "q8Z7xx12aa"': ["q8Z7xx12aa"],
    '#define DB_PWD "q8Z7xx12aa"': ["q8Z7xx12aa"],
    'pwd = """q8Z7xx12aa\nzz"""': ["q8Z7xx12aa\nzz"],
    "private_key: |\n  MIIEq8Z7xx12aa\n  zz88Yy\nother: 1": ["MIIEq8Z7xx12aa", "zz88Yy"],
    "api_tokens:\n  - q8Z7xx12aa\n  - 'zz88Yy1122'\nx: 1": ["q8Z7xx12aa", "zz88Yy1122"],
    '<add key="pwd" value="q8Z7xx12aa"/>': ["q8Z7xx12aa"],
    '<add value="q8Z7xx12aa" name="pwd"/>': ["q8Z7xx12aa"],
    'a = "q8Z7xx12"\n# a = 5\npwd = a': ["q8Z7xx12"],
    'a = "q8Z7xx12"\npwd = f"{a}z9"': ["q8Z7xx12", "z9"],
    '# pwd = "q8Z7xx12"': ["q8Z7xx12"],
    '/* x\n a = "q8Z7xx12" */ pwd = a': [],
    "user, name = 'bob', 'q8Z7xx12aa'": [],
    "items:\n  - q8Z7xx12aa": [],
}


@pytest.mark.parametrize("text", sorted(FORMS))
def test_forms(text):
    found = [text[a:b] for a, b, _, _ in lexed_spans(text)]
    assert [x for x in found if "{" not in x] == FORMS[text]


def test_comments():
    text = "a # b\n// c\nx = 'http://d' /* e\n f */ g\n#define H 1\n-- i"
    assert [text[a:b] for a, b in comments(text)] == ["# b", "// c", "/* e\n f */", "-- i"]


@pytest.mark.parametrize("unit", ["pwd = (", "token: |\n", 'key["', 'pwd = """', "<a key='x' ", "a, b, ", "/*", "pwd = 'x' + \\\n", "secret:\n - a\n", "password", "f'{a}", "token = token + "])
def test_time_in_proportion(unit):
    began = time.perf_counter()
    scan(unit * (200_000 // len(unit)))
    assert time.perf_counter() - began < 15


def test_whole_query(spark):
    """Base spans by a plain reading of their rules, and all spans of every document."""
    rows = {r["doc_id"]: r for r in op9_secret_scan(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    kinds = {"assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII, 2, 6), "access": ("(AKIA[A-Z0-9]+)", 0, 1, 20), "hex": ("([0-9a-f]+)", 0, 1, 24)}
    assert len(rows) == len(docs)
    for d in docs:
        text, found = d["text"] or "", []
        for k, (name, (pattern, flags, group, least)) in enumerate(kinds.items()):
            found += [(m.start(), k, m.end(), name) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
        base = ",".join(f"{name}:{a}:{b}" for a, _, b, name in sorted(found))
        r = rows[d["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and r["spans"].split(",") == ",".join(f"{k}:{a}:{b}" for a, b, k in scan(text)[1]).split(",")
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[3] == n for x in found) for n in kinds]
        assert {f"{k}:{a}:{b}" for a, b, k in base_spans(text)} <= set(r["spans"].split(",")) or not found
