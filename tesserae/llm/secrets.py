"""Secret scanning: three base patterns and an assignment-aware lexer.

The lexer reads lines that look like source or configuration (a name, ``=``, ``:`` or ``=>``, then strings,
numbers, names and ``+``, or in configuration an unquoted value up to the line's end), and forms that go over lines or
name their target otherwise (brackets, sums, triple quotes, subscripts, tuples, typed declarations, macros, block scalars,
lists, elements). It keeps the constants that it has seen in the text, and so finds the literals that reach a name,
directly or through other names. A literal is scored by the words of the names that it reaches
and by how random it looks; spans that score enough are added to those of the base patterns.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Container, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, sha_hex, text_buffers

KINDS = ("assign", "access", "hex", "lexed")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_HINT = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

_NAME = r"[A-Za-z_$][\w$.\-]*"
_TERM = rf"""(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`|{_NAME}|[0-9][\w.]*)"""
_OP = r"(:=|=>|(?<![=!<>])=(?!=)|:(?!:))"
#: A name that something is assigned to; the first group only matches at the start of a line.
_HEAD = re.compile(rf"""(?:(^[ \t]*(?:(?:export|set|ENV|-)[ \t]+)?)|(?<![\w$.\-]))["']?({_NAME})["']?[ \t]*{_OP}[ \t]*""", re.ASCII | re.MULTILINE)
_NEXT = re.compile(rf"({_NAME})([ \t]*){_OP}([ \t]*)", re.ASCII)
_VALUE = re.compile(rf"{_TERM}(?:[ \t]*\+[ \t]*{_TERM})*+", re.ASCII)
_DECLARED = re.compile(r"([^\n=:;\"`(){}]++):?=(?![=>])[ \t]*")
_TYPE = re.compile(r"[&*]*(?:'\w+[ \t]+)?(?:(?:mut|const|static|dyn|readonly)[ \t]+)*[A-Za-z_$][\w$.]*[?!]?(?:[ \t]*\|[ \t]*[A-Za-z_$][\w$.]*[?!]?)*", re.ASCII)
_BRANCH = re.compile(r"\b(?:if|elif|while|for|in|is|and|or|not|case|lambda|with|except|as)[ \t]\Z")
_QUOTES = ("'", '"', "`")
_COMMENT = re.compile(r"[ \t]#")
_BESIDE = re.compile(rf"(?<=[ \t])[\"']?{_NAME}=(?=[^\s=])", re.ASCII)
#: Right sides that are expressions: containers, references, calls, subscripts, attributes of usual objects, operators.
_EXPRESSION = re.compile(rf"[\[({{<].*|[$%][({{].*|{_NAME}(?:\(.*\).*|\[.*\].*|[(\[{{])|(?:self|this|cls|process|os|env|environ|config|cfg|settings|options|args|request|req|params)\.{_NAME}|(?:new|await|not|lambda|function|async)[ \t].*", re.ASCII)
_TERMS = re.compile(_TERM, re.ASCII)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Weights of the words in a target's name.
SENSITIVE = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 2, "credential": 3, "credentials": 3, "apikey": 3, "api": 1, "key": 1, "auth": 1, "private": 1, "access": 1, "bearer": 2, "signing": 1, "client": 0, "session": 1, "salt": 1}
_TYPES = {"string", "boolean", "integer", "number", "object", "optional"}
_PLAIN = {"none", "null", "true", "false", "undefined", "changeme", "example", "placeholder"}

_LONGEST_PLAIN = max(map(len, _PLAIN))
#: Without one of these words no name is sensitive.
_ANY = re.compile("passw|passphrase|pwd|secret|token|credential|api|key|auth|private|access|bearer|signing|session|salt", re.IGNORECASE)

_STRING = r"""(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
_PIECE = rf"(?:[bBuUrRfF]{{0,2}}{_STRING}|{_NAME})"
#: Strings and names that are joined over lines: in brackets, or by an operator or a backslash at a line's end.
_BRACKETED = rf"\(\s*+{_PIECE}(?:\s*+(?:\+\s*+)?{_PIECE})*+\s*+(?:,\s*+)?\)"
_JOINED = rf"{_PIECE}(?:[ \t]*(?:\\\r?\n[ \t]*)?\+[ \t]*(?:\\?\r?\n[ \t]*)?{_PIECE}|[ \t]*\\\r?\n[ \t]*{_PIECE}|[ \t]*\r?\n[ \t]*\+[ \t]*{_PIECE})*+"
_LONG_VALUE = rf"(?:{_BRACKETED}|{_JOINED})"
_PIECES = re.compile(rf"([bBuUrRfF]{{0,2}})({_STRING})|({_NAME})", re.ASCII)
_FIELD = re.compile(rf"\{{({_NAME})(?:[:!][^{{}}]*)?\}}", re.ASCII)
#: Names with values that one line doesn't hold, sums (+=), subscripts and typed declarations before a name.
_WIDE = re.compile(rf"""(?:(?<![\w$.\-"'\]])({_NAME})|\[[ \t]*["']({_NAME})["'][ \t]*\])[ \t]*(?::[ \t]*{_NAME}[ \t]*)?(\+=|:=|=(?![=>]))[ \t]*({_LONG_VALUE})""", re.ASCII)
_GO = re.compile(rf"^[ \t]*+(?:(?:const|var|let|val|static|final|public|private)[ \t]++)++({_NAME})[ \t]++[*\[\]\w.]+[ \t]*=[ \t]*({_STRING}|`[^`]*`)", re.ASCII | re.MULTILINE)
_DEFINE = re.compile(rf"^[ \t]*#[ \t]*define[ \t]+({_NAME})[ \t]+({_STRING}|[^\s(]\S*)", re.ASCII | re.MULTILINE)
_TUPLE = re.compile(rf"^[ \t]*({_NAME}(?:[ \t]*,[ \t]*{_NAME})++)[ \t]*:?=[ \t]*({_PIECE}(?:[ \t]*,[ \t]*{_PIECE})++)", re.ASCII | re.MULTILINE)
_TRIPLE = re.compile(rf"""(?<![\w$.\-])({_NAME})["']?[ \t]*+(?::[ \t]*+{_NAME}[ \t]*+)?[:=][ \t]*+[bBuUrRfF]{{0,2}}(\"\"\"|\'\'\')""", re.ASCII)
_BLOCK_SCALAR = re.compile(rf"""^([ \t]*)(?:-[ \t]+)?["']?({_NAME})["']?[ \t]*+:[ \t]*+(?:[|>][+\-0-9]*+[ \t]*+)?\r?\n""", re.ASCII | re.MULTILINE)
_ITEM = re.compile(r"[ \t]*-[ \t]+(.*)")
_ELEMENT = re.compile(r"<[A-Za-z][^<>]*>")
_PAIR = re.compile(rf"""\b(key|name|id|value)[ \t]*=[ \t]*("[^"]*"|'[^']*')""", re.ASCII | re.IGNORECASE)
_ASIDE = re.compile(r"(?:^|(?<=[ \t]))(?:#(?![ \t]*define\b)|//|--[ \t])[^\n]*|/\*", re.ASCII | re.MULTILINE)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of each base match, in code points."""
    out = []
    if _HINT.search(text):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def sensitivity(name: str) -> int:
    words = [w.lower() for w in _PARTS.findall(name)]
    each = {*words, *(a + b for a, b in zip(words, words[1:], strict=False))}
    return sum(SENSITIVE.get(w, SENSITIVE.get(w.removesuffix("s"), 0)) for w in each)


def entropy(count: Counter[str], n: int) -> float:
    return -sum(p * math.log2(p) for c in count.values() if (p := c / n))


class Node:
    """Where a value comes from: places in the text and nodes of other values; best: score, order and name it reaches."""

    __slots__ = ("best", "parts")

    def __init__(self, parts: list[tuple[int, int] | Node]):
        self.parts, self.best = parts, None


class Constant:
    """A value of any length: its node, its size and how often it holds each character; ``short`` is the value itself
    where it may be one of _PLAIN."""

    __slots__ = ("count", "node", "short", "size")

    def __init__(self, text: str, parts: list[tuple[int, int] | Constant]):
        self.node = Node([x.node if isinstance(x, Constant) else x for x in parts])
        if len(parts) == 1 and isinstance(parts[0], Constant):
            self.count, self.size, self.short = parts[0].count, parts[0].size, parts[0].short
            return
        self.count = Counter()
        for part in parts:
            if isinstance(part, Constant):
                for c, n in part.count.items():
                    self.count[c] += n
            else:
                self.count.update(text[part[0] : part[1]])
        self.size = sum(self.count.values())
        self.short = "".join([x.short if isinstance(x, Constant) else text[x[0] : x[1]] for x in parts]) if self.size <= _LONGEST_PLAIN else None


def _is_type(text: str) -> bool:
    """Whether text is a type as declarations have it between ':' and '='; what stands in brackets isn't looked at."""
    depth, plain = 0, []
    for c in text:
        depth += c in "[<"
        if not depth:
            plain.append(c)
        depth -= c in "]>" and depth > 0
    return not depth and bool(_TYPE.fullmatch("".join(plain).strip()))


def statements(text: str, known: Container[str]) -> Iterator[tuple[int, list[str], list[tuple[int, int, str | None]]]]:
    """The assignments of a text, in order: place, names, and the terms of the value: start, end, and the name of a constant or
    None for a literal. known: the constants so far.

    ``a = b = "x"`` and ``a: b = "x"`` (a may be declared with type b, or b be set in a branch of a) assign to both. A
    line that begins with its name is configuration: an unquoted value is a literal up to the line's end, a comment or
    the next ``name=``, unless it is an expression or made of known constants.
    """
    at, beside, end = 0, -1, -1
    while m := _HEAD.search(text, at):
        names, at, op = [m[2]], m.end(), m[3]
        first = m[1] is not None or m.start(2) == beside
        branch = op == ":" and m[1] is None and _BRANCH.search(text, max(0, m.start() - 12), m.start())
        while n := _NEXT.match(text, at):
            after = text[n.end() : n.end() + 1]
            if first and (not (n[2] or n[4] or after in _QUOTES) or after in ("", "\n", "\r", "#")):
                if n[3] == "=" and text[at - 1] in " \t":
                    beside = at
                break  # an operator inside an unquoted value
            if branch:
                names, branch = [], None
            names.append(n[1])
            at, op = n.end(), n[3]
        if op == ":" and (d := _DECLARED.match(text, at)) and (not first or d[1][-1] in " \t" or text[d.end() : d.end() + 1] in _QUOTES) and _is_type(d[1]):
            at = d.end()
        v = _VALUE.match(text, at)
        found = list(_TERMS.finditer(text, at, v.end())) if v else []
        terms = [(t.start() + 1, t.end() - 1, None) if t[0][0] in _QUOTES else (t.start(), t.end(), None if t[0][0].isdigit() else t[0]) for t in found]
        if first and not any(t[0][0] in _QUOTES for t in found):
            if at > end:
                end = text.find("\n", at)
                end = len(text) if end < 0 else end
                if c := _COMMENT.search(text, at - 1, end):
                    end = max(at, c.start())
            stop = end
            if c := _BESIDE.search(text, at + 1, end):
                stop = c.start()
                beside = stop + (text[stop] in _QUOTES)
            raw = text[at:stop].rstrip(" \t\r,;")
            if not v or v.end() < at + len(raw) or not any(name in known for _, _, name in terms):
                yield m.start(2), names, [(at, at + len(raw), None)] if raw and raw.lower() not in _TYPES and not _EXPRESSION.fullmatch(raw) else []
                continue
        yield m.start(2), names, terms
        at = v.end() if v else at


def _quoted(text: str, start: int, end: int) -> tuple[int, int, None]:
    return start + 1, end - 1, None


def _terms_of(text: str, start: int, end: int) -> list[tuple[int, int, str | None]]:
    """The strings and names of a value; of a formatted string its plain parts and the names in its fields."""
    out: list[tuple[int, int, str | None]] = []
    for m in _PIECES.finditer(text, start, end):
        if m[3]:
            out.append((m.start(), m.end(), m[3]))
        elif "f" not in m[1].lower():
            out.append(_quoted(text, *m.span(2)))
        else:
            at, stop = m.start(2) + 1, m.end(2) - 1
            for f in _FIELD.finditer(text, at, stop):
                out += [(at, f.start(), None)] if f.start() > at else []
                out.append((f.start(1), f.end(1), f[1]))
                at = f.end()
            out += [(at, stop, None)] if stop > at else []
    return out


def wide_statements(text: str) -> list[tuple[int, list[str], list[tuple[int, int, str | None]], bool]]:
    """Assignments in forms that one line of name and value doesn't show: place, names, terms, and whether they are added to
    what the name holds. Values over several lines, in brackets or triple quotes, sums, subscripts, tuples, typed
    declarations, macros, block scalars and lists of configuration, elements with a key and a value."""
    out: list[tuple[int, list[str], list[tuple[int, int, str | None]], bool]] = []
    for m in _WIDE.finditer(text):
        raw, subscript = m[4], m[2] is not None
        if subscript or m[3] == "+=" or raw[0] == "(" or "\n" in raw or raw[:2].lower() in ('f"', "f'"):
            out.append((m.start(1) if m[1] else m.start(2), [m[1] or m[2]], _terms_of(text, *m.span(4)), m[3] == "+="))
    for m in _GO.finditer(text):
        out.append((m.start(1), [m[1]], [_quoted(text, *m.span(2))], False))
    for m in _DEFINE.finditer(text):
        out.append((m.start(1), [m[1]], [_quoted(text, *m.span(2)) if m[2][0] in _QUOTES else (*m.span(2), None)], False))
    for m in _TUPLE.finditer(text):
        names, values = re.findall(_NAME, m[1], re.ASCII), list(_PIECES.finditer(text, *m.span(2)))
        if len(names) == len(values):
            out += [(m.start(1) + k, [name], _terms_of(text, *v.span()), False) for k, (name, v) in enumerate(zip(names, values, strict=True))]
    at, absent = 0, set()
    while m := _TRIPLE.search(text, at):
        end = -1 if m[2] in absent else text.find(m[2], m.end())
        if end < 0:
            absent.add(m[2])
        else:
            out.append((m.start(1), [m[1]], [(m.end(), end, None)], False))
        at = m.end() if end < 0 else end + 3
    at = 0
    while m := _BLOCK_SCALAR.search(text, at):
        at, deep, scalar = m.end(), len(m[1]), m[0].rstrip()[-1:] != ":"
        lines: list[tuple[int, int, None]] = []
        while at < len(text):
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            line = text[at:end]
            body = line.strip()
            if body and len(line) - len(line.lstrip()) <= deep - (not scalar and body[:2] == "- "):
                break
            if not scalar and body:
                item = _ITEM.match(line)
                if not item:
                    break
                value = item[1].strip()
                if value and not re.match(rf"{_NAME}[ \t]*[:=]", value, re.ASCII):
                    begin = at + item.start(1)
                    out.append((begin, [m[2]], [_quoted(text, begin, begin + len(value)) if value[0] in _QUOTES and value[-1] == value[0] and len(value) > 1 else (begin, begin + len(value), None)], False))
            elif body:
                lines.append((at + line.index(body), at + line.index(body) + len(body), None))
            at = end + 1
        if lines:
            out.append((m.start(2), [m[2]], lines, False))
        at = max(m.end(), min(at, len(text)))
    for e in _ELEMENT.finditer(text):
        found = {p[1].lower(): p for p in reversed(list(_PAIR.finditer(text, *e.span())))}
        name = next((found[k][2][1:-1] for k in ("key", "name", "id") if k in found), None)
        if name and "value" in found:
            out.append((e.start(), [name], [_quoted(text, *found["value"].span(2))], False))
    return sorted(out, key=lambda x: x[0])


def comments(text: str) -> list[tuple[int, int]]:
    """Where comments stand: behind #, // or -- that begin a line or follow a space, and between /* and */."""
    out, at = [], 0
    while m := _ASIDE.search(text, at):
        end = m.end()
        if m[0] == "/*":
            end = text.find("*/", m.end())
            end = len(text) if end < 0 else end + 2
        out.append((m.start(), end))
        at = max(end, m.end())
    return out


def all_statements(text: str, known: Container[str]) -> Iterator[tuple[int, list[str], list[tuple[int, int, str | None]], bool]]:
    """statements and wide_statements by place; of one place the former come first."""
    wide, k = wide_statements(text), 0
    for place, names, terms in statements(text, known):
        while k < len(wide) and wide[k][0] < place:
            yield wide[k]
            k += 1
        yield place, names, terms, False
    yield from wide[k:]


def lexed_spans(text: str, least: float = 4.0) -> list[tuple[int, int, str, float]]:
    """Start, end, name and score of the literals that reach a sensitive name.

    Constants are propagated in text order: ``a = "x"; password = a + "y"`` makes the literals x and y reach
    password. A name keeps its last literals only, and none once something unknown is assigned to it. What comments
    assign is scored, but stays among comments. Values of any length and any number of literals are scored, by their
    counts of characters.
    """
    if not _ANY.search(text):
        return []
    code: dict[str, Constant] = {}
    aside: dict[str, Constant] = {}
    made: list[Node] = []
    remarks = comments(text)
    begins = [a for a, _ in remarks]
    for place, names, terms, more in all_statements(text, code):
        k = bisect_right(begins, place) - 1
        known = aside if k >= 0 and place < remarks[k][1] else code
        parts: list[tuple[int, int] | Constant] = [(start, end) if term is None else known[term] for start, end, term in terms if term is None or term in known]
        if more and names[0] in known:
            parts.insert(0, known[names[0]])
        if not parts:
            for name in names:
                known.pop(name, None)
            continue
        c = Constant(text, parts)
        made.append(c.node)
        for name in names:
            known[name] = c
            weight = sensitivity(name)
            if weight < 2 or c.size < 6 or (c.short is not None and c.short.lower() in _PLAIN):
                continue
            score = weight + entropy(c.count, c.size) / 2 + any(map(str.isdecimal, c.count)) - 2 * (" " in c.count)
            if score >= least and (c.node.best is None or score > c.node.best[0]):
                c.node.best = (score, -len(made), name)
    best: dict[tuple[int, int], tuple[float, int, str]] = {}
    for node in reversed(made):  # users of a value come after it, so its best is known by then
        for part in node.parts if node.best else ():
            if isinstance(part, Node):
                if part.best is None or node.best[:2] > part.best[:2]:
                    part.best = node.best
            elif part[1] > part[0] and (part not in best or node.best[:2] > best[part][:2]):
                best[part] = node.best
    return [(a, b, name, score) for (a, b), (score, _, name) in sorted(best.items())]


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join([f"{k}:{a}:{b}" for a, b, k in spans])


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    base = base_spans(text)
    more = [(a, b, "lexed") for a, b, _, _ in lexed_spans(text)]
    return base, sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2]), x[1])) if more else base


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_spans: bool = True) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, and with keep_spans ``found``.

    found: array of (kind, start, end, name, score), in code points; name and score only for kind ``lexed``.
    Null text is empty: no spans. Whole texts of any length are read; rows are independent, so repeated rows
    give repeated results and an empty table none. Other columns are not looked at.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    found_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            for i, j in chunks(offsets):
                rows = []
                for text in batch.column(1).slice(i, j - i):
                    text = text.as_py() or ""
                    base, spans = scan(text)
                    count = Counter(k for _, _, k in base)
                    rows.append((count["assign"], count["access"], count["hex"], sha_hex(_joined(base).encode()), _joined(spans)))
                    if keep_spans:
                        names = {(a, b): (n, s) for a, b, n, s in lexed_spans(text)} if len(spans) > len(base) else {}
                        rows[-1] += ([{"kind": k, "start": a, "end": b, "name": names[a, b][0] if k == "lexed" else None, "score": names[a, b][1] if k == "lexed" else None} for a, b, k in spans],)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), found_type][: 5 + keep_spans]
                arrays = [pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *arrays], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"][: 1 + len(arrays)])

    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema + (", found array<struct<kind:string,start:long,end:long,name:string,score:double>>" if keep_spans else ""))
