"""Secret scanning: three base patterns and an assignment-aware lexer.

The lexer cuts a text into strings (also triple-quoted ones), comments and the rest, and reads source
and configuration syntax in the rest into name-literal pairs: ``name = "literal"``, ``"name": "literal"``,
``NAME=value``, ``name => 'literal'``, ``a := "x" + "y"``, ``name = call("literal")``, YAML block scalars,
XML elements, and key and value that stand side by side (``<add key="DbPassword" value="..."/>``).  What
stands inside a string or a comment is no assignment.  A name bound to a literal is a constant of its
document; ``password = name``, earlier or later, passes the literal on to the new name.  A literal is
reported when the names it reaches are sensitive and it looks like a value; its score is the product of
both.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, prepare, read_table

# fixed values: the base patterns
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so the same spans as [0-9a-f]+ of 24 or more
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "named")

#: How sensitive a word of a name is; a name's score is its best word's, or its best pair's.
WORD_SCORE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "credential": 0.9, "credentials": 0.9, "token": 0.9, "apikey": 1.0, "bearer": 0.8, "auth": 0.6, "passcode": 0.9}
PAIR_SCORE = {("api", "key"): 1.0, ("access", "key"): 0.9, ("private", "key"): 0.9, ("signing", "key"): 0.8, ("encryption", "key"): 0.8, ("account", "key"): 0.8, ("shared", "key"): 0.8}
#: Words that are sensitive only at a name's end (DB_PASS, not pass_count).
LAST_SCORE = {"pass": 0.9}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|changeme|example|placeholder|your.*|none|null|nil|true|false|todo|test|undefined|\$\{.*\}|\$\w+|<.*>|%\w+%)$")
LEAST_SCORE, LEAST_LENGTH = 0.5, 6

_NAME_CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_0123456789.-"
# a quote after a letter, digit or backslash opens no string (don't), but for string prefixes (rb"...")
_QUOTE = r"""(?:(?<![A-Za-z0-9\\])|(?<=\b[rbuf])|(?<=\b[rbf][rbf]))"""
_LEXER = re.compile(rf"""(?P<string>{_QUOTE}(?:"(?!"")(?:[^"\\\n]|\\.)*+"|""(?!")|'(?!'')(?:[^'\\\n]|\\.)*+'|''(?!')|`[^`\n]*+`))|(?P<triple>\"\"\"|\'\'\')|(?P<line>(?:(?<=\s)|(?<![\s\S]))(?:\#|//)[^\n]*+)|(?P<block>/\*|<!--)|(?P<op>=>|:=|(?<![=!<>:+])[:=](?![=:/]))""", re.I)
_ENDS = {'"""': '"""', "'''": "'''", "/*": "*/", "<!--": "-->"}
_BARE = re.compile(r"""[A-Za-z0-9+/_.\-]++(?:={1,2}(?![A-Za-z0-9+/_."'=\-]))?""")
_GAP = re.compile(r"[ \t]*(?:\\\r?\n[ \t]*)?")
_JOIN = re.compile(r"[ \t]*(?:\+|\.(?=[ \t])|&|\|\||\?\?|(?<=[ \t)\]'\"])or(?=[ \t]))?[ \t]*(?:\\\r?\n[ \t]*)?")
_BORDER = re.compile(r"[<>{}\n;]")
#: What follows a passphrase's first word on its line: more words, up to the line's end.
_MORE_WORDS = re.compile(r"(?: [A-Za-z0-9]+){1,11}(?=[ \t]*\r?(?:\n|$))")
_CALL = re.compile(r"([A-Za-z_][\w.]*+)\(")
_LOOKUP = re.compile(r"(?i)(?:get|getenv|env|environ|lookup|fetch)$")
_SCALAR = re.compile(r"[ \t]*[|>][+-]?[ \t]*\r?\n")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)(?:\s[^<>]*+)?+>([^<>]++)</\1\s*>")
#: Names whose literals go together when they stand side by side.
_KEYS, _VALUES = frozenset("key name id property".split()), frozenset("value content default".split())
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_SENSITIVE = re.compile(r"(?i)pass|pwd|secret|token|key|cred|auth|bearer")


def name_score(name: str) -> float:
    """How sensitive a target name is, from the words in it (snake, kebab, dotted or camel case)."""
    words = [w.lower() for w in _WORDS.findall(name)]
    pairs = (PAIR_SCORE.get(p, 0.0) for p in zip(words, words[1:]))
    last = LAST_SCORE.get(words[-1], 0.0) if words else 0.0
    return max([last, *(WORD_SCORE.get(w, 0.0) for w in words), *pairs])


def literal_score(value: str) -> float:
    """How much a literal looks like a secret value: long enough, no placeholder, varied characters."""
    if len(value) < LEAST_LENGTH or PLACEHOLDER.match(value):
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return min(1.0, entropy / 2.5)


def lex(text: str) -> tuple[dict[int, tuple[int, int, int]], dict[int, int], list[tuple[int, int, int]]]:
    """(strings: opening -> inner start, inner end, end; the same by end -> opening; operators: start, end, where the rest before it begins)."""
    strings: dict[int, tuple[int, int, int]] = {}
    ends: dict[int, int] = {}
    operators: list[tuple[int, int, int]] = []
    at = rest = 0
    open_ended: set[str] = set()  # what has no end from here on is no string or comment
    while m := _LEXER.search(text, at):
        at = m.end()
        kind = m.lastgroup
        if kind == "op":
            operators.append((m.start(), at, rest))
            rest = at
        elif kind == "string":
            strings[m.start()] = (m.start() + 1, at - 1, at)
            ends[at] = m.start()
        elif kind == "line":
            rest = at
        else:
            end = -1 if m[0] in open_ended else text.find(_ENDS[m[0]], at)
            if end < 0:
                open_ended.add(m[0])
                continue
            if kind == "triple":
                strings[m.start()] = (at, end, end + 3)
                ends[end + 3] = m.start()
            at = end + len(_ENDS[m[0]])
            if kind == "block":
                rest = at
    return strings, ends, operators


def _target(text: str, lo: int, hi: int, strings, ends) -> str | None:
    """The name, quoted or not, that stands right before an operator."""
    while hi > lo and text[hi - 1] in " \t":
        hi -= 1
    if hi in ends:
        a, b, _ = strings[ends[hi]]
        name = text[a:b]
        return name if name and not name.strip(_NAME_CHARACTERS) and name[0] not in "0123456789.-" else None
    stem = text[lo:hi].rstrip(_NAME_CHARACTERS)
    return text[lo + len(stem) : hi].lstrip("0123456789.-") or None


def _value(text: str, at: int, strings, stop: int) -> tuple[list[tuple[int, int]], list[str], bool]:
    """Spans of the literals, and the names, that an expression joins; whether it is one bare word, which may be either.

    Arguments of a call are read up to the next operator, at ``stop``."""
    block = _SCALAR.match(text, at)
    if block:
        line = text.rfind("\n", 0, at) + 1
        indent, lo, hi, p = len(text[line:at]) - len(text[line:at].lstrip(" -")), None, None, block.end()
        while p < len(text):
            end = text.find("\n", p)
            end = len(text) if end < 0 else end
            body = text[p:end].strip()
            if body and len(text[p:end]) - len(text[p:end].lstrip(" ")) <= indent:
                break
            if body:
                first = p + text[p:end].index(body)
                lo, hi = first if lo is None else lo, first + len(body)
            p = end + 1
        return ([(lo, hi)] if lo is not None else []), [], False
    spans: list[tuple[int, int]] = []
    names: list[str] = []
    last, terms, looked, p = (0, 0), 0, False, _GAP.match(text, at).end()
    while p < len(text):
        call = _CALL.match(text, p)
        if p in strings or (text[p] in "rbufRBUF" and (q := next((k for k in (p + 1, p + 2) if k in strings), None)) is not None):
            a, b, p = strings[p if p in strings else q]
            spans.append((a, b))
        elif call:
            k, lookup, p = 0, bool(_LOOKUP.search(call[1])), call.end()
            while p < stop and text[p] not in ")\n;":
                if p in strings:
                    a, b, p = strings[p]
                    if k or not lookup:
                        spans.append((a, b))
                    k += 1
                else:
                    p += 1
            p += 1
        elif word := _BARE.match(text, p):
            p = word.end()
            if text[p : p + 1] == "[" and 0 < (close := text.find("]", p, stop if stop > p else len(text))) and "\n" not in text[p:close]:
                p, looked = close + 1, True  # the value at a key, which is no literal
            else:
                names.append(word[0])
                last = word.span()
        else:
            break
        terms += 1
        join = _JOIN.match(text, p)
        if join.end() == p or not join[0].strip(" \t\\\r\n") and join.end() not in strings:
            break
        p = join.end()
    bare = terms == 1 and bool(names) and not looked  # a value of configuration syntax, unless it is a constant
    return spans + [last] * bare, names, bare


def _borders(text: str, strings) -> list[int]:
    """Where elements, objects, lines and statements begin or end, strings aside."""
    opening = sorted(strings)
    inside = lambda at: (k := bisect_left(opening, at + 1)) > 0 and at < strings[opening[k - 1]][2]
    return [m.start() for m in _BORDER.finditer(text) if not inside(m.start())]


def named_literals(text: str) -> list[tuple[str, int, int, float]]:
    """(target name, start, end, score) of each literal that reaches a sensitive name."""
    if not _SENSITIVE.search(text):
        return []
    strings, ends, operators = lex(text)
    # an assignment: name, its literals, the names it joins in, the highest weight that has reached it, whether a bare word is its value
    made: list[list] = []
    of: dict[str, list[int]] = {}
    beside: dict[str, tuple[int, int, int]] = {}
    borders: list[int] | None = None
    stops = [lo for lo, *_ in operators[1:]] + [len(text)]
    for (lo, hi, rest), stop in zip(operators, stops):
        name = _target(text, rest, lo, strings, ends)
        if not name:
            continue
        spans, names, bare = _value(text, hi, strings, stop)
        if not spans and not names:
            continue
        of.setdefault(name, []).append(len(made))
        made.append([name, spans, names, 0.0, bare])
        if bare and text[lo] == ":" and "passphrase" in name.lower() and (more := _MORE_WORDS.match(text, spans[0][1])):
            made[-1][1], made[-1][2], made[-1][4] = [(spans[0][0], more.end())], [], False  # several words are one value
        kind = "key" if name.lower() in _KEYS else "value" if name.lower() in _VALUES else ""
        if kind and len(spans) == 1:
            beside[kind] = (*spans[0], lo)
            if len(beside) == 2:
                (a, b, p), value = beside["key"], beside["value"]
                if borders is None:
                    borders = _borders(text, strings)
                if bisect_left(borders, min(b, value[1])) == bisect_left(borders, max(p, value[2])):
                    made.append([text[a:b], [value[:2]], [], 0.0, False])
                    beside.clear()
    for m in _ELEMENT.finditer(text):
        body = m[2].strip()
        if body:
            lo = m.start(2) + m[2].index(body)
            made.append([m[1], [(lo, lo + len(body))], [], 0.0, False])
    found: dict[tuple[int, int], tuple[str, float]] = {}
    passed: dict[tuple[str, float], int] = {}  # definitions of a name that a weight has reached
    for k, (name, *_) in enumerate(made):
        weight = name_score(name)
        reached = [k] if weight else []
        while reached:
            i = reached.pop()
            _, spans, names, known, bare = made[i]
            if known >= weight:
                continue
            made[i][3] = weight
            parts = []
            for x in names:
                defined = of.get(x)
                if defined:  # the definitions before this one (branches have several), or else the first one after it
                    before = max(bisect_left(defined, i), 1)
                    parts.append(defined[before - 1])
                    parts += defined[passed.get((x, weight), 0) : before - 1]
                    passed[x, weight] = max(passed.get((x, weight), 0), before - 1)
            reached += [x for x in parts if x != i]
            if bare and parts and parts[0] != i:
                spans = []  # the bare word is a constant
            for lo, hi in spans:
                score = weight * literal_score(text[lo:hi])
                if score >= LEAST_SCORE and score > found.get((lo, hi), ("", 0.0))[1]:
                    found[lo, hi] = (name, score)
    return [(name, lo, hi, score) for (lo, hi), (name, score) in sorted(found.items())]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches, sorted."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{lo}:{hi}" for lo, k, hi in sorted(spans))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256, spans, n_named, names, scores, score.

    ``names`` lists the sensitive names, ``scores`` the scores of the named spans in their order, to three
    places, and ``score`` is the highest (0 without any).  A null or empty text has no spans: counts of 0,
    empty strings and the digest of the empty string.  Repeated rows and null ids give a row each; other columns are not read."""
    prepare(docs.sparkSession)

    def work(batches):
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                text = text or ""
                base, named = base_spans(text), named_literals(text)
                kinds = Counter(k for _, k, _ in base)
                digest = hashlib.sha256(render(base).encode()).hexdigest()
                every = render(base + [(lo, 3, hi) for _, lo, hi, _ in named])
                rows.append((kinds[0], kinds[1], kinds[2], digest, every, len(named), ",".join(sorted({n for n, *_ in named})), ",".join(f"{x:.3f}" for *_, x in named), max((x for *_, x in named), default=0.0)))
            cols = list(zip(*rows)) if rows else [()] * 9
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_named", "names", "scores", "score"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = map_arrow(src, work, "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_named long, names string, scores string, score double")
    return out.withColumnRenamed("id", id_col)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents"))
