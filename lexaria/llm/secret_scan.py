"""Secret scan: fixed patterns, and literals assigned to sensitive names.

Three patterns are always searched (kinds ``assign``, ``access``, ``hex``; see
``base_spans``).  On top, an assignment-aware lexer cuts the text into words,
strings (with prefixes, triple quotes, escapes), operators, line ends and comments.
From them it reads pairs of a target name and a value: ``name = value``, ``name: T =
value``, ``name: value``, ``"name" => value``, ``x["name"] = value``, ``--name value``,
``<name>value</name>``, and ``name: X`` next to ``value: Y``.  A value is a chain of
literals joined by adjacency or operators, over line ends inside brackets; lists and
alternatives (``a or b``) are several chains.  Names in a value are references to
constants of the text: the last definition before, else the first one after; one in a
comment defines nothing.  Calls hide their arguments, but for conversions
(``str(...)``) and defaults of lookups (``getenv(name, default)``).  Keys inside
``name: {...}``, or indented below ``name:``, inherit part of a sensitive name.

Sensitivity flows from a target along references to every literal behind it, each
pair once, so copies of references don't multiply.  A chain scores the sensitivity
times its strength, from length, character classes and entropy; placeholders score
zero.  Literals of chains of ``LEAST`` or more become spans of kind ``literal``.

All steps are linear in the text (but for sorting): an opening quote that nothing closes
makes the others of its kind plain up to the line's end, and brackets are matched once.
A text without any sensitive word is not lexed, as none of its names could be sensitive.

Spans are in code points, end exclusive, in order of start and then of kind as
listed in ``KINDS``.  Null text is empty and has no spans; repeated rows get
equal spans; an empty table gives an empty result.  Whole texts are scanned, of any
length; tokens take some 40 bytes each.  Only the named columns are read; others may
have any name.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaria.llm.words import bound_batches, give_back

KINDS = ("assign", "access", "hex", "literal")
LEAST = 0.5
#: What a redacted span becomes.
MASK = "[secret]"

# The three base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Runs are maximal, so asking for the least length at once gives the same matches as dropping short ones.
HEX = re.compile(r"[0-9a-f]{16,}")

#: Sensitivity of a target name's parts; the largest counts.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "secrets": 1.0, "token": 0.9, "apikey": 1.0, "privatekey": 1.0, "accesskey": 0.9,
    "secretkey": 1.0, "authkey": 0.9, "credential": 0.9, "credentials": 0.9, "signingkey": 0.9, "encryptionkey": 1.0, "bearer": 0.8, "authorization": 0.8, "auth": 0.6, "salt": 0.5, "webhook": 0.5,
}
_JOINED = ("api", "private", "access", "secret", "auth", "signing", "encryption")
#: Every sensitive name has one of these in it.
_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "auth", "salt", "webhook")
_PLACEHOLDER = re.compile(
    r"(?i)(x+|\*+|\.+|<[^>]*>|\$?\{.*|%.*%|your.*|example.*|changeme.*|placeholder.*|redacted.*|none|null|true|false|todo.*|undefined)\Z", re.DOTALL
)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Calls whose arguments are the value itself, and those whose arguments after the first are its default.
_SAME = {"str", "string", "bytes", "bytearray", "secretstr", "b64decode", "decode", "encode", "format", "quote", "strip", "trim", "optional", "field"}
_LOOKUP = {"getenv", "get", "getproperty", "env", "getorelse", "getordefault", "setdefault"}

_TOKEN = re.compile(
    r"""(?P<space>[ \t\f\v]++|\\\r?\n)|(?P<line>\r?\n|\r)|(?P<quote>[rRbBfFuU]{0,2}(?:\"{3}|'{3}|["'`]))|(?P<word>[A-Za-z_$][\w$]*+(?:-[A-Za-z_][\w$]*+)*+)"""
    r"""|(?P<other>\w++)|(?P<mark>:=|=>|->|::|==|!=|<=|>=|\?\?|\|\||<!--|/\*|//|--|[^\w\s])|(?P<rest>\s)"""
)
_BODY = {
    '"': re.compile(r'((?:[^"\\\n]|\\[^\n])*+)"'),
    "'": re.compile(r"((?:[^'\\\n]|\\[^\n])*+)'"),
    "`": re.compile(r"((?:[^`\\\n]|\\[^\n])*+)`"),
    '"""': re.compile(r'((?:[^"\\]|\\.|"(?!""))*+)"""', re.DOTALL),
    "'''": re.compile(r"((?:[^'\\]|\\.|'(?!''))*+)'''", re.DOTALL),
}
_BARE = re.compile(r"""[A-Za-z0-9+/_.~$@!#%^*{}-]++(?:={1,2}(?![\w"']))?""")
_REF = re.compile(r"\$\{?([A-Za-z_][\w.]*)\}?\Z|\{\{ *([A-Za-z_][\w.]*) *\}\}\Z")
_KEY = re.compile(r"[\w .$@/-]{1,128}\Z")
_IDENTIFIER = re.compile(r"(?:[a-z]+(?:[_.][a-z0-9]+)+|[a-z]+(?:[A-Z][a-z]+)+)\Z")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)(?:\s[^<>]*+)?>([^<]*+)</")
_TYPE = set(".<>[]|,?&")
WORD, OTHER, TEXT, MARK, LINE = range(5)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns; matches that are too short take their text along but don't count."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def sensitivity(name: str) -> float:
    """0 to 1: how much a target name says that its value is secret."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    joined = [a + b for a, b in zip(parts, parts[1:]) if a in _JOINED]
    return max((SENSITIVE.get(p, 0.0) for p in parts + joined), default=0.0)


def strength(counts: Counter) -> float:
    """0 to 1: how much characters look like a key rather than a word."""
    n = sum(counts.values())
    if n < 8 or " " in counts or "\n" in counts:
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    kinds = {"a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "-" for c in counts}
    if len(kinds) == 1 and "0" not in kinds:
        return 0.0
    return min(1.0, n / 16) * 0.4 + min(1.0, entropy / 3.5) * 0.4 + (len(kinds) - 1) / 2 * 0.2


class Tokens:
    """Tokens of a text in arrays: kind, start, end, where a string's value starts and ends, the matching bracket, whether in a comment."""

    def __init__(self, text: str):
        self.text = text
        self.kind, self.comment = bytearray(), bytearray()
        self.start, self.end, self.low, self.high, self.match = (array("q") for _ in range(5))
        self._lex()

    def _add(self, kind: int, start: int, end: int, low: int, high: int, comment: bool) -> None:
        self.kind.append(kind)
        self.comment.append(comment)
        for column, value in zip((self.start, self.end, self.low, self.high, self.match), (start, end, low, high, -1), strict=True):
            column.append(value)

    def _lex(self) -> None:
        text, at, n, quiet = self.text, 0, len(self.text), 0
        dead: dict[str, int] = {}
        open_: list[int] = []
        while at < n:
            m = _TOKEN.match(text, at)
            kind, end = m.lastgroup, m.end()
            comment = at < quiet
            if kind == "quote":
                own = m.group()
                quote = own.lstrip("rRbBfFuU")
                plain = dead.get(quote, -1) >= at or (len(own) == 1 and own != "`" and at > 0 and (text[at - 1].isalnum() or text[at - 1] == "_"))
                body = None if plain else _BODY[quote].match(text, end)
                if body:
                    self._add(TEXT, at, body.end(), end, body.end(1), comment)
                    end = body.end()
                else:
                    if not plain:
                        line = text.find("\n", end)
                        dead[quote] = n if len(quote) == 3 or line < 0 else line
                    end = at + 1
                    self._add(MARK if text[at] in "\"'`" else OTHER, at, end, at, end, comment)
            elif kind == "word" or kind == "other":
                self._add(WORD if kind == "word" else OTHER, at, end, at, end, comment)
            elif kind == "line":
                self._add(LINE, at, end, at, end, comment)
            elif kind == "mark":
                mark = m.group()
                if not comment:
                    if mark in ("#", "//"):
                        before = text[at - 1] if at else "\n"
                        if before.isspace() or (mark == "//" and before != ":"):
                            line = text.find("\n", end)
                            quiet = n if line < 0 else line
                    elif mark in ("/*", "<!--"):
                        close = text.find("*/" if mark == "/*" else "-->", end)
                        quiet = n if close < 0 else close
                if mark in "([{":
                    open_.append(len(self.kind))
                elif mark in ")]}" and open_:
                    k = open_.pop()
                    self._add(MARK, at, end, at, end, comment)
                    self.match[k] = len(self.kind) - 1
                    at = end
                    continue
                self._add(MARK, at, end, at, end, comment)
            at = end

    def mark(self, i: int) -> str:
        """The operator at i, or nothing."""
        return self.text[self.start[i] : self.end[i]] if 0 <= i < len(self.kind) and self.kind[i] == MARK else ""

    def is_(self, i: int, kind: int) -> bool:
        return 0 <= i < len(self.kind) and self.kind[i] == kind


#: A pair: target name, chains of (start, end, reference), whether it defines the name, and what it inherits.
Pair = tuple[str, list[list[tuple[int, int, str]]], bool, float]


class _Reader:
    """Pairs of a text, in order."""

    def __init__(self, text: str):
        self.text, self.t = text, Tokens(text)
        self.named: dict[int, str] = {}
        self.pairs: list[Pair] = []
        self.scopes: list[float] = []
        self.below: list[tuple[int, float]] = []
        self.value_of = ""
        self._read()

    def _target(self, i: int) -> str:
        """The name in front of the operator at i."""
        t = self.t
        if i in self.named:
            return self.named.pop(i)
        j = i - 1
        if t.mark(j) in ("?", "!"):
            j -= 1
        if t.mark(j) == "]" and t.is_(j - 1, TEXT) and t.mark(j - 2) == "[":
            j -= 1
        if t.is_(j, TEXT):
            name = self.text[t.low[j] : min(t.high[j], t.low[j] + 129)]
            return name if _KEY.match(name) else ""
        if not t.is_(j, WORD):
            return ""
        first = j
        while j - first < 12 and t.mark(first - 1) in (".", "->", "::") and t.is_(first - 2, WORD):
            first -= 2
        return self.text[t.start[first] : t.end[j]][-256:]

    def _annotated(self, i: int) -> int:
        """Where ``: T = value`` has its ``=``, given its colon; -1 if it is no such thing."""
        for j in range(i + 1, min(i + 18, len(self.t.kind))):
            mark = self.t.mark(j)
            if mark == "=":
                return j if j > i + 1 else -1
            if not (self.t.is_(j, WORD) or (mark and mark in _TYPE)):
                return -1
        return -1

    def _chains(self, i: int) -> list[list[tuple[int, int, str]]]:
        """The chains of the value that starts at token i."""
        t, text = self.t, self.text
        chains: list[list[tuple[int, int, str]]] = [[]]
        depth, first, join, open_ = 0, True, False, True  # open_: an operand may come
        while i < len(t.kind):
            kind, mark = t.kind[i], t.mark(i)
            if kind == LINE:
                if depth or join or t.mark(i + 1) == "+":
                    i += 1
                    continue
                break
            if kind == TEXT:
                ref = _REF.match(text, t.low[i], t.high[i])
                chains[-1].append((t.low[i], t.high[i], (ref.group(1) or ref.group(2)) if ref else ""))
                i, first, join, open_ = i + 1, False, False, False
            elif kind == WORD and text[t.start[i] : t.end[i]] in ("or", "and", "else", "if", "new", "await", "return", "Bearer", "Basic"):
                if text[t.start[i] : t.end[i]] in ("or", "and", "else", "if"):
                    chains.append([])
                    open_ = True
                i += 1
            elif open_ and (
                kind in (WORD, OTHER) or (first and not depth and mark and mark in "+/_.~$@!#%^*{-")
            ) and not (kind == OTHER and not first and not join):
                j = i
                while kind == WORD and j - i < 16 and t.mark(j + 1) in (".", "->", "::") and t.is_(j + 2, WORD):
                    j += 2
                path = text[t.start[i] : t.end[j]]
                if kind == WORD and t.mark(j + 1) == "(" and t.start[j + 1] == t.end[j]:
                    base, _, call = path.rpartition(".")
                    if base:
                        chains[-1].append((t.start[i], t.start[i], base))
                    call, close = call.lower(), t.match[j + 1]
                    if call in _SAME:
                        i, depth = j + 2, depth + 1
                    elif close < 0:
                        break
                    elif call in _LOOKUP:
                        k = j + 2
                        while k < close and t.mark(k) != ",":
                            k = t.match[k] + 1 if t.match[k] > k else k + 1
                        i, depth = k + 1, depth + (k < close)
                        chains.append([])
                    else:
                        i = close + 1
                    first = join = False
                    open_ = depth > 0 and t.mark(i - 1) != ")"
                    continue
                bare = _BARE.match(text, t.start[i]) if first and not depth else None
                if bare and (kind != WORD or bare.end() != t.end[j]):
                    word = bare.group().rstrip(".")
                    ref = _REF.match(word)
                    chains[-1].append((t.start[i], t.start[i] + len(word), (ref.group(1) or ref.group(2)) if ref else ""))
                    while i < len(t.kind) and t.start[i] < bare.end():
                        i += 1
                    first = join = open_ = False
                    continue
                # a name alone is a reference; where nothing has it, the first one of an undecorated value is a bare literal
                own = first and not depth and not _IDENTIFIER.match(path)
                chains[-1].append((t.start[i], t.end[j] if own else t.start[i], path))
                i, first, join, open_ = j + 1, False, False, False
            elif mark in ("+", ".", "&") and not first:
                if mark == "." and t.is_(i + 1, WORD) and t.mark(i + 2) == "(":  # a method of the value before
                    close = t.match[i + 2]
                    if close < 0:
                        break
                    i = close + 1
                    continue
                i, join, open_ = i + 1, True, True
            elif mark in ("||", "??"):
                chains.append([])
                i, join, open_ = i + 1, True, True
            elif mark in ("(", "["):
                depth, i, open_ = depth + 1, i + 1, True
            elif mark in (")", "]") and depth:
                depth, i = depth - 1, i + 1
            elif mark == "," and depth:
                chains.append([])
                i, open_ = i + 1, True
            else:
                break
        return [c for c in chains if c]

    def _found(self, name: str, chains: list[list[tuple[int, int, str]]], comment: bool) -> None:
        last = name.lower().rpartition(".")[2]
        if last in ("name", "key", "id", "variable") and chains and len(chains[0]) == 1:
            s, e, _ = chains[0][0]
            self.value_of = self.text[s : min(e, s + 128)]
        elif last in ("value", "default", "content"):
            name, self.value_of = f"{self.value_of}.{name}" if self.value_of else name, ""
        else:
            self.value_of = ""
        inherits = max([*self.scopes[-1:], *(w for _, w in self.below[-1:])], default=0.0)
        if chains:
            self.pairs.append((name, chains, not comment, inherits))

    def _read(self) -> None:
        t, text = self.t, self.text
        pending, pending_at = 0.0, -1
        for i in range(len(t.kind)):
            kind = t.kind[i]
            if kind == LINE:
                nxt = i + 1
                if nxt < len(t.kind) and t.kind[nxt] != LINE and self.below and not self.scopes:
                    indent = t.start[nxt] - t.end[i]
                    while self.below and self.below[-1][0] >= indent:
                        self.below.pop()
                continue
            if kind != MARK:
                continue
            mark = t.mark(i)
            if mark in "([{":
                self.scopes.append(pending if pending_at == i else (self.scopes[-1] if self.scopes and mark == "[" else 0.0))
            elif mark in ")]}":
                if self.scopes:
                    self.scopes.pop()
            elif mark == "<":
                m = _ELEMENT.match(text, t.start[i])
                if m:
                    value = m.group(2)
                    low = m.start(2) + len(value) - len(value.lstrip())
                    if value.strip():
                        self._found(m.group(1), [[(low, low + len(value.strip()), "")]], bool(t.comment[i]))
            elif mark == "--" and t.is_(i + 1, WORD) and t.start[i + 1] == t.end[i] and t.mark(i + 2) not in ("=", ":"):
                self._found(text[t.start[i + 1] : t.end[i + 1]], self._chains(i + 2), bool(t.comment[i]))
            elif mark in ("=", ":=", "=>", ":"):
                name = self._target(i)
                if not name:
                    continue
                if mark == ":":
                    equals = self._annotated(i)
                    if equals >= 0:
                        self.named[equals] = name
                        continue
                if t.mark(i + 1) in ("{", "["):
                    weight = sensitivity(name)
                    pending, pending_at = (weight * 0.9 if weight >= 0.9 else 0.0), i + 1
                    if t.mark(i + 1) == "{":
                        continue
                elif mark == ":" and t.is_(i + 1, LINE):
                    j = i - 1
                    while j > 0 and not t.is_(j - 1, LINE) and i - j < 8:
                        j -= 1
                    weight = sensitivity(name)
                    if t.start[j] - (t.end[j - 1] if j else 0) >= 0:
                        self.below.append((t.start[j] - (t.end[j - 1] if j else 0), weight * 0.9 if weight >= 0.9 else 0.0))
                    continue
                self._found(name, self._chains(i + 1), bool(t.comment[i]))


def pairs(text: str) -> list[Pair]:
    """The pairs of a target name and a value, in order."""
    return _Reader(text).pairs


def literal_spans(text: str) -> list[tuple[int, int, int]]:
    low = text.lower()
    if not any(h in low for h in _HINTS):
        return []
    return _judged(text, pairs(text))


def _judged(text: str, found: list[Pair]) -> list[tuple[int, int, int]]:
    """Spans of the literals that reach a sensitive target and are strong."""
    defined: dict[str, list[int]] = {}
    for k, (name, _, defines, _) in enumerate(found):
        if defines:
            for own in {name, name.rpartition(".")[2]}:
                defined.setdefault(own, []).append(k)

    def definition(name: str, user: int) -> int:
        """The pair that a reference means: the last one before its user, else the first after; -1 if there is none."""
        if name.startswith("$"):
            name = name.strip("${}")
        places = defined.get(name) or defined.get(name.rpartition(".")[2])
        if not places:
            return -1
        at = bisect_left(places, user)
        k = places[at - 1] if at else places[0]
        return k if k != user else (places[1] if len(places) > 1 else -1)

    weight: dict[int, float] = {}
    start = sorted(((w, k) for k, p in enumerate(found) if (w := max(sensitivity(p[0]), p[3])) > 0), reverse=True)
    for w, k in start:  # the largest weights first, so each pair is reached once
        todo = [k]
        while todo:
            k = todo.pop()
            if k in weight:
                continue
            weight[k] = w
            todo += [d for c in found[k][1] for _, _, ref in c if ref and (d := definition(ref, k)) >= 0]
    spans: set[tuple[int, int, int]] = set()
    own: dict[int, Counter] = {}

    def characters(k: int) -> Counter:
        """Those of a pair's first chain, without what it refers to."""
        if k not in own:
            own[k] = Counter()
            for s, e, ref in found[k][1][0]:
                if not ref:
                    own[k].update(text[s:e])
        return own[k]

    for k, w in weight.items():
        for chain in found[k][1]:
            counts: Counter = Counter()
            literals: list[tuple[int, int]] = []
            held: set[int] = set()
            for s, e, ref in chain:
                d = definition(ref, k) if ref else -1
                if d >= 0:
                    counts.update(characters(d))
                    if d not in held:
                        held.add(d)
                        literals += [(a, b) for a, b, r in found[d][1][0] if not r]
                elif e > s and not (ref and len(chain) > 1):
                    counts.update(text[s:e])
                    literals.append((s, e))
            if len(literals) == 1 and _PLACEHOLDER.match(text, *literals[0]):
                continue
            if w * strength(counts) >= LEAST:
                spans |= {(s, 3, e) for s, e in literals if e > s}
    return sorted(spans)


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans in order."""
    return sorted(base_spans(text) + literal_spans(text))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str) -> str:
    """The text with each span (overlapping ones together) replaced by MASK."""
    spans = scan(text)
    if not spans:
        return text
    out, at = [], 0
    merged: list[list[int]] = []
    for s, _, e in spans:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], MASK]
        at = e
    return "".join([*out, text[at:]])


_OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _OUT.split(", ")]
    for batch in batches:
        rows = []
        texts = batch.column(1)
        for i in range(len(texts)):
            text = texts[i].as_py() or ""
            base = base_spans(text)
            spans = sorted(base + literal_spans(text))
            n = [sum(k == j for _, k, _ in base) for j in range(3)] if base else [0, 0, 0]
            rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        types = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts by kind, digest of the base spans, and all spans of every row."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_scan_batches, _OUT)


def _redact_column(texts: pa.Array) -> pa.Array:
    out = pa.array([None if (t := texts[i].as_py()) is None else redact(t) for i in range(len(texts))], pa.string())
    give_back()
    return out


def redact_secrets(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with spans masked; the column of text lengths, if there is one, follows."""
    bound_batches(docs.sparkSession)
    out = docs.withColumn(text_col, F.arrow_udf(_redact_column, "string")(F.col(text_col).cast("string")))
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.length(text_col).cast(dict(docs.dtypes)[chars_col]))
    return out
