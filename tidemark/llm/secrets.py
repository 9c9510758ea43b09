"""Operator 13: secret scans by assignment-aware lexing.

Three plain patterns give the base findings.  Beyond them the text is read as source code or
configuration: a lexer finds what is assigned to which name (``name = "..."``, ``"name": "..."``,
``name: str = ...``, ``cfg["name"] = ...``, ``name => ...``, ``--name=value``, whole lines
``name: value``, elements and attributes of markup) and gives name-literal pairs.  A value may also
name another one; such constants are followed back, through any number of names, so that in
``x = "..."; password = x`` the literal of ``x`` belongs to ``password`` too.  A literal's score is
that of the most sensitive name that reaches it, times how much the literal itself looks like
a secret.  A scan takes time in proportion to the text, whatever is in it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .common import small_batches

#: Kinds of findings in the order in which findings of one place are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "literal")
#: A literal of this score is a finding.
LEAST_SCORE = 0.5

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the three patterns; matches too short to count still take their place."""
    lower = text.lower()
    found = []
    if "passw" in lower or "secret" in lower or "token" in lower or "api" in lower:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return found


# Names.

#: Words that make a name sensitive, and how much; ``key`` does behind one of the next list.
_WORDS = dict.fromkeys("password passwd pwd passphrase passcode secret token apikey credential cred".split(), 1.0) | dict.fromkeys("auth authorization bearer signature cookie salt".split(), 0.7)
_KEYS = frozenset("api access private secret auth signing encryption master shared ssh account client service storage".split())
#: A name that ends in one of these is about a secret, but isn't one.
_ABOUT = frozenset("url uri path file filename dir name id type length len size count limit min max field label title prefix suffix header placeholder hint regex pattern policy expiry expires ttl age at time timeout enabled required valid index".split())
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_a-zA-Z]+")
#: No name is sensitive without one of these in it.
_STEM = re.compile(r"pass|pwd|secret|token|key|cred|auth|bearer|signature|cookie|salt", re.I)


def sensitivity(name: str) -> float:
    """From 0 to 1: whether what is assigned to ``name`` ought to be a secret."""
    if not _STEM.search(name):
        return 0.0
    words = [w.lower() for w in _WORD.findall(name)]
    if not words or words[-1] in _ABOUT:
        return 0.0
    best = 0.0
    for before, word in zip(["", *words], words, strict=False):
        if word in ("key", "keys") and before in _KEYS:
            best = max(best, 0.9)
        best = max(best, _WORDS.get(word, 0.0), _WORDS.get(word.removesuffix("s"), 0.0), 1.0 if word.endswith(("password", "passwd", "secret", "token", "apikey")) else 0.0)
    return best


# Literals.

_PLACEHOLDER = re.compile(r"x+|\*+|\.+|-+|_+|<.*>|\[.*\]|\$.*|%.*%|\{.*|(?:change|your|my|example|dummy|sample|fake|insert|enter|redacted|placeholder|todo)[\W_]?.*|none|null|nil|true|false|undefined|default|password|passwd|secret|token|string|str|required|optional", re.I | re.S)
_CLASSES = [re.compile(p) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^a-zA-Z\d]")]


def likeness(literal: str) -> float:
    """From 0 to 1: whether a literal looks like a secret, by its length, characters and entropy."""
    n = len(literal)
    if n < 6 or _PLACEHOLDER.fullmatch(literal):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    kinds = sum(1 for p in _CLASSES if p.search(literal))
    return min(1.0, entropy / 3.5) * (1.0 if kinds > 1 else 0.6) * (1.0 if n >= 8 else 0.8) * (0.4 if any(c.isspace() for c in literal) else 1.0)


# Pairs. Possessive repeats and looks behind keep each of these patterns from reading a place twice.

_NAME = r"[A-Za-z_$@][\w$]*+(?:[.\-][\w$]++)*+"
_PAIR = re.compile(
    rf"""(?:(?P<quote>["'`])(?P<key>[\w$.\-]++)(?P=quote)|(?<![\w$.\-])-{{0,2}}(?P<name>{_NAME}))[ \t]*+\]?[ \t]*+
    (?::[ \t]*+[A-Za-z_][\w.]*+(?:\[[\w.,\ ]*+\])?+[ \t]*+(?==(?!=)))?+
    (?P<op>:=|=>|=(?![=~>])|:(?![:/=]))[ \t]*+""",
    re.X,
)
_STRING = {q: re.compile(rf"{q}((?:[^{q}\\\n]|\\.)*+){q}") for q in "\"'`"}
_LONG = {q * 3: re.compile(rf"{q * 3}((?:[^{q}\\]|\\.|{q}(?!{q * 2}))*+){q * 3}", re.S) for q in "\"'"}
_PREFIX = re.compile(r"[fFrRbBuU]{0,2}(?=[\"'])")
_REFERENCE = re.compile(r"\$\{([\w.\-]+)\}|\$([A-Za-z_]\w*)|%([A-Za-z_]\w*)%|\{\{[ ]*([\w.\-]+)[ ]*\}\}")
_BARE_NAME = re.compile(rf"{_NAME}(?![\w$(\[])")
_RUN = re.compile(r"[^\s\"'`,;(){}\[\]<>]++")
_JOINT = re.compile(r"[ \t]*+(?:(?P<sign>\+|\.\.?|\|\||&)[ \t]*+(?:\\?\n[ \t]*+)?+|\n[ \t]*+(?P<again>\+|\.\.?|\|\|)[ \t]*+|\\\n[ \t]*+)?+")
_LINE_END = re.compile(r"[ \t]*+(?:[#;][^\n]*+|//[^\n]*+)?+(?:\r?\n|\Z)")
_TAG = re.compile(r"<([A-Za-z][\w.:\-]*+)((?:[^<>\"']|\"[^\"<>]*+\"|'[^'<>]*+')*+)>([^<>\n]*+)")
_ATTRIBUTE = re.compile(r"([A-Za-z][\w.:\-]*+)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)')")


class _Pair:
    """A name, the literals assigned to it, and the names that its value mentions."""

    __slots__ = ("name", "literals", "names", "bare", "weight")

    def __init__(self, name: str, literals: list[tuple[int, int]], names: list[str], bare: tuple[int, int] | None):
        self.name, self.literals, self.names, self.bare, self.weight = name, literals, names, bare, 0.0


def _on_own_line(text: str, start: int) -> bool:
    """Whether only indentation, a list, comment or option mark, ``export`` or ``set`` is before ``start`` on its line."""
    k = start
    while k and text[k - 1] in " \t-#*;/\"'":
        k -= 1
    if k and text[k - 1] != "\n":
        for word in ("export", "set"):
            if text.startswith(word, k - len(word)) and (k == len(word) or text[k - len(word) - 1] in "\n \t"):
                return True
        return False
    return True


class _Reader:
    def __init__(self, text: str):
        self.text, self.open_until = text, dict.fromkeys([*_STRING, *_LONG], 0)

    def string(self, at: int) -> re.Match | None:
        """A string literal at a place; where one has no end, no later one of its mark has before ``open_until``."""
        at = m.end() if (m := _PREFIX.match(self.text, at)) else at
        mark = self.text[at : at + 3]
        for marks, table in ((mark, _LONG), (mark[:1], _STRING)):
            if marks in table and at >= self.open_until[marks]:
                if m := table[marks].match(self.text, at):
                    return m
                end = -1 if len(marks) == 3 else self.text.find("\n", at)
                self.open_until[marks] = len(self.text) if end < 0 else end
        return None

    def value(self, at: int) -> tuple[list[tuple[int, int]], list[str], int]:
        """Literals and names of the value at a place, joined by signs or side by side, and where it ends."""
        literals, names, end = [], [], at
        signed = True
        while True:
            if m := self.string(at):
                literals.append(m.span(1))
                # What a literal takes in by name is part of the value.
                names += [x for found in _REFERENCE.findall(m[1]) for x in found if x]
            elif not signed:
                return literals, names, end
            elif m := _REFERENCE.match(self.text, at):
                names.append(m[m.lastindex])
            elif m := _BARE_NAME.match(self.text, at):
                names.append(m[0])
            else:
                return literals, names, end
            end = m.end()
            joint = _JOINT.match(self.text, end)
            at, signed = joint.end(), bool(joint["sign"] or joint["again"])

    def pairs(self) -> Iterator[_Pair]:
        text, at = self.text, 0
        while m := _PAIR.search(text, at):
            name, start = m["key"] or m["name"], m.start()
            literals, names, end = self.value(m.end())
            bare = None
            if not literals and _on_own_line(text, start) and (run := _RUN.match(text, m.end())) and _LINE_END.match(text, run.end()):
                bare = run.span()
            yield _Pair(name.lstrip("$@"), literals, names, bare)
            # Inside of a literal there may be pairs again, in a value's name none.
            at = max(m.end(), end if not literals else m.end())
        for m in _TAG.finditer(text):
            if m[3].strip():
                yield _Pair(m[1], [m.span(3)], [], None)
            values = {a[1].lower(): a.span(2) if a[2] is not None else a.span(3) for a in _ATTRIBUTE.finditer(m[2])}
            if "value" in values:
                for key in ("name", "key", "id"):
                    if key in values:
                        a, b = values["value"]
                        k, e = values[key]
                        yield _Pair(m[2][k:e], [(m.start(2) + a, m.start(2) + b)], [], None)


def literal_findings(text: str) -> list[tuple[int, int, int, str, float]]:
    """``(start, kind, end, name, score)`` of literals that reach a sensitive name."""
    if not _STEM.search(text):
        return []
    pairs = list(_Reader(text).pairs())
    # What a name means is its last definition before, else its first one after.
    known: dict[str, int] = {}
    first: dict[str, list[int]] = {}
    for k, p in enumerate(pairs):
        if len(mine := first.setdefault(p.name, [])) < 2:
            mine.append(k)
    needs: list[list[int]] = []
    for k, p in enumerate(pairs):
        needs.append([known[n] if n in known else next((d for d in first[n] if d != k), k) for n in p.names if n in first])
        known[p.name] = k
    # The most sensitive names first, so each pair is reached once, with its highest weight.
    own = [sensitivity(p.name) for p in pairs]
    reached_by: list[str] = [""] * len(pairs)
    for start in sorted((k for k in range(len(pairs)) if own[k]), key=lambda k: (-own[k], k)):
        todo = [start]
        while todo:
            k = todo.pop()
            if pairs[k].weight:
                continue
            pairs[k].weight, reached_by[k] = own[start], pairs[start].name
            todo += needs[k]
    found = {}
    for p, name, needed in zip(pairs, reached_by, needs, strict=True):
        if not p.weight:
            continue
        spans = p.literals
        if p.bare and not needed:
            a, b = p.bare
            if any(c.isdigit() for c in text[a:b]) and any(c.isalpha() for c in text[a:b]):
                spans = [p.bare]
        score = p.weight * likeness("".join(text[a:b] for a, b in spans))
        if score >= LEAST_SCORE:
            for a, b in spans:
                if b > a and score > found.get((a, b), ("", 0.0))[1]:
                    found[a, b] = name, score
    return [(a, 3, b, name, score) for (a, b), (name, score) in found.items()]


def findings(text: str) -> list[tuple[int, int, int, str | None, float | None]]:
    """All findings of a text in order. A literal that lies in a base finding isn't listed again."""
    base = sorted(base_findings(text))
    out = [(*f, None, None) for f in base]
    farthest, k = -1, 0
    for f in sorted(literal_findings(text)):
        while k < len(base) and base[k][0] <= f[0]:
            farthest = max(farthest, base[k][2])
            k += 1
        if f[2] > farthest:
            out.append(f)
    return sorted(out, key=lambda f: f[:3])


_FINDING = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("name", StringType()), StructField("score", DoubleType())])


@F.arrow_udf(ArrayType(_FINDING))
def _findings(texts: pa.Array) -> pa.Array:
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())])
    rows = []
    for text in texts.cast(pa.binary()).to_pylist():
        # A byte that isn't UTF-8 counts as one character.
        found = findings(text.decode("utf-8", "surrogateescape")) if text else []
        rows.append([{"kind": KINDS[k], "start": a, "end": b, "name": name and name.encode("utf-8", "replace").decode(), "score": score} for a, k, b, name, score in found])
    return pa.array(rows, pa.list_(kind))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Each row's id and its ``findings``: an array of ``kind, start, end, name, score`` by place.

    Places are in characters, the end exclusive.  ``assign``, ``access`` and ``hex`` are the base
    patterns; ``literal`` has the place of a literal, the sensitive name that it reaches and its
    score.  A null or empty text has no findings; rows are looked at one by one, so shared or null
    ids and repeated rows each give their own; an empty table gives none.  With ``carry`` the
    whole row is in a struct ``row``; columns of ``docs`` keep their names there.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias(id_col), _findings(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("findings"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []))
    return rows


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each finding, with its ``secret``: the text at its place."""
    rows = scanned(docs, id_col, text_col, carry=True)
    found = rows.select(id_col, F.col(f"row.`{text_col}`").alias("_text"), F.explode("findings").alias("f"))
    return found.select(id_col, "f.*", F.substring("_text", (F.col("f.start") + 1).cast("int"), (F.col("f.end") - F.col("f.start")).cast("int")).alias("secret"))


def digests(found: DataFrame) -> DataFrame:
    """``found`` as counts of the base kinds, a SHA-256 of the base places, and all places as text."""
    listed = lambda some: F.array_join(F.transform(some, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base: Column = F.filter("findings", lambda f: f["kind"] != KINDS[3])
    return found.select(*[c for c in found.columns if c not in ("findings", "row")], *[count(k) for k in KINDS[:3]], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"))
