"""Operator 2: exact token counts of every prefix, by prefix dynamic programming.

A sequence of BPE tokens is the encoding of its bytes exactly if each two neighbours
are (that is, encoding the pair's bytes gives the pair again).  So the last token of
each prefix follows from the last tokens of shorter prefixes: it is the only
vocabulary entry that ends there and may follow the last token of what it leaves.
One pass gives the count at every prefix, and later truncation or budget questions
read the table instead of encoding again.

The table is stored as one signed difference per character (``prefix_deltas``); its
running sum is the count at each prefix.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .tokens import PieceWise, byte_alphabet, default_tokenizer

#: The first so many bytes of pre-tokens are remembered with their counts, so many of them.
HEAD, HEADS = 7, 200_000
_WHITE = re.compile(r"\s\s+")
_CONTRACTIONS = {"'re", "'ve", "'ll", "'s", "'t", "'m", "'d"}


class PrefixCounter:
    """Token counts of all prefixes of pieces of text, for one byte-level BPE vocabulary."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        specials = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials)) if specials else r"(?!)")
        self.split = regex.compile(public_tokenizers.PATTERN).finditer
        alphabet = byte_alphabet()
        self.shown = dict(enumerate(alphabet))
        self.heads: dict[str, tuple[list[int], list[int]]] = {}
        # Tokens are numbered here in the order in which merging makes them: bytes, then one for each merge.
        with open(path, encoding="utf-8") as f:
            merges = [m if isinstance(m, list) else m.split(" ") for m in json.load(f)["model"]["merges"]]
        self.number = {s: n for n, s in enumerate(alphabet + [a + b for a, b in merges])}
        #: Length of the longest token that ends in these three characters.
        self.longest: dict[str, int] = {}
        for token in self.number:
            if len(token) > 2:
                self.longest[token[-3:]] = max(len(token), self.longest.get(token[-3:], 0))
        self.parts = [(n, n) for n in range(256)] + [(self.number[a], self.number[b]) for a, b in merges]
        self.merged = {p: n for n, p in enumerate(self.parts) if n >= 256}

    def _may_follow(self, left: int, right: int) -> bool:
        """Does encoding the bytes of both tokens give both?

        Undo the merges of both, latest first: the pair stands unless two parts that touch
        at the border would have merged before the merges that made up the tokens.
        """
        merged, parts = self.merged.get, self.parts
        before = len(parts)
        while True:
            if merged((left, right), before) < before:
                return False
            if left > right:
                before, left = left, parts[left][1]
                if left == before:  # a byte has no parts
                    before, right = right + 1, parts[right][0]
                    if right + 1 == before:
                        return True
            else:
                before, right = right + 1, parts[right][0]
                if right + 1 == before:
                    before, left = left, parts[left][1]
                    if left == before:
                        return True

    def pre_token(self, word: str) -> list[int]:
        """Counts at the prefixes of one pre-token, a count for each character."""
        s = word.encode().decode("latin-1").translate(self.shown)
        head = s[:HEAD]
        if (known := self.heads.get(head)) is None:
            if len(self.heads) >= HEADS:
                self.heads.clear()
            known = self.heads[head] = self._extend(head, [-1], [0])
        last, count = known if len(s) <= HEAD else self._extend(s, [*known[0]], [*known[1]])
        if len(s) == len(word):
            return count[1:]
        return [count[end] for end in accumulate(len(c.encode()) for c in word)]

    def _extend(self, s: str, last: list[int], count: list[int]) -> tuple[list[int], list[int]]:
        """Last token and count of each prefix of ``s``, from those of its first prefixes on."""
        number, longest, may = self.number.get, self.longest.get, self._may_follow
        for end in range(len(last), len(s) + 1):
            first = end - longest(s[end - 3 : end], 2) if end > 2 else 0
            for begin in range(first if first > 0 else 0, end):
                token = number(s[begin:end])
                if token is not None and (not begin or may(last[begin], token)):
                    last.append(token)
                    count.append(count[begin] + 1)
                    break
        return last, count

    def counts(self, piece: str) -> list[int]:
        """Counts at the prefixes of a piece, as encoding each prefix alone would give."""
        if piece.removeprefix(" ").isalpha():
            return self.pre_token(piece)
        if self.special.search(piece):
            return self._with_specials(piece)
        out: list[int] = []
        base = 0
        for m in self.split(piece):
            word = m.group()
            if word in _CONTRACTIONS:  # cut short, it falls into a quote and letters
                inner = [1] + [1 + n for n in self.pre_token(word[1:])]
                inner[-1] = self.pre_token(word)[-1]
            else:
                inner = self.pre_token(word)
            out += [base + n for n in inner]
            base = out[-1]
        for m in _WHITE.finditer(piece):  # cut inside a run of white space, all of it is one pre-token
            a, b = m.span()
            before = out[a - 1] if a else 0
            out[a:b] = [before + n for n in self.pre_token(m.group())]
        return out

    def _with_specials(self, piece: str) -> list[int]:
        """Counts for a piece with special strings: what stands between them is encoded apart, and one that is cut short is plain text."""
        out: list[int] = []
        base = begin = 0
        for m in self.special.finditer(piece):
            inner = self.counts(piece[begin : m.end() - 1]) if m.end() - 1 > begin else []
            out += [base + n for n in inner]
            base += (inner[m.start() - begin - 1] if m.start() > begin else 0) + 1
            out.append(base)
            begin = m.end()
        return out + ([base + n for n in self.counts(piece[begin:])] if begin < len(piece) else [])

    def deltas(self, piece: str) -> bytes:
        """Differences of :meth:`counts`, as 16-bit integers."""
        counts = self.counts(piece)
        return struct.pack(f"<{len(counts)}h", counts[0], *map(int.__sub__, counts[1:], counts))


_counters: dict = {}


def prefix_table(text: str | None, path: str | None = None) -> np.ndarray:
    """Counts at all prefixes of a whole text: element k is the count of its first k + 1 characters."""
    path = path or default_tokenizer()
    if path not in _counters:
        _counters[path] = PieceWise(PrefixCounter(path).deltas)
    return np.cumsum(np.frombuffer(_counters[path](text), dtype="<i2"), dtype=np.int64)


def longest_prefix(deltas: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens, from a stored table."""
    counts = np.cumsum(np.frombuffer(deltas, dtype="<i2"), dtype=np.int64)
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def tokens_at(deltas: bytes, n_chars: int) -> int:
    """Tokens of the first ``n_chars`` characters, from a stored table."""
    return int(np.frombuffer(deltas, dtype="<i2")[: max(0, n_chars)].sum(dtype=np.int64))


def with_prefix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, with_text: bool = False) -> DataFrame:
    """``id, n_bytes, n_tokens, prefix_deltas`` for each row of ``docs``, and its text if asked for.

    A null text counts as empty: no bytes, no tokens, an empty table.  Rows with equal
    or null ids each keep a row.  Other columns of ``docs`` are not read.  The work grows with
    a text's length, whether it has spaces or not, and with special strings as without.
    """
    path = tokenizer or default_tokenizer()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = PieceWise(PrefixCounter(path).deltas)
        table = _counters[path]
        for batch in batches:
            tables = [table(t) for t in batch.column(2).to_pylist()]
            n = [int(np.frombuffer(t, dtype="<i2").sum(dtype=np.int64)) for t in tables]
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(tables, pa.binary()), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns if with_text else columns[:4], ["id", "n_bytes", "n_tokens", "prefix_deltas", "text"][: 4 + with_text])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.octet_length(F.coalesce(text_col, F.lit(""))).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    schema = "id long, n_bytes long, n_tokens long, prefix_deltas binary" + ", text string" * with_text
    return rows.mapInArrow(run, schema).withColumnsRenamed({"id": id_col, "text": text_col})


def truncated(counted: DataFrame, budget: int, id_col: str = "doc_id", text_col: str = "text", table_col: str = "prefix_deltas") -> DataFrame:
    """``id, text`` with each text cut to its longest prefix of at most ``budget`` tokens.

    ``counted`` has each text beside the table that :func:`with_prefix_counts` made of it;
    nothing is encoded here.  A null text stays null.
    """
    small_batches(counted.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [None if t is None else t[: longest_prefix(d, budget)] for t, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.string())], ["id", "text"])

    rows = counted.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(table_col, F.lit(b"")).alias("table"))
    return rows.mapInArrow(run, "id long, text string").withColumnsRenamed({"id": id_col, "text": text_col})
