"""Operator 11: the fill-in-middle transformation, by overlapping chunks.

A text is a sequence of tokens: white space and the word behind it, and white space at
the end.  A token ends where a character that isn't white space stands before one that
is, so a boundary is a predicate of two adjacent characters.  Each text is cut into
chunks that share one character with the next, so every pair of adjacent characters is
seen by exactly one chunk, and all chunks are counted side by side, as vectors.  Prefix
sums over the counts say which chunk owns the boundary of a given rank; only the
chunks that own one of the two cuts of a text are scanned again for its place.

White space is in ASCII, so all this works on the bytes of the texts as Arrow holds them;
characters are bytes that don't continue one.  A text is one row, so the chunks of one
text are in one task; texts are spread over tasks and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import small_batches

#: Bytes in a chunk.
CHUNK = 1 << 14
#: Text before the prefix, the suffix and the middle of a rearranged text.
MARKERS = ("<P>", "<S>", "<M>")

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins, with the end behind."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    starts = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


def _chunks(starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each chunk, and the number of the first chunk of each text, with the end behind; empty texts have none."""
    of_text = -(-np.diff(starts) // size)
    first = np.concatenate([[0], np.cumsum(of_text)])
    text = np.repeat(np.arange(len(of_text)), of_text)
    return starts[text] + (np.arange(first[-1]) - first[text]) * size, first


def cut_places(texts: pa.Array, draws: Sequence[np.ndarray], size: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each text, and for each of ``draws`` the characters before the boundary of rank ``draw % (tokens + 1)``.

    Rank 0 is the start of the text and the last rank its end.  Null is empty: no tokens, all
    cuts at 0.
    """
    data, starts = _bytes_of(texts)
    n_texts = len(starts) - 1
    at, first = _chunks(starts, size)
    stop = np.append(at[1:], starts[-1])
    # A boundary lies behind byte i if i is in a word and i + 1 is not; the last byte of a text has no other behind it.
    space = _SPACE[data]
    ends = np.zeros(len(data), dtype=bool)
    np.greater(space[1:], space[:-1], out=ends[:-1])
    filled = np.flatnonzero(np.diff(starts))
    ends[starts[filled + 1] - 1] = False
    character = (data & 0xC0) != 0x80

    count = lambda flags: np.add.reduceat(flags, at, dtype=np.int64) if len(at) else np.zeros(0, dtype=np.int64)
    boundaries, characters = np.concatenate([[0], np.cumsum(count(ends))]), np.concatenate([[0], np.cumsum(count(character))])
    n = boundaries[first[1:]] - boundaries[first[:-1]]
    n[filled] += 1
    length = characters[first[1:]] - characters[first[:-1]]

    places = np.zeros((len(draws), n_texts), dtype=np.int64)
    for k, draw in enumerate(draws):
        rank = np.asarray(draw, dtype=np.int64) % (n + 1)
        places[k] = np.where(rank == n, length, 0)
        for t in np.flatnonzero((rank > 0) & (rank < n)):
            wanted = boundaries[first[t]] + rank[t]
            owner = np.searchsorted(boundaries, wanted, "left") - 1
            cut = at[owner] + np.flatnonzero(ends[at[owner] : stop[owner]])[wanted - boundaries[owner] - 1] + 1
            places[k, t] = characters[owner] - characters[first[t]] + np.count_nonzero(character[at[owner] : cut])
    return n, places


@F.arrow_udf(StructType([StructField(c, LongType()) for c in ("n", "first", "second")]))
def _cuts(texts: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
    n, places = cut_places(texts, [a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False)])
    return pa.StructArray.from_arrays([pa.array(n), pa.array(places.min(0)), pa.array(places.max(0))], ["n", "first", "second"])


def drawn(id_: Column, nth: int, seed: int) -> Column:
    """The nth number of a row: eight digits of the hexadecimal SHA-256 of seed, colon and id (a null id is empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * nth + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, rate: int = 50, spm_rate: int = 80, seed: int = 42, markers: Sequence[str] = MARKERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's text rearranged: ``id, n, form, prefix_chars, middle_chars, output``.

    ``n`` counts tokens.  Two draws from the id cut the text at boundaries of tokens into prefix,
    middle and suffix, each possibly empty.  ``rate`` percent of the texts are rearranged,
    ``spm_rate`` percent of those with the suffix first (``spm``), others with the prefix first
    (``psm``); ``plain`` texts stay as they are, as do empty ones and those that hold a marker;
    there both lengths are null.  A null text is empty, a null id counts as an empty one,
    rows that share an id and a text give equal rows, an empty table gives none.  Other columns
    of ``docs`` are not read.
    """
    small_batches(docs.sparkSession)
    p, s, m = (F.lit(x) for x in markers)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), *[drawn(F.col(id_col), k, seed).alias(f"h{k + 1}") for k in range(4)])
    rows = rows.withColumn("cut", _cuts("text", "h1", "h2"))
    plain = (F.col("text") == "") | (F.col("h3") % 100 >= rate)
    for mark in (p, s, m):
        plain |= F.contains("text", mark)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm")
    rows = rows.select("id", "text", "cut.*", form.alias("form"))
    prefix, middle = F.substring("text", F.lit(1), F.col("first").cast("int")), F.substring("text", (F.col("first") + 1).cast("int"), (F.col("second") - F.col("first")).cast("int"))
    suffix = F.substring("text", (F.col("second") + 1).cast("int"), F.lit(2**31 - 1))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    shown = lambda c: F.when(F.col("form") != "plain", c)
    return rows.select(F.col("id").alias(id_col), "n", "form", shown(F.col("first")).alias("prefix_chars"), shown(F.col("second") - F.col("first")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The text that gave ``output`` in ``form``: the parts behind the markers, put back in order."""
    p, s, m = markers
    behind = lambda mark: F.split_part(output, F.lit(mark), F.lit(2))
    until = lambda part, mark: F.split_part(part, F.lit(mark), F.lit(1))
    psm = F.concat(until(behind(p), s), behind(m), until(behind(s), m))
    spm = F.concat(until(behind(p), m), behind(m), until(behind(s), p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digests(transformed: DataFrame, markers: Sequence[str] = MARKERS) -> DataFrame:
    """``transformed`` with SHA-256 of the output and of the text restored from it, in place of the output."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return transformed.withColumns({"output_sha256": sha(F.col("output")), "restored_sha256": sha(restored(F.col("output"), F.col("form"), markers))}).drop("output")
