"""Operator 3: near-duplicate groups by one-permutation MinHash.

1. Each text becomes the set of its 64-bit shingle hashes; documents with equal sets are
   one class from then on.
2. One hash of each shingle gives both its bin and its rank: the least of each bin is the
   sketch.  Empty bins borrow from a bin that a hash of (bin, attempt) points to, until one
   is found that isn't empty (optimal densification), so that two sets borrow alike.
3. Bands of the sketch are bucket keys.  A bucket links its members to one hub, the member
   whose buckets are the fullest (the text that the others were copied from falls in with
   most of them), so its candidate edges are as many as its members.
4. Links are confirmed on the full sets, and components formed.  Buckets whose members are
   then still in different components get eight more hubs; small ones get all members as
   hubs, so there no pair stays unseen.  While that brings together a good part of what is
   apart in large buckets, one more hub for each of them, chosen anew, follows.
5. What then is still apart is compared in full: everything outside a family's largest
   component with all of the family, in blocks of bounded size, so no pair of different
   components that shared a bucket stays unseen.

Two 64-bit hashes that agree count as one shingle; for a pair of documents of a million
words the odds are below 1e-7.  A pair at the threshold shares no bucket with odds of about
1e-8, growing to 1e-5 for pairs whose sketch happens to fall three deviations low.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored
from .components import components

SHINGLE_WORDS = 5
#: Least similarity of linked documents, in hundredths.
THRESHOLD = 85
#: Words whose hashes a worker remembers.
MEMO_WORDS = 500_000
#: Buckets up to this size are compared in full, larger ones by stars.
SMALL_BUCKET = 16
MORE_HUBS = 8
#: Bins of the sketch, slots in a band, and bands.
BANDING = (256, 6, 42)
#: Another hub is tried while that brings together so large a part of what is apart.
WORTH = 0.25
#: Members, and shingles, of a block of the comparison in full.
BLOCK_MEMBERS, BLOCK_SHINGLES = 2_000, 1_000_000


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= MEMO_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


_words = _WordHash()
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one scrambling of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Odd multipliers that tell the places within a shingle, or within a band, apart.
_PLACES = _mix(np.arange(1, 65, dtype=_U)) | _U(1)


def shingles(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text: A-Z lower-cased, words parted by ASCII white space.

    A text of fewer words than ``size`` is one shingle; without words, or null, there is none.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, dtype=_U)
    hashes = np.fromiter(map(_words.__getitem__, words), dtype=_U, count=len(words))
    n = max(1, len(words) - size + 1)
    total = np.full(n, min(len(words), size), dtype=_U)
    for k in range(min(size, len(words))):
        total += _mix(hashes[k : k + n] * _PLACES[k])
    return np.unique(_mix(total))


def sketch(hashes: np.ndarray, bins: int) -> np.ndarray:
    """Least hash of each bin (the top bits are the bin), empty bins filled by optimal densification.

    ``hashes`` is sorted and not empty; ``bins`` is a power of two.
    """
    place = (hashes >> _U(65 - bins.bit_length())).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    out = np.zeros(bins, dtype=_U)
    filled = np.zeros(bins, dtype=bool)
    out[place[first]], filled[place[first]] = hashes[first], True
    source, todo, attempt = np.arange(bins), np.flatnonzero(~filled), 1
    while len(todo):
        probe = (_mix(todo.astype(_U) * _PLACES[1] + _PLACES[2:3] * _U(attempt)) % _U(bins)).astype(np.int64)
        hit = filled[probe]
        source[todo[hit]] = probe[hit]
        todo, attempt = todo[~hit], attempt + 1
    return out[source]


def band_keys(signature: np.ndarray, slots: int, bands: int) -> np.ndarray:
    """A 64-bit key for each band.  Bands beyond the sketch's length take slots by a fixed shuffle."""
    order, turn = np.arange(len(signature)), 0
    picks = []
    while len(picks) < bands:
        if turn:
            order = np.argsort(_mix(np.arange(len(signature), dtype=_U) + _U(turn) * _PLACES[3]), kind="stable")
        picks += [order[k : k + slots] for k in range(0, len(order) - slots + 1, slots)]
        turn += 1
    chosen = signature[np.array(picks[:bands])]
    keys = _mix(np.arange(bands, dtype=_U) * _PLACES[4])
    for k in range(slots):
        keys = _mix(keys + chosen[:, k] * _PLACES[5])
    return keys


def _described(docs: DataFrame, bins: int, slots: int, bands: int, size: int) -> DataFrame:
    """``id, n_shingles, class_key, bands`` of ``docs (id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key, keys = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, size)
                n.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(band_keys(sketch(s, bins), slots, bands).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "n_shingles", "class_key", "bands"])

    return docs.mapInArrow(run, "id long, n_shingles long, class_key binary, bands array<long>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """``id, shingles`` of ``docs (id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, size).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    return docs.mapInArrow(run, "id long, shingles array<long>")


def _shared(keys: DataFrame) -> DataFrame:
    """``key, id, n``: the members of buckets ``(key, id)`` that have more than one."""
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return stored(keys.join(sizes, "key"), "buckets")


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The edges ``a, b`` between components, of those of ``pairs (id, hub, a, b)`` whose full sets are similar enough."""
    both = pairs.join(sets.select("id", F.col("shingles").alias("x")), "id").join(sets.select(F.col("id").alias("hub"), F.col("shingles").alias("y")), "hub")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(100 * shared >= threshold * (F.size("x") + F.size("y") - shared)).select("a", "b")


def _pairs(members: DataFrame, group: list[str]) -> DataFrame:
    """Members of each bucket with the hub of each group in it, and both's components, where these differ.

    A hub is the heaviest member of its group, of these the one of the least id.
    """
    hubs = members.groupBy(*group).agg(F.max_by(F.struct("id", "component"), F.struct("weight", -F.col("id"))).alias("hub")).select("key", "hub")
    joined = members.join(hubs, "key").where("component <> hub.component")
    return joined.select("id", F.col("hub.id").alias("hub"), F.col("component").alias("a"), F.col("hub.component").alias("b")).distinct()


def _mixed(members: DataFrame) -> DataFrame:
    """The members of the buckets that more than one component has a part in."""
    mixed = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    return members.join(mixed, "key")


def _renamed(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` whose ``component`` has joined another by ``names (node, component)``."""
    names = names.select(F.col("node").alias("component"), F.col("component").alias("_new"))
    return rows.join(names, "component", "left").withColumn("component", F.coalesce("_new", "component")).drop("_new")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Shingles that each of ``left`` has in common with each of ``right``.

    Shingles of many sets are counted by matrix products, rare ones pair by pair.
    """
    n, m = len(left), len(right)
    out = np.zeros((n, m), dtype=np.int64)
    if not n or not m:
        return out
    row = np.repeat(np.arange(n), [len(s) for s in left])
    column = np.repeat(np.arange(m), [len(s) for s in right])
    known, a = np.unique(np.concatenate(left), return_inverse=True)
    tokens = np.concatenate(right)
    b = np.minimum(np.searchsorted(known, tokens), max(len(known) - 1, 0))
    hit = known[b] == tokens if len(known) else np.zeros(len(tokens), dtype=bool)
    b, column = b[hit], column[hit]
    often_a, often_b = np.bincount(a, minlength=len(known)), np.bincount(b, minlength=len(known))
    frequent = often_a * often_b > 10_000
    dense = np.flatnonzero(frequent)
    place = np.full(len(known), -1)
    place[dense] = np.arange(len(dense))
    for begin in range(0, len(dense), 2048):
        x, y = (np.zeros((k, min(2048, len(dense) - begin)), dtype=np.float32) for k in (n, m))
        for table, where, code in ((x, row, place[a]), (y, column, place[b])):
            inside = (code >= begin) & (code < begin + 2048)
            table[where[inside], code[inside] - begin] = 1
        out += (x @ y.T).astype(np.int64)
    # The rest: each occurrence on the left meets those of its shingle on the right.
    order = np.argsort(b, kind="stable")
    b, column = b[order], column[order]
    rare = ~frequent[a] & (often_b[a] > 0)
    a, row = a[rare], row[rare]
    first = np.searchsorted(b, a)
    for begin in range(0, len(a), 1 << 17):
        some = slice(begin, begin + (1 << 17))
        times = often_b[a[some]]
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        cells = np.repeat(row[some], times) * m + column[np.repeat(first[some], times) + step]
        out += np.bincount(cells, minlength=n * m).reshape(n, m)
    return out


def _joined(table: pa.Table, threshold: int) -> pa.Table:
    """Edges between components by links between the two sides of a block pair, as few as join the same components."""
    sides = [table.filter(pa.compute.equal(table["side"], side)) for side in (0, 1)]
    own = table.num_rows and not sides[1].num_rows
    parts, sizes, sets = [], [], []
    for t in (sides[0], sides[0] if own else sides[1]):
        parts.append(t["component"].to_pylist())
        sizes.append(t["size"].to_numpy())
        sets.append([np.asarray(x.values, dtype=np.int64) for x in t["tokens"]])
    common = common_counts(*sets)
    similar = 100 * common >= threshold * (sizes[0][:, None] + sizes[1][None, :] - common)
    label: dict[int, int] = {}

    def root(c: int) -> int:
        while (up := label.get(c, c)) != c:
            label[c] = c = label.get(up, up)
        return c

    a, b = [], []
    for i, j in zip(*(k.tolist() for k in np.nonzero(similar)), strict=True):
        x, y = root(parts[0][i]), root(parts[1][j])
        if x != y:
            label[x] = y
            a.append(x)
            b.append(y)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _in_full(apart: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Edges between components that links between the members ``apart (key, id, component)`` of mixed buckets make, by comparing blocks of their full sets.

    A family is what buckets chain together.  Shingles that one member alone has count in
    sizes only, and a set with too few others has no link.  Of a family's largest component
    no two blocks are compared with each other, of others all that are alike in size.
    """
    lowest = apart.groupBy("key").agg(F.min("id").alias("low"))
    family = stored(components(apart.join(lowest, "key").select(F.col("low").alias("a"), F.col("id").alias("b"))).withColumnsRenamed({"node": "id", "component": "family"}), "families")
    left = apart.groupBy("id").agg(F.any_value("component").alias("component")).join(family, "id")
    tokens = stored(sets.join(left.select("id"), "id", "left_semi").select("id", F.size("shingles").alias("size"), F.explode("shingles").alias("token")), "tokens")
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("token")
    # Shingles that cross no two members don't reach the arrays; members below the threshold of common ones don't go on.
    able = tokens.join(often, "token").groupBy("id", "size").agg(F.collect_list("token").alias("tokens")).where(100 * F.size("tokens") >= threshold * F.col("size"))
    members = stored(able.join(left, "id"), "able")
    parts = members.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = parts.groupBy("family").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    # Sets whose sizes are two classes apart can't be similar enough.
    size_class = F.floor(F.log(F.col("size").cast("double")) / (1e-6 - math.log(threshold / 100))).cast("int")
    members = members.join(largest, "family").withColumns({"rest": F.col("component") != F.col("largest"), "class": size_class})
    group = ["family", "class", "rest"]
    slots = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_MEMBERS, F.sum(F.size("tokens")) / BLOCK_SHINGLES)).cast("int")
    sizes = stored(members.groupBy(*group).agg(slots.alias("slots")), "slots")
    placed = stored(members.join(sizes, group).withColumn("slot", F.pmod(F.xxhash64("id"), F.col("slots")).cast("int")), "placed")
    blocks = sizes.select(*group, F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
    block = F.struct("class", "rest", "slot")
    pairs = blocks.where("rest").select("family", block.alias("x")).join(blocks.select("family", block.alias("y")), "family")
    pairs = pairs.where((F.abs(F.col("x.class") - F.col("y.class")) <= 1) & (~F.col("y.rest") | (F.col("x") <= F.col("y"))))
    pairs = stored(pairs.withColumn("task", F.xxhash64("family", "x", "y")), "tasks")
    sides = pairs.select("family", "task", F.lit(0).alias("side"), "x.*").unionByName(pairs.where("x <> y").select("family", "task", F.lit(1).alias("side"), "y.*"))
    sent = placed.join(sides, [*group, "slot"]).select("task", "side", "component", F.col("size").cast("long").alias("size"), "tokens")
    return sent.groupBy("task").applyInArrow(lambda table: _joined(table, threshold), "a long, b long")


def _linked(shared: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """``node, component`` of the members of buckets ``shared (key, id, n)`` that are linked with others."""
    weights = shared.groupBy("id").agg(F.sum("n").alias("weight"))
    members = stored(shared.join(weights, "id").withColumn("component", F.col("id")), "members")
    steps: list[DataFrame] = []  # the components after each step, as names of those before it

    def joined(edges: DataFrame, members: DataFrame) -> DataFrame:
        """The mixed buckets among ``members`` once ``edges`` have joined their components."""
        edges = stored(edges, "links")
        if not edges.isEmpty():
            steps.append(stored(components(edges), "names"))
            members = _renamed(members, steps[-1])
        return stored(_mixed(members), "mixed")

    def hubs(members: DataFrame, group: list[str]) -> DataFrame:
        return joined(_confirmed(stored(_pairs(members, group), "pairs"), sets, threshold), members)

    left = hubs(members, ["key"])
    turn = F.when(F.col("n") <= SMALL_BUCKET, F.col("id")).otherwise(F.pmod(F.xxhash64("id"), F.lit(MORE_HUBS)))
    left = stored(hubs(left.withColumn("turn", turn), ["key", "turn"]).where(F.col("n") > SMALL_BUCKET), "large")
    count, salt = left.count(), 0
    while count:
        before, salt = count, salt + 1
        left = hubs(left.withColumn("weight", F.xxhash64("id", F.lit(salt))), ["key"])
        count = left.count()
        if count > (1 - WORTH) * before:
            break
    if count:
        joined(_in_full(left, sets, threshold), left)
    if not steps:
        return members.limit(0).select(F.col("id").alias("node"), "component")
    named = steps[0]
    for later in steps[1:]:
        # A later step also joins components of one member, which no step before has named.
        named = _renamed(named, later).unionByName(later.join(named.select("node"), "node", "left_anti"))
    return named


def _grouped(texts: DataFrame, threshold: int, size: int) -> DataFrame:
    """``id, n_shingles, component`` of ``texts (id, text)`` whose ids are unique and not null."""
    described = stored(_described(texts, *BANDING, size), "described")
    known = described.where("class_key IS NOT NULL")
    classes = stored(known.groupBy("class_key").agg(F.min("id").alias("rep"), F.any_value("bands").alias("bands")), "classes")
    shared = _shared(classes.select(F.explode("bands").alias("key"), F.col("rep").alias("id")))
    # The one shuffle of texts. It is a merge join at any size: the members of shared buckets grow with the corpus.
    sets = stored(_sets(texts.join(shared.select("id").distinct().hint("merge"), "id", "left_semi"), size), "sets")
    linked = _linked(shared, sets, threshold)
    # Classes of one document in no component need no row here.
    named = classes.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("class_key", F.coalesce("component", "rep").alias("component"))
    return described.join(named, "class_key", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, size: int = SHINGLE_WORDS) -> DataFrame:
    """``id, n_shingles, component_id, kept`` for each row of ``docs``.

    Documents are linked if 100 * |intersection| >= threshold * |union| of their shingle
    sets; a component takes the least id in it and keeps that document.  Null and blank
    texts have no shingles and stand alone.  Rows that share an id are judged one by one, each
    by its own text, and may so be in different components; those of equal texts are in one.
    A row with a null id has neither component nor links and is kept.  Other columns are not read.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    named = texts.where("id IS NOT NULL")
    if named.groupBy("id").count().where("count > 1").isEmpty():
        out = _grouped(named, threshold, size)
    else:  # rows take numbers in place of their ids, and components the least id of their rows
        rows = stored(named.withColumn("row", F.monotonically_increasing_id()), "rows")
        of_row = stored(_grouped(rows.select(F.col("row").alias("id"), "text"), threshold, size).withColumnRenamed("id", "row").join(rows.select("row", "id"), "row"), "of_row")
        least = of_row.groupBy("component").agg(F.min("id").alias("least"))
        out = of_row.join(least, "component").select("id", "n_shingles", F.col("least").alias("component"))
    out = out.select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), (F.col("component") == F.col("id")).alias("kept"))
    nameless = _described(texts.where("id IS NULL"), *BANDING, size)
    return out.unionByName(nameless.select(F.col("id").alias(id_col), "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")))
