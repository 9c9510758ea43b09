"""Dependencies between catalog objects: edges ``(src, dst)`` say that src needs dst."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import numbered, spread, stored

from .contraction import cycles, has_cycles, longest_paths, strong_components


def table_references(statements: DataFrame) -> DataFrame:
    """Names after FROM and JOIN in each statement, once each."""
    found = F.regexp_extract_all("sql_text", F.lit(r"(?i)\b(?:FROM|JOIN)\s+([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?)"), F.lit(1))
    return statements.select("stmt_id", F.explode(F.array_distinct(F.transform(found, lambda x: F.lower(x)))).alias("ref"))


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """How many objects each one needs, and how many need it."""
    once = edges.distinct()
    out = once.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("needs"))
    back = once.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("needed_by"))
    return out.join(back, "node", "full").select("node", F.coalesce("needs", F.lit(0)).alias("needs"), F.coalesce("needed_by", F.lit(0)).alias("needed_by"))


def closure(edges: DataFrame) -> DataFrame:
    """All pairs (src, dst) where src needs dst directly or through others, itself too if it is in a cycle.

    A round joins the pairs that the last one found, behind and before, with what is known, so
    paths double in length and no old pairs meet again; each round writes its new pairs only.
    """
    new = stored(edges.select("src", "dst").distinct())
    known = [new]
    while not new.isEmpty():
        reach = reduce(DataFrame.unionByName, known)
        fresh = new.select(F.col("src").alias("a"), F.col("dst").alias("b"))
        longer = fresh.join(reach, F.col("b") == F.col("src")).select(F.col("a").alias("src"), "dst").unionByName(fresh.join(reach, F.col("a") == F.col("dst")).select("src", F.col("b").alias("dst")))
        new = stored(longer.distinct().join(reach, ["src", "dst"], "left_anti"))
        known.append(new)
    return reduce(DataFrame.unionByName, known)


def in_cycles(edges: DataFrame) -> DataFrame:
    """Nodes that need themselves, directly or through others."""
    return strong_components(edges).select("node")


def has_cycle(edges: DataFrame) -> DataFrame:
    return has_cycles(edges).agg((F.count(F.lit(1)) > 0).alias("has_cycle"))


def cycle_paths(edges: DataFrame) -> DataFrame:
    """One cycle of each component as an array that begins and ends with its least node (:func:`cycles` has the same as rows)."""
    rows = cycles(edges).groupBy("component").agg(F.array_sort(F.collect_list(F.struct("place", "node"))).alias("p"))
    names = F.transform("p", lambda x: x["node"])
    return rows.select("component", F.size("p").cast("long").alias("length"), F.concat(names, F.slice(names, 1, 1)).alias("path"))


class CircularDependency(ValueError):
    """Objects need each other, so they have no order."""


def depths(edges: DataFrame, strict: bool = False) -> DataFrame:
    """Length of each node's longest path to a node that needs nothing.

    Nodes in or above cycles have none; with ``strict`` a cycle is an error that shows the first one.
    """
    if strict:
        first = cycles(edges).groupBy().agg(F.min("component").alias("c")).first()["c"]
        if first is not None:
            shown = [r["node"] for r in cycles(edges).where(F.col("component") == first).orderBy("place").limit(20).collect()]
            raise CircularDependency("Circular dependency: " + " -> ".join([*shown, first if len(shown) < 20 else "..."]))
    return longest_paths(edges)


def creation_order(edges: DataFrame) -> DataFrame:
    """A place for each settled node such that what it needs comes first: by depth, then by name."""
    return numbered(depths(edges), "depth", "node").select("node", "depth", "place")


#: The order in which kinds of objects are created.
KIND_ORDER = ("sequence", "table", "index", "view", "procedure", "trigger")


def canonical_order(objects: DataFrame) -> DataFrame:
    """Objects by kind, lower-case schema (public if none) and lower-case name."""
    priority = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), F.col("kind")), F.lit(99)).cast("int")
    rows = objects.select("object_id", "kind", priority.cast("long").alias("priority"), F.lower(F.coalesce("schema_name", F.lit("public"))).alias("_schema"), F.lower("name").alias("_name"))
    placed = stored(numbered(rows, "kind", "_schema", "_name", "object_id", name="_number").drop("_schema", "_name"))
    first = placed.groupBy("kind").agg(F.min("_number").alias("_first"))
    return placed.join(first, "kind").select("object_id", "kind", (F.col("_number") - F.col("_first") + 1).alias("place"), "priority")


def dependency_order(objects: DataFrame, edges: DataFrame, strict: bool = True) -> DataFrame:
    """A place for each object by kind, then depth, schema and name; objects that no edge names have depth 0.

    ``objects (kind, schema_name, name)`` are keyed as :func:`object_key` does.  A cycle is an error
    unless ``strict`` is false; objects in or above it then come last of their kind, without a depth.
    """
    priority = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), F.col("kind")), F.lit(99)).cast("long")
    keyed = objects.select(object_key(F.col("kind"), F.col("schema_name"), F.col("name")).alias("node"), priority.alias("priority"), F.lower(F.coalesce("schema_name", F.lit("public"))).alias("_schema"), F.lower("name").alias("_name")).distinct()
    known = depths(edges, strict)
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct().withColumn("_edge", F.lit(True))
    rows = keyed.join(nodes, "node", "left").join(known, "node", "left").withColumn("depth", F.when(F.col("_edge").isNull(), F.lit(0).cast("long")).otherwise(F.col("depth")))
    rows = rows.withColumn("_last", F.coalesce("depth", F.lit((1 << 62))))
    return numbered(rows, "priority", "_last", "_schema", "_name", "node").select("node", "priority", "depth", "place")


def object_key(kind: Column, schema: Column, name: Column, default: str = "public") -> Column:
    """Lower-case ``schema.kind.name``."""
    return F.concat_ws(".", F.lower(F.coalesce(schema, F.lit(default))), kind, F.lower(name))


def implied_edges(objects: DataFrame) -> DataFrame:
    """Edges that kinds imply: an index or trigger needs the table of its schema and name; keys are lower-case schema.kind.name."""
    rows = objects.select("kind", F.lower(F.coalesce("schema_name", F.lit("public"))).alias("s"), F.lower("name").alias("n")).distinct()
    key = lambda kind: F.concat_ws(".", F.col("s"), kind, F.col("n"))
    tables = rows.where("kind = 'table'").select("s", "n")
    return rows.where("kind IN ('index', 'trigger')").join(tables, ["s", "n"]).select(key(F.col("kind")).alias("src"), key(F.lit("table")).alias("dst"))


def object_edges(definitions: DataFrame, references: DataFrame, default: str = "public") -> DataFrame:
    """All dependencies as one typed relation ``src, dst, via, found``.

    ``definitions (kind, schema_name, name, sql_text)`` are the objects; the text is the query of a view or
    the body of a procedure, else null.  ``references (kind, schema_name, name, via, ref_schema, ref_name)`` are the names that objects state:
    ``via`` is foreign_key or inherits (of a table), on (of an index or trigger), calls or
    follows (of a trigger).  A name without a schema is looked for in the object's own schema, then in the default
    one; names behind FROM and JOIN in a view's text may be views or tables, in that order, in a
    procedure's only tables.  ``found`` says whether there is such an object; if there is none, the name is taken to be
    in the schema that it states, else in the object's own.  Names are compared in lower case; a null kind
    or name, or a reference without a name, gives no edge.
    """
    low = lambda c: F.lower(F.trim(c))
    named = definitions.where("kind IS NOT NULL AND name IS NOT NULL").select("kind", F.coalesce(low(F.col("schema_name")), F.lit(default)).alias("s"), low(F.col("name")).alias("n"), "sql_text")
    targets = named.select(F.col("kind").alias("k"), F.col("s").alias("ts"), F.col("n").alias("rn")).distinct()
    # What kinds of objects each kind of reference may mean.
    means = {"foreign_key": ("table",), "inherits": ("table",), "on": ("table",), "calls": ("procedure",), "follows": ("trigger",), "view_text": ("view", "table"), "procedure_text": ("table",)}
    stated = references.where("kind IS NOT NULL AND name IS NOT NULL").select("kind", F.coalesce(low(F.col("schema_name")), F.lit(default)).alias("s"), low(F.col("name")).alias("n"), "via", low(F.col("ref_schema")).alias("rs"), low(F.col("ref_name")).alias("rn"))
    words = F.regexp_extract_all("sql_text", F.lit(r"(?i)\b(?:FROM|JOIN)\s+([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?)"), F.lit(1))
    texts = named.where("kind IN ('view', 'procedure')").select("kind", "s", "n", F.concat(F.col("kind"), F.lit("_text")).alias("via"), F.explode(F.array_distinct(F.transform(words, F.lower))).alias("_ref"))
    dotted = F.instr("_ref", ".") > 0
    texts = texts.select("kind", "s", "n", "via", F.when(dotted, F.substring_index("_ref", ".", 1)).alias("rs"), F.substring_index("_ref", ".", -1).alias("rn"))
    asked = stated.unionByName(texts).where("rn IS NOT NULL AND rn <> ''").distinct()
    # Each reference with all that it may mean, in order of preference; the first that exists is meant.
    tries = F.create_map(*[x for via, kinds in means.items() for x in (F.lit(via), F.array(*[F.lit(k) for k in kinds]))])
    schemas = F.when(F.col("rs").isNotNull(), F.array("rs")).otherwise(F.array_distinct(F.array("s", F.lit(default))))
    options = asked.select("*", F.posexplode(tries[F.col("via")]).alias("_k", "k")).select("*", F.posexplode(schemas).alias("_s", "ts"))
    met = options.join(targets.withColumn("_hit", F.lit(True)), ["k", "ts", "rn"], "left")
    rank = F.struct(F.col("_hit").isNull().alias("no"), F.col("_s"), F.when(F.col("_hit").isNull(), -F.col("_k")).otherwise(F.col("_k")).alias("o"))
    best = met.groupBy("kind", "s", "n", "via", "rs", "rn").agg(F.min_by(F.struct("k", "ts", F.col("_hit").isNotNull().alias("found")), rank).alias("b"))
    key = lambda s, k, n: F.concat_ws(".", s, k, n)
    return best.select(key(F.col("s"), F.col("kind"), F.col("n")).alias("src"), key(F.col("b.ts"), F.col("b.k"), F.col("rn")).alias("dst"), "via", F.col("b.found").alias("found")).distinct()


#: Shares that the statements of one name are dealt out in.
SHARES = 64


def mentions(statements: DataFrame, names: DataFrame) -> DataFrame:
    """Statements that hold a name as a word, case aside: words are joined, not every name tried on every text.

    A name may be in most statements, so each goes to ``SHARES`` tasks with a share of the statements.
    """
    texts = spread(statements.select("stmt_id", "sql_text"))
    words = texts.select("stmt_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("sql_text"), F.lit(r"\w+"), F.lit(0)))).alias("name"))
    words = words.withColumn("_share", F.pmod(F.xxhash64("stmt_id"), F.lit(SHARES)))
    wanted = names.select(F.lower("name").alias("name")).distinct().withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
    return words.join(wanted, ["name", "_share"]).select("stmt_id", "name")
