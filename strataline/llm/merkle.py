"""Merkle manifest of a table: built levels stored as parent-linked node rows, climbed by a recursive query.

A leaf is the SHA-256 of a row's fields (``-`` for null, else byte count, colon, value).  Per language the leaves stand in
the order of doc_id; two consecutive nodes become the hash of both, a last odd one the hash of itself, until one is left:
the language's subroot.  The subroots, ordered by language, become the root in the same way.

Nodes are built and stored in storeys of ``HEIGHT`` levels.  A block of up to 2**HEIGHT nodes is one bounded group, and
every node row holds its siblings up to the top of its block and the name of that top as its parent, so that a climb of
k levels takes k / HEIGHT joins.  The climb is a recursive query: each leaf row looks for its parent, appends that
node's siblings to its proof and folds them into its own hash, until it has reached the root.

Positions come from a range sort by (language, doc_id, leaf, place in the table), numbered range by range, so neither a
hot language nor thousands of repeated rows meet in one task.  In the upper storeys many climbers ask for few
nodes; that side is small there, and adaptive execution sends it to them or splits the join.

Defined results: a null language is a tree of its own and comes first; null doc_ids come first in their tree; rows
that are equal in all fields have equal leaves, and one of each such row gets each place; equal doc_ids are ordered by
their leaves; only FIELDS are read, so other columns and their names do not matter; an empty table gives no rows; a lone
leaf is its subroot, a lone subroot the root, and their proof is empty.  Adding 1 to n_chars cannot overflow.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.llm.common import settle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEIGHT = 8            # levels of a storey: blocks of 256 nodes
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"   # rows a recursive query may return; a climb returns a few for each leaf
FOLD = "aggregate({siblings}, lower(hex({start})), (h, s) -> sha2(CASE WHEN s.hash IS NULL THEN h WHEN s.left THEN concat(s.hash, h) ELSE concat(h, s.hash) END, 256))"


@dataclass
class Manifest:
    """leaves: doc_id, leaf, node (the top of its block), folded, proof.  nodes: node, parent, siblings, proof, subroot, root."""

    leaves: DataFrame
    nodes: DataFrame


def _encoded(value: Column) -> Column:
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_rows(docs: DataFrame) -> DataFrame:
    """t (the tree of the row), doc_id, leaf, and start: the leaf that a climb starts from, with 1 added to n_chars in the
    rows whose doc_id's checksum is divisible by 7."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    n_chars = F.when(tampered, F.col("n_chars").cast("decimal(38,0)") + 1).otherwise(F.col("n_chars"))

    def digest(n):
        return F.sha2(F.concat(*[_encoded(n if f == "n_chars" else F.col(f)) for f in FIELDS]), 256)
    leaf = F.unhex(digest(F.col("n_chars")))
    start = F.when(tampered, F.unhex(digest(n_chars))).otherwise(leaf)
    return docs.select(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")).alias("t"), "doc_id", leaf.alias("leaf"), start.alias("start"))


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with their place in the order (pos, from 0) in their tree t, and the tree's number of rows n.

    Rows equal in ``order`` are told apart by their place in the (settled) table."""
    ranged = rows.withColumn("__at", F.monotonically_increasing_id()).repartitionByRange("t", *order, "__at")
    ranged = settle(ranged.withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy("t", "__part").agg(F.count(F.lit(1)).alias("__k"))   # at most ranges + trees rows
    tree = Window.partitionBy("t")
    before = F.sum("__k").over(tree.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("t", "__part", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__k").over(tree).alias("n"))
    inside = F.row_number().over(Window.partitionBy("t", "__part").orderBy(*order, "__at"))
    return ranged.join(counts, ["t", "__part"]).select(*rows.columns, (F.col("__before") + inside - 1).alias("pos"), "n")


def blocks(rows: DataFrame, height: int, *load: str) -> DataFrame:
    """Blocks of the rows (t, pos, n, hash): t, pos (of the block), n (blocks of its tree), h (levels built), levels (the
    hashes of each level, hexadecimal) and the columns ``load`` of the rows, in order."""
    def paired(a):
        two = lambda i: F.concat(F.get(a, 2 * i), F.coalesce(F.get(a, 2 * i + 1), F.lit("")))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 2).cast("int")), lambda i: F.sha2(two(i), 256))
    to_top = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)   # halvings until one node is left
    own = rows.select("t", F.shiftright("pos", height).alias("pos"), "n", F.struct(F.col("pos").alias("i"), "hash", *load).alias("x"))
    held = own.groupBy("t", "pos", "n").agg(F.array_sort(F.collect_list("x"), lambda a, b: (a["i"] - b["i"]).cast("int")).alias("x"))
    held = held.withColumn("h", F.least(F.lit(height), to_top).cast("int"))
    level0 = F.transform("x", lambda x: F.lower(F.hex(x["hash"])))
    steps = F.when(F.col("h") > 0, F.sequence(F.lit(1), F.col("h"))).otherwise(F.array().cast("array<int>"))
    levels = F.aggregate(steps, F.array(level0), lambda done, _: F.concat(done, F.array(paired(F.element_at(done, -1)))))
    n = F.shiftright(F.col("n") + F.lit(2 ** height - 1), height)
    return held.select("t", "pos", n.alias("n"), "h", levels.alias("levels"), "x")


def _members(done: DataFrame, level: int, height: int, *fields) -> DataFrame:
    """One row per member of a block: parent, siblings (hash, left), hash, up (the hash of the block's top), fields."""
    top = F.col("n") == 1
    parent = F.when(top, F.concat(F.lit("/"), "t")).otherwise(F.concat(F.lit(f"{level + height}/"), F.col("pos").cast("string"), F.lit("/"), "t"))
    bit = lambda i, k: F.call_function("shiftright", i, k)
    each = F.when(F.col("h") > 0, F.sequence(F.lit(0), F.col("h") - 1)).otherwise(F.array().cast("array<int>"))
    siblings = lambda i: F.transform(each, lambda k: F.struct(F.get(F.get("levels", k), bit(i, k).bitwiseXOR(F.lit(1))).alias("hash"),
                                                              (bit(i, k) % 2 == 1).alias("left")))
    member = lambda x, i: F.struct(siblings(i).alias("siblings"), F.get(F.get("levels", F.lit(0)), i).alias("hash"), x.alias("x"))
    rows = done.select("t", parent.alias("parent"), F.element_at(F.element_at("levels", -1), 1).alias("up"), F.inline(F.transform("x", member)))
    return rows.select("t", "parent", "siblings", "hash", "up", *fields)


def _storeys(rows: DataFrame, level: int, height: int) -> tuple[list[DataFrame], DataFrame]:
    """The node rows of all storeys from ``level`` (0 in a tree of named rows) up, and t, hash of the trees' tops."""
    nodes, tops = [], []
    while True:
        tops.append(rows.where("n = 1").select("t", "hash"))
        rows = rows.where("n > 1")
        if level and rows.isEmpty():
            break
        done = settle(blocks(rows, height))
        nodes.append(_members(done, level, height, F.concat(F.lit(f"{level}/"), F.col("x.i").cast("string"), F.lit("/"), "t").alias("node")))
        rows = settle(done.select("t", "pos", "n", F.unhex(F.element_at(F.element_at("levels", -1), 1)).alias("hash")))
        level += height
    return nodes, _union(tops)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def build(docs: DataFrame, height: int = HEIGHT) -> Manifest:
    """All levels of the tree, as rows."""
    placed = positions(settle(leaf_rows(docs)), ["doc_id", "leaf"]).withColumn("hash", F.col("leaf"))
    ground = settle(blocks(placed, height, "doc_id", "start"))
    leaves = _members(ground, 0, height, F.col("x.doc_id").alias("doc_id"), F.col("x.hash").alias("leaf"), F.col("x.start").alias("start"))
    leaves = leaves.select("doc_id", "leaf", F.col("parent").alias("node"),
                           F.expr(f"unhex({FOLD.format(siblings='siblings', start='start')})").alias("folded"), _proof().alias("proof"))
    up = settle(ground.select("t", "pos", "n", F.unhex(F.element_at(F.element_at("levels", -1), 1)).alias("hash")))
    nodes, tops = _storeys(up, height, height)
    # the tree of subroots: its leaves are named by the tops of their trees
    named = tops.select(F.lit("").alias("t"), F.col("t").alias("name"), "hash")
    crown = settle(blocks(positions(settle(named), ["name"]), height, "name"))
    first = _members(crown, 0, height, F.concat(F.lit("/"), "x.name").alias("node"))
    rest, _ = _storeys(settle(crown.select("t", "pos", "n", F.unhex(F.element_at(F.element_at("levels", -1), 1)).alias("hash"))), height, height)
    rows = _union([*[n.withColumn("subroot", F.lit(None).cast("string")) for n in [*nodes, *rest]], first.withColumn("subroot", F.col("hash"))])
    return Manifest(leaves, settle(rows.select("node", "parent", "siblings", _proof().alias("proof"), F.unhex("subroot").alias("subroot"),
                                               F.when(F.col("parent") == "/", F.unhex("up")).alias("root"))))


def _proof() -> Column:
    return F.unhex(F.array_join(F.transform("siblings", lambda s: s["hash"]), ""))   # absent siblings add nothing


def climb(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (all siblings from the leaf up), folded (the root that the started leaf gives); binary."""
    spark = manifest.leaves.sparkSession
    leaves, nodes = (f"merkle_{part}_{uuid.uuid4().hex}" for part in ("leaves", "nodes"))
    manifest.leaves.createOrReplaceTempView(leaves)
    manifest.nodes.createOrReplaceTempView(nodes)
    before = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        return settle(spark.sql(f"""
            WITH RECURSIVE climb(doc_id, leaf, node, folded, proof, subroot, root) AS (
                SELECT doc_id, leaf, node, folded, proof, CAST(NULL AS BINARY), CAST(NULL AS BINARY) FROM {leaves}
                UNION ALL
                SELECT c.doc_id, c.leaf, n.parent, unhex({FOLD.format(siblings='n.siblings', start='c.folded')}), concat(c.proof, n.proof),
                       coalesce(c.subroot, n.subroot), n.root
                FROM climb c JOIN {nodes} n ON c.node = n.node AND c.node <> '/')
            SELECT doc_id, leaf, subroot, root, unhex(sha2(lower(hex(proof)), 256)) AS proof_sha256, folded FROM climb WHERE node = '/'"""))
    finally:
        spark.conf.set(ROW_LIMIT, before)
        spark.catalog.dropTempView(leaves)
        spark.catalog.dropTempView(nodes)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (hexadecimal) and verified, one row per document."""
    done = climb(build(docs))
    text = lambda c: F.lower(F.hex(c))
    return done.select("doc_id", *[text(c).alias(c) for c in ("leaf", "subroot", "root", "proof_sha256")], text("folded").alias("folded_root"),
                       (F.col("folded") == F.col("root")).alias("verified"))
