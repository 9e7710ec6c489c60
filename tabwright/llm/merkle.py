"""Merkle manifest of a table: levels stored as parent-linked node rows, proofs climbed by a recursive query.

Every row is a leaf. The leaves of a group, in id order, form a tree of fan-out
``FAN``; the groups' tops, in group order, form the tree above. A node row knows
its parent, the digests to its left and right in its run, and its parent's
digest. A recursive query starts at the leaves and ascends by the parent links,
appending siblings and folding the leaf found now. The leaves of one run have
the same way up, so they ride in one row and each folds its own digest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwright.functions.exprs import c
from tabwright.functions.ordering import join_keys
from tabwright.session import write_through

FAN = 8
#: number of the tree over the groups' tops; the groups' trees count from 1
TOP = 0
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def sized(value: Column) -> Column:
    """``-`` for null, else byte count, colon and value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def hex_text(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def joined(digests: Column) -> Column:
    """The digests of an array end to end."""
    return F.aggregate(digests, F.lit(b""), lambda a, x: F.concat(a, x))


def leaf_rows(docs: DataFrame, fields: list[str], group_col: str, id_col: str, found: dict[str, Column] | None = None) -> DataFrame:
    """(id, grp, leaf, now): the digest of the fields of each row, and of the row with ``found`` columns in their place."""
    found = found or {}
    was = digest(F.concat(*[sized(c(f)) for f in fields]))
    now = digest(F.concat(*[sized(found.get(f, c(f))) for f in fields])) if found else was
    return docs.select(c(id_col).alias("id"), c(group_col).cast("string").alias("grp"), was.alias("leaf"), now.alias("now"))


def numbered(d: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``d`` with ``idx``, the place from 0 of each row within its ``by`` group in ``order``, nulls first.

    The rows are range partitioned and written, so a partition's number and a
    row's place in its file are fixed; only a (group, partition) table of counts
    is summed up. Rows that are equal throughout are dealt apart by their place
    in the source, so they fill no partition of their own.
    """
    keys = [*[c(x) for x in by], *[c(x) for x in order]]
    spread = d.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(*keys, F.col("spread"))
    place = F.monotonically_increasing_id()
    laid = spread.sortWithinPartitions(*keys, "spread").drop("spread").withColumn("part", F.shiftright(place, 33)).withColumn("at", place.bitwiseAND(F.lit((1 << 33) - 1)))
    laid = write_through(laid, name)
    counts = laid.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select(*by, "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return join_keys(laid, start, [*by, "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def node_name(tree: Column, level: int, idx: Column) -> Column:
    return F.concat_ws("/", tree.cast("string"), F.lit(str(level)), idx.cast("string"))


def risen(level: DataFrame, height: int, name: str, fan: int) -> tuple[DataFrame, DataFrame]:
    """(node rows of a level, the level above) from (tree, idx, size, hash, node, last) rows of trees with more than one node."""
    run = F.floor(F.col("idx") / fan).alias("run")
    member = F.struct("idx", "hash", "node", "last")
    runs = level.groupBy("tree", run, "size").agg(F.array_sort(F.collect_list(member)).alias("m"))
    runs = write_through(runs.withColumn("up", digest(hex_text(joined(F.col("m.hash"))))), name)
    parent = node_name(F.col("tree"), height + 1, F.col("run"))
    rows = runs.select(parent.alias("parent"), "up", F.col("m.hash").alias("hashes"), F.posexplode("m").alias("pos", "x"))
    nodes = rows.select(
        F.col("x.node").alias("node"), "parent", joined(F.expr("slice(hashes, 1, pos)")).alias("before"),
        joined(F.expr("slice(hashes, pos + 2, size(hashes))")).alias("after"), F.col("x.hash").alias("hash"), "up", F.col("x.last").alias("last"),
    )
    size = F.ceil(F.col("size") / fan)
    above = runs.select("tree", F.col("run").alias("idx"), size.alias("size"), F.col("up").alias("hash"), parent.alias("node"))
    return nodes, above.withColumn("last", (F.col("size") == 1) & (F.col("tree") != TOP))


@dataclass
class Manifest:
    """``runs``: (node, leaves of a run, hash of node); ``nodes``: parent-linked rows; ``root``: name of the root's row, none for an empty table."""

    runs: DataFrame
    nodes: DataFrame
    root: str | None


def build(leaves: DataFrame, fan: int = FAN) -> Manifest:
    """Trees over (id, grp, leaf, now) rows, level by level; each level is written and is an eighth of the one below.

    Leaves of a group ascend by id (null first), equal ids by their digests, so
    repeated rows may stand in either order. Groups ascend bytewise, null first.
    """
    leaves = write_through(leaves, "merkle-leaves")
    if leaves.isEmpty():
        return Manifest(leaves, leaves, None)
    groups = numbered(leaves.groupBy("grp").agg(F.count(F.lit(1)).alias("size")), [], ["grp"], "merkle-groups")
    groups = write_through(groups.select("grp", "size", (F.col("idx") + 1).alias("tree")), "merkle-trees")
    placed = numbered(join_keys(leaves, groups, ["grp"]).drop("grp"), ["tree"], ["id", "leaf", "now"], "merkle-placed")
    run = F.floor(F.col("idx") / fan).alias("run")
    runs = placed.groupBy("tree", "size", run).agg(F.array_sort(F.collect_list(F.struct("idx", "id", "leaf", "now"))).alias("m"))
    alone = F.col("size") == 1
    whole = F.when(alone, F.col("m")[0]["leaf"]).otherwise(digest(hex_text(joined(F.col("m.leaf")))))
    name = F.when(alone, node_name(F.col("tree"), 0, F.col("run"))).otherwise(node_name(F.col("tree"), 1, F.col("run")))
    runs = write_through(runs.select("tree", "size", F.col("run").alias("idx"), "m", whole.alias("hash"), name.alias("node")), "merkle-runs")
    level = runs.select("tree", "idx", F.ceil(F.col("size") / fan).alias("size"), "hash", "node").withColumn("last", F.col("size") == 1)

    made: list[DataFrame] = []
    tops: list[DataFrame] = []
    most, trees = groups.agg(F.max("size"), F.count(F.lit(1))).first()
    height, most = 1, -(-most // fan)
    while True:
        tops.append(level.where("last"))
        if most == 1:
            break
        nodes, level = risen(level.where("not last"), height, "merkle-level", fan)
        made.append(nodes)
        height, most = height + 1, -(-most // fan)
    tops_of = tops[0]
    for t in tops[1:]:
        tops_of = tops_of.unionByName(t)
    level = tops_of.select(F.lit(TOP).cast("long").alias("tree"), (F.col("tree") - 1).alias("idx"), F.lit(trees).cast("long").alias("size"), "hash", "node", F.lit(True).alias("last"))
    height, left = 0, trees
    while left > 1:
        nodes, level = risen(level, height, "merkle-top", fan)
        made.append(nodes)
        height, left = height + 1, -(-left // fan)
    end = level.select("node", F.lit(None).cast("string").alias("parent"), F.lit(b"").alias("before"), F.lit(b"").alias("after"), "hash", F.lit(None).cast("binary").alias("up"), "last")
    all_nodes = end
    for nodes in made:
        all_nodes = all_nodes.unionByName(nodes)
    all_nodes = write_through(all_nodes, "merkle-nodes")
    return Manifest(runs, all_nodes, all_nodes.where("parent is null").first()["node"])


FOLD = "unhex(sha2(lower(hex(concat({}))), 256))"
CLIMB = f"""
    WITH RECURSIVE climb AS (
        SELECT node, leaves, cast('' AS binary) AS path, hash, cast(NULL AS binary) AS subroot FROM {{starts}}
        UNION ALL
        SELECT n.parent, transform(k.leaves, x -> named_struct('id', x.id, 'leaf', x.leaf, 'folded', {FOLD.format('n.before, x.folded, n.after')})),
            concat(k.path, n.before, n.after), n.up, coalesce(k.subroot, CASE WHEN n.last THEN n.hash END)
        FROM climb k JOIN {{nodes}} n ON n.node = k.node
        WHERE n.parent IS NOT NULL
    )
    SELECT leaves, path, hash AS root, coalesce(subroot, hash) AS subroot FROM climb WHERE node = {{root}}
"""


def climb(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """(id, leaf, subroot, root, proof, folded) of every leaf, all binary; ``proof`` has the siblings end to end from the leaf's run up to the root.

    The recursion's limit on rows, meant against endless queries, is lifted while
    it runs: this one ends at the root.
    """
    before = "aggregate(slice(m.leaf, 1, i), cast('' AS binary), (a, b) -> concat(a, b))"
    after = "aggregate(slice(m.leaf, i + 2, size(m)), cast('' AS binary), (a, b) -> concat(a, b))"
    first = FOLD.format(f"{before}, x.now, {after}")
    starts = manifest.runs.select(
        "node",
        "hash",
        F.expr(f"transform(m, (x, i) -> named_struct('id', x.id, 'leaf', x.leaf, 'folded', CASE WHEN size = 1 THEN x.now ELSE {first} END))").alias("leaves"),
    )
    old = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        done = write_through(spark.sql(CLIMB, starts=starts, nodes=manifest.nodes, root=manifest.root), "merkle-climb")
    finally:
        spark.conf.set(ROW_LIMIT, old)
    each = done.select(F.col("leaves.leaf").alias("run"), "path", "root", "subroot", F.posexplode("leaves").alias("i", "x"))
    own = F.concat(joined(F.expr("slice(run, 1, i)")), joined(F.expr("slice(run, i + 2, size(run))")), F.col("path"))
    return each.select(F.col("x.id").alias("id"), F.col("x.leaf").alias("leaf"), "subroot", "root", own.alias("proof"), F.col("x.folded").alias("folded"))


#: Fixed value: the fields of a leaf, in order
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def manifest_report(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every document, in lowercase hex.

    Rows whose id's crc32 is divisible by three are read with their text
    lower-cased (A-Z); a null id counts as empty text there. Null fields are
    ``-``, texts of any length are hashed whole. Repeated rows are leaves each.
    An empty table has no leaves and no rows. Other columns stay behind.
    """
    altered = F.crc32(F.coalesce(c("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 0
    text = c("text").cast("string")
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaves = leaf_rows(docs, FIELDS, "lang", "doc_id", {"text": F.when(altered, lower).otherwise(text)})
    manifest = build(leaves)
    if manifest.root is None:
        none = docs.select("doc_id").limit(0)
        hexes = [F.lit("").alias(x) for x in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
        return none.select("doc_id", *hexes, F.lit(True).alias("verified"))
    found = climb(docs.sparkSession, manifest)
    return found.select(
        F.col("id").alias("doc_id"), *[hex_text(F.col(x)).alias(x) for x in ("leaf", "subroot", "root")],
        F.sha2(hex_text(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), hex_text(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )
