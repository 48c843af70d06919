"""Merkle dataset manifest by slot pivots (operator 11), DataFrame functions only.

A leaf is the hash of a document's fields. Per group (language), leaves in order of
their id form a tree: every ``fanout`` consecutive nodes hash into one, until one is
left; the groups' roots, in order of their names, form a tree in the same way.

One level is a slot pivot: nodes are grouped by their parent's number, a conditional
aggregate per slot spreads the children into ``fanout`` columns, concatenating the
columns and hashing gives the parent, and leaving out a child's own column gives its
siblings, those left of it and those right of it.

Plan:

1. One projection over the scan hashes the texts; nothing else reads them. The table
   written has a few hundred bytes a row.
2. Places: rows are range-partitioned by (group, id, leaf, row) and sorted where they
   are; a row's place is its number in its task plus the group's rows of earlier
   tasks, of which there is one row a task and group. No task holds a whole group.
3. Nodes are dealt out once by blocks of ``fanout ** levels`` consecutive ones; all
   pivots of a block then happen without another exchange, and carry the proofs of
   the block's nodes along. Blocks become the nodes of the next round, so 64 documents
   a block give log64(n) rounds; each block's proof is joined back once per block.

Defined cases: null fields hash as ``-``; a null id comes first in its group and is
never tampered with; rows of one id are ordered by their leaf, equal rows are
interchangeable; a null group is a group, ordered first; other columns are not read;
an empty table gives no rows; texts of any length are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import narrow
from corpusflow.session import materialize

FANOUT, LEVELS = 2, 6
#: Bits of ``monotonically_increasing_id`` that number the rows of a task.
TASK_BITS = 33


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame, group_col: str = "lang") -> DataFrame:
    """``doc_id, lang, leaf, fold``: ``fold`` is the leaf after tampering with every
    document of whose id's crc32 seven is a divisor (``n_chars`` grows by 1)."""
    doc_id, n_chars = F.col("doc_id").cast("long"), F.col("n_chars").cast("decimal(20,0)")
    hashed = lambda n: digest(field(doc_id), field(F.col("source")), field(F.col("lang")), field(n), field(F.col("text")))
    hit = (F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0) & n_chars.isNotNull()
    leaf = docs.select(doc_id.alias("doc_id"), F.col(group_col).cast("string").alias("lang"), hashed(n_chars).alias("leaf"),
                       F.when(hit, hashed(n_chars + 1)).alias("changed"))
    return leaf.select("doc_id", "lang", "leaf", F.coalesce("changed", "leaf").alias("fold"))


def placed(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``at``, the place in its group by ``order``, and ``nodes``, the
    group's rows."""
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    keys = [group, *order, "_row"]  # the last one deals out equal rows
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row")
    rows = materialize(rows.withColumn("_m", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("_task", F.shiftright("_m", TASK_BITS))
    runs = rows.groupBy(group, "_task").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # a window row per task and group, not per document
    before = Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    runs = materialize(runs.select(group, "_task", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
                                   F.sum("_n").over(Window.partitionBy(group)).alias("nodes")), f"{name}-runs")
    return rows.join(narrow(runs, 96), [group, "_task"]).withColumn("at", F.col("_m") + F.col("_shift")).drop("_m", "_task", "_shift")


def _pivot(rows: DataFrame, fanout: int) -> DataFrame:
    """One level up, for ``g, block, at, nodes, digest, kids``."""
    slot = F.pmod("at", F.lit(fanout))
    child = F.struct("digest", "kids")
    up = rows.groupBy("g", "block", "nodes", F.floor(F.col("at") / fanout).alias("at")).agg(
        *[F.first(F.when(slot == s, child), ignorenulls=True).alias(f"c{s}") for s in range(fanout)])
    one = [F.coalesce(F.col(f"c{s}.digest"), F.lit("")) for s in range(fanout)]
    many = F.col("nodes") > 1  # a single node is the root of its group

    def proven(s: int) -> Column:
        step = F.array(F.struct(F.concat(F.lit(""), *one[:s]).alias("left"), F.concat(F.lit(""), *one[s + 1:]).alias("right")))
        return F.transform(f"c{s}.kids", lambda k: F.struct(k["payload"].alias("payload"), F.concat(k["path"], step).alias("path")))

    kids = F.concat(*[F.coalesce(proven(s), F.slice("c0.kids", 1, 0)) for s in range(fanout)])
    return up.select("g", "block", "at", F.ceil(F.col("nodes") / fanout).alias("nodes"),
                     F.when(many, digest(*one)).otherwise(F.col("c0.digest")).alias("digest"),
                     F.when(many, kids).otherwise(F.col("c0.kids")).alias("kids"))


def prove(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """``g, payload, path, root`` of ``g, at, nodes, digest, payload``: the path has the
    siblings of every level, from the leaf's on, as ``left`` and ``right``."""
    path = F.array().cast("array<struct<left:string,right:string>>")
    size = fanout ** levels
    rows = nodes.select("g", F.floor(F.col("at") / size).alias("block"), "at", "nodes", "digest",
                        F.array(F.struct("payload", path.alias("path"))).alias("kids")).repartition("g", "block")
    for _ in range(levels):
        rows = _pivot(rows, fanout)
    blocks = materialize(rows.drop("block"), "merkle-blocks")
    if blocks.where("nodes > 1").isEmpty():
        done = blocks.select("kids", "g", path.alias("up"), F.col("digest").alias("root"))
    else:
        above = prove(blocks.select("g", "at", "nodes", "digest", F.col("at").alias("payload")), fanout, levels)
        above = above.select("g", F.col("payload").alias("at"), F.col("path").alias("up"), "root")
        done = blocks.join(above, ["g", "at"]).select("kids", "g", "up", "root")
    return done.select("g", "up", "root", F.explode("kids").alias("k")).select(
        "g", "k.payload", F.concat("k.path", "up").alias("path"), "root")


def manifest(docs: DataFrame, group_col: str = "lang", fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """``doc_id, lang, leaf, subroot, root, path, fold`` of every document."""
    made = leaves(docs, group_col)
    # groups go by a hash of fixed width; their names are needed for their order only
    made = materialize(made.withColumn("g", F.sha2(field(F.col("lang")), 256)), "merkle-leaves")
    nodes = placed(made, "g", ["doc_id", "leaf"], "merkle-placed")
    proven = prove(nodes.select("g", "at", "nodes", F.col("leaf").alias("digest"),
                                F.struct("doc_id", "lang", "leaf", "fold").alias("payload")), fanout, levels)
    proven = materialize(proven, "merkle-proofs")
    groups = proven.select("g", F.col("payload.lang").alias("lang"), "root").groupBy("g").agg(
        F.first("lang").alias("lang"), F.first("root").alias("digest")).withColumn("all", F.lit(0))
    groups = placed(groups, "all", ["lang"], "merkle-groups")
    top = prove(groups.select(F.col("all").alias("g"), "at", "nodes", "digest", F.col("g").alias("payload")), fanout, levels)
    top = materialize(top.select(F.col("payload").alias("g"), F.col("path").alias("up"), F.col("root").alias("whole")), "merkle-top")
    return proven.join(narrow(top, 4096), "g").select(
        "payload.doc_id", "payload.lang", "payload.leaf", F.col("root").alias("subroot"), F.col("whole").alias("root"),
        F.concat("path", "up").alias("path"), "payload.fold")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of its path."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def audit(manifest: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``."""
    siblings = F.concat_ws("", F.transform("path", lambda s: F.concat(s["left"], s["right"])))
    out = manifest.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
                          folded(F.col("fold"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
