"""Merkle manifest of a data set: one leaf a row, one tree a group, one root over the groups.

Leaf coordinates come from bitmaps, not from sorting leaves. Each group's ids are merged into a
compressed bitmap, of which only words of 64 ids that hold any are kept, with their popcount; a
directory holds the count of leaves before each word, on two levels (words, and runs of 1024 words).
The rank of a leaf is its word's directory entry and the popcount of the bits below its own.

The tree is then reduced by keyed slot arrays: nodes with the same index // 1024 meet as an array
of slots and are reduced ten levels in one step, so three steps do a billion leaves. Proofs go
the other way: each step hands a block's path to the root down once, not once a leaf.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, stage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = 10
#: Every seventh id, by this divisor of its CRC-32, is tampered with in an audit.
TAMPER = 7
_LEFT, _RIGHT, _LONE = b"l", b"r", b"-"


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(values: dict[str, Column]) -> Column:
    """The digest of a row's fields, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[_field(v) for v in values.values()]), 256))


def leaves(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", count_col: str = "n_chars", fields=FIELDS) -> DataFrame:
    """(doc_id, grp, leaf, forged): the leaf of each row, and for rows whose id an audit tampers
    with the leaf they would have with ``count_col`` one higher."""
    own = {c: F.col(c) for c in fields}
    # A decimal holds the successor of the largest long as well.
    forged = {**own, count_col: F.col(count_col).cast("decimal(20,0)") + 1}
    chosen = F.crc32(F.col(id_col).cast("string").cast("binary")) % TAMPER == 0
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(group_col).alias("grp"),
        leaf(own).alias("leaf"),
        F.when(chosen, leaf(forged)).alias("forged"),
    )


_WORD = "shiftright(doc_id, 6)"
_BIT = "cast(doc_id & 63 as int)"


def directory(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grp, word, bits, n, base) of each word of 64 ids that holds any, a null id's word being null
    and first, and (grp, size). ``base`` is the number of the group's leaves before the word."""
    words = rows.groupBy("grp", F.expr(_WORD).alias("word")).agg(
        F.expr(f"bit_or(shiftleft(1L, {_BIT}))").alias("bits"), F.count(F.lit(1)).alias("n")
    )
    words = stage(words.withColumn("run", F.expr("shiftright(word, 10)")), "words")
    runs = words.groupBy("grp", "run").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("grp").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    size = F.sum("n").over(Window.partitionBy("grp"))
    runs = stage(runs.select("grp", "run", F.coalesce(before, F.lit(0)).alias("run_base"), size.alias("size")), "runs")
    inside = F.sum("n").over(Window.partitionBy("grp", "run").orderBy("word").rowsBetween(Window.unboundedPreceding, -1))
    words = words.withColumn("inside", F.coalesce(inside, F.lit(0))).alias("w")
    met = words.join(runs.alias("r"), F.expr("w.grp <=> r.grp and w.run <=> r.run"))
    met = met.selectExpr("w.grp as grp", "word", "bits", "w.n as n", "run_base + inside as base", "size")
    return met, runs.select("grp", "size").distinct()


def _ranked_groups(sizes: DataFrame) -> DataFrame:
    """(grp, g, size, groups): groups numbered in bytewise order, null first. A directory over first
    characters, of which there are few, spares a sort of all groups in one task."""
    sizes = stage(sizes.withColumn("head", F.substring("grp", 1, 1)), "sizes")
    heads = sizes.groupBy("head").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("head")
    heads = heads.select(
        "head",
        F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("groups"),
    )
    met = sizes.alias("s").join(heads.alias("h"), F.expr("s.head <=> h.head"))
    place = F.row_number().over(Window.partitionBy("s.head").orderBy("grp")) - 1
    return stage(met.select("grp", (F.col("base") + place).alias("g"), "size", "groups"), "groups")


def coordinates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged (doc_id, leaf, forged, g, idx, size) for each row of ``leaves``, and the groups."""
    words, sizes = directory(rows)
    groups = _ranked_groups(sizes)
    words = words.alias("w").join(groups.alias("g"), F.expr("w.grp <=> g.grp"))
    words = stage(words.select("w.grp", "word", "bits", "n", "base", "g", "w.size"), "directory")
    met = rows.withColumn("key", F.expr(_WORD)).alias("x").join(words.alias("w"), F.expr("x.grp <=> w.grp and x.key <=> w.word"))
    met = met.select("doc_id", "leaf", "forged", "bits", "n", "base", "g", "size", "word")
    single = F.coalesce(F.bit_count("bits") == F.col("n"), F.lit(False))
    rank = F.expr(f"base + bit_count(bits & ~shiftleft(-1L, {_BIT}))")
    met = stage(met.withColumn("idx", F.when(single, rank)), "ranked")
    out = ["doc_id", "leaf", "forged", "g", "idx", "size"]
    # Ids that occur again: equal rows are counted, different ones ranked by their leaf, through a
    # directory over the leaf's first two bytes, so that no id's rows have to meet in one task.
    again = met.where("idx is null").groupBy("g", "word", "doc_id", "leaf", "forged", "base", "size").agg(F.count(F.lit(1)).alias("copies"))
    again = stage(again.withColumn("head", F.substring("leaf", 1, 2)), "again")
    heads = again.groupBy("g", "word", "doc_id", "head").agg(F.sum("copies").alias("n"))
    order = Window.partitionBy("g", "word").orderBy("doc_id", "head").rowsBetween(Window.unboundedPreceding, -1)
    heads = stage(heads.withColumn("skip", F.coalesce(F.sum("n").over(order), F.lit(0))), "heads")
    same = F.expr("a.g = h.g and a.word <=> h.word and a.doc_id <=> h.doc_id and a.head = h.head")
    met_heads = again.alias("a").join(heads.alias("h"), same).select("a.*", "skip")
    order = Window.partitionBy("g", "doc_id", "head").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("base") + F.col("skip") + F.coalesce(F.sum("copies").over(order), F.lit(0))
    spread = met_heads.withColumn("first", first).withColumn("idx", F.explode(F.expr("sequence(first, first + copies - 1)")))
    return stage(met.where("idx is not null").select(out).unionByName(spread.select(out)), "leaves"), groups


def _hex(*nodes: bytes) -> bytes:
    """The digest of digests, which are concatenated as hex text."""
    return sha256("".join(n.hex() for n in nodes).encode()).digest()


def _tree(nodes: list[bytes], size: int, most: int) -> list[list[bytes]]:
    """The levels above a block of neighbouring nodes, itself first; ``size`` nodes are on its whole
    level, and levels end where one node is left, or after ``most``."""
    levels = [nodes]
    for _ in range(most):
        if size == 1:
            break
        below = levels[-1]
        levels.append([_hex(*below[k : k + 2]) for k in range(0, len(below), 2)])
        size = -(-size // 2)
    return levels


def _local_path(levels: list[list[bytes]], k: int) -> list[bytes]:
    """A step for each level above node k: the side of its sibling and the sibling, or none."""
    path = []
    for level in levels[:-1]:
        other = k ^ 1
        path.append(_LONE if other >= len(level) else (_LEFT if k & 1 else _RIGHT) + level[other])
        k >>= 1
    return path


def _steps(path: bytes) -> list[bytes]:
    out, a = [], 0
    while a < len(path):
        b = a + (1 if path[a : a + 1] == _LONE else 33)
        out.append(path[a:b])
        a = b
    return out


def fold(node: bytes, steps: list[bytes]) -> bytes:
    """The root that a node and the steps of its path lead to."""
    for step in steps:
        side, other = step[:1], step[1:]
        node = _hex(node) if side == _LONE else _hex(other, node) if side == _LEFT else _hex(node, other)
    return node


def _blocks(nodes: DataFrame, most: int, *more: str) -> DataFrame:
    """(g, block, size, slots): nodes with the same index >> most as an array in order of index."""
    slot = F.struct(F.expr(f"cast(idx & {(1 << most) - 1} as int)").alias("slot"), F.col("node"), *more)
    block = F.expr(f"shiftright(idx, {most})").alias("block")
    return nodes.groupBy("g", block, "size").agg(F.sort_array(F.collect_list(slot)).alias("slots"))


def _reduced(nodes: DataFrame, most: int) -> DataFrame:
    """The nodes ``most`` levels up."""

    def run(batch):
        out = [_tree([s["node"] for s in slots], n, most)[-1][0] for slots, n in zip(batch["slots"].to_pylist(), batch["size"].to_pylist())]
        sizes = pa.array([-(-n >> most) for n in batch["size"].to_pylist()], pa.int64())
        return pa.record_batch([batch["g"], batch["block"], sizes, pa.array(out, pa.binary())], names=["g", "idx", "size", "node"])

    return map_batches(_blocks(nodes, most), run, "g long, idx long, size long, node binary")


def climb(nodes: DataFrame, most: int = LEVELS) -> list[DataFrame]:
    """Staged (g, idx, size, node) of every ``most`` levels, from ``nodes`` to one node a group."""
    out = [nodes]
    while out[-1].where("size > 1").limit(1).count():
        out.append(stage(_reduced(out[-1], most), "level"))
    return out


def _with_paths(nodes: DataFrame, above: DataFrame, most: int, *more: str) -> DataFrame:
    """Blocks of ``nodes`` with the path of the node above, which is the block's own index there."""
    up = above.select(F.col("g").alias("up_g"), F.col("idx").alias("up_idx"), F.col("path").alias("up"))
    blocks = _blocks(nodes, most, *more)
    return blocks.join(up, (blocks["g"] == up["up_g"]) & (blocks["block"] == up["up_idx"])).drop("up_g", "up_idx")


def _paths(nodes: DataFrame, above: DataFrame, most: int) -> DataFrame:
    """(g, idx, node, path) for the nodes of a level, from the paths of the level ``most`` above."""

    def run(batch):
        g, idx, own, paths = [], [], [], []
        for row in batch.to_pylist():
            levels = _tree([s["node"] for s in row["slots"]], row["size"], most)
            for k, s in enumerate(row["slots"]):
                g.append(row["g"])
                idx.append((row["block"] << most) + k)
                own.append(s["node"])
                paths.append(b"".join(_local_path(levels, k)) + row["up"])
        return pa.record_batch(
            [pa.array(g, pa.int64()), pa.array(idx, pa.int64()), pa.array(own, pa.binary()), pa.array(paths, pa.binary())],
            names=["g", "idx", "node", "path"],
        )

    return map_batches(_with_paths(nodes, above, most), run, "g long, idx long, node binary, path binary")


def _descend(levels: list[DataFrame], top: DataFrame, most: int) -> DataFrame:
    """The paths of the level above the lowest; ``top`` has those of the highest."""
    paths = top
    for nodes in levels[-2:0:-1]:
        paths = stage(_paths(nodes, paths, most), "paths")
    return paths


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", count_col: str = "n_chars", fields=FIELDS, most: int = LEVELS) -> DataFrame:
    """One row per input row: doc_id, g (number of its group), idx (place of its leaf there), leaf,
    subroot, root, siblings (those of its proof, from leaf to root, concatenated), folded_root (from
    the audited leaf, which is tampered with where ``TAMPER`` divides the id's CRC-32) and verified.
    Digests are binary.

    In a group leaves ascend by id, null first; leaves of one id ascend by digest, and equal rows are
    leaves of their own. Groups ascend bytewise, null first, and may hold any number of rows; their
    number may grow too. Null fields enter a leaf as such, so null and empty texts differ; a null
    count stays null when tampered with, and a null id is not tampered with. Texts of any length are
    hashed where they lie. Other columns are ignored; an empty table gives an empty result."""
    rows = stage(leaves(docs, id_col, group_col, count_col, fields), "hashed")
    own, groups = coordinates(rows)
    levels = climb(own.select("g", "idx", "size", F.col("leaf").alias("node")), most)
    subroots = levels[-1].where("idx = 0").select(F.lit(0).cast("long").alias("g"), F.col("g").alias("idx"), "node")
    subroots = subroots.withColumn("size", F.lit(groups.count()).cast("long"))
    upper = climb(stage(subroots.select("g", "idx", "size", "node"), "subroots"), most)
    root = upper[-1].select("g", "idx", F.col("node"), F.lit(b"").alias("path"))
    # Each subroot's path, keyed by its group; a lone group's subroot is the root.
    tops = _descend([None, *upper], root, most)
    tops = tops.select(F.col("idx").alias("g"), F.lit(0).cast("long").alias("idx"), "path", F.col("node").alias("subroot"))
    tops = stage(tops, "tops")
    blocks = _with_paths(own.withColumnRenamed("leaf", "node"), _descend(levels, tops.drop("subroot"), most), most, "doc_id", "forged")
    whole = (root.first() or {"node": None})["node"]
    roots = tops.select("g", "subroot", F.lit(whole).cast("binary").alias("root"))
    schema = "doc_id long, g long, idx long, leaf binary, subroot binary, root binary, siblings binary, folded_root binary, verified boolean"
    return map_batches(blocks.join(roots, "g"), _audit(most), schema)


def _audit(most: int):
    kinds = {"doc_id": pa.int64(), "g": pa.int64(), "idx": pa.int64(), "verified": pa.bool_()}
    names = ("doc_id", "g", "idx", "leaf", "subroot", "root", "siblings", "folded_root", "verified")

    def run(batch):
        columns = {n: [] for n in names}
        for row in batch.to_pylist():
            levels, up = _tree([s["node"] for s in row["slots"]], row["size"], most), _steps(row["up"])
            for k, s in enumerate(row["slots"]):
                steps = _local_path(levels, k) + up
                folded = fold(s["forged"] or s["node"], steps)
                siblings = b"".join(x[1:] for x in steps)
                idx = (row["block"] << most) + k
                values = (s["doc_id"], row["g"], idx, s["node"], row["subroot"], row["root"], siblings, folded, folded == row["root"])
                for out, v in zip(columns.values(), values):
                    out.append(v)
        return pa.record_batch([pa.array(v, kinds.get(n, pa.binary())) for n, v in columns.items()], names=list(names))

    return run


def report(docs: DataFrame, **options) -> DataFrame:
    """The manifest with digests as hex text, and of each proof a digest."""
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return manifest(docs, **options).select(
        "doc_id",
        text("leaf"),
        text("subroot"),
        text("root"),
        F.sha2(F.lower(F.hex("siblings")).cast("binary"), 256).alias("proof_sha256"),
        text("folded_root"),
        "verified",
    )
