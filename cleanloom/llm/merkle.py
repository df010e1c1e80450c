"""Merkle manifest of a table: nodes labelled by the leaf ranks they cover, proofs by containment of these intervals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cleanloom.llm.common import kind, ref
from cleanloom.plans.lookup import attach
from cleanloom.session import stored

# Levels that one bucket of the tree spans: a bucket covers 2 ** BAND neighbouring nodes and is one row.
BAND = 6
INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def encoded(value: Column) -> Column:
    """``-`` for null, else the byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts put together; digests go in as hex text."""
    return F.sha2(F.concat(*parts) if len(parts) > 1 else parts[0], 256)


def fold(start: Column, steps: Column) -> Column:
    """Digest of the root that a node with digest ``start`` and these steps to the root leads to."""
    return F.aggregate(steps, start, lambda acc, s: digest(
        F.when(s["digest"].isNull(), acc).when(s["before"], F.concat(s["digest"], acc)).otherwise(F.concat(acc, s["digest"]))))


def proof(steps: Column) -> Column:
    """Digest of all siblings on the way to the root, left to right, one level after another."""
    return digest(F.array_join(F.transform(steps, lambda s: s["digest"]), ""))


def ranked(leaves: DataFrame, order: list[str], tree: str = "tree") -> DataFrame:
    """The leaves with their rank ``lo`` in their tree and the tree's leaf ``count`` and ``height``.

    Leaves are range-partitioned by tree and order, so a tree of any size spreads over many tasks; ties that the order
    leaves are broken by the whole row. Only counts per tree and range are gathered. Nulls of the order come first.
    """
    rows = stored(leaves.withColumn("seq", F.monotonically_increasing_id()), "merkle-leaves")
    keys = [ref(tree), *map(ref, order), F.col("seq")]
    # The upper bits of the number are the range's, so it grows along the order.
    sorted_rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    placed = stored(sorted_rows.withColumn("part", F.shiftright("at", 33)).drop("seq"), "merkle-order")
    spans = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("tree", "part", "n", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
                         F.sum("n").over(Window.partitionBy("tree")).alias("count"))
    spans = stored(spans.withColumn("height", F.when(F.col("count") > 1, F.length(F.bin(F.col("count") - 1))).otherwise(0)), "merkle-spans")
    whole = attach(placed, spans, ["tree", "part"], "n", placed.count(), spans.count(), F.lit(True))
    return whole.withColumn("lo", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def buckets(entries: DataFrame, base: int, payload: list[str]) -> DataFrame:
    """One row per bucket of 2 ** BAND neighbouring nodes of level ``base``: its members and every node above them in it.

    ``levels[k]`` holds the nodes of level ``base + k`` as ``lo, hi, digest``: the leaf ranks lo to hi - 1 are covered. The
    last level is the bucket's top alone.
    """
    out = entries.groupBy("tree", F.shiftright("lo", base + BAND).alias("bucket")).agg(
        F.max("height").alias("height"), F.max("count").alias("count"),
        F.sort_array(F.collect_list(F.struct("lo", "digest", *payload))).alias("members"))
    out = out.withColumn("level0", F.transform("members", lambda m: F.struct(
        m["lo"].alias("lo"), F.least(m["lo"] + F.lit(1 << base).cast("long"), F.col("count")).alias("hi"), m["digest"].alias("digest"))))
    for k in range(BAND):
        below = F.col(f"level{k}")

        def parent(i: Column) -> Column:
            left, right = F.get(below, i * 2), F.get(below, i * 2 + 1)
            return F.struct(left["lo"].alias("lo"), F.coalesce(right["hi"], left["hi"]).alias("hi"),
                            digest(left["digest"], F.coalesce(right["digest"], F.lit(""))).alias("digest"))

        pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size(below) - 1) / 2).cast("int")), parent)
        out = out.withColumn(f"level{k + 1}", F.when(F.col("height") > base + k, pairs).otherwise(below))
    levels = [F.col(f"level{k}") for k in range(BAND + 1)]
    return out.select("tree", "bucket", "height", "count", "members", F.array(*levels).alias("levels"), F.get(levels[-1], F.lit(0))["digest"].alias("top"))


def steps_inside(lo: Column, base: int) -> Column:
    """The siblings on the way from a member to its bucket's top, one step a level; a step without sibling has no digest.

    The parent is the node of the next level whose interval contains the member; what it covers besides the member's own
    node is the sibling.
    """
    def step(k: Column) -> Column:
        def beside(parent: Column) -> Column:
            others = F.filter(F.get("levels", k), lambda n: (n["lo"] >= parent["lo"]) & (n["hi"] <= parent["hi"]) & ~((n["lo"] <= lo) & (lo < n["hi"])))
            return F.get(F.transform(others, lambda n: F.struct(n["digest"].alias("digest"), (n["lo"] < lo).alias("before"))), F.lit(0))

        # One parent contains the member; as a lambda's argument it is found once.
        parents = F.filter(F.get("levels", k + 1), lambda p: (p["lo"] <= lo) & (lo < p["hi"]))
        alone = F.struct(F.lit(None).cast("string").alias("digest"), F.lit(False).alias("before"))
        return F.coalesce(F.get(F.transform(parents, beside), F.lit(0)), alone)

    return F.transform(F.slice(F.array(*map(F.lit, range(BAND))), F.lit(1), F.least(F.lit(BAND), F.col("height") - base)), step)


@dataclass
class Manifest:
    """``leaves``: tree, rank, digest, the payload and the steps to the tree's root. ``roots``: tree, root, n leaves. ``nodes``: tree, level, lo, hi, digest."""

    leaves: DataFrame
    roots: DataFrame
    nodes: DataFrame


def climb(entries: DataFrame, payload: list[str], highest: int, base: int = 0) -> Manifest:
    """Build all trees of ``entries`` (tree, lo, height, count, digest, payload) band by band, each 2 ** BAND times smaller.

    The ancestors above a bucket are attached to the bucket, by the bucket of the next band whose interval contains it; so
    a leaf meets its ancestors where it already is, and no row is copied once per level.
    """
    here = stored(buckets(entries, base, payload), "merkle-buckets")
    done = F.col("height") <= base + BAND
    roots = here.where(done).select("tree", F.col("top").alias("root"), F.col("count").alias("n"))
    level = here.select("tree", "height", F.posexplode("levels").alias("k", "nodes")).where(F.col("k") < F.when(done, F.col("height") - base + 1).otherwise(BAND))
    nodes = level.select("tree", (F.col("k") + base).alias("level"), F.inline("nodes"))
    above = F.array().cast("array<struct<digest:string,before:boolean>>")
    if highest > base + BAND:
        tops = here.where(~done).select("tree", "height", "count", F.shiftleft("bucket", base + BAND).alias("lo"), F.col("top").alias("digest"))
        upper = climb(tops, [], highest, base + BAND)
        lead = upper.leaves.select("tree", F.shiftright("rank", base + BAND).alias("bucket"), F.col("steps").alias("above"))
        here = here.join(lead, ["tree", "bucket"], "left")
        above = F.coalesce(F.col("above"), above)
        roots, nodes = roots.union(upper.roots), nodes.union(upper.nodes)
    found = here.select("tree", F.explode(F.transform("members", lambda m: F.struct(
        m["lo"].alias("rank"), m["digest"].alias("digest"), *[m[c].alias(c) for c in payload], F.concat(steps_inside(m["lo"], base), above).alias("steps")))).alias("m"))
    return Manifest(found.select("tree", "m.*"), roots, nodes)


def manifest(leaves: DataFrame, order: list[str], payload: list[str]) -> Manifest:
    """Trees over ``leaves`` (tree, digest, and columns to order by and to carry): every 2 consecutive nodes of a level make
    their parent, a last one alone makes its own, until one node remains."""
    entries = stored(ranked(leaves, order), "merkle-entries")
    highest = entries.agg(F.max("height")).first()[0]
    return climb(entries, payload, highest or 0)


def dataset_manifest(df: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
                     tamper_col: str = "n_chars", tamper_every: int = 7) -> DataFrame:
    """``id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    A row's digest covers ``fields``, each as text with its length and ``-`` if null. The rows of a group, by ascending id,
    are the leaves of its tree; the groups' roots, by group (null first, then bytewise), those of the last tree. Proofs are
    the siblings on both ways up. Rows whose id's crc32 ``tamper_every`` divides are folded anew with ``tamper_col``
    raised by one, all others with their own digest; ``verified`` tells whether that gives the root.

    A null id comes first in its group and is never tampered with; rows of one id are ordered by their digest, so equal
    rows may swap places, which changes nothing. A null group is a group of its own; an empty text is not null. An empty
    table gives no rows. Columns outside ``fields`` are ignored; one of a number's type must be ``tamper_col``. Texts are hashed
    where they are read and move nowhere.
    """
    if kind(df, tamper_col) not in INTEGRAL:
        raise ValueError(f"{tamper_col} is no integer column: one cannot be added.")
    values = {c: encoded(ref(c)) for c in fields}
    # One beyond the largest long is a number, too.
    raised = {**values, tamper_col: encoded((ref(tamper_col).cast("decimal(20,0)") + F.lit(1)).cast("decimal(21,0)"))}
    hit = F.crc32(ref(id_col).cast("string")) % tamper_every == 0
    leaves = df.select(encoded(ref(group_col)).alias("tree"), ref(id_col).alias("id"), digest(*values.values()).alias("digest"),
                       F.when(hit, digest(*raised.values())).alias("tampered"))
    low = manifest(leaves, ["id", "digest"], ["id", "tampered"])
    # A group's name is what its encoded form holds behind the colon.
    name = F.when(F.col("tree") != "-", F.expr("substring(tree, instr(tree, ':') + 1)"))
    roots = stored(low.roots.withColumn("name", name), "merkle-roots")
    high = manifest(roots.select(F.lit("").alias("tree"), F.col("tree").alias("member"), "name", F.col("root").alias("digest"), "n"), ["name"], ["member", "n"])
    # The last tree is one tree: its root is one row.
    tops = high.leaves.join(high.roots.select("tree", "root"), "tree")
    tops = stored(tops.select(F.col("member").alias("tree"), "n", F.col("digest").alias("subroot"), "root", F.col("steps").alias("last")), "merkle-tops")
    whole = attach(low.leaves, tops, ["tree"], "n", df.count(), tops.count(), F.lit(True)).withColumn("way", F.concat("steps", "last"))
    folded = whole.withColumn("folded_root", fold(F.coalesce("tampered", "digest"), F.col("way")))
    return folded.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", proof(F.col("way")).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
