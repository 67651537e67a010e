"""Merkle manifest of a dataset, by sibling-shift self-joins.

Every row is a leaf; the leaves of a group ascend by an order column and form a tree of ``fanout``, the
subroots of all groups, ordered by group, form one more tree over them.  A level is one table of
(grp, idx, n, digest), n the nodes its group has there.  It equijoins itself once per sibling on the computed
sibling index (idx XOR 1 for a binary tree, otherwise the other slots of the run of ``fanout``), so each node
gets the digests left and right of it; the rows of slot zero emit the parents, which are the next level.
Paths then come down: a node's path is its own siblings and its parent's path, so a parent's path is moved
once for all its children's runs and no group is ever gathered in one task.

Indices come from sampled ranges of (group, order, digest): a row number inside the range plus the rows its
group has in earlier ranges, so a group of any size is spread.  Each level is written to the shared folder.

Defined cases: a field that is NULL enters as ``-``; a NULL order value comes first, a NULL group before all
groups; rows tied in the order are told apart by digest, and equal rows hold neighbouring places, each with
the proof of its own place; empty and very long texts are ordinary fields; an empty table has the root None and
no rows; columns that are not fields are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrubspark.llm.common import quoted, stored
from scrubspark.operators.fill import order_ranges

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Place in a group above its tree: the group's own leaf in the tree of groups.
ABOVE = -1
NO_PATH = "cast(array() as array<struct<before: string, after: string>>)"


def framed(value: Column) -> Column:
    """``-`` for NULL, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts put together."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(values: list[Column]) -> Column:
    return digest(*[framed(v) for v in values])


def indexed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with ``grp``) and their place ``idx`` from 0 in the group by ``order``, and its size ``n``."""
    t = order_ranges(rows, [F.col("grp"), *[F.col(c) for c in order]])
    parts = t.groupBy("__b", "grp").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("grp")
    earlier = whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__b", "grp", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"),
                         F.sum("n").over(whole).alias("n"))
    place = F.row_number().over(Window.partitionBy("__b", "grp").orderBy(*order))
    t = t.withColumn("place", place).join(parts, ["__b", "grp"])
    return t.select(*rows.columns, (F.col("first") + F.col("place") - 1).alias("idx"), "n")


def sibling_index(idx: Column, fanout: int, shift: int) -> Column:
    """The index ``shift`` slots on from ``idx``, round the run of ``fanout`` that holds it."""
    if fanout == 2:
        return idx.bitwiseXOR(F.lit(1))
    slot = F.pmod(idx, F.lit(fanout))
    return idx - slot + F.pmod(slot + shift, F.lit(fanout))


def with_siblings(level: DataFrame, fanout: int) -> DataFrame:
    """``level`` and, for each node, the digests ``before`` and ``after`` it in its run (the last may be short)."""
    out = level
    places = []
    for shift in range(1, fanout):
        other = level.where("n > 1").select("grp", F.col("idx").alias(f"at{shift}"), F.col("digest").alias(f"d{shift}"))
        out = out.withColumn(f"at{shift}", sibling_index(F.col("idx"), fanout, shift)).join(
            other, ["grp", f"at{shift}"], "left")
        places.append(F.struct(F.col(f"at{shift}").alias("at"), F.col(f"d{shift}").alias("d")))
    others = F.sort_array(F.array(*places))

    def side(keep):
        return F.array_join(F.transform(F.filter(others, lambda s: s["d"].isNotNull() & keep(s["at"])), lambda s: s["d"]), "")

    return out.select(*level.columns, side(lambda at: at < F.col("idx")).alias("before"),
                      side(lambda at: at > F.col("idx")).alias("after"))


def parents(level: DataFrame, fanout: int) -> DataFrame:
    """The next level: the slot-zero rows of every group that has more than one node."""
    return level.where((F.col("n") > 1) & (F.pmod("idx", F.lit(fanout)) == 0)).select(
        "grp", F.floor(F.col("idx") / fanout).alias("idx"), F.ceil(F.col("n") / fanout).alias("n"),
        digest(F.col("digest"), F.col("after")).alias("digest"))


def tree(nodes: DataFrame, fanout: int, most: int) -> list[DataFrame]:
    """All levels of the trees over ``nodes`` (grp, idx, n, digest), written; ``most`` is the largest n."""
    levels = [stored(with_siblings(nodes, fanout), "merkle-level")]
    while most > 1:
        levels.append(stored(with_siblings(parents(levels[-1], fanout), fanout), "merkle-level"))
        most = -(-most // fanout)
    return levels


def paths(levels: list[DataFrame], above: DataFrame, fanout: int) -> DataFrame:
    """The lowest level with ``path``: (before, after) of every step up, then the group's path of ``above``."""
    down = None
    for level in reversed(levels):
        tops = above.select("grp", F.lit(ABOVE).cast("long").alias("up"), F.col("path").alias("rest"))
        if down is not None:
            tops = tops.unionAll(down.select("grp", F.col("idx").alias("up"), F.col("path").alias("rest")))
        up = F.when(F.col("n") == 1, F.lit(ABOVE)).otherwise(F.floor(F.col("idx") / fanout)).cast("long")
        step = F.array(F.struct("before", "after"))
        down = level.withColumn("up", up).join(tops, ["grp", "up"]).select(
            *[c for c in level.columns if c not in ("before", "after")],
            F.when(F.col("n") == 1, F.col("rest")).otherwise(F.concat(step, "rest")).alias("path"))
    return down


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda at, s: digest(s["before"], at, s["after"]))


def proof_text(path: Column) -> Column:
    """The sibling digests of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


@dataclass
class Manifest:
    """``root`` of the dataset (None for no rows); ``groups``: (grp, digest, path), the subroots and their
    paths; ``rows``: one row per leaf with the carried columns, grp, idx, n, digest, path."""

    root: str | None
    groups: DataFrame
    rows: DataFrame


def subtrees(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """(levels, roots): the trees over ``nodes`` and one row (grp, digest) for each."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels = tree(nodes, fanout, most)
    tops = [lv.where("n = 1").select("grp", "digest") for lv in levels]
    roots = tops[0]
    for t in tops[1:]:
        roots = roots.unionAll(t)
    return levels, roots


def manifest(docs: DataFrame, fields=FIELDS, group: str = "source", order: str = "doc_id", fanout: int = 3,
             carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs``; ``carry`` names further columns, computed in the one scan, that rows keep."""
    carry = carry or {}
    key = F.when(quoted(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), quoted(group).cast("string")))
    leaves = stored(docs.select(key.alias("grp"), quoted(order).alias("ord"),
                                leaf_digest([quoted(c) for c in fields]).alias("digest"),
                                *[c.alias(f"c_{name}") for name, c in carry.items()]), "merkle-leaves")
    kept = [f"c_{name}" for name in carry]
    levels, roots = subtrees(stored(indexed(leaves, ["ord", "digest", *kept]), "merkle-index"), fanout)
    # The group's name is both its order and, in the tree of groups, carried along as the leaf's name.
    named = stored(indexed(roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), ["name"]),
                   "merkle-groups")
    top_levels, top = subtrees(named, fanout)
    root = top.first()
    start = named.sparkSession.range(1).select(F.lit("").alias("grp"), F.expr(NO_PATH).alias("path"))
    above = stored(paths(top_levels, start, fanout).select(F.col("name").alias("grp"), "digest", "path"), "merkle-above")
    rows = paths(levels, above.select("grp", F.expr("path || array(named_struct('before', '=', 'after', digest))").alias(
        "path")), fanout)
    # The last entry of a path is the mark that brought the subroot down with it.
    mark = F.element_at("path", -1)
    rows = rows.select(F.col("ord").alias(order), *[F.col(f"c_{name}").alias(name) for name in carry], "grp", "idx", "n",
                       F.col("digest").alias("leaf"), mark["after"].alias("subroot"),
                       F.slice("path", 1, F.size("path") - 1).alias("path"))
    return Manifest(root["digest"] if root else None, above, rows)


def verified(m: Manifest, claimed: str, order: str = "doc_id") -> DataFrame:
    """Each row's proof, and the root that its carried ``claimed`` leaf folds to with the original siblings."""
    root = F.lit(m.root).cast("string")
    out = m.rows.select(order, "leaf", "subroot", root.alias("root"), F.sha2(proof_text(F.col("path")), 256).alias(
        "proof_sha256"), fold(F.col(claimed), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def without_newlines(docs: DataFrame, fields=FIELDS, order: str = "doc_id") -> Column:
    """The leaf of a row after tampering: every second row, by the CRC32 of its id, loses the text's newlines."""
    hit = F.crc32(quoted(order).cast("string").cast("binary")) % 2 == 0
    text = F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return leaf_digest([text if c == "text" else quoted(c) for c in fields])
