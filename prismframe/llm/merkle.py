"""Merkle manifest of a dataset: a digest of every row, of every group and of all, with the siblings that prove each row.

Leaves are numbered within their group in order, over all tasks: a sort by ranges, the rows of each group in each range, and a
running sum of these. Levels are windows over group and parent: the ordered list of a full frame is the preimage of the
parent and holds the siblings, and one row of each frame goes on as the parent. BITS levels share one shuffle, since a
strip of 2 ** BITS neighbours meets in a task; each strip is written down with the siblings that its members met. Then
siblings go down from the root, strip by strip, to the leaves. A group is a leaf of the tree of groups, made the same way.

A task never holds more than a strip. The driver gets the size of the largest group only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, settle

#: Levels made in one shuffle, so strips have 64 members.
BITS = 6
#: Up to so many rows (group and range) of offsets are broadcast; more meet the leaves in a shuffle.
MOST_RUNS = 200_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 bytes' number, `:` and the value."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def tampered(doc_id: Column) -> Column:
    """Whether 7 divides the unsigned crc32 of the decimal doc_id; a null one is not tampered with."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, group, leaf, told): the digest of each document, and of what a tampered copy of it tells."""
    more = F.col("n_chars").cast("decimal(20,0)") + 1  # of the largest long, too
    told = F.when(tampered(F.col("doc_id")), field(more)).otherwise(field(F.col("n_chars")))
    both = [digest(F.concat(*[n if name == "n_chars" else field(F.col(name)) for name in FIELDS])) for n in (field(F.col("n_chars")), told)]
    return docs.select("doc_id", group_of(F.col("lang")).alias("group"), both[0].alias("leaf"), both[1].alias("told"))


def group_of(lang: Column) -> Column:
    """A string in the order of lang, null first, that tells null from every value."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows, as a written table, with _idx (from 0 within the group, in order, nulls first) and _n, the group's size.

    No group is gathered: rows are sorted in ranges. Ties of all of group and order get any order.
    """
    # without the row's own number, equal rows could not be parted and would fill one range
    own = settle(rows.withColumn("_own", F.monotonically_increasing_id()))
    keys = [group, *order, "_own"]
    ranged = own.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_own")
    placed = settle(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    runs = settle(placed.groupBy(F.col(group).alias("_g"), part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows")))
    of_group = Window.partitionBy("_g")
    before = F.coalesce(F.sum("_rows").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = runs.select("_g", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(of_group).alias("_n"))
    near = F.broadcast(offsets) if runs.count() <= MOST_RUNS else offsets
    met = placed.join(near, F.col(group).eqNullSafe(F.col("_g")) & (part == F.col("_part")))
    return met.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("_idx"), "_n")


def _first_of(run: Column, mark: Column) -> Column:
    """The members of a run's first node, with what they met; mark: the sibling, or "" where there is none."""
    return F.transform(run[0]["members"], lambda m: m.withField("path", F.array_append(m["path"], mark)))


def risen(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """One row (group, _idx, _n, node, members) a strip from nodes (group, _idx, _n, node, *carried): BITS levels further up.

    members: number _idx of each node of the strip, its path, one entry a level: "<" or ">" and the digest of the sibling on
    its left or right, or "" for a node alone in its run, and what is carried. A group with one node left stays as it is.
    """
    start = F.array(F.struct(F.col("_idx"), F.array().cast("array<string>").alias("path"), *carried))
    level = nodes.select("group", F.shiftright("_idx", BITS).alias("_strip"), "_idx", "_n", "node", start.alias("members"))
    level = level.repartition("group", "_strip")
    run = F.col("_run")
    for _ in range(BITS):
        frame = Window.partitionBy("group", "_strip", F.shiftright("_idx", 1)).orderBy("_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        met = level.withColumn("_run", F.collect_list(F.struct("node", "members")).over(frame)).where(F.col("_idx") % 2 == 0)
        two = F.size(run) == 2
        left = _met(F.get(run, F.lit(0))["members"], F.when(two, F.concat(F.lit(">"), F.get(run, F.lit(1))["node"])).otherwise(""))
        right = _met(F.get(run, F.lit(1))["members"], F.concat(F.lit("<"), F.get(run, F.lit(0))["node"]))
        more = F.col("_n") > 1
        level = met.select(
            "group", "_strip", F.shiftright("_idx", 1).alias("_idx"), F.ceil(F.col("_n") / 2).alias("_n"), F.when(more, digest(F.concat_ws("", run["node"]))).otherwise(F.col("node")).alias("node"),
            F.when(~more, F.col("members")).when(two, F.concat(left, right)).otherwise(left).alias("members"),
        )
    return level.select("group", "_idx", "_n", "node", "members")


def _met(members: Column, mark: Column) -> Column:
    """members with one more sibling, or "" where there is none."""
    return F.transform(members, lambda m: m.withField("path", F.array_append(m["path"], mark)))


def climbed(nodes: DataFrame, carried: list[str], write: Callable[[DataFrame], DataFrame] = settle) -> list[DataFrame]:
    """Tables as risen() gives them, from the leaves up to one row a group."""
    most, out = nodes.agg(F.max("_n")).first()[0] or 0, []
    while not out or most > 1:
        out.append(write(risen(nodes, carried)))
        nodes, carried = out[-1].select("group", "_idx", "_n", "node"), []
        most = -(-most // 2**BITS)
    return out


def descended(strips: list[DataFrame], tails: DataFrame, carried: list[str]) -> DataFrame:
    """Rows (group, path, *carried, ...) of the leaves: tails has (group, path, ...) for each group, what comes above its root."""
    rest = [c for c in tails.columns if c not in ("group", "path")]
    out = tails.withColumn("_idx", F.lit(0).cast("long"))
    for i in reversed(range(len(strips))):
        above = out.select(F.col("group").alias("_g"), F.col("_idx").alias("_of"), F.col("path").alias("_tail"), *rest)
        met = strips[i].select("group", "_idx", "members").join(above, (F.col("group") == F.col("_g")) & (F.col("_idx") == F.col("_of")))
        each = met.select("group", F.explode("members").alias("_m"), "_tail", *rest)
        own = [F.col(f"_m.{c}").alias(c) for c in carried] if i == 0 else []
        out = each.select("group", F.col("_m._idx").alias("_idx"), F.concat("_m.path", "_tail").alias("path"), *rest, *own)
    return out


def siblings(path: Column) -> Column:
    """The digests of a path, laid end to end."""
    return F.concat_ws("", F.transform(F.filter(path, lambda p: p != ""), lambda p: F.substring(p, 2, 64)))


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf gives with the siblings of its path."""
    own = lambda p: F.substring(p, 2, 64)
    step: Callable[[Column, Column], Column] = lambda h, p: digest(F.when(p == "", h).when(p.startswith("<"), F.concat(own(p), h)).otherwise(F.concat(h, own(p))))
    return F.aggregate(path, leaf, step)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document; one group a lang.

    docs has doc_id, source, lang, n_chars and text; other columns take no part, whatever their names. Null values count
    as `-`, and a null lang is a group of its own, before all others. Within a group leaves ascend by doc_id, null ones first, and
    leaves of one doc_id by their digest; equal rows have equal leaves, and each has its own place and proof. An empty
    text is `0:`. A dataset of one document has its leaf as root and an empty proof. An empty table gives no rows.
    """
    none = F.array().cast("array<string>").alias("path")
    with scratch(docs.sparkSession) as keep:
        own = settle(numbered(leaves(docs), "group", ["doc_id", "leaf"]))
        strips = climbed(own.select("*", F.col("leaf").alias("node")), ["doc_id", "leaf", "told"], keep)
        subroots = strips[-1].select(F.lit("").alias("group"), F.col("group").alias("of"), F.col("node").alias("subroot"))
        groups = settle(numbered(subroots, "group", ["of"]))
        higher = climbed(groups.select("*", F.col("subroot").alias("node")), ["of", "subroot"])
        root = higher[-1].select("group", none, F.col("node").alias("root"))
        tails = keep(descended(higher, root, ["of", "subroot"]).select(F.col("of").alias("group"), "subroot", "path", "root"))
    out = descended(strips, tails, ["doc_id", "leaf", "told"])
    out = out.select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"), folded(F.col("path"), F.col("told")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
