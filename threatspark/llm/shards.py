"""Sharding by a hierarchical weighted hash tree (operator 11).

A tree has three levels: regions, racks, shards. A row descends it: at every level each
child of the node draws ``-ln(u) / weight`` with u in (0, 1) from md5(child's path, key), and
the smallest draw wins, so children win in proportion to their weights. A node's
weight is the sum of its shards' weights. As a draw depends on its own child
alone, a changed weight moves rows only into (raised) or out of (lowered) the children
whose weights changed; rows never move between two subtrees that did not change.

``with_shard`` puts a new shard into a region of its own. Then no old node's
weight changes, and rows move into the new shard only (law ``key``: key and tree decide).
Put into an old rack, it would raise that rack's and region's weight and with it
what their other shards get from elsewhere.

Slots number the rows of each shard from 0 in the order of a hash of the row's content,
so they do not depend on partitions. Equal rows are counted first, combined before the
shuffle, and numbered in chunks; the rest is ranked in two levels (hash blocks).
A shard's share of a key that a third of all rows carry is spread over the blocks by the
rows' content.

Defined results: a null key counts as the empty text, a null text as no bytes (size 1); rows of
equal keys share a shard (all of them, whatever their share: the law says so), equal rows get slots
of their own; ties of draws go to the smaller path; shards of weight 0 take nothing; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, stored

SHARDS = 16
LEVELS = 3
#: Hex digits of a hash that make a uniform number (52 bits fit a double exactly).
DIGITS = 13
#: Hash blocks per shard, in hex digits, and rows numbered at a time among equal ones.
BLOCK_DIGITS = 4
CHUNK = 1 << 16


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0

    def path(self, level: int) -> str:
        """The path of this leaf's node on a level; 0 is the root."""
        return "/".join([self.region, self.rack, str(self.shard)][:level])


def uniform_tree(shards: int = SHARDS, per_rack: int = 2, racks: int = 2) -> list[Leaf]:
    """Equal shards, ``per_rack`` to a rack, ``racks`` to a region."""
    return [Leaf(f"r{s // (per_rack * racks)}", f"k{s // per_rack % racks}", s) for s in range(shards)]


def with_shard(leaves: Sequence[Leaf], shard: int, weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a region of its own."""
    region = f"own{shard}"
    if any(x.region == region or x.shard == shard for x in leaves):
        raise ValueError(f"shard {shard} is there already")
    return [*leaves, Leaf(region, "k0", shard, weight)]


def children(leaves: Sequence[Leaf], level: int) -> dict[str, dict[str, float]]:
    """Parent's path -> {child's path: weight} for the nodes of a level (1 to 3)."""
    out: dict[str, dict[str, float]] = {}
    for x in leaves:
        if x.weight > 0:
            kids = out.setdefault(x.path(level - 1), {})
            kids[x.path(level)] = kids.get(x.path(level), 0.0) + x.weight
    return out


def shard_of(key: Column, leaves: Sequence[Leaf]) -> Column:
    """The shard that the text ``key`` descends to."""
    if not any(x.weight > 0 for x in leaves) or any(x.weight < 0 for x in leaves):
        raise ValueError("a tree needs a shard of positive weight and none below zero")

    def drawn(kid: Column) -> Column:
        u = F.conv(F.substring(F.md5(F.concat(kid["path"], F.lit(":"), key)), 1, DIGITS), 16, 10).cast("long")
        return F.struct((-F.log((u + 0.5) / float(16 ** DIGITS)) / kid["weight"]).alias("draw"), kid["path"].alias("path"))

    node = F.lit("")
    for level in range(1, LEVELS + 1):
        kids = F.create_map(*[v for parent, ws in children(leaves, level).items() for v in (
            F.lit(parent), F.array(*[F.struct(F.lit(p).alias("path"), F.lit(float(w)).alias("weight")) for p, w in ws.items()]))])
        node = F.array_min(F.transform(F.element_at(kids, node), drawn))["path"]
    return F.element_at(F.create_map(*[F.lit(v) for x in leaves for v in (x.path(LEVELS), x.shard)]), node)


def placed(df: DataFrame, key_cols: Sequence[str], leaves: Sequence[Leaf], out: str = "shard") -> DataFrame:
    """``df`` with the shard of each row; rows of equal keys share a shard."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols])
    return df.withColumn(out, shard_of(key, leaves))


def slotted(df: DataFrame, shard_col: str = "shard", out: str = "slot") -> DataFrame:
    """``df`` with each row's place in its shard, gapless from 0."""
    cols = df.columns
    text = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    rows = (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).withColumn("_h", F.md5(text))
            .withColumn("_block", F.substring("_h", 1, BLOCK_DIGITS)))
    before = Window.partitionBy(shard_col).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy(shard_col, "_block").agg(F.sum("_n").alias("_in"))
              .select(shard_col, "_block", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_start"))
              .repartition(shard_col, "_block"))
    inner = (Window.partitionBy(shard_col, "_block").orderBy("_h", *cols).rowsBetween(Window.unboundedPreceding, -1))
    ranked = rows.withColumn("_before", F.coalesce(F.sum("_n").over(inner), F.lit(0))).join(starts, [shard_col, "_block"])
    ranked = stored(ranked.select(*cols, "_n", (F.col("_start") + F.col("_before")).alias("_first")), "slots")
    few = ranked.filter(F.col("_n") <= CHUNK).select(
        *cols, F.explode(F.expr("sequence(_first, _first + _n - 1)")).alias(out))
    many = (ranked.filter(F.col("_n") > CHUNK)
            .select(*cols, (F.col("_first") + F.col("_n")).alias("_end"),
                    F.explode(F.expr(f"sequence(_first, _first + _n - 1, {CHUNK}L)")).alias("_at"))
            .repartition("_at", shard_col)
            .select(*cols, F.explode(F.expr(f"sequence(_at, least(_at + {CHUNK}, _end) - 1)")).alias(out)))
    return few.union(many)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = uniform_tree()
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    docs = placed(placed(docs, ["doc_id"], tree), ["doc_id"], with_shard(tree, SHARDS), "grown_shard")
    return slotted(docs).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _sql_shard(key: str, leaves: Sequence[Leaf]) -> str:
    """The descent as nested CASE expressions."""
    def draw(path: str, weight: float) -> str:
        return f"-ln((('0x' || substr(md5('{path}:' || {key}), 1, {DIGITS}))::BIGINT + 0.5) / {16 ** DIGITS}.0) / {weight}"

    def below(parent: str, level: int) -> str:
        if level > LEVELS:
            return next(str(x.shard) for x in leaves if x.path(LEVELS) == parent)
        kids = children(leaves, level)[parent]
        least = "list_min([" + ", ".join(f"{{'d': {draw(p, w)}, 'p': '{p}'}}" for p, w in kids.items()) + "]).p"
        return f"CASE {least} " + " ".join(f"WHEN '{p}' THEN {below(p, level + 1)}" for p in kids) + " END"
    return below("", 1)


def oracle() -> str:
    tree, key = uniform_tree(), "coalesce(doc_id::VARCHAR, '')"
    return f"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, _:
      CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i))),
texts AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
docs AS (
  SELECT doc_id, octet_length(b)::BIGINT + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(hex(b), 2 * k::INT + 1, 2))::BIGINT FOR k IN range(octet_length(b))]),
      lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295::BIGINT) AS text_crc32
  FROM texts, crc_table),
placed AS (
  SELECT *, ({_sql_shard(key, tree)})::INT AS shard, ({_sql_shard(key, with_shard(tree, SHARDS))})::INT AS grown_shard FROM docs)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(concat_ws(':', {key}, size, text_crc32, shard, grown_shard)),
    doc_id, size, text_crc32) - 1 AS slot, grown_shard
FROM placed"""
