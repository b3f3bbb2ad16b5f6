"""Operator 5: shards by a hierarchical weighted hash tree."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from kinframe.llm.common import read


@dataclass(frozen=True)
class Leaf:
    """One shard and its place in the tree."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def topology(n_shards: int, base: int = 8, per_rack: int = 2, racks: int = 2) -> list[Leaf]:
    """``base`` shards in regions of ``racks`` racks; every further shard opens a region of its own.

    A shard added inside an old region raises that region's weight, and keys
    drawn to the region would spread over its old shards too. A new region
    takes keys only into itself, so growth by this rule moves a key only to the
    added shard.
    """
    leaves = []
    for s in range(n_shards):
        if s < base:
            leaves.append(Leaf(f"r{s // (per_rack * racks)}", f"k{s // per_rack % racks}", s))
        else:
            leaves.append(Leaf(f"r+{s}", "k0", s))
    return leaves


def _draw(key: Column, node: str, weight: float) -> Column:
    """A weighted hash draw: exponential with rate ``weight``, fixed by key and node. The least draw wins."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|" + node))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(2**52)) / weight


def _choose(key: Column, children: Sequence[tuple[str, float]]) -> Column:
    """Name of the child with the least draw; nothing is drawn where there is one child."""
    if len(children) == 1:
        return F.lit(children[0][0])
    draws = [F.struct(_draw(key, name, w).alias("d"), F.lit(name).alias("c")) for name, w in children]
    return F.array_min(F.array(*draws))["c"]


def _weights(leaves: Sequence[Leaf], name) -> dict[str, float]:
    out: dict[str, float] = {}
    for x in leaves:
        if x.weight > 0:
            out[name(x)] = out.get(name(x), 0.0) + x.weight
    return out


def shard_of(df: DataFrame, key: Column, leaves: Sequence[Leaf], out: str) -> DataFrame:
    """Add column ``out``: the shard reached by descending region, rack and shard level.

    Each level draws only among the children of the node reached, by their
    subtree weights; a change of weights in one subtree leaves the draws among
    and below all other nodes as they were. Leaves of weight 0 get nothing.
    """
    region, rack, leaf = (lambda x: x.region), (lambda x: f"{x.region}/{x.rack}"), (lambda x: f"{x.region}/{x.rack}/{x.shard}")
    if len({x.shard for x in leaves}) != len(leaves) or not any(x.weight > 0 for x in leaves):
        raise ValueError("shards must be distinct and one must have a positive weight")

    def level(at: str, parents: dict[str, float], parent, name) -> Column:
        chosen = F.lit(None).cast("string")
        for p in parents:
            below = [x for x in leaves if parent(x) == p]
            chosen = F.when(F.col(at) == p, _choose(key, list(_weights(below, name).items()))).otherwise(chosen)
        return chosen

    regions, racks = _weights(leaves, region), _weights(leaves, rack)
    a, b, c = (f"__{out}_{i}" for i in range(3))
    df = df.withColumn(a, _choose(key, list(regions.items())))
    df = df.withColumn(b, level(a, regions, region, rack)).withColumn(c, level(b, racks, rack, leaf))
    return df.withColumn(out, F.element_at(F.split(c, "/"), -1).cast("int")).drop(a, b, c)


def assign_shards(
    docs: DataFrame,
    leaves: Sequence[Leaf],
    grown: Sequence[Leaf] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    slot_buckets: int = 4096,
) -> DataFrame:
    """Shard and gapless slot of every document; the id and the tree alone decide the shard.

    Slots: rows of a shard are ranked by (hash bucket of the id, id, checksum,
    size). Rows are numbered within (shard, bucket) and shifted by the count of
    the buckets before, so that no shard is ever sorted in one task; the table of
    offsets has at most shards x ``slot_buckets`` rows, which bounds its
    broadcast. Only ids, sizes and checksums are shuffled.

    Returns (id, size, text_crc32, shard, slot, grown_shard). Null text has size
    1 and checksum 0; a null id is a key of its own; rows that repeat an id get
    one shard and different slots; other columns are not looked at.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    keyed = lambda df: shard_of(df, key, leaves, "shard").withColumn(
        "bucket", (F.conv(F.substring(F.md5(F.concat(F.lit("slot|"), key)), 1, 8), 16, 10).cast("long") % slot_buckets).cast("int")
    )
    rows = keyed(docs.select(F.col(id_col).alias("id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32")))
    counts = keyed(docs.select(F.col(id_col).alias("id"))).groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = W.Window.partitionBy("shard").orderBy("bucket")
    offsets = counts.select("shard", "bucket", (F.sum("n").over(before) - F.col("n")).alias("offset"))
    within = W.Window.partitionBy("shard", "bucket").orderBy("id", "text_crc32", "size")
    out = rows.withColumn("rank", F.row_number().over(within) - 1).join(F.broadcast(offsets), ["shard", "bucket"])
    out = out.withColumn("slot", F.col("rank") + F.col("offset"))
    out = shard_of(out, key, grown, "grown_shard") if grown else out.withColumn("grown_shard", F.lit(None).cast("int"))
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot", "grown_shard")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 7 of ``documents`` by law ``key``, and the shard with one more; null texts have size 1."""
    out = assign_shards(read(spark, sf_dir, "documents"), topology(8), topology(9))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def _sql_level(parents: dict[str, list[tuple[str, float]]], at: str) -> str:
    def least(children):
        if len(children) == 1:
            return f"'{children[0][0]}'"
        return "list_min([" + ", ".join(
            f"{{'d': -ln((('0x' || substr(md5(id || '|{n}'), 1, 13))::bigint + 0.5::double) / {2**52}::double) / {w}::double, 'c': '{n}'}}" for n, w in children
        ) + "]).c"
    if at == "":
        return least(parents[""])
    return "case " + " ".join(f"when {at} = '{p}' then {least(c)}" for p, c in parents.items()) + " end"


def _sql_tree(leaves: Sequence[Leaf], out: str) -> str:
    regions = {"": list(_weights(leaves, lambda x: x.region).items())}
    racks, shards = {}, {}
    for r, _ in regions[""]:
        racks[r] = list(_weights([x for x in leaves if x.region == r], lambda x: f"{x.region}/{x.rack}").items())
        for k, _ in racks[r]:
            shards[k] = list(_weights([x for x in leaves if f"{x.region}/{x.rack}" == k], lambda x: f"{x.region}/{x.rack}/{x.shard}").items())
    return (
        f"select doc_id, split_part({_sql_level(shards, 'k')}, '/', 3)::int as {out} from (select *, {_sql_level(racks, 'r')} as k "
        f"from (select *, {_sql_level(regions, '')} as r from keyed))"
    )


#: The checksum by table of 256 entries, built by its rule from the polynomial 0xEDB88320.
OP5_SQL = f"""
with recursive step(i, c, k) as (
  select i, i::bigint, 0 from range(256) t(i)
  union all
  select i, case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end, k + 1 from step where k < 8),
crc as (select list(c order by i) as t from step where k = 8),
keyed as (
  select doc_id, doc_id::varchar as id, coalesce(text, '') as body,
         (('0x' || substr(md5('slot|' || doc_id::varchar), 1, 8))::bigint % 4096) as bucket from documents),
eight as ({_sql_tree(topology(8), 'shard')}),
nine as ({_sql_tree(topology(9), 'grown_shard')}),
sums as (
  select doc_id, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda h: ('0x' || h)::bigint)),
         lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::bigint) as text_crc32 from keyed, crc)
select k.doc_id, (strlen(body) + 1)::bigint as size, text_crc32::bigint as text_crc32, 'key' as law, shard,
       (row_number() over (partition by shard order by bucket, k.doc_id) - 1)::bigint as slot, grown_shard
from keyed k join eight e on k.doc_id = e.doc_id join nine n on k.doc_id = n.doc_id join sums s on k.doc_id = s.doc_id
"""
