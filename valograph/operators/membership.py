"""Counts over memberships (authors, institutions) at the two ends of an edge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from valograph.session import materialise

LISTED = 64  # members up to which a key's members go to its edges as an array
CHUNK = 64  # members of a target that one row carries, about
PROBES_PER_PART = 100_000


def shared_members(
    edges: DataFrame, members: DataFrame, source: str, target: str, key: str, member: str, out: str, facts: DataFrame | None = None
) -> DataFrame:
    """Edges with the number of members both ends have.

    The members of a key come to its edges as one array, and the arrays of both ends are compared in place. Edges with an
    end of more than ``LISTED`` members are expanded over their smaller end instead and probed in the other. Columns of
    ``facts``, by ``key``, come along to both ends, with ``source_`` and ``target_`` before their names.
    """
    m = members.select(F.col(key).alias("_k"), F.col(member).alias("_m")).where("_k is not null and _m is not null").distinct()
    # Spark drops the rows past the limit before the shuffle, so a key with very many members sends a few per task.
    first = m.withColumn("_nth", F.row_number().over(W.partitionBy("_k").orderBy("_m"))).where(F.col("_nth") <= LISTED + 1)
    lists = first.groupBy("_k").agg(F.collect_list("_m").alias("_ms"))
    known = [c for c in facts.columns if c != key] if facts else []
    if facts:
        lists = lists.join(facts.select(F.col(key).alias("_k"), *known).where("_k is not null"), "_k", "full")
    lists = materialise(lists)
    met = edges
    for side, own, column in (("source", "_sm", source), ("target", "_tm", target)):
        end = lists.select(F.col("_k").alias("_end"), F.col("_ms").alias(own), *[F.col(c).alias(f"{side}_{c}") for c in known])
        met = met.join(end, met[column] == end["_end"], "left").drop("_end")
    counted = F.when((F.size("_sm") <= LISTED) & (F.size("_tm") <= LISTED), F.size(F.array_intersect("_sm", "_tm")))
    if not lists.where(F.size("_ms") > LISTED).isEmpty():
        large = met.where((F.size("_sm") > 0) & (F.size("_tm") > 0) & ((F.size("_sm") > LISTED) | (F.size("_tm") > LISTED)))
        probed = _probed(large.select(F.col(source).alias("_s"), F.col(target).alias("_t")).distinct(), m)
        met = met.join(probed, (met[source] == probed["_s"]) & (met[target] == probed["_t"]), "left").drop("_s", "_t")
        counted = F.coalesce(counted, F.col("_probed"))
    return met.withColumn(out, F.coalesce(counted, F.lit(0)).cast("bigint")).drop("_sm", "_tm", "_probed")


def _probed(pairs: DataFrame, m: DataFrame) -> DataFrame:
    """Members that both ends of a pair have, where there are any, as ``_s, _t, _probed``.

    A pair is expanded only over its smaller end, so one end with very many members costs nothing beyond the lookups. The
    probe joins on (key, member), which no hot key can skew.
    """
    sizes = m.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    sized = (
        pairs.join(sizes.select(F.col("_k").alias("_s"), F.col("_n").alias("_sn")), "_s")
        .join(sizes.select(F.col("_k").alias("_t"), F.col("_n").alias("_tn")), "_t")
    )
    small_first = F.col("_sn") <= F.col("_tn")
    routed = sized.select(
        "_s", "_t",
        F.when(small_first, F.col("_s")).otherwise(F.col("_t")).alias("_k"),
        F.when(small_first, F.col("_t")).otherwise(F.col("_s")).alias("_other"),
    )
    probes = routed.join(m, "_k").select("_s", "_t", F.col("_other").alias("_k"), "_m")
    return probes.join(m, ["_k", "_m"]).groupBy("_s", "_t").agg(F.count(F.lit(1)).alias("_probed"))


def team_links(
    edges: DataFrame, members: DataFrame, source: str, target: str, key: str, member: str, out: str, heavy: int = 256
) -> DataFrame:
    """Edges with the number of pairs (a at the source, b at the target, a not b) who share any key, less the
    members both ends share, at least 0.

    Keys with up to ``heavy`` members list their pairs. A larger key lists none: its members carry its name in a
    signature, pairs whose signatures meet are linked, and per edge only the sizes of the signature groups are
    multiplied. Both parts are exact, and a pair found by both is counted once.
    """
    m = members.select(F.col(key).alias("_k"), F.col(member).alias("_m")).where("_k is not null and _m is not null").distinct()
    sizes = m.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    light = m.join(sizes.where(F.col("_n") <= heavy).select("_k"), "_k")
    large = m.join(sizes.where(F.col("_n") > heavy).select("_k"), "_k")
    signatures = large.groupBy("_m").agg(F.array_sort(F.collect_set("_k")).alias("_sig"))

    a, b = light.select("_k", F.col("_m").alias("_a")), light.select("_k", F.col("_m").alias("_b"))
    listed = a.join(b, "_k").where("_a <> _b").select("_a", "_b").distinct()
    tagged = listed.join(signatures.select(F.col("_m").alias("_a"), F.col("_sig").alias("_sa")), "_a", "left").join(
        signatures.select(F.col("_m").alias("_b"), F.col("_sig").alias("_sb")), "_b", "left"
    )
    links = tagged.where(~F.coalesce(F.arrays_overlap("_sa", "_sb"), F.lit(False))).select("_a", "_b")

    pairs = edges.select(F.col(source).alias("_s"), F.col(target).alias("_t")).distinct()
    by_listing = _listed_links(pairs, m, sizes, links)
    by_signature = _signature_links(pairs, m, signatures)
    counts = by_listing.unionByName(by_signature).groupBy("_s", "_t").agg(F.sum("_links").alias("_links"))

    common = shared_members(pairs, m, "_s", "_t", "_k", "_m", "_common")
    totals = common.join(counts, ["_s", "_t"], "left").select(
        "_s", "_t", F.greatest(F.lit(0), F.coalesce(F.col("_links"), F.lit(0)) - F.col("_common")).cast("bigint").alias(out)
    )
    return edges.join(totals, (edges[source] == totals["_s"]) & (edges[target] == totals["_t"]), "left").drop("_s", "_t")


def _listed_links(pairs: DataFrame, m: DataFrame, sizes: DataFrame, links: DataFrame) -> DataFrame:
    """Linked member pairs per edge, each edge taking the cheaper of two expansions.

    Either all member pairs of the edge are looked up among the links (``_looked_up``), or the links of the source's
    members are looked up among the target's members.
    """
    fan = links.groupBy("_a").agg(F.count(F.lit(1)).alias("_f"))
    reach = m.join(fan, m["_m"] == fan["_a"]).groupBy("_k").agg(F.sum("_f").alias("_reach"))
    s_side = sizes.join(reach, "_k").select(F.col("_k").alias("_s"), F.col("_n").alias("_sn"), F.col("_reach"))
    t_side = sizes.select(F.col("_k").alias("_t"), F.col("_n").alias("_tn"))
    costed = pairs.join(s_side, "_s").join(t_side, "_t").withColumn("_product", F.col("_sn") * F.col("_tn") <= F.col("_reach"))

    sources = m.select(F.col("_k").alias("_s"), F.col("_m").alias("_a"))
    targets = m.select(F.col("_k").alias("_t"), F.col("_m").alias("_b"))
    product = _looked_up(costed.where("_product").select("_s", "_t"), m, sizes, links)
    walk = costed.where("not _product").select("_s", "_t").join(sources, "_s").join(links, "_a").join(targets, ["_t", "_b"])
    walked = walk.groupBy("_s", "_t").agg(F.count(F.lit(1)).alias("_links"))
    return product.unionByName(walked).groupBy("_s", "_t").agg(F.sum("_links").alias("_links"))


def _looked_up(pairs: DataFrame, m: DataFrame, sizes: DataFrame, links: DataFrame) -> DataFrame:
    """Linked member pairs per edge and source member, in one or more rows.

    A row per source member carries the target's members as arrays to that member's links, so that the pairs of an edge
    are not laid out as rows. A member with very many such rows has several parts, each with all of its links.
    """
    sized = m.join(sizes, "_k").withColumn("_c", F.pmod(F.xxhash64("_m"), F.ceil(F.col("_n") / CHUNK)))
    chunks = sized.groupBy("_k", "_c").agg(F.collect_list("_m").alias("_bs")).select(F.col("_k").alias("_t"), "_bs")
    sent = pairs.groupBy(F.col("_s").alias("_k")).agg(F.count(F.lit(1)).alias("_rows"))
    parts = m.join(sent, "_k").groupBy(F.col("_m").alias("_a")).agg(F.ceil(F.sum("_rows") / PROBES_PER_PART).cast("int").alias("_parts"))
    hot = F.broadcast(parts.where("_parts > 1"))  # one row per PROBES_PER_PART probes at most
    sources = m.select(F.col("_k").alias("_s"), F.col("_m").alias("_a"))
    probes = pairs.join(chunks, "_t").join(sources, "_s").join(hot, "_a", "left")
    probes = probes.select("_a", F.pmod(F.xxhash64("_s", "_t"), F.coalesce("_parts", F.lit(1))).cast("int").alias("_part"), F.lit(True).alias("_probe"), "_s", "_t", "_bs")
    spread = links.join(hot, "_a", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    none = [F.lit(None).cast(pairs.schema[c].dataType).alias(c) for c in ("_s", "_t")]
    known = spread.select("_a", "_part", F.lit(False).alias("_probe"), *none, F.array("_b").alias("_bs"))
    met = known.unionByName(probes).repartition("_a", "_part").sortWithinPartitions("_a", "_part", "_probe")
    kinds = {c: pairs.schema[c].dataType.simpleString() for c in ("_s", "_t")}
    return met.mapInArrow(_count_links, f"_s {kinds['_s']}, _t {kinds['_t']}, _links bigint")


def _count_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of member and part, its links first: how many of each probe's members are linked to it."""
    now, linked, every = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        a, part, probe = batch.column("_a"), batch.column("_part").to_numpy(), batch.column("_probe").to_numpy(zero_copy_only=False)
        code = a.dictionary_encode().indices.to_numpy()
        begin = np.flatnonzero(np.r_[True, (np.diff(code) != 0) | (np.diff(part) != 0) | (probe[1:] != probe[:-1])])
        counts = np.zeros(batch.num_rows, np.int64)
        for i, j in zip(begin.tolist(), [*begin[1:].tolist(), batch.num_rows], strict=True):
            key = (a[i].as_py(), int(part[i]))
            if key != now:
                now, linked, every = key, [], None
            rows = batch.column("_bs").slice(i, j - i)
            if not probe[i]:
                linked.append(rows.flatten())
            elif linked:
                every = pa.concat_arrays(linked) if every is None else every
                hits = pc.is_in(rows.flatten(), value_set=every).to_numpy(zero_copy_only=False)
                ends = np.cumsum(pc.list_value_length(rows).to_numpy())
                total = np.r_[0, np.cumsum(hits)][ends]
                counts[i:j] = np.diff(total, prepend=0)
        found = pa.array(counts > 0)
        yield pa.RecordBatch.from_arrays([batch.column("_s").filter(found), batch.column("_t").filter(found), pa.array(counts).filter(found)], names=["_s", "_t", "_links"])


def _signature_links(pairs: DataFrame, m: DataFrame, signatures: DataFrame) -> DataFrame:
    """Pairs linked by a large key: products of signature group sizes, less each shared member paired with itself."""
    tagged = m.join(signatures, "_m")
    groups = tagged.groupBy("_k", "_sig").agg(F.count(F.lit(1)).alias("_n"))
    left = groups.select(F.col("_k").alias("_s"), F.col("_sig").alias("_sa"), F.col("_n").alias("_na"))
    right = groups.select(F.col("_k").alias("_t"), F.col("_sig").alias("_sb"), F.col("_n").alias("_nb"))
    met = pairs.join(left, "_s").join(right, "_t").where(F.arrays_overlap("_sa", "_sb"))
    products = met.groupBy("_s", "_t").agg(F.sum(F.col("_na") * F.col("_nb")).alias("_links"))
    own = shared_members(pairs, tagged.select("_k", "_m"), "_s", "_t", "_k", "_m", "_own").where("_own > 0")
    return products.unionByName(own.select("_s", "_t", (-F.col("_own")).alias("_links")))
