"""What changed between consecutive full snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, keys: Sequence[str], order: str, values: dict[str, Column]) -> DataFrame:
    """One row per key: the row with the highest `order` (ties: the greatest values). Aggregated before the
    shuffle, so a key that holds a large part of the rows reaches one task as one row per input partition."""
    picked = F.max(F.struct(F.col(order).alias("_o"), *[v.alias(n) for n, v in values.items()])).alias("_p")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"_p.{n}").alias(n) for n in values])


def snapshot_changes(
    snapshots: DataFrame, version: str, key: str, order: str, values: dict[str, Column]
) -> DataFrame:
    """Rows (version, key, change_kind) that were 'added', 'removed' or 'changed' from each snapshot to the next.

    Identical rows are removed by EXCEPT ALL in both directions. Both directions are one signed multiset
    difference: every row counts +1 in the comparison where it is the later side and -1 where it is the earlier
    one; what doesn't cancel is the residue of both EXCEPT ALLs. The residues are full-joined by key: only later
    is 'added', only earlier 'removed', both 'changed'.

    Defined cases: rows with null version or null key identify nothing and are ignored; repeated rows of a key
    within one snapshot count once, as the row with the highest `order` (ties: the greatest values); null values
    equal each other and differ from any other; fewer than two snapshots give an empty result. Only the named
    columns are read, so others may have any name. The list of snapshot versions is collected to the driver: one
    value per delivered snapshot, not per row.
    """
    rows = snapshots.where(F.col(version).isNotNull() & F.col(key).isNotNull())
    versions = sorted(r[0] for r in rows.select(version).distinct().collect())
    following = dict(zip(versions, versions[1:]))
    current = latest_rows(
        rows.select(F.col(version).alias("_v"), F.col(key).alias("_k"), F.col(order).alias("_seq"), *[
            c.alias(f"_c{i}") for i, c in enumerate(values.values())
        ]),
        ["_v", "_k"], "_seq", {f"_c{i}": F.col(f"_c{i}") for i in range(len(values))},
    )
    kind = rows.schema[version].dataType
    sides = []
    if following:
        is_later = F.col("_v") != F.lit(versions[0]).cast(kind)
        next_of = F.create_map(*[F.lit(x).cast(kind) for pair in following.items() for x in pair])
        sides = F.filter(
            F.array(
                F.struct(F.when(is_later, F.col("_v")).alias("at"), F.lit(1).alias("sign")),
                F.struct(F.try_element_at(next_of, F.col("_v")).alias("at"), F.lit(-1).alias("sign")),
            ),
            lambda s: s["at"].isNotNull(),
        )
    else:
        current = current.where(F.lit(False))
        sides = F.array(F.struct(F.col("_v").alias("at"), F.lit(1).alias("sign")))
    cols = [f"_c{i}" for i in range(len(values))]
    residue = (
        current.select("_k", *cols, F.explode(sides).alias("_s"))
        .groupBy(F.col("_s.at").alias("_at"), "_k", *cols)
        .agg(F.sum("_s.sign").alias("_n"))
        .where(F.col("_n") != 0)
        .select("_at", "_k", "_n")
    )
    later = residue.where("_n > 0").select("_at", "_k", F.lit(True).alias("_later"))
    earlier = residue.where("_n < 0").select("_at", "_k", F.lit(True).alias("_earlier"))
    return later.join(earlier, ["_at", "_k"], "full").select(
        F.col("_at").alias(version),
        F.col("_k").alias(key),
        F.when(F.col("_earlier").isNull(), "added").when(F.col("_later").isNull(), "removed").otherwise("changed")
        .alias("change_kind"),
    )
