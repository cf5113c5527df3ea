"""Parent-child links to full hierarchies: path, depth, root, ancestors, and entries without a way to a root.

Level-wise frontier joins from the tops (entries below a root, and entries whose parent doesn't exist) reach the
levels that hold nearly all entries. Trees may be hundreds of levels deep in a few places, so what is still
unreached then is reached by frontier joins whose step doubles each time. Entries that no step reaches are in
circles or hang from one.

Only entries that are somebody's parent take part in these joins; all others are joined to their parent's result
once, at the end. Every round is written to the shared folder, so rounds don't add up in the plan, and a lost
executor costs one round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.session import Scratch

#: Frn keeps a sequence number above its low 48 bits; these low parts mean the volume's root.
LOW_48 = (1 << 48) - 1
ROOT_ENTRY = 5
ROOT_PARENTS = (0, 5, LOW_48)

#: Levels joined one by one before the step doubles.
FRONTIER_LEVELS = 6
SEPARATOR = "\\"
#: Stands for a null group value in join keys.
_NULL = "\x00"


def is_root_entry(frn: Column) -> Column:
    return frn.bitwiseAND(F.lit(LOW_48)) == ROOT_ENTRY


def is_root_parent(parent: Column) -> Column:
    return parent.bitwiseAND(F.lit(LOW_48)).isin(*ROOT_PARENTS)


def entries(rows: DataFrame, groups: Sequence[str], order: str, name: str | None) -> DataFrame:
    """One row (groups, id, parent[, name]) per entry: its row with the highest `order`. Root rows and rows
    without an id are no entries."""
    kept = rows.where(F.col("id").isNotNull() & ~is_root_entry(F.col("id")))
    keys = [F.coalesce(F.col(g).cast("string"), F.lit(_NULL)).alias(g) for g in groups]
    carried = [F.col("parent")] + ([F.col(name).alias("name")] if name else [])
    picked = kept.select(*keys, "id", F.struct(F.col(order).alias("_o"), *carried).alias("_row"))
    grouped = picked.groupBy(*groups, "id").agg(F.max("_row").alias("_row"))
    return grouped.select(*groups, "id", "_row.parent", *(["_row.name"] if name else []))


class _Climb:
    """The joins of one run. Columns: groups, id, up (where the entry hangs from or has climbed to), dist (steps
    climbed), low (smallest id on the way), with names trail (names on the way), with ancestors chain (ids on the way, from
    the highest down to the entry's own)."""

    def __init__(self, spark: SparkSession, groups: Sequence[str], named: bool, chained: bool):
        self.scratch = Scratch(spark, "hierarchy")
        self.groups = list(groups)
        self.named, self.chained = named, chained

    def keyed(self, df: DataFrame, key: str, prefix: str, cols: Sequence[str]) -> DataFrame:
        """groups + `key` renamed for a join on it, other columns with a prefix."""
        return df.select(*self.groups, F.col(key).alias("up"), *[F.col(c).alias(prefix + c) for c in cols])

    def start(self, nodes: DataFrame) -> DataFrame:
        extra = ([F.col("name").alias("trail")] if self.named else []) + ([F.array("id").alias("chain")] if self.chained else [])
        return nodes.select(
            *self.groups, "id", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("dist"),
            F.col("id").alias("low"), *extra,
        )

    def doubled(self, state: DataFrame, until: str) -> tuple[DataFrame, DataFrame]:
        """Climb with doubling steps. until='left': to the first node outside `state`, or forever in circles;
        returns (those that left, those that can't). until='circle': returns (state on circles, state) once every
        `up` is on a circle and `low` covers the whole circle."""
        extended = (["trail"] if self.named else []) + (["chain"] if self.chained else []) if until == "left" else []
        cols = ["up", "dist", "low", *extended]
        first, previous, steps = state, -1, 1
        while True:
            above = self.keyed(state, "id", "a_", cols)
            both = state.join(above, [*self.groups, "up"], "left")
            moved = F.col("a_up").isNotNull()
            longer = {"trail": F.concat("a_trail", F.lit(SEPARATOR), "trail"), "chain": F.concat("a_chain", "chain")}
            extra = [F.when(moved, longer[c]).otherwise(F.col(c)).alias(c) for c in extended]
            after = both.select(
                *self.groups, "id", F.coalesce("a_up", "up").alias("up"),
                (F.col("dist") + F.coalesce("a_dist", F.lit(0).cast("bigint"))).alias("dist"),
                F.least("low", F.coalesce("a_low", "low")).alias("low"), *extra, moved.alias("moved"),
            )
            after = self.scratch.cut(after, f"doubled{steps}")
            steps *= 2
            if until == "left":
                active = after.where("moved").count()
                if active in (0, previous):
                    return after.where("not moved"), after.where("moved")
                previous = active
            else:
                circle = after.select(*self.groups, F.col("up").alias("id")).distinct().count()
                if circle == previous and steps >= circle:
                    on = self.scratch.cut(
                        after.select(*self.groups, "up").distinct().withColumnRenamed("up", "id")
                        .join(after, [*self.groups, "id"]).select(*self.groups, "id", "low"), "circle",
                    )
                    if self.chained:
                        on = self.around(on.join(first.select(*self.groups, "id", "up"), [*self.groups, "id"]))
                    return on, after
                previous = circle
            state = after.drop("moved")


    def around(self, on: DataFrame) -> DataFrame:
        """Entries on circles (groups, id, up, low) with chain: the entries above each on its circle, ending with its own id."""
        state = self.scratch.cut(on.withColumn("chain", F.array("id")).withColumn("full", F.lit(False)), "around")
        while not state.where("not full").isEmpty():
            both = state.join(self.keyed(state, "id", "a_", ["up", "chain"]), [*self.groups, "up"])
            longer = F.when(F.col("full"), F.col("chain")).otherwise(F.concat("a_chain", "chain"))
            both = both.withColumn("longer", longer)
            # all after the last place of the own id but the end
            earlier = F.expr("size(longer) - 1 - array_position(reverse(slice(longer, 1, size(longer) - 1)), id)")
            again = F.expr("array_contains(slice(longer, 1, size(longer) - 1), id)")
            state = self.scratch.cut(both.select(
                *self.groups, "id", F.when(F.col("full"), F.col("up")).otherwise(F.col("a_up")).alias("up"), "low",
                F.when(again, F.slice("longer", earlier + 2, F.size("longer"))).otherwise(F.col("longer")).alias("chain"),
                (F.col("full") | again).alias("full"),
            ), "around")
        return state.select(*self.groups, "id", "low", "chain")


def resolve_hierarchy(
    rows: DataFrame,
    groups: Sequence[str],
    order: str,
    name: str | None = None,
    frontier_levels: int = FRONTIER_LEVELS,
    only_unrooted: bool = False,
    ancestors: bool = False,
) -> DataFrame:
    """For each entry: status ('ok', 'orphan' or 'loop'), top (id), depth, with `name` also full_path, and with
    `ancestors` also those (ids from the top down to the parent). rows need the columns id, parent, groups, order[, name].

    status 'ok': top is the ancestor right below the root, depth the steps to it. 'orphan': going up ends at an
    entry whose parent doesn't exist; top is that entry. 'loop': going up ends in a circle; top is the smallest id
    on it, depth the steps to the first entry on it; full_path is null; its ancestors are the entries on the way to the circle and all
    others on it, each once. There is no limit of depth.
    only_unrooted returns just 'orphan' and 'loop' entries, without reading anything but links.

    Defined cases: of repeated rows of an entry the one with the highest order counts (ties: the greater parent);
    a null parent is a parent that doesn't exist; null groups form one group; rows with null id are ignored; a null
    name counts as empty. Columns with other names aren't read.
    """
    spark = rows.sparkSession
    named = name is not None
    climb = _Climb(spark, groups, named, ancestors)
    scratch, g = climb.scratch, climb.groups
    if named:
        rows = rows.withColumn("_name", F.coalesce(F.col(name), F.lit("")))
    nodes = scratch.cut(entries(rows, groups, order, "_name" if named else None), "entries")
    rooted = is_root_parent(F.col("parent"))
    parents = nodes.where(F.col("parent").isNotNull() & ~rooted).select(*g, F.col("parent").alias("id")).distinct()
    inner = scratch.cut(parents.join(nodes.withColumn("known", F.lit(True)), [*g, "id"], "left"), "parents")
    missing = inner.where("known is null").select(*g, "id")
    known = inner.where("known").drop("known")

    # Level 0: entries right below a root, and entries whose parent doesn't exist.
    cut_off = F.col("parent").isNull() | F.col("_gone")
    gone = missing.select(*g, F.col("id").alias("parent"), F.lit(True).alias("_gone"))
    status = F.when(is_root_parent(F.col("parent")), "ok").when(cut_off, "orphan")
    nothing = F.array().cast("array<bigint>").alias("chain")
    path_col, chain_col = ["path"] if named else [], ["chain"] if ancestors else []
    extra = ([F.col("name").alias("path")] if named else []) + ([nothing] if ancestors else [])
    level = scratch.cut(
        known.join(gone, [*g, "parent"], "left").select(
            *g, "id", "parent", status.alias("status"), F.when(status.isNotNull(), F.col("id")).alias("top"),
            F.when(status.isNotNull(), F.lit(0).cast("bigint")).alias("depth"),
            *extra, *(["name"] if named else []),
        ), "level0",
    )
    state_cols = [*g, "id", "status", "top", "depth", *path_col, *chain_col]
    link_cols = [*g, "id", "parent"] + (["name"] if named else [])
    reached = [level.where("status is not null").select(*state_cols)]
    unreached = level.where("status is null").select(*link_cols)
    for depth in range(1, frontier_levels + 1):
        above = reached[-1].select(*g, F.col("id").alias("parent"), *[F.col(c) for c in state_cols[len(g) + 1:]])
        extra = [F.concat("path", F.lit(SEPARATOR), "name").alias("path"), "name"] if named else []
        extra += [F.concat("chain", F.array("parent")).alias("chain")] if ancestors else []
        level = scratch.cut(
            unreached.join(above, [*g, "parent"], "left").select(
                *g, "id", "parent", "status", "top", (F.col("depth") + 1).alias("depth"), *extra
            ), f"level{depth}",
        )
        reached.append(level.where("status is not null").select(*state_cols))
        unreached = level.where("status is null").select(*link_cols)
        if unreached.isEmpty():
            break
    circles = None
    if not unreached.isEmpty():
        left, stuck = climb.doubled(climb.start(unreached), "left")
        top = reached[-1].select(
            *g, F.col("id").alias("up"), "status", "top", F.col("depth").alias("top_depth"),
            *[F.col(c).alias("top_" + c) for c in [*path_col, *chain_col]],
        )
        extra = [F.concat("top_path", F.lit(SEPARATOR), "trail").alias("path")] if named else []
        above_own = F.slice("chain", F.lit(1), F.size("chain") - 1)  # the node's own id ends its chain
        extra += [F.concat("top_chain", F.array("up"), above_own).alias("chain")] if ancestors else []
        reached.append(left.join(top, [*g, "up"]).select(
            *g, "id", "status", "top", (F.col("dist") + F.col("top_depth")).alias("depth"), *extra
        ))
        if not stuck.isEmpty():
            looped = scratch.cut(stuck.select(*g, "id").join(unreached, [*g, "id"]), "looped")
            on, _ = climb.doubled(climb.start(looped), "circle")
            circles = on
            no_path = [F.lit(None).cast("string").alias("path")] if named else []
            loop_cols = [F.lit("loop").alias("status"), F.col("low").alias("top")]
            reached.append(on.select(*g, "id", *loop_cols, F.lit(0).cast("bigint").alias("depth"), *no_path, *([above_own.alias("chain")] if ancestors else [])))
            hanging = looped.join(on, [*g, "id"], "left_anti")
            if not hanging.isEmpty():
                tails, _ = climb.doubled(climb.start(hanging), "left")
                circle = on.select(*g, F.col("id").alias("up"), "low", *([F.col("chain").alias("circle")] if ancestors else []))
                reached.append(
                    tails.drop("low").join(circle, [*g, "up"]).select(
                        *g, "id", *loop_cols, F.col("dist").alias("depth"), *no_path,
                        *([F.concat("circle", above_own).alias("chain")] if ancestors else []),
                    )
                )
    state = reached[0]
    for part in reached[1:]:
        state = state.unionByName(part)
    if only_unrooted:
        state = state.where("status <> 'ok'")

    # All entries from their parent's result; entries on circles are their own result.
    above = state.select(*g, F.col("id").alias("parent"), *[F.col(c).alias("p_" + c) for c in state_cols[len(g) + 1:]])
    absent = missing.select(*g, F.col("id").alias("parent"), F.lit("missing").alias("p_status"))
    above = above.unionByName(absent, allowMissingColumns=True)
    joined = nodes.where(F.col("parent").isNotNull() & ~rooted).join(above, [*g, "parent"])
    loops = F.col("p_status") == "loop"
    is_top = F.col("p_status") == "missing"
    extra = [F.when(is_top, F.col("name")).when(~loops, F.concat("p_path", F.lit(SEPARATOR), "name")).alias("path")] if named else []
    extra += [F.when(is_top, nothing).otherwise(F.concat("p_chain", F.array("parent"))).alias("chain")] if ancestors else []
    result = joined.select(
        *g, "id", F.when(is_top, "orphan").otherwise(F.col("p_status")).alias("status"),
        F.when(is_top, F.col("id")).otherwise(F.col("p_top")).alias("top"),
        F.when(is_top, F.lit(0).cast("bigint")).otherwise(F.col("p_depth") + 1).alias("depth"), *extra,
    )
    if circles is not None:
        result = result.join(circles.select(*g, "id"), [*g, "id"], "left_anti")
        own = state.join(circles.select(*g, "id"), [*g, "id"], "left_semi")
        result = result.unionByName(own.select(*result.columns))
    tops = nodes.where(F.col("parent").isNull() | rooted) if not only_unrooted else nodes.where(F.col("parent").isNull())
    extra = ([F.col("name").alias("path")] if named else []) + ([nothing] if ancestors else [])
    result = result.unionByName(tops.select(
        *g, "id", F.when(F.col("parent").isNull(), "orphan").otherwise("ok").alias("status"), F.col("id").alias("top"),
        F.lit(0).cast("bigint").alias("depth"), *extra,
    ))
    restored = [F.when(F.col(c) != _NULL, F.col(c)).alias(c) for c in g]
    extra = ([F.col("path").alias("full_path")] if named else []) + ([F.col("chain").alias("ancestors")] if ancestors else [])
    return result.select(*restored, "id", "status", "top", "depth", *extra)


def descendants(resolved: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(groups, ancestor, id, distance): every entry below every entry above it, from resolve_hierarchy's
    ancestors; entries on a circle are below each other. As many rows as the depths add up to."""
    steps = F.posexplode("ancestors").alias("_at", "ancestor")
    return resolved.select(*groups, "id", F.size("ancestors").alias("_n"), steps).select(
        *groups, "ancestor", "id", (F.col("_n") - F.col("_at")).cast("bigint").alias("distance")
    )
