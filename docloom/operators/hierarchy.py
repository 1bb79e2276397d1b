"""Trees of unknown depth from parent-child rows.

Method: subtree sizes are summed upward, preorder ranges are allotted to
siblings downward by prefix sums, and the nested ranges then answer every
question about ancestors and descendants. Nodes that the upward pass never
finishes have parents without end: they stand on a cycle or below one.

Both passes double their stride (a node adds itself to its parent, then to the
node two up, then four up, ...), so a tree of depth d takes log2(d) rounds, not
d, and every round is one equality join over narrow rows. Each round is written
to the shared folder, so no round is ever computed twice or lost.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.plans.ranges import points_in_ranges
from docloom.plans.ranks import prefix_sums
from docloom.plans.shared import Scratch

NODE_COLUMNS = ["group_id", "node_id", "name", "parent_id", "root_id", "depth", "range_start", "range_end"]


def name_key(name: Column) -> Column:
    """The form in which names are compared: no case, outer white space, backticks or backslashes.

    Null stays null; a name of which nothing is left gives null.
    """
    bare = F.regexp_replace(name, r"[`\\]", "")
    trimmed = F.regexp_replace(bare, r"(?U)^[\s\u200b\ufeff]+|[\s\u200b\ufeff]+$", "")
    return F.nullif(F.lower(trimmed), F.lit(""))


def latest_nodes(
    rows: DataFrame, group: str, node: str, name: str, parent: str, version: str
) -> DataFrame:
    """One row (group_id, node_id, name, key, parent_key) for each name of a group.

    Of several rows of a name the one with the greatest version, then the
    greatest id counts; a null version is the smallest. Rows without a name or
    id form no node. Repeated rows count once.
    """
    picked = rows.select(
        F.col(group).alias("group_id"),
        name_key(F.col(name)).alias("key"),
        F.struct(
            F.col(version).alias("v"),
            F.col(node).cast("bigint").alias("node_id"),
            F.trim(F.regexp_replace(F.col(name), r"[`\\]", "")).alias("name"),
            name_key(F.col(parent)).alias("parent_key"),
        ).alias("row"),
    ).where(F.col("key").isNotNull() & F.col("row.node_id").isNotNull())
    best = picked.groupBy("group_id", "key").agg(F.max("row").alias("row"))
    return best.select("group_id", "key", "row.node_id", "row.name", "row.parent_key")


def link_parents(nodes: DataFrame) -> DataFrame:
    """Replace parent names by ids: (group_id, node_id, name, parent_id), null for roots.

    A parent that is null, blank or not in the group makes the node a root.
    """
    parents = nodes.select(
        F.col("group_id").alias("pg"), F.col("key").alias("pk"), F.col("node_id").alias("parent_id")
    )
    roots = nodes.where("parent_key is null").select(
        "group_id", "node_id", "name", F.lit(None).cast("bigint").alias("parent_id")
    )
    linked = nodes.where("parent_key is not null").join(
        parents, F.col("group_id").eqNullSafe(F.col("pg")) & (F.col("parent_key") == F.col("pk")), "left"
    )
    return roots.unionByName(linked.select("group_id", "node_id", "name", "parent_id"))


def _sizes_upward(linked: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(node_id, size) of all finished nodes, and the nodes whose links do not end (node_id, ptr)."""
    active = scratch.write(
        linked.where("parent_id is not null").select("node_id", F.col("parent_id").alias("ptr"), F.lit(1).cast("bigint").alias("size")),
        "up0",
    )
    left, rounds = active.count(), []
    while left:
        rounds.append(active.select(F.col("ptr").alias("node_id"), "size"))
        hops = active.select(F.col("node_id").alias("h"), F.col("ptr").alias("next"))
        gains = active.groupBy(F.col("ptr").alias("g")).agg(F.sum("size").alias("gain"))
        # Only nodes whose target has itself a target go on: an inner join.
        step = active.join(hops, F.col("ptr") == F.col("h")).join(gains, F.col("node_id") == F.col("g"), "left")
        active = scratch.write(
            step.select("node_id", F.col("next").alias("ptr"), (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size")),
            f"up{len(rounds)}",
        )
        now = active.count()
        if now == left:
            break
        left = now
    ones = linked.select("node_id", F.lit(1).cast("bigint").alias("size"))
    every = reduce(DataFrame.unionByName, rounds, ones)
    sizes = every.groupBy("node_id").agg(F.sum("size").alias("size"))
    endless = active.select("node_id", "ptr")
    return sizes.join(endless.select("node_id"), "node_id", "left_anti"), endless


def _on_cycles(endless: DataFrame, scratch: Scratch) -> DataFrame:
    """(node_id) of nodes on a cycle, among nodes whose parents never end.

    The targets of a stride shrink to the cycles' nodes: when doubling the
    stride leaves their number as it was, all of them stand on cycles.
    """
    hops = scratch.write(endless, "cycle0")
    targets = hops.select(F.col("ptr").alias("node_id")).distinct()
    count, round_ = targets.count(), 0
    while count:
        round_ += 1
        step = hops.join(hops.select(F.col("node_id").alias("h"), F.col("ptr").alias("next")), F.col("ptr") == F.col("h"))
        hops = scratch.write(step.select("node_id", F.col("next").alias("ptr")), f"cycle{round_}")
        targets = hops.select(F.col("ptr").alias("node_id")).distinct()
        now = targets.count()
        if now == count:
            break
        count = now
    return targets


def _ranges_downward(trees: DataFrame, scratch: Scratch, with_path: bool, bits: int) -> DataFrame:
    """Add root_id, depth, range_start, range_end (and path) to finished nodes (.., parent_id, size).

    A round moves and writes only the nodes that have not reached their root;
    those that have stay in the tables of the round in which they did.
    """
    offsets = prefix_sums(trees, ["group_id", "parent_id"], "node_id", F.col("size"), "__offset", bits)
    root = F.col("parent_id").isNull()
    state = offsets.select(
        "group_id",
        "node_id",
        "name",
        "parent_id",
        "size",
        F.col("parent_id").alias("ptr"),
        F.coalesce("parent_id", "node_id").alias("root_id"),
        F.when(root, 0).otherwise(1).alias("depth"),
        # A child's range starts one behind its parent's own place.
        (F.col("__offset") + F.when(root, 0).otherwise(1)).alias("range_start"),
        *([F.array("name").alias("path")] if with_path else []),
    )
    done, moving, round_ = [], scratch.write(state, "down0"), 0
    while True:
        done.append(moving.where("ptr is null"))
        moving = moving.where("ptr is not null")
        if moving.isEmpty():
            break
        round_ += 1
        above = reduce(DataFrame.unionByName, done, moving).select(
            F.col("node_id").alias("a_id"),
            F.col("ptr").alias("a_ptr"),
            F.col("root_id").alias("a_root"),
            F.col("depth").alias("a_depth"),
            F.col("range_start").alias("a_start"),
            *([F.col("path").alias("a_path")] if with_path else []),
        )
        changes = {
            "root_id": F.col("a_root"),
            "depth": F.col("depth") + F.col("a_depth"),
            "range_start": F.col("range_start") + F.col("a_start"),
            "ptr": F.col("a_ptr"),
        }
        if with_path:
            changes["path"] = F.concat("a_path", "path")
        moved = moving.join(above, F.col("ptr") == F.col("a_id")).withColumns(changes).select(*state.columns)
        moving = scratch.write(moved, f"down{round_}")
    return reduce(DataFrame.unionByName, done).withColumn("range_end", F.col("range_start") + F.col("size"))


def build_hierarchy(
    rows: DataFrame,
    group: str = "catalog_id",
    node: str = "topic_id",
    name: str = "qualified_name",
    parent: str = "parent_qualified_name",
    version: str = "updated_at",
    with_path: bool = False,
) -> DataFrame:
    """All nodes of all trees: ``NODE_COLUMNS`` (and ``path``, the names from the root down).

    ``range_start`` is the node's place in preorder within its group, and the
    half-open range to ``range_end`` holds exactly its subtree, so the subtree
    has ``range_end - range_start`` nodes. Siblings stand in the order of ids.

    A root has depth 0 and is its own root. A node on a cycle has root -1 and
    depth -1; one whose parents lead into a cycle has root -1 and depth -2;
    both have null ranges and paths. Which row of a name counts, and what nulls,
    blanks, repeated rows and unknown parents mean, is said at ``latest_nodes``
    and ``link_parents``. Other columns of ``rows`` are not read. An empty table
    gives an empty result.
    """
    scratch = Scratch(rows.sparkSession, "hierarchy")
    linked = scratch.write(link_parents(latest_nodes(rows, group, node, name, parent, version)), "linked")
    top = linked.agg(F.max("node_id").alias("m"), F.min("node_id").alias("n")).first()
    bits = 63 if top["m"] is None or top["n"] < 0 else max(1, int(top["m"]).bit_length())
    sizes, endless = _sizes_upward(linked, scratch)
    state = _ranges_downward(linked.join(sizes, "node_id"), scratch, with_path, bits)
    cycle = _on_cycles(endless, scratch).select(F.col("node_id").alias("c"))
    lost = linked.join(endless.select("node_id"), "node_id", "left_semi").join(cycle, F.col("node_id") == F.col("c"), "left")
    lost = lost.select(
        "group_id",
        "node_id",
        "name",
        "parent_id",
        F.lit(-1).cast("bigint").alias("root_id"),
        F.when(F.col("c").isNotNull(), -1).otherwise(-2).alias("depth"),
        F.lit(None).cast("bigint").alias("range_start"),
        F.lit(None).cast("bigint").alias("range_end"),
        *([F.lit(None).cast("array<string>").alias("path")] if with_path else []),
    )
    keep = NODE_COLUMNS + (["path"] if with_path else [])
    return scratch.result(state.select(*keep).unionByName(lost.select(*keep)))


def _bits(nodes: DataFrame) -> int:
    top = nodes.agg(F.max("range_end").alias("m")).first()["m"]
    return max(1, int(top or 1).bit_length())


def descendants(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(node_id, descendant_id, distance) for the nodes named in ``queries`` (node_id).

    Answered from the nested ranges alone; a node is not its own descendant.
    Nodes on or below a cycle have no descendants here.
    """
    finished = nodes.where("range_start is not null")
    asked = finished.join(queries.select("node_id").distinct(), "node_id", "left_semi").select(
        F.col("group_id"),
        F.col("node_id").alias("of_id"),
        F.col("depth").alias("of_depth"),
        (F.col("range_start") + 1).alias("from_place"),
        F.col("range_end").alias("to_place"),
    )
    points = finished.select("group_id", "node_id", "depth", "range_start")
    pairs = points_in_ranges(points, asked, "group_id", "range_start", "from_place", "to_place", _bits(finished))
    return pairs.select(
        F.col("of_id").alias("node_id"),
        F.col("node_id").alias("descendant_id"),
        (F.col("depth") - F.col("of_depth")).alias("distance"),
    )


def ancestors(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(node_id, ancestor_id, distance) for the nodes named in ``queries`` (node_id)."""
    finished = nodes.where("range_start is not null")
    asked = finished.join(queries.select("node_id").distinct(), "node_id", "left_semi").select(
        "group_id", "node_id", "depth", "range_start"
    )
    spans = finished.where("range_end - range_start > 1").select(
        F.col("group_id"),
        F.col("node_id").alias("ancestor_id"),
        F.col("depth").alias("a_depth"),
        (F.col("range_start") + 1).alias("from_place"),
        F.col("range_end").alias("to_place"),
    )
    pairs = points_in_ranges(asked, spans, "group_id", "range_start", "from_place", "to_place", _bits(finished))
    return pairs.select("node_id", "ancestor_id", (F.col("depth") - F.col("a_depth")).alias("distance"))
