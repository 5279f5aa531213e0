"""Parent-child links to full hierarchies.

A row has at most one parent, so the links are a forest, some of whose trees end in a circle instead of a root.

1. *Connected components* by pointer jumping: every row's pointer doubles its reach each round, so a chain of
   depth d takes log2(d) joins; the label is the root, or the smallest id of the circle.
2. Components of up to ``max_component`` rows are *co-located* (one shuffle by label, streamed in label order) and
   walked by an *iterative depth-first traversal with node colouring*: white rows are unseen, grey ones on the stack,
   black ones done; an edge into a grey row is a back edge and closes a circle.
3. A component above that bound, which may hold a third of all rows, never reaches one task: the same columns come
   from doubling pointers that carry their path. Both ways give the same rows; the tests hold one against the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.keys import norm_id
from lodestone.session import cut_lineage

MAX_COMPONENT = 100_000
#: Circle rows up to which they are broadcast to the rows on and below circles.
MAX_CIRCLE_BROADCAST = 200_000
SCHEMA = (
    "node_id string, parent_id string, component_id string, root_id string, depth int, path string, "
    "path_ids array<string>, n_descendants bigint, cycle_id string, status string"
)


def clean_links(df: DataFrame, node: str, parent: str, name: str) -> DataFrame:
    """(node_id, parent_id, name): ids normalised, one row an id, a parent without a row of its own counts as none."""
    rows = (
        df.select(norm_id(node).alias("node_id"), norm_id(parent).alias("parent_id"), F.trim(F.col(name)).alias("name"))
        .where("node_id is not null")
        .groupBy("node_id")
        .agg(F.min(F.struct("parent_id", "name")).alias("r"))
        .select("node_id", "r.parent_id", "r.name")
    )
    known = rows.select(F.col("node_id").alias("parent_id"), F.lit(True).alias("known"))
    return rows.join(known, "parent_id", "left").select(
        "node_id",
        F.when(F.col("known"), F.col("parent_id")).alias("parent_id"),
        "name",
        (F.col("parent_id").isNotNull() & F.col("known").isNull()).alias("dangling"),
    )


def components(links: DataFrame) -> DataFrame:
    """(node_id, parent_id, name, dangling, label, on_cycle) by pointer jumping.

    up: the row 2^k links above, or the root once reached; low: the smallest id on that way.
    Once no row is on its way to a root, the rows left lead into circles. The set of rows that 2^k links reach shrinks
    to the circles; when it and the smallest ids stay, every circle row has seen its whole circle.
    """
    state = cut_lineage(
        links.select(
            "*",
            F.coalesce("parent_id", "node_id").alias("up"),
            F.least("node_id", F.coalesce("parent_id", "node_id")).alias("low"),
            F.col("parent_id").isNull().alias("done"),
            F.lit(False).alias("moved"),
        )
    )
    reached = None
    while True:
        now = state.where("not done").agg(F.count("*").alias("n"), F.countDistinct("up").alias("reached"), F.max("moved").alias("moved")).first()
        if not now["n"] or (reached == now["reached"] and not now["moved"]):
            break
        reached = now["reached"]
        at = state.select(F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("low").alias("low2"), F.col("done").alias("done2"))
        jumped = state.where("not done").join(at, "up").select(
            "node_id", "parent_id", "name", "dangling", F.col("up2").alias("up"), F.least("low", "low2").alias("low"), F.col("done2").alias("done"),
            (F.col("low2") < F.col("low")).alias("moved"),
        )
        state = cut_lineage(state.where("done").unionByName(jumped))
    circle = state.where("not done").select(F.col("up").alias("circle_id")).distinct()
    cycles = state.join(circle, F.col("node_id") == F.col("circle_id")).select("circle_id", F.col("low").alias("cycle"))
    on = cycles.select(F.col("circle_id").alias("node_id"), F.lit(True).alias("on_cycle"))
    return (
        state.join(cycles.withColumnRenamed("circle_id", "up"), "up", "left")
        .join(on, "node_id", "left")
        .select(
            "node_id", "parent_id", "name", "dangling",
            F.when(F.col("done"), F.col("up")).otherwise(F.col("cycle")).alias("label"),
            F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"),
            F.col("done").alias("rooted"),
        )
    )


def _coloured(rows: list[tuple[str, str | None]], label: str) -> tuple[dict[str, list[str]], dict[str, int], set[str]]:
    """(children, rows below each row, rows on the circle) of one component: depth first, without recursion."""
    children: dict[str, list[str]] = {}
    for n, p in rows:
        if p is not None:
            children.setdefault(p, []).append(n)
    for c in children.values():
        c.sort()
    white, grey, black = 0, 1, 2
    colour = dict.fromkeys((n for n, _ in rows), white)
    circle: set[str] = set()
    below: dict[str, int] = {}
    way: list[str] = []
    stack: list[tuple[str, int]] = [(label, 0)]
    while stack:
        n, k = stack.pop()
        if not k:
            colour[n] = grey
            way.append(n)
            below[n] = 0
        kids = children.get(n, ())
        if k < len(kids):
            stack.append((n, k + 1))
            c = kids[k]
            if colour[c] == white:
                stack.append((c, 0))
            elif colour[c] == grey:  # the back edge n -> c
                circle.update(way[way.index(c) :])
        else:
            colour[n] = black
            way.pop()
            if way:
                below[way[-1]] += below[n] + 1
    return children, below, circle


def walk(rows: list[tuple[str, str | None, str | None, bool]], label: str, sep: str) -> Iterator[tuple]:
    """One component's rows of SCHEMA. rows: (node_id, parent_id, name, dangling).

    The first pass colours and counts, the second gives out each row as it is met, so what is held is one way down and
    the component's links, never all paths.
    """
    children, below, circle = _coloured([r[:2] for r in rows], label)
    if circle:
        cycle = min(circle)
        for n, p, _, _ in rows:
            on = n in circle
            yield n, p, label, None, None, None, None, len(rows) - 1 if on else below[n], cycle if on else None, "cycle" if on else "into_cycle"
        return
    kept = {n: (p, x or "", d) for n, p, x, d in rows}
    ids: list[str] = []
    names: list[str] = []
    stack: list[tuple[str, int]] = [(label, 0)]
    while stack:
        n, depth = stack.pop()
        del ids[depth:], names[depth:]
        parent, name, dangling = kept[n]
        ids.append(n)
        names.append(name)
        yield n, parent, label, label, depth, sep.join(names), ids.copy(), below[n], None, "dangling" if dangling else "rooted"
        stack.extend((c, depth + 1) for c in reversed(children.get(n, ())))


#: Path entries up to which rows of a walk are gathered before they leave the task.
HELD_ENTRIES = 200_000


def _components(batches: Iterator[pd.DataFrame], cols: tuple[str, ...]) -> Iterator[tuple[str, list[tuple]]]:
    """(label, rows) of each component, from rows that come component by component."""
    at, rows = None, []
    for b in batches:
        for label, *row in zip(b["label"], *(b[c] for c in cols)):
            if label != at and rows:
                yield at, rows
                rows = []
            at = label
            rows.append(tuple(row))
    if rows:
        yield at, rows


def _walks(sep: str):
    """The mapInPandas function over rows that come component by component."""
    cols = [c.split()[0] for c in SCHEMA.replace("array<string>", "a").split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, held = [], 0
        for label, rows in _components(batches, ("node_id", "parent_id", "name", "dangling")):
            for r in walk(rows, label, sep):
                out.append(r)
                held += 4 + len(r[6] or ())
                if held > HELD_ENTRIES:
                    yield pd.DataFrame(out, columns=cols)
                    out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=cols)

    return run


def _circles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for label, rows in _components(batches, ("node_id", "parent_id")):
        circle = sorted(_coloured(rows, label)[2])
        yield pd.DataFrame({"node_id": circle, "cycle_id": circle[0]})


def cycles(df: DataFrame, node: str, parent: str, max_component: int = MAX_COMPONENT) -> DataFrame:
    """(node_id, cycle_id): the rows on circles, as in hierarchy(), whose rules hold, without any path.

    Only components that end in a circle are walked; the pointers' jumps tell them apart. Of one above max_component the
    jumps also tell its circle.
    """
    looped = cut_lineage(components(clean_links(df, node, parent, node)).where("not rooted").select("node_id", "parent_id", "label", "on_cycle"))
    large = cut_lineage(looped.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > max_component).select("label"))
    far = None
    if large.limit(1).count():
        looped, far = looped.join(large, "label", "left_anti"), looped.join(large, "label", "left_semi")
    out = looped.select("label", "node_id", "parent_id").repartition("label").sortWithinPartitions("label").mapInPandas(_circles, "node_id string, cycle_id string")
    return out if far is None else out.unionByName(far.where("on_cycle").select("node_id", F.col("label").alias("cycle_id")))


def _doubled(part: DataFrame, sep: str) -> DataFrame:
    """The same columns for components of any size: pointers double together with the way they skip.

    Circle rows are cut loose first, so what leads into a circle is a tree below one of its rows.
    """
    cut = part.withColumn("above", F.when(~F.col("on_cycle"), F.col("parent_id")))
    state = cut_lineage(cut.select("*", F.col("above").alias("up"), F.array("node_id").alias("ids"), F.array(F.coalesce("name", F.lit(""))).alias("names")))
    while state.where("up is not null").limit(1).count():
        at = state.select(F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("ids").alias("ids2"), F.col("names").alias("names2"))
        jumped = state.where("up is not null").join(at, "up").select(
            *cut.columns, F.col("up2").alias("up"), F.concat("ids2", "ids").alias("ids"), F.concat("names2", "names").alias("names")
        )
        state = cut_lineage(state.where("up is null").unionByName(jumped))
    below = state.select(F.explode(F.slice("ids", 1, F.size("ids") - 1)).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("below"))
    size = part.groupBy("label").agg(F.count("*").alias("size"))
    return (
        state.join(below, "node_id", "left")
        .join(size, "label")
        .select(
            "node_id", "parent_id", F.col("label").alias("component_id"),
            F.when(F.col("rooted"), F.col("label")).alias("root_id"),
            F.when(F.col("rooted"), F.size("ids") - 1).alias("depth"),
            F.when(F.col("rooted"), F.array_join("names", sep)).alias("path"),
            F.when(F.col("rooted"), F.col("ids")).alias("path_ids"),
            F.when(F.col("on_cycle"), F.col("size") - 1).otherwise(F.coalesce("below", F.lit(0))).cast("bigint").alias("n_descendants"),
            F.when(F.col("on_cycle"), F.col("label")).alias("cycle_id"),
            F.when(F.col("rooted"), F.when(F.col("dangling"), "dangling").otherwise("rooted")).when(F.col("on_cycle"), "cycle").otherwise("into_cycle").alias("status"),
        )
    )


def hierarchy(df: DataFrame, node: str, parent: str, name: str, sep: str = ".", max_component: int = MAX_COMPONENT) -> DataFrame:
    """One row per distinct id of df with its place in the forest; see SCHEMA.

    path, path_ids: from the root down to the row, null on and below circles, which have no root; depth 0 is a root.
    n_descendants: rows below; on a circle all other rows of the component. descendants() lists them.
    cycle_id: the smallest id of the circle that the row is on, null off circles.
    status: rooted, dangling (its parent has no row; it counts as a root; rows below it are rooted), cycle, into_cycle.

    Null or blank ids are no rows; null or blank parents mean a root. Repeated rows count once; where they differ, the
    smallest (parent, name) holds. A null name stands as an empty part of the path. An empty table gives no rows. Other
    columns of df are not looked at, whatever their names.
    """
    found = cut_lineage(components(clean_links(df, node, parent, name)))
    sizes = found.groupBy("label").agg(F.count("*").alias("rows_in"))
    large = cut_lineage(sizes.where(F.col("rows_in") > max_component).select("label"))
    if large.limit(1).count():
        near, far = found.join(large, "label", "left_anti"), found.join(large, "label", "left_semi")
    else:
        near, far = found, None
    out = (
        near.select("label", "node_id", "parent_id", "name", "dangling")
        .repartition("label")
        .sortWithinPartitions("label")
        .mapInPandas(_walks(sep), SCHEMA)
    )
    return out if far is None else out.unionByName(_doubled(far, sep))


def descendants(placed: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, distance): every row of hierarchy() under each row above it, circles left out; see all_descendants()."""
    return placed.select(F.posexplode(F.slice("path_ids", 1, F.size("path_ids") - 1)).alias("k", "ancestor_id"), F.col("node_id").alias("descendant_id"), "depth").select(
        "ancestor_id", "descendant_id", (F.col("depth") - F.col("k")).cast("int").alias("distance")
    )


def all_descendants(placed: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, distance): descendants() and the pairs of rows on and below circles.

    The rows of a circle are each other's descendants and have every row below the circle as one; distance is the
    smallest number of links. No row is its own descendant. Each row stands n_descendants times as an ancestor.

    The link above the circle's smallest id is cut, which leaves a tree; the circle's rows that are not on the way down
    from there are met through the cut link.
    """
    looped = placed.where("root_id is null").select("node_id", F.when(F.col("cycle_id").isNull() | (F.col("cycle_id") != F.col("node_id")), F.col("parent_id")).alias("up"), "component_id", "cycle_id")
    state = cut_lineage(
        looped.select("node_id", "up", "component_id", F.array("node_id").alias("ids"), F.col("cycle_id").isNotNull().cast("int").alias("turn"), F.col("cycle_id").isNotNull().alias("on"))
    )
    while state.where("up is not null").limit(1).count():
        at = state.select(F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("ids").alias("ids2"), F.col("turn").alias("turn2"))
        jumped = state.where("up is not null").join(at, "up").select(
            "node_id", F.col("up2").alias("up"), "component_id", F.concat("ids2", "ids").alias("ids"), (F.col("turn") + F.col("turn2")).alias("turn"), "on"
        )
        state = cut_lineage(state.where("up is null").unionByName(jumped))
    # turn: how many circle rows are on the way, which are the first ones of the circle
    ways = state.withColumn("depth", F.size("ids") - 1)
    down = ways.select(F.posexplode(F.slice("ids", 1, F.size("ids") - 1)).alias("k", "ancestor_id"), F.col("node_id").alias("descendant_id"), "depth").select(
        "ancestor_id", "descendant_id", (F.col("depth") - F.col("k")).cast("int").alias("distance")
    )
    ring = ways.where("on").select("component_id", F.col("node_id").alias("ancestor_id"), F.col("depth").alias("place"))
    ring = ring.join(ring.groupBy("component_id").agg(F.count("*").alias("size")), "component_id").where("size > 1")
    if ring.limit(MAX_CIRCLE_BROADCAST + 1).count() <= MAX_CIRCLE_BROADCAST:
        ring = F.broadcast(ring)
    round_ = (
        ways.select("component_id", F.col("node_id").alias("descendant_id"), "turn", "depth")
        .join(ring, "component_id")
        .where(F.col("place") >= F.col("turn"))
        .select("ancestor_id", "descendant_id", (F.col("depth") + F.col("size") - F.col("place")).cast("int").alias("distance"))
    )
    return descendants(placed).unionByName(down).unionByName(round_)
