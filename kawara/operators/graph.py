"""Clusters and graphs: iterative DataFrame algorithms without collecting edges or labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kawara.functions import geometry as g
from kawara.operators import kernels, spatial
from kawara.operators.spatial import _cut


def connected(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, comp): comp is the smallest id connected to id. vertices: id; edges: a, b, in any direction.

    Labels take the minimum of their neighbours', then jump to their label's label, so chains halve every round.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = _cut(both.where("a <> b"))
    labels = _cut(vertices.select("id", F.col("id").alias("comp")).distinct())
    before = None
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        less = labels.join(near.withColumnRenamed("a", "id"), "id", "left")
        less = less.select("id", F.least("comp", F.coalesce("near", "comp")).alias("comp"))
        up = less.select(F.col("id").alias("comp"), F.col("comp").alias("root"))
        labels = _cut(less.join(up, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")))
        # labels only ever fall, so an equal sum is an equal labelling
        mark = labels.agg(F.sum(F.col("comp").cast("decimal(38,0)"))).first()[0]
        if mark == before:
            return labels
        before = mark


def radius_components(points: DataFrame, radius: float) -> DataFrame:
    """Euclidean clusters of points (id, x, y): chains of steps of at most the radius. A point that is nowhere is alone.

    Points in one place are one.
    """
    places = _cut(points.where(spatial.PLACED).groupBy("x", "y").agg(F.min("id").alias("id")))
    found = place_components(places, radius)
    return points.select("id", "x", "y").join(found, ["x", "y"], "left").select("id", F.coalesce("comp", "id").alias("comp")).distinct()


def place_components(places: DataFrame, radius: float) -> DataFrame:
    """(x, y, comp) of places (id, x, y), no two in one place: comp is the smallest id that is chained to a place.

    Clustered as dbscan() does where each place is a core, so that no pairs are made. A few places are one tile, in one
    task, without rounds over tables; they come with a hint to broadcast them, others with one to merge.
    """
    ends = [f(k) for k in "xy" for f in (F.min, F.max)]
    n, *ends = places.agg(F.count("*"), *ends).first()
    # cells are counted in 64 bits, two axes in one number
    few = n <= spatial.MOST and (not n or max(map(abs, ends)) < 1e9 * radius)
    labels = _one_tile(places, radius) if few else dbscan(places, radius, 1)
    found = places.join(labels.hint("merge"), "id").select("x", "y", F.col("cluster").alias("comp"))
    return F.broadcast(found) if n <= spatial.MOST else found.hint("merge")


def _one_tile(places: DataFrame, radius: float) -> DataFrame:
    """(id, cluster) of places as of dbscan(), where all places are cores of one tile."""
    size, halo = TILE * radius, 2.001 * radius
    rows = places.select(F.col("id").cast("long"), F.col("x").cast("double"), F.col("y").cast("double")).where("id IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            block = pa.Table.from_batches(held)
            p = np.column_stack([block.column(k).to_numpy() for k in "xy"])
            at = np.broadcast_to(np.floor(p.min(axis=0) / size), p.shape)
            found = kernels.tiles_clustered(block.column("id").to_numpy(), p, at, size, halo, radius, 1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found[:2]], names=["id", "cluster"])

    return _cut(rows.coalesce(1).mapInArrow(run, "id long, cluster long"))


#: Side of a tile in eps: how many of its points are copied beside it, and how many meet in memory.
TILE = 64
#: Rows that a task clusters at once; a larger tile is one such block.
BLOCK = 200_000
CLUSTERED = "id long, label long, core boolean, own boolean, shared boolean"


def dbscan(points: DataFrame, eps: float, least: int, smallest: int = 1, axes: str = "xy") -> DataFrame:
    """(id, cluster) of points (id and the axes); noise and clusters of fewer than smallest points are left out.

    A point with at least `least` points in eps, itself included, is a core. Cores in reach of each other share a
    cluster, named by its smallest core; a border point takes the smallest cluster in reach.

    Points are shuffled once, by tiles of TILE eps, with copies of those within 2 eps of a tile: what a tile says of its
    own points and of those in reach of them is then whole. Tiles are clustered alone (kernels.tiles_clustered); clusters
    that share a core are joined over cores at the tiles' sides only. A tile meets in one task.
    """
    size, halo = TILE * eps, 2.001 * eps
    rows = points.select(F.col("id").cast("long"), *(F.col(k).cast("double").alias(k) for k in axes))
    rows = rows.where(" AND ".join(f"abs({k}) < double('infinity')" for k in axes))
    for k in axes:
        low, high = spatial.cell(F.col(k) - halo, size), spatial.cell(F.col(k) + halo, size)
        rows = rows.withColumn(f"t{k}", F.explode(F.sequence(low, high)))
    tile = [f"t{k}" for k in axes]
    rows = rows.repartition(*tile).sortWithinPartitions(*tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, tile):
            at = np.column_stack([block.column(t).to_numpy() for t in tile])
            p = np.column_stack([block.column(k).to_numpy() for k in axes])
            found = kernels.tiles_clustered(block.column("id").to_numpy(), p, at, size, halo, eps, least)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["id", "label", "core", "own", "shared"])

    seen = _cut(rows.mapInArrow(run, CLUSTERED))
    links = seen.where("core AND shared").select(F.col("id").alias("a"), F.col("label").alias("b"))
    nodes = links.select(F.col("a").alias("id")).unionByName(seen.select(F.col("label").alias("id")))
    labels = connected(nodes, links).withColumnRenamed("id", "label")
    found = seen.where("own").join(labels, "label").groupBy("id").agg(F.min("comp").alias("cluster"))
    found = _cut(found)
    big = found.groupBy("cluster").count().where(F.col("count") >= smallest).select("cluster")
    return found.join(big, "cluster").select("id", "cluster")


def _blocks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted batches as tables of about BLOCK rows or more, each of whole groups of equal keys."""
    held, n, due = [], 0, BLOCK
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= due:
            rows = pa.Table.from_batches(held)
            columns = [rows.column(k).to_numpy() for k in keys]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0))
            last = int(new[-1]) + 1 if len(new) else 0
            if last:
                yield rows.slice(0, last)
            rows = rows.slice(last)
            # a group that fills a block is looked at again when it has doubled
            held, n, due = rows.to_batches(), rows.num_rows, BLOCK if last else 2 * n
    if n:
        yield pa.Table.from_batches(held)


def gap_clusters(rows: DataFrame, keys: list[str], value: str, gap: float, tie: str) -> DataFrame:
    """rows with cluster, numbered from 0 within keys: a step of more than the gap in sorted order starts a new one."""
    order = Window.partitionBy(*keys).orderBy(value, tie)
    start = F.coalesce((F.col(value) - F.lag(value).over(order) > gap).cast("long"), F.lit(0))
    return rows.withColumn("start", start).withColumn("cluster", F.sum("start").over(order)).drop("start")


def runs(rows: DataFrame, order: Window, value: Column) -> DataFrame:
    """rows with run, numbered from 1: consecutive equal values in order share a run (gaps and islands)."""
    new = F.when(value.eqNullSafe(F.lag(value).over(order)) & F.lag(F.lit(1)).over(order).isNotNull(), 0).otherwise(1)
    return rows.withColumn("new", new).withColumn("run", F.sum("new").over(order)).drop("new")


def pruned_leaves(edges: DataFrame) -> DataFrame:
    """edges (a, b) without those that hang from a node of degree 1, again and again until none is left.

    Only the nodes that a round has touched can be leaves of the next one, so a round costs their edges, not all.
    """
    edges = _cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
    both = _cut(both)
    # degree and the sum of neighbours: the sum is the last neighbour once the degree is 1
    state = _cut(both.groupBy("v").agg(F.count("*").alias("n"), F.sum(F.col("w").cast("decimal(38,0)")).alias("rest")))
    while True:
        leaves = state.where("n = 1").select(F.col("rest").cast("long").alias("v"), F.col("v").alias("leaf"))
        gone = _cut(leaves)
        if not gone.limit(1).count():
            break
        less = gone.groupBy("v").agg(F.count("*").alias("k"), F.sum(F.col("leaf").cast("decimal(38,0)")).alias("lost"))
        kept = state.join(less, "v", "left").withColumn("n", F.col("n") - F.coalesce("k", F.lit(0)))
        kept = kept.withColumn("rest", F.col("rest") - F.coalesce("lost", F.lit(0)))
        kept = kept.join(gone.select(F.col("leaf").alias("v")), "v", "left_anti").where("n > 0")
        state = _cut(kept.select("v", F.col("n").cast("long").alias("n"), F.col("rest").cast("decimal(38,0)").alias("rest")))
    alive = state.select("v")
    kept = edges.join(alive.withColumnRenamed("v", "a"), "a", "left_semi").join(alive.withColumnRenamed("v", "b"), "b", "left_semi")
    return kept.select("a", "b")


def merged_edges(edges: DataFrame) -> DataFrame:
    """One row for each pair of nodes (a <= b) with the largest label."""
    return edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("label").alias("label"))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("a").alias("node"), "label").unionByName(edges.select(F.col("b").alias("node"), "label"))
    return ends.groupBy("node", "label").agg(F.count("*").alias("degree"))


def opposite_pairs(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The directed edges (a, b, edge) left when each a-b has cancelled one b-a: a multiset difference.

    The n-th of equal edges meets the n-th of the opposite ones, so each cancels one.
    """
    nth = F.row_number().over(Window.partitionBy(*keys, "a", "b").orderBy("edge"))
    numbered = edges.withColumn("nth", nth)
    other = numbered.select(*keys, F.col("a").alias("b"), F.col("b").alias("a"), "nth")
    return numbered.join(other, [*keys, "a", "b", "nth"], "left_anti").drop("nth")


def united(graphs: list[DataFrame]) -> DataFrame:
    """The edges (a, b, label) of several graphs as one; of an edge's labels the largest."""
    rows = graphs[0].select("a", "b", "label")
    for other in graphs[1:]:
        rows = rows.unionByName(other.select("a", "b", "label"))
    return merged_edges(rows)


def neighbours_of(edges: DataFrame) -> DataFrame:
    """(node, near): the sorted neighbours of each node."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("near")))
    return both.where("node <> near").groupBy("node").agg(F.array_sort(F.collect_set("near")).alias("near"))


def without_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """edges without those of gone (a, b), in either direction."""
    either = gone.select("a", "b").unionByName(gone.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return edges.join(either, ["a", "b"], "left_anti")


def moved_nodes(nodes: DataFrame, edges: DataFrame, moves: DataFrame, error: float) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after moves (id, x, y): nodes within error of each other are one, the smallest id.

    Edges that join a node to itself go; of doubled ones the largest label stays.
    """
    at = moves.select("id", F.col("x").alias("to_x"), F.col("y").alias("to_y"))
    placed = nodes.join(at, "id", "left").select("id", F.coalesce("to_x", "x").alias("x"), F.coalesce("to_y", "y").alias("y"))
    same = _cut(radius_components(_cut(placed), error))
    kept = placed.join(same, "id").where("id = comp").select("id", "x", "y")
    ends = edges.join(same.select(F.col("id").alias("a"), F.col("comp").alias("to_a")), "a").join(same.select(F.col("id").alias("b"), F.col("comp").alias("to_b")), "b")
    return kept, merged_edges(ends.where("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"), "label"))


def split_edges(segments: DataFrame, size: float, error: float = 1e-6, keys: tuple[str, ...] = ()) -> DataFrame:
    """segments (id, ax, ay, bx, by, label) cut where they cross or touch others: (keys, id, part, ax, ay, bx, by, label).

    Pairs meet on cells of the given size, in the cell of their boxes' lower common corner only; parts follow each
    other from a to b.
    """
    lo = {k: F.least(f"a{k}", f"b{k}") for k in "xy"}
    hi = {k: F.greatest(f"a{k}", f"b{k}") for k in "xy"}
    boxed = segments.withColumns({f"{k}0": v - error for k, v in lo.items()}).withColumns({f"{k}1": v + error for k, v in hi.items()})
    boxed = boxed.withColumn("c", F.explode(spatial.box_cells(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), size))).select("*", "c.cx", "c.cy").drop("c")
    other = boxed.select(*keys, "cx", "cy", *(F.col(c).alias(f"o_{c}") for c in ("id", "ax", "ay", "bx", "by", "x0", "y0", "x1", "y1")))
    pairs = boxed.join(other.hint("merge"), [*keys, "cx", "cy"]).where("id <> o_id AND x0 <= o_x1 AND o_x0 <= x1 AND y0 <= o_y1 AND o_y0 <= y1")
    here = (spatial.cell(F.greatest("x0", "o_x0"), size) == F.col("cx")) & (spatial.cell(F.greatest("y0", "o_y0"), size) == F.col("cy"))
    ux, uy, vx, vy = (F.col(f"{e}b{k}") - F.col(f"{e}a{k}") for e in ("", "o_") for k in "xy")
    d = F.nullif(ux * vy - uy * vx, F.lit(0.0))
    gx, gy = F.col("o_ax") - F.col("ax"), F.col("o_ay") - F.col("ay")
    s, t = (gx * vy - gy * vx) / d, (gx * uy - gy * ux) / d
    length, reach = F.sqrt(ux * ux + uy * uy), F.sqrt(vx * vx + vy * vy)
    cut = pairs.where(here).select(*keys, "id", s.alias("s"), t.alias("t"), length.alias("length"), reach.alias("reach"))
    cut = cut.where((F.col("t") * F.col("reach")).between(-error, F.col("reach") + error))
    cut = cut.where((F.col("s") * F.col("length") > error) & (F.col("s") * F.col("length") < F.col("length") - error))
    # one cut for crossings within error of each other
    at = cut.groupBy(*keys, "id", F.rint(F.col("s") * F.col("length") / error)).agg(F.min("s").alias("s"))
    ends = at.groupBy(*keys, "id").agg(F.array_sort(F.collect_list("s")).alias("cuts"))
    rows = segments.join(ends.hint("merge"), [*keys, "id"], "left")
    row = F.concat(F.array(F.lit(0.0)), F.coalesce("cuts", F.array().cast("array<double>")), F.array(F.lit(1.0)))
    rows = rows.withColumn("row", row).withColumn("part", F.explode(F.sequence(F.lit(0), F.size("row") - 2)))
    point = lambda i, k: F.col(f"a{k}") + F.get("row", F.col("part") + i) * (F.col(f"b{k}") - F.col(f"a{k}"))
    return rows.select(*keys, "id", "part", point(0, "x").alias("ax"), point(0, "y").alias("ay"), point(1, "x").alias("bx"), point(1, "y").alias("by"), "label")


def from_segments(segments: DataFrame, error: float, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of segments (ax, ay, bx, by, label): ends on one grid cell of error are one node, numbered from 0
    by x, then y; segments within one cell go, and of doubled edges the largest label stays."""
    snap = lambda c: F.rint(F.col(c) / error).cast("long")
    rows = segments.select(*keys, "label", *(snap(f"{e}{k}").alias(f"{e}{k}") for e in "ab" for k in "xy"))
    ends = rows.select(*keys, F.col("ax").alias("x"), F.col("ay").alias("y")).unionByName(rows.select(*keys, F.col("bx").alias("x"), F.col("by").alias("y")))
    by = Window.partitionBy(*keys).orderBy("x", "y") if keys else Window.orderBy("x", "y")
    nodes = ends.distinct().withColumn("node", F.row_number().over(by) - 1)
    own = [nodes.select(*keys, F.col("x").alias(f"{e}x"), F.col("y").alias(f"{e}y"), F.col("node").alias(e)) for e in "ab"]
    joined = rows.join(own[0], [*keys, "ax", "ay"]).join(own[1], [*keys, "bx", "by"]).where("a <> b")
    edges = joined.groupBy(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("label").alias("label"))
    return nodes.select(*keys, "node", (F.col("x") * error).alias("x"), (F.col("y") * error).alias("y")), edges


def groups(labels: DataFrame) -> DataFrame:
    """(comp, members): the sorted members of each component of labels (id, comp)."""
    return labels.groupBy("comp").agg(F.array_sort(F.collect_list("id")).alias("members"))


class UnevenEdges(ValueError):
    """An edge does not belong to exactly two faces."""


def face_pairs(edges: DataFrame, keys: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """(keys, a, b, left, right): the two faces of each edge (keys, a, b, face), whichever way it runs in them.

    Edges of one face, or of more than two, are left out; strict makes them an error of the job.
    """
    per = edges.groupBy(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.array_sort(F.collect_list("face")).alias("f"))
    if strict:
        per = per.withColumn("f", F.when(F.size("f") == 2, F.col("f")).otherwise(F.raise_error(F.lit("an edge without exactly two faces"))))
    two = per.where(F.size("f") == 2)
    return two.select(*keys, "a", "b", F.get("f", F.lit(0)).alias("left"), F.get("f", F.lit(1)).alias("right"))


def aligned_edges(nodes: DataFrame, edges: DataFrame, base: float, threshold: float) -> DataFrame:
    """(node, aligned): how many edges of each node run along a base direction in degrees, or square to it, within the
    threshold. nodes: node, x, y; edges: a, b."""
    own = [nodes.select(F.col("node").alias(e), F.col("x").alias(f"{e}x"), F.col("y").alias(f"{e}y")) for e in "ab"]
    rows = edges.join(own[0], "a").join(own[1], "b")
    turn = F.degrees(F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax"))) - base
    rows = rows.withColumn("hit", g.axis_aligned(turn, threshold).cast("int"))
    ends = rows.select(F.col("a").alias("node"), "hit").unionByName(rows.select(F.col("b").alias("node"), "hit"))
    return ends.groupBy("node").agg(F.sum("hit").alias("aligned"))
