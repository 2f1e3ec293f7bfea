"""Spatial joins on grid cells: an equi-join on the cell, then the exact predicate.

Polygons (or the searched side) are exploded over the cells that they cover; points have one cell. Spark sees a hash
join and splits skewed cells at run time. A cell side near the size of the searched shapes keeps both the copies and
the rows of a cell few.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kawara.functions import geometry as g


def _shared(df: DataFrame) -> str:
    """The session's shared folder; a temporary one where the session has none, on a local master only."""
    context = df.sparkSession.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="kawara-")
        context.setCheckpointDir(found)
    return found


def _cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: its plan runs once, and a lost executor costs nothing that is written."""
    path = f"{_shared(df).rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def box_cells(x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> Column:
    """The cells (cx, cy) that a box covers."""
    return F.flatten(
        F.transform(
            F.sequence(cell(x0, size), cell(x1, size)),
            lambda cx: F.transform(F.sequence(cell(y0, size), cell(y1, size)), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy"))),
        )
    )


def with_cell(points: DataFrame, size: float) -> DataFrame:
    return points.withColumn("cx", cell(F.col("x"), size)).withColumn("cy", cell(F.col("y"), size))


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of points (x, y, ...) and the polygons (ring, ...) that strictly contain them.

    keys: columns of both sides that have to be equal besides.
    """
    box = polygons.withColumn("box", g.bounds(F.col("ring")))
    b = F.col("box")
    covered = box.withColumn("c", F.explode(box_cells(b["min_x"], b["min_y"], b["max_x"], b["max_y"], size)))
    covered = covered.select("*", "c.cx", "c.cy").drop("c")
    rows = with_cell(points, size).join(covered, [*keys, "cx", "cy"])
    inside = (F.col("x") > b["min_x"]) & (F.col("x") < b["max_x"]) & (F.col("y") > b["min_y"]) & (F.col("y") < b["max_y"])
    return rows.where(inside).where(g.contains(F.col("ring"), F.col("x"), F.col("y"))).drop("cx", "cy", "box")


def within_radius(left: DataFrame, right: DataFrame, radius: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs at most radius apart, with distance. left: x, y, ...; right: its x and y become rx and ry.

    Cells are one radius wide; each left row looks into the nine cells around its own.
    """
    around = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    near = with_cell(left, radius).withColumn("o", F.explode(around))
    near = near.withColumn("cx", F.col("cx") + F.col("o.i")).withColumn("cy", F.col("cy") + F.col("o.j")).drop("o")
    other = with_cell(right, radius).withColumnRenamed("x", "rx").withColumnRenamed("y", "ry")
    pairs = near.join(other, [*keys, "cx", "cy"]).drop("cx", "cy")
    apart = F.sqrt((F.col("x") - F.col("rx")) ** 2 + (F.col("y") - F.col("ry")) ** 2)
    return pairs.withColumn("distance", apart).where(F.col("distance") <= radius)


def has_neighbor(left: DataFrame, right: DataFrame, radius: float, key: str) -> DataFrame:
    """The distinct keys of left rows that have a right row within the radius."""
    return within_radius(left, right, radius).select(key).distinct()


def nearest_within(left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """For each left row that has one: its nearest right row closer than the radius, the smallest id of equals."""
    pairs = within_radius(left, right, radius, keys).where(F.col("distance") < radius)
    best = F.min(F.struct("distance", right_id)).alias("best")
    return pairs.groupBy(*keys, left_id).agg(best).select(*keys, left_id, f"best.{right_id}", "best.distance")


#: Rows of a broadcast side at most.
MOST = 10_000


def crossed(left: DataFrame, right: DataFrame, most: int = MOST) -> DataFrame:
    """left beside each row of right. right is counted; beyond most rows it is worked off in blocks of about that many,
    each broadcast for a pass of its own, so that no task ever holds more."""
    blocks = -(-right.count() // most)
    if blocks <= 1:
        return left.crossJoin(F.broadcast(right))
    dealt = right.withColumn("block", F.pmod(F.xxhash64(*right.columns), F.lit(blocks)))
    out = None
    for k in range(blocks):
        part = left.crossJoin(F.broadcast(dealt.where(F.col("block") == k).drop("block")))
        out = part if out is None else out.unionByName(part)
    return out


#: Bytes of a block of vectors at most, and blocks of queries in a broadcast.
BLOCK = 1 << 22
BLOCKS = 8


def _blocks_of(rows: DataFrame, key: str, dims: str, pre: str, copies: int | None = None) -> DataFrame:
    """Vectors (doubles) in blocks as bytes: <pre>ids, <pre>vectors, <pre>size. Of equal vectors in a block, only those
    of the smallest ids, copies at most, are kept. Rows without a whole vector are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            starts = np.cumsum(sizes) - sizes
            ids, flat = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy()
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                own = own[np.argsort(ids[own], kind="stable")]
                vectors = flat[starts[own][:, None] + np.arange(size)] + 0.0
                if copies:
                    _, kind = np.unique(np.ascontiguousarray(vectors).view(f"V{8 * size}").ravel(), return_inverse=True)
                    order = np.argsort(kind, kind="stable")
                    first = np.flatnonzero(np.diff(kind[order], prepend=-1))
                    nth = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
                    kept = np.sort(order[nth < copies])
                    own, vectors = own[kept], vectors[kept]
                step = max(1, BLOCK // (8 * size))
                parts = [slice(k, k + step) for k in range(0, len(own), step)]
                columns = [[ids[own[x]].tobytes() for x in parts], [vectors[x].tobytes() for x in parts], [size] * len(parts)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int32())], names=[f"{pre}ids", f"{pre}vectors", f"{pre}size"])

    kept = rows.select(F.col(key).cast("long"), F.col(dims).cast("array<double>").alias("v"))
    kept = kept.where(F.col(key).isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull()))
    return kept.mapInArrow(run, f"{pre}ids binary, {pre}vectors binary, {pre}size int")


def nearest_vectors(queries: DataFrame, rows: DataFrame, k: int, dims: str = "embedding") -> DataFrame:
    """(query_id, vec_id, distance, rank): the exact k nearest rows (vec_id, dims) of a stated query set, ties: smallest id.

    Blocks of queries (query_id, embedding), broadcast a few at a time, meet blocks of rows. A matrix product tells which
    rows of a block may be among its k nearest, allowing for its rounding; their distances are then summed in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, x, size, q_ids, q, q_size = (batch.column(c)[row].as_py() for c in range(6))
                if size != q_size:
                    continue
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                x, q = np.frombuffer(x).reshape(-1, size), np.frombuffer(q).reshape(-1, size)
                xx, step = (x * x).sum(1), max(1, (1 << 22) // len(x))
                for at in range(0, len(q), step):
                    p = q[at : at + step]
                    qq = (p * p).sum(1)
                    near = qq[:, None] + xx - 2 * (p @ x.T)
                    slack = 16 * (size + 8) * np.finfo(float).eps * (qq + xx.max())
                    kth = np.partition(near, k - 1, 1)[:, k - 1] if len(x) > k else np.full(len(p), np.inf)
                    # what is no number stays a candidate
                    i, j = np.nonzero(~(near > (kth + slack)[:, None]))
                    total = np.zeros(len(i))
                    for d in range(size):
                        gap = p[i, d] - x[j, d]
                        total = total + gap * gap
                    total = np.sqrt(total)
                    order = np.lexsort((ids[j], total, i))
                    nth = np.arange(len(i)) - np.searchsorted(i, i)  # i is sorted, and so stays in place
                    best = order[nth < k]
                    columns = [pa.array(q_ids[at + i[best]]), pa.array(ids[j[best]]), pa.array(total[best])]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "distance"])

    left = _cut(_blocks_of(rows, "vec_id", dims, "", k))
    asked = _cut(_blocks_of(queries, "query_id", "embedding", "q_"))
    pairs = crossed(left, asked, BLOCKS).mapInArrow(run, "query_id long, vec_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


#: Places in a cell at most, where nearest() begins.
CROWD = 64
#: Rows that are somewhere; others are near nothing.
PLACED = "abs(x) < double('infinity') AND abs(y) < double('infinity')"


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, size: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """For each left row (keys, left_id, x, y) its nearest right row (keys, right_id, x, y), however far; ties: smallest id.

    Rings of cells: a radius is tried first, then doubled for the rows that found nothing, until all have one. It is
    size, or size halved until no cell holds over CROWD places. Right rows in one place are one, that of smallest id.
    Rows whose keys have no right row at all are left out.
    """
    wanted = left.select(*keys, left_id, "x", "y")
    have = _cut(right.where(PLACED).groupBy(*keys, "x", "y").agg(F.min(right_id).alias(right_id)))
    n = have.count()
    if not n:
        return wanted.limit(0).select(*keys, left_id, F.lit(None).cast(right.schema[right_id].dataType).alias(right_id), F.lit(0.0).alias("distance"))
    wanted = wanted.where(PLACED)
    wanted = wanted.join(have.select(*keys).distinct(), list(keys), "left_semi") if keys else wanted
    radius = size
    for _ in range(60):
        if n <= CROWD or with_cell(have, radius).groupBy(*keys, "cx", "cy").count().agg(F.max("count")).first()[0] <= CROWD:
            break
        radius /= 2
    have = F.broadcast(have) if n <= MOST else have.hint("merge")
    out, open_ = None, wanted
    while True:
        # the few places look around, not the rows
        pairs = within_radius(have, open_, radius, keys)
        found = pairs.groupBy(*keys, left_id).agg(F.min(F.struct("distance", right_id)).alias("best")).select(*keys, left_id, f"best.{right_id}", "best.distance")
        found = _cut(found)
        out = found if out is None else out.unionByName(found)
        open_ = _cut(open_.join(found.select(*keys, left_id).hint("merge"), [*keys, left_id], "left_anti"))
        if not open_.limit(1).count():
            return out
        radius *= 2


def tiles_overlapping(tiles: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Tiles whose header box meets the search box; plain comparisons, so Parquet statistics prune files."""
    return tiles.where((F.col("min_x") <= x1) & (F.col("max_x") >= x0) & (F.col("min_y") <= y1) & (F.col("max_y") >= y0))


def smallest_container(boxes: DataFrame, size: float) -> DataFrame:
    """(child, parent): for each box (id, x0, y0, x1, y1) the smallest larger one that contains it; smallest id of equals.

    A child's corner has one cell, so only boxes over that cell are looked at.
    """
    grown = boxes.withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    parents = grown.select(*(F.col(c).alias(f"p_{c}") for c in grown.columns))
    parents = parents.withColumn("c", F.explode(box_cells(F.col("p_x0"), F.col("p_y0"), F.col("p_x1"), F.col("p_y1"), size)))
    parents = parents.select("*", "c.cx", "c.cy").drop("c")
    children = grown.withColumn("cx", cell(F.col("x0"), size)).withColumn("cy", cell(F.col("y0"), size))
    pairs = children.join(parents, ["cx", "cy"]).where(
        "p_x0 <= x0 AND p_y0 <= y0 AND p_x1 >= x1 AND p_y1 >= y1 AND p_area > area"
    )
    best = F.min(F.struct("p_area", "p_id")).alias("best")
    return pairs.groupBy(F.col("id").alias("child")).agg(best).select("child", F.col("best.p_id").alias("parent"))


def _meetings(boxes: DataFrame, size: float, keys: tuple[str, ...], only: str = "true") -> DataFrame:
    """Each two boxes (id, x0, y0, x1, y1, ...) that overlap with an area (half-open) as one row: one's columns, and the
    other's with o_ before them.

    only: a condition on both, that holds both ways or neither. A pair meets once, in the cell of the overlap's lower
    corner: there one box has its own lower corner, or one has its lower x and the other its lower y. Cells are a quarter
    of size, so that few boxes meet that do not overlap.
    """
    size /= 4
    low = {f"l{k}": cell(F.col(f"{k}0"), size) for k in "xy"}
    placed = boxes.withColumns(low)
    covered = placed.withColumn("c", F.explode(box_cells(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), size)))
    covered = covered.select("*", "c.cx", "c.cy").drop("c")
    named = lambda rows: rows.select(*keys, "cx", "cy", *(F.col(c).alias(f"o_{c}") for c in placed.columns if c not in keys))
    own = [*keys, "cx", "cy"]
    corner = placed.withColumns({"cx": F.col("lx"), "cy": F.col("ly")}).join(named(covered).hint("merge"), own)
    corner = corner.where("id <> o_id AND (id < o_id OR o_lx <> cx OR o_ly <> cy)")
    cross = covered.where("cx = lx AND cy <> ly").join(named(covered.where("cx <> lx AND cy = ly")).hint("merge"), own)
    found = [rows.where(only).where("x0 < o_x1 AND o_x0 < x1 AND y0 < o_y1 AND o_y0 < y1") for rows in (corner, cross)]
    return found[0].unionByName(found[1])


def box_pairs(boxes: DataFrame, size: float, keys: tuple[str, ...] = (), only: str = "true") -> DataFrame:
    """Pairs (a, b), a < b, of boxes (id, x0, y0, x1, y1) that overlap with an area (half-open).

    only: a condition on columns of the boxes, with o_ before those of the other one, that holds both ways or neither.
    """
    return _meetings(boxes, size, keys, only).select(*keys, F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b"))


def box_relations(boxes: DataFrame, size: float, keys: tuple[str, ...] = (), share: float = 0.9, gap: float = 0.5) -> DataFrame:
    """(keys, a, b, relation) of each ordered pair of boxes (id, x0, y0, x1, y1): CONTAINING where the overlap is over
    share of b, else CONTAINED where it is over share of a, else NEIGHBORING where the boxes are closer than gap.

    Two boxes grown by gap meet once, and are told about both ways."""
    ends = [f"{k}{i}" for k in "xy" for i in (0, 1)]
    grown = boxes.select(*keys, "id", *(F.col(e).alias(f"r{e}") for e in ends), *((F.col(e) + (gap if e[1] == "1" else -gap)).alias(e) for e in ends))
    pairs = _meetings(grown, size, keys)
    zero = F.lit(0.0)
    common = F.greatest(zero, F.least("rx1", "o_rx1") - F.greatest("rx0", "o_rx0")) * F.greatest(zero, F.least("ry1", "o_ry1") - F.greatest("ry0", "o_ry0"))
    area = lambda p: (F.col(f"{p}rx1") - F.col(f"{p}rx0")) * (F.col(f"{p}ry1") - F.col(f"{p}ry0"))
    dx = F.greatest(zero, F.col("o_rx0") - F.col("rx1"), F.col("rx0") - F.col("o_rx1"))
    dy = F.greatest(zero, F.col("o_ry0") - F.col("ry1"), F.col("ry0") - F.col("o_ry1"))
    pairs = pairs.select(*keys, "id", "o_id", (common / area("")).alias("own"), (common / area("o_")).alias("other"), F.sqrt(dx * dx + dy * dy).alias("apart"))
    kind = lambda one, two: F.when(F.col(two) > share, "CONTAINING").when(F.col(one) > share, "CONTAINED").when(F.col("apart") < gap, "NEIGHBORING")
    way = lambda a, b, kind: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), kind.alias("relation"))
    both = F.array(way("id", "o_id", kind("own", "other")), way("o_id", "id", kind("other", "own")))
    return pairs.select(*keys, F.explode(both).alias("p")).select(*keys, "p.*").where("relation IS NOT NULL")


def boxes_held(boxes: DataFrame, size: float, keys: tuple[str, ...] = (), share: float = 0.9) -> DataFrame:
    """(keys, id) of the boxes (id, x0, y0, x1, y1) of which over share, half at least, lies in another box.

    Such a box's middle lies in the other one, and has one cell: no pairs are made of boxes that merely meet. As rows
    of one cell are looked at all, cells are a quarter of size.
    """
    if share < 0.5:
        raise ValueError("share has to be half at least")
    size /= 4
    middle = {f"c{k}": cell((F.col(f"{k}0") + F.col(f"{k}1")) / 2, size) for k in "xy"}
    own = boxes.withColumns(middle).withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).where("area > 0")
    # a little wider, for middles that rounding moves
    cover = box_cells(F.col("x0") - size / 1000, F.col("y0") - size / 1000, F.col("x1") + size / 1000, F.col("y1") + size / 1000, size)
    other = boxes.select(*keys, *(F.col(c).alias(f"o_{c}") for c in ("id", "x0", "y0", "x1", "y1")), F.explode(cover).alias("c")).select("*", "c.cx", "c.cy").drop("c")
    wide, high = (F.least(f"{k}1", f"o_{k}1") - F.greatest(f"{k}0", f"o_{k}0") for k in "xy")
    pairs = own.join(other.hint("merge"), [*keys, "cx", "cy"]).where((F.col("id") != F.col("o_id")) & (wide > 0) & (wide * high / F.col("area") > share))
    return pairs.select(*keys, "id").distinct()
