"""Clusters in the plane (MTH9, CLU6): rotation, convex hulls, centroids, overlaps by separating axes, and colours that overlapping hulls do not share.

Cases. Null coordinates or groups: left out. A group of one or two points, or of points on
a line, has a hull of one or two corners. Repeated points count once. Touching hulls
overlap. Empty tables: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged

#: Colours of the palette, and differences that count as none.
COLOURS = 26
NEAR = 1e-10
POLYGON = "array<struct<x:double,y:double>>"


def rotated(x: Column, y: Column, degrees: float) -> tuple[Column, Column]:
    """MTH9: a point turned around the origin, counter-clockwise."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return c * x - s * y, s * x + c * y


def hull_of(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull, counter-clockwise from the leftmost; none within an edge."""
    points = sorted(set(points))

    def chain(run):
        out: list[tuple[float, float]] = []
        for p in run:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(points) + chain(points[::-1]) if len(points) > 2 else points


def hulls(points: DataFrame, group: str = "cluster_id", x: str = "x", y: str = "y") -> DataFrame:
    """(group, polygon): the convex hull of each group. Batches are reduced to their own hulls before they are shuffled, so a hot group sends corners only; a hull of hulls is the hull."""
    kind = points.schema[group].dataType.simpleString()
    rows = points.select(group, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            found = [(g, *p) for g, own in df.groupby(group) for p in hull_of(list(zip(own["x"], own["y"], strict=True)))]
            yield pd.DataFrame(found, columns=[group, "x", "y"])

    def whole(df: pd.DataFrame) -> pd.DataFrame:
        polygon = [{"x": a, "y": b} for a, b in hull_of(list(zip(df["x"], df["y"], strict=True)))]
        return pd.DataFrame({group: [df[group].iloc[0]], "polygon": [polygon]})

    corners = rows.mapInPandas(partial, f"`{group}` {kind}, x double, y double")
    return corners.groupBy(group).applyInPandas(whole, f"`{group}` {kind}, polygon {POLYGON}")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def _next(polygon: Column, i: Column) -> Column:
    return F.get(polygon, F.pmod(i + 1, F.size(polygon)))


def centroid(polygon: Column) -> Column:
    """Struct of x and y: the area's centre; of the corners' where there is no area."""
    cross = lambda p, i: p["x"] * _next(polygon, i)["y"] - _next(polygon, i)["x"] * p["y"]
    area = _sum(F.transform(polygon, cross)) / 2
    part = lambda k: _sum(F.transform(polygon, lambda p, i: (p[k] + _next(polygon, i)[k]) * cross(p, i))) / (6 * area)
    mean = lambda k: _sum(F.transform(polygon, lambda p: p[k])) / F.size(polygon)
    flat = (F.size(polygon) < 3) | (F.abs(area) < NEAR)
    return F.struct(*[F.when(flat, mean(k)).otherwise(part(k)).alias(k) for k in ("x", "y")])


def expanded(polygon: Column, buffer: float) -> Column:
    """Corners moved outward, away from their mean; polygons of fewer than three stay."""
    mean = lambda k: _sum(F.transform(polygon, lambda p: p[k])) / F.size(polygon)

    def moved(p: Column) -> Column:
        far = F.hypot(p["x"] - mean("x"), p["y"] - mean("y"))
        return F.struct(*[(p[k] + F.when(far > NEAR, buffer * (p[k] - mean(k)) / far).otherwise(0.0)).alias(k) for k in ("x", "y")])

    return F.when(F.size(polygon) < 3, polygon).otherwise(F.transform(polygon, moved))


def parted(a: Column, b: Column) -> Column:
    """Whether an edge's normal separates two convex polygons."""

    def separates(edge: Column) -> Column:
        reach = lambda polygon: F.transform(polygon, lambda p: p["x"] * edge["nx"] + p["y"] * edge["ny"])
        return (F.array_max(reach(a)) < F.array_min(reach(b)) - NEAR) | (F.array_max(reach(b)) < F.array_min(reach(a)) - NEAR)

    def normals(polygon: Column) -> Column:
        def normal(p: Column, i: Column) -> Column:
            dx, dy = _next(polygon, i)["x"] - p["x"], _next(polygon, i)["y"] - p["y"]
            return F.when(F.hypot(dx, dy) > NEAR, F.struct((-dy / F.hypot(dx, dy)).alias("nx"), (dx / F.hypot(dx, dy)).alias("ny")))

        return F.filter(F.transform(polygon, normal), lambda e: e.isNotNull())

    return F.exists(F.concat(normals(a), normals(b)), separates)


def overlaps(polygons: DataFrame, group: str = "cluster_id", buffer: float = 0.0) -> DataFrame:
    """(a, b), a below b: groups whose hulls overlap.

    A polygon stands in the cells of its own level, whose side is the power of two above its extent, so in four at most; and it is looked up in the cells of each coarser level in use. So large and small polygons meet without a cross join. A pair is found in the one cell that holds the lower left corner of both boxes' common part.
    """
    side = lambda pick, k: pick(F.transform("polygon", lambda p: p[k]))
    rows = polygons.select(F.col(group).alias("id"), expanded(F.col("polygon"), buffer).alias("polygon"))
    rows = rows.select("*", side(F.array_min, "x").alias("x0"), side(F.array_max, "x").alias("x1"), side(F.array_min, "y").alias("y0"), side(F.array_max, "y").alias("y1"))
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-6))
    rows = staged(rows.withColumn("level", F.ceil(F.log2(extent)).cast("int")), "hulls")
    levels = rows.select(F.col("level").alias("at")).distinct()  # powers of two between the smallest and the largest extent: some tens
    every = F.array_sort(F.collect_set("at"))

    def cells(of: DataFrame, level: str) -> DataFrame:
        along = lambda low, high: F.sequence(F.floor(F.col(low) / F.pow(F.lit(2.0), level)), F.floor(F.col(high) / F.pow(F.lit(2.0), level)))
        return of.withColumn("cx", F.explode(along("x0", "x1"))).withColumn("cy", F.explode(along("y0", "y1")))

    use = [r for r in (levels.agg(every).first()[0] or [])]
    own = cells(rows, "level").select(*[F.col(c).alias(f"b_{c}") for c in ("id", "polygon", "x0", "x1", "y0", "y1", "level", "cx", "cy")])
    looked = rows.withColumn("at", F.explode(F.filter(F.array(*[F.lit(k) for k in use]).cast("array<int>"), lambda k: k >= F.col("level"))))
    looked = cells(looked, "at")
    met = looked.join(own, (F.col("at") == F.col("b_level")) & (F.col("cx") == F.col("b_cx")) & (F.col("cy") == F.col("b_cy")) & ((F.col("level") < F.col("at")) | (F.col("id") < F.col("b_id"))))
    touch = (F.col("x0") <= F.col("b_x1")) & (F.col("b_x0") <= F.col("x1")) & (F.col("y0") <= F.col("b_y1")) & (F.col("b_y0") <= F.col("y1"))
    at = lambda k: F.floor(F.greatest(F.col(f"{k}0"), F.col(f"b_{k}0")) / F.pow(F.lit(2.0), "at"))
    met = met.where(touch & (at("x") == F.col("cx")) & (at("y") == F.col("cy"))).where(~parted(F.col("polygon"), F.col("b_polygon")))
    return met.select(F.least("id", "b_id").alias("a"), F.greatest("id", "b_id").alias("b"))


def _fits(choices: Column, ideal: Column) -> Column:
    """The choice nearest to the ideal, the lower of two; null of none."""
    return F.array_min(F.transform(choices, lambda c: F.struct(F.abs(c - ideal).alias("far"), c.alias("colour"))))["colour"]


def _one_by_one(first: list, near: dict[int, set[int]], total: int, colours: int) -> list[tuple[int, int]]:
    """(rank, colour) of the groups before colours run out: each takes one that none has yet, two or more away from its neighbours' if there is one, and nearest to its place."""
    taken: dict[int, int] = {}
    for rank in first:
        beside = {taken[r] for r in near.get(rank, ()) if r in taken}
        free = [c for c in range(colours) if c not in taken.values()]
        choices = next(filter(None, ([c for c in free if all(abs(c - o) >= least for o in beside)] for least in (2, 1, 0))))
        ideal = int(rank / max(total - 1, 1) * (colours - 1))
        taken[rank] = min(choices, key=lambda c: abs(c - ideal))
    return sorted(taken.items())


def coloured(centres: DataFrame, pairs: DataFrame, group: str = "cluster_id", x: str = "x", colours: int = COLOURS) -> DataFrame:
    """CLU6: (group, colour) with colours from 0, as if groups chose from left to right (ties: the lower group first).

    The first `colours` groups take a colour each; they alone are gone through in order, in the driver, with the overlaps among them. Every later one takes the colour nearest to its place that no overlapping group to its left has, which needs those groups alone: in each round all choose whose left neighbours have chosen. Only a group with all colours to its left shares one.
    """
    by_x = Window.orderBy(x, group)  # clusters, not points: one number each
    ranked = staged(centres.select(F.col(group).alias("id"), (F.row_number().over(by_x) - 1).alias("rank")), "ranks")
    total = ranked.count()
    rank_a, rank_b = (ranked.select(F.col("id").alias(k), F.col("rank").alias(f"r{k}")) for k in "ab")
    edges = pairs.join(rank_a, "a").join(rank_b, "b").select(F.least("ra", "rb").alias("left"), F.greatest("ra", "rb").alias("rank"))
    edges = staged(edges.distinct(), "edges")
    near: dict[int, set[int]] = {}
    for r in edges.where(F.col("rank") < colours).collect():  # at most colours * colours / 2
        near.setdefault(r["rank"], set()).add(r["left"])
    found = _one_by_one(list(range(min(total, colours))), near, total, colours)
    chosen = staged(ranked.sparkSession.createDataFrame(found, "rank int, colour int"), "colours")
    palette = F.array(*[F.lit(c) for c in range(colours)])
    left = ranked.where(F.col("rank") >= colours).select("rank")
    count = total - len(found)
    while count:
        beside = left.join(edges, "rank", "left").join(chosen.withColumnRenamed("rank", "left"), "left", "left")
        waits = F.count_if(F.col("left").isNotNull() & F.col("colour").isNull())
        ready = beside.groupBy("rank").agg(F.collect_set("colour").alias("beside"), waits.alias("waits")).where("waits = 0")
        ideal = F.floor(F.col("rank") / max(total - 1, 1) * (colours - 1)).cast("int")
        colour = F.coalesce(_fits(F.array_except(palette, "beside"), ideal), ideal).cast("int")
        now = staged(ready.select("rank", colour.alias("colour")), "colours")
        count -= now.count()
        chosen = staged(chosen.unionByName(now), "colours")
        left = left.join(now, "rank", "left_anti")
    return ranked.join(chosen, "rank").select(F.col("id").alias(group), "colour")
