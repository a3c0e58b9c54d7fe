"""Hard-negative mining by a pivot table.

Vectors are lengthened by one component, sqrt(M - |x|^2) with M the largest squared
length, anchors by zero: the squared distance of an anchor q to a row x is then
|q|^2 + M - 2 q.x, and the largest inner product is the smallest distance. Distances
of all rows to a few pivots are stored. By the triangle inequality they bracket the
distance of an anchor to a row, and so the score; what the bracket leaves is scored
exactly, in whole numbers.

Rows lie in blocks, ordered by their nearest pivot and the distance to it. A slice is
the anchors of some neighbouring blocks. Each anchor first looks through its own
block, which gives it bounds; the least and largest pivot distances of slices and
blocks then tell which of them need to meet, and only these are shuffled to each
other. Anchors are looked up twice: for the best rows of their label, and for the best
rows of others within the windows of score that those give.

The pivots are picked among at most SAMPLE rows; they decide what is skipped, never
what is found. Every row is in the table.

Cases. Rows with a null label or vector, or a null or non-finite component, take no
part. Vectors of unlike lengths count as if zeros followed the shorter ones; so does an
empty one. Components are floored to whole steps; beyond the largest that keeps a score
within a long, they count as that. Repeated rows are rows of their own: a copy of the
anchor is another row. Ties of score go to the smaller id, a null id last, then to the
place of the row. An anchor without positives, or a positive without negatives in its
window, gives no rows. Empty table: no rows. Absent columns count as null, and further
columns of any name are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.aggregates import numbered
from .common import named, staged

STEPS = 256
PIVOTS = 8
#: Rows among which pivots are picked.
SAMPLE = 2048
#: Rows of a block, and blocks whose anchors are a slice.
BLOCK = 1024
SLICE = 16
#: Beyond every score.
FAR = 1 << 62


def _lengthened(x: np.ndarray, most: float) -> np.ndarray:
    x = x.astype(float)
    return np.column_stack([x, np.sqrt(np.maximum(0.0, most - np.einsum("ij,ij->i", x, x)))])


def pick_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """n rows of x, each the farthest from those before it."""
    picked = [0]
    near = np.full(len(x), np.inf)
    while len(picked) < min(n, len(x)):
        near = np.minimum(near, np.linalg.norm(x - x[picked[-1]], axis=1))
        picked.append(int(near.argmax()))
    return x[picked]


def _matrix(column: pa.ChunkedArray, kind: str = "<i8") -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), kind)
    return flat.reshape(len(column), -1)


def _pivot_table(table: DataFrame, steps: int, pivots: int, block: int) -> DataFrame:
    """(at, id, label, anchor, own, v, d, nearest, block): whole steps as bytes, the squared length, distances to the pivots."""
    spark = table.sparkSession
    size, low, high = table.agg(F.max(F.size("x")), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    dims = max(1, size or 0)
    most_step = float(int((FAR / dims) ** 0.5))

    def whole(column) -> np.ndarray:
        flat, counts = column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy(zero_copy_only=False)
        out = np.zeros((len(column), dims))
        out[np.repeat(np.arange(len(column)), counts), np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)] = flat
        return np.clip(np.floor(out * steps), -most_step, most_step).astype(np.int64)

    def stepped(batches):
        for batch in batches:
            x = whole(batch["x"])
            own = np.einsum("ij,ij->i", x.astype(float), x.astype(float))
            rest = [batch[c] for c in ("at", "id", "label", "anchor")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(own), pa.array([r.tobytes() for r in x], pa.binary())], names=["at", "id", "label", "anchor", "own", "v"])

    rows = staged(table.mapInArrow(stepped, "at long, id long, label long, anchor boolean, own double, v binary"), "stepped")
    most = rows.agg(F.max("own")).first()[0] or 0.0
    sample = rows.orderBy(F.xxhash64("at"), "at").limit(SAMPLE).select("v").collect()
    chosen = pick_pivots(_lengthened(np.stack([np.frombuffer(r["v"], "<i8") for r in sample]), most), pivots) if sample else np.zeros((1, dims + 1))

    def measured(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _lengthened(_matrix(batch["v"]), most)
            if_anchor = x.copy()
            if_anchor[:, -1] = 0.0
            far, from_anchor = (np.sqrt(np.stack([((y - p) ** 2).sum(1) for p in chosen], 1)) for y in (x, if_anchor))
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, d.size + 1, d.shape[1]), pa.int32()), pa.array(d.ravel())) for d in (far, from_anchor)]
            nearest = far.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists, pa.array(nearest, pa.int32()), pa.array(far[np.arange(len(far)), nearest])], names=[*batch.schema.names, "d", "anchor_d", "nearest", "ring"])

    placed = rows.mapInArrow(measured, "at long, id long, label long, anchor boolean, own double, v binary, d array<double>, anchor_d array<double>, nearest int, ring double")
    placed = numbered(placed, [F.asc("nearest"), F.asc("ring"), F.asc("at")], "no")
    return staged(placed.select("*", F.floor((F.col("no") - 1) / block).cast("bigint").alias("block"), F.lit(most).alias("most")).drop("no", "ring", "nearest"), "pivot-table")


_FOUND = "anchor_at long, anchor_id long, window int, at long, id long, score long, rank int"


def _search(left: pa.Table, right: pa.Table, same: bool, k: int) -> pa.Table:
    """The k best rows of each anchor's windows: of its label, or of others. left: anchors with lows and highs; right: a block."""
    out: list[tuple] = []
    if left.num_rows and right.num_rows:
        ids = np.array([FAR if i is None else i for i in right["id"].to_pylist()], np.int64)
        right = right.take(pa.array(np.lexsort((right["at"].to_numpy(), ids))))
        x, label, at, ids = _matrix(right["v"]), right["label"].to_numpy(), right["at"].to_numpy(), right["id"].to_pylist()
        d, most = np.array(right["d"].to_pylist()), right["most"][0].as_py()
        reach = np.abs(x).max(initial=0)
        for a in left.to_pylist():
            q = np.frombuffer(a["v"], "<i8")
            gap = np.abs(d - np.array(a["anchor_d"])).max(1)
            both = np.array(a["anchor_d"]) + d
            slack = 1e-9 * (a["own"] + most) + 1.0
            upper, lower = (a["own"] + most - gap**2) / 2 + slack, (a["own"] + most - both.min(1) ** 2) / 2 - slack
            lows, highs = np.array(a["lows"]), np.array(a["highs"])
            fit = (label == a["label"]) == same
            fit &= (upper >= lows.min()) & (lower <= highs.max()) & (at != a["at"])
            held = np.flatnonzero(fit)
            exact = float(reach) * float(np.abs(q).max(initial=0)) * len(q) < 2.0**53
            scores = (x[held].astype(float) @ q.astype(float)).astype(np.int64) if exact else x[held] @ q
            order = np.argsort(-scores, kind="stable")  # rows are in order of ids
            held, scores = held[order], scores[order]
            for w, (low, high) in enumerate(zip(lows.tolist(), highs.tolist(), strict=True)):
                first, end = int(np.searchsorted(-scores, -high, "left")), int(np.searchsorted(-scores, -low, "right"))
                end = min(end, first + k)
                out += [(a["at"], a["id"], w, int(at[i]), ids[i], int(s), r + 1) for r, (i, s) in enumerate(zip(held[first:end], scores[first:end], strict=True))]
    names = ["anchor_at", "anchor_id", "window", "at", "id", "score", "rank"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    return pa.Table.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=names)


def _ringed(distances: str, pivots: int, prefix: str = "") -> list[Column]:
    return [F.array(*[f(F.col(distances)[p]) for p in range(pivots)]).alias(prefix + n) for n, f in (("least", F.min), ("largest", F.max))]


def _best(table: DataFrame, anchors: DataFrame, same: bool, k: int, pivots: int) -> DataFrame:
    """The k best rows in each window of each anchor, over all blocks. anchors: rows of the table with lows and highs."""
    found_here = lambda left, right: _search(left, right, same, k)
    rows = table.select(F.col("block").alias("there"), "at", "id", "label", "v", "d", "most")
    home = staged(anchors.groupBy("block").cogroup(rows.groupBy("there")).applyInArrow(found_here, _FOUND), "own-blocks")
    # A window that its own block has filled needs nothing below its k-th score.
    filled = home.where(F.col("rank") == k).groupBy(F.col("anchor_at").alias("at")).agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))
    raised = F.transform("lows", lambda low, i: F.greatest(low, F.coalesce(F.try_element_at("kth", i), low)))
    bounded = anchors.join(filled, "at", "left").withColumn("lows", F.when(F.col("kth").isNull(), F.col("lows")).otherwise(raised)).drop("kth")
    bounded = staged(bounded.select("*", F.floor(F.col("block") / SLICE).cast("bigint").alias("slice")), "bounded")
    slices = bounded.groupBy("slice").agg(
        F.min(F.array_min("lows")).alias("low"),
        F.max(F.array_max("highs")).alias("high"),
        F.min("own").alias("q_min"),
        F.max("own").alias("q_max"),
        F.min("label").alias("label_from"),
        F.max("label").alias("label_to"),
        *_ringed("anchor_d", pivots, "q_"),
    )
    blocks = table.groupBy("block").agg(F.first("most").alias("most"), F.min("label").alias("from"), F.max("label").alias("to"), *_ringed("d", pivots))
    last = blocks.agg(F.max("block")).first()[0]
    # The stated anchors against all rows, in blocks: a slice lists the blocks, and meets those that its bracket cannot rule out.
    listed = slices.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last or 0).cast("bigint")))).join(blocks, "block")
    gaps = F.transform(F.sequence(F.lit(0), F.lit(pivots - 1)), lambda p: F.greatest(F.lit(0.0), F.get("q_least", p) - F.get("largest", p), F.get("least", p) - F.get("q_largest", p)))
    sums = F.transform(F.sequence(F.lit(0), F.lit(pivots - 1)), lambda p: F.get("q_largest", p) + F.get("largest", p))
    slack = F.lit(1e-9) * (F.col("q_max") + F.col("most")) + 1
    upper = (F.col("q_max") + F.col("most") - F.pow(F.array_max(gaps), 2)) / 2 + slack
    lower = (F.col("q_min") + F.col("most") - F.pow(F.array_min(sums), 2)) / 2 - slack
    labels = (F.col("label_from") <= F.col("to")) & (F.col("from") <= F.col("label_to")) if same else ~((F.col("label_from") == F.col("label_to")) & (F.col("from") == F.col("to")) & (F.col("from") == F.col("label_from")))
    meeting = staged(listed.where((upper >= F.col("low")) & (lower <= F.col("high")) & labels).select("slice", "block"), "meeting")
    key = F.struct("slice", "block").alias("pair")
    left = bounded.withColumnRenamed("block", "home").join(meeting, "slice").where("home <> block").select(key, "at", "id", "label", "own", "v", "anchor_d", "lows", "highs")
    right = rows.withColumnRenamed("there", "block").join(meeting, "block").select(key, "at", "id", "label", "v", "d", "most")
    away = left.groupBy("pair").cogroup(right.groupBy("pair")).applyInArrow(found_here, _FOUND)
    w = Window.partitionBy("anchor_at", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"), "at")
    return home.union(away).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    label: Column,
    vector: str = "embedding",
    id_: str = "vec_id",
    positives: int = 5,
    negatives: int = 3,
    window: tuple[int, int] = (50, 95),
    steps: int = STEPS,
    pivots: int = PIVOTS,
    block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for each row where `anchor` holds and each of its best rows of the same label, the best rows of other labels whose score lies within the window, in hundredths of the positive's."""
    x = named(vectors, vector, "array<double>").cast("array<double>")
    taken = vectors.select(named(vectors, id_, "bigint").cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), x.alias("x"), F.monotonically_increasing_id().alias("at"))
    sound = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    table = _pivot_table(staged(taken.where(F.col("label").isNotNull() & F.col("x").isNotNull() & sound), "vectors"), steps, pivots, block)
    pivots = max(1, len((table.select("d").first() or [[0]])[0]))
    base = table.where("anchor").select("block", "at", "id", "label", "own", "v", "anchor_d")
    far = F.lit(FAR).cast("bigint")
    best = staged(_best(table, base.select("*", F.array(-far).alias("lows"), F.array(far).alias("highs")), True, positives, pivots).select("anchor_at", F.col("at").alias("positive_at"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("place")), "positives")
    # low <= 100 * score and 100 * score <= high, in whole scores.
    low, high = (F.col("positive_score").cast("decimal(38,0)") * n for n in window)
    wanted = best.select("*", F.ceil(low / 100).cast("bigint").alias("low"), F.floor(high / 100).cast("bigint").alias("high")).where("low <= high")
    own = wanted.groupBy(F.col("anchor_at").alias("at")).agg(F.array_sort(F.collect_list(F.struct("place", "low", "high"))).alias("w"))
    anchors = base.join(own, "at").select(*base.columns, F.col("w.low").alias("lows"), F.col("w.high").alias("highs"), F.col("w.place").alias("places"))
    anchors = staged(anchors, "anchors")
    found = _best(table, anchors.drop("places"), False, negatives, pivots)
    placed = anchors.select(F.col("at").alias("anchor_at"), F.posexplode("places").alias("window", "place"))
    rows = found.join(placed, ["anchor_at", "window"]).join(best, ["anchor_at", "place"])
    return rows.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def relabelled(vectors: DataFrame) -> Column:
    """The label, one higher modulo ten where vec_id is divisible by seven."""
    label = named(vectors, "label", "int").cast("bigint")
    return F.when(named(vectors, "vec_id", "bigint") % 7 == 0, (label + 1) % 10).otherwise(label)


#: The same rows in DuckDB: all pairs of anchors and rows.
ORACLE = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
WHERE 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) <= 3
"""
