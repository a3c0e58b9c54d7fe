"""Similarity, retrieval and votes (SIM1-SIM4, RAG1-RAG5, AGG17).

Rankings go by an inverted file: candidates lie in lists by their nearest centroid, each
list cut into blocks by the distance to it. The triangle inequality tells which blocks
can hold one of a query's k best; only those meet it, as matrices in Arrow batches, and
only the best k of each block go on. Results are exact: centroids decide what is skipped
and never what is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..staging import staged
from .aggregates import numbered

#: Rows in a block, lists at most, and candidates that centroids are fitted on.
BLOCK = 4096
LISTS = 256
SAMPLE = 8192
#: Comments and rules whose products are held at a time; parts that each side of a community is cut into, if it has as many slices, and
#: rows of a part at most; tasks at most.
SLICE, RULES = 1024, 1024
SIDES, PART, TASKS = 4, 1 << 16, 4096


def _met(comments: DataFrame, rules: DataFrame, key: str, slice_: int, block: int, run, kinds: str) -> DataFrame:
    """run(slice of comments, block of rules) wherever they meet. Each part of a community's comments meets each part of its rules in a cell, and a task has whole cells: a row is sent SIDES times, more often only where parts would exceed PART. A task holds one part of rules and the products of one slice and block."""
    import numpy as np
    import pyarrow as pa

    parts = lambda n, step: F.greatest(F.least(F.lit(SIDES), F.ceil(n / step)), F.ceil(n / PART)).cast("int")
    sizes = comments.groupBy(key).agg(parts(F.count("*"), slice_).alias("_slices")).join(rules.groupBy(key).agg(parts(F.count("*"), block).alias("_blocks")), key)
    cells, before = F.col("_slices") * F.col("_blocks"), Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)  # communities: one number each
    sizes = staged(sizes.withColumn("_first", F.coalesce(F.sum(cells).over(before), F.lit(0))), "similarity-sizes")
    tasks = min(TASKS, sizes.agg(F.sum(cells)).first()[0] or 1)
    number = lambda id_, n: F.pmod(F.xxhash64(id_), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cell = (F.col("_first") + F.col("_s") * F.col("_blocks") + F.col("_b")).alias("_cell")
    kind = {c: df.schema[c].dataType for df, c in ((comments, "comment_id"), (rules, "rule_index"))}
    c = comments.select(key, "comment_id", F.col("embedding").alias("v")).join(sizes, key).withColumn("_s", number("comment_id", "_slices")).withColumn("_b", every("_blocks"))
    c = c.select(cell, F.lit(True).alias("_asks"), key, "comment_id", F.lit(None).cast(kind["rule_index"]).alias("rule_index"), "v")
    r = rules.select(key, "rule_index", F.col("embedding").alias("v")).join(sizes, key).withColumn("_b", number("rule_index", "_blocks")).withColumn("_s", every("_slices"))
    # New columns: both sides may come from the same table.
    r = r.select(cell, F.lit(False).alias("_asks"), F.col(key).alias(key), F.lit(None).cast(kind["comment_id"]).alias("comment_id"), "rule_index", "v")

    def side(batches):
        at, held = None, []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            of, asks = table["_cell"].to_numpy(), table["_asks"].to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((of[1:] != of[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(of)], strict=True):
                if a == b:
                    continue
                if of[a] != at:
                    at, held = of[a], []
                if not asks[a]:
                    held.append(table.slice(a, b - a))
                    continue
                if len(held) > 1:
                    held = [pa.concat_tables(held).combine_chunks()]
                for left in (table.slice(i, min(slice_, b - i)) for i in range(a, b, slice_)):
                    for right in (t.slice(j, block) for t in held for j in range(0, t.num_rows, block)):
                        yield from run(left, right).to_batches()

    dealt = c.unionByName(r).repartitionById(tasks, F.pmod("_cell", F.lit(tasks)).cast("int")).sortWithinPartitions("_cell", "_asks")
    return dealt.mapInArrow(side, kinds)


def _products(a, b):
    """(scores of all pairs as FLOAT, which of them are known) of two columns of vectors. A null, a null component or different lengths: not known."""
    import numpy as np
    import pyarrow.compute as pc

    def sized(column):
        column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
        n = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).copy()
        flat = column.flatten()
        if flat.null_count:
            n[pc.list_parent_indices(column).to_numpy()[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
        return column, n

    (a, m), (b, n) = sized(a), sized(b)
    scores, known = np.zeros((len(m), len(n)), np.float32), m[:, None] == n[None, :]
    known[m < 0] = False
    for size in set(m.tolist()) & set(n.tolist()) - {-1, 0}:
        i, j = np.flatnonzero(m == size), np.flatnonzero(n == size)
        x, y = vectors(a.take(i)).astype(float), vectors(b.take(j)).astype(float)
        with np.errstate(over="ignore", invalid="ignore"):
            scores[np.ix_(i, j)] = x @ y.T
    return scores, known


def similarities(comments: DataFrame, rules: DataFrame, key: str = "subreddit", slice_: int = SLICE, block: int = RULES) -> DataFrame:
    """SIM1: the long table (key, comment_id, rule_index, score) of each community's comments and rules: products of a slice of comments and a block of rules."""
    import numpy as np
    import pyarrow as pa

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n, m = left.num_rows, right.num_rows
        scores, known = _products(left["v"], right["v"])
        at, to = pa.array(np.repeat(np.arange(n), m)), pa.array(np.tile(np.arange(m), n))
        return pa.table({key: left[key].take(at), "comment_id": left["comment_id"].take(at), "rule_index": right["rule_index"].take(to), "score": pa.array(scores.ravel(), mask=~known.ravel(), from_pandas=False)})

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((comments, key), (comments, "comment_id"), (rules, "rule_index")))
    return _met(comments, rules, key, slice_, block, run, f"{kinds}, score float")


def _in_order(scores, known):
    """Whole numbers above 0 in the order of FLOAT scores, not-a-number last; 0 where a score is not known."""
    import numpy as np

    bits = np.where(np.isnan(scores), np.float32(np.nan), scores + np.float32(0.0)).view(np.uint32)
    return np.where(known, np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)), np.uint32(0))


def _from_order(numbers):
    """The FLOAT scores that the numbers stand for."""
    import numpy as np

    numbers = np.asarray(numbers).astype(np.uint32)
    return np.where(numbers >> 31, numbers ^ np.uint32(1 << 31), ~numbers).view(np.float32)


def matches(comments: DataFrame, rules: DataFrame, ambiguous: float = 98.0, gold: float = 99.2, key: str = "subreddit", apart: bool = False, slice_: int = SLICE, block: int = RULES) -> DataFrame:
    """SIM2: filters.matched over similarities() by numbers.thresholds, (key, comment_id, rule_index, score), without a table of scores.

    The products are made three times: counted by the upper half of a score's bits, by the lower half where the percentiles lie, and for each comment's best rule. So memory and shuffles grow with comments and rules, and only the arithmetic with their pairs. apart: a comment is not its own rule.
    """
    import numpy as np
    import pyarrow as pa

    pairs = lambda run, kinds: _met(comments, rules, key, slice_, block, run, kinds)

    def ordered(left: pa.Table, right: pa.Table):
        scores, known = _products(left["v"], right["v"])
        if apart:
            known &= left["comment_id"].to_numpy()[:, None] != right["rule_index"].to_numpy()[None, :]
        return _in_order(scores, known)

    def upper(left: pa.Table, right: pa.Table) -> pa.Table:
        found = ordered(left, right).ravel()
        n = np.bincount(found[found > 0] >> 16, minlength=1 << 16)
        some = np.flatnonzero(n)
        return pa.table({"bin": some, "n": n[some]})

    def counted(run) -> list[tuple[int, int]]:
        rows = pairs(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
        return sorted((r["bin"], r["n"]) for r in rows)

    def holding(bins: list[tuple[int, int]], places: list[int]) -> dict[int, tuple[int, int]]:
        """The bin of each place, and how many lie before the bin."""
        before = np.append(0, np.cumsum([n for _, n in bins]))
        at = np.searchsorted(before, places, "right") - 1
        return {k: (bins[i][0], int(before[i])) for k, i in zip(places, at, strict=True)}

    whole = counted(upper)  # at most 65536 rows
    total = sum(n for _, n in whole)
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((comments, key), (comments, "comment_id"), (rules, "rule_index"))}
    if not total:
        return comments.sparkSession.createDataFrame([], ", ".join(f"{c} {kind}" for c, kind in kinds.items()) + ", score float")
    shares = (ambiguous / 100, gold / 100)
    places = sorted({min(total - 1, int(q * (total - 1)) + i) for q in shares for i in (0, 1)})
    there = holding(whole, places)
    wanted = sorted({b for b, _ in there.values()})

    def lower(left: pa.Table, right: pa.Table) -> pa.Table:
        found = ordered(left, right).ravel()
        found = found[np.isin(found >> 16, np.array(wanted, np.uint32)) & (found > 0)]
        own, n = np.unique(found, return_counts=True)
        return pa.table({"bin": own.astype(np.int64), "n": n})

    fine = counted(lower)  # at most 65536 rows for each of four bins
    value = {}
    for k, (b, before) in there.items():
        value[k] = float(_from_order([holding([x for x in fine if x[0] >> 16 == b], [k - before])[k - before][0]])[0])
    cuts = []
    for q in shares:
        pos = q * (total - 1)
        a, b = value[int(pos)], value[min(total - 1, int(pos) + 1)]
        cuts.append(int(_in_order(np.array([a if a == b else a + (b - a) * (pos - int(pos))]).astype(np.float32), np.array([True]))[0]))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("rule_index")  # the first rule of equals
        found = ordered(left, right) if left.num_rows and right.num_rows else np.zeros((left.num_rows, 1), np.uint32)
        at = found.argmax(1)
        score = found[np.arange(len(at)), at]
        keep = np.flatnonzero(score > 0)
        out = left.select([key, "comment_id"]).take(pa.array(keep))
        return out.append_column("rule_index", right["rule_index"].take(pa.array(at[keep]))).append_column("best", pa.array(score[keep].astype(np.int64))).append_column("over", pa.array((found[keep] > cuts[0]).sum(1))).append_column("score", pa.array(_from_order(score[keep])))

    schema = ", ".join(f"{c} {kind}" for c, kind in kinds.items())
    rows = pairs(best, f"{schema}, best long, over long, score float").groupBy(key, "comment_id").agg(F.min(F.struct((-F.col("best")).alias("b"), "rule_index", "score")).alias("m"), F.sum("over").alias("over"))
    kept = rows.where((F.col("over") <= 1) & (-F.col("m.b") >= cuts[1]))
    return kept.select(key, "comment_id", "m.rule_index", "m.score")


def centroids(x, n: int, rounds: int = 8):
    """n centres of the rows of x, each start the farthest from those before it, by Lloyd's rounds."""
    import numpy as np

    at, near = [0], np.full(len(x), np.inf)
    while len(at) < min(n, len(x)):
        near = np.minimum(near, ((x - x[at[-1]]) ** 2).sum(1))
        at.append(int(near.argmax()))
    c = x[at]
    for _ in range(rounds):
        own = to_centroids(x, c).argmin(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        n_own = np.bincount(own, minlength=len(c))
        c = np.where(n_own[:, None] > 0, sums / np.maximum(n_own, 1)[:, None], c)
    return c


def to_centroids(x, c):
    """Distances of all rows of x to all of c."""
    import numpy as np

    square = (x**2).sum(1)[:, None] + (c**2).sum(1)[None, :] - 2 * (x @ c.T)
    return np.sqrt(np.maximum(square, 0.0))


def lengthened(x, most: float):
    """Rows with sqrt(most - |x|^2) behind: of these and of queries with a zero behind, the nearest has the largest inner product."""
    import numpy as np

    return np.column_stack([x, np.sqrt(np.maximum(0.0, most - (x**2).sum(1)))])


def vectors(column):
    """A column of equally long arrays as a matrix."""
    flat = column.combine_chunks().flatten() if hasattr(column, "combine_chunks") else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else flat.to_numpy(zero_copy_only=False).reshape(0, 0)


def inverted_file(queries: DataFrame, candidates: DataFrame, by: str | None = None, block: int = BLOCK) -> tuple[DataFrame, float, int, int]:
    """The staged file (id, v, bucket, query, list, ring, far, block) of candidates and queries side by side, the largest squared length of a candidate, and how many candidates and queries there are.

    list is the nearest centroid, ring the distance to it, far a query's distances to all. A block holds neighbouring rings of one list of one bucket.
    """
    import numpy as np
    import pyarrow as pa

    bucket = (F.col(by).cast("string") if by else F.lit("")).alias("bucket")
    given = [df.select("id", F.col("embedding").cast("array<double>").alias("v"), bucket, F.lit(kind).alias("query")).where("v IS NOT NULL AND bucket IS NOT NULL") for df, kind in ((candidates, False), (queries, True))]
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    both = given[0].unionByName(given[1])
    most, n, asked = both.agg(F.max(F.when(~F.col("query"), square)), F.count_if(~F.col("query")), F.count_if("query")).first()
    most, lists = float(most or 0.0), min(LISTS, -(-n // block))
    sample = given[0].orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect() if lists > 1 else []
    centres = centroids(lengthened(np.array([r["v"] for r in sample]), most), lists) if sample else None

    def placed(batches):
        for batch in batches:
            x, query = vectors(batch["v"]), batch["query"].to_numpy(zero_copy_only=False)
            far = np.zeros((len(x), 1))
            if centres is not None and len(x):
                x = lengthened(x, most)
                x[query, -1] = 0.0
                far = to_centroids(x, centres)
            near = far.argmin(1) if len(x) else np.zeros(0, int)
            kept = pa.array([r if q else None for q, r in zip(query, far, strict=True)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(far[np.arange(len(far)), near]), kept], names=[*batch.schema.names, "list", "ring", "far"])

    kind = candidates.schema["id"].dataType.simpleString()
    rows = both.mapInArrow(placed, f"id {kind}, v array<double>, bucket string, query boolean, list int, ring double, far array<double>")
    rows = numbered(rows, [F.asc(c) for c in ("bucket", "list", "ring", "id", "query")], "no")
    return staged(rows.withColumn("block", F.floor((F.col("no") - 1) / block)).drop("no"), "inverted-file"), most, n, asked


def _best_of_block(k: int, names: tuple[str, ...] = ("query_id", "candidate_id", "score")):
    """Of queries on the left, the k best candidates on the right."""
    import numpy as np
    import pyarrow as pa

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = left.schema.field("qid").type
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (kind, kind, pa.float64()), strict=True)})
        right = right.sort_by("cid")
        qids, ids = left["qid"].to_numpy(zero_copy_only=False), right["cid"].to_numpy(zero_copy_only=False)
        q, c = vectors(left["qv"]), vectors(right["cv"])
        out = []
        for start in range(0, len(q), 256):
            scores = q[start : start + 256] @ c.T
            scores[qids[start : start + 256, None] == ids[None, :]] = -np.inf
            order = np.argsort(-np.round(scores, 12), axis=1, kind="stable")[:, :k]  # the smaller id first among equals
            best = np.take_along_axis(scores, order, 1)
            at, place = np.nonzero(np.isfinite(best))
            out.append((start + at, order[at, place], best[at, place]))
        at, order, best = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({names[0]: left["qid"].take(pa.array(at)), names[1]: right["cid"].take(pa.array(order)), names[2]: pa.array(best)})

    return run


def nearest(queries: DataFrame, candidates: DataFrame, k: int, by: str | None = None, block: int = BLOCK) -> DataFrame:
    """SIM3, TOP1, RAG1: (query_id, candidate_id, score, rank) of the k best candidates of each query, itself left out, in the bucket of `by` or among all.

    queries and candidates: (id, embedding array<float> or array<double>, and by). Ties go to the smaller id. A query first looks through the block it lies in; its k-th score there bounds what else it needs. Slices of neighbouring queries then meet the blocks of their bucket that the bound leaves. Rows without a vector take no part.
    """
    import numpy as np
    import pyarrow as pa

    table, most, n, asked = inverted_file(queries, candidates, by, block)
    place = ["bucket", "list", "block"]
    q = table.where("query").select(*[F.col(c).alias(f"q_{c}") for c in place], F.col("id").alias("qid"), F.col("v").alias("qv"), "far")
    c = table.where("NOT query").select(*place, F.col("id").alias("cid"), F.col("v").alias("cv"), "ring")
    kind = table.schema["id"].dataType.simpleString()
    schema = f"query_id {kind}, candidate_id {kind}, score double"
    home = q.drop("far").groupBy(*[f"q_{c}" for c in place]).cogroup(c.drop("ring").groupBy(*place)).applyInArrow(_best_of_block(k), schema)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "candidate_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)
    if n + asked <= block:  # one block holds them all
        return best(home)
    home = staged(home, "own-blocks")
    kth = home.groupBy(F.col("query_id").alias("qid")).agg(F.when(F.count("*") >= k, F.min("score")).alias("low"))
    # So many blocks to a slice that it has about as many queries as a block has rows.
    bounded = q.join(kth, "qid", "left").withColumn("slice", F.floor(F.col("q_block") / max(1, (n + asked) // max(1, asked))))

    def bounds(group: pa.Table) -> pa.Table:
        far, low = vectors(group["far"]), group["low"].to_numpy(zero_copy_only=False).astype(float)
        own = (vectors(group["qv"]) ** 2).sum(1).max()
        return pa.table({"bucket": group["q_bucket"][:1], "slice": group["slice"][:1], "low": [float(np.nan_to_num(low, nan=-np.inf).min())], "own": [float(own)], "least": [far.min(0).tolist()], "largest": [far.max(0).tolist()]})

    slices = bounded.groupBy("q_bucket", "slice").applyInArrow(bounds, "bucket string, slice long, low double, own double, least array<double>, largest array<double>")
    blocks = c.groupBy(*place).agg(F.min("ring").alias("from"), F.max("ring").alias("to"))
    gap = F.greatest(F.lit(0.0), F.get("least", F.col("list")) - F.col("to"), F.col("from") - F.get("largest", F.col("list")))
    best_there = (F.col("own") + F.lit(most) - gap * gap) / 2 + F.lit(1e-9) * (F.col("own") + F.lit(most + 1.0))
    met = slices.join(blocks, "bucket").where(best_there >= F.col("low")).select("bucket", "slice", "list", "block")
    met = staged(met, "met-blocks")
    key = F.struct("bucket", "slice", "list", "block").alias("key")
    left = bounded.select(F.col("q_bucket").alias("bucket"), "slice", "q_list", "q_block", "qid", "qv").join(met, ["bucket", "slice"]).where("q_block <> block OR q_list <> list").select(key, "qid", "qv")
    right = c.join(met, place).select(key, "cid", "cv")
    away = left.groupBy("key").cogroup(right.groupBy("key")).applyInArrow(_best_of_block(k), schema)
    return best(home.union(away))


def mixed(ranked: DataFrame, k: int, kind: str = "thread_type") -> DataFrame:
    """RAG2: of each query's ranked candidates, the best ceil(k/2) violating and floor(k/2) compliant, filled up with the best of the rest. ranked must hold at least k of each kind where there are as many."""
    own = Window.partitionBy("query_id", kind).orderBy("rank")
    quota = F.when(F.col(kind) == "violating", (k + 1) // 2).otherwise(k // 2)
    rows = ranked.withColumn("_in", F.row_number().over(own) <= quota)
    rows = rows.withColumn("_tier", F.when(F.col("_in"), F.when(F.col(kind) == "violating", 0).otherwise(1)).otherwise(2))
    w = Window.partitionBy("query_id").orderBy("_tier", "rank")
    return rows.withColumn("position", F.row_number().over(w).cast("bigint")).where(F.col("position") <= k).drop("_in", "_tier")


def drawn(queries: DataFrame, candidates: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """RAG2, random: for each query k candidates of its bucket, itself left out, drawn without replacement by digests of its own id.

    Candidates are numbered within their bucket; a query's digests name places in it, the same one once, and where a small bucket gives too few different ones, those that follow the first. So draws of two queries have nothing to do with each other, and a query reads k + 1 rows, not its bucket.
    """
    bucket = F.col(by).cast("string") if by else F.lit("")
    number = lambda *parts: F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("bigint")
    c = candidates.select(F.col("id").alias("cid"), bucket.alias("bucket"), F.md5(F.concat(F.lit("drawn:"), F.col("id").cast("string"))).alias("_p"))
    c = numbered(c, [F.asc("bucket"), F.asc("_p"), F.asc("cid")], "_no")
    n = c.groupBy("bucket").agg(F.count("*").alias("_n"), F.min("_no").alias("_first"))
    c = c.join(n.select("bucket", "_first"), "bucket").withColumn("at", F.col("_no") - F.col("_first"))
    q = queries.select(F.col("id").alias("qid"), bucket.alias("bucket")).join(n, "bucket")
    qid = F.col("qid").cast("string")
    places = F.transform(F.sequence(F.lit(0), F.lit(3 * k + 15)), lambda r: number(qid, r.cast("string")) % F.col("_n"))
    following = F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: (number(qid, F.lit("0")) + i) % F.col("_n"))
    q = q.select("qid", "bucket", F.posexplode(F.slice(F.array_distinct(F.concat(places, following)), 1, k + 1)).alias("step", "at"))
    rows = q.join(c, ["bucket", "at"]).where("qid <> cid")
    own = Window.partitionBy("qid").orderBy("step")
    return rows.select(F.col("qid").alias("query_id"), F.col("cid").alias("candidate_id"), F.lit(0.0).alias("score"), F.row_number().over(own).cast("bigint").alias("rank")).where(F.col("rank") <= k)


def vote(ranked: DataFrame, rule: str = "rule", options: DataFrame | None = None) -> DataFrame:
    """AGG17: each query's rule with most votes, then the largest score sum, then the best first rank; rules that are not among its options do not count."""
    rows = ranked if options is None else ranked.join(options, ["query_id", rule], "left_semi")
    sums = rows.groupBy("query_id", rule).agg(F.count("*").alias("votes"), F.round(F.sum("score"), 9).alias("score_sum"), F.min("rank").alias("first_rank"))
    best = sums.groupBy("query_id").agg(F.min_by(F.struct(rule, "votes", "score_sum", "first_rank"), F.struct(-F.col("votes"), -F.col("score_sum"), F.col("first_rank"))).alias("r"))
    return best.select("query_id", F.col(f"r.{rule}").alias("predicted"), "r.votes", "r.score_sum", "r.first_rank")


def targets(pairs: DataFrame) -> DataFrame:
    """PRJ6, RAG4: two targets for each pair, keyed `split:mod_comment_id:thread_type`."""
    both = F.array(*[F.struct(F.lit(t).alias("thread_type"), F.col(f"{t}_comment_id").alias("comment_id"), F.col(f"{t}_correct_answer").alias("correct_answer"), F.col(f"{t}_thread").alias("thread")) for t in ("violating", "compliant")])
    rest = [c for c in ("split", "mod_comment_id", "submission_id", "subreddit", "subreddit_cluster_id", "subreddit_cluster_label", "rule_cluster_id", "rule_cluster_label", "rule") if c in pairs.columns]
    rows = pairs.select(*rest, F.inline(both))
    return rows.withColumn("target_key", F.concat_ws(":", "split", "mod_comment_id", "thread_type"))


def target_text(subreddit: Column, rules: Column, body: Column) -> Column:
    """PRJ7: what is embedded for a target; blank bodies are marked."""
    return F.concat(F.lit("r/"), subreddit, F.lit("\n"), rules, F.lit("\n"), F.when(F.trim(F.coalesce(body, F.lit(""))) == "", "[empty]").otherwise(body))


def provenance(selected: DataFrame) -> DataFrame:
    """RAG5: each query's chosen examples as one array in order."""
    return selected.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "candidate_id", "score"))), lambda e: F.struct(e["candidate_id"].alias("target_key"), e["score"].alias("score"))).alias("examples"))


def lookup(pairs: DataFrame, renderable_only: bool = False) -> DataFrame:
    """RAG4: targets of pairs without media, by target_key; for random retrieval only those whose last comment can be shown."""
    from .filters import pair_has_media, renderable

    rows = targets(pairs.where(~pair_has_media()))
    return rows.where(renderable("thread")) if renderable_only else rows


def prepared(queries: DataFrame, selected: DataFrame, split: str, source_split: str, artifact: dict[str, str] | None = None, traces: DataFrame | None = None) -> DataFrame:
    """RAG3: (id, examples) of every query, empty where nothing was selected for it.

    artifact: query_split and candidate_split of a stored ranking, which must be those asked for. traces: (target_key, trace), attached where there is one.
    """
    for name, wanted in (("query_split", split), ("candidate_split", source_split)):
        if artifact is not None and artifact.get(name) != wanted:
            raise ValueError(f"{name} of the ranking is {artifact.get(name)}, not {wanted}")
    found = selected if traces is None else selected.join(traces.select(F.col("target_key").alias("candidate_id"), "trace"), "candidate_id", "left")
    if traces is None:
        return examples(queries, found)
    entry = F.struct("rank", F.col("candidate_id").alias("target_key"), "score", "trace")
    own = found.groupBy(F.col("query_id").alias("id")).agg(F.array_sort(F.collect_list(entry)).alias("examples"))
    return queries.join(own, "id", "left").withColumn("examples", F.coalesce("examples", F.array().cast(own.schema["examples"].dataType)))


def examples(queries: DataFrame, selected: DataFrame) -> DataFrame:
    """RAG3: each query with its examples, an empty array where there is none."""
    none = F.from_json(F.lit("[]"), F.lit(f"array<struct<target_key:{selected.schema['candidate_id'].dataType.simpleString()},score:double>>"))
    rows = queries.join(provenance(selected).withColumnRenamed("query_id", "id"), "id", "left")
    return rows.withColumn("examples", F.coalesce("examples", none))
