"""Hard negatives by exact integer products: Strassen's multiplication on tiles of anchors and candidates, heaps that merge.

Rows are scaled to integers and cut into tiles of candidates; anchors are dealt into blocks. Both lie in the shared folder, only
their numbers are shuffled, and a task takes one block after the other against some tiles. A product of a block and a
tile is Strassen's: quarters padded with zeros to even sides, seven products of sums, down to small leaves. int64 sums
and products wrap modulo 2**64 and nothing is divided, so a score that fits into 64 bits is right whatever its terms are.

Two passes: the first keeps the best rows of the anchor's label (the positive heap), the second the best rows of other labels
within each positive's window (the window heaps). A heap is a sorted run of at most k (score, id); two merge into the k
best of both, in a task over its tiles, then between tasks. Windows that a score of a tile cannot enter are skipped by comparison.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.llm import shared as S

LEAF = 32
BLOCK = 1024  # anchors of a block, about
TILE_BYTES = 1 << 25  # of a tile of candidates
STEP = 4096  # candidates that are multiplied at once
NONE = -(2**63)


# ---------------------------------------------------------------- products


def _even(x: np.ndarray) -> np.ndarray:
    rows, cols = x.shape
    return np.pad(x, ((0, rows % 2), (0, cols % 2))) if rows % 2 or cols % 2 else x


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b; where every partial sum is below 2**53, doubles hold the same integers and their product is faster."""
    top = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64) if top < 2**53 else a @ b


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of int64 matrices, modulo 2**64."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= LEAF:
        return _leaf(a, b)
    a, b = _even(a), _even(b)
    r, s, c = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:r, :s], a[:r, s:], a[r:, :s], a[r:, s:]
    b11, b12, b21, b22 = b[:s, :c], b[:s, c:], b[s:, :c], b[s:, c:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * r, 2 * c), np.int64)
    out[:r, :c], out[:r, c:] = p1 + p4 - p5 + p7, p3 + p5
    out[r:, :c], out[r:, c:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, integers held as doubles; beyond 64 bits the nearest 64-bit integer."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if top < 2**62:
        return strassen(a.astype(np.int64), np.ascontiguousarray(b.astype(np.int64).T))
    whole = lambda x: np.array([int(v) for v in x.ravel()], object).reshape(x.shape)
    return np.clip(whole(a) @ whole(b).T, NONE + 1, 2**63 - 1).astype(np.int64)


# ---------------------------------------------------------------- heaps


class Heaps:
    """k best (score, id) of each of n windows lo..hi, scores from high to low, ties by smaller id."""

    def __init__(self, n: int, k: int, lo: np.ndarray | None = None, hi: np.ndarray | None = None):
        self.k = k
        self.lo = np.full(n, NONE + 1, np.int64) if lo is None else lo
        self.hi = np.full(n, 2**63 - 1, np.int64) if hi is None else hi
        self.score = np.full((n, k), NONE, np.int64)
        self.id = np.zeros((n, k), np.int64)

    def offer(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, out: np.ndarray | None = None) -> None:
        """Scores (one row for each of `rows`, one column an id) but for those that `out` marks."""
        fits = (score >= np.maximum(self.lo[rows], self.score[rows, -1])[:, None]) & (score <= self.hi[rows][:, None])
        if out is not None:
            fits &= ~out
        at, col = np.nonzero(fits)
        if not len(at):
            return
        touched, at = np.unique(at, return_inverse=True)
        old = self.score[rows[touched]] > NONE
        held, place = np.nonzero(old)
        who = np.r_[at, held]
        value = np.r_[score[touched[at], col], self.score[rows[touched]][held, place]]
        name = np.r_[ids[col], self.id[rows[touched]][held, place]]
        order = np.lexsort((name, ~value, who))
        who, value, name = who[order], value[order], name[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        keep = rank < self.k
        new_score, new_id = np.full((len(touched), self.k), NONE, np.int64), np.zeros((len(touched), self.k), np.int64)
        new_score[who[keep], rank[keep]], new_id[who[keep], rank[keep]] = value[keep], name[keep]
        self.score[rows[touched]], self.id[rows[touched]] = new_score, new_id


def bounds(positive: int, low: int, high: int) -> tuple[int, int]:
    """Scores s with low * positive <= 100 * s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


# ---------------------------------------------------------------- tiles and blocks


def _tiler(folder: str):
    def cut(batches):
        """Writes the rows, sorted by dimensions and id, as tiles; their names."""
        from pyspark import TaskContext

        part, k, d = TaskContext.get().partitionId(), 0, None
        held: list[tuple] = []

        def tile():
            name = f"{part}-{k}"
            rows = sorted(held, key=lambda r: (r[1], r[0]))  # by label, so that a label is one run
            S.write_array(folder, f"ids-{name}", np.array([r[0] for r in rows], np.int64))
            S.write_array(folder, f"labels-{name}", np.array([r[1] for r in rows], np.int64))
            S.write_array(folder, f"x-{name}", np.array([r[2] for r in rows], np.float64))
            return pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "tile": pa.array([name]), "rows": pa.array([len(rows)], pa.int64())})

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "x")), strict=True):
                if held and (len(row[2]) != d or 8 * len(held) * max(d, 1) >= TILE_BYTES):
                    yield tile()
                    held, k = [], k + 1
                d = len(row[2])
                held.append((*row[:2], np.array(row[2], np.float64)))
        if held:
            yield tile()

    return cut


def _blocker(folder: str):
    def write(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("vec_id", "label", "x")), strict=True), key=lambda r: (r[1], r[0]))
        name = f"{key[0].as_py()}-{key[1].as_py()}"
        S.write_array(folder, f"anchors-{name}", np.array([r[0] for r in rows], np.int64))
        S.write_array(folder, f"labels-{name}", np.array([r[1] for r in rows], np.int64))
        S.write_array(folder, f"x-{name}", np.array([r[2] for r in rows], np.float64))
        return pa.table({"d": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int64())})

    return write


def _runs(batches):
    """(block, its tiles) of rows that are sorted by block; a task's tiles of a block are one run unless it is cut between batches."""
    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("d", "block", "tile")), strict=True))
        lo = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i][:2] != rows[lo][:2]:
                yield rows[lo][0], f"{rows[lo][0]}-{rows[lo][1]}", [r[2] for r in rows[lo:i]]
                lo = i


def _steps(first: int, end: int):
    """Slices of candidates; the first are short, so that heaps have a lowest score before the long ones are compared with it."""
    size = 128
    while first < end:
        yield slice(first, min(end, first + size))
        first, size = first + size, min(2 * size, STEP)


PAIRS = "anchor_id long, positive_id long, id long, score long, positive_score long"


def _emit(anchors, positives, heaps: Heaps, positive_scores) -> pa.RecordBatch:
    w, place = np.nonzero(heaps.score > NONE)
    arrays = [anchors[w], positives[w], heaps.id[w, place], heaps.score[w, place], positive_scores[w]]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], ["anchor_id", "positive_id", "id", "score", "positive_score"])


def _positives(tiles: str, blocks: str, k: int):
    def find(batches):
        t, b = S.Arrays(tiles, 64), S.Arrays(blocks, 64)
        for d, block, names in _runs(batches):
            anchors, labels = b.get(f"anchors-{block}", np.int64), b.get(f"labels-{block}", np.int64)
            x = b.get(f"x-{block}", np.float64).reshape(len(anchors), d)
            heaps = Heaps(len(anchors), k)
            for name in names:
                ids, kinds = t.get(f"ids-{name}", np.int64), t.get(f"labels-{name}", np.int64)
                y = t.get(f"x-{name}", np.float64).reshape(len(ids), d)
                for label in np.intersect1d(labels, kinds):
                    rows = np.arange(*np.searchsorted(labels, [label, label + 1]))
                    first, end = np.searchsorted(kinds, [label, label + 1])
                    for at in _steps(first, end):
                        heaps.offer(rows, scores(x[rows], y[at]), ids[at], anchors[rows][:, None] == ids[at][None, :])
            yield _emit(anchors, anchors, heaps, np.zeros(len(anchors), np.int64))

    return find


def _window_writer(folder: str, low: int, high: int):
    def write(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("anchor_id", "positive_id", "positive_score")), strict=True))
        name = f"{key[0].as_py()}-{key[1].as_py()}"
        edges = [bounds(r[2], low, high) for r in rows]
        S.write_array(folder, f"windows-{name}", np.array([(*r, *e) for r, e in zip(rows, edges, strict=True)], np.int64))
        return pa.table({"d": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int64())})

    return write


def _negatives(tiles: str, blocks: str, k: int):
    def find(batches):
        t, b = S.Arrays(tiles, 64), S.Arrays(blocks, 64)
        for d, block, names in _runs(batches):
            anchors, labels = b.get(f"anchors-{block}", np.int64), b.get(f"labels-{block}", np.int64)
            x = b.get(f"x-{block}", np.float64).reshape(len(anchors), d)
            windows = b.get(f"windows-{block}", np.int64).reshape(-1, 5)
            order = np.argsort(anchors)
            row = order[np.searchsorted(anchors, windows[:, 0], sorter=order)]
            nth = np.arange(len(windows)) - np.searchsorted(windows[:, 0], windows[:, 0])
            heaps = Heaps(len(windows), k, windows[:, 3], windows[:, 4])
            open_ = windows[:, 3] <= windows[:, 4]
            for name in names:
                ids, kinds = t.get(f"ids-{name}", np.int64), t.get(f"labels-{name}", np.int64)
                y = t.get(f"x-{name}", np.float64).reshape(len(ids), d)
                for at in _steps(0, len(ids)):
                    score, same = scores(x, y[at]), labels[:, None] == kinds[at][None, :]
                    for i in range(int(nth.max(initial=-1)) + 1):  # the i-th window of every anchor at once
                        w = np.flatnonzero((nth == i) & open_)
                        heaps.offer(w, score[row[w]], ids[at], same[row[w]])
            yield _emit(windows[:, 0], windows[:, 1], heaps, windows[:, 2])

    return find


# ---------------------------------------------------------------- the operator


def _best(found: DataFrame, by: list[str], k: int, place: str) -> DataFrame:
    """The k best of each heap from all tasks: first within salts, so that no group holds what all tasks sent."""
    order = [F.col("score").desc(), F.col("id").asc()]
    salted = found.withColumn("salt", F.pmod(F.col("id"), F.lit(64)))
    first = salted.withColumn(place, F.row_number().over(Window.partitionBy(*by, "salt").orderBy(*order))).where(F.col(place) <= k)
    return first.withColumn(place, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(place) <= k).drop("salt")


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor and label are expressions over vec_id and label. A row's components become floor(scale * x); its score is the inner
    product with the anchor's, higher first, ties by smaller vec_id. An anchor's positives are its first `positives` other rows of
    the same label, a positive's negatives the first `negatives` rows of another label with
    low * positive_score <= 100 * score <= high * positive_score. Fewer rows give fewer results; a negative positive_score gives none.

    Rows with a null id, label or vector, or a component that is null or not finite (before or after scaling), take no part.
    Vectors of different lengths don't meet. Rows that repeat a vec_id count once, with the smallest label and vector. Scores beyond
    64 bits become the nearest 64-bit integer. An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.selectExpr("cast(vec_id as bigint) AS vec_id", "cast(label as bigint) AS label", "cast(embedding as array<double>) AS e")
    rows = rows.withColumn("label", label).withColumn("x", F.expr(f"transform(e, v -> v * {float(scale)}D)"))
    rows = rows.where("vec_id is not null and label is not null and e is not null and forall(x, v -> v is not null and not isnan(v) and abs(v) < double('Infinity'))")
    # floor() of a double is a long in SQL; from 2**53 on doubles are integers already
    rows = rows.withColumn("x", F.expr("transform(x, v -> if(abs(v) < 9007199254740992D, double(floor(v)), v))"))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.label", "r.x", F.size("r.x").alias("d"))
    rows = S.stored(rows, "rows")
    tiles, blocks = S.table_path(spark, "tiles"), S.table_path(spark, "blocks")
    shape = "d int, tile string, rows long"
    cut = S.stored(S.spread(rows).sortWithinPartitions("d", "vec_id").mapInArrow(_tiler(tiles), shape), "tiled")

    anchors = rows.where(is_anchor)
    sizes = anchors.groupBy("d").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))  # a row for each length of vectors
    dealt = anchors.join(sizes, "d").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    key = S.stored(dealt.groupBy("d", "block").applyInArrow(_blocker(blocks), "d int, block long"), "blocked")
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # names only: every block with every tile of its length, some tiles of a block to a task
    grid = cut.join(sizes, "d").select("d", "tile", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block")).join(key, ["d", "block"], "left_semi")
    grid = grid.repartition(n, "d", "block", F.pmod(F.xxhash64("tile"), F.lit(64))).sortWithinPartitions("d", "block", "tile")

    found = grid.mapInArrow(_positives(tiles, blocks, positives), PAIRS)
    best = _best(found, ["anchor_id"], positives, "rank").select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    windows = best.join(dealt.select(F.col("vec_id").alias("anchor_id"), "d", "block"), "anchor_id")
    S.stored(windows.groupBy("d", "block").applyInArrow(_window_writer(blocks, low, high), "d int, block long"), "windowed")
    found = grid.mapInArrow(_negatives(tiles, blocks, negatives), PAIRS)
    best = _best(found, ["anchor_id", "positive_id"], negatives, "rank")
    return best.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
