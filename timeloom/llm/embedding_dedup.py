"""Embedding near-duplicates by PCA-ordered tiled comparison, exact in double precision.

Unit vectors are rotated onto the principal axes of the whole table, so the leading dimensions carry most of a
product. They are sorted along the first axes and cut into tiles, which lie in the shared folder. Two tiles meet only
if their boxes in the leading axes come near enough (an equi-join on cells of the first three axes finds them); only
the tiles' numbers are shuffled, and a task reads the two tiles it compares. The products of the leading dimensions
are taken first; the rest of a product is at most the product of the suffix norms, and where the sum cannot reach the
threshold the comparison stops. Rotation rounds, so products within `NEAR` of the threshold are decided by the
cosine of the vectors as given: sum of products / (norm * norm), each in double precision. Equal vectors are one class
from the start, links are counted in the tile and only a spanning forest of them leaves it, so no group emits its pairs.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm import shared as S

TILE = 1024
BOX = 8  # leading dimensions of a tile's box
CELL = 3  # of these, as many make the cells of the join and the order of the tiles
STEPS = (8, 24)  # dimensions after which a comparison may stop
NEAR = 1e-9  # far above the rounding of rotated products


def _given(batches):
    """key: digest of the vector, null where it can't be linked; vector: scaled by a power of two, which rounds nothing."""
    for batch in batches:
        keys, vectors = [], []
        for v in batch.column("embedding").to_pylist():
            x = None
            if v and None not in v:
                x = np.array(v, np.float64)
                top = np.abs(x).max()
                x = np.ldexp(x, -int(np.frexp(top)[1])).tobytes() if np.isfinite(top) and top > 0 else None
            vectors.append(x)
            keys.append(None if x is None else hashlib.blake2b(x, digest_size=16).digest())
        yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "key": pa.array(keys, pa.binary()), "vector": pa.array(vectors, pa.binary())})


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _moments(batches):
    from pyspark import TaskContext

    total = None
    for batch in batches:
        x = _matrix(batch.column("vector"))
        if len(x):
            x = _units(x)
            total = (0 if total is None else total) + x.T @ x
    if total is not None:
        yield pa.RecordBatch.from_pydict({"salt": pa.array([TaskContext.get().partitionId() % 64], pa.int32()), "moments": pa.array([total.tobytes()], pa.binary())})


def _sum_moments(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x) for x in table["moments"].to_pylist())
    return pa.table({"salt": pa.array([0], pa.int32()), "moments": pa.array([total.tobytes()], pa.binary())})


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows)).reshape(len(rows), -1) if rows else np.zeros((0, 0))


def _rotator(axes):
    def rotate(batches):
        for batch in batches:
            y = _units(_matrix(batch.column("vector"))) @ axes.value if batch.num_rows else np.zeros((0, CELL))
            lead = np.zeros((len(y), CELL))
            lead[:, : min(CELL, y.shape[1])] = y[:, :CELL]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("rep", "n", "vector")), pa.array([r.tobytes() for r in y], pa.binary()), *(pa.array(lead[:, k]) for k in range(CELL))],
                ["rep", "n", "vector", "y", *(f"y{k}" for k in range(CELL))],
            )

    return rotate


def _tiles(folder: str):
    def cut(batches):
        """Writes tiles into the folder; their numbers and boxes."""
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def tile(rows):
            number = (part << 32) + k
            y = np.frombuffer(b"".join(r[3] for r in rows)).reshape(len(rows), -1)
            S.write_array(folder, f"y-{number}", y)
            S.write_array(folder, f"x-{number}", np.frombuffer(b"".join(r[2] for r in rows)))
            S.write_array(folder, f"ids-{number}", np.array([r[:2] for r in rows], np.int64))
            lead = np.zeros((len(rows), BOX))
            lead[:, : min(BOX, y.shape[1])] = y[:, :BOX]
            return pa.RecordBatch.from_pydict({"tile": pa.array([number], pa.int64()), "lo": pa.array([lead.min(0)], pa.list_(pa.float64())), "hi": pa.array([lead.max(0)], pa.list_(pa.float64()))})

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("rep", "n", "vector", "y")), strict=True)
            while len(held) >= TILE:
                yield tile(held[:TILE])
                held, k = held[TILE:], k + 1
        if held:
            yield tile(held)

    return cut


def linked(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows of a and b have a product of at least threshold; rows and columns of those too near to it to tell."""
    d = a.shape[1]
    total, done = np.zeros((len(a), len(b))), 0
    for step in (s for s in STEPS if s < d):
        total += a[:, done:step] @ b[:, done:step].T
        done = step
        rest = np.sqrt((a[:, done:] ** 2).sum(1))[:, None] * np.sqrt((b[:, done:] ** 2).sum(1))
        open_ = total + rest >= threshold - NEAR
        n = int(open_.sum())
        if n < 0.05 * open_.size:
            i, j = np.nonzero(open_)
            value = np.concatenate([np.zeros(0), *(np.einsum("kd,kd->k", a[i[lo : lo + 65_536]], b[j[lo : lo + 65_536]]) for lo in range(0, n, 65_536))])
            open_[i, j] = value >= threshold
            near = np.abs(value - threshold) < NEAR
            return open_, i[near], j[near]
    total += a[:, done:] @ b[:, done:].T
    return total >= threshold, *np.nonzero(np.abs(total - threshold) < NEAR)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the rows of x and y: sum of products / (norm * norm)."""
    dot = lambda p, q: np.array([math.fsum(r) for r in p * q])
    return dot(x, y) / (np.sqrt(dot(x, x)) * np.sqrt(dot(y, y)))


def _comparer(threshold: float, folder: str, d: int):
    def tile(arrays: S.Arrays, kind: str, number: int) -> np.ndarray:
        return arrays.get(f"{kind}-{number}", np.int64 if kind == "ids" else np.float64).reshape(-1, 2 if kind == "ids" else d)

    def compare(batches):
        arrays = S.Arrays(folder, 64)
        for batch in batches:
            for ta, tb in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
                ia, na = tile(arrays, "ids", ta).T
                ib, nb = tile(arrays, "ids", tb).T
                hit, i, j = linked(tile(arrays, "y", ta), tile(arrays, "y", tb), threshold)
                for lo in range(0, len(i), 4096):
                    p, q = i[lo : lo + 4096], j[lo : lo + 4096]
                    hit[p, q] = cosines(tile(arrays, "x", ta)[p], tile(arrays, "x", tb)[q]) >= threshold
                same = ta == tb
                if same:
                    np.fill_diagonal(hit, False)
                if not hit.any():
                    continue
                count = dict(zip(ia.tolist(), (hit @ nb).tolist(), strict=True))
                if not same:
                    count |= dict(zip(ib.tolist(), (na @ hit).tolist(), strict=True))
                count = {k: v for k, v in count.items() if v}
                edges = _forest(hit, ia, ib, same)
                yield pa.RecordBatch.from_pydict({
                    "a": pa.array([*count, *(x for x, _ in edges)], pa.int64()), "b": pa.array([*[None] * len(count), *(y for _, y in edges)], pa.int64()),
                    "links": pa.array([*count.values(), *[None] * len(edges)], pa.int64()),
                })

    return compare


def _forest(hit: np.ndarray, ia: np.ndarray, ib: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Each component of the tile's links as a star around one of its rows."""
    left = hit.any(1)
    edges = []
    while left.any():
        seed = int(np.argmax(left))
        rows = np.zeros(len(ia), bool)
        rows[seed] = True
        cols = np.zeros(len(ib), bool)
        new = rows
        while new.any():
            reach = hit[new].any(0) & ~cols
            cols |= reach
            new = hit[:, reach].any(1) & ~rows
            if same:
                new |= reach & ~rows
            rows |= new
        left &= ~rows
        members = {*ia[rows].tolist(), *ib[cols].tolist()} - {int(ia[seed])}
        edges += [(int(ia[seed]), m) for m in members]
    return edges


def embedding_dedup(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
    different lengths don't link. A cosine of exactly the threshold links. Rows that repeat a vec_id must repeat its
    vector and count once. An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    units = S.stored(vectors.mapInArrow(_given, "vec_id long, key binary, vector binary"), "vectors")
    classes = units.where("key is not null").dropDuplicates(["vec_id", "key"]).groupBy("key").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    classes = S.stored(classes, "classes")
    found = None
    for size in [r[0] for r in classes.select(F.length("vector").alias("d")).distinct().collect()]:  # the distinct lengths of vectors: one, as a rule
        part = _links(classes.where(F.length("vector") == size), size // 8, threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return units.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = S.stored(found, "links")
    label = S.components(found.where("links is null").select("a", "b"))
    links = found.where("links is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    joined = classes.select("key", "rep", "n").join(links, "rep", "left").join(label.withColumnRenamed("id", "rep"), "rep", "left")
    of = joined.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    return units.select("vec_id", "key").join(of, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
        (F.coalesce("component", "vec_id") == F.col("vec_id")).alias("kept"))


def _links(classes: DataFrame, d: int, threshold: float) -> DataFrame:
    """a, links: how many vectors link with class a across a pair of tiles; a, b: edges of its components."""
    spark = classes.sparkSession
    kind = "salt int, moments binary"
    sums = classes.select("vector").mapInArrow(_moments, kind).groupBy("salt").applyInArrow(_sum_moments, kind).groupBy("salt").applyInArrow(_sum_moments, kind)
    moments = np.frombuffer(sums.collect()[0]["moments"]).reshape(d, d)  # d x d, whatever the input
    axes = spark.sparkContext.broadcast(np.ascontiguousarray(np.linalg.eigh(moments)[1][:, ::-1]))
    lead = [f"y{k}" for k in range(CELL)]
    rotated = classes.select("rep", "n", "vector").mapInArrow(_rotator(axes), "rep long, n long, vector binary, y binary, " + ", ".join(f"{c} double" for c in lead))
    reach = math.sqrt(2 - 2 * threshold) + 1e-6
    order = [F.floor(F.col(c) / (reach / 2)).alias(f"c{k}") for k, c in enumerate(lead)]
    ordered = rotated.select("*", *order)
    by = [f"c{k}" for k in range(CELL)] + lead[-1:]
    folder = S.table_path(spark, "tiles")
    ranged = ordered.repartitionByRange(*by).sortWithinPartitions(*by, "rep").select("rep", "n", "vector", "y")
    boxes = S.stored(ranged.mapInArrow(_tiles(folder), "tile long, lo array<double>, hi array<double>"), "boxes")

    def cells(more: float, s: str):
        """A row for each cell that the box, wider by `more`, meets; with the first cell it meets on each axis."""
        out = boxes.select(F.col("tile").alias(f"t{s}"), F.col("lo").alias(f"l{s}"), F.col("hi").alias(f"h{s}"))
        for k in range(CELL):
            low, high = F.floor((F.col(f"l{s}")[k] - more) / reach), F.floor((F.col(f"h{s}")[k] + more) / reach)
            out = out.withColumn(f"f{s}{k}", low).withColumn(f"c{k}", F.explode(F.sequence(low, high)))
        return out

    gap = sum((F.greatest(F.lit(0.0), F.col("la")[k] - F.col("hb")[k], F.col("lb")[k] - F.col("ha")[k]) ** 2 for k in range(BOX)), F.lit(0.0))
    once = [F.col(f"c{k}") == F.greatest(f"fa{k}", f"fb{k}") for k in range(CELL)]  # of the cells that two boxes share, the first
    near = cells(reach, "a").join(cells(0.0, "b"), [f"c{k}" for k in range(CELL)])
    for condition in [F.col("ta") <= F.col("tb"), gap <= reach**2, *once]:
        near = near.where(condition)
    # the rows are small and the work behind them is not, so their number of partitions is given
    pairs = near.select("ta", "tb").repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "ta", F.pmod("tb", F.lit(4)))
    return pairs.mapInArrow(_comparer(threshold, folder, d), "a long, b long, links long")
