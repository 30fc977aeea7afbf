"""N-gram Jaccard join over a token-group matrix.

Documents with the same shingle set are one class. A class with more shingles of its own than a linked set may lack
links with nothing; that is told from a share of all shingles, picked by their hash, and leaves the candidates. These
are partitioned into groups of similar documents, about `GROUP` shingles a group, and each group stores its token
union and, for each document, the places of its shingles in it: a token-group matrix of whole sets. The overlap of
a query group's documents with another group's union bounds what they can share with any document in it; only groups
with documents that reach the bound are opened, and compared exactly.

Which groups meet is found without loss by signatures. Two linked sets differ in at most k shingles, so if the hash
deals all shingles to more than k parts, one part at least is the same in both. A signature is the digest of one part.
k grows with the size, so there is a deal for each class of sizes, and a set is dealt for every class that a smaller
partner may have. Documents of a group share their most frequent signature.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm import shared as S

U64 = np.uint64
GROUP = 300_000  # shingles of a group's documents together, about
PER_DOC = 64  # what a document counts for besides its shingles


def size_classes() -> np.ndarray:
    """First sizes of the classes."""
    bounds = [1]
    while bounds[-1] < 2**40:
        bounds.append(max(bounds[-1] + 1, bounds[-1] * 7 // 5))
    return np.array(bounds)


BOUNDS = size_classes()


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """Of one set: two linked sets that differ share at least one."""
    n = len(s)
    mixed = S.mix(s ^ U64(0x632BE59BD9B4E019))
    out = []
    first, last = np.searchsorted(BOUNDS, [-(-percent * n // 100), n], "right") - 1
    for c in range(int(first), int(last) + 1):
        k = int(BOUNDS[c + 1] - 1) * (100 - percent) // percent
        m = k + 1 + (k + 1) // 6
        part = (mixed % U64(m)).astype(np.int64)
        sums = np.zeros(m, np.uint64)
        np.add.at(sums, part, mixed)
        sums = S.mix(sums + (np.arange(m, dtype=np.uint64) + U64(1)) * U64(0x9E3779B97F4A7C15) + U64((c + 1) * 0xC2B2AE3D27D4EB4F % 2**64))
        filled = np.bincount(part, minlength=m) > 0
        # k parts at most differ: with more than k filled ones the k + 1 least signatures of these suffice, otherwise empty parts count too
        out.append(np.sort(sums[filled])[: k + 1] if filled.sum() > k else sums)
    return np.concatenate(out)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    off = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat))


def _digest(s: np.ndarray) -> tuple[int, int]:
    return (int(s.sum().astype(np.int64)), int(np.bitwise_xor.reduce(S.mix(s)).astype(np.int64))) if len(s) else (0, 0)


def _signer(width: int, percent: int):
    rate = U64(min(65536, (100 - percent) * 65536 * 5 // 300))

    def sign(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, buf, off in S.pieces(batch.column("text")):
                h, row = S.words(buf, off)
                sets = S.shingles(h, row, hi - lo, width)
                h1, h2 = zip(*map(_digest, sets), strict=True)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": ids.slice(lo, hi - lo), "n": pa.array([len(s) for s in sets], pa.int32()), "h1": pa.array(h1, pa.int64()), "h2": pa.array(h2, pa.int64()),
                    "picked": _lists([s[(s & U64(0xFFFF)) < rate] for s in sets]),
                })

    return sign


def _setter(width: int, percent: int):
    def sets(batches):
        for batch in batches:
            for lo, hi, buf, off in S.pieces(batch.column("text")):
                h, row = S.words(buf, off)
                found = S.shingles(h, row, hi - lo, width)
                own = np.array(batch.column("h1"))[lo:hi]
                keep = [k for k, s in enumerate(found) if len(s) and _digest(s)[0] == own[k]]  # a repeated doc_id may have other texts
                yield pa.RecordBatch.from_pydict({
                    "h1": pa.array(own[keep], pa.int64()), "n": pa.array([len(found[k]) for k in keep], pa.int32()),
                    "set": pa.array([found[k].tobytes() for k in keep], pa.binary()), "signatures": _lists([signatures(found[k], percent) for k in keep]),
                })

    return sets


# ---------------------------------------------------------------- groups


class Group:
    """ids of the documents, their token union, and the places of each one's shingles in it."""

    def __init__(self, ids: np.ndarray, union: np.ndarray, size: np.ndarray, at: np.ndarray):
        self.ids, self.union, self.size, self.at = ids, union, size, at
        self.begin = np.r_[0, np.cumsum(size)[:-1]].astype(np.int64)

    @classmethod
    def of(cls, sets: dict[int, np.ndarray]) -> Group:
        union, at = np.unique(np.concatenate(list(sets.values())), return_inverse=True)
        return cls(np.array(list(sets), np.int64), union, np.array([len(s) for s in sets.values()]), at.astype(np.uint32))

    def overlaps(self, mark: np.ndarray, docs: np.ndarray | None = None) -> np.ndarray:
        """How many shingles of each document are marked."""
        if docs is None:
            return np.add.reduceat(mark[self.at], self.begin, dtype=np.int64)
        size = self.size[docs]
        begin = np.r_[0, np.cumsum(size)[:-1]]
        return np.add.reduceat(mark[self.at[np.repeat(self.begin[docs] - begin, size) + np.arange(size.sum())]], begin, dtype=np.int64)


def links(a: Group, b: Group | None, percent: int) -> list[tuple[int, int]]:
    """Links that connect what is linked within a (b None) or between a and b; no pair that is already connected is compared."""
    other = a if b is None else b
    if b is None:
        place, queries, targets = np.arange(len(a.union)), np.arange(len(a.ids)), np.ones(len(a.ids), bool)
    else:
        place = np.minimum(np.searchsorted(b.union, a.union), len(b.union) - 1)
        shared = b.union[place] == a.union
        place[~shared] = len(b.union)
        queries = np.flatnonzero(100 * a.overlaps(shared) >= percent * a.size)  # the bound by the other's union
        if not len(queries):
            return []
        back = np.zeros(len(b.union), bool)
        back[place[shared]] = True
        targets = 100 * b.overlaps(back) >= percent * b.size
    label = np.arange(len(a.ids) + (0 if b is None else len(b.ids)))
    shift = 0 if b is None else len(a.ids)
    out = []
    for q in queries.tolist():
        n = int(a.size[q])
        open_ = targets & (100 * np.minimum(other.size, n) >= percent * np.maximum(other.size, n)) & (label[shift:] != label[q])
        if b is None:
            open_[: q + 1] = False
        docs = np.flatnonzero(open_)
        if not len(docs):
            continue
        mark = np.zeros(len(other.union) + 1, bool)
        mark[place[a.at[a.begin[q] : a.begin[q] + n]]] = True
        mark[-1] = False
        o = other.overlaps(mark, docs)
        for j in docs[100 * o >= percent * (n + other.size[docs] - o)].tolist():
            if label[shift + j] != label[q]:
                label[label == label[shift + j]] = label[q]
                out.append((int(a.ids[q]), int(other.ids[j])))
    return out


_MATRIX = "block long, ids array<long>, sizes array<int>, token_union binary, places binary, a array<long>, b array<long>"


def _matrix(percent: int):
    def build(table: pa.Table) -> pa.Table:
        group = Group.of({h: np.frombuffer(s, np.uint64) for h, s in zip(table["h1"].to_pylist(), table["set"].to_pylist(), strict=True)})
        found = links(group, None, percent)
        return pa.table({
            "block": table["block"][:1], "ids": pa.array([group.ids], pa.list_(pa.int64())), "sizes": pa.array([group.size.astype(np.int32)], pa.list_(pa.int32())),
            "token_union": pa.array([group.union.tobytes()], pa.binary()), "places": pa.array([group.at.tobytes()], pa.binary()),
            "a": pa.array([[x for x, _ in found]], pa.list_(pa.int64())), "b": pa.array([[y for _, y in found]], pa.list_(pa.int64())),
        })

    return build


def _opener(percent: int):
    def group(batch: pa.RecordBatch, r: int, side: str) -> Group:
        x = {c: batch.column(f"{side}_{c}")[r].as_py() for c in ("ids", "sizes", "token_union", "places")}
        return Group(np.array(x["ids"], np.int64), np.frombuffer(x["token_union"], np.uint64), np.array(x["sizes"], np.int64), np.frombuffer(x["places"], np.uint32))

    def open_pairs(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                found = links(group(batch, r, "x"), group(batch, r, "y"), percent)
                if found:
                    yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return open_pairs


# ---------------------------------------------------------------- the Spark jobs


def candidates(signed: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(n, h1, h2, rep) of all classes, and (doc_id, h1) of those that may link: with few shingles of their own."""
    reps = S.stored(signed.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
    owner = signed.select("h1", F.explode("picked").alias("token")).groupBy("token").agg(F.min("h1").alias("h1"), F.max("h1").alias("other"))
    alone = owner.where("h1 = other").groupBy("h1").agg(F.count("*").alias("alone"))
    few = F.expr(f"100 * n >= {percent} * (n + 1) AND 100 * coalesce(alone, 0) <= {100 - percent} * n")
    return reps, reps.join(alone, "h1", "left").where(few).select(F.col("rep").alias("doc_id"), "h1")


def ngram_join(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, rep (smallest doc_id with the same shingle set), component_id, for every row of docs.

    Linked: Jaccard of the sets of `width`-word shingles at least percent/100, compared in whole numbers on 64-bit
    shingle hashes. Null or empty text, or one of white space: n_shingles 0, linked with nothing. Fewer words than
    `width`: the whole sequence is one shingle. Rows that repeat a doc_id are documents of their own under that id.
    Rows without doc_id link with nothing and have no component_id. An empty table gives an empty result. Other
    columns of docs are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = S.stored(docs.mapInArrow(_signer(width, percent), "doc_id long, n int, h1 long, h2 long, picked array<long>"), "signed")
    full = signed.where("n > 0 AND doc_id is not null")
    reps, some = candidates(full, percent)
    sets = S.stored(docs.join(some, "doc_id").select("h1", "text").mapInArrow(_setter(width, percent), "h1 long, n int, set binary, signatures array<long>"), "sets")
    each = sets.select("h1", "n", F.explode("signatures").alias("signature"))
    often = each.groupBy("signature").agg(F.count("*").alias("count"), F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo < hi").select("signature", "count")
    shared = S.stored(each.join(often, "signature"), "shared")
    keyed = shared.groupBy("h1", "n").agg(F.max(F.struct("count", "signature"))["signature"].alias("key"))
    keyed = S.stored(keyed, "keys")
    weight = keyed.groupBy("key").agg(F.sum(F.col("n") + PER_DOC).alias("weight"))
    part = F.pmod(F.xxhash64("h1"), F.ceil(F.col("weight") / GROUP))
    blocks = S.stored(keyed.join(weight, "key").select("h1", F.xxhash64("key", part).alias("block")), "blocks")
    matrix = S.stored(sets.select("h1", "set").join(blocks, "h1").groupBy("block").applyInArrow(_matrix(percent), _MATRIX), "matrix")
    meet = shared.join(blocks, "h1").groupBy("signature", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    x, y = (meet.select("signature", F.col("block").alias(s), F.col("lo").alias(f"{s}_lo"), F.col("hi").alias(f"{s}_hi")) for s in "xy")
    fits = F.expr(f"x < y AND 100 * x_hi >= {percent} * y_lo AND 100 * y_hi >= {percent} * x_lo")
    pairs = x.join(y, "signature").where(fits).select("x", "y").distinct()
    side = lambda s: matrix.select(F.col("block").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("ids", "sizes", "token_union", "places")])
    across = pairs.join(side("x"), "x").join(side("y"), "y").mapInArrow(_opener(percent), "a long, b long")
    within = matrix.select(F.explode(F.arrays_zip("a", "b")).alias("z")).select("z.a", "z.b")
    label = S.components(within.unionByName(across))
    named = reps.join(label.withColumnRenamed("id", "h1"), "h1", "left").select("n", "h1", "h2", "rep", F.coalesce("component", "h1").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = S.stored(named.join(least, "component").select("n", "h1", "h2", "rep", "component_id"), "named")
    linked = full.select("doc_id", "n", "h1", "h2").join(named, ["n", "h1", "h2"]).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "rep", "component_id")
    rest = signed.where("n = 0 OR doc_id is null").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("rep"), F.col("doc_id").alias("component_id"))
    S.discard(reps, sets, shared, keyed, blocks, matrix)
    return linked.unionByName(rest)
