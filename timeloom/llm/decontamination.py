"""Benchmark decontamination: MinHash containment search, partitioned by size, verified exactly.

An item's sketch is its smallest shingle hashes (bottom-k MinHash), with k = n - need + 1 of n shingles where `need`
must be contained: a document that contains `need` of them holds at least one hash of the sketch, so nothing is lost
however long the document is. Items are partitioned by size in powers of two; a document is searched only in the
partitions whose smallest `need` it can hold. Candidates are verified by exact containment of shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm import shared as S

BLOCK = 2_000_000  # shingles of test items that are broadcast at once: 16 MB of hashes; more items go in more blocks


def _itemiser(width: int):
    def itemise(batches):
        for batch in batches:
            for lo, hi, buf, off in S.pieces(batch.column("text")):
                h, row = S.words(buf, off, S.PUNCTUATION)
                sets = S.shingles(h, row, hi - lo, width)
                yield pa.RecordBatch.from_pydict({
                    "item_id": batch.column("item_id").slice(lo, hi - lo), "n": pa.array([len(s) for s in sets], pa.int32()),
                    "set": pa.array([s.tobytes() for s in sets], pa.binary()),
                })

    return itemise


def _partitions(items: list[tuple[int, np.ndarray]], percent: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(least need, sketch hashes sorted, item of each) per power of two of the items' sizes."""
    out = []
    sizes = np.array([len(s) for _, s in items])
    for c in sorted({int(n).bit_length() for n in sizes}):
        own = [k for k, n in enumerate(sizes.tolist()) if n.bit_length() == c]
        need = [-(-percent * int(sizes[k]) // 100) for k in own]
        hashes = np.concatenate([items[k][1][: sizes[k] - q + 1] for k, q in zip(own, need, strict=True)])
        of = np.repeat(own, [sizes[k] - q + 1 for k, q in zip(own, need, strict=True)])
        order = np.argsort(hashes, kind="stable")
        out.append((min(need), hashes[order], of[order]))
    return out


def _searcher(width: int, percent: int, shared):
    def search(batches):
        ids, sets, tables = shared.value
        for batch in batches:
            docs = np.array(batch.column("doc_id"))
            for lo, hi, buf, off in S.pieces(batch.column("text")):
                h, row = S.words(buf, off, S.PUNCTUATION)
                found = S.shingles(h, row, hi - lo, width)
                size = np.array([len(s) for s in found], np.int64)
                flat = np.concatenate(found)
                of = np.repeat(np.arange(hi - lo), size)
                pairs: set[tuple[int, int]] = set()
                for need, hashes, items in tables:
                    at = np.flatnonzero(size[of] >= need)
                    x = flat[at]
                    begin = np.searchsorted(hashes, x)
                    hit = np.flatnonzero(hashes[np.minimum(begin, len(hashes) - 1)] == x)
                    end = np.searchsorted(hashes, x[hit], "right")
                    for d, a, b in zip(of[at[hit]].tolist(), begin[hit].tolist(), end.tolist(), strict=True):
                        pairs.update((d, k) for k in items[a:b].tolist())
                out = []
                for d, k in sorted(pairs):
                    n, doc = len(sets[k]), found[d]
                    place = np.minimum(np.searchsorted(doc, sets[k]), len(doc) - 1)
                    both = int((doc[place] == sets[k]).sum())
                    if 100 * both >= percent * n:
                        out.append((docs[lo + d], ids[k], n, both))
                if out:
                    d, k, n, both = zip(*out, strict=True)
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(d, pa.int64()), "item_id": pa.array(k, pa.int64()), "n_item": pa.array(n, pa.int64()), "n_shared": pa.array(both, pa.int64()),
                    })

    return search


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, item_id, n_item, n_shared: documents that contain percent/100 or more of an item's word shingles.

    Words are runs of letters, digits, underscores and all non-ASCII characters, A-Z lower-cased; fewer words than
    `width` are one shingle. Items and documents that are null or have no word match nothing. Each pair comes once,
    repeated rows or not. Empty tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null").distinct()
    items = S.stored(items.mapInArrow(_itemiser(width), "item_id long, n int, set binary").where("n > 0"), "items")
    total = items.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
    blocks = -(-total // BLOCK)
    out = spark.createDataFrame([], "doc_id long, item_id long, n_item long, n_shared long")
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()  # one block of about BLOCK shingles
        if not rows:
            continue
        own = [(r["item_id"], np.frombuffer(r["set"], np.uint64)) for r in rows]
        shared = spark.sparkContext.broadcast(([i for i, _ in own], [s for _, s in own], _partitions(own, percent)))
        out = out.unionByName(docs.mapInArrow(_searcher(width, percent, shared), "doc_id long, item_id long, n_item long, n_shared long"))
    return out.distinct()
