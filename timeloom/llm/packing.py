"""Best-fit packing of tokenised documents by length patterns.

The lengths' histogram (at most `capacity` counts, whatever the input) goes to the driver. Patterns of one to three
lengths that fill a sequence exactly are enumerated, their repeat counts fitted to the histogram by non-negative
least squares, rounded down, and what remains is packed best-fit on the histogram. The plan's size depends on the
capacity alone (about capacity**2 / 12 patterns), so it is broadcast; every piece finds its sequence by its rank
among the pieces of its length. Ranks come from counts per input partition, so no length is gathered in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeloom.llm import shared as S

class Encoder:
    """Ids of whole texts for a byte-level BPE file of `tokenizers`.

    The file's own vocabulary is handed to tiktoken, whose ids are the same (ids rise with the merges, which is
    checked) at a quarter of the time. Texts with control characters, of which the libraries differ on what is
    white space, and texts that hold an added token go to `tokenizers` itself.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in plain)}
        special = {t["content"] for t in json.loads(self.tokenizer.to_str())["added_tokens"]}
        self.odd = regex.compile("|".join(["[\\x00-\\x08\\x0e-\\x1f\\x7f-\\x9f\\u180e\\u200b\\u2060\\ufeff]", *map(regex.escape, sorted(special))])).search
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        ordered = all(x < y for x, y in zip(merged, merged[1:], strict=False)) and len(ranks) == 256 + len(merged)
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if ordered else None

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or self.odd(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


def _cutter(path: str, capacity: int, end: int, keep_ids: bool):
    def cut(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode = Encoder(path)
        rank = np.zeros(capacity + 1, np.int64)
        last = np.uint32(end).tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode(text or "").tobytes() + last
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    own = ids[4 * a : 4 * b]
                    out.append((doc, k, a, b - a, zlib.crc32(own), part, int(rank[b - a]), np.frombuffer(own, "<i4") if keep_ids else None))
                    rank[b - a] += 1
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", "ids"]
                arrays = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays[: 7 + keep_ids], names[: 7 + keep_ids])

    return cut


def patterns(capacity: int) -> np.ndarray:
    """All a >= b >= c >= 0, a > 0, with a + b + c = capacity."""
    a = np.arange(1, capacity + 1)
    out = []
    for x in a.tolist():
        b = np.arange((capacity - x + 1) // 2, min(x, capacity - x) + 1)
        out.append(np.stack([np.full(len(b), x), b, capacity - x - b], 1))
    return np.concatenate(out)


def fit(histogram: np.ndarray, shapes: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative least squares: repeats x of the shapes with sum of their lengths near the histogram (accelerated projected gradient)."""
    scale = max(float(histogram.sum()), 1.0)
    h = histogram / scale
    used = (shapes == 0) | (histogram[shapes] > 0)
    shapes = np.where(used.all(1)[:, None], shapes, 0)
    n = len(histogram)

    def apply(x):
        y = np.zeros(n)
        for k in range(3):
            y += np.bincount(shapes[:, k], x, n)
        y[0] = 0
        return y

    def back(r):
        r = r.copy()
        r[0] = 0
        return r[shapes].sum(1)

    v = np.ones(len(shapes))
    for _ in range(15):  # largest eigenvalue
        v = back(apply(v))
        top = np.linalg.norm(v)
        if not top:
            return np.zeros(len(shapes))
        v /= top
    x = y = np.zeros(len(shapes))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(y - back(apply(y) - h) / (1.05 * top), 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / s * (new - x)
        x, t = new, s
    return x * scale


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences); uses every piece of the histogram once."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    shapes = patterns(capacity)
    shapes = shapes[shapes[:, 0] < capacity]
    repeats = np.floor(fit(left, shapes)).astype(np.int64)
    for k in np.argsort(-repeats, kind="stable"):
        if repeats[k] < 1:
            break
        shape = tuple(int(v) for v in shapes[k] if v)
        n = min(int(repeats[k]), *(int(left[v]) // shape.count(v) for v in set(shape)))
        if n > 0:
            out.append((shape, n))
            for v in shape:
                left[v] -= n
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for v in np.flatnonzero(left)[::-1].tolist():
        n = int(left[v])
        while n and (fits := [r for r in room if r >= v]):
            r = min(fits)
            shape, have = room[r].pop()
            if not room[r]:
                del room[r]
            k = min(n, have)
            if have > k:
                room.setdefault(r, []).append((shape, have - k))
            room.setdefault(r - v, []).append(((*shape, v), k))
            n -= k
        most = capacity // v
        for m, k in ((most, n // most), (n % most, 1)):
            if m and k:
                room.setdefault(capacity - m * v, []).append(((v,) * m, k))
    return out + [x for same in room.values() for x in same]


def _placer(slots):
    def place(batches):
        begin, first, sequence, offset = slots.value
        for batch in batches:
            length, rank = np.array(batch.column("length")), np.array(batch.column("rank"))
            at = np.empty(len(length), np.int64)
            for v in np.unique(length).tolist():
                own = length == v
                at[own] = begin[v] + np.searchsorted(first[begin[v] : begin[v + 1]], rank[own], "right") - 1
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], [*names, "sequence_id", "offset"]
            )

    return place


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 2, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, [ids], sequence_id, offset: a row per piece of a document's ids.

    Null text is empty; every document has its end token at least, so none is lost. Only documents longer than
    `capacity` are cut: the first piece takes what is left over, the others are full. Repeated rows are packed
    each. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids array<int>" * keep_ids
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = S.stored(docs.mapInArrow(_cutter(tokenizer, capacity, end, keep_ids), kind), "pieces")
    counts = cut.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = S.stored(counts.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))), "starts")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in starts.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most `capacity` rows
        histogram[r["length"]] = r["n"]
    slots: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
    taken = np.zeros(capacity + 1, np.int64)
    base = 0
    for shape, n in plan(histogram, capacity):
        at = 0
        for v in shape:
            slots[v].append((int(taken[v]), base, at))
            taken[v] += n
            at += v
        base += n
    begin = np.cumsum([0, *(len(s) for s in slots)])
    table = np.array([x for s in slots for x in s], np.int64).reshape(-1, 3)
    shared = spark.sparkContext.broadcast((begin, *(table[:, k].copy() for k in range(3))))
    ranked = cut.join(starts.select("length", "part", "before"), ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids, (F.col("rank") + F.col("before")).alias("rank")
    )
    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids + ", sequence_id long, offset long"
    return ranked.mapInArrow(_placer(shared), out)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 2) -> DataFrame:
    """sequence_id, ids, doc_ids: the packed sequences themselves, at most `capacity` ids each."""
    rows = pack(docs, tokenizer, capacity, end, keep_ids=True)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return rows.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.array_distinct(F.transform("p", lambda x: x["doc_id"])).alias("doc_ids"))
