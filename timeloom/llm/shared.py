"""Helpers of the training-data operators: durable intermediate tables, hashing of words, components."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.sources.storage import discard, scope, shared_dir, spread, stored, table_path  # noqa: F401

U64 = np.uint64


# ---------------------------------------------------------------- words of UTF-8 buffers

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: bytes between words for the operators whose words are letters, digits, underscores and all that is not ASCII
PUNCTUATION = np.array([not (chr(b).isalnum() or b == 95) for b in range(128)] + [False] * 128)
LOWER = np.arange(256)
LOWER[65:91] += 32
#: a random number for each byte at each of the first places of a word
_PLACES = 64
_AT = np.random.default_rng(20240607).integers(0, 2**64, (_PLACES, 256), dtype=np.uint64).ravel()
_FAR = U64(0x632BE59BD9B4E019)
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 2**64))
_powers: list[np.ndarray] = []


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        m = max(n, 1 << 20)
        _powers[:] = [np.multiply.accumulate(np.r_[U64(1), np.full(m, b, np.uint64)]) for b in (_BASE, _BASE_INV)]
    return _powers[0], _powers[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling hash's base and of its inverse, n at least."""
    return _pow(n)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def pieces(column: pa.Array, most: int = 1 << 21):
    """(first row, end row, bytes, offsets) of runs of whole rows of about `most` bytes."""
    buf, off = utf8(column)
    lo = 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(buf: np.ndarray, off: np.ndarray, gap: np.ndarray = _SPACE, spans: bool = False) -> tuple[np.ndarray, ...]:
    """64-bit hashes of the words, by default `[^\\x20\\x09-\\x0D]+`, with A-Z lower-cased, and the row of each; spans: begin and end too.

    A hash is a sum of independent random numbers, one for each place and byte, so words differ in some term whatever their pattern.
    """
    n = len(buf)
    if not n:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * (3 if spans else 1))
    text = ~gap[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    edge[n] = True
    first = text.copy()
    first[1:] &= ~text[:-1] | edge[1:n]
    last = text.copy()
    last[:-1] &= ~text[1:] | edge[1:n]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(a):
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * (3 if spans else 1))
    size = b - a
    begin = np.cumsum(size) - size
    place = np.arange(int(size.sum()), dtype=np.int32) - np.repeat(begin.astype(np.int32), size)
    low = LOWER[buf[text]].astype(np.int32)
    value = _AT[np.minimum(place, _PLACES - 1) << 8 | low]
    if int(size.max()) > _PLACES:  # beyond the table: a mixed number of place and byte
        far = np.flatnonzero(place >= _PLACES)
        value[far] = mix(mix(place[far].astype(np.uint64) + _FAR) + low[far].astype(np.uint64))
    h = mix(np.add.reduceat(value, begin) + size.astype(np.uint64) * U64(0xD6E8FEB86659FD93))
    row = np.searchsorted(off, a, "right") - 1
    return (h, row, a, b) if spans else (h, row)


def shingles(h: np.ndarray, row: np.ndarray, n_rows: int, width: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its `width`-word shingles; shorter rows: the whole sequence as one."""
    ends = np.searchsorted(row, np.arange(n_rows), "right")
    begins = np.r_[0, ends[:-1]]
    m = len(h) - width + 1
    s = np.zeros(max(m, 0), np.uint64)
    for i in range(width):
        s = mix(s + h[i : i + len(s)] * U64(2 * i + 1))
    out = []
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(s[a : b - width + 1]))
        elif b > a:
            x = U64(b - a)
            for v in h[a:b]:
                x = mix(np.array([x], np.uint64) + v)[0]
            out.append(np.array([x], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


# ---------------------------------------------------------------- ranks over all rows


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with the place of each row in the given order, from 1, as column `name`: sorted in ranges, each counted from where those before it end."""
    kept = df.columns
    ranged = df.repartitionByRange(*order).select("*", F.spark_partition_id().alias("_range"))
    parts = stored(ranged, "ranges")
    before = parts.groupBy("_range").agg(F.count("*").alias("n")).selectExpr("_range", "sum(n) over (order by _range) - n AS before")  # one row a range
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return parts.withColumn("_place", place).join(before, "_range").select(*kept, (F.col("before") + F.col("_place")).alias(name))


# ---------------------------------------------------------------- connected components


def components(links: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable over links (a, b). Vertices without links don't appear.

    Each round takes the smallest label among the neighbours' and then the label's own label, so paths
    halve; rounds go on until no label changes. Only grouped minima and equi-joins run; hubs are pre-aggregated
    or split by skew joins.
    """
    links = stored(links.select("a", "b").where("a <> b"), "links")
    both = stored(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        low = label.join(near, "id").select("id", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        jump = label.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = stored(
            low.join(jump, "component", "left").select("id", F.least("component", F.coalesce("further", "component")).alias("component"), "was"), "labels"
        )
        discard(label)
        label = new.select("id", "component")
        label.stored_at = new.stored_at
        if not new.where("component <> was").limit(1).count():
            discard(links, both)
            return label


# ---------------------------------------------------------------- arrays in the shared folder


def write_array(folder: str, name: str, values: np.ndarray) -> None:
    """One raw array as a file of the shared folder; a repeated task writes the same bytes over it in one move."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(values).tobytes())
    store.move(part, f"{path}/{name}")


def open_array(folder: str, name: str, dtype) -> np.ndarray:
    """Memory-mapped where the shared folder is mounted, else read by the store's own client."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    path = f"{path}/{name}"
    info = store.get_file_info(path)
    if info.type == fs.FileType.NotFound or not info.size:
        return np.zeros(0, dtype)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


class Arrays:
    """A task's view of a folder's arrays; few stay open, as a process may map only so many."""

    def __init__(self, folder: str, most: int = 4096):
        self.folder, self.most = folder, most
        self.open: dict[str, np.ndarray] = {}

    def get(self, name: str, dtype) -> np.ndarray:
        if name not in self.open:
            if len(self.open) >= self.most:
                self.open.clear()
            self.open[name] = open_array(self.folder, name, dtype)
        return self.open[name]
