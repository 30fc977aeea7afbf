"""Interpolated modified Kneser-Ney trigram model, counted in Spark, kept as sorted hash arrays that workers memory-map.

Two passes count: words, whose sorted hashes become the vocabulary (a word's id is its place), then trigrams (u, v, w)
of ids. Tasks sum up runs of two million tokens before anything is shuffled. Trigrams are dealt by their middle word, so
one shard sees all of a context (u, v) and all words u before a pair (v, w). A frequent middle word is split over a
grid of shards by both neighbours, in proportion to its count; its contexts and pairs are partial there and are summed
in a further shuffle of their own. Each shard is one file of the shared folder; a scoring task maps some at a time and
looks up whole batches in sorted order.

p3(w|uv) = max(c(uvw) - D(c(uvw)), 0) / c(uv.) + gamma(uv) p2(w|v). p2 likewise over the numbers of different words
seen before vw, p1 over those seen before w, interpolated with 1 / (V + 1), which the unknown word gets; a context
never seen leaves the next lower level alone. Two start tokens precede a document. D has three values per level,
estimated from counts of counts. Probabilities over the vocabulary and the unknown word sum to 1 in every context.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm import shared as S

U64 = np.uint64
END = U64(0x5851F42D4C957F2D)  # hash of the end token
HOLD = 6_000_000  # entries a task sums up at once
RUN = 2_000_000  # tokens whose trigrams are counted together: their different words fit 21 bits


# ---------------------------------------------------------------- sums of sorted keys


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    c = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def _counted(chunks) -> tuple[np.ndarray, np.ndarray]:
    keys, counts, held = [], [], 0
    for x in chunks:
        k, n = np.unique(x, return_counts=True)
        keys.append(k)
        counts.append(n)
        held += len(k)
        if held > HOLD:
            k, n = _summed(keys, counts)
            keys, counts, held = [k], [n], len(k) // 2
    return _summed(keys, counts)


def _groups(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, in sorted columns."""
    n = len(columns[0])
    change = np.zeros(n, bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _spans(column: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and end row of each run of equal values."""
    first = _groups(column)
    return zip(first.tolist(), np.r_[first, len(column)][1:].tolist(), strict=True)


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first) if len(first) else np.zeros(0, np.int64)


def _kinds(n: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Per group: sum, how many are 1, 2 and more."""
    return [_sums(x, first) for x in (n, (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64))]


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of non-negative integers, byte planes apart: the upper ones are nearly all zero."""
    planes = np.stack([c.astype(np.int64) for c in columns]).view(np.uint8).reshape(-1, 8).T
    return pa.Codec("zstd").compress(np.ascontiguousarray(planes).tobytes(), asbytes=True)


def _unpacked(data: bytes, n: int, columns: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, 8 * n * columns), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).reshape(columns, n)


def _gaps(v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by v, then u: steps of v, and of u where v stays."""
    dv, du = np.diff(v, prepend=0), np.diff(u, prepend=0)
    return dv, np.where(dv == 0, du, u)


def _ungapped(dv: np.ndarray, du: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.r_[True, dv[1:] != 0])
    total = np.cumsum(du)
    return np.cumsum(dv), total - np.repeat((total - du)[first], np.diff(np.r_[first, len(dv)]))


def _edges(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard and its rows."""
    order = np.argsort(shard, kind="stable")
    first = _groups(shard[order])
    for a, b in zip(first.tolist(), np.diff(np.r_[first, len(shard)]).cumsum().tolist(), strict=True):
        yield int(shard[order[a]]), order[a:b]


def _top(x: np.ndarray, shards: int) -> np.ndarray:
    return (x >> U64(64 - (shards.bit_length() - 1))).astype(np.int64)


# ---------------------------------------------------------------- files of sorted hash arrays


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return S.mix(S.mix(a.astype(np.uint64) + U64(1)) * U64(0x9E3779B97F4A7C15) + b.astype(np.uint64))


def _write(folder: str, name: str, sections: list[np.ndarray]) -> None:
    """One file of several arrays: their number, then length and item size of each, then the arrays at multiples of 8."""
    head = np.array([len(sections), *(x for s in sections for x in (len(s), s.itemsize))], np.int64)
    parts = [head.view(np.uint8)]
    for s in sections:
        raw = np.ascontiguousarray(s).view(np.uint8)
        parts += [raw, np.zeros(-len(raw) % 8, np.uint8)]
    S.write_array(folder, name, np.concatenate(parts))


def _sections(data: np.ndarray) -> list[np.ndarray]:
    if not len(data):
        return []
    n = int(data[:8].view(np.int64)[0])
    head, at, out = data[8 : 8 + 16 * n].view(np.int64).reshape(n, 2).tolist(), 8 + 16 * n, []
    for length, size in head:
        out.append(data[at : at + length * size].view(f"u{size}"))
        at += -(-length * size // 8) * 8
    return out


def _least(x: np.ndarray) -> np.ndarray:
    """As the smallest unsigned type that holds the largest value."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _table(keys: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Sections of a table: keys of rows whose first column is 1 (the others then follow), keys of the others, their columns.

    A key is the upper 48 bits of a hash. As a shard holds some million keys at every size of the corpus, a key not in it
    is taken for another about once in 10^8 lookups.
    """
    order = np.argsort(keys, kind="stable")
    keys, columns = keys[order] >> U64(16), [c[order] for c in columns]
    out = []
    for rows in (np.flatnonzero(columns[0] == 1), np.flatnonzero(columns[0] != 1)):
        out += [(keys[rows] >> U64(16)).astype(np.uint32), (keys[rows] & U64(0xFFFF)).astype(np.uint16)]
    return out + [_least(c[rows]) for c in columns]


def _find(high: np.ndarray, low: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the sorted keys are there, where)."""
    if not len(high):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, lo = (keys >> U64(16)).astype(np.uint32), (keys & U64(0xFFFF)).astype(np.uint16)
    at = np.searchsorted(high, h)
    open_ = np.flatnonzero(at < len(high))
    open_ = open_[high[at[open_]] == h[open_]]
    hits = []
    while len(open_):
        got = low[at[open_]]
        hits.append(open_[got == lo[open_]])
        open_ = open_[got < lo[open_]]
        at[open_] += 1
        open_ = open_[at[open_] < len(high)]
        open_ = open_[high[at[open_]] == h[open_]]
    which = np.concatenate(hits) if hits else np.zeros(0, np.int64)
    return which, at[which]


# ---------------------------------------------------------------- vocabulary

_BLOBS = "shard int, n long, data binary"


def _word_counter(shards: int):
    def count(batches):
        def chunks():
            for batch in batches:
                for lo, hi, buf, off in S.pieces(batch.column("text")):
                    h, _ = S.words(buf, off)
                    yield np.r_[h, np.full(hi - lo, END)]

        k, n = _counted(chunks())
        rows = [(s, len(own), k[own].tobytes() + n[own].astype(np.int64).tobytes()) for s, own in _edges(_top(k, shards))]
        yield _batch(_BLOBS, rows)

    return count


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], [f for f, _ in fields])


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)


def _word_writer(folder: str):
    def write(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for n, data in _rows(batches, "n", "data"):
            keys.append(np.frombuffer(data, np.uint64, n))
            counts.append(np.frombuffer(data, np.int64, n, 8 * n))
            held += n
            if held > 4 * HOLD:
                k, c = _summed(keys, counts)
                keys, counts, held = [k], [c], len(k) // 2
        k, n = _summed(keys, counts)
        _write(folder, f"words-{key[0].as_py()}", [k, n])
        yield _batch("shard int, v long, n long", [(key[0].as_py(), len(k), int(n.sum()))])

    return write


class Model:
    """A task's view of the files: mapped on first use, some thousand at a time."""

    def __init__(self, meta: dict):
        self.m = meta
        self.files = S.Arrays(meta["folder"])
        self.v, self.n, self.shards = meta["v"], meta["n"], meta["shards"]
        self.docs = int(self.ids(np.array([END]))[1][0])  # every document has one end, and so one start

    def sections(self, name: str, shard: int) -> list[np.ndarray]:
        return _sections(self.files.get(f"{name}-{shard}", np.uint8))

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and training counts."""
        u, back = np.unique(hashes, return_inverse=True)
        ids, counts = np.full(len(u), -1, np.int64), np.zeros(len(u), np.int64)
        shard = _top(u, self.shards)
        for a, b in _spans(shard):
            k = int(shard[a])
            found = self.sections("words", k)
            if found:
                at = np.minimum(np.searchsorted(found[0], u[a:b]), len(found[0]) - 1)
                hit = np.flatnonzero(found[0][at] == u[a:b])
                ids[a + hit] = self.m["offsets"][k] + at[hit]
                counts[a + hit] = found[1][at[hit]]
        return ids[back], counts[back]

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Training counts of sorted ids; the start's is that of documents."""
        out = np.full(len(ids), self.docs, np.int64)
        offsets = np.array([*self.m["offsets"], self.v])
        edges = np.searchsorted(ids, offsets)
        for k in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            out[edges[k] : edges[k + 1]] = self.sections("words", k)[1][ids[edges[k] : edges[k + 1]] - offsets[k]]
        return out

    def sides(self, count: np.ndarray) -> np.ndarray:
        """Into how many parts either neighbour splits the trigrams of a middle word: 1 up to a shard's share of the tokens."""
        return np.ceil(np.sqrt(1 + count * self.shards // max(self.n, 1))).astype(np.int64)

    def shard(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, count: np.ndarray) -> np.ndarray:
        side = self.sides(count).astype(np.uint64)
        part = S.mix(u.astype(np.uint64)) % side * side + S.mix(w.astype(np.uint64) + U64(77)) % side
        return _top(_pair_key(part, v), self.shards)

    def spot(self, a: np.ndarray, b: np.ndarray, v: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key of the pair (a, b), one of which is the middle word v; whether v is split; the shard that has the pair's sums."""
        key, split = _pair_key(a, b), self.sides(count) > 1
        zero = np.zeros(len(v), np.uint64)
        return key, split, np.where(split, (key & U64(self.shards - 1)).astype(np.int64), _top(_pair_key(zero, v), self.shards))

    def look(self, name: str, place: int, columns: int, keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """A table's columns at the keys; zeros where a key is absent."""
        result = np.zeros((columns, len(keys)), np.int64)
        for base in range(0, self.shards, 1 << 16):  # a number of a shard and a key share 64 bits
            rows = np.flatnonzero((shard >= base) & (shard < base + (1 << 16))) if self.shards > 1 << 16 else slice(None)
            u, back = np.unique(((shard[rows] - base).astype(np.uint64) << U64(48)) | (keys[rows] >> U64(16)), return_inverse=True)
            out = np.zeros((columns, len(u)), np.int64)
            for a, b in _spans(u >> U64(48)):
                found = self.sections(name, base + int(u[a] >> U64(48)))
                if not found:
                    continue
                own = u[a:b] & U64(2**48 - 1)
                one_high, one_low, high, low, *values = found[place : place + 4 + columns]
                which, _ = _find(one_high, one_low, own)
                out[: min(columns, 2), a + which] = 1
                which, at = _find(high, low, own)
                for j, x in enumerate(values):
                    out[j, a + which] = x[at]
            result[:, rows] = out[:, back]
        return result

    def grams(self, texts: pa.Array):
        """Per run of rows: first and end row, row of each token, ids (u, v, w; start: the vocabulary's size), counts of v and w."""
        for lo, hi, buf, off in S.pieces(texts):
            h, row = S.words(buf, off)
            size = np.bincount(row, minlength=hi - lo)
            ends = np.cumsum(size + 1) - 1
            tokens = np.empty(len(h) + hi - lo, np.uint64)
            tokens[ends] = END
            inner = np.ones(len(tokens), bool)
            inner[ends] = False
            tokens[inner] = h
            w, count_w = self.ids(tokens)
            starts = np.r_[0, ends[:-1] + 1]
            v, count_v = np.r_[self.v, w[:-1]], np.r_[self.docs, count_w[:-1]]
            v[starts], count_v[starts] = self.v, self.docs
            u = np.r_[self.v, v[:-1]]
            u[starts] = self.v
            yield lo, hi, np.repeat(np.arange(hi - lo), size + 1), u, v, w, count_v, count_w


# ---------------------------------------------------------------- trigrams


def _gram_counter(meta):
    def count(batches):
        model = Model(meta.value)
        held: list[np.ndarray] = []

        def flush():
            u, v, w = np.concatenate(held, axis=1)
            held.clear()
            for a in range(0, len(u), RUN):
                yield _gram_rows(model, u[a : a + RUN], v[a : a + RUN], w[a : a + RUN])

        for batch in batches:
            for _, _, _, u, v, w, _, _ in model.grams(batch.column("text")):
                held.append(np.stack([u, v, w]))
                if sum(x.shape[1] for x in held) + len(u) > RUN:
                    yield from flush()
        if held:
            yield from flush()

    return count


def _gram_rows(model: Model, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    """Counts of a run's trigrams, a row per shard."""
    ids, local = np.unique(np.concatenate([u, v, w]), return_inverse=True)
    u, v, w = local.astype(np.uint64).reshape(3, -1)
    keys, n = np.unique((v << U64(42)) | (u << U64(21)) | w, return_counts=True)
    mask = U64(2**21 - 1)
    middle = (keys >> U64(42)).astype(np.int64)
    u, v, w = ids[(keys >> U64(21) & mask).astype(np.int64)], ids[middle], ids[(keys & mask).astype(np.int64)]
    rows = []
    for s, own in _edges(model.shard(u, v, w, model.counts(ids)[middle])):
        rows.append((s, len(own), _packed(*_gaps(v[own], u[own]), w[own], n[own])))
    return _batch(_BLOBS, rows)


def _merged(batches) -> tuple[np.ndarray, ...]:
    """u, v, w and counts, sorted by v, u, w."""
    held, size = [np.zeros((4, 0), np.int64)], 0

    def merge():
        v, u, w, n = np.concatenate(held, axis=1)
        order = np.lexsort((w, u, v))
        v, u, w = v[order], u[order], w[order]
        first = _groups(v, u, w)
        return np.stack([v[first], u[first], w[first], _sums(n[order], first)])

    for n, data in _rows(batches, "n", "data"):
        dv, du, w, c = _unpacked(data, n, 4)
        held.append(np.stack([*_ungapped(dv, du), w, c]))
        size += n
        if size > HOLD:
            held = [merge()]
            size = held[0].shape[1] // 2
    v, u, w, n = merge()
    return u, v, w, n


_PARTS = "kind string, shard int, n long, data binary, n1 long, n2 long, n3 long, n4 long"


def _counts_of_counts(kind: str, n: np.ndarray) -> tuple:
    return (kind, 0, len(n), b"", *(int((n == i).sum()) for i in (1, 2, 3, 4)))


def _dealt(kind: str, shard: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    return [(kind, s, len(own), _packed(*(c[own] for c in columns)), 0, 0, 0, 0) for s, own in _edges(shard)]


def _lower(model: Model, v: np.ndarray, w: np.ndarray, before: np.ndarray) -> list[tuple]:
    """Rows of the two lower levels from whole pairs (v, w), sorted, and how many different words came before each."""
    step = model.m["step"]
    first = _groups(v)
    ids, different = np.unique(w, return_counts=True)
    return [
        _counts_of_counts("pairs", before),
        *_dealt("second", v[first] // step, v[first] % step, *_kinds(before, first)),
        *_dealt("first", ids // step, ids % step, different),
    ]


def _gram_writer(meta):
    def write(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(meta.value)
        u, v, w, n = _merged(batches)
        grams = _table(_pair_key(_pair_key(u, v), w), n)
        first = _groups(v, u)
        cu, cv, sums = u[first], v[first], _kinds(n, first)
        order = np.lexsort((w, v))
        first = _groups(v[order], w[order])
        fv, fw, before = v[order][first], w[order][first], np.diff(np.r_[first, len(v)])
        middle = np.unique(v)
        split = model.sides(model.counts(middle)) > 1
        hot_c, hot_f = (split[np.searchsorted(middle, x)] for x in (cv, fv))
        contexts = _table(_pair_key(cu, cv)[~hot_c], *(x[~hot_c] for x in sums))
        pairs = _table(_pair_key(fv, fw)[~hot_f], before[~hot_f])
        _write(model.m["folder"], f"grams-{key[0].as_py()}", grams + contexts + pairs)
        rows = [_counts_of_counts("grams", n), *_lower(model, fv[~hot_f], fw[~hot_f], before[~hot_f])]
        low = U64(model.shards - 1)
        cu, cv, fv, fw = cu[hot_c], cv[hot_c], fv[hot_f], fw[hot_f]
        rows += _dealt("context", (_pair_key(cu, cv) & low).astype(np.int64), cu, cv, *(x[hot_c] for x in sums))
        rows += _dealt("pair", (_pair_key(fv, fw) & low).astype(np.int64), fv, fw, before[hot_f])
        yield _batch(_PARTS, rows)

    return write


def _split_writer(meta):
    """Sums the partial contexts and pairs of split middle words."""

    def write(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(meta.value)
        width = {"context": 6, "pair": 3}
        held = {k: [np.zeros((c, 0), np.int64)] for k, c in width.items()}
        for kind, n, data in _rows(batches, "kind", "n", "data"):
            held[kind].append(_unpacked(data, n, width[kind]))
        whole = {}
        for kind, parts in held.items():
            x = np.concatenate(parts, axis=1)
            x = x[:, np.lexsort((x[1], x[0]))]
            first = _groups(x[0], x[1])
            whole[kind] = [x[0][first], x[1][first], *(_sums(y, first) for y in x[2:])]
        u, v, *sums = whole["context"]
        a, b, before = whole["pair"]
        _write(model.m["folder"], f"split-{key[0].as_py()}", _table(_pair_key(u, v), *sums) + _table(_pair_key(a, b), before))
        yield _batch(_PARTS, _lower(model, a, b, before))

    return write


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts; where counts of counts are missing, the usual limits."""
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    d2 = 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return min(max(d1, 0.05), 1), min(max(d2, 0.05), 2), min(max(d3, 0.05), 3)


def _stat_writer(meta, d: tuple[float, float, float]):
    def write(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, s = meta.value, key[0].as_py()
        total, follow = np.zeros((4, m["step"]), np.int64), np.zeros(m["step"], np.int64)
        for kind, n, data in _rows(batches, "kind", "n", "data"):
            at, *x = _unpacked(data, n, 5 if kind == "second" else 2)
            if kind == "second":
                total[:, at] += x
            else:
                follow[at] += x[0]
        share = np.array(d) @ total[1:] / np.maximum(total[0], 1)
        _write(m["folder"], f"stats-{s}", [_least(total[0]), share.view(np.uint64), _least(follow)])
        yield _batch("n1 long, n2 long, n3 long, n4 long, more long", [(*(int((follow == i).sum()) for i in (1, 2, 3, 4)), int((follow > 2).sum()))])

    return write


# ---------------------------------------------------------------- scoring


def _by_id(model: Model, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per id: number of different trigrams around it, share of their discounts, number of different words before it; unknown: zeros."""
    u, back = np.unique(ids, return_inverse=True)
    out = np.zeros((3, len(u)))
    step = model.m["step"]
    edges = np.searchsorted(u, np.arange(model.shards + 1) * step)
    for s in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        found = model.sections("stats", s)
        if found:
            at = u[edges[s] : edges[s + 1]] - s * step
            out[:, edges[s] : edges[s + 1]] = found[0][at], found[1].view(np.float64)[at], found[2][at]
    return tuple(out[:, back])


def _left(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(count - np.array([0, *d])[np.minimum(count, 3).astype(np.int64)], 0)


def _pair_sums(model: Model, place: dict[str, int], columns: int, known: np.ndarray, a, b, v, count) -> np.ndarray:
    """Columns of the pairs (a, b) around the middle word v, from the shard of v or, where v is split, from that of the pair."""
    out = np.zeros((columns, len(a)), np.int64)
    rows = np.flatnonzero(known)
    key, split, shard = model.spot(a[rows], b[rows], v[rows], count[rows])
    for name, own in (("grams", np.flatnonzero(~split)), ("split", np.flatnonzero(split))):
        if len(own):
            out[:, rows[own]] = model.look(name, place[name], columns, key[own], shard[own])
    return out


def _log10(model: Model, u, v, w, count_v) -> np.ndarray:
    m = model.m
    follow = _by_id(model, w)[2]
    p = np.full(len(w), 1 / (model.v + 1))
    if m["pairs"]:
        p = _left(follow, m["d1"]) / m["pairs"] + m["gamma1"] * p
    around, share, _ = _by_id(model, v)
    before = _pair_sums(model, {"grams": 13, "split": 8}, 1, (v >= 0) & (w >= 0), v, w, v, count_v)[0]
    p = np.where(around > 0, _left(before, m["d2"]) / np.maximum(around, 1) + share * p, p)
    total, *kinds = _pair_sums(model, {"grams": 5, "split": 0}, 4, (u >= 0) & (v >= 0), u, v, v, count_v)
    c = np.zeros(len(w), np.int64)
    rows = np.flatnonzero((total > 0) & (w >= 0))
    key = _pair_key(_pair_key(u[rows], v[rows]), w[rows])
    c[rows] = model.look("grams", 0, 1, key, model.shard(u[rows], v[rows], w[rows], count_v[rows]))[0]
    upper = (_left(c, m["d3"]) + np.array(m["d3"]) @ np.array(kinds) * p) / np.maximum(total, 1)
    return np.log10(np.where(total > 0, upper, p))


def _scorer(meta):
    def score(batches):
        model = Model(meta.value)
        names = [c for c in model.m["keep"]]
        for batch in batches:
            out = np.zeros((4, batch.num_rows))
            for lo, hi, row, u, v, w, count_v, count in model.grams(batch.column("text")):
                n = hi - lo
                out[0, lo:hi] = np.bincount(row, minlength=n)
                out[1, lo:hi] = np.bincount(row, count > 0, n)
                out[2, lo:hi] = np.bincount(row, np.log10((count + 0.1) / (model.n + 0.1 * (model.v + 1))), n)
                out[3, lo:hi] = np.bincount(row, _log10(model, u, v, w, count_v), n)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(out[0].astype(np.int64)), pa.array(out[1].astype(np.int64)),
                 pa.array(np.full(batch.num_rows, model.n, np.int64)), pa.array(out[2]), pa.array(out[3])],
                [*names, "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return score


def lm_scores(train: DataFrame, docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep's columns of docs, then n_tokens, n_known, train_tokens, base_score, score (log10).

    Tokens are the words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased and an end token; null text is empty, so it has
    one token. Every row of train counts, repeated ones too. With an empty train table all scores are 0, as only
    the unknown word remains. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    train = train.select(text)
    shards = 1 << max(4, (2 * train.rdd.getNumPartitions() - 1).bit_length())
    folder = S.table_path(spark, "ngrams")
    words = S.stored(train.mapInArrow(_word_counter(shards), _BLOBS).groupBy("shard").applyInArrow(_word_writer(folder), "shard int, v long, n long"), "words")
    sizes = {r["shard"]: r for r in words.collect()}  # one row per shard
    vs = [sizes[k]["v"] if k in sizes else 0 for k in range(shards)]
    v, n = sum(vs), sum(r["n"] for r in sizes.values())
    meta = {"folder": folder, "shards": shards, "v": v, "n": n, "offsets": [int(x) for x in np.cumsum([0, *vs[:-1]])], "step": -(-(v + 1) // shards)}
    share = spark.sparkContext.broadcast(meta)
    grams = S.stored(train.mapInArrow(_gram_counter(share), _BLOBS).groupBy("shard").applyInArrow(_gram_writer(share), _PARTS), "grams")
    split = S.stored(grams.where("kind in ('context', 'pair')").groupBy("shard").applyInArrow(_split_writer(share), _PARTS), "split")
    parts = grams.union(split)
    seen = {r["kind"]: r for r in parts.groupBy("kind").agg(*(F.sum(c).alias(c) for c in ("n", "n1", "n2", "n3", "n4"))).collect()}
    d3, d2 = (discounts(*(seen[k][c] for c in ("n1", "n2", "n3", "n4"))) if k in seen else discounts(0, 0, 0, 0) for k in ("grams", "pairs"))
    pairs = seen["pairs"]["n"] if "pairs" in seen else 0
    kind = "n1 long, n2 long, n3 long, n4 long, more long"
    stats = parts.where("kind in ('first', 'second')").groupBy("shard").applyInArrow(_stat_writer(share, d2), kind)
    t = S.stored(stats, "stats").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n1", "n2", "n3", "n4", "more"))).collect()[0]
    S.discard(words, grams, split)
    d1 = discounts(t["n1"], t["n2"], t["n3"], t["n4"])
    gamma = (d1[0] * t["n1"] + d1[1] * t["n2"] + d1[2] * t["more"]) / pairs if pairs else 1.0
    share = spark.sparkContext.broadcast(meta | {"d1": d1, "d2": d2, "d3": d3, "gamma1": gamma, "pairs": pairs, "keep": keep})
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, text).mapInArrow(_scorer(share), kinds + ", n_tokens long, n_known long, train_tokens long, base_score double, score double")
