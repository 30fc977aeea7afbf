"""Removal of byte strings that an earlier document already has, by suffix arrays.

Every 50-byte window belongs to the smallest hash of a 16-byte gram inside it (its minimizer). Equal windows have
equal minimizers, so consecutive windows of one minimizer are cut out together as one string, and all strings of a
minimizer meet in one shard. A first pass finds the minimizers that two documents share, as sorted hash arrays in
the shared folder that workers memory-map; only their strings are sent on. A string that a task has sent is named by
its digest from then on, and a text that several documents have whole enters once, with the smallest of them: in the others
every window is an earlier one. A minimizer with more than `HOT` runs is split further: its windows by where the gram stands
in them and by the bytes that windows with such a place have in common, so that equal windows still meet.

A shard's suffix arrays hold each of its different strings once, with the smallest document that has it, and decide
for every window: Larsson-Sadakane refinement (groups of equal prefixes are split by the ranks of what follows, sorted
ones are left alone), Kasai's common prefixes (compared only where the preceding bytes differ, counted down
elsewhere), classes of suffixes whose common prefix has 50 bytes. Arrays have about `PART` bytes, which stay in a core's
cache, and are cut between minimizers. Strings of one minimizer beyond `SHARD` bytes are cut into several arrays, and their
classes are merged by binary search of each one's windows in the others' sorted windows.

Tasks hold a bounded number of minimizers and strings whatever the size of their part of the input, and no step sorts
again what a task has sorted before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm import shared as S

U64 = np.uint64
GRAM = 16
SHARD = 2 << 20  # bytes of one suffix array at most; those that a group of strings has while there are few groups
PART = 200_000  # bytes of one suffix array where minimizers allow it
HOT = 50_000  # runs of one minimizer that a shard takes without splitting them
RANGES = 7  # parts of the places that a gram may have in a window
PIECE = 1 << 17  # bytes of text that a task hashes at once, so few that their arrays stay in a core's cache
LOOKED_UP = 1 << 20  # bytes of text whose minimizers are looked up at once
FLUSH = 12 << 20  # bytes of strings that a task holds before it sends them
HELD = 3_000_000  # minimizers that a task holds before it sends them


# ---------------------------------------------------------------- suffix arrays


def load8(buf: np.ndarray, kind: str) -> np.ndarray:
    """The 8 bytes from each position on as one number, zeros beyond the end."""
    n = len(buf)
    wide = np.zeros(n + 16, np.uint8)
    wide[:n] = buf
    out = np.empty(n, np.uint64)
    for o in range(min(8, n)):
        m = (n - o + 7) // 8
        out[o::8] = wide[o : o + 8 * m].view(kind)
    return out


def suffix_array(buf: np.ndarray) -> np.ndarray:
    """Larsson-Sadakane: each round doubles the sorted depth and touches only groups that are still unsorted."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int32)
    key = load8(buf, ">u8")
    sa = np.argsort(key).astype(np.int32)
    key = key[sa]
    change = np.r_[True, key[1:] != key[:-1]]
    start = np.maximum.accumulate(np.where(change, np.arange(n, dtype=np.int32), np.int32(0)))
    rank = np.empty(n + 1, np.int32)
    rank[sa] = start
    rank[n] = -1
    h = 8
    at = np.flatnonzero(~(change & np.r_[change[1:], True])).astype(np.int32)
    del key, change, start
    while len(at) and h < n + 8:
        sub = sa[at]
        key = (rank[sub].astype(np.int64) << 32) | (rank[np.minimum(sub + h, n)] + 1)
        order = np.argsort(key)
        sub, key = sub[order], key[order]
        sa[at] = sub
        new = np.r_[True, key[1:] != key[:-1]]
        rank[sub] = np.maximum.accumulate(np.where(new, at, np.int32(0)))
        at = at[~(new & np.r_[new[1:], True])]
        h *= 2
    return sa


def common_prefixes(buf: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Kasai: lcp[k] of suffixes sa[k-1], sa[k]. Where the preceding bytes agree it is the previous position's less one."""
    n = len(buf)
    phi = np.full(n, -1, np.int32)
    phi[sa[1:]] = sa[:-1]
    follows = np.zeros(n, bool)
    at = np.flatnonzero(phi[1:] > 0).astype(np.int32) + 1
    follows[at] = (buf[at - 1] == buf[phi[at] - 1]) & (phi[at - 1] == phi[at] - 1)
    plcp = np.zeros(n, np.int32)
    eight = load8(buf, "<u8")
    i = np.flatnonzero(~follows & (phi >= 0)).astype(np.int32)
    j = phi[i]
    depth = 0
    while len(i):
        a, b = i + depth, j + depth
        inside = (a < n) & (b < n)
        x = np.where(inside, eight[np.minimum(a, n - 1)] ^ eight[np.minimum(b, n - 1)], U64(1))
        same = x == 0
        low = x[~same] & (~x[~same] + U64(1))
        plcp[i[~same]] = depth + np.where(inside[~same], np.log2(low.astype(np.float64)).astype(np.int32) // 8, 0)
        i, j, depth = i[same], j[same], depth + 8
    del eight
    at = np.arange(n, dtype=np.int32)
    plcp = np.minimum(plcp, n - np.maximum(at, phi))
    head = np.maximum.accumulate(np.where(follows, np.int32(-1), at))
    return np.maximum(plcp[head] - (at - head), 0)[sa]


def earliest(strings: list[bytes], docs, length: int) -> list[np.ndarray]:
    """For each string's windows of `length` bytes: the smallest of docs among all strings that hold the window."""
    docs = np.asarray(docs, np.int64)
    chunks, lo, size = [], 0, 0
    for k, s in enumerate(strings):
        if size and size + len(s) > SHARD:
            chunks.append((lo, k))
            lo, size = k, 0
        size += len(s) + 4
    chunks.append((lo, len(strings)))
    out: list[np.ndarray] = []
    heads = []
    most = np.iinfo(np.int64).max
    for lo, hi in chunks:
        part = strings[lo:hi]
        # 0xFF is in no UTF-8 text; the number behind it makes every suffix differ
        buf = np.frombuffer(b"".join([x for k, s in enumerate(part) for x in (s, b"\xff" + k.to_bytes(3, "big"))]), np.uint8)
        lens = np.array([len(s) for s in part])
        begin = np.r_[0, np.cumsum(lens + 4)[:-1]]
        doc = np.full(len(buf), most)
        window = np.repeat(begin + np.maximum(lens - length + 1, 0), lens + 4) > np.arange(len(buf))
        doc[window] = np.repeat(docs[lo:hi], lens + 4)[window]
        sa = suffix_array(buf)
        new = common_prefixes(buf, sa) < length
        new[:1] = True
        at = np.flatnonzero(new)
        least = np.minimum.reduceat(doc[sa], at)
        of = np.empty(len(buf), np.int32)
        of[sa] = np.cumsum(new, dtype=np.int32) - 1
        heads.append((buf, sa[at], least, of, begin, lens))
    if len(heads) > 1:
        texts = []
        for buf, first, least, *_ in heads:
            keep = np.flatnonzero(least < most)
            wide = np.ones((len(keep), length + 1), np.uint8)  # the last byte keeps zeros at the end from being cut off
            wide[:, :length] = np.lib.stride_tricks.sliding_window_view(buf, length)[first[keep]]
            texts.append((keep, wide.view(f"S{length + 1}").ravel()))
        merged = [h[2].copy() for h in heads]
        for a, (ka, ta) in enumerate(texts):
            for b, (kb, tb) in enumerate(texts):
                if a != b and len(tb):
                    at = np.minimum(np.searchsorted(tb, ta), len(tb) - 1)
                    hit = tb[at] == ta
                    merged[a][ka[hit]] = np.minimum(merged[a][ka[hit]], heads[b][2][kb[at[hit]]])
        heads = [(h[0], h[1], m, *h[3:]) for h, m in zip(heads, merged, strict=True)]
    for _, _, least, of, begin, lens in heads:
        values = least[of]
        out += [values[b : b + n - length + 1] for b, n in zip(begin.tolist(), lens.tolist(), strict=True)]
    return out


# ---------------------------------------------------------------- the Spark jobs


def _runs(buf: np.ndarray, off: np.ndarray, length: int):
    """Of maximal runs of windows with one minimizer: begin, end (of starts), row, minimizer; and the hash of every gram."""
    n = len(buf) - length + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    eight = load8(buf, "<u8")
    m = len(buf) - GRAM + 1
    grams = g = S.mix(S.mix(eight[:m]) + eight[8 : 8 + m] * U64(0x9E3779B97F4A7C15))
    width, span = length - GRAM + 1, 1
    while 2 * span <= width:
        g = np.minimum(g[:-span], g[span:])
        span *= 2
    f = np.minimum(g[:n], g[width - span : width - span + n])
    lens = np.diff(off)
    edge = np.zeros(len(buf) + 1, np.int32)
    long = lens >= length
    np.add.at(edge, off[:-1][long], 1)
    np.add.at(edge, off[1:][long] - length + 1, -1)
    valid = np.cumsum(edge[:n]) > 0
    change = np.r_[True, (f[1:] != f[:-1]) | (valid[1:] != valid[:-1])]
    begin = np.flatnonzero(change)
    end = np.r_[begin[1:], n]
    keep = valid[begin]
    begin, end = begin[keep], end[keep]
    return begin, end, np.searchsorted(off, begin, "right") - 1, f[begin], grams


def _sums(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, whether several documents have them (marked so or there twice, as a document comes once), and the sums of their runs."""
    k, two, runs = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, kind), np.zeros(0, bool), np.zeros(0, np.uint32))
    order = np.argsort(k)
    k, two, runs = k[order], two[order], runs[order]
    del order, parts
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    if not len(k):
        return k, two, runs
    two = np.logical_or.reduceat(two, first) | (np.diff(np.r_[first, len(k)]) > 1)
    return k[first], two, np.minimum(np.add.reduceat(runs, first, dtype=np.int64), 2**32 - 1).astype(np.uint32)


def _halves(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Both 64-bit halves of 16-byte digests."""
    both = np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _texts(folder: str):
    def write(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Digests of a shard's texts that several documents have, with the smallest of these; the bytes of all its texts."""
        size, parts = 0, []
        for batch in batches:
            size += int(np.array(batch.column("n")).sum())
            many = np.array(batch.column("first")) < np.array(batch.column("last"))
            own = batch.filter(pa.array(many))
            parts.append((*_halves(own.column("digest")), np.array(own.column("first")).astype(np.int64)))
        a, b, first = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(a)
        a, b, first = a[order], b[order], first[order]
        alone = np.r_[True, a[1:] != a[:-1]] & np.r_[a[1:] != a[:-1], True][: len(a)] if len(a) else np.zeros(0, bool)  # others are taken for different texts
        S.write_array(folder, f"same-{key[0].as_py()}", np.concatenate([a[alone], b[alone], first[alone].view(np.uint64)]))
        yield pa.RecordBatch.from_pydict({"size": pa.array([size], pa.int64())})

    return write


def _copies(arrays: S.Arrays, same: int, digest: pa.Array, ids: np.ndarray) -> np.ndarray:
    """Which documents have the whole text of a smaller one."""
    a, b = _halves(digest)
    order = np.argsort(a)
    shard = (a[order] >> U64(65 - same.bit_length())).astype(np.int64)
    hit = np.zeros(len(a), bool)
    edges = np.r_[0, np.flatnonzero(shard[1:] != shard[:-1]) + 1, len(a)]
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if lo < hi and (n := len(own := arrays.get(f"same-{int(shard[lo])}", np.uint64)) // 3):
            k = order[lo:hi]
            at = np.minimum(np.searchsorted(own[:n], a[k]), n - 1)
            hit[k] = (own[:n][at] == a[k]) & (own[n : 2 * n][at] == b[k]) & (own[2 * n :][at].view(np.int64) < ids[k])
    return hit


def _first_ones(batch: pa.RecordBatch, arrays: S.Arrays, same: int) -> pa.RecordBatch:
    """Without documents that have the whole text of a smaller one."""
    gone = _copies(arrays, same, batch.column("digest"), np.array(batch.column("doc_id")).astype(np.int64))
    return batch.filter(pa.array(~gone)) if gone.any() else batch


def _finder(length: int, shards: int, folder: str, same: int):
    bits = shards.bit_length() - 1

    def sent(x: np.ndarray, two: np.ndarray, runs: np.ndarray) -> pa.RecordBatch:
        """A row per shard."""
        cut = np.searchsorted(x, np.arange(shards, dtype=np.uint64) << U64(64 - bits)) if bits else np.array([0])
        cut = np.r_[cut, len(x)]
        low = ((x << U64(bits)) >> U64(32)).astype(np.uint32)
        once = ~two & (runs == 1)
        rows = []
        for k in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
            own, one = slice(cut[k], cut[k + 1]), once[cut[k] : cut[k + 1]]
            rows.append((k, low[own][one].tobytes(), low[own][~one].tobytes(), two[own][~one].tobytes(), runs[own][~one].tobytes()))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["shard", "once", "more", "docs", "runs"])

    def find(batches):
        """Minimizers, whether several documents have them, and their runs; a row per shard, again when HELD minimizers are there."""
        arrays = S.Arrays(folder)
        found, held = [], 0
        for batch in batches:
            for _, _, buf, off in S.pieces(_first_ones(batch, arrays, same).column("text"), PIECE):
                _, _, row, f, _ = _runs(buf, off, length)
                f = S.mix(f)  # minima lie near zero; shards are ranges of mixed ones
                order = np.argsort(f, kind="stable")
                f, d = f[order], row[order]
                first = np.flatnonzero(np.r_[True, f[1:] != f[:-1]]) if len(f) else np.zeros(0, np.int64)
                last = np.r_[first[1:], len(f)] - 1 if len(f) else first
                found.append((f[first], d[last] != d[first], (last - first + 1).astype(np.uint32)))
                held += len(first)
                if held > HELD:
                    found = [_sums(found, np.uint64)]
                    held = len(found[0][0])
                    if held > HELD // 2:  # else as many come in before the next sum as are kept here
                        yield sent(*found[0])
                        found, held = [], 0
        yield sent(*_sums(found, np.uint64))

    return find


def _sharer(folder: str, hot: int):
    def share(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        held, most = 0, 6_000_000
        for batch in batches:
            for once, more, docs, runs in zip(*(batch.column(c).to_pylist() for c in ("once", "more", "docs", "runs")), strict=True):
                a, b = np.frombuffer(once, np.uint32), np.frombuffer(more, np.uint32)
                parts += [(a, np.zeros(len(a), bool), np.ones(len(a), np.uint32)), (b, np.frombuffer(docs, bool), np.frombuffer(runs, np.uint32))]
                held += len(a) + len(b)
                if held > most:
                    parts = [_sums(parts, np.uint32)]
                    held = len(parts[0][0])
                    most = max(6_000_000, 2 * held)
        x, twice, runs = _sums(parts, np.uint32)
        k = key[0].as_py()
        S.write_array(folder, f"shard-{k}", x[twice])
        much = (x[twice & (runs > hot)].astype(np.uint64) | U64(k << 32)).tobytes()
        yield pa.RecordBatch.from_pydict({"runs": pa.array([int(runs[twice].sum(dtype=np.int64))], pa.int64()), "hot": pa.array([much], pa.binary())})

    return share


def _digests(total: np.ndarray, power: np.ndarray, inverse: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from a to b: of all their grams, which are mixed, so no pattern of bytes cancels out."""
    return S.mix((total[b - GRAM + 1] - total[a]) * inverse[a] + (b - a).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def _split(begin, end, f, grams, length: int, digest):
    """Runs of hot minimizers cut by the gram's place in the window: run, begin, end, key. digest: of bytes a to b."""
    width = length - GRAM + 1
    step = -(-width // RANGES)
    out = []
    at, most = 0, 0
    while at < len(begin):  # about 100 000 windows at once
        most = at + max(1, int(np.searchsorted(np.cumsum(end[at:] - begin[at:]), 100_000)))
        size = end[at:most] - begin[at:most]
        run = np.repeat(np.arange(at, min(most, len(begin))), size)
        s = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size) + begin[run]
        place = (grams[np.minimum(s[:, None] + np.arange(width), len(grams) - 1)] == f[run][:, None]).argmax(1)
        part = place // step
        gram = s + place
        new = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (part[1:] != part[:-1]) | (gram[1:] != gram[:-1])])
        until = np.r_[new[1:], len(run)]
        left = gram[new] - part[new] * step  # windows of a part have `length - step + 1` bytes from here on in common
        key = digest(left, left + length - step + 1) + (part[new] + 1).astype(np.uint64) * U64(0x9E3779B97F4A7C15)
        out.append((run[new], s[new], s[until - 1] + 1, S.mix(key ^ f[run[new]])))
        at = most
    return [np.concatenate(x) for x in zip(*out, strict=True)]


_SENT = ("keys", "digests", "docs", "begins", "lengths", "fresh", "strings")
_SENT_SCHEMA = "shard int, " + ", ".join(f"{c} binary" for c in _SENT)


class _Seen:
    """Numbers in a few sorted arrays, each at least twice as long as the next, so none is sorted often."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def new(self, u: np.ndarray) -> np.ndarray:
        """Which of the sorted, different u were not here; now they are."""
        out = np.ones(len(u), bool)
        for own in self.levels:
            out &= own[np.minimum(np.searchsorted(own, u), len(own) - 1)] != u
        if out.any():
            self.levels.append(u[out])
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            self.levels[-2:] = [np.sort(np.concatenate(self.levels[-2:]))]
        return out


def _cutter(length: int, shards: int, folder: str, same: int, targets: int):
    bits = shards.bit_length() - 1

    def shared(arrays: S.Arrays, x: np.ndarray) -> np.ndarray:
        """Which of the sorted minimizers x several documents have."""
        shard = (x >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64)
        low = ((x << U64(bits)) >> U64(32)).astype(np.uint32)
        hit = np.zeros(len(x), bool)
        edges = np.r_[0, np.flatnonzero(shard[1:] != shard[:-1]) + 1, len(x)]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if a < b and len(own := arrays.get(f"shard-{int(shard[a])}", np.uint32)):
                at = np.minimum(np.searchsorted(own, low[a:b]), len(own) - 1)
                hit[a:b] = own[at] == low[a:b]
        return hit

    def is_hot(arrays: S.Arrays, x: np.ndarray) -> np.ndarray:
        own, x = arrays.get("hot", np.uint64), x >> U64(32 - bits)
        return own[np.minimum(np.searchsorted(own, x), len(own) - 1)] == x if len(own) else np.zeros(len(x), bool)

    def sent(held: list[tuple]):
        """A row per shard."""
        key, digest, doc, at, size, fresh = (np.concatenate(x) for x in list(zip(*held, strict=True))[:6])
        text = np.frombuffer(b"".join(x[6] for x in held), np.uint8)
        start = np.zeros(len(key), np.int64)
        start[fresh] = np.cumsum(size[fresh]) - size[fresh]
        shard = (key % U64(targets)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(targets + 1))
        for k in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            own = order[edges[k] : edges[k + 1]]
            new = own[fresh[own]]
            n = size[new]
            bytes_ = text[np.repeat(start[new] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            yield (k, *(x.tobytes() for x in (key[new], digest[own], doc[own], at[own], size[own].astype(np.uint32), fresh[own])), pa.compress(bytes_, "zstd", asbytes=True))

    def cut(batches):
        arrays = S.Arrays(folder, 1 << 14)
        seen = _Seen()
        held: list[tuple] = []
        weight = 0

        def flush():
            rows = list(sent(held)) if held else []
            for lo in range(0, len(rows), 256):
                cols = list(zip(*rows[lo : lo + 256], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["shard", *_SENT])

        def some(wide: list[tuple]) -> Iterator[tuple]:
            """Strings of these pieces that several documents may have."""
            f = S.mix(np.concatenate([x[-2] for x in wide]))
            order = np.argsort(f)
            there = np.zeros(len(f), bool)
            there[order] = shared(arrays, f[order])
            hot = np.zeros(len(f), bool)
            hot[there] = is_hot(arrays, f[there])
            at = 0
            for ids, buf, off, begin, end, row, f, grams in wide:
                pick, much = there[at : at + len(f)], hot[at : at + len(f)]
                at += len(f)
                if not pick.any():
                    continue
                power, inverse = S.powers(len(buf))
                total = np.zeros(len(grams) + 1, np.uint64)
                np.cumsum(grams * power[: len(grams)], out=total[1:])
                digest = lambda a, b, t=total, p=power, i=inverse: _digests(t, p, i, a, b)
                plain, much = np.flatnonzero(pick & ~much), np.flatnonzero(much)
                a, b, r, key = begin[plain], end[plain], row[plain], f[plain]
                if len(much):
                    run, c, d, k = _split(begin[much], end[much], f[much], grams, length, digest)
                    a, b, r, key = np.r_[a, c], np.r_[b, d], np.r_[r, row[much][run]], np.r_[key, k]
                z = b + length - 1
                name = digest(a, z) ^ S.mix(key)
                u, first = np.unique(name, return_index=True)
                fresh = np.zeros(len(a), bool)
                fresh[first[seen.new(u)]] = True
                n = (z - a)[fresh]
                text = buf[np.repeat(a[fresh] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()
                yield key, name, ids[r].astype(np.int64), a - off[r], z - a, fresh, text

        for batch in batches:
            batch = _first_ones(batch, arrays, same)
            ids = np.array(batch.column("doc_id"))
            wide: list[tuple] = []
            many = 0
            for lo, hi, buf, off in S.pieces(batch.column("text"), PIECE):
                wide.append((ids[lo:hi], buf, off, *_runs(buf, off, length)))
                many += len(buf)
                if many > LOOKED_UP or hi == batch.num_rows:
                    for x in some(wide):
                        held.append(x)
                        weight += len(x[-1]) + 37 * len(x[0])
                    wide, many = [], 0
                    if weight > FLUSH:
                        yield from flush()
                        held, weight = [], 0
        yield from flush()

    return cut


def _marker(length: int):
    def mark(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = dict(zip(_SENT, (np.uint64, np.uint64, np.int64, np.int64, np.uint32, bool), strict=False))
        parts: dict[str, list] = {c: [] for c in kinds}
        texts: list[bytes] = []
        # keys come with the first string of a digest only
        for batch in batches:
            for r in range(batch.num_rows):
                for c, kind in kinds.items():
                    parts[c].append(np.frombuffer(batch.column(c)[r].as_py(), kind))
                if n := int(parts["lengths"][-1][parts["fresh"][-1]].sum(dtype=np.int64)):
                    texts.append(pa.decompress(batch.column("strings")[r].as_py(), n, "zstd", asbytes=True))
        keys, name, doc, at, size, fresh = (np.concatenate(parts.pop(c)) for c in kinds)
        text = np.frombuffer(b"".join(texts), np.uint8)
        del texts
        size = size[fresh].astype(np.int64)
        begin = np.cumsum(size) - size
        name, back = np.unique(name, return_inverse=True)
        sender = np.empty(len(name), np.int64)  # of each string, the first that came
        sender[back[fresh][::-1]] = np.arange(len(size))[::-1]
        mate = sender[back[fresh]]
        _equal(text, size, begin, np.flatnonzero(mate != np.arange(len(size))), mate)
        order = np.argsort(keys[sender], kind="stable")  # strings of a minimizer next to each other
        place = np.empty(len(name), np.int64)
        place[order] = np.arange(len(name))
        rows = np.argsort(place[back], kind="stable")
        own, doc, at = place[back][rows], doc[rows], at[rows]
        del back, rows, mate
        least = np.minimum.reduceat(doc, np.searchsorted(own, np.arange(len(name))))
        sender = sender[order]
        begin, size, keys = begin[sender], size[sender], keys[sender]
        weight, first = np.cumsum(size), 0
        ends = np.r_[np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]  # where a minimizer's strings end
        while first < len(keys):
            until = int(ends[min(np.searchsorted(weight[ends - 1], weight[first] - size[first] + PART), len(ends) - 1)])
            raw = [text[a : a + n].tobytes() for a, n in zip(begin[first:until].tolist(), size[first:until].tolist(), strict=True)]
            lo, hi = np.searchsorted(own, [first, until])
            yield from _spans(earliest(raw, least[first:until], length), own[lo:hi] - first, doc[lo:hi], at[lo:hi], length)
            first = until

    return mark


def _equal(text: np.ndarray, size: np.ndarray, begin: np.ndarray, these: np.ndarray, mate: np.ndarray) -> None:
    """Compares the bytes of strings with those of the strings that have the same digest."""
    for lo in range(0, len(these), 20_000):
        a = these[lo : lo + 20_000]
        b, n = mate[a], size[a]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if (n != size[b]).any() or (text[np.repeat(begin[a], n) + at] != text[np.repeat(begin[b], n) + at]).any():
            raise RuntimeError("two strings have one 64-bit digest")


def _spans(windows: list[np.ndarray], own: np.ndarray, doc: np.ndarray, at: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
    """What goes of runs of documents: own is the string of each run, windows the earliest documents of a string's windows."""
    size = np.array([len(w) for w in windows])
    flat = np.concatenate(windows)
    start = np.r_[0, np.cumsum(size)[:-1]]
    edge = np.zeros(len(flat), bool)
    edge[start] = True
    edge[1:] |= flat[1:] != flat[:-1]
    seg = np.flatnonzero(edge)  # stretches of a string whose windows have one earliest document
    until = np.r_[seg[1:], len(flat)]
    of = np.searchsorted(start, seg, "right") - 1
    lo, hi = np.searchsorted(of, own), np.searchsorted(of, own, "right")
    n = hi - lo
    who = np.repeat(np.arange(len(own)), n)
    k = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    gone = flat[seg[k]] < doc[who]
    who, k = who[gone], k[gone]
    shift = at[who] - start[of[k]]
    begin, end = shift + seg[k], shift + until[k] - 1 + length
    for lo in range(0, len(who), 200_000):
        cut = slice(lo, lo + 200_000)
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc[who[cut]]), "begin": pa.array(begin[cut]), "end": pa.array(end[cut])})


def _remover(columns: list[str], length: int, folder: str, same: int):
    def remove(batches):
        arrays = S.Arrays(folder)
        for batch in batches:
            spans = batch.column("spans")
            begins, ends = (spans.flatten().field(k).to_numpy().tolist() for k in range(2))
            of = np.r_[0, np.cumsum(np.array(spans.value_lengths().fill_null(0)))].tolist()
            copy = _copies(arrays, same, batch.column("digest").fill_null(bytes(16)), np.array(batch.column("key").fill_null(np.iinfo(np.int64).min)))
            kept, n_bytes, n_removed, n_spans, digest = [], [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                raw = (text or "").encode()
                n_bytes.append(len(raw))
                parts, to, runs, removed = [], 0, 0, 0
                mine = [(0, len(raw))] if copy[k] and len(raw) >= length else sorted(zip(begins[of[k] : of[k + 1]], ends[of[k] : of[k + 1]], strict=True))
                for begin, end in mine:
                    if begin > to or not runs:
                        runs += 1
                        parts.append(raw[to:begin])
                        removed -= begin
                        removed += begin
                    if end > to:
                        removed += end - max(begin, to)
                        to = end
                parts.append(raw[to:])
                left = b"".join(parts)
                kept.append(text if not runs else left.decode(errors="ignore"))
                n_removed.append(removed)
                n_spans.append(runs)
                digest.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns]
                + [pa.array(kept, pa.string()), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest)],
                names=[*columns, "kept_text", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return remove


def _digest(text: str):
    """Half of the text's SHA-256."""
    return F.unhex(F.substring(F.sha2(F.col(text), 256), 1, 32))


def _parts_removed(docs: DataFrame, length: int, hot: int) -> tuple[DataFrame, str, int]:
    """doc_id, begin, end (bytes of the whole text; several rows may overlap or touch) of documents whose text no smaller one has whole; where these texts are listed."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("length(text) > 0 and doc_id is not null").withColumn("digest", _digest("text"))
    folder = S.table_path(spark, "minimizers")
    same = 1 << max(4, (docs.rdd.getNumPartitions() // 8).bit_length())
    texts = docs.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max(F.octet_length("text")).cast("long").alias("n"))
    top = F.conv(F.substring(F.hex("digest"), 1, 4), 16, 10).cast("int")
    listed = texts.groupBy(F.shiftright(top, 17 - same.bit_length()).alias("shard")).applyInArrow(_texts(folder), "size long")
    size = listed.agg(F.coalesce(F.sum("size"), F.lit(0))).collect()[0][0]
    shards = 1 << max(4, (size // (18 << 20)).bit_length())  # about a million minimizers in each
    found = docs.mapInArrow(_finder(length, shards, folder, same), "shard int, once binary, more binary, docs binary, runs binary")
    shared = found.groupBy("shard").applyInArrow(_sharer(folder, hot), "runs long, hot binary").collect()
    runs = sum(r.runs for r in shared)
    S.write_array(folder, "hot", np.sort(np.frombuffer(b"".join(r.hot for r in shared), np.uint64)))  # one for `hot` runs at most
    groups = (40 * runs // SHARD).bit_length()  # a run's string has about 68 bytes, and half of them differ
    targets = 1 << max(4, groups - min(4, max(0, groups - 9)))  # beyond 512 groups they grow first, so that tasks send no crumbs
    sent = docs.mapInArrow(_cutter(length, shards, folder, same, targets), _SENT_SCHEMA)
    return sent.groupBy("shard").applyInArrow(_marker(length), "doc_id long, begin long, end long"), folder, same


def suffix_dedup(docs: DataFrame, length: int = 50, hot: int = HOT) -> DataFrame:
    """All columns of docs but text, then kept_text, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller doc_id;
    judged on the input. Null text: empty, n_bytes 0, kept_text null. Rows that repeat a doc_id must repeat its
    text; none of them is earlier than the others. Rows without doc_id keep their text and make nobody else's go. kept_text drops bytes of a character that was cut in part;
    kept_sha256 is of the kept bytes themselves. An empty table gives an empty result.
    """
    parts, folder, same = _parts_removed(docs, length, hot)
    spans = parts.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    rest = [c for c in docs.columns if c != "text"]
    own = [f"c{k}" for k in range(len(rest))]  # whatever the columns are called
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(rest, own, strict=True)], F.col("doc_id").cast("long").alias("__key"), F.col("text").cast("string").alias("text"))
    joined = inner.join(spans, F.col("__key") == F.col("__id"), "left").select(*own, F.col("__key").alias("key"), "text", _digest("text").alias("digest"), "spans")
    kind = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for c, n in zip(rest, own, strict=True))
    made = joined.mapInArrow(_remover(own, length, folder, same), kind + "kept_text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return made.select(*[F.col(n).alias(c) for c, n in zip(rest, own, strict=True)], "kept_text", "n_bytes", "n_removed", "n_spans", "kept_sha256")
