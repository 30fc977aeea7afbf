"""Document fingerprints by a randomised edit embedding: random walks over characters, sampled, banded and verified.

All texts share one source of random bits, one for each time and class of characters. A walk stands on a character, at each time step
puts it out, and goes on to the next one where the bit of that time and character says so; the times at which it leaves its
characters are the whole walk. Two texts that differ by few edits walk apart and meet again, so a small edit distance becomes a small
Hamming distance between what they put out. A fingerprint samples that output: each of its digits belongs to a slot, a slot picks
one time uniformly from the walk (the last of a fixed sequence of record times before the walk's end, so texts of any lengths
pick alike where they can) and shows four bits of a hash of the character there. Bands are samples of digits: texts that share one
are candidates, and the share of equal digits decides.

Each walk needs the one before it only for its own text, so texts are walked side by side in numpy, the few longest of a batch one by one.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.llm import shared as S

SLOTS = 128
PERIOD = 1 << 14  # after so many steps the shared bits begin anew
NARROW = 64  # with fewer texts side by side, one by one is faster
BATCH = 1 << 23  # characters that are walked at once
BANDS, DIGITS = 20, 8
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


# ---------------------------------------------------------------- shared randomness


@cache
def waits() -> np.ndarray:
    """Flat [time, class]: steps from that time until the walk leaves a character of the class; each step leaves with probability 1/2."""
    leaves = np.random.default_rng(12).integers(0, 2, (PERIOD, 256), np.uint8).astype(bool)
    leaves[-1] = True
    at = np.where(leaves, np.arange(PERIOD, dtype=np.int32)[:, None], np.int32(PERIOD))
    following = np.minimum.accumulate(at[::-1], axis=0)[::-1]
    return (following - np.arange(PERIOD, dtype=np.int32)[:, None] + 1).astype(np.uint8).ravel()


@cache
def records() -> np.ndarray:
    """[slot, k]: the k-th record time of a slot. For any end, the last one before it is uniform over the times before it."""
    r = np.random.default_rng(34)
    rows = []
    for _ in range(SLOTS):
        times = [0]
        while times[-1] < 1 << 45:
            times.append(int((times[-1] + 1) / (1.0 - r.random())))
        rows.append(times)
    out = np.full((SLOTS, max(map(len, rows))), 1 << 62, np.int64)
    for row, times in zip(out, rows, strict=True):
        row[: len(times)] = times
    return out


@cache
def band_slots() -> np.ndarray:
    r = np.random.default_rng(56)
    return np.array([r.choice(SLOTS, DIGITS, replace=False) for _ in range(BANDS)])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _classes(codes: np.ndarray) -> np.ndarray:
    return ((codes * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8)


# ---------------------------------------------------------------- walks


def walk(codes: np.ndarray, begin: np.ndarray, n: np.ndarray, since: np.ndarray) -> np.ndarray:
    """For texts of n characters from `begin` in codes, walked from the times `since`: the time at which each character is left."""
    kind, wait, mask = _classes(codes), waits(), PERIOD - 1
    left = np.empty(len(codes), np.int64)
    order = np.argsort(-n, kind="stable")
    b, t, long_ = begin[order], since[order].astype(np.int64), n[order]
    common = int(long_[NARROW - 1]) if len(n) >= NARROW else 0
    walking = np.searchsorted(-long_, -np.arange(common), "left")  # texts with more than i characters
    for i, a in enumerate(walking.tolist()):
        at = b[:a] + i
        t[:a] += wait[((t[:a] & mask) << 8) | kind[at]]
        left[at] = t[:a]
    steps = wait.tobytes()
    for k in np.flatnonzero(long_ > common).tolist():
        now, times = int(t[k]), []
        for c in kind[b[k] + common : b[k] + long_[k]].tolist():
            now += steps[(now & mask) << 8 | c]
            times.append(now)
        left[b[k] + common : b[k] + long_[k]] = times
    return left


def _digits(codes: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Four bits of a hash of (slot, time, character); 0 where there is none (time below 0)."""
    slot = np.arange(SLOTS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = S.mix(S.mix(times.astype(np.uint64) + slot) + codes.astype(np.uint64))
    return np.where(times < 0, 0, (h >> np.uint64(60)).astype(np.int64)).astype(np.uint8)


def _sample(end: np.ndarray) -> np.ndarray:
    """[text, slot]: the slot's time in a walk that ends at `end`; -1 in an empty one."""
    r = records()
    out = np.empty((len(end), SLOTS), np.int64)
    for s in range(SLOTS):
        k = np.searchsorted(r[s], end, "left") - 1
        out[:, s] = np.where(k < 0, -1, r[s][np.maximum(k, 0)])
    return out


def digits_of(walks: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """[text, slot] of texts given as (code points, times at which they are left)."""
    times = _sample(np.array([left[-1] if len(left) else 0 for _, left in walks], np.int64))
    codes = np.zeros((len(walks), SLOTS), np.uint32)
    for row, (text, left), t in zip(codes, walks, times, strict=True):
        if len(left):
            row[:] = text[np.searchsorted(left, t, "right")]
    return _digits(codes, times)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal digits of the rows of a and b, less what chance gives; 0 to 1."""
    return np.maximum(0.0, ((a == b).mean(1) - 1 / 16) / (15 / 16))


def band_keys(digits: np.ndarray) -> np.ndarray:
    """[text, band]: number of the band and its digits in one integer."""
    weights = np.uint64(16) ** np.arange(DIGITS, dtype=np.uint64)
    value = (digits[:, band_slots()].astype(np.uint64) * weights).sum(2)
    return ((np.arange(BANDS, dtype=np.uint64) << np.uint64(4 * DIGITS)) + value).astype(np.int64)


def _text(digits: np.ndarray) -> list[str]:
    return [row.tobytes().decode() for row in _HEX[digits]]


def _walks(texts: list[np.ndarray], since: np.ndarray) -> list[np.ndarray]:
    n = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(n) - n
    left = walk(np.concatenate([*texts, np.zeros(0, np.uint32)]), begin, n, since)
    return [left[a : a + m] for a, m in zip(begin.tolist(), n.tolist(), strict=True)]


def fingerprints(texts: list[str]) -> np.ndarray:
    """Digits of each text."""
    codes = [code_points(t) for t in texts]
    return digits_of(list(zip(codes, _walks(codes, np.zeros(len(codes), np.int64)), strict=True)))


# ---------------------------------------------------------------- documents beside the next one

PRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, bands_edited int, bands_next int"
_DOCUMENT, _FIRST_OF_NEXT, _ALONE = 0, 1, 2


def _judge(rows: list[tuple]):
    """Rows (kind, doc_id, text) in their order; the last one only serves the one before it, unless it stands alone."""
    texts = [t or "" for _, _, t in rows]
    codes = [code_points(t) for t in texts]
    left = _walks(codes, np.zeros(len(codes), np.int64))
    digits = digits_of(list(zip(codes, left, strict=True)))
    own = [k for k in range(len(rows) - 1) if rows[k][0] == _DOCUMENT]
    cuts = [len(codes[k]) - len(codes[k]) // 2 for k in own]
    tails = [codes[k + 1][: len(codes[k]) // 2] for k in own]
    times = _walks(tails, np.array([left[k][c - 1] if c else 0 for k, c in zip(own, cuts, strict=True)], np.int64))
    edited = [(np.concatenate([codes[k][:c], tail]), np.concatenate([left[k][:c], t])) for k, c, tail, t in zip(own, cuts, tails, times, strict=True)]
    changed = digits_of(edited)
    near_edited, near_next = likeness(digits[own], changed), likeness(digits[own], digits[[k + 1 for k in own]])
    keys = band_keys(digits)
    shared_edited, shared_next = (keys[own] == band_keys(changed)).sum(1), (keys[own] == keys[[k + 1 for k in own]]).sum(1)
    sha = [hashlib.sha256((texts[k][:c] + texts[k + 1][: len(codes[k]) // 2]).encode()).hexdigest() for k, c in zip(own, cuts, strict=True)]
    single = [k for k in range(len(rows)) if rows[k][0] == _ALONE]
    nulls = [None] * len(single)
    kept = own + single
    return pa.RecordBatch.from_arrays(
        [
            pa.array([rows[k][1] for k in kept], pa.int64()), pa.array([len(codes[k]) for k in kept], pa.int64()), pa.array([*sha, *nulls], pa.string()),
            pa.array(_text(digits[kept]), pa.string()), pa.array([*_text(changed), *nulls], pa.string()),
            pa.array([*near_edited.tolist(), *nulls], pa.float64()), pa.array([*near_next.tolist(), *nulls], pa.float64()),
            pa.array([*shared_edited.tolist(), *nulls], pa.int32()), pa.array([*shared_next.tolist(), *nulls], pa.int32()),
        ],
        [c.split()[0] for c in PRINTS.split(", ")],
    )


def _in_order(batches):
    rows, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("kind", "doc_id", "text")), strict=True):
            rows.append(row)
            size += len(row[2] or "")
            if size >= BATCH and row[0] != _ALONE:
                yield _judge(rows)
                rows, size = [row], len(row[2] or "")
            elif size >= BATCH:
                yield _judge(rows)
                rows, size = [], 0
    if rows:
        yield _judge(rows)


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, bands_edited, bands_next for every row of docs.

    A document's edited text has its last half (floor(n_chars / 2) code points) replaced by the first as many code points, or all, of the
    next document in descending order of doc_id; after the last comes the first. near_* is the likeness of the fingerprints, bands_*
    the number of bands they share. Fingerprints depend on the text alone; the empty text's (null: empty) is all zeros. Rows that repeat
    a doc_id follow each other by text, nulls first. Rows without doc_id have no next document: their edited_* and the columns behind are null.
    A single document is its own next one. An empty table gives an empty result; other columns are ignored.

    One shuffle deals the texts into ranges of ids; the first row of a range also goes to the range that comes before it.
    """
    spark = docs.sparkSession
    docs = docs.selectExpr("cast(doc_id as bigint) AS doc_id", "cast(text as string) AS text")
    ids = docs.select("doc_id").where("doc_id is not null")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*[F.lit(k / ranges) for k in range(1, ranges)]) if ranges > 1 else F.array(F.lit(0.5))
    ends = sorted(set(ids.agg(F.percentile_approx("doc_id", shares, max(10_000, 50 * ranges)).alias("q")).collect()[0]["q"] or []))  # fewer than there are ranges
    part = _range_of(ends)
    heads = {r["part"]: r["head"] for r in ids.groupBy(part.alias("part")).agg(F.max("doc_id").alias("head")).collect()}  # one row a range
    order = sorted(heads)
    receiver = {p: order[(k + 1) % len(order)] for k, p in enumerate(order)}  # ids go down: a range's first row follows the next higher range's last
    also = F.create_map(*[F.lit(x) for p in order for x in (p, receiver[p])]) if order else F.create_map(F.lit(0), F.lit(0))
    here = F.struct(F.col("part"), F.when(F.col("doc_id").isNull(), _ALONE).otherwise(_DOCUMENT).alias("kind"))
    there = F.struct(also[F.col("part")].alias("part"), F.lit(_FIRST_OF_NEXT).alias("kind"))
    first = F.col("doc_id").isin(sorted(set(heads.values()))) if heads else F.lit(False)
    placed = docs.withColumn("part", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(ranges)).cast("int")).otherwise(part))
    placed = placed.select("doc_id", "text", F.explode(F.when(first, F.array(here, there)).otherwise(F.array(here))).alias("p")).select("p.*", "doc_id", "text")
    dealt = placed.repartitionById(ranges, F.col("part")).sortWithinPartitions("kind", F.col("doc_id").desc(), F.col("text").asc_nulls_first())
    return dealt.select("kind", "doc_id", "text").mapInArrow(_in_order, PRINTS)


def _range_of(ends: list[int]) -> Column:
    """How many of the ascending ends lie below doc_id, by halving steps over a constant array."""
    if not ends:
        return F.lit(0)
    steps = [F.lit(1 << k) for k in range(len(ends).bit_length() - 1, -1, -1)]
    below = lambda at: F.get(F.lit(ends).cast("array<bigint>"), at - 1) < F.col("doc_id")  # noqa: E731; null beyond the last end
    return F.aggregate(F.array(*steps), F.lit(0), lambda at, step: F.when(below(at + step), at + step).otherwise(at))


# ---------------------------------------------------------------- near copies


def _banded(batches):
    for batch in batches:
        digits = np.frombuffer("".join(batch.column("fingerprint").to_pylist()).encode(), np.uint8).reshape(-1, SLOTS)
        digits = np.where(digits < 97, digits - 48, digits - 87)
        keys = band_keys(digits)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column("rep")), BANDS), pa.int64()), pa.array(keys.ravel(), pa.int64())], ["rep", "band"])


def near_copies(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, component_id for rows (doc_id, fingerprint): the smallest doc_id reachable over links of fingerprints that are alike.

    Documents of one fingerprint are one class. Classes that share a band are candidates: the band's smallest class is compared with
    all others, those with a likeness of `least` or more link to it, the rest of the band goes into another round, so no band
    emits its pairs and no group is collected. Rows without doc_id are left out.
    """
    classes = S.stored(prints.where("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("rep")), "classes")
    left = S.stored(classes.mapInArrow(_banded, "rep long, band long"), "banded")
    digits = lambda c: F.split(c, "(?!$)")
    equal = F.size(F.filter(F.zip_with(digits("fingerprint"), digits("other"), lambda x, y: x == y), lambda e: e))
    alike = F.greatest(F.lit(0.0), (equal / SLOTS - 1 / 16) / (15 / 16)) >= least
    links = None
    while True:
        centre = left.groupBy("band").agg(F.min("rep").alias("centre"), F.count("*").alias("n")).where("n > 1").select("band", "centre")
        pairs = S.stored(left.join(centre, "band").where("rep <> centre"), "pairs")
        of = classes.select("rep", "fingerprint")
        judged = pairs.select("rep", "centre").distinct().join(of, "rep").join(of.select(F.col("rep").alias("centre"), F.col("fingerprint").alias("other")), "centre")
        judged = S.stored(judged.select("rep", "centre", alike.alias("alike")), "judged")
        found = judged.where("alike").select(F.col("rep").alias("a"), F.col("centre").alias("b"))
        links = found if links is None else links.union(found)
        S.discard(left)
        left = S.stored(pairs.join(judged.where("not alike"), ["rep", "centre"]).select("rep", "band"), "banded")
        S.discard(pairs)
        if left.isEmpty():
            break
    label = S.components(links)
    of = classes.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("fingerprint", F.coalesce("component", "rep").alias("component_id"))
    return prints.where("doc_id is not null").select("doc_id", "fingerprint").join(of, "fingerprint").select("doc_id", "component_id")
