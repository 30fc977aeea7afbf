"""Hard negatives, fingerprints and importance resampling against brute force; nulls, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeloom.llm import fingerprints as P
from timeloom.llm import shared as S
from timeloom.llm.hard_negatives import NONE, Heaps, bounds, hard_negatives, scores, strassen
from timeloom.llm.resampling import gains, grams, patterns, resample

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = "the quick brown fox jumps over the lazy dog while seven small cats watch from a wide green wall and nobody speaks at all today "


# ---- 11


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 64, 5), (65, 67, 129), (130, 33, 70), (200, 100, 257), (4, 0, 3), (0, 5, 2)])
def test_strassen_is_the_product(shape):
    m, k, n = shape
    r = np.random.default_rng(m)
    a, b = r.integers(-300, 300, (m, k)), r.integers(-300, 300, (k, n))
    assert (strassen(a, b) == a @ b).all()
    a, b = r.integers(-(2**62), 2**62, (m, k)), r.integers(-(2**62), 2**62, (k, n))
    assert (strassen(a, b) == a @ b).all()  # both wrap modulo 2**64


def test_scores_beyond_doubles_and_64_bits():
    a, b = np.array([[2.0**31, 3.0], [1.0, 1.0]]), np.array([[2.0**29, 1.0], [2.0**31, 5.0]])
    assert scores(a, b).tolist() == [[2**60 + 3, 2**62 + 15], [2**29 + 1, 2**31 + 5]]
    assert scores(np.array([[2.0**40]]), np.array([[2.0**40], [-(2.0**40)], [2.0]])).tolist() == [[2**63 - 1, -(2**63) + 1, 2**41]]
    assert bounds(10, 30, 90) == (3, 9) and bounds(11, 30, 90) == (4, 9) and bounds(0, 30, 90) == (0, 0)
    lo, hi = bounds(-10, 30, 90)
    assert lo > hi


def test_heaps_merge_in_any_order():
    r = np.random.default_rng(3)
    score, ids = r.integers(0, 6, (4, 500)), r.permutation(500)
    for parts in (1, 7, 40):
        h = Heaps(4, 10, np.array([0, 1, 2, 9]), np.array([9, 4, 2, 9]))
        for at in np.array_split(r.permutation(500), parts):
            h.offer(np.arange(4), score[:, at], ids[at])
        for w, (lo, hi) in enumerate([(0, 9), (1, 4), (2, 2), (9, 9)]):
            best = sorted((-s, i) for s, i in zip(score[w].tolist(), ids.tolist(), strict=True) if lo <= s <= hi)[:10]
            assert [(-s, i) for s, i in zip(h.score[w].tolist(), h.id[w].tolist(), strict=True) if s > NONE] == best


def brute_negatives(rows, scale, k, n, low, high):
    """rows of (vec_id, label, vector), anchors: ids divisible by 10."""
    v = {}
    for i, label, e in sorted((r for r in rows if None not in r and all(x is not None and math.isfinite(x) for x in r[2])), key=lambda r: (r[0], r[1])):
        v.setdefault(i, (label, [math.floor(scale * x) for x in e]))
    out = []
    for a, (la, xa) in v.items():
        if a % 10:
            continue
        near = {i: sum(p * q for p, q in zip(xa, x, strict=True)) for i, (_, x) in v.items() if len(x) == len(xa)}
        mine = sorted((-s, i) for i, s in near.items() if i != a and v[i][0] == la)[:k]
        for s, p in mine:
            fits = sorted((-t, i) for i, t in near.items() if v[i][0] != la and low * -s <= 100 * t <= high * -s)[:n]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i) in enumerate(fits)]
    return sorted(out)


def test_hard_negatives_against_brute_force(spark, monkeypatch):
    import timeloom.llm.hard_negatives as H

    r = np.random.default_rng(11)
    rows = [(i, int(r.integers(3)), r.integers(-3, 4, 5).astype(float).tolist()) for i in range(300)]  # many ties
    rows += [(400 + i, i % 3, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(60)]  # one vector many times
    rows += [(500, 1, None), (510, None, [1.0] * 5), (None, 1, [1.0] * 5), (520, 1, [1.0, None, 1.0, 1.0, 1.0]), (530, 1, [float("nan")] * 5), (540, 1, [float("inf")] * 5)]
    rows += [(550, 0, [1.0, 2.0]), (551, 0, [1.0, 2.5]), (552, 1, [0.5, 1.0]), (560, 2, []), (561, 2, []), (562, 1, []), (570, 7, [0.3] * 5), (580, 1, [0.0] * 5)]
    rows += rows[:7]
    monkeypatch.setattr(H, "BLOCK", 8)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("score", F.lit(2))
    found = hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label"), scale=4, positives=5, negatives=10, low=30, high=90)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(tuple(x) for x in found.collect())
    assert got == brute_negatives(rows, 4, 5, 10, 30, 90) and len(got) > 500
    assert not hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0, F.col("label")).count()


# ---- 12


def plain_print(text: str) -> str:
    """The walk step by step, the digit of every slot one by one."""
    wait, codes = P.waits().reshape(P.PERIOD, 256), [ord(c) for c in text]
    put_out = []
    for c in codes:
        put_out += [c] * int(wait[len(put_out) % P.PERIOD, ((c * 2654435761) % 2**32) >> 24])
    digits = []
    for slot, times in enumerate(P.records().tolist()):
        before = [t for t in times if t < len(put_out)]
        if not before:
            digits.append("0")
            continue
        s = np.array([before[-1]], np.uint64) + np.uint64(slot * 0x9E3779B97F4A7C15 % 2**64)
        digits.append(f"{int(S.mix(S.mix(s) + np.uint64(put_out[before[-1]]))[0]) >> 60:x}")
    return "".join(digits)


HARD = [None, "", "a", "ab", "abc", BASE, BASE.upper(), BASE * 40, "é\U0001f600\x00" * 30, "x" * 5000, BASE[:-1], BASE]


def test_fingerprints_against_single_steps():
    texts = [t or "" for t in HARD]
    assert P._text(P.fingerprints(texts)) == [plain_print(t) for t in texts]
    many = [BASE[k % 40 :] * (1 + k % 5) for k in range(200)]  # walked side by side
    assert P._text(P.fingerprints(many)) == [plain_print(t) for t in many]
    start = P.waits().reshape(P.PERIOD, 256)
    assert start.min() == 1 and abs(start.mean() - 2) < 0.05


def test_likeness_falls_with_edits():
    r = np.random.default_rng(1)
    base = "".join(r.choice(list("abcdefghij klmnop"), 6000))
    seen = [1.0]
    for n in (5, 60, 600):
        s = list(base)
        for at in sorted(r.choice(len(s), n, replace=False), reverse=True):
            s[at : at + 1] = [["q"], [], ["q", s[at]]][int(r.integers(3))]
        d = P.fingerprints([base, "".join(s)])
        seen.append(float(P.likeness(d[:1], d[1:])[0]))
    assert seen[1] > 0.7 and seen == sorted(seen, reverse=True)


def next_and_edited(rows):
    rows = sorted((r for r in rows if r[0] is not None), key=lambda r: (-r[0], r[1] is not None, r[1] or ""))
    texts = [t or "" for _, t in rows]
    out = []
    for k, (i, _) in enumerate(rows):
        t, following = texts[k], texts[(k + 1) % len(texts)]
        out.append((i, t, t[: len(t) - len(t) // 2] + following[: len(t) // 2], following))
    return out


@pytest.mark.parametrize("size", [1, 2, 12, 150])
def test_document_fingerprints_against_brute_force(spark, size):
    r = np.random.default_rng(size)
    rows = [(k * k - 50, t) for k, t in enumerate(HARD)][:size] + [(1000 + k, " ".join(r.choice(BASE.split(), int(r.integers(0, 60))))) for k in range(size - len(HARD))]
    rows += rows[3:5]
    alone = [(None, "no id"), (None, None)]
    df = spark.createDataFrame(rows + alone, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS part", "'k' AS kind", "2 AS p")
    got = P.document_fingerprints(df).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0, x.n_chars, x.edited_sha256 or "", x.fingerprint, x.edited_fingerprint or "") for x in got) == sorted(
        [(False, i, len(t), hashlib.sha256(e.encode()).hexdigest(), plain_print(t), plain_print(e)) for i, t, e, _ in next_and_edited(rows)]
        + [(True, 0, len(t or ""), "", plain_print(t or ""), "") for _, t in alone]
    )
    share = lambda x, y: max(0.0, (sum(a == b for a, b in zip(x, y, strict=True)) / 128 - 1 / 16) / (15 / 16))
    by_id = {}
    for i, t, e, following in next_and_edited(rows):
        by_id.setdefault(i, []).append((share(plain_print(t), plain_print(e)), share(plain_print(t), plain_print(following))))
    for x in got:
        if x.doc_id is not None:
            assert any(abs(x.near_edited - a) + abs(x.near_next - b) < 1e-12 for a, b in by_id[x.doc_id])
    assert not P.document_fingerprints(df.limit(0)).count()


def test_batches_do_not_change_fingerprints(spark, monkeypatch):
    rows = [(k, BASE[k % 50 :] * 3) for k in range(80)] + [(None, "x")]
    want = {(x.doc_id, x.edited_sha256, x.fingerprint, x.near_next) for x in P.document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    small = [(P._DOCUMENT, i, t) for i, t in reversed(rows[:-1])] + [(P._FIRST_OF_NEXT, *rows[-2]), (P._ALONE, *rows[-1])]
    import pyarrow as pa

    monkeypatch.setattr(P, "BATCH", 1000)
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*small, strict=True)], ["kind", "doc_id", "text"])
    out = pa.Table.from_batches(P._in_order([batch.slice(0, 30), batch.slice(30)])).to_pylist()
    assert {(x["doc_id"], x["edited_sha256"], x["fingerprint"], x["near_next"]) for x in out} == want


def test_ranges_are_found_by_halving(spark):
    for ends in ([], [5], [1, 2, 3], list(range(0, 700, 7))):
        got = spark.range(-3, 720).select(F.col("id").alias("doc_id")).withColumn("r", P._range_of(ends)).collect()
        assert all(r.r == sum(e < r.doc_id for e in ends) for r in got)


def test_near_copies_links_families(spark):
    r = np.random.default_rng(9)
    words = BASE.split()
    texts = {}
    for family in range(4):
        base = list(r.choice(words, 300))
        for k in range(25):
            w = list(base)
            w[int(r.integers(len(w)))] = f"w{k}"
            texts[family * 100 + k] = " ".join(w) if k else " ".join(base)
        texts[family * 100 + 50] = texts[family * 100]
    prints = dict(zip(texts, P._text(P.fingerprints(list(texts.values()))), strict=True))
    df = spark.createDataFrame([*prints.items(), (None, prints[0])], "doc_id long, fingerprint string")
    got = {x.doc_id: x.component_id for x in P.near_copies(df).collect()}
    digits = {k: np.frombuffer(p.encode(), np.uint8)[None, :] for k, p in prints.items()}
    for i in got:
        for j in got:
            if float(P.likeness(digits[i], digits[j])[0]) >= 0.9:
                assert got[i] == got[j]
            if i // 100 != j // 100:
                assert got[i] != got[j]
    assert got[50] == 0 and not P.near_copies(df.limit(0)).count()


# ---- 13


def brute_draw(docs, target, most, buckets, seed, percent, least):
    def found(text):
        w = WORD.findall((text or "").translate(LOW))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(w) - n + 1)]

    raw, goal = Counter(), Counter()
    for _, t in docs:
        raw.update(found(t)[1])
    for t in target:
        goal.update(found(t)[1])
    s_all, t_all = sum(raw.values()), sum(goal.values())
    gain = lambda b: math.floor(1000 * math.log((goal[b] + 1) * (s_all + buckets) / ((raw[b] + 1) * (t_all + buckets))))
    out, open_ = [], []
    for d, t in docs:
        n_words, f = found(t)
        weight = sum(map(gain, f)) // len(f) if f else 0
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if n_words >= least:
                open_.append((-score, d))
        out.append((d, len(f), weight, score))
    open_.sort()
    drawn = Counter()
    ranks = {}
    for k, (_, d) in enumerate(open_[: percent * len(open_) // 100]):
        ranks.setdefault(d, []).append(k + 1)
        drawn[d] += 1
    return sorted(((*x,) for x in out), key=str), {d: sorted(r) for d, r in ranks.items()}


@pytest.mark.parametrize(("most", "percent"), [(1, 10), (2, 40), (3, 100), (1, 0)])
def test_resampling_against_brute_force(spark, most, percent):
    r = np.random.default_rng(most)
    docs = [(k, " ".join(r.choice([*BASE.split(), "É9", "a_b", "Ünï"], int(r.integers(0, 50))))) for k in range(90)]
    docs += [(200, None), (201, ""), (202, " .,;\n"), (203, "one"), (204, BASE * 300), (205, "word " * 100), (None, BASE), (206, "A\x7fb\x80c " * 30), (207, "y" * 9000)]
    docs += docs[:4]
    target = [BASE, "lazy dog", None, ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS rank", "3 AS buckets", "4 AS n_words").repartition(3)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample(df, goal, most, 97, 5, percent, 20).collect()
    rows, ranks = brute_draw(docs, target, most, 97, 5, percent, 20)
    assert sorted(((x.doc_id, x.n_features, x.weight, x.score) for x in got), key=str) == rows
    mine = {}
    for x in got:
        if x["rank"] is not None:
            mine.setdefault(x.doc_id, []).append(x["rank"])
    assert {d: sorted(v) for d, v in mine.items()} == ranks and (percent == 0) == (not ranks)
    assert not resample(df.limit(0), goal).count() and resample(df, goal.limit(0)).count() == len(docs)


def test_overlapping_grams_are_those_of_the_words():
    for text in ("", "one", "a b c d", "A-b  C\td", "é x é x é", " lead and trail ", "x" * 3000 + " y"):
        w = WORD.findall(text.translate(LOW))
        assert grams(text.encode(), patterns(3)) == [[zlib.crc32(" ".join(w[i : i + n]).encode()) for i in range(len(w) - n + 1)] for n in (1, 2, 3)]
    assert gains(np.array([0, 9]), np.array([9, 0])).tolist() == [2302, -2303]


def test_ranks_over_ranges(spark):
    rows = [(int(x), k % 5) for k, x in enumerate(np.random.default_rng(2).integers(0, 9, 200))]
    df = spark.createDataFrame(rows, "v long, w long").repartition(4)
    got = S.numbered(df, [F.col("v").desc(), F.col("w").asc()], "place").orderBy("place").collect()
    assert [x.place for x in got] == list(range(1, 201)) and [(x.v, x.w) for x in got] == sorted(rows, key=lambda r: (-r[0], r[1]))
