"""op10 on larger parts: what tasks hold and sort, texts that several documents have whole, arrays cut between minimizers."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from test_operators import brute_removed

from timeloom.llm import suffix_dedup as M


def test_minimizers_are_not_sorted_again(monkeypatch, tmp_path):
    """Beyond three million minimizers a task sorted all of them again for every megabyte."""
    sorted_, sums = [], M._sums
    monkeypatch.setattr(M, "_sums", lambda parts, kind: (sorted_.append(sum(len(p[0]) for p in parts)), sums(parts, kind))[1])
    letters = np.random.default_rng(5).integers(97, 123, 75_000_000, dtype=np.uint8).tobytes().decode()
    texts = [letters[k : k + 100_000] for k in range(0, len(letters), 100_000)]
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array(range(k, k + 50)), "text": texts[k : k + 50], "digest": pa.array([bytes(16)] * 50, pa.binary())}) for k in range(0, len(texts), 50)]
    rows = pa.Table.from_batches(M._finder(50, 16, str(tmp_path), 16)(iter(batches)))
    found = sum(len(x) // 4 for c in ("once", "more") for x in rows.column(c).to_pylist())
    assert found > M.HELD and sum(sorted_) < 1.1 * found and max(sorted_) < 1.1 * M.HELD
    by = Counter(dict.fromkeys(range(16), 0))  # minimizers are minima, so their leading bits tell little apart
    for k, *cols in zip(*(rows.column(c).to_pylist() for c in ("shard", "once", "more")), strict=True):
        by[k] += sum(len(x) // 4 for x in cols)
    assert max(by.values()) < 1.1 * found / 16


def test_seen_strings():
    r, seen, known, sizes = np.random.default_rng(6), M._Seen(), set(), []
    for _ in range(300):
        u = np.unique(r.integers(0, 20_000, 100, dtype=np.uint64))
        assert seen.new(u).tolist() == [x not in known for x in u.tolist()]
        known |= set(u.tolist())
        sizes.append(len(seen.levels))
    assert max(sizes) <= 12 and sum(map(len, seen.levels)) == len(known)


def test_texts_that_several_documents_have_whole(spark):
    """Their strings are cut out of one of them; short ones stay, rows without id and repeated rows are nobody's copies."""
    r = np.random.default_rng(7)
    words = [f"word{k}" for k in range(300)]
    texts = [" ".join(r.choice(words, 60)) for _ in range(6)] + ["a" * 49, "b" * 50, "é" * 25, ""]
    rows = [(int(d), texts[k % len(texts)]) for k, d in enumerate(r.permutation(200) - 50)] + [(500, texts[0][:200] + texts[1][100:])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in M.suffix_dedup(frame).collect()}
    assert got == brute_removed(rows)
    spans, *_ = M._parts_removed(frame, 50, M.HOT)
    assert {x.doc_id for x in spans.collect()} == {500}
    other = spark.createDataFrame([(1, texts[0]), (1, texts[0]), (None, texts[0]), (2, texts[0]), (None, texts[0])], "doc_id long, text string")
    n = len(texts[0])
    left = {True: hashlib.sha256(texts[0].encode()).hexdigest(), False: hashlib.sha256(b"").hexdigest()}
    want = sorted((d or 0, n, 0 if d != 2 else n, 0 if d != 2 else 1, left[d != 2], texts[0] if d != 2 else "") for d in (1, 1, None, 2, None))
    assert sorted((x.doc_id or 0, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256, x.kept_text) for x in M.suffix_dedup(other).collect()) == want


def test_texts_with_half_a_digest_in_common(tmp_path):
    """They count as different texts, so nothing rests on 64 bits."""
    same = [(b"\1" * 8 + b"\2" * 8, 1, 9, 3), (b"\1" * 8 + b"\3" * 8, 2, 9, 3), (b"\1" * 7 + b"\4" * 9, 4, 9, 3), (b"\1" * 16, 5, 5, 3), (b"\5" * 16, 6, 6, 8)]
    cols = dict(zip(("digest", "first", "last", "n"), (list(x) for x in zip(*same, strict=True)), strict=True))
    batch = pa.RecordBatch.from_pydict({c: pa.array(v, pa.binary() if c == "digest" else pa.int64()) for c, v in cols.items()})
    assert [b.to_pydict() for b in M._texts(str(tmp_path))((pa.scalar(0),), iter([batch]))] == [{"size": [20]}]
    asked = pa.array([x[0] for x in same] + [same[2][0]], pa.binary())
    assert M._copies(M.S.Arrays(str(tmp_path)), 16, asked, np.array([9, 9, 9, 9, 9, 4])).tolist() == [False, False, True, False, False, False]


@pytest.mark.parametrize("part", [1, 300, 10**6])
def test_arrays_are_cut_between_minimizers(part, monkeypatch):
    """Spans of a group are the same however its strings are dealt to arrays; equal digests of different strings are noticed."""
    monkeypatch.setattr(M, "PART", part)
    r = np.random.default_rng(8)
    base = [bytes(r.integers(97, 100, 90, dtype=np.uint8)) for _ in range(20)]
    strings = [base[k % 20][k % 7 : 60 + k % 7 + k % 11] for k in range(120)]
    doc, key = r.integers(0, 50, 240), np.arange(120, dtype=np.uint64) % np.uint64(20)
    which = np.r_[np.arange(120), r.integers(0, 120, 120)]
    fresh = np.arange(240) < 120

    def row(pick, strings):
        own = {"keys": key[which[pick]][fresh[pick]], "digests": which[pick].astype(np.uint64), "docs": doc[pick].astype(np.int64), "begins": np.arange(240)[pick] * 100, "lengths": np.array([len(strings[k]) for k in which[pick]], np.uint32), "fresh": fresh[pick]}
        sent = [x.tobytes() for x in own.values()] + [pa.compress(b"".join(strings[k] for k in which[pick][fresh[pick]]), "zstd", asbytes=True)]
        return pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), *(pa.array([x], pa.binary()) for x in sent)], ["shard", *M._SENT])

    half = np.arange(240) % 2 == 0
    got = set()
    for b in M._marker(50)((pa.scalar(0),), iter([row(half, strings), row(~half, strings)])):
        got |= {(d, x) for d, a, z in zip(*(b.column(c).to_pylist() for c in ("doc_id", "begin", "end")), strict=True) for x in range(a, z)}
    least: dict = {}
    for k, d in zip(which, doc, strict=True):
        for p in range(len(strings[k]) - 49):
            w = strings[k][p : p + 50]
            least[w] = min(d, least.get(w, 99))
    want = set()
    for j, (k, d) in enumerate(zip(which, doc, strict=True)):
        for p in range(len(strings[k]) - 49):
            if least[strings[k][p : p + 50]] < d:
                want |= {(d, 100 * j + x) for x in range(p, p + 50)}
    assert got == want and want
    with pytest.raises(RuntimeError, match="64-bit"):
        list(M._marker(50)((pa.scalar(0),), iter([row(half, strings), row(~half, strings), row(half, [s[:-1] + b"!" for s in strings])])))
