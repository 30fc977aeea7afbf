"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as the sum of a hashed word embedding and of the hashed embeddings of its 3- to 5-byte character grams.
Two gated recurrent layers read a window of `WINDOW` words in either direction, attention pools their states, and a
logistic unit scores the window. A document's score is that of its worst window; all windows, which overlap by half, are
scored. Training fits on a sample of labelled documents (`SAMPLE` of each class at most, by the hash of their ids, and
`SAMPLE_BYTES` of text together) and picks the window that speaks for the label anew in each round; embeddings start
from the sample's log-odds. It runs in one task, which a lost executor only repeats: the driver sees neither texts nor
windows. The model has a fixed size (about 4 MB), so it is broadcast.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeloom.llm import shared as S

U64 = np.uint64
WINDOW, STRIDE = 64, 32
SAMPLE = (1200, 2400)  # toxic and other labelled documents that training sees at most
SAMPLE_BYTES = 10 << 20  # of their texts together; a text of more than a 64th of it is not learned from
BITS, DIM, HIDDEN = 15, 8, 8
GRAMS = (3, 4, 5)


# ---------------------------------------------------------------- inputs


class Words:
    """Distinct words of a run of rows, the word of each token, and the rows' tokens."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        parts = []
        lo = 0
        while lo < len(off) - 1:  # in pieces: hashing takes some 40 bytes a byte
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + (1 << 20), "right")) - 1)
            h, row, a, b = S.words(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], S.PUNCTUATION, spans=True)
            parts.append((h, row + lo, a + off[lo], b + off[lo]))
            lo = hi
        h, row, a, b = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
        u, first, self.token = np.unique(h, return_index=True, return_inverse=True)
        self.bucket = (u >> U64(64 - BITS)).astype(np.int64)
        self.size = np.bincount(row, minlength=len(off) - 1)
        self.begin = np.r_[0, np.cumsum(self.size)[:-1]].astype(np.int64)
        lens = b[first] - a[first] + 2  # with a mark at either end
        start = np.r_[0, np.cumsum(lens)[:-1]].astype(np.int64)
        total = int(lens.sum())
        chars = np.full(total + 8, 2, np.uint64)
        at = np.arange(total) - np.repeat(start, lens)
        inner = (at > 0) & (at < np.repeat(lens, lens) - 1)
        low = S.LOWER[buf].astype(np.uint64)
        chars[:total][inner] = low[(np.repeat(a[first], lens) + at - 1)[inner]]
        grams, of = [], []
        owner = np.repeat(np.arange(len(u)), lens)
        rest = np.repeat(lens, lens) - at
        for n in GRAMS:
            x = np.full(total, n, np.uint64)
            for i in range(n):
                x = (x << U64(8)) + chars[i : i + total] + U64(1)
            ok = rest >= n
            grams.append((S.mix(x[ok]) >> U64(64 - BITS)).astype(np.int64))
            of.append(owner[ok])
        self.gram, self.of = np.concatenate(grams), np.concatenate(of)
        order = np.argsort(self.of, kind="stable")
        self.gram, self.of = self.gram[order], self.of[order]
        self.n = len(u)
        self.weight = (1 / np.sqrt(np.maximum(np.bincount(self.of, minlength=self.n), 1))).astype(np.float32)

    def vectors(self, p: dict) -> np.ndarray:
        out = p["word"][self.bucket].copy()
        if len(self.of):
            at = np.flatnonzero(np.r_[True, self.of[1:] != self.of[:-1]])
            out[self.of[at]] += np.add.reduceat(p["char"][self.gram], at, axis=0) * self.weight[self.of[at], None]
        return out

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, first token and length of every window; the last one of a row ends with it."""
        n = np.where(self.size > 0, 1 + np.maximum(0, -(-(self.size - WINDOW) // STRIDE)), 0)
        row = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        begin = self.begin[row] + k * STRIDE
        return row, begin, np.minimum(WINDOW, self.begin[row] + self.size[row] - begin)


# ---------------------------------------------------------------- the network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


def initial(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    g = lambda *s: (r.standard_normal(s) * 0.3 / np.sqrt(s[0])).astype(np.float32)
    p = {"word": (r.standard_normal((1 << BITS, DIM)) * 0.02).astype(np.float32), "char": (r.standard_normal((1 << BITS, DIM)) * 0.02).astype(np.float32)}
    for d in "fb":
        p |= {f"w{d}": g(DIM, 3 * HIDDEN) * 3, f"u{d}": g(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    return p | {"attend": g(2 * HIDDEN), "out": g(2 * HIDDEN), "bias": np.zeros(1, np.float32)}


def _read(gates: np.ndarray, index: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: list | None) -> np.ndarray:
    """States (steps, windows, HIDDEN) of one direction. gates: the inputs' part per distinct word."""
    steps, n = index.shape
    h = np.zeros((n, HIDDEN), np.float32)
    states = np.empty((steps, n, HIDDEN), np.float32)
    for t in range(steps):
        x = gates[index[t]]
        y = h @ u
        zr = _sigmoid(x[:, : 2 * HIDDEN] + y[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(x[:, 2 * HIDDEN :] + r * y[:, 2 * HIDDEN :])
        new = c + z * (h - c)
        if keep is not None:
            keep.append((h, z, r, c, y[:, 2 * HIDDEN :]))
        h = np.where(mask[t][:, None], new, h)
        states[t] = h
    return states


def forward(p: dict, vectors: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows. index, mask: (steps, windows)."""
    tape = {"f": [] if keep is not None else None, "b": [] if keep is not None else None}
    f = _read(vectors @ p["wf"] + p["cf"], index, mask, p["uf"], tape["f"])
    b = _read(vectors @ p["wb"] + p["cb"], index[::-1], mask[::-1], p["ub"], tape["b"])[::-1]
    s = f @ p["attend"][:HIDDEN] + b @ p["attend"][HIDDEN:]
    s = np.where(mask, s, -1e9)
    e = np.exp(s - s.max(0))
    a = e / e.sum(0)
    pooled = np.concatenate([np.einsum("tn,tnh->nh", a, f), np.einsum("tn,tnh->nh", a, b)], 1)
    if keep is not None:
        keep |= {"f": f, "b": b, "a": a, "pooled": pooled, "tape": tape}
    return pooled @ p["out"] + p["bias"][0]


def gradients(p: dict, vectors: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: dict, delta: np.ndarray) -> tuple[dict, np.ndarray]:
    """Of the parameters and of the distinct words' vectors, given the logits' gradient."""
    f, b, a, pooled = (keep[k] for k in ("f", "b", "a", "pooled"))
    g = {"out": pooled.T @ delta, "bias": np.array([delta.sum()], np.float32)}
    dp = delta[:, None] * p["out"]
    da = np.einsum("tnh,nh->tn", f, dp[:, :HIDDEN]) + np.einsum("tnh,nh->tn", b, dp[:, HIDDEN:])
    ds = a * (da - (a * da).sum(0))
    g["attend"] = np.r_[np.einsum("tn,tnh->h", ds, f), np.einsum("tn,tnh->h", ds, b)]
    dv = np.zeros_like(vectors)
    for d, lo in (("f", 0), ("b", HIDDEN)):
        dstate = a[:, :, None] * dp[None, :, lo : lo + HIDDEN] + ds[:, :, None] * p["attend"][lo : lo + HIDDEN]
        way = slice(None) if d == "f" else slice(None, None, -1)
        dstate, at, on, u = dstate[way], index[way], mask[way], p[f"u{d}"]
        dx = np.empty((*at.shape, 3 * HIDDEN), np.float32)
        du = np.zeros_like(u)
        dh = np.zeros((index.shape[1], HIDDEN), np.float32)
        for t in range(len(at) - 1, -1, -1):
            h, z, r, c, y = keep["tape"][d][t]
            dh = dh + dstate[t]
            live = on[t][:, None]
            dn = np.where(live, dh, 0)
            dz = dn * (h - c) * z * (1 - z)
            dc = dn * (1 - z) * (1 - c * c)
            dr = dc * y * r * (1 - r)
            dx[t] = np.concatenate([dz, dr, dc], 1)
            dy = np.concatenate([dz, dr, dc * r], 1)
            du += h.T @ dy
            dh = np.where(live, dn * z, dh) + dy @ u.T
        dgates = np.stack([np.bincount(at.ravel(), dx[:, :, k].ravel(), len(vectors)) for k in range(3 * HIDDEN)], 1).astype(np.float32)
        g[f"u{d}"], g[f"c{d}"], g[f"w{d}"] = du, dgates.sum(0), vectors.T @ dgates
        dv += dgates @ p[f"w{d}"].T
    return g, dv


# ---------------------------------------------------------------- training


def _batch(words: Words, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps = int(size.max(initial=1))
    at = np.arange(steps)[:, None]
    mask = at < size
    return words.token[np.where(mask, begin + at, begin)], mask


def _logits(p: dict, words: Words, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    vectors = words.vectors(p)
    out = np.empty(len(begin), np.float32)
    order = np.argsort(size, kind="stable")
    for lo in range(0, len(order), 4096):
        own = order[lo : lo + 4096]
        out[own] = forward(p, vectors, *_batch(words, begin[own], size[own]))
    return out


def _worst(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Index of the largest value of each row, -1 without any."""
    order = np.lexsort((values, row))
    last = np.full(n, -1)
    last[row[order]] = order
    return last


def train(texts: list[str], labels: np.ndarray, share: float, updates: int = 120, seed: int = 7) -> dict[str, np.ndarray]:
    """share: of label 1 among all labelled documents, to which the scores are calibrated. Rounds over the sample go on until `updates` steps are made."""
    r = np.random.default_rng(seed)
    buf, off = S.utf8(pa.array(texts, pa.string()))
    words = Words(buf, off)
    row, begin, size = words.windows()
    n = len(texts)
    p = initial(seed)
    check = r.random(n) < 0.2  # kept from fitting, for the calibration
    fit = ~check
    for name, bucket, of in (("word", words.bucket, np.arange(words.n)), ("char", words.gram, words.of)):
        pos, neg = np.zeros(1 << BITS), np.zeros(1 << BITS)
        for d in np.flatnonzero(fit).tolist():
            word = np.unique(words.token[words.begin[d] : words.begin[d] + words.size[d]])
            lo, hi = np.searchsorted(of, word), np.searchsorted(of, word, "right")
            flat = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange((hi - lo).sum())
            (pos if labels[d] == 1 else neg)[np.unique(bucket[flat])] += 1
        odds = np.log((pos + 0.5) / ((labels[fit] == 1).sum() + 1)) - np.log((neg + 0.5) / ((labels[fit] == 0).sum() + 1))
        p[name][:, 0] += np.clip(odds * (pos + neg) / (pos + neg + 20), -3, 3) * (0.4 if name == "word" else 0.1)
    lexical = words.vectors(p)[:, 0][words.token]
    value = np.array([lexical[a : a + s].max() for a, s in zip(begin.tolist(), size.tolist(), strict=True)] or [0.0])
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    size_of_batch = min(256, max(16, n // 16))
    while step < updates:
        pick = _worst(value[: len(row)], row, n)
        chosen = [pick[(pick >= 0) & fit]]
        other = np.flatnonzero((labels[row] == 0) & fit[row])
        chosen.append(r.choice(other, min(len(other), n)) if len(other) else other)
        use = r.permutation(np.concatenate(chosen))
        if not len(use):
            break
        for lo in range(0, len(use), size_of_batch):
            own = use[lo : lo + size_of_batch]
            index, mask = _batch(words, begin[own], size[own])
            distinct, local = np.unique(index, return_inverse=True)
            part = _Part(words, distinct)
            vectors, keep = part.vectors(p), {}
            y = labels[row[own]].astype(np.float32)
            delta = (_sigmoid(forward(p, vectors, local.reshape(index.shape), mask, keep)) - y) / len(own)
            g, dv = gradients(p, vectors, local.reshape(index.shape), mask, keep, delta.astype(np.float32))
            g |= part.gradients(dv)
            step += 1
            for k, x in g.items():
                if k in ("word", "char"):
                    x = x + 1e-5 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                p[k] = (p[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        if step < updates:
            value = _logits(p, words, begin, size)
    logit = _logits(p, words, begin, size)
    worst = _worst(logit, row, n)
    have = (worst >= 0) & check
    p["scale"] = _calibrated(logit[worst[have]], labels[have], share)
    return p


class _Part:
    """The inputs of some distinct words."""

    def __init__(self, words: Words, distinct: np.ndarray):
        at = np.full(words.n, -1)
        at[distinct] = np.arange(len(distinct))
        own = at[words.of] >= 0
        self.bucket, self.gram, self.of = words.bucket[distinct], words.gram[own], at[words.of[own]]
        self.n, self.weight = len(distinct), words.weight[distinct]

    vectors = Words.vectors

    def gradients(self, dv: np.ndarray) -> dict[str, np.ndarray]:
        word, char = np.zeros((1 << BITS, DIM), np.float32), np.zeros((1 << BITS, DIM), np.float32)
        np.add.at(word, self.bucket, dv)
        np.add.at(char, self.gram, dv[self.of] * self.weight[self.of, None])
        return {"word": word, "char": char}


def _calibrated(logit: np.ndarray, label: np.ndarray, share: float) -> np.ndarray:
    """a, b of sigmoid(a * logit + b), each class weighted as among all labelled documents."""
    a, b = 1.0, 0.0
    if not (0 < label.sum() < len(label)):
        return np.array([a, b])
    w = np.where(label == 1, share / label.mean(), (1 - share) / (1 - label.mean()))
    x = logit.astype(np.float64)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(w * (q - label) * x).sum() + 0.1 * (a - 1), (w * (q - label)).sum()])
        c = w * q * (1 - q)
        h = np.array([[(c * x * x).sum() + 0.1, (c * x).sum()], [(c * x).sum(), c.sum() + 1e-6]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, g), -2, 2)
    return np.array([max(a, 0.05), b])


# ---------------------------------------------------------------- the Spark jobs


def _scorer(shared, names: list[str]):
    def score(batches):
        p = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, hi, buf, off in S.pieces(batch.column("text"), 1 << 20):
                if isinstance(p, float):
                    out[lo:hi] = np.where(np.diff(off) > 0, p, 0)
                    continue
                words = Words(buf, off)
                row, begin, size = words.windows()
                if len(row):
                    logit = _logits(p, words, begin, size)
                    worst = np.full(hi - lo, -np.inf)
                    np.maximum.at(worst, row, logit)
                    a, b = p["scale"]
                    out[lo:hi] = np.where(np.isfinite(worst), 1 / (1 + np.exp(-np.clip(a * worst + b, -40, 40))), 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out)], [*names, "score"])

    return score


def _trainer(share: float):
    def fit(batches):
        texts, labels = [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            labels += batch.column("toxic").to_pylist()
        y = np.array(labels, np.int64)
        model = train(texts, y, share) if len(set(labels)) == 2 else float(share)
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    return fit


def fitted(docs: DataFrame, labels: DataFrame):
    """The model, trained in one task from a sample bounded by SAMPLE and SAMPLE_BYTES; a number where a class is missing."""
    spark = docs.sparkSession
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y, most in ((1, SAMPLE[0]), (0, SAMPLE[1]))]
    ids = parts[0].unionByName(parts[1])
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(ids), "doc_id")
    sample = S.stored(texts.groupBy("doc_id", "toxic").agg(F.max("text").alias("text")), "toxicity-sample")
    size = F.octet_length("text")
    so_far = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over the sample's ids, SAMPLE rows at most
    within = sample.select("doc_id", size.alias("size")).where(F.col("size") <= SAMPLE_BYTES // 64).withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE_BYTES)
    chosen = sample.join(F.broadcast(within.select("doc_id")), "doc_id").select("doc_id", "text", "toxic").repartition(1).sortWithinPartitions("doc_id")
    rows = chosen.mapInArrow(_trainer(share), "model binary").collect()  # one model
    return spark.sparkContext.broadcast(pickle.loads(rows[0]["model"]) if rows else float(share))


def toxicity(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """keep's columns of docs (of every row), then score, 0 to 1: the chance of label 1.

    labels (doc_id, toxic) are those to learn from; several for one document: the largest counts. Null, empty and
    wordless texts score 0. Without labels of both classes the score is their share. An empty table gives an empty
    result. Of docs only the text is an input; doc_id finds the labels.
    """
    model = fitted(docs, labels.select("doc_id", "toxic"))
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)], F.col("text").cast("string").alias("text"))
    kind = "".join(f"c{k} {docs.schema[c].dataType.simpleString()}, " for k, c in enumerate(keep))
    scored = inner.mapInArrow(_scorer(model, [f"c{k}" for k in range(len(keep))]), kind + "score double")
    return scored.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(keep)], "score")
