"""Importance resampling towards a target distribution: hashed n-gram counts of raw and target texts, weights, a Gumbel top-k draw.

A text is lower-cased (A-Z), everything that is no word becomes a single space, and `regex.finditer(overlapped=True)` with
lookarounds at both ends walks over it: each match is the span of an n-gram, whose bytes go to CRC-32 as they stand. A text is
scanned once: its distinct buckets and their counts are stored, both histograms (of a fixed number of buckets) are sums
over what is stored, and the weights are read off it. The draw needs no global sort: scores are integers within some ten thousands
of 0, so a histogram of them gives the score at which the draw ends; only rows from there up are ranked, in parts.
"""

from __future__ import annotations

import math
import zlib
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm import shared as S

#: A-Z to a-z; bytes outside 0-9, a-z and UTF-8's upper half to a space
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def patterns(most: int) -> list[regex.Pattern]:
    """For n of 1 to `most`: n words with a space or an end on either side. Words are possessive, so no start is tried twice."""
    return [regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1)) for n in range(1, most + 1)]


def grams(text: bytes, scans: list[regex.Pattern]) -> list[list[int]]:
    """CRC-32 of every n-gram, for each of the scans."""
    flat = b" ".join(text.translate(_PLAIN).split())
    return [list(map(zlib.crc32, map(itemgetter(0), scan.finditer(flat, overlapped=True)))) for scan in scans]


def _counter(most: int, buckets: int):
    def count(batches):
        """Words and n-grams of each text; its distinct buckets and their counts, 32 bits each."""
        scans = patterns(most)
        for batch in batches:
            words, features, keys, counts = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = grams((text or "").encode(), scans)
                k, c = np.unique(np.array([x for g in found for x in g], np.int64) % buckets, return_counts=True)
                words.append(len(found[0]))
                features.append(sum(map(len, found)))
                keys.append(k.astype("<u4").tobytes())
                counts.append(c.astype("<u4").tobytes())
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array(words, pa.int64()), pa.array(features, pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())],
                [*rest, "n_words", "n_features", "buckets", "counts"],
            )

    return count


COUNTED = "n_words long, n_features long, buckets binary, counts binary"


def _sums(buckets: int):
    def total(batches):
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for k, c in zip(batch.column("buckets").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                held[np.frombuffer(k, "<u4")] += np.frombuffer(c, "<u4")
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int64()), "n": pa.array(held[at], pa.int64())})

    return total


def histogram(counted: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs: one row a bucket and task is shuffled, one a bucket comes to the driver."""
    rows = counted.select("buckets", "counts").mapInArrow(_sums(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    out[[r[0] for r in rows]] = [r[1] for r in rows]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed target share over the smoothed raw share) of each bucket."""
    b = len(raw)
    s_all, t_all = float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def _weigher(gain):
    def weigh(batches):
        for batch in batches:
            out = []
            for k, c, n in zip(*(batch.column(x).to_pylist() for x in ("buckets", "counts", "n_features")), strict=True):
                out.append(int((gain.value[np.frombuffer(k, "<u4")] * np.frombuffer(c, "<u4")).sum()) // n if n else 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "n_words", "n_features")), pa.array(out, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return weigh


def resample(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, least_words: int = 20) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of docs.

    Features are the runs of 1 to `most` words of a text; weight is the floored mean of their buckets' gains (0 without features),
    score adds floored Gumbel noise taken from sha256(`seed:doc_id`). Of the rows with an id and `least_words` words, `percent` in 100
    with the highest scores are drawn and ranked from 1, ties by doc_id. Null texts are empty. A row without id counts in the
    histogram and has a weight, but neither score nor rank. Repeated rows count and are drawn each. An empty target leaves
    smoothing alone, an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    counter, text = _counter(most, buckets), F.col("text").cast("string").alias("text")
    counted = S.stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(counter, "doc_id long, " + COUNTED), "counted")
    gain = spark.sparkContext.broadcast(gains(histogram(counted, buckets), histogram(target.select(text).mapInArrow(counter, COUNTED), buckets)))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = counted.mapInArrow(_weigher(gain), "doc_id long, n_words long, n_features long, weight long").withColumn("score", F.col("weight") + noise)
    scored = S.stored(scored.withColumn("open", F.expr(f"doc_id is not null and n_words >= {least_words}")), "scored")
    S.discard(counted)
    drawn = percent * scored.where("open").count() // 100
    steps = scored.where("open").groupBy("score").agg(F.count("*").alias("n")).selectExpr("score", "sum(n) over (order by score desc) AS above")  # one row a score: some 10^5
    end = steps.where(f"above >= {drawn}").agg(F.max("score")).collect()[0][0] if drawn else None
    last = F.lit(False) if end is None else F.col("open") & (F.col("score") >= end)
    ranked = S.numbered(scored.where(last), [F.col("score").desc(), F.col("doc_id").asc()], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(scored.where(~last).withColumn("rank", F.lit(None).cast("long")).select(*columns))
