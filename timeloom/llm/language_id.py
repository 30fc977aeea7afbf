"""Language of web pages by Bayesian fusion of evidence.

log P(lang | page) is the sum of three terms: a character-gram likelihood of the text, the likelihood of the declared
markup language, and a prior of the host, smoothed hierarchically: host towards its address suffix, suffix towards
all pages. Counts for the last two are grouped sums of the text posteriors over all pages; a page's own share is
taken out of its host's and suffix's counts, so it doesn't confirm itself. The gram model is fitted on a bounded
sample of labelled documents (`SAMPLE` of each language at most, by the hash of their ids).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.llm import shared as S

U64 = np.uint64
SAMPLE = 400
BITS = 15
GRAMS = (1, 2, 3, 4)
EVIDENCE = 60  # so many independent grams at most does a text count for: grams of one text depend on each other
PIECE = 1 << 19  # bytes of text whose grams are taken at once: some 150 bytes of arrays a byte
ROWS = 500  # pages that are read at once
STRENGTH = 4.0  # pages' worth of the wider prior in a narrower one

MOST_LANGUAGES = 200  # languages that are modelled, those with the most labelled documents: a model of one takes 256 kB of the driver

_OPEN = re.compile(r"(?i)<(?:!--|(script|style|head|template|noscript)\b)?")
_END = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style", "head", "template", "noscript")}
_ENTITY = re.compile(r"&[#\w]+;")
_HTML_TAG = re.compile(r"(?i)<html\b[^>]*")
_LANG = re.compile(r"(?i)\blang\s*=\s*[\"']?\s*([a-z]{2,8})")


def plain(html: str) -> str:
    """Text without comments, elements that show nothing, tags and entities, a space for each, in one pass.

    What is opened and never closed is read as a tag, a `<` without `>` behind it as text. An end that was looked for in vain
    is not looked for again, so the pass is linear.
    """
    out, at, missing = [], 0, set()
    while (m := _OPEN.search(html, at)) and ">" not in missing:
        end, name = -1, "-->" if m[0] == "<!--" else (m[1] or "").lower()
        if name and name not in missing:
            if name == "-->":
                found = html.find(name, m.end())
                end = found + 3 if found >= 0 else -1
            elif close := _END[name].search(html, m.end()):
                end = close.end()
            if end < 0:
                missing.add(name)
        if end < 0:
            end = html.find(">", m.start()) + 1
            if not end:
                missing.add(">")
                break
        out += [html[at : m.start()], " "]
        at = end
    out.append(html[at:])
    return _ENTITY.sub(" ", "".join(out))


def declared(html: str) -> str | None:
    """Language that the first <html> tag with one declares."""
    for tag in _HTML_TAG.finditer(html):
        if m := _LANG.search(tag[0]):
            return m[1].lower()
    return None


def _grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the byte grams of each row, and their rows; a gram doesn't cross rows."""
    n = len(buf)
    low = S.LOWER[buf].astype(np.uint64)
    low[(low < 65) | ((low > 90) & (low < 97)) | ((low > 122) & (low < 128))] = 32
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    out, rows = [], []
    for g in GRAMS:
        if n >= g:
            x = np.full(n - g + 1, g, np.uint64)
            for i in range(g):
                x = (x << U64(8)) + low[i : n - g + 1 + i]
            ok = row[: n - g + 1] == row[g - 1 :]
            out.append((S.mix(x[ok]) >> U64(64 - BITS)).astype(np.int64))
            rows.append(row[: n - g + 1][ok])
    return (np.concatenate(out), np.concatenate(rows)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _gram_counter(batches):
    """Gram counts of each language among a task's texts."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lo, hi, buf, off in S.pieces(batch.column("text"), PIECE):
            bucket, row = _grams(buf, off)
            for name in sorted(set(langs[lo:hi])):
                own = (langs[lo:hi] == name)[row]
                counts[name] = counts.get(name, 0) + np.bincount(bucket[own], minlength=1 << BITS)
    yield pa.RecordBatch.from_pydict({"lang": pa.array(list(counts), pa.string()), "counts": pa.array([c.astype(np.int64).tobytes() for c in counts.values()], pa.binary())})


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in table["counts"].to_pylist())
    return pa.table({"lang": table["lang"][:1], "counts": pa.array([total.tobytes()], pa.binary())})


def fit(texts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages of texts (lang, text) and log P(gram | lang), add-half smoothed: (2**BITS, languages). Only counts leave the tasks."""
    kind = "lang string, counts binary"
    rows = texts.select("lang", "text").mapInArrow(_gram_counter, kind).groupBy("lang").applyInArrow(_add, kind).collect()  # 256 kB a language
    found = {r["lang"]: np.frombuffer(r["counts"], np.int64) for r in rows}
    names = sorted(found)
    counts = np.stack([found[n] + 0.5 for n in names], 1) if names else np.zeros((1 << BITS, 0))
    return names, np.log(counts / counts.sum(0)).astype(np.float32)


def text_posteriors(column: pa.Array, model: np.ndarray) -> np.ndarray:
    out = np.full((len(column), model.shape[1]), 1 / model.shape[1])
    for lo, hi, buf, off in S.pieces(column, PIECE):
        bucket, row = _grams(buf, off)
        n = np.bincount(row, minlength=hi - lo)
        ll = np.stack([np.bincount(row, model[bucket, k], hi - lo) for k in range(model.shape[1])], 1)
        ll = ll / np.maximum(n, 1)[:, None] * np.minimum(n, EVIDENCE)[:, None]
        p = np.exp(ll - ll.max(1, keepdims=True))
        out[lo:hi] = p / p.sum(1, keepdims=True)
    return out


def _reader(shared):
    def read(batches):
        model, names = shared.value
        for batch in (whole.slice(lo, ROWS) for whole in batches for lo in range(0, whole.num_rows, ROWS)):
            html = batch.column("html").to_pylist()
            said = [declared(h or "") for h in html]
            p = text_posteriors(pa.array([plain(h or "") for h in html], pa.string()), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("host"), pa.array([d if d is None or d in names else "other" for d in said], pa.string()),
                 pa.array(list(p), pa.list_(pa.float64()))],
                ["page_id", "host", "declared", "p"],
            )

    return read


def _sums(n: int, p: str = "p") -> Column:
    return F.array(*[F.sum(F.col(p)[k]) for k in range(n)])


def _smoothed(own: str, counts: str, prior: str) -> Column:
    """(counts - own + STRENGTH * prior), normalised."""
    raw = F.zip_with(F.zip_with(counts, own, lambda c, o: F.greatest(c - o, F.lit(0.0))), prior, lambda c, q: c + STRENGTH * q)
    return F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda a, y: a + y))


def language_id(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, host, declared, text_lang, lang, confidence for every row of pages.

    docs (doc_id, text, lang) are the labelled texts. Pages without html or url keep the evidence that is there: an
    empty text is equally likely in all languages, no `://` gives an empty host. A declared language that no labelled
    text has counts as `other`; beyond the `MOST_LANGUAGES` most frequent languages none is modelled. Ties: the language that comes first by name. Without labelled texts lang is null.
    Repeated pages are judged each, an empty table gives an empty result, other columns are ignored.
    """
    spark = pages.sparkSession
    labelled = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", F.col("lang").cast("string").alias("lang"))
    modelled = [r["lang"] for r in labelled.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(MOST_LANGUAGES).collect()]
    labelled = labelled.where(F.col("lang").isin(modelled))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    least = lambda df, *by: df.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("k") <= SAMPLE)
    ids = least(least(labelled.withColumn("part", F.pmod(F.xxhash64("doc_id", "lang"), F.lit(32))), "lang", "part"), "lang").select("doc_id").distinct()
    texts = docs.where("lang is not null and text is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    names, model = fit(texts.where(F.col("lang").isin(modelled)).join(F.broadcast(ids), "doc_id", "left_semi"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1)).alias("host")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), host, F.col("html").cast("string").alias("html"))
    if not names:
        null = F.lit(None).cast("string")
        return base.select("page_id", "host", null.alias("declared"), null.alias("text_lang"), null.alias("lang"), F.lit(0.0).alias("confidence"))
    n = len(names)
    shared = spark.sparkContext.broadcast((model, set(names)))
    read = S.stored(base.mapInArrow(_reader(shared), "page_id long, host string, declared string, p array<double>"), "pages")
    read = read.withColumn("suffix", F.element_at(F.split("host", r"\."), -1))
    total = read.agg(_sums(n).alias("s")).collect()[0]["s"]  # one number per language
    world = F.array(*[F.lit((x or 0.0) / max(sum(y or 0.0 for y in total), 1e-9)) for x in total])
    said = {r["declared"]: r["s"] for r in read.where("declared is not null").groupBy("declared").agg(_sums(n).alias("s")).collect()}  # languages + 1 rows
    values = sorted(said)
    like = {v: [float(np.log((said[v][k] + 0.5) / (sum(said[w][k] for w in values) + 0.5 * len(values)))) for k in range(n)] for v in values}
    declared = F.lit(None).cast("array<double>")
    for v in values:
        declared = F.when(F.col("declared") == v, F.array(*[F.lit(x) for x in like[v]])).otherwise(declared)
    declared = F.coalesce(declared, F.array(*[F.lit(0.0)] * n))
    of_host = read.groupBy("host").agg(_sums(n).alias("h"))
    of_suffix = read.groupBy("suffix").agg(_sums(n).alias("s"))
    full = read.join(of_host, "host").join(of_suffix, "suffix").withColumn("world", world)
    full = full.withColumn("wide", _smoothed("p", "s", "world")).withColumn("prior", _smoothed("p", "h", "wide"))
    score = F.zip_with(F.zip_with("p", "prior", lambda a, b: F.log(F.greatest(a, F.lit(1e-12))) + F.log(F.greatest(b, F.lit(1e-12)))), declared, lambda a, b: a + b)
    full = full.withColumn("score", score).withColumn("best", F.array_max("score"))
    name = F.array(*[F.lit(x) for x in names])
    pick = lambda c: F.element_at(name, F.array_position(c, F.array_max(c)).cast("int"))
    mass = F.aggregate(F.transform("score", lambda x: F.exp(x - F.col("best"))), F.lit(0.0), lambda a, y: a + y)
    return full.select("page_id", "host", "declared", pick(F.col("p")).alias("text_lang"), pick(F.col("score")).alias("lang"), (1 / mass).alias("confidence"))
