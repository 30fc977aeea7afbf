"""The stored index: its searches against brute force, and what their plans read."""

import math
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from timeloom.operators import textindex as T


def corpus():
    r = np.random.default_rng(8)
    words = [f"w{k}" for k in range(40)]
    weight = 1 / np.arange(1, 41)
    texts = [" ".join(r.choice(words, int(r.integers(0, 60)), p=weight / weight.sum())) for _ in range(900)]
    texts[5], texts[6], texts[7], texts[8] = None, "", "W0, w0! w0-rare", "rare " * 50
    return list(enumerate(texts))


def brute(docs, terms, exact=None):
    split = {d: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w] for d, t in docs}
    n, avg = len(docs), sum(map(len, split.values())) / len(docs)
    tf = {d: Counter(w) for d, w in split.items()}
    out = []
    for d, c in tf.items():
        if not any(c[t] for t in terms) or (exact is not None and d % 3 != exact):
            continue
        s = 0.0
        for t in terms:
            df = sum(t in x for x in tf.values())
            s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(split[d]) / avg))
        out.append((-round(s, 6), d))
    return [(d, -s) for s, d in sorted(out)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index") / "i")
    block, part = T.BLOCK, T.PART
    T.BLOCK, T.PART = 16, 50
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").withColumn("kind", F.concat(F.lit("K"), F.col("doc_id") % 3)).withColumn("term", F.lit("clash"))
    T.build_index(docs, folder, exact=("kind",))
    yield folder
    T.BLOCK, T.PART = block, part


@pytest.mark.parametrize("terms", [["w0"], ["w0", "rare"], ["rare", "w35", "w0"], ["w39"], ["absent"], ["absent", "w3"]])
@pytest.mark.parametrize(("limit", "offset"), [(10, 0), (25, 15), (2000, 0)])
def test_search_is_brute_force(spark, index, terms, limit, offset):
    got = [(r.doc, r.score) for r in T.search_ranked(spark, index, terms, limit, offset).collect()]
    want = brute(corpus(), terms)[offset : offset + limit]
    assert [d for d, _ in got] == [d for d, _ in want] and all(abs(a - b) < 2e-6 for (_, a), (_, b) in zip(got, want, strict=True))


def test_exact_values_and_no_terms(spark, index):
    got = [r.doc for r in T.search_ranked(spark, index, ["w7"], 20, exact={"kind": "k1"}).collect()]
    assert got == [d for d, _ in brute(corpus(), ["w7"], 1)][:20]
    assert [tuple(r) for r in T.search_ranked(spark, index, [], 3, 2).collect()] == [(2, 0.0), (3, 0.0), (4, 0.0)]


def test_plan_reads_only_the_blocks_that_matter(spark, index):
    plan = T.search_plan(spark, index, ["w0", "rare"], 10)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "bucket" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(best" in text and "split(" not in text
    all_docs = {d for d, _ in brute(corpus(), ["w0", "rare"])}
    assert plan.count() < len(all_docs) / 2


def test_sync_modes(spark):
    status = lambda *s: spark.createDataFrame([(k, x) for k, x in enumerate(s)], "k int, status string")
    modes = [T.sync_metadata(status(*s)).collect()[0].mode for s in (("same",), ("same", "new"), ("deleted",), ("changed", "new"), ())]
    assert modes == ["noop", "incremental_append", "incremental_sync", "incremental_sync", "noop"]
    assert T.sync_metadata(status("new"), indexed=False).collect()[0].mode == "full_rebuild"


def test_empty_index(spark, tmp_path):
    T.build_index(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "i"))
    assert not T.search_ranked(spark, str(tmp_path / "i"), ["x"]).count() and not T.search_ranked(spark, str(tmp_path / "i"), []).count()


def test_words_are_those_of_the_sql(spark, tmp_path):
    texts = ["", None, "Ab, aB!ab", "İx Ky été z9", "-- ", "end", "end", "9" * 300, "a\u0000b"]
    T.build_index(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), str(tmp_path / "i"))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = con.execute(f"SELECT term, count(DISTINCT doc), count(*) FROM (SELECT doc_id AS doc, unnest({T._TOK}) AS term FROM documents) GROUP BY 1 ORDER BY 1").fetchall()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "i" / "terms")).select("term", "df", "cf").orderBy("term").collect()] == want
    again = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select(F.explode(T.words_of("text")).alias("term")).groupBy("term").count()
    assert sorted(tuple(r) for r in again.collect()) == [(t, n) for t, _, n in want]


def shuffled(spark, run) -> int:
    """Rows that the stages of a run shuffle."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def stages() -> dict[int, int]:
        time.sleep(1)  # the store follows the run
        found = store.stageList(None, False, False, none, None)
        return {s.stageId(): s.shuffleWriteRecords() for s in (found.apply(k) for k in range(found.size()))}

    last = max(stages(), default=-1)
    run()
    return sum(n for k, n in stages().items() if k > last)


def test_build_shuffles_a_row_a_term_of_a_chunk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "PART", 1 << 16)  # the module's index has small parts
    docs = spark.range(2000).repartition(4).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), F.col("id") % 2) for k in range(20)]).alias("text")).localCheckpoint()
    assert shuffled(spark, lambda: T.build_index(docs, str(tmp_path / "i"))) < 2000  # 40 000 pairs of a term and a document
    assert spark.read.parquet(str(tmp_path / "i" / "postings")).agg(F.sum("n")).collect()[0][0] == 40_000


@pytest.mark.parametrize(("chunk", "part"), [(1, 8), (300, 40), (1 << 24, 1 << 16)])
def test_chunks_change_nothing(spark, tmp_path, monkeypatch, chunk, part):
    monkeypatch.setattr(T, "CHUNK", chunk)
    monkeypatch.setattr(T, "PART", part)
    docs = spark.createDataFrame([(f"d{d}", t) for d, t in corpus()[:150]], "doc_id string, text string").withColumn("kind", F.when(F.col("doc_id") != "d9", "Kä"))
    T.build_index(docs, str(tmp_path / "i"), exact=("kind",))
    blocks = spark.read.parquet(str(tmp_path / "i" / "postings"))
    got = {(r.term, r.doc): (r.tf, r.len) for r in blocks.select("term", F.explode("postings").alias("p")).select("term", "p.*").collect()}
    split = {f"d{d}": [w for w in re.split(r"[\W_]+", (t or "").lower()) if w] for d, t in corpus()[:150]}
    want = {(w, d): (n, len(words)) for d, words in split.items() for w, n in Counter(words).items()} | {("kind=kä", d): (1, len(words)) for d, words in split.items() if d != "d9"}
    assert got == want
    heads = blocks.select("n", "best", "total", F.expr("aggregate(postings.tf, 0L, (a, x) -> a + x)"), F.size("postings")).collect()
    assert all(r[0] == r[4] <= T.BLOCK and r[2] == r[3] for r in heads)
    parts = blocks.select("part", F.explode("postings.doc").alias("doc")).groupBy("doc").agg(F.countDistinct("part").alias("n"))
    assert parts.where("n > 1").isEmpty()
