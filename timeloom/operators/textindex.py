"""Full-text search: a stored index of postings in blocks, BM25 that reads the blocks which can matter."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.registry import query
from timeloom.sources import fixture
from timeloom.sources.storage import derived_folder

K1, B = 1.2, 0.75
BUCKETS = 64  # folders of terms
BLOCK = 128  # postings of a block
PART = 1 << 16  # documents of a part, about
CHUNK = 1 << 24  # bytes of text whose words are counted at once


def words_of(body: str) -> Column:
    return F.filter(F.split(F.lower(F.replace(body, F.lit("İ"), F.lit("i"))), r"[^\p{Alnum}]+"), lambda t: t != "")  # Java's lower case of the one letter has a second character


def _impact(tf: Column, length: Column, avg: float) -> Column:
    """What a posting adds to a score, without the term's idf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg))


def _word_reader() -> Callable[[pa.Array], tuple[np.ndarray, pa.Array]]:
    """A function of texts that gives the row and the text of each of their words, as `words_of` has them. This and what follows is nested, so that it travels to executors by value."""
    fold = np.zeros(256, "uint8")  # letters and digits, lower-cased; all other bytes separate
    for c in b"0123456789abcdefghijklmnopqrstuvwxyz":
        fold[c] = fold[ord(chr(c).upper())] = c

    def read(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        for letter, plain in (("\u0130", "i"), ("\u212a", "k")):  # what else is lower-cased to a letter of ASCII
            texts = pc.replace_substring(texts, letter, plain) if pc.any(pc.match_substring(texts, letter)).as_py() else texts
        texts = pc.fill_null(texts.cast(pa.string()), "")
        ends = np.frombuffer(texts.buffers()[1], "int32", len(texts) + 1, 4 * texts.offset).astype("int64")
        data = texts.buffers()[2]
        low = fold[np.frombuffer(data, "uint8", ends[-1] - ends[0], ends[0])] if data and ends[-1] > ends[0] else np.zeros(0, "uint8")
        ends -= ends[0]
        inside = low != 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        heads = ends[:-1][ends[:-1] < len(low)]
        begins[heads] = inside[heads]
        at = np.flatnonzero(begins)
        offsets = np.append(np.cumsum(inside, dtype="int32")[at] - 1, np.int32(inside.sum())).astype("int32")
        return np.searchsorted(ends, at, "right") - 1, pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(low[inside]))

    return read


def _measurer() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc, body to doc, len: how many words a document has."""
    read = _word_reader()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, len(batch) * CHUNK // max(batch.nbytes, 1))
            for k in range(0, len(batch), step):
                some = batch.slice(k, step)
                n = np.bincount(read(some.column(1))[0], minlength=len(some))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n.astype("int32"))], ["doc", "len"])

    return measure


def _counter(parts: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc, body and exact terms to term, part, docs, tfs, lens: a row a term of up to `most` documents, which are one part's."""
    read = _word_reader()

    def count(docs: pa.Table, part: int) -> pa.RecordBatch:
        docs = docs.combine_chunks().to_batches()[0]
        row, words = read(docs.column(1))
        lens = np.bincount(row, minlength=len(docs)).astype("int32")
        exact = [x.cast(pa.string()) for x in docs.columns[2:]]
        row = np.concatenate([row, *[np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False)) for x in exact]])
        coded = pa.concat_arrays([words, *[x.drop_null() for x in exact]]).dictionary_encode()
        found, tf = np.unique(coded.indices.to_numpy().astype("int64") * len(docs) + row, return_counts=True)  # by term, then by document
        term, row = found // len(docs), found % len(docs)
        first = pa.array(np.searchsorted(term, np.arange(len(coded.dictionary) + 1)).astype("int32"))
        lists = [pa.ListArray.from_arrays(first, x) for x in (docs.column(0).take(pa.array(row)), pa.array(tf.astype("int32")), pa.array(lens[row]))]
        return pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.full(len(coded.dictionary), part, "int64")), *lists], ["term", "part", "docs", "tfs", "lens"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, rows, size = [], 0, 0
        for batch in batches:
            step = max(1, min(most, len(batch) * CHUNK // max(batch.nbytes, 1)))
            for k in range(0, len(batch), step):
                some = batch.slice(k, step)
                if held and (rows + len(some) > most or size + some.nbytes > CHUNK):
                    yield count(pa.Table.from_batches(held), part % parts)
                    held, rows, size, part = [], 0, 0, part + 1
                held, rows, size = [*held, some], rows + len(some), size + some.nbytes
        if rows:
            yield count(pa.Table.from_batches(held), part % parts)

    return counted


def _cutter(avg: float, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of `_counter`, sorted by term and part, to term, part, best, n, total, postings: blocks of a term and part by impact. Holds the rows of one term and part, and a batch."""

    def cut(rows: pa.Table, first: np.ndarray) -> pa.RecordBatch:
        rows = rows.combine_chunks().to_batches()[0]
        docs, tf, length = rows.column(2).flatten(), rows.column(3).flatten().to_numpy().astype("int64"), rows.column(4).flatten().to_numpy()
        run = np.repeat(np.cumsum(first) - 1, pc.list_value_length(rows.column(2)).to_numpy())
        impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg))  # as `_impact` has it
        order = np.lexsort((docs.to_numpy() if pa.types.is_integer(docs.type) else pc.rank(docs).to_numpy(), -impact, run))
        tf, length, impact = tf[order], length[order], impact[order]
        starts = np.flatnonzero((np.arange(len(run)) - np.searchsorted(run, run)) % block == 0)
        head = pa.array(np.flatnonzero(first)[run[starts]])
        postings = pa.StructArray.from_arrays([docs.take(pa.array(order)), pa.array(tf), pa.array(length)], ["doc", "tf", "len"])
        n = np.diff(np.append(starts, len(run)))
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(run)).astype("int32")), postings)
        return pa.RecordBatch.from_arrays(
            [rows.column(0).take(head), rows.column(1).take(head), pa.array(impact[starts]), pa.array(n.astype("int32")), pa.array(np.add.reduceat(tf, starts)), lists], ["term", "part", "best", "n", "total", "postings"]
        )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            term, part = (rows[c].combine_chunks() for c in ("term", "part"))
            first = np.append(True, pc.or_(pc.not_equal(term[1:], term[:-1]), pc.not_equal(part[1:], part[:-1])).to_numpy(zero_copy_only=False))
            last = int(np.flatnonzero(first)[-1])
            held = rows.slice(last)
            if last:
                yield cut(rows.slice(0, last), first[:last])
        if held is not None:
            yield cut(held, np.append(True, np.zeros(len(held) - 1, bool)))

    return blocks


def build_index(docs: DataFrame, folder: str, doc: str = "doc_id", body: str = "text", exact: tuple[str, ...] = ()) -> None:
    """Writes an index of docs into a folder of the store; texts are read once for their lengths and once for their words.

    `lengths` (doc, len), `stats` (n, avg), `terms` (bucket, term, df, cf, top) and `postings` (bucket, term, part, best, n, total, postings): blocks of up to `BLOCK` postings of
    a term, those with the highest impact first, with the best impact and the summed counts of each block. Terms are dealt to folders by their CRC-32; within
    one they are sorted by term and best impact, so a reader's filters on both skip row groups and pages. Words are counted in chunks of texts, and only
    a row a term of a chunk is shuffled. Chunks are dealt to parts of about `PART` documents and a term's postings are
    gathered by part, so a word of all documents fills no group. exact: columns whose whole value is a
    term of its own, `column=value`, which has no share in the length. Null bodies are empty; documents must have distinct ids.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc).alias("doc"), F.col(body).alias("body"), *[F.concat(F.lit(f"{c}="), F.lower(c)).alias(f"x{k}") for k, c in enumerate(exact)])
    kind = rows.schema["doc"].dataType.simpleString()
    rows.select("doc", "body").mapInArrow(_measurer(), f"doc {kind}, len int").write.parquet(f"{folder}/lengths")
    spark.read.schema(f"doc {kind}, len int").parquet(f"{folder}/lengths").agg(F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avg")).write.parquet(f"{folder}/stats")
    n, avg = spark.read.parquet(f"{folder}/stats").collect()[0]
    bucket = (F.crc32("term") % BUCKETS).cast("int").alias("bucket")
    counted = rows.mapInArrow(_counter(-(-n // PART) or 1, max(1, PART // 8)), f"term string, part long, docs array<{kind}>, tfs array<int>, lens array<int>")
    dealt = counted.repartition(bucket, F.col("part") % 4).sortWithinPartitions(bucket, "term", "part")
    blocks = dealt.mapInArrow(_cutter(avg or 1.0, BLOCK), f"term string, part long, best double, n int, total long, postings array<struct<doc:{kind},tf:long,len:int>>")
    blocks.select(bucket, "*").sortWithinPartitions("bucket", "term", F.desc("best")).write.option("parquet.block.size", 1 << 22).partitionBy("bucket").parquet(f"{folder}/postings")
    held = spark.read.schema("bucket int, term string, best double, n int, total long").parquet(f"{folder}/postings")
    held.groupBy("bucket", "term").agg(F.sum("n").alias("df"), F.sum("total").alias("cf"), F.max("best").alias("top")).repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/terms")


def _pruned(spark: SparkSession, folder: str, table: str, terms: list[str]) -> DataFrame:
    """Rows of the terms; only their buckets' files are listed and read. An index of no words has no file that a schema could come from."""
    buckets = sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})
    doc = spark.read.parquet(f"{folder}/lengths").schema["doc"].dataType.simpleString()
    schema = {"terms": "term string, df long, cf long, top double", "postings": f"term string, part long, best double, n int, postings array<struct<doc:{doc},tf:long,len:int>>"}[table]
    return spark.read.schema(f"{schema}, bucket int").parquet(f"{folder}/{table}").where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))


def search_plan(spark: SparkSession, folder: str, terms: list[str], k: int | None) -> DataFrame:
    """doc, score of all documents that may be among the k best of the terms: blocks whose best posting, with the best of
    all other terms (in the index: the scan skips them; in the block's part of the documents), stays below what k documents are known to reach are left out. k None: of all documents with a term."""
    wanted = sorted({t.lower() for t in terms})
    n, avg = spark.read.parquet(f"{folder}/stats").collect()[0]
    known = {r["term"]: (math.log(1 + (n - r["df"] + 0.5) / (r["df"] + 0.5)), r["top"]) for r in _pruned(spark, folder, "terms", wanted).collect()}  # a row a term of the search
    wanted = [t for t in wanted if t in known]
    blocks = _pruned(spark, folder, "postings", wanted)
    idf = F.coalesce(*[F.when(F.col("term") == t, known[t][0]) for t in wanted]) if wanted else F.lit(0.0)

    def scored(some: DataFrame) -> DataFrame:
        rows = some.select(idf.alias("idf"), F.explode("postings").alias("p")).select("p.*", "idf")
        return rows.groupBy("doc").agg(F.sum(F.col("idf") * _impact(F.col("tf"), F.col("len"), avg or 1.0)).alias("score"))

    if k is None or not wanted:
        return scored(blocks)
    first = [blocks.where(F.col("term") == t).orderBy(F.desc("best")).limit(k // BLOCK + 2) for t in wanted]
    seeds = scored(reduce(DataFrame.unionByName, first)).orderBy(F.desc("score")).limit(k).agg(F.count("*").alias("n"), F.min("score").alias("least")).collect()[0]
    reached = seeds["least"] - 1e-6 if seeds["n"] >= k else 0.0  # scores are rounded to six places
    most = sum(i * top for i, top in known.values())
    keep = [(F.col("term") == t) & (F.col("best") >= (reached - (most - i * top)) / i) for t, (i, top) in known.items()]
    here = lambda k: F.coalesce(f"top{k}", F.lit(0.0))  # noqa: E731; the best of a term within a part of the documents
    tops = blocks.groupBy("part").agg(*[F.max(F.when(F.col("term") == t, idf * F.col("best"))).alias(f"top{k}") for k, t in enumerate(wanted)])
    rest = sum((F.when(F.col("term") != t, here(k)).otherwise(0.0) for k, t in enumerate(wanted)), F.lit(0.0))
    return scored(blocks.where(reduce(lambda a, b: a | b, keep)).join(tops, "part").where(idf * F.col("best") + rest >= reached))


def search_ranked(spark: SparkSession, folder: str, terms: list[str], limit: int = 50, offset: int = 0, exact: dict[str, str] | None = None) -> DataFrame:
    """doc, score: the best documents of an index by BM25 over a few terms, ties by doc; without terms all documents with score 0.

    exact: values that the index's exact columns must have. Terms that no document has add nothing.
    """
    if not terms:
        hits = spark.read.parquet(f"{folder}/lengths").select("doc", F.lit(0.0).alias("score"))
    else:
        hits = search_plan(spark, folder, terms, None if exact else offset + limit)  # a filter decides behind the scores
    for column, value in (exact or {}).items():
        hits = hits.join(_pruned(spark, folder, "postings", [f"{column}={value.lower()}"]).select(F.explode("postings.doc").alias("doc")), "doc", "left_semi")
    return hits.select("doc", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc").offset(offset).limit(limit)


def index_sync(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """status per key, from digests of whole rows: new, changed, same or deleted."""
    digest = lambda df: df.select(key, F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("d"))
    both = digest(old).withColumnRenamed("d", "was").join(digest(new).withColumnRenamed("d", "now"), key, "full")
    status = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("was") == F.col("now"), "same").otherwise("changed")
    return both.select(key, status.alias("status"))


MODES = ["full_rebuild", "noop", "incremental_append", "incremental_sync"]


def sync_metadata(statuses: DataFrame, indexed: bool = True) -> DataFrame:
    """One row: how many keys are new, changed, deleted and same, and what the index needs. indexed: whether there is one yet."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("new", "changed", "deleted", "same")]
    return statuses.agg(*counts).withColumn("mode", F.when(F.lit(not indexed), MODES[0]).when(F.col("changed") + F.col("deleted") > 0, MODES[3]).when(F.col("new") > 0, MODES[2]).otherwise(MODES[1]))


_TOK = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '')"


def document_index(spark: SparkSession, sf_dir: str) -> str:
    return derived_folder(spark, f"{sf_dir}/documents.parquet", "document-index", lambda folder: build_index(fixture.RELATIONS["documents"](spark, sf_dir), folder))


def event_index(spark: SparkSession, sf_dir: str) -> str:
    return derived_folder(spark, f"{sf_dir}/events.parquet", "event-index", lambda folder: build_index(fixture.events_full(spark, sf_dir), folder, "event_id", "message_full", EXACT))


EXACT = ("artifact_type", "severity", "event_action", "hash")
query("index_build", f"WITH t AS (SELECT doc_id AS doc, unnest({_TOK}) AS term FROM documents) SELECT term, count(DISTINCT doc) AS docs, count(*) AS tf, count(DISTINCT doc) AS in_blocks FROM t GROUP BY 1", over="documents_at")(
    lambda at: at[0].read.parquet(f"{document_index(*at)}/terms").select("term", F.col("df").alias("docs"), F.col("cf").alias("tf"))
    .join(at[0].read.parquet(f"{document_index(*at)}/postings").groupBy("term").agg(F.sum("n").alias("in_blocks")), "term", "left")
)


def _bm25(source: str, terms: list[str], rest: str, where: str = "true") -> str:
    """The same scores by splitting every text. source: a relation doc, w (words), keep."""
    counts = ", ".join(f"len(list_filter(w, lambda t: t = '{t}')) AS c{k}" for k, t in enumerate(terms))
    dfs = ", ".join(f"count(*) FILTER (c{k} > 0) AS d{k}" for k in range(len(terms)))
    score = " + ".join(f"ln(1 + (c - d{k} + 0.5) / (d{k} + 0.5)) * c{k} * 2.2 / (c{k} + 1.2 * (0.25 + 0.75 * n / avg))" for k in range(len(terms)))
    return f"d AS ({source}), r AS (SELECT *, len(w) AS n, {counts} FROM d), s AS (SELECT count(*) AS c, avg(n) AS avg, {dfs} FROM r) SELECT doc, round({score}, 6) AS score FROM r, s WHERE ({' OR '.join(f'c{k} > 0' for k in range(len(terms)))}) AND {where} ORDER BY score DESC, doc {rest}"


_DOCS = f"SELECT doc_id AS doc, {_TOK} AS w FROM documents"
query("search_ranked", "WITH " + _bm25(_DOCS, ["idiot", "the"], "LIMIT 50"), over="documents_at")(lambda at: search_ranked(at[0], document_index(*at), ["idiot", "the"]))
query("documents_search", "WITH " + _bm25(_DOCS, ["water", "house", "und"], "LIMIT 30 OFFSET 20"), over="documents_at")(lambda at: search_ranked(at[0], document_index(*at), ["und", "house", "Water"], limit=30, offset=20))
query("events_search", ", " + _bm25("SELECT event_id AS doc, list_filter(regexp_split_to_array(lower(message_full), '[^a-z0-9]+'), lambda t: t <> '') AS w, severity = 'high' AS keep FROM ef", ["certutil", "http", "exe"], "LIMIT 40", "keep"), over="session")(
    lambda at: search_ranked(at[0], event_index(*at), ["certutil", "http", "exe"], limit=40, exact={"severity": "HIGH"})
)
_SYNC = "CASE WHEN event_id LIKE '%7' THEN 'deleted' WHEN event_id LIKE '%3' THEN 'changed' WHEN event_id LIKE '%5' THEN 'new' ELSE 'same' END"


def _sync(er: DataFrame) -> DataFrame:
    rows = er.select("event_id", "severity", "host")
    old = rows.where("event_id NOT LIKE '%5'")
    new = rows.where("event_id NOT LIKE '%7'").withColumn("severity", F.when(F.col("event_id").like("%3"), F.concat("severity", F.lit("!"))).otherwise(F.col("severity")))
    return index_sync(old, new, "event_id")


query("index_sync", f"SELECT event_id, {_SYNC} AS status FROM er")(_sync)


def _metadata(er: DataFrame) -> DataFrame:
    rows, less = er.select("event_id", "severity", "host"), er.where("event_id NOT LIKE '%5'").select("event_id", "severity", "host")
    runs = {"built": index_sync(rows.limit(0), rows, "event_id"), "again": index_sync(rows, rows, "event_id"), "appended": index_sync(less, rows, "event_id"), "edited": _sync(er)}
    return reduce(DataFrame.unionByName, [sync_metadata(r, name != "built").withColumn("run", F.lit(name)) for name, r in runs.items()])


_LIKE = lambda d: f"count(*) FILTER (event_id LIKE '%{d}')"
query("index_metadata", f"""SELECT 'built' AS run, count(*) AS new, 0 AS changed, 0 AS deleted, 0 AS same, 'full_rebuild' AS mode FROM er UNION ALL
 SELECT 'again', 0, 0, 0, count(*), 'noop' FROM er UNION ALL SELECT 'appended', {_LIKE(5)}, 0, 0, count(*) - {_LIKE(5)}, 'incremental_append' FROM er UNION ALL
 SELECT 'edited', {_LIKE(5)}, {_LIKE(3)}, {_LIKE(7)}, count(*) - {_LIKE(5)} - {_LIKE(3)} - {_LIKE(7)}, 'incremental_sync' FROM er""")(_metadata)
#: fields of an event that its index body holds
BODY = [
    "event_id", "case_id", "event_time_utc", "artifact_type", "event_action", "severity", "host", "user_name", "process_name", "file_path", "ip", "url", "hash", "message_short", "message_full",
    "source_file_id", "parser_name", "evidence_ref", "attributes_json",
]
query("index_body", "SELECT event_id, concat_ws(' ', " + ", ".join(BODY) + ") AS body FROM ef", over="ef")(lambda ef: ef.select("event_id", F.concat_ws(" ", *BODY).alias("body")))
