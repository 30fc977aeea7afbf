"""The training-data operators against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from compare import connect, differ
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from timeloom.llm import queries as Q
from timeloom.llm.decontamination import contaminated
from timeloom.llm.embedding_dedup import embedding_dedup
from timeloom.llm.html_text import html_text, visible_text
from timeloom.llm.language_id import language_id
from timeloom.llm.ngram_join import ngram_join
from timeloom.llm.ngram_lm import discounts, lm_scores
from timeloom.llm.packing import pack, plan, sequences
from timeloom.llm.suffix_dedup import common_prefixes, earliest, suffix_array, suffix_dedup
from timeloom.llm.toxicity import toxicity
from timeloom.llm.url_filter import split_url, url_filter

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, n int, part string, spans string, rank long, block long"
BASE = "the quick brown fox jumps over the lazy dog while seven small cats watch from a wide green wall and nobody speaks at all today "


def hard(spark):
    """Documents with every awkward text; columns named like the operators' own."""
    r = np.random.default_rng(5)
    texts = [None, "", "  \t\n", "one", "two words", "Two WORDS", BASE, BASE.upper(), BASE + "extra", BASE * 3, "é" * 60 + BASE, "x" * 200, "x" * 200, BASE * 400, BASE[:49], BASE[:50], BASE[1:51], "a\x1cb \u2028c"]
    texts += [" ".join(r.choice(BASE.split(), 30)) for _ in range(20)]
    near = BASE.split()
    for k in range(12):
        w = list(near)
        w[k] = f"w{k}"
        texts.append(" ".join(w * 3))
    return [(k, t, 1, "p", "s", 2, 3) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(hard(spark), DOCS)


def test_sql_twins(spark):
    con = connect(SF)
    for name, sql in Q.ORACLES.items():
        assert not differ(spark, con, SF, Q.QUERIES[name], sql), name


# ---- 2


def brute_components(rows, width, percent):
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    top = {d: d for d in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            a, b = sets[i], sets[j]
            if i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                top[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_ngram_join(docs, width, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join(docs, width, percent).collect()}
    assert got == brute_components([(r[0], r[1]) for r in docs.collect()], width, percent)


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_ngram_join_of_many_documents(spark, width, percent, monkeypatch):
    """A large group of near copies with drift, small ones, sets at the threshold, short ones, and texts of common lines."""
    from timeloom.llm import ngram_join as J

    monkeypatch.setattr(J, "GROUP", 20_000)  # many groups to a family
    r = np.random.default_rng(9)
    vocabulary = np.array([f"v{k}" for k in range(3000)])
    rows, d = [], 0
    for size, n, drift in [(300, 40, 3), *[(int(r.integers(2, 6)), int(r.integers(4, 120)), 2) for _ in range(130)]]:
        base = list(r.choice(vocabulary, n))
        for _ in range(size):
            w = list(base)
            for _ in range(int(r.integers(0, drift + 1))):
                w[int(r.integers(len(w)))] = str(r.choice(vocabulary))
            rows.append((d, " ".join(w[: len(w) - int(r.integers(0, 3))])))
            d += 1
    lines = [" ".join(r.choice(vocabulary, 9)) for _ in range(12)]
    rows += [(d + k, " ".join(r.choice(lines, 6))) for k in range(200)]
    for n in (9, 10, 18, 19, 20, 27, 60):  # subsets by one shingle
        w = list(r.choice(vocabulary, n + width))
        rows += [(5000 + n * 10 + k, " ".join(w[: n + width - 1 - k])) for k in range(4)]
    frame = spark.createDataFrame([rows[k] for k in r.permutation(len(rows))], "doc_id long, text string").repartition(5)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join(frame, width, percent).collect()}
    want = brute_components(rows, width, percent)
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows) - 100


def test_signatures_meet():
    from timeloom.llm.ngram_join import signatures

    r = np.random.default_rng(6)
    for percent in (80, 90):
        for n in [*range(4, 60), 100, 333, 1000]:
            a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            for _ in range(6):
                less, more = int(r.integers(0, n // 4 + 1)), int(r.integers(0, n // 4 + 1))
                b = np.unique(np.r_[r.permutation(a)[: n - less], r.integers(0, 2**63, more).astype(np.uint64)])
                both = len(np.intersect1d(a, b))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    assert len(np.intersect1d(signatures(a, percent), signatures(b, percent)))


def test_ngram_join_of_repeated_ids(spark):
    rows = [(1, BASE), (1, "quite another text of seven words here"), (2, BASE), (2, "quite another text of seven words here"), (None, BASE), (3, None)]
    got = sorted(ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).select("doc_id", "component_id").collect(), key=str)
    assert [tuple(r) for r in got] == sorted([(1, 1), (1, 1), (2, 1), (2, 1), (None, None), (3, 3)], key=lambda t: f"Row(doc_id={t[0]}, component_id={t[1]})")


def test_ngram_join_repeated_rows_and_empty(docs):
    twice = ngram_join(docs.union(docs), 3, 90)
    assert twice.count() == 2 * docs.count() and twice.distinct().count() == docs.count()
    assert ngram_join(docs.limit(0)).count() == 0


# ---- 3


def test_packing(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = pack(docs, path, 64).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    t = Tokenizer.from_file(path)
    for d, text, *_ in docs.collect():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(by_doc[d], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // 64))) and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 64 for r in own[1:])
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in own)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert len(by_seq) <= 1.1 * -(-sum(r["length"] for r in rows) // 64) + 1
    assert pack(docs.limit(0), path).count() == 0


def test_sequences_hold_the_ids(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = sum(len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sum(len(r["ids"]) for r in sequences(docs, path, 64).collect()) == want


def test_added_tokens_in_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\x0b" + BASE * 3, "<|endoftext|", "a\u200b<|endoftext|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = defaultdict(list)
    for r in sorted(pack(docs, path, 64, keep_ids=True).collect(), key=lambda r: (r["doc_id"], r["piece"])):
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        got[r["doc_id"]] += r["ids"]
    assert got == {d: [*t.encode(x, add_special_tokens=False).ids, 2] for d, x in enumerate(texts)}
    assert got[0] == [64, 220, 50256, 275, 2]


def test_plan_uses_every_piece_once():
    h = np.random.default_rng(1).integers(0, 50, 129)
    h[0] = 0
    got = Counter()
    for shape, n in plan(h, 128):
        assert sum(shape) <= 128
        for v in shape:
            got[v] += n
    assert [got[k] for k in range(129)] == h.tolist()


# ---- 4


def test_contamination_against_brute_force(spark, docs):
    items = spark.createDataFrame([(1, BASE), (2, "w3 lazy dog"), (3, None), (4, ""), (5, "nothing like it here at all"), (1, BASE)], "item_id long, text string")
    word = re.compile(r"[0-9a-z_\x80-\U0010ffff]+")
    sets = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())(word.findall((t or "").translate(LOW)))
    want = set()
    for d, t, *_ in docs.collect():
        for i, x in items.distinct().collect():
            a, b = sets(t), sets(x)
            if b and 100 * len(a & b) >= 80 * len(b):
                want.add((d, i, len(b), len(a & b)))
    assert {tuple(r) for r in contaminated(docs, items).collect()} == want and want
    assert contaminated(docs, items.limit(0)).count() == 0 and contaminated(docs.limit(0), items).count() == 0


# ---- 5, 6, 1


@pytest.mark.parametrize(
    "html,want",
    [(None, ""), ("", ""), ("<p>a<p>b", "a\n\nb"), ("<ul><li>x<li>y</ul>", "- x\n- y"), ("<ol start=3><li>x<li>y</ol>", "3. x\n4. y"), ("a<br>b", "a\nb"), ("<b>a</b> b<script>x</script>", "a b"),
     ("<div hidden>x</div><div style='display: none'>y</div>z", "z"), ("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>", "a    | bbb\ncccc | d"), ("<pre>a\n  b</pre>", "a\n  b"), ("a &amp; &lt;b", "a & <b"), ("<p>unclosed <i>x", "unclosed x")],
)
def test_visible_text(html, want):
    assert visible_text(html) == want


@pytest.mark.parametrize(
    "html,want",
    [("<head><title>t</title><body>Hello<br>World", "Hello\nWorld"), ("<head><title>t</title>Hello<p>World", "Hello\n\nWorld"), ("<head><meta charset=x>\n<img src=a>Hello", "Hello"), ("<title>t</title><body>text", "text"),
     ("<head><style>x</style><noscript>n</noscript>\n<link><script>y</script><body>a<b>c</b>", "ac"), ("<head><noscript>n<body>text", "text"), ("<head><title>t</title></head>\n<body>a", "a"),
     ("<svg><title>t</title><desc>d</desc><text>one</text><text>two</text><path/></svg>", "one\ntwo"), ("<math><semantics><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></semantics></math>", "x=1"),
     ("a<textarea>\nb\n  c</textarea>d", "a\nb\n  c\nd"), ("<p>a<select><optgroup label=g><option>b<option>c<optgroup label=h><option>d</select>", "a\ng\nb\nc\nh\nd"), ("<span aria-hidden=true>x</span> y", "x y"), ("<text>a</text>b", "ab"),
     ("<textarea><i>a</i> &amp; b</textarea><i>c</i>", "<i>a</i> & b\nc"), ("<textarea>a<b>c", "a<b>c"), ("<textarea/>a</textarea>b", "a\nb")],
)
def test_text_that_browsers_show(html, want):
    assert visible_text(html) == want


def test_html_of_deep_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "u", "<div>" * 3000 + "x"), (2, None, None)], "page_id long, url string, html string")
    assert {r[0]: r[1] for r in html_text(pages).collect()} == {1: "x", 2: ""}
    assert html_text(pages.limit(0)).count() == 0
    assert [r[0] for r in html_text(pages.union(pages).withColumn("text", F.lit(3))).orderBy("page_id").collect()] == [1, 1, 2, 2]


def test_nested_tables():
    assert visible_text("<table><tr><td>" * 5000 + "x") == "x"
    inner = "<table><tr><td>1<td>22<tr><td>333<td>4</table>"
    assert visible_text(f"<table><tr><td>a<td>{inner}<tr><td>b<td>c</table>") == "a | 1 | 22 333 | 4\nb | c"


def test_long_urls_and_clashing_columns(spark):
    rows = [(1, "http://a.org/" + "x" * 200_000, "r"), (1, "http://a.org/" + "x" * 200_000, "r"), (2, "http://a.example.org/en/1" + "/y" * 50_000, "r"), (None, "http://b.com/de", "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    began = __import__("time").time()
    assert sorted((r["rule"] or "") for r in url_filter(pages, Q.URL_RULES).collect()) == ["", "example.org/en/1", "org/", "org/"]
    assert __import__("time").time() - began < 20


@pytest.mark.parametrize("url,want", [(None, ("", "")), ("x/y", ("", "")), ("http://A.b/C?d", ("a.b", "/C")), ("http://a#x", ("a", "")), ("s://a/b#c?d", ("a", "/b"))])
def test_split_url(url, want):
    assert split_url(url) == want


def test_longest_rule_wins(spark):
    pages = spark.createDataFrame([(1, "http://x.example.org/es/1"), (2, "http://notexample.org/es/1"), (3, "http://a.com/de/x"), (4, None), (5, "http://example.org/en/12")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter(pages, Q.URL_RULES).collect()}
    assert got == {1: ("example.org/es/", "block"), 2: ("org/", "allow"), 3: ("com/de/", "block"), 4: (None, "allow"), 5: ("example.org/en/1", "block")}
    assert url_filter(pages.limit(0), Q.URL_RULES).count() == 0


def test_language_id(spark):
    rows = Q.QUERIES["op1_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url"), "page_id").collect()
    right = [r["lang"] == re.search(r"://[^/]*/([a-z]+)/", r["url"])[1] for r in rows]
    assert len(rows) == 50 and np.mean(right) > 0.8
    pages = spark.createDataFrame([(1, None, None), (2, "http://a.b", ""), (3, "x", "<html lang=xx>")], "page_id long, url string, html string")
    labelled = spark.createDataFrame([(1, "the and of", "en"), (2, "der und die", "de"), (3, None, "fr"), (4, "x", None)], "doc_id long, text string, lang string")
    assert language_id(pages, labelled).count() == 3 and language_id(pages.limit(0), labelled).count() == 0
    assert {r["lang"] for r in language_id(pages, labelled.limit(0)).collect()} == {None}


def test_language_fusion_against_plain_sums(spark):
    """Host and suffix priors without the page's own share, declared language by counts, all by loops; repeated pages, ties, a long page, clashing columns."""
    from timeloom.llm import language_id as L

    words = {"de": "der die das und nicht ist ein wir haben", "en": "the and of to is that we have not", "fr": "le la les et des est nous avons pas"}
    r = np.random.default_rng(13)
    text = lambda k, n: " ".join(r.choice(words[k].split(), n))
    labelled = spark.createDataFrame([(k, text(lang, 40), lang) for k, lang in enumerate([*words] * 5)], "doc_id long, text string, lang string")
    hosts = ["a.de", "b.de", "c.fr", "d.com", "d.com", "d.com", ""]
    rows = []
    for k in range(60):
        h = hosts[int(r.integers(len(hosts)))]
        lang = {"de": "de", "fr": "fr"}.get(h.split(".")[-1], "en")
        said = [None, lang, "en", "xx"][int(r.integers(4))]
        body = "" if k % 9 == 0 else text(lang, int(r.integers(1, 30)))
        rows.append((k, f"http://{h}/p" if h else None, None if k % 13 == 0 else f"<html{f' lang={said}' if said else ''}><p>{body}</p>", "x"))
    rows += [rows[7], rows[7], (100, "http://d.com", "<p>" + text("en", 20_000) + "</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, lang string")
    names, model = L.fit(labelled)
    p = L.text_posteriors(__import__("pyarrow").array([L.plain(h or "") for _, _, h, _ in rows]), model)
    host = [(re.search(r"://([^/?#]*)", u)[1] if u else "") for _, u, _, _ in rows]
    suffix = [h.split(".")[-1] for h in host]
    said = [(lambda d: d if d is None or d in names else "other")(L.declared(h or "")) for _, _, h, _ in rows]
    world = p.sum(0) / p.sum()
    values = sorted({s for s in said if s})
    total = {v: sum((p[k] for k in range(len(rows)) if said[k] == v), np.zeros(len(names))) for v in values}
    like = {v: np.log((total[v] + 0.5) / (sum(total.values()) + 0.5 * len(values))) for v in values}
    want = []
    for k in range(len(rows)):
        wide = sum((p[j] for j in range(len(rows)) if suffix[j] == suffix[k] and j != k), np.zeros(len(names))) + L.STRENGTH * world
        narrow = sum((p[j] for j in range(len(rows)) if host[j] == host[k] and j != k), np.zeros(len(names))) + L.STRENGTH * wide / wide.sum()
        score = np.log(np.maximum(p[k], 1e-12)) + np.log(np.maximum(narrow / narrow.sum(), 1e-12)) + (like[said[k]] if said[k] else 0)
        e = np.exp(score - score.max())
        want.append((rows[k][0], names[int(score.argmax())], round(float(e.max() / e.sum()), 6)))
    got = [(x["page_id"], x["lang"], round(x["confidence"], 6)) for x in language_id(pages, labelled).collect()]
    assert sorted(got) == sorted(want)


# ---- 7


def test_toxicity_of_repeated_and_clashing(spark):
    docs = spark.createDataFrame([(1, "idiot words", 5.0), (1, "idiot words", 6.0), (None, "the end", 7.0)], "doc_id long, text string, c0 double")
    known = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    got = toxicity(docs, known, ["c0", "doc_id"]).collect()
    assert sorted(r["c0"] for r in got) == [5.0, 6.0, 7.0] and all(0 <= r["score"] <= 1 for r in got)


def test_toxicity_on_held_out_documents(spark):
    r = np.random.default_rng(3)
    rows, labels = [], []
    for d in range(400):
        w = list(r.choice(BASE.split(), 120))
        y = int(d % 4 == 0)
        if y:
            w[int(r.integers(120))] = str(r.choice(["idiot", "scum", "moron"]))
        rows.append((d, " ".join(w)))
        labels.append((d, y))
    rows += [(1000, None), (1001, ""), (1002, " ;"), (1003, "word " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1))
    known = spark.createDataFrame([x for x in labels if x[0] % 5], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity(docs, known, ["doc_id"]).collect()}
    held = [(got[d], y) for d, y in labels if d % 5 == 0]
    assert len(got) == 404 and np.mean([(s >= 0.5) == (y == 1) for s, y in held]) > 0.9
    assert got[1000] == got[1001] == got[1002] == 0 and all(0 <= s <= 1 for s in got.values())
    assert {r["score"] for r in toxicity(docs.limit(5), known.where("toxic = 0"), ["doc_id"]).collect()} == {0.0}
    assert toxicity(docs.limit(0), known.limit(0), ["doc_id"]).count() == 0


def window_words(n_rows=6):
    from timeloom.llm import toxicity as T

    r = np.random.default_rng(11)
    texts = [" ".join(r.choice(BASE.split(), int(k))) for k in r.integers(3, 90, n_rows)]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    words = T.Words(buf, np.r_[0, np.cumsum([len(t) for t in texts])])
    _, begin, size = words.windows()
    return T, words, begin, size


def plain_logit(p, x, hidden):
    """The network's definition, one window, one step at a time, in double precision."""
    sig = lambda a: 1 / (1 + np.exp(-a))
    states = {}
    for d in "fb":
        h, out = np.zeros(hidden), []
        for v in x if d == "f" else x[::-1]:
            g, y = v @ p[f"w{d}"] + p[f"c{d}"], h @ p[f"u{d}"]
            z, k = sig(g[:hidden] + y[:hidden]), sig(g[hidden : 2 * hidden] + y[hidden : 2 * hidden])
            c = np.tanh(g[2 * hidden :] + k * y[2 * hidden :])
            h = (1 - z) * c + z * h
            out.append(h)
        states[d] = np.array(out if d == "f" else out[::-1])
    both = np.concatenate([states["f"], states["b"]], 1)
    a = np.exp(both @ p["attend"])
    return (a / a.sum()) @ both @ p["out"] + p["bias"][0]


def test_the_network_against_its_definition():
    T, words, begin, size = window_words()
    p = {k: v.astype(np.float64) for k, v in T.initial(3).items()}
    vectors = words.vectors(p)
    got = T.forward(p, vectors, *T._batch(words, begin, size))
    want = [plain_logit(p, vectors[words.token[b : b + s]], T.HIDDEN) for b, s in zip(begin, size, strict=True)]
    assert np.allclose(got, want, atol=1e-5)


def test_gradients_against_differences():
    T, words, begin, size = window_words(3)
    p = {k: v.astype(np.float64) for k, v in T.initial(3).items()}
    p |= {k: v * 20 for k, v in p.items() if k in ("word", "char")}
    vectors = words.vectors(p)
    index, mask = T._batch(words, begin, size)
    y = np.arange(len(begin)) % 2
    loss = lambda q, v: float(np.sum(np.logaddexp(0, T.forward(q, v, index, mask)) - y * T.forward(q, v, index, mask)))
    keep = {}
    delta = 1 / (1 + np.exp(-T.forward(p, vectors, index, mask, keep))) - y
    g, dv = T.gradients(p, vectors, index, mask, keep, delta)
    r = np.random.default_rng(0)
    for name, grad in [*((k, g[k]) for k in ("wf", "uf", "cf", "wb", "ub", "cb", "attend", "out", "bias")), ("vectors", dv)]:
        for _ in range(3):
            at = tuple(int(r.integers(s)) for s in grad.shape)
            sides = []
            for e in (1e-2, -1e-2):  # states are single precision
                q, v = {k: x.copy() for k, x in p.items()}, vectors.copy()
                (v if name == "vectors" else q[name])[at] += e
                sides.append(loss(q, v))
            assert abs((sides[0] - sides[1]) / 2e-2 - grad[at]) < 2e-3 + 0.02 * abs(grad[at]), name


def test_the_network_adds_to_the_words(spark):
    """Label 1 where `not` does not stand before the word: words alone, whatever their weights, can't tell."""
    from timeloom.llm import toxicity as T

    r = np.random.default_rng(8)
    texts, y = [], []
    for k in range(600):
        w = list(r.choice(BASE.split(), 12))
        w[5:7] = ["bad", "not"] if k % 2 else ["not", "bad"]
        texts.append(" ".join(w))
        y.append(k % 2)
    p = T.train(texts[:500], np.array(y[:500]), 0.5, updates=400)
    buf = np.frombuffer("".join(texts[500:]).encode(), np.uint8)
    words = T.Words(buf, np.r_[0, np.cumsum([len(t) for t in texts[500:]])])
    _, begin, size = words.windows()
    logit = p["scale"][0] * T._logits(p, words, begin, size) + p["scale"][1]
    assert np.mean((logit >= 0) == (np.array(y[500:]) == 1)) > 0.9
    lexical = words.vectors(p)[:, 0][words.token]
    bag = np.array([lexical[b : b + s].sum() for b, s in zip(begin, size, strict=True)])
    assert max(np.mean((bag >= c) == (np.array(y[500:]) == 1)) for c in np.unique(bag)) < 0.7


def test_toxic_passages_across_window_edges():
    from timeloom.llm.toxicity import STRIDE, WINDOW

    assert 2 * STRIDE <= WINDOW  # so that any passage of up to half a window lies whole in one


# ---- 8


def test_embedding_dedup(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((60, 6))
    x[20:30] = x[0] + 0.2 * r.standard_normal((10, 6))
    x[30:34] = x[1]
    rows = [(k, [float(v) for v in y]) for k, y in enumerate(x)] + [(100, None), (101, [0.0] * 6), (102, [float("nan")] + [1.0] * 5), (103, [1.0, None] + [1.0] * 4), (104, []), (105, [1.0, 2.0]), (34, [float(v) for v in x[34]])]
    got = embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    label = np.arange(60)
    for _ in range(60):
        label = np.array([min([label[k], *label[hit[k]]]) for k in range(60)])
    for g in got:
        k = g["vec_id"]
        want = (int(hit[k].sum()), int(label[k])) if k < 60 else (0, k)
        assert (g["n_links"], g["component_id"], g["kept"]) == (*want, want[1] == k)
    assert len(got) == len(rows)
    assert embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_at_the_threshold_and_in_many_tiles(spark, monkeypatch):
    from timeloom.llm import embedding_dedup as E

    monkeypatch.setattr(E, "TILE", 64)
    r = np.random.default_rng(21)
    x = r.standard_normal((1500, 24))
    x[500:900] = x[r.integers(0, 40, 400)] + 0.35 * r.standard_normal((400, 24))
    x[900:950] = x[900]
    exact = []
    for k in range(60):  # cosine 90 / (10 * 10), whatever the order of the axes
        axes, sign = r.permutation(24), r.choice([-1.0, 1.0], 24)
        a, b = np.zeros(24), np.zeros(24)
        a[axes[0]] = 10 * sign[0]
        b[axes[:4]] = np.array([9, 3, 3, 1]) * np.r_[sign[0], sign[1:4]]
        exact += [(5000 + 2 * k, a * 2.0 ** (k % 5)), (5001 + 2 * k, b)]
    rows = [(k, [float(v) for v in y]) for k, y in [*enumerate(x), *exact]]
    got = {g["vec_id"]: (g["n_links"], g["component_id"]) for g in embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)).collect()}
    y, ids = np.array([v for _, v in rows]), np.array([k for k, _ in rows])
    hit = (y @ y.T) / (np.linalg.norm(y, axis=1)[:, None] * np.linalg.norm(y, axis=1)) >= 0.9
    np.fill_diagonal(hit, False)
    label = ids.copy()
    for _ in range(100):
        label = np.array([min([label[k], *label[hit[k]]]) for k in range(len(ids))])
    assert got == {int(i): (int(h.sum()), int(c)) for i, h, c in zip(ids, hit, label, strict=True)}
    assert all(got[i][0] >= 1 for i, _ in exact)


# ---- 9


def brute_lm(train, texts):
    """log10 probabilities of texts by the definition, with counters; texts are lists of words, END is None."""
    c, tri = Counter(), Counter()
    for w in train:
        c.update(w)
        tri.update(zip(["<s>", "<s>", *w[:-2]] if len(w) > 1 else ["<s>"], ["<s>", *w[:-1]], w, strict=True))
    n, v = sum(c.values()), len(c)
    levels = [Counter(w for _, w in {(y, z) for _, y, z in tri}), Counter((y, z) for _, y, z in tri), tri]
    d = []
    for level in levels:
        coc = Counter(level.values())
        d.append(discounts(*[coc[i] for i in (1, 2, 3, 4)]))
    total, back = [Counter(), Counter(), Counter()], [Counter(), Counter(), Counter()]
    for i, level in enumerate(levels):
        for gram, k in level.items():
            context = gram[:-1] if i else ()
            total[i][context] += k
            back[i][context] += d[i][min(k, 3) - 1]

    def p(i, context, w):
        if i < 0:
            return 1 / (v + 1)
        rest = p(i - 1, context[1:], w)
        k = levels[i][(*context, w) if i else w]
        return ((k - d[i][min(k, 3) - 1] if k else 0) + back[i][context] * rest) / total[i][context] if total[i][context] else rest

    for context in [("<s>", "<s>"), ("the", "quick"), ("seven", "never seen")]:
        assert math.isclose(sum(p(2, context, w) for w in c) + p(2, context, "never seen"), 1)
    base = lambda w: math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1)))
    return [
        (len(w), sum(c[x] > 0 for x in w), n, sum(map(base, w)), sum(math.log10(p(2, (x, y), z)) for x, y, z in zip(["<s>", "<s>", *w[:-2]][-len(w) :], ["<s>", *w[:-1]], w, strict=True)))
        for w in texts
    ]


def same_scores(train, docs):
    words = {r["doc_id"]: [*WORD.findall((r["text"] or "").translate(LOW)), None] for r in docs.collect()}
    learnt = [words[r["doc_id"]] for r in train.select("doc_id").collect()]
    brute = dict(zip(words, brute_lm(learnt, list(words.values())), strict=True))
    got = lm_scores(train, docs, ["doc_id"]).collect()
    assert len(got) == len(words)
    for r in got:
        counts, want = brute[r["doc_id"]][:3], brute[r["doc_id"]][3:]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == counts
        assert math.isclose(r["base_score"], want[0], rel_tol=1e-9) and math.isclose(r["score"], want[1], rel_tol=1e-9), r


def test_lm_against_brute_force(docs):
    """The fox's words are so frequent that all are split; see below for rare ones."""
    train = docs.where("doc_id % 3 <> 0")
    same_scores(train, docs)
    assert {r["score"] for r in lm_scores(train.limit(0), docs, ["doc_id"]).collect()} == {0.0}
    assert lm_scores(train, docs.limit(0), ["doc_id"]).count() == 0


def test_lm_of_rare_and_frequent_words(spark, monkeypatch):
    """Some words are over a shard's share and split, most are not; runs of a few tokens, so counts of a trigram meet in the shards."""
    from timeloom.llm import ngram_lm

    r = np.random.default_rng(3)
    vocabulary = ["the", "quick", "seven", *(f"w{k}" for k in range(3000))]
    rows = [(k, " ".join(vocabulary[min(int(x), 3002)] for x in r.zipf(1.25, int(r.integers(0, 60))))) for k in range(600)]
    rows += [(1000 + k, rows[k][1]) for k in range(50)] + [(2000, "the quick " * 3000), (2001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(ngram_lm, "RUN", 500)
    same_scores(docs.where("doc_id % 10 <> 0"), docs)


def test_lm_files_and_packing():
    """Columns, gaps and tables of keys come back as they went in; keys whose upper halves agree are told apart."""
    from timeloom.llm import ngram_lm as M

    r = np.random.default_rng(4)
    v = np.sort(r.integers(0, 50, 400))
    u = r.integers(0, 2**40, 400)
    u = u[np.lexsort((u, v))]
    dv, du, w = M._unpacked(M._packed(*M._gaps(v, u), u), 400, 3)
    assert (w == u).all() and all((x == y).all() for x, y in zip(M._ungapped(dv, du), (v, u), strict=True))
    keys = np.unique(np.r_[r.integers(0, 2**63, 300), np.arange(0, 40 << 16, 1 << 16)]).astype(np.uint64)
    high, low, more_high, more_low, values = M._table(keys, np.where(np.arange(len(keys)) % 2, 1, 70_000))
    assert (values == 70_000).all() and len(high) + len(more_high) == len(keys)
    asked = np.unique(np.r_[keys >> np.uint64(16), np.arange(100, 140).astype(np.uint64)])
    odd = keys[1::2] >> np.uint64(16)
    which, at = M._find(high, low, asked)
    assert sorted(asked[which]) == sorted(odd) and (((high[at].astype(np.uint64) << np.uint64(16)) | low[at]) == asked[which]).all()


def test_lm_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b a", 2), (1, "a b a", 2), (2, None, 3)], "doc_id long, text string, shard int")
    got = lm_scores(docs, docs, ["doc_id", "shard"]).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["shard"], r["n_tokens"]) for r in got] == [(1, 2, 4), (1, 2, 4), (2, 3, 1)] and got[0]["score"] == got[1]["score"]


# ---- 10


def brute_removed(rows):
    first = {}
    raw = {d: (t or "").encode() for d, t in rows}
    for d in sorted(raw):
        for p in range(len(raw[d]) - 49):
            first.setdefault(raw[d][p : p + 50], d)
    out = {}
    for d, s in raw.items():
        gone = bytearray(len(s))
        for p in range(len(s) - 49):
            if first[s[p : p + 50]] < d:
                gone[p : p + 50] = b"\1" * 50
        runs = len([g for g in bytes(gone).split(b"\0") if g])
        out[d] = (len(s), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(s, gone, strict=True) if not g)).hexdigest())
    return out


def test_suffix_dedup(docs):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup(docs).collect()}
    assert got == brute_removed([(r[0], r[1]) for r in docs.collect()])
    assert suffix_dedup(docs.union(docs)).count() == 2 * docs.count() and suffix_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [50_000, 3])
def test_suffix_dedup_of_many_documents(spark, hot):
    """Passages that many documents share in changing company, whole copies, long and periodic texts, all split as hot where hot is 3."""
    r = np.random.default_rng(12)
    vocabulary = [f"word{k}" for k in range(400)]
    passages = [" ".join(r.choice(vocabulary, int(n))) for n in r.integers(8, 90, 15)]
    rows = []
    for d in range(500):
        parts = [" ".join(r.choice(vocabulary, int(r.integers(0, 25))))]
        for _ in range(int(r.integers(0, 3))):
            p = passages[int(r.integers(15))]
            a = int(r.integers(0, len(p) // 2))
            parts += [p[a : a + int(r.integers(30, 300))], " ".join(r.choice(vocabulary, int(r.integers(0, 9))))]
        rows.append((d * 7 % 503, " ".join(parts)))
    rows += [(1000 + k, rows[k][1]) for k in range(40)] + [(2000, "ab" * 300), (2001, "x" * 120 + "ab" * 200), (2002, "\u00e9" * 90), (2003, passages[0] * 200), (2004, "z\u00e9" + passages[0])]
    frame = spark.createDataFrame([rows[k] for k in r.permutation(len(rows))], "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffix_dedup(frame, hot=hot).collect()}
    assert got == brute_removed(rows)


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(4)
    for n in (1, 2, 9, 200):
        s = bytes(r.choice(list(b"ab"), n)) + b"\xff"
        buf = np.frombuffer(s, np.uint8)
        sa = suffix_array(buf)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        for k, v in enumerate(common_prefixes(buf, sa).tolist()):
            if k:
                a, b = s[sa[k - 1] :], s[sa[k] :]
                assert v == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_shards_are_merged(monkeypatch):
    from timeloom.llm import suffix_dedup as M

    strings = [b"0123456789" * 3, b"xx" + b"0123456789" * 2, b"123456789012345"]
    whole = earliest(strings, [5, 3, 9], 10)
    monkeypatch.setattr(M, "SHARD", 8)
    parts = earliest(strings, [5, 3, 9], 10)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True)) and whole[0].min() == 3


# ---- pipeline


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in P.STAGES:
        before, kept = kept, stage(spark, kept, SF)
        if name != "best_fit_packing":
            assert kept.columns == docs.columns
            kept = spark.createDataFrame(kept.collect(), docs.schema)
        if name == "ngram_jaccard_join":
            brute = brute_components([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
            assert {r["doc_id"] for r in kept.collect()} == {c for _, c in brute.values()}
    assert kept.count() >= 100 and {"doc_id", "sequence_id", "offset"} <= set(kept.columns)


def test_stages_against_brute_force(spark, docs):
    import corpus_pipeline as P

    stages = dict(P.STAGES)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(d, t, "en", "s", len(t or "")) for d, t, *_ in docs.collect()]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows += [(1000 + k, BASE + " " + t, "en", "s", 1) for k, t in enumerate(items[:3])]
    given = spark.createDataFrame(rows, table.schema)
    raw = {r[0]: (r[1] or "").encode() for r in rows}
    first = {}
    for d in sorted(raw):
        for p in range(len(raw[d]) - 49):
            first.setdefault(raw[d][p : p + 50], d)
    want = {}
    for d, s in raw.items():
        gone = bytearray(len(s))
        for p in range(len(s) - 49):
            if first[s[p : p + 50]] < d:
                gone[p : p + 50] = b"\1" * 50
        want[d] = bytes(x for x, g in zip(s, gone, strict=True) if not g)
    cut = {r["doc_id"]: (r["text"] or "").encode() for r in stages["suffix_array_dedup"](spark, given, SF).collect()}
    assert cut == {d: s.decode(errors="replace").encode() for d, s in want.items() if s or not raw[d]}
    word = re.compile(r"[0-9a-z_\x80-\U0010ffff]+")
    sets = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())(word.findall((t or "").translate(LOW)))
    banned = [b for b in map(sets, items) if b]
    clean = {r[0] for r in rows if not any(100 * len(sets(r[1]) & b) >= 80 * len(b) for b in banned)}
    assert {r["doc_id"] for r in stages["benchmark_decontamination"](spark, given, SF).collect()} == clean and len(clean) == len(rows) - 3
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r[0]: np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4") for r in rows}
    pieces = stages["best_fit_packing"](spark, given, SF).collect()
    assert sum(r["length"] for r in pieces) == sum(map(len, ids.values()))
    assert all(zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in pieces)
