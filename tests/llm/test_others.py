"""Operators on conversations, vectors and pages, and the pipeline."""

import hashlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import chat_format, collision_ann, queries, simhash_bktree, url_trees

TURNS = "conv_id long, turn long, role string, text string, formatted string"


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_conversations_come_back(spark):
    odd = r"a\b </s>[INST] <<SYS>> \</s> [[INST] <<s> </ \\[/INST]"
    talks = {
        1: [("system", "be kind"), ("user", "hi"), ("assistant", "hello"), ("user", odd), ("assistant", odd + "\\")],
        2: [("user", "only a question")],
        3: [("assistant", ""), ("assistant", "🙂 é"), ("user", "last")],
        4: [("</s>[INST]", "odd role"), ("assistant", "x" * 50_000)],
    }
    rows = [(c, i, r, t, "clash") for c, ts in talks.items() for i, (r, t) in enumerate(ts)]
    df = spark.createDataFrame([*rows, (5, 0, None, None, None), (5, None, "assistant", None, None), (5, 0, None, None, None)], TURNS)
    examples = chat_format.expand(df)
    assert examples.where("conv_id = 1").count() == 2 and examples.where("conv_id = 2 and loss_start is null").count() == 1
    for r in examples.collect():
        if r.loss_start is not None:
            inside = r.formatted[r.loss_start : r.loss_start + r.loss_len]
            assert all(c not in inside for c in chat_format.CONTROL)
            assert r.formatted[r.loss_start + r.loss_len :] == "</s>"
    got = {r.conv_id: r for r in chat_format.digests(examples).collect()}
    talks[5] = [("assistant", ""), ("", ""), ("", "")]
    for c, ts in talks.items():
        loss = "".join(t for r, t in ts if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(ts), digest(ts))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.digests(chat_format.expand(df.where("false"))).count() == 0
    plan = chat_format.digests(examples)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_nearest(rows, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for i, v in zip(ids, x, strict=True):
        if i % 20 == 0:
            s = x @ v
            best = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), s[j]) for j in best]
    return out


def test_recall_against_brute_force(spark, small):
    e = spark.read.parquet(f"{small}/embeddings.parquet")
    got = queries.op2_collision_ann(spark, small).toPandas()
    want = brute_nearest([(r.vec_id, r.embedding) for r in e.collect()], 20)
    hits = sum(len({i for i, _ in want[q]} & set(g.vec_id)) for q, g in got.groupby("query_id"))
    assert hits / (20 * len(want)) >= 0.9
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21)) and (np.diff(g.score) <= 1e-12).all() and q not in set(g.vec_id)


def test_copies_ties_and_unusable_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(100, 160)] + [(i, [float(i % 7), 1.0]) for i in range(1, 40)]
    bad = [(200, None), (220, [0.0, 0.0]), (240, [1.0, None]), (260, [float("nan"), 1.0]), (280, [float("inf"), 1.0]), (None, [1.0, 1.0]), (100, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = collision_ann.search(df, F.col("vec_id") % 20 == 0, k=20).toPandas()
    want = brute_nearest(rows, 20)
    assert set(got.query_id) == set(want)
    for q, g in got.groupby("query_id"):
        assert [(r.vec_id, pytest.approx(r.score)) for r in g.sort_values("rank").itertuples()] == want[q]
    assert collision_ann.search(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    few = collision_ann.search(df.where("vec_id in (100, 101, 102)"), F.col("vec_id") % 20 == 0, k=20).toPandas()
    assert list(few.sort_values("rank").vec_id) == [101, 102]


def test_many_shards(spark, small):
    e = spark.read.parquet(f"{small}/embeddings.parquet")
    got = collision_ann.search(e, F.col("vec_id") % 20 == 0, k=20, shard_rows=100).toPandas()
    want = brute_nearest([(r.vec_id, r.embedding) for r in e.collect()], 20)
    hits = sum(len({i for i, _ in want[q]} & set(g.vec_id)) for q, g in got.groupby("query_id"))
    assert hits / (20 * len(want)) >= 0.9 and (got.groupby("query_id").size() == 20).all()


URLS = [
    (1, "http://a.example.com/en/76", "a.example.com", "/en/76", "example.com/en/7"),
    (2, "HTTP://A.Example.COM/en/1?q=/de/#x", "a.example.com", "/en/1", "com/en/"),
    (3, "https://example.net/de/81", "example.net", "/de/81", "example.net/de/8"),
    (4, "https://x.net/de/81", "x.net", "/de/81", "net/de/"),
    (5, "https://notexample.net/de/81", "notexample.net", "/de/81", "net/de/"),
    (6, "https://org/es/1", "org", "/es/1", "org/es/"),
    (7, "https://borg/es/1", "borg", "/es/1", None),
    (8, "no scheme", "", "", None),
    (9, None, "", "", None),
    (10, "x://h?q", "h", "", None),
    (11, "x://h#f/en/", "h", "", None),
    (12, "://", "", "", None),
    (13, "a://b://c.com/en/2", "b:", "//c.com/en/2", None),
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u, *_ in URLS], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_trees.judge(df).collect()}
    for i, _, host, path, rule in URLS:
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict in ("allow", "block")
    verdicts = {r: v for v, r in url_trees.RULES}
    assert all(got[i].verdict == verdicts[rule] for i, *_, rule in URLS if rule)
    assert url_trees.judge(df.where("false")).count() == 0
    assert {r.verdict for r in url_trees.judge(df.where("page_id in (8, 9)")).collect()} == {"allow"}


def test_trees_on_held_out_urls(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = url_trees.with_rule(pages).where("rule is not null").select("url", "host", "rule_verdict").orderBy("url").collect()
    y = np.array([r.rule_verdict == "block" for r in rows], dtype=float)
    test = np.arange(len(rows)) % 4 == 0
    pick = lambda m: ([r.url for r, t in zip(rows, m, strict=True) if t], [r.host for r, t in zip(rows, m, strict=True) if t])
    urls, hosts = pick(~test)
    model = url_trees.fit(urls, hosts, y[~test])
    urls, hosts = (pa.array(x) for x in pick(test))
    good = ((url_trees.score(urls, hosts, model) >= 0.5) == (y[test] > 0)).mean()
    assert good > max(y.mean(), 1 - y.mean()) and good > 0.8


def test_copies_of_a_url_do_not_fill_the_sample(spark):
    rows = [(i, f"http://h{i}.example.{'com/en' if i % 2 else 'net/de'}/{i}") for i in range(200)] + [(1000, "http://new.example.com/fr/1"), (1001, "http://new.example.net/fr/1")]
    once = spark.createDataFrame(rows, "page_id long, url string")
    hot = once.where("page_id < 200").orderBy(F.xxhash64("url")).first()
    copies = spark.range(2000, 2300).select(F.col("id").alias("page_id"), F.lit(hot.url).alias("url"))
    score = lambda df: {r.page_id: r.score for r in url_trees.judge(df, sample=200).where("rule is null").collect()}
    assert score(once.unionByName(copies)) == score(once)


def test_features_against_plain_python():
    import math
    from collections import Counter

    urls = ["http://a-b.c1.example.com/x/y/9?a=1&b=2#c=3/?d=", "", "no scheme", "x://h#f/en/?a=1", "http://ü.example/日本/١?q", "http://h" + "/long" * 5000]
    hosts = ["a-b.c1.example.com", "", "", "h", "ü.example", "h"]
    got = url_trees.lexical(pa.array(urls), pa.array(hosts))
    for row, u, h in zip(got, urls, hosts, strict=True):
        n, plain = len(u), u.split("#")[0]
        path = plain.split("?")[0].partition("://")[2].partition("/")
        query = plain.partition("?")[2]
        bits = -sum(v / n * math.log2(v / n) for v in Counter(u).values()) if n else 0
        digits = sum(c.isdecimal() for c in u)
        want = [n, len(h), (path[1] + path[2]).count("/") if "://" in u else plain.split("?")[0].count("/"), h.count("."), digits / max(n, 1), sum(c.isdecimal() for c in h), bits, query.count("="), h.count("-")]
        assert row.tolist() == pytest.approx(want)


def test_rates_of_a_training_row_come_from_other_rows():
    hosts = pa.array([f"h.s{i}.example" for i in range(50)])
    y = np.arange(50) % 2.0
    names, values, prior = url_trees.suffix_rates(hosts, y, smooth=1.0)
    own = dict(zip(names.to_pylist(), values, strict=True))
    assert own["s1.example"] == pytest.approx((1 + prior) / 2) and own["s2.example"] == pytest.approx(prior / 2)
    # each two-label suffix is seen once: out of fold it says nothing
    fold = np.arange(50) % url_trees.FOLDS
    for f in range(url_trees.FOLDS):
        rest = url_trees.suffix_rates(hosts.filter(pa.array(fold != f)), y[fold != f])
        assert (url_trees.rates_of(hosts.filter(pa.array(fold == f)), rest)[:, 1] == rest[2]).all()


def test_verdicts_of_the_query_against_brute_force(spark, small):
    """Rules by plain Python; the other URLs by the model that the same labelled URLs give."""
    rows = {r.page_id: r.url for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url").collect()}
    got = {r.page_id: r for r in queries.op8_url_trees(spark, small).collect()}
    assert set(got) == set(rows)

    def parsed(url):
        head, found, rest = (url or "").partition("://")
        if not found:
            return "", ""
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host) :]
        for c in "?#":
            path = path.split(c)[0]
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path

    ruled = {}
    for i, url in rows.items():
        host, path = parsed(url)
        fits = [(len(r), r, v) for v, r in url_trees.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        ruled[i] = (host, path, *(max(fits)[1:] if fits else (None, None)))
        assert (got[i].host, got[i].path, got[i].rule) == ruled[i][:3]
        assert ruled[i][3] in (None, got[i].verdict)
    labelled = sorted({(rows[i], h, v) for i, (h, _, r, v) in ruled.items() if r})
    order = {r.u: r.h for r in spark.createDataFrame([(u,) for u, *_ in labelled], "u string").select("u", F.xxhash64("u").alias("h")).collect()}
    labelled.sort(key=lambda x: (order[x[0]], x[0]))
    model = url_trees.fit([x[0] for x in labelled], [x[1] for x in labelled], np.array([x[2] == "block" for x in labelled], dtype=float))
    for i, (h, _, r, _) in ruled.items():
        if r is None:
            one = url_trees.score(pa.array([rows[i] or ""]), pa.array([h]), model)[0]
            assert got[i].score == pytest.approx(one) and got[i].verdict == ("block" if one >= 0.5 else "allow")


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(v) for v in rng.normal(size=3 if i % 3 else 5)]) for i in range(1, 200)]
    got = collision_ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5, shard_rows=20).toPandas()
    by = dict(rows)
    for q, g in got.groupby("query_id"):
        same = [(i, v) for i, v in rows if len(v) == len(by[q]) and i != q]
        best = sorted(same, key=lambda x: (-np.dot(x[1], by[q]), x[0]))[:5]
        assert len(set(g.vec_id) & {i for i, _ in best}) >= 4 and all(len(by[i]) == len(by[q]) for i in g.vec_id)
    assert set(got.query_id) == {i for i in range(20, 200, 20)}


def test_pipeline_against_its_parts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, kept, small).cache()
        assert new.columns == docs.columns and new.count() <= kept.count(), name
        kept = new
    rows = kept.collect()
    from tests.llm.test_documents import brute_components, brute_fingerprint, check_packing, measured

    by_id = {r.doc_id: r for r in docs.collect()}
    assert all(measured(by_id[r.doc_id].text)[0] >= 10 for r in rows)
    fps = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    assert all(i == c for i, c in brute_components(fps).items())
    check_packing(kept, corpus_pipeline.run(spark, small), 2048)


def test_pipeline_of_odd_rows(spark, small):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _extra string, lang_pred string"
    text = "The quick brown fox and the lazy dog went over the hill to see what there was. " * 2
    rows = [(1, text, "en", "a", 1, "x", "y"), (1, text, "en", "a", 1, "x", "y"), (2, text + "More of it, and then some.", None, None, None, None, None), (None, text, "en", None, 1, None, None), (3, None, None, None, None, None, None), (4, "", "en", "b", 0, None, None)]
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        kept = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, small)
            assert kept.columns == df.columns
        corpus_pipeline.STAGES[-1][1](spark, kept, small).collect()


def test_near_copies_of_ids_with_several_texts(spark, small):
    words = [f"word{i}" for i in range(3200)]
    a, b, c = (" ".join(words[i : i + 1000]) for i in (0, 1100, 2200))
    rows = [(1, a, "u"), (1, b, "v"), (2, a, "w"), (3, b + " more", "x"), (2, c, "y"), (2, c, "z"), (None, a, "n"), (None, a, "n"), (4, None, "o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [tuple(r) for r in corpus_pipeline.near_copies(spark, docs, small).collect()]
    ids = [r for r in kept if r[0] is not None]
    fps = {t: simhash_bktree.fingerprint((t or "").encode()) for _, t, _ in rows}
    assert (fps[b] ^ fps[b + " more"]).bit_count() <= 2 and min((fps[x] ^ fps[y]).bit_count() for x, y in ((a, b), (a, c), (b, c))) > 2
    assert sorted((i, t) for i, t, _ in ids) == sorted([(1, a), (1, b), (2, c), (4, None)], key=lambda r: (r[0], r[1] or "")) and sum(r[0] is None for r in kept) == 2


def test_every_operator_has_its_query(spark):
    import __spark_entry__

    found = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in found) for i in range(1, 11)) and "pipeline" in found
