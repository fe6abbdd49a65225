"""Operators on documents: odd input, and brute-force versions on small tables."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import language_mixture, line_winnowing, packing, quality_ledger, simhash_bktree, token_count, unigram_pieces
from graphloom.llm.queries import PIECES, WORDS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start string, ids string"
WORDS_FILE, PIECES_FILE = public_tokenizers.path(WORDS), public_tokenizers.path(PIECES)
ODD = [
    None,
    "",
    "   \n\t ",
    "one",
    "one two",
    "Don't stop: it's 1234 ÉTÉ œuvre ﬁ Å \x00 🙂 a\xa0b\x1cc",
    "<|endoftext|> and <|ENDOFTEXT|>",
    "x " * 6000,
    "x" * 3000,
    "<0x0A> <s> ▁ a▁b  c",
    "the same line\n" * 30,
]


def frame(spark, texts, langs=None):
    rows = [(i, t, (langs or ["en"] * len(texts))[i], f"src{i % 3}" if i % 4 else None, 0, "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    docs = frame(spark, ODD)
    twice = docs.where("doc_id = 5")
    no_id = spark.createDataFrame([(None, "no id here", None, None, None, None, None)], SCHEMA)
    return docs.unionByName(twice).unionByName(no_id)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# -- tokens


def test_counts_are_the_library_s(odd):
    lib = Tokenizer.from_file(WORDS_FILE)
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.count(odd, WORDS_FILE).collect()}
    rows = odd.select("doc_id", "text").collect()
    want = set()
    for r in rows:
        n = len(lib.encode(r.text or "", add_special_tokens=False).ids)
        want.add((r.doc_id, len((r.text or "").encode()), n, n > 2048))
    assert got == want
    assert token_count.count(odd, WORDS_FILE).count() == len(rows)


def test_counts_on_real_documents(spark, small):
    lib = Tokenizer.from_file(WORDS_FILE)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_count.count(docs, WORDS_FILE).collect()}
    assert got == {r.doc_id: len(lib.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}


def test_other_vocabularies_go_through_the_library(odd):
    for name in ("byte_bpe_50k.json", PIECES):
        tool = token_count.counter(public_tokenizers.path(name))
        got = [len(x) // 4 for x in tool.ids([t.encode() if t else None for t in ODD])]
        assert got == [len(tool.whole(t)) if t else 0 for t in ODD]


def test_proven_strings_encode_alone(odd):
    tool = token_count.counter(WORDS_FILE)
    assert len(tool.proven) > 30_000
    for text in list(tool.proven)[::997]:
        assert [int(np.frombuffer(tool.proven[text], "<u4")[0])] == tool.whole(text)


def test_count_of_no_rows(none):
    assert token_count.count(none, WORDS_FILE).count() == 0


# -- packing


def check_packing(docs, pieces, size):
    lib = Tokenizer.from_file(WORDS_FILE)
    want = sorted(((r.doc_id if r.doc_id is not None else -1), tuple(lib.encode(r.text or "", add_special_tokens=False).ids) + (1,)) for r in docs.select("doc_id", "text").collect())
    got = pieces.collect()
    by_seq = {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for s, rows in by_seq.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == size or s == max(by_seq)
    assert sum(r.length for r in got) == sum(len(x) for _, x in want)
    ids = {}
    for d, x in want:
        ids.setdefault(d, x)
    for r in got:
        d = r.doc_id if r.doc_id is not None else -1
        assert r.doc_tokens == len(ids[d])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[d][r.start : r.start + r.length], dtype="<u4").tobytes())


def test_packing_of_odd_documents(odd):
    for size in (64, 2048):
        check_packing(odd, packing.pack(odd, WORDS_FILE, size), size)


def test_packing_keeps_the_mixture(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    pieces = packing.pack(docs, WORDS_FILE, 512).cache()
    check_packing(docs, pieces, 512)
    p = pieces.toPandas()
    share = p.pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum").fillna(0).iloc[:-1]
    target = p.groupby("source").length.sum() / p.length.sum() * 512
    assert (share - target).abs().max().max() < 4


def test_packing_with_weights():
    plan = packing.phases([100, 300, 50], [1.0, 1.0, 2.0])
    assert [sum(x) for x in zip(*plan, strict=True)] == [100, 300, 50]
    given = packing.served(np.arange(0, 451), plan)
    assert (given.sum(axis=0) == np.arange(451)).all() and (np.diff(given) >= 0).all()
    assert abs(given[2, 80] - 40) <= 2 and abs(given[0, 80] - 20) <= 2


def test_served_stays_exact_for_huge_corpora():
    totals = [10**14, 3, 7 * 10**12]
    x = np.array([0, 2048, 10**13, sum(totals)], dtype=np.int64)
    given = packing.served(x, packing.phases(totals))
    assert [int(v) for v in given.sum(axis=0)] == x.tolist() and [int(v) for v in given[:, -1]] == totals


def test_packing_of_many_sources(spark):
    rows = [(i, f"word {i} and some more words", None, f"host{i}.example", 0, None, None) for i in range(1500)]
    rows += [(2000 + i, "hot words " * 100, None, "hot", 0, None, None) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    names = {r[0]: r[3] for r in rows}
    for weights in (None, {"hot": 3.0, "host7.example": 1.0, "absent": 5.0}):
        pieces = packing.pack(docs, WORDS_FILE, 512, weights).cache()
        check_packing(docs, pieces, 512)
        p = pieces.toPandas()
        assert (p.source == p.doc_id.map(names)).all()
        share = p[p.source == "hot"].groupby("sequence_id").length.sum()
        if weights is None:
            share = share.reindex(range(p.sequence_id.max()), fill_value=0)
            assert (share - 512 * p[p.source == "hot"].length.sum() / p.length.sum()).abs().max() < 12
        else:  # the weighted sources first: the small one a quarter until it ends
            small = p[p.source == "host7.example"]
            assert share.loc[1] == 512 and small.sequence_id.max() == 0 and abs((small.offset + small.length).max() - small.length.sum()) < 512


def test_shares_are_exact_and_their_look_up_finds_each_token():
    rng = np.random.default_rng(2)
    totals = rng.integers(1, 50, 37)
    plan = packing.Plan([(np.arange(0, 37, 2), totals[::2]), (np.arange(1, 37, 2), totals[1::2])])
    x = np.arange(plan.total + 1)
    got = [plan.at(np.full(len(x), s), x) for s in range(37)]
    mine = np.stack([g[0] for g in got])
    assert (mine.sum(axis=0) == x).all() and (np.diff(mine) >= 0).all() and (mine[:, -1] == totals).all()
    assert (np.stack([g[1] for g in got]) == np.cumsum(mine, axis=0) - mine).all()
    big = rng.integers(1, 2**60, 500)
    part = rng.integers(0, 2**60, 500) % (big + 1)
    much = rng.integers(0, 2**60, 500) % (big + 1)
    assert packing._share(much, part, big).tolist() == [int(a) * int(b) // int(c) for a, b, c in zip(much, part, big, strict=True)]


def test_packing_of_no_rows(none):
    assert packing.pack(none, WORDS_FILE).count() == 0


# -- quality


def measured(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    grams = {}
    for i in range(len(w) - 4):
        grams.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {i + o for at in grams.values() if len(at) > 1 for i in at for o in range(5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(covered))


def test_measurements_against_brute_force(spark, odd, small):
    more = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    docs = odd.select("doc_id", "text").unionByName(more)
    for r in quality_ledger.ledger(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) == measured(r.text)
        assert bool(r.fail_bits & 1) == (r.n_words < 10)


def test_ledger_keeps_other_columns_and_no_rows(odd, none):
    assert quality_ledger.ledger(odd).columns[: len(odd.columns)] == odd.columns
    assert quality_ledger.ledger(none).count() == 0 and quality_ledger.ablation(quality_ledger.ledger(none)).count() == 0


def test_ablation_counts(odd):
    led = quality_ledger.ledger(odd).cache()
    bits = [r.fail_bits for r in led.collect()]
    for r in quality_ledger.ablation(led).collect():
        mask = quality_ledger.POLICIES[r.policy]
        bit = next(1 << b for b, (n, _) in quality_ledger.RULES.items() if n == r.rule)
        assert r.failing == sum(b & bit != 0 for b in bits) and r.only_this == sum(b & mask == bit for b in bits)
        assert r.kept == sum(b & mask == 0 for b in bits) and r.kept_without == sum(b & mask & ~bit == 0 for b in bits)


def test_length_alone_does_not_reject(spark):
    bits = spark.createDataFrame([(64,), (65,), (0,)], "fail_bits int")
    assert [r.fail_bits for r in bits.where(quality_ledger.passes()).collect()] == [64, 0]


def test_quality_runs_without_python(odd):
    plan = quality_ledger.ledger(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- language


def test_languages_of_held_out_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    said = language_mixture.predict(docs, language_mixture.train(docs, ~held)).where(held)
    good, n = said.select(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 20 and good / n > 0.95


def test_only_labelled_rows_are_learnt(spark):
    de, fr = "der schnelle braune fuchs springt über den faulen hund und schläft", "le renard brun saute par dessus le chien paresseux puis il dort"
    rows = [(1, fr, "fr"), (2, de, "de"), (3, de + " heute", "de")]
    same = lambda a, b: a[0] == b[0] and (a[1] == b[1]).all()
    model = lambda r: language_mixture.train(spark.createDataFrame(r, "doc_id long, text string, lang string"))
    want = model(rows)
    assert want[0] == ["de", "fr"]
    assert same(want, model([*rows, (2, "qqqq wwww zzzz", None), (None, "qqqq", "de"), (4, None, "de")]))  # no label, key or text
    assert same(want, model([*rows, *rows[:1] * 50]))  # copies
    both = [*rows, (2, de, "fr")]  # one key, two labels: each row teaches its own
    assert same(model(both), model(both[::-1])) and not same(model(both), want)


def test_more_labels_than_languages(spark, monkeypatch):
    monkeypatch.setattr(language_mixture, "LANGUAGES", 2)
    rows = [(i, f"some words of text {i}", lang) for i, lang in enumerate(["b", "a", "c", "c", "a", "c"])]
    assert language_mixture.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))[0] == ["a", "c"]


def test_language_sets_against_all_subsets():
    """The set that infer() chooses has the best penalised likelihood of all subsets, by brute force."""
    from itertools import combinations

    rng = np.random.default_rng(7)
    p = rng.dirichlet(np.ones(60) * 0.2, size=3).T + 1e-6
    logp = np.full((language_mixture.BUCKETS, 3), -20.0)
    logp[:60] = np.log(p / p.sum(axis=0))
    for mix in ((1, 0, 0), (0.6, 0.4, 0), (0.4, 0.3, 0.3), (0, 0.9, 0.1)):
        counts = [int(400 * m) for m in mix]
        bucket = np.concatenate([rng.choice(60, c, p=p[:, i] / p[:, i].sum()) for i, c in enumerate(counts)])
        got = language_mixture.infer(np.zeros(len(bucket), dtype=np.int64), bucket, 1, logp, steps=500)[0]
        value = {}
        for k in (1, 2, 3):
            for some in combinations(range(3), k):
                pi = np.full(k, 1 / k)
                e = np.exp(logp[bucket][:, some])
                for _ in range(2000):
                    r = e * pi
                    pi = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
                value[some] = np.log(e @ pi).sum() - (k - 1) * 0.5 * np.log(len(bucket))
        assert tuple(np.flatnonzero(got > 0)) == max(value, key=value.get)


def test_languages_of_odd_texts(odd, none):
    model = language_mixture.train(odd.where("text is not null"))
    rows = language_mixture.predict(odd, model).collect()
    assert len(rows) == odd.count()
    for r in rows:
        text = ODD[r.doc_id] if r.doc_id is not None else "no id here"
        letters = any(c.isalpha() for c in text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    assert language_mixture.predict(none, model).count() == 0
    assert {r.lang_pred for r in language_mixture.predict(odd, language_mixture.train(none)).collect()} == {"und"}


def test_mixtures_are_found(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language_mixture.train(docs)
    by = {r.lang: r.text for r in docs.where("length(text) > 1500").select("lang", "text").collect()}
    mixed = by["de"][:1500] + " " + by["fr"][:500]
    out = language_mixture.predict(frame(spark, [mixed, by["es"]]), model).orderBy("doc_id").collect()
    assert set(out[0].languages) == {"de", "fr"} and out[0].lang_pred == "de" and 0.6 < out[0].score < 0.9
    assert out[1].languages == ["es"] and out[1].score == 1.0


def test_documents_of_several_languages_stay(spark, small, none):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language_mixture.train(docs)
    by = {r.lang: r.text for r in docs.where("length(text) > 1500").select("lang", "text").collect()}
    mixed = frame(spark, [" ".join(by[x][:1500] for x in ("de", "fr", "es")), "123 456"])
    assert language_mixture.predict(mixed, model).where("doc_id = 0").first().score < 0.5
    assert [r.doc_id for r in language_mixture.keep_determined(mixed, model).collect()] == [0]
    assert language_mixture.keep_determined(mixed, language_mixture.train(none)).count() == 2


def test_proportions_maximise_likelihood():
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.ones(40) * 0.3, size=2).T + 1e-6
    logp = np.full((language_mixture.BUCKETS, 2), -20.0)
    logp[:40] = np.log(p / p.sum(axis=0))
    bucket = np.r_[rng.choice(40, 700, p=p[:, 0] / p[:, 0].sum()), rng.choice(40, 300, p=p[:, 1] / p[:, 1].sum())]
    got = language_mixture.infer(np.zeros(1000, dtype=np.int64), bucket, 1, logp, steps=200)[0, 0]
    grid = np.linspace(0.001, 0.999, 999)
    best = grid[np.argmax([np.log(np.exp(logp[bucket]) @ [g, 1 - g]).sum() for g in grid])]
    assert abs(got - best) < 0.02


# -- near copies


def brute_components(fps):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_copies_against_brute_force(spark, odd, small):
    more = spark.read.parquet(f"{small}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text")
    docs = odd.where("doc_id is not null").select("doc_id", "text").unionByName(more)
    got = simhash_bktree.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = brute_components(fps)
    for r in got:
        assert int(r.fingerprint, 16) == fps[r.doc_id] and len(r.fingerprint) == 16
        assert r.component_id == want[r.doc_id]


def test_near_copies_of_no_rows_and_no_ids(none, odd):
    assert simhash_bktree.near_duplicates(none).count() == 0
    assert [r.component_id for r in simhash_bktree.near_duplicates(odd.where("doc_id is null")).collect()] == [None]


def test_long_chains_of_links(spark):
    # a chain of values, each two bits from the next, and copies of some
    values, v = [], 0x0123456789ABCDEF
    rng = np.random.default_rng(3)
    for _ in range(300):
        values.append(v)
        a, b = rng.choice(64, 2, replace=False)
        v ^= (1 << int(a)) | (1 << int(b))
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in values]
    edges = simhash_bktree.links(spark.createDataFrame([(x,) for x in sorted(set(signed))], "fp long"))
    roots = simhash_bktree.components(edges)
    assert roots.select("root").distinct().count() == 1 and roots.count() == len(set(signed)) - 1


def test_bk_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    values = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for c in centres]))
    rng.shuffle(values)
    tree = simhash_bktree.BKTree(values)
    got = {(int(a), int(b)) for x, y in tree.search(values, 2) for a, b in zip(x, y, strict=True)}
    want = {(i, j) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 2)}
    assert got == want


# -- lines


def bare_lines(text):
    cut = re.split(r"(?<=\n)|(?<=[.!?] )", text or "")
    return [x for x in (y.strip(" \t\n\x0b\f\r").lower() for y in cut) if x]


def test_later_runs_go_and_first_ones_stay(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    out = {r.doc_id: r.text for r in line_winnowing.dedup_lines(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    seen = set()
    every = set()
    for d in sorted(out):
        lines = bare_lines(out[d])
        every |= set(lines)
        for i in range(len(lines)):
            n, k = 0, i
            while k < len(lines) and n < line_winnowing.MIN_CHARS:
                n, k = n + len(lines[k]), k + 1
            if n >= line_winnowing.MIN_CHARS:
                run = tuple(lines[i:k])
                assert run not in seen
                seen.add(run)
    # nothing is lost: each line is still somewhere
    assert {x for t in texts.values() for x in bare_lines(t)} == every


def test_passages_inside_lines_are_found(spark):
    passage = " ".join(f"Sentence number {i} of the passage that is pasted around here." for i in range(12))
    docs = frame(spark, [f"Alpha beta gamma. {passage} Delta.", f"Something else, and then {passage} and on it goes.", "Clean text. It stays as it is.\n\nAll of it."])
    out = {r.doc_id: r for r in line_winnowing.dedup_lines(docs).collect()}
    assert out[0].text.count("passage that is pasted") == 12 and out[0].removed_lines == 0
    assert out[1].text.count("passage that is pasted") <= 2 and out[1].text.startswith("Something else")
    assert out[2].text == "Clean text. It stays as it is.\n\nAll of it."
    assert line_winnowing.dedup_lines(docs).columns == [*docs.columns, "removed_lines", "removed_chars"]


def test_lines_of_odd_documents(odd, none):
    got = line_winnowing.dedup_lines(odd)
    assert got.count() == odd.count() and line_winnowing.dedup_lines(none).count() == 0
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[0].text is None and rows[1].text == ""
    assert rows[10].removed_lines > 0 and rows[10].text.startswith("the same line\n")
    whole = "A long line that is repeated word by word in two documents of this very small corpus, to be sure that its second place is cut out as a whole and that nothing else is."
    assert line_winnowing.MIN_CHARS <= len(whole)


def test_lines_run_without_python(odd):
    plan = line_winnowing.select(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_runs(texts, min_chars):
    """Lines (with content) of each text that are in a run of min_chars or more with an earlier place, by comparing all pairs."""
    lines = [bare_lines(t) for t in texts]
    gone = [set() for _ in texts]
    for p, mine in enumerate(lines):
        for q in range(p + 1):
            other = lines[q]
            for shift in range(1 - len(other), len(mine)) if q < p else range(1, len(mine)):
                run = []
                for i in range(len(mine) + 1):
                    if i < len(mine) and 0 <= i - shift < len(other) and mine[i] == other[i - shift]:
                        run.append(i)
                    else:
                        if sum(len(mine[j]) for j in run) >= min_chars:
                            gone[p].update(run)
                        run = []
    return [[x for i, x in enumerate(l) if i not in g] for l, g in zip(lines, gone, strict=True)]


def test_earlier_quotes_do_not_hide_a_run(spark):
    passage = [f"Here is sentence {i} of a passage, about so long. " for i in range(10)]
    assert all(len(a) + len(b) < line_winnowing.MIN_CHARS for a, b in zip(passage, passage[1:], strict=False))
    # in four surroundings each
    quotes = [f"Quote {i} of {k} begins. {passage[i]}{passage[i + 1]}And quote {i} of {k} is over." for i in range(9) for k in range(4)]
    docs = frame(spark, [*quotes, "First place. " + "".join(passage) + "Its end.", "Later place. " + "".join(passage) + "Other end."])
    out = {r.doc_id: r for r in line_winnowing.dedup_lines(docs).collect()}
    assert all(out[i].removed_lines == 0 for i in range(37))
    assert out[37].removed_lines == 10 and out[37].text == "Later place. Other end."


def test_runs_by_text_ids_with_ties_and_repeated_rows(spark):
    long_ = "A line that is long enough to be a run of its own, since it has more than one hundred and fifty characters, all of which are in this one single line of text"
    assert len(long_) >= line_winnowing.MIN_CHARS
    rows = [("b", f"{long_}\nafter b"), ("b", f"{long_}\nafter b"), ("b", f"{long_}\nother b"), ("a", f"before a\n{long_}"), (None, long_), (None, long_), ("c", None), ("d", "")]
    got = [(r.id, r.body, r.removed_lines) for r in line_winnowing.dedup_lines(spark.createDataFrame(rows, "id string, body string"), "id", "body").collect()]
    assert sorted(got, key=repr) == sorted([("b", "after b", 1), ("b", "after b", 1), ("b", "other b", 1), ("a", f"before a\n{long_}", 0), (None, "", 1), (None, "", 1), ("c", None, 0), ("d", "", 0)], key=repr)
    marked = [(1, f"x\x01 y. {long_}\nend"), (2, f"z. {long_}\nEnd \x01")]
    cut = {r.doc_id: r.text for r in line_winnowing.dedup_lines(spark.createDataFrame(marked, "doc_id long, text string")).collect()}
    assert cut == {1: marked[0][1], 2: "z. End \x01"}


def test_runs_against_brute_force(spark):
    rng = np.random.default_rng(11)
    stock = [f"{'abcdefghijklmnopqrstuvwxyz'[int(i) % 26] * int(n)}{i}.\n" for i, n in enumerate(rng.choice([1, 1, 8, 30, 60, 90, 170], 30))]
    for size in (12, 30):
        texts = ["".join(stock[int(i)] for i in rng.integers(0, size // 3, rng.integers(1, 40))) for _ in range(12)]
        # pieces of earlier texts, so that runs have several partners
        texts += ["".join(re.split(r"(?<=\n)", texts[int(p)])[int(a) : int(a) + 8] * 2) for p, a in zip(rng.integers(0, 12, 12), rng.integers(0, 20, 12), strict=True)]
        want = brute_runs(texts, line_winnowing.MIN_CHARS)
        got = {r.doc_id: r.text for r in line_winnowing.dedup_lines(frame(spark, texts)).collect()}
        assert [bare_lines(got[i]) for i in range(len(texts))] == want


# -- pieces


def brute_viterbi(model, text):
    """Best score of any split, by bytes of unknown characters."""
    ids = {}
    best = [0.0] + [-np.inf] * len(text)
    for i in range(len(text)):
        single = False
        for j in range(i + 1, min(len(text), i + 48) + 1):
            p = text[i:j]
            if p not in ids:
                ids[p] = model.get(p)
            if ids[p] is not None:
                single |= j == i + 1
                best[j] = max(best[j], best[i] + ids[p])
        if not single:
            best[i + 1] = max(best[i + 1], best[i] - model[None])
    return best[-1]


def test_pieces_round_trip_and_best_score(spark, odd, none):
    model = unigram_pieces.pieces(PIECES_FILE)
    for r in unigram_pieces.round_trip(odd, PIECES_FILE).collect():
        assert r.round_trip
    coded = unigram_pieces.encode(odd, PIECES_FILE)
    back = unigram_pieces.decode(coded, PIECES_FILE)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, odd.select("doc_id", "text").collect()))
    assert unigram_pieces.round_trip(none, PIECES_FILE).count() == 0
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=PIECES_FILE)
    scores = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    scores[None] = -model.floor
    for text in ("the quick brown fox", "Überraschung ist nicht naïve", "a🙂b 日本 xyzzy", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa"):
        ids = np.frombuffer(next(model.encode([text])), "<u4")
        marked = "▁" + text.replace(" ", "▁")
        got = sum(model.score[i] for i in ids if not model.first_byte[i])
        chars = sum(c not in scores for c in marked)
        want = brute_viterbi(scores, marked)
        assert got + chars * model.floor == pytest.approx(want, rel=1e-12)


def test_digest_of_ids_is_stable(spark):
    a = unigram_pieces.round_trip(frame(spark, ["Hello world", "x"]), PIECES_FILE).orderBy("doc_id").collect()
    ids = next(unigram_pieces.pieces(PIECES_FILE).encode(["Hello world"]))
    assert a[0].ids_crc32 == zlib.crc32(ids) and a[0].n_pieces == len(ids) // 4
    assert hashlib.sha256(unigram_pieces.pieces(PIECES_FILE).decode(ids)).hexdigest() == hashlib.sha256(b"Hello world").hexdigest()
