"""Embedding whitening, ranked lexical search and adaptive quality rules against plain versions."""
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trailcast.llm import lexical_search, quality_rules, queries, whitening

SF = "/root/testdata/sf0.01"


# ---- whitening ---------------------------------------------------------------------------

def spectrum(d, values, seed=3):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q @ np.diag(np.array(values, float)) @ q.T


@pytest.mark.parametrize("d, values", [(1, [2]), (2, [0, 0]), (3, [1, 2, 3]), (5, [3, 3, 3, 1, 1]), (40, [10.0 ** -k for k in range(40)]),
                                       (64, list(1 + np.arange(64) / 1000)), (30, [5, 4, 3, 2] + [0] * 26), (6, [-2, -1, 0, 0, 1, 2])])
def test_components_equal_eigenvectors(d, values):
    v = spectrum(d, values)
    v = (v + v.T) / 2
    e, q = whitening.components(v, 8)
    true = np.sort(values)[::-1][:8]
    top = max(1.0, np.abs(values).max())
    assert np.abs(e - true).max() <= 1e-13 * top
    assert np.abs(v @ q - q * e).max() <= 1e-13 * top and np.abs(q.T @ q - np.eye(q.shape[1])).max() <= 1e-13
    assert (q[np.argmax(np.abs(q), 0), np.arange(q.shape[1])] > 0).all()


def test_polar_factor():
    a = spectrum(20, [10.0 ** -k * (-1) ** k for k in range(12)] + [1e-13] * 8)
    u = whitening.polar((a + a.T) / 2)
    assert np.abs(u @ u.T - np.eye(20)).max() < 1e-12 and (np.linalg.eigvalsh(u @ a) > -1e-14).all()


def plain_whitening(rows, dim):
    keep = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == dim and None not in v and np.isfinite(np.array(v, float)).all()]
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v in keep], object)
    n, s = len(x), x.sum(0)
    centred = np.array(x - s / n, float)
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:8], q[:, ::-1][:, :8]
    return keep, n, ((n * x - s) ** 2).sum(1), centred @ q / np.sqrt(e), e / np.trace(v)


def test_whitening_against_eigh(spark):
    rng = np.random.default_rng(5)
    x = np.float32(rng.standard_normal((300, 12)) @ np.diag(np.arange(1, 13)))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(7, [float(c) for c in x[7]])]
    rows += [(900, None), (901, []), (902, [None] + [0.0] * 11), (903, [float("nan")] + [0.0] * 11), (904, [float("inf")] * 12), (905, [1.0] * 11), (None, [0.5] * 12)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, component string").repartition(5)
    got = whitening.whiten(df, whitening.fit(df)).toPandas().sort_values(["component", "vec_id", "whitened"])
    keep, n, deviation, z, explained = plain_whitening(rows, 12)
    assert len(got) == 8 * len(keep) and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    ids = [-1 if i is None else i for i, _ in keep]
    for k in range(8):
        part = got[got.component == k + 1]
        want = sorted(zip(ids, deviation, z[:, k]))
        other = sorted(zip(ids, deviation, -z[:, k]))
        mine = sorted(zip(part.vec_id.fillna(-1).astype(int), part.deviation.astype(int), part.whitened))
        assert [m[:2] for m in mine] == [w[:2] for w in want]
        near = lambda a: np.abs(np.array([m[2] for m in mine]) - np.array([w[2] for w in a])).max() < 1e-8
        assert near(want) or near(other)
        assert np.allclose(part.explained, explained[k], rtol=1e-9)


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        df = spark.createDataFrame(rows, schema)
        assert whitening.whiten(df, whitening.fit(df)).count() == 0
    df = spark.createDataFrame([(1, [1.0, 2.0, 5.0]), (2, [2.0, 2.0, 5.0]), (3, [4.0, 2.0, 5.0])], schema)     # one column varies
    got = whitening.whiten(df, whitening.fit(df)).collect()
    assert len(got) == 3 and abs(sum(r.whitened ** 2 for r in got) / 3 - 1) < 1e-12 and all(abs(r.explained - 1) < 1e-12 for r in got)
    with pytest.raises(Exception, match="beyond 2"):
        whitening.fit(spark.createDataFrame([(1, [1e300, 2.0])], schema))


def test_exact_products_of_large_integers():
    y = np.random.default_rng(0).integers(-(1 << 27), 1 << 27, (50, 3))
    assert (whitening._product(y) == np.array(y.astype(object).T @ y.astype(object), np.int64)).all()
    small = y >> 8
    assert (whitening._product(small) == small.T @ small).all()
    with pytest.raises(ArithmeticError):
        whitening._product(y << 3)


# ---- ranked lexical search ---------------------------------------------------------------

def plain_terms(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(table))


def plain_search(docs, items, k=20):
    bags = [(i, plain_terms(t)) for i, t in docs]
    bags = [(i, Counter(b), len(b)) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for doc, bag, n in bags:
            m = 75 + (25 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in plain_terms(text) if t in bag)
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, place + 1, None if none else doc, -score) for place, (score, none, doc) in enumerate(sorted(scored)[:k])]
    return Counter(out)


@pytest.mark.parametrize("group_bytes, k", [(1 << 22, 20), (40, 3)])
def test_search_against_plain_version(spark, group_bytes, k):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)] + ["Ünï", "a1", "ÉX", "b"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ".", "-", "@"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 30))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(200)] + [(None, docs[5][1]), (5, docs[5][1]), (2000, None), (2001, ""), (2002, "[]"), (None, "w1 w2"), (2003, " ".join(["w3", "other"] * 3000))]
    items = [(i, text(rng.randint(1, 12))) for i in range(20)] + [(3, "w1 w1 w2"), (None, docs[5][1]), (40, None), (41, ""), (42, "unseen words"), (43, "!")]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, score int").repartition(6)
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, rank string")
    got = Counter(tuple(r) for r in lexical_search.search(d, i, k, group_bytes=group_bytes).collect())
    assert got == plain_search(docs, items, k)


def test_search_exact_sums_and_collisions():
    value = np.array([(1 << 60) - 1, (1 << 60) + 1, 3], np.int64)
    assert lexical_search._sums(np.array([0, 0, 1]), value, 2, 1 << 62).tolist() == [1 << 61, 3]
    items = lexical_search.Items(["a b c"])
    at = int(np.argsort(items.h1)[1])
    h1, h2 = items.h1.copy(), items.h2.copy()
    assert items.find(h1, h2).tolist() == [0, 1, 2]
    assert items.find(h1[at:at + 1], h2[at:at + 1] + np.uint64(1)).tolist() == [-1]         # one hash alone is no match
    items.h1[:] = items.h1[0]                              # all words in one hash: the other one decides
    items.h2 = np.sort(items.h2)
    assert items.find(items.h1, items.h2).tolist() == [0, 1, 2]


def test_search_copies_are_cut_before_the_shuffle(spark):
    rows = spark.range(100).selectExpr("id as doc", "id % 7 as n", "array(cast(id % 3 as int)) as terms", "array(cast(id % 2 as int)) as counts")
    plan = lexical_search.classes(rows, 100, 200, 20)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"WindowGroupLimit[^\n]*Partial", plan), plan
    assert plan.count("Exchange") == 1


# ---- quality rules -----------------------------------------------------------------------

def duck_rules(rows):
    con = duckdb.connect()
    con.register("frame", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"}))
    con.execute("CREATE TABLE documents AS SELECT doc_id, text::VARCHAR AS text, lang::VARCHAR AS lang, source::VARCHAR AS source FROM frame")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return Counter(con.execute(f"SELECT {', '.join(names)} FROM ({quality_rules.oracle_sql()})").fetchall()), names


def rule_rows(long_words=1000):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghé") for _ in range(n))
    rows = []
    for i in range(400):
        group = rng.choice([("en", "a"), ("en", "b"), ("de", "c"), (None, "a"), ("en", None), ("fr", "rare") if i < 12 else ("en", "a")])
        n = rng.randint(40, 120)
        words = [word(rng.randint(2, 9) if group[1] != "b" else rng.randint(8, 14)) for _ in range(n)]
        if i % 17 == 0:
            words = [word(25) for _ in range(n)]
        if i % 19 == 0:
            words = [w + "##$" for w in words]
        if i % 13 == 0:
            words[20:40] = words[:20]
        lines = [" ".join(words[k:k + 8]) for k in range(0, n, 8)]
        if i % 11 == 0:
            lines += lines[:5] * 3
        rows.append((i, rng.choice(["\n", "\r\n", " \x0b\n\n"]).join(lines), *group))
    return rows + [(500, None, "en", "a"), (501, "", "en", "a"), (502, " \n\t", None, None), (None, "a b", "en", "a"), (503, "a a a a", "en", "b"), (504, "x y z x y z", "xx", "yy"), rows[0],
                   (505, " ".join(word(5) for _ in range(long_words)), "en", "a"), (506, "w " * long_words, "en", "a"), (507, " x y" * 60, "de", "c")]


def test_rules_against_sql(spark):
    rows = rule_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, kept string").repartition(7)
    want, names = duck_rules(rows)
    got = quality_rules.rules(df)
    assert Counter(tuple(r) for r in got.select(names).collect()) == want
    failed = Counter(x for r in got.collect() for x in r.failed)
    assert all(failed[m] for m in ("word_length", "symbols")) and got.where("kept").count() > 250


def test_rules_over_long_texts(spark):
    """Texts of 6 MB and of a million words."""
    rng = random.Random(1)
    rows = [(1, " ".join("%x" % rng.getrandbits(20) for _ in range(1_000_000)), "en", "a"), (2, "\n".join(f"line {i % 1000} of them" for i in range(300_000)), "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert Counter(tuple(r) for r in quality_rules.rules(df).select(names).collect()) == duck_rules(rows)[0]


def test_sketches_merge(spark):
    """Sketches of parts, added up, are the sketch of the whole, and so are their thresholds."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    keep = quality_rules._keep(docs, "doc_id", "lang", "source")
    rows = spark.createDataFrame(quality_rules.facts(docs, keep).toPandas())
    whole = quality_rules.sketch(rows)
    parts = [quality_rules.sketch(rows.where(F.col("doc_id") % 3 == k)) for k in range(3)]
    merged = quality_rules.merge(parts[0].unionByName(parts[1]).unionByName(parts[2]), "lang", "source")
    as_set = lambda df: Counter(tuple(r) for r in df.select("lang", "source", "measure", "bin", "n").collect())
    assert as_set(merged) == as_set(whole)
    limits = lambda df: sorted(map(str, quality_rules.thresholds(df).collect()))
    assert limits(merged) == limits(whole)
    known = quality_rules.rules(docs.where("doc_id % 2 = 0"), known=whole.unionByName(whole))
    assert known.count() == docs.where("doc_id % 2 = 0").count()


def test_sketch_quartiles_are_within_a_bin(spark):
    values = [int(x) for x in np.random.default_rng(2).lognormal(8, 2, 4000)] + [0, 1, 255, 256, 257]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality_rules.bin_of(F.col("v")).alias("bin"))
    for v, low, b in df.select("v", quality_rules.low_edge(F.col("bin")), "bin").collect():
        assert low <= v <= low + low // 128 + (0 if v < 256 else 1)
    sketch = df.groupBy(F.lit("symbols").alias("measure"), "bin").agg(F.count("*").alias("n"))
    r = quality_rules.fences(sketch).collect()[0]
    q1, q3 = (sorted(values)[math.ceil(len(values) * k / 4) - 1] for k in (1, 3))
    assert abs((r.high + r.low) / 2 - (q1 + q3) / 2) <= (q1 + q3) / 128 and r.docs == len(values)


def test_native_plan(spark):
    plan = queries.op13_quality_rules(spark, SF)._jdf.queryExecution().executedPlan().toString()
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    plan += quality_rules.facts(rows, quality_rules._keep(rows, "doc_id", "lang", "source"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
