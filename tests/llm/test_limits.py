"""Work that grows with a text's size, boundaries, and scores against the models behind them."""
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailcast.llm import embeddings, queries, secret_scan, suffix_dedup, toxicity
from trailcast.llm.scratch import Scratch

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def forest(spark):
    return secret_scan.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_many_candidates_in_one_text(spark, forest):
    """100,000 candidates in one text: scanned and redacted in linear time, right at every place."""
    rng = random.Random(2)
    words, spans, at = [], [], 0
    for i in range(100_000):
        kind = i % 3
        value = "%032x" % rng.getrandbits(128)
        head = ("commit ", "password=", "x ")[kind]
        words.append(head + value)
        spans.append((at + len(head), len(value), kind))
        at += len(words[-1]) + 1
    text = " ".join(words)
    docs = spark.createDataFrame([(1, text, "src/app.conf")], "doc_id long, text string, source string")
    begin = time.time()
    rows = secret_scan.scan(docs, forest).select("start", "length", "secret").collect()
    assert sorted((r.start, r.length) for r in rows) == [s[:2] for s in spans]
    marked = {r.start for r in rows if r.secret}
    assert {s[0] for s in spans if s[2] == 1} <= marked and not any(s[0] in marked for s in spans if s[2] == 0)
    want, last = [], 0
    for start, size, _ in spans:
        want += [text[last:start], "[SECRET]" if start in marked else text[start:start + size]]
        last = start + size
    assert secret_scan.redact(docs, forest).collect()[0].text == "".join(want) + text[last:]
    assert time.time() - begin < 120


def test_forest_as_sql_equals_the_model(spark):
    """The SQL expression gives the share of the model's trees that predict a secret."""
    scratch = Scratch(spark, "secrets-test")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labelled = secret_scan.labelled_findings(docs, scratch).unionByName(secret_scan.example_rows(spark))
    model, rows = secret_scan.train_model(labelled, scratch)
    forest = secret_scan.forest_of(model)
    got = rows.select(*secret_scan.FEATURES, "features", forest.score([F.col(n) for n in secret_scan.FEATURES]).alias("score")).collect()
    assert len(got) > 300
    for r in got:
        assert abs(r.score - np.mean([t.predict(r.features) for t in model.trees])) < 1e-9


def test_doubtful_findings_teach_nothing(spark):
    texts = ['"password": "a1b2c3d4e5f6"', "AIzaSyA1234567890abcdefghij x", "glpat-abcdEFGH12345678", "commit 0123456789abcdef0123", "client_secret_x=0000111122223333", "api_key=abc123abc123abc1"]
    docs = spark.createDataFrame([(i + 1, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, source string").where(f"crc32(cast(doc_id as string)) % 5 <> 0")
    held = {i + 1 for i in range(len(texts))} - {r.doc_id for r in docs.collect()}
    got = {r.candidate: r.label for r in secret_scan.labelled_findings(docs, Scratch(spark, "doubtful")).collect()}
    want = {"a1b2c3d4e5f6": (1, 1), "0123456789abcdef0123": (4, 0), "abc123abc123abc1": (6, 1)}
    assert got == {v: label for v, (i, label) in want.items() if i not in held}


def test_exceptions_in_linear_time():
    lexicon = toxicity.learn([], [], [])
    folded = toxicity.fold("trash can idiot you trash " * 40_000)
    lexicon.word_weights(toxicity.fold("x"))
    begin = time.time()
    found = lexicon.word_weights(folded)
    assert time.time() - begin < 2
    assert len(found) == 80_000


def test_word_weights_against_a_plain_scan():
    rng = random.Random(3)
    words = ["trash", "can", "idiot", "idiots", "you", "stupid", "simple", "moron", "a"]
    lexicon = toxicity.Lexicon({" idiot": 2.0, " trash ": 1.5, " stupid ": 1.0, " moron": 3.0, " mor": 0.5}, ["trash can", "can stupid a", "simple idiot"], (0.5, 2.0, -4.0))
    for _ in range(200):
        folded = " " + " ".join(rng.choice(words) for _ in range(rng.randint(0, 25))) + " "
        want = {}
        for at in range(len(folded)):
            fits = [w for e, w in lexicon.weights.items() if folded.startswith(e, at)]
            free = any(s <= at < s + len(p) + 1 for p in lexicon.exceptions for s in range(len(folded)) if folded.startswith(f" {p} ", s))
            if fits and not free:
                want[at] = max(fits)
        assert lexicon.word_weights(folded) == want


def test_held_out_recall(spark):
    """Toxic held-out texts are found, not only many clean ones left alone."""
    sf = "/root/testdata/sf0.1"
    rows = queries.op9_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r.toxic == 1]
    assert len(toxic) > 30 and np.mean([r.predicted for r in toxic]) >= 0.9
    assert np.mean([r.predicted for r in rows if r.toxic == 0]) <= 0.01


def test_links_of_huge_and_tiny_vectors(spark):
    rows = [(1, [1e200, 1e200], 1), (2, [2e200, 2e200], 1), (3, [1e-200, 1e-200], 1), (4, [5e-324, 5e-324], 1), (5, [1e308, -1e308], 1), (6, [0.0, 0.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (0, 6)}


def test_too_few_tables_are_an_error():
    with pytest.raises(ValueError, match="fewer hashes"):
        embeddings.tables_needed(64, 4, 0, 0.3, 0.99, 4)


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold, 64 dimensions: at least 0.98 are found, none below it."""
    rng = np.random.default_rng(9)
    a = rng.standard_normal((1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal(a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    cos = np.where(np.arange(1500) % 5 == 0, 0.9295, 0.9305)[:, None]
    b = cos * a + np.sqrt(1 - cos ** 2) * b
    rows = [(2 * i + k, [float(c) for c in v], 3) for i in range(1500) for k, v in enumerate((a[i], b[i]))]
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert not any(got[2 * i] for i in range(0, 1500, 5))
    assert np.mean([got[2 * i] for i in range(1500) if i % 5]) >= 0.98


@pytest.mark.parametrize("size, removed", [(399, 0), (400, 400), (401, 401)])
def test_repeat_boundary(spark, size, removed):
    """A passage two documents share goes from 400 bytes on, and only its own bytes."""
    rng = random.Random(size)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(size)
    rows = [(1, "A" + text(700) + "[" + passage + "]" + text(90)), (2, "B" + text(300) + "(" + passage + ")" + text(900)), (3, text(2000)), (4, passage[:398])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_removed, r.n_spans, r.repeats) for r in df.sparkSession.createDataFrame(suffix_dedup.remove_repeats(df, with_bytes=False).select("doc_id", "n_removed", "n_spans", (F.col("n_removed") > 0).alias("repeats")).collect()).collect()}
    assert got == {1: (removed, int(removed > 0), removed > 0), 2: (removed, int(removed > 0), removed > 0), 3: (0, 0, False), 4: (0, 0, False)}


def test_anchors_depend_on_content_alone():
    """The same windows have the same anchors alone and inside a much larger piece."""
    rng = np.random.default_rng(4)
    small = rng.integers(97, 101, 5000).astype(np.uint8)
    large = np.concatenate([rng.integers(97, 101, 1_500_000).astype(np.uint8), small])
    own, first, last, anchor, gram = suffix_dedup.runs_of(small, np.array([0, 5000]))
    own2, first2, last2, anchor2, gram2 = suffix_dedup.runs_of(large, np.array([0, 1_500_000, len(large)]))
    mine = own2 == 1
    assert (first == first2[mine]).all() and (anchor == anchor2[mine]).all() and (gram == gram2[mine]).all()


def test_native_redaction_has_no_python(spark, forest):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (secret_scan.scan(docs, forest), secret_scan.redact(docs, forest)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
