"""The quality classifier against a plain version: features as named tuples in dictionaries,
one follow-the-regularised-leader update a row, one sum a score."""
import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from trailcast.llm import quality

TOKEN = re.compile(rb"[0-9A-Za-z'\x80-\xff]+|[!-&(-/:-@\[-`{-~]+")
WORD = re.compile(rb"[0-9A-Za-z'\x80-\xff]")


def plain_features(text):
    """Share of each feature in the text's tokens, times 8."""
    tokens = TOKEN.findall((text or "").encode())
    words = [t.lower() for t in tokens]
    shapes = []
    for k, t in enumerate(tokens):
        if not WORD.match(t):
            shapes.append(t)
            continue
        upper, low = len(re.findall(rb"[A-Z]", t)), len(re.findall(rb"[a-z]", t))
        kind = "digits" if re.search(rb"[0-9]", t) else "upper" if upper > 1 and not low else "capital" if upper else "lower"
        shapes.append((kind, k > 0 and words[k - 1] == words[k]))
    back = lambda x, k, n: x[k - n] if k >= n else None
    found = Counter()
    for k in range(len(tokens)):
        found.update([("w", words[k]), ("ww", words[k], back(words, k, 1)), ("s", shapes[k]), ("ss", shapes[k], back(shapes, k, 1)),
                      ("sss", shapes[k], back(shapes, k, 1), back(shapes, k, 2))])
    return {f: 8.0 * c / len(tokens) for f, c in found.items()}


def plain_weight(z, n):
    return 0.0 if abs(z) <= 0.02 else -(z - math.copysign(0.02, z)) / ((1.0 + math.sqrt(n)) / 0.3 + 0.1)


def plain_score(x, state):
    total = sum(plain_weight(*state.get(f, (0.0, 0.0))) * v for f, v in {**x, "bias": 1.0}.items())
    return 1 / (1 + math.exp(-max(-35, min(35, total))))


def plain_fit(rows, epochs=3):
    state = {}
    for _ in range(epochs):
        for text, y in rows:
            x = plain_features(text)
            miss = plain_score(x, state) - y
            new = {}
            for f, v in {**x, "bias": 1.0}.items():
                z, n = state.get(f, (0.0, 0.0))
                g = miss * v
                sigma = (math.sqrt(n + g * g) - math.sqrt(n)) / 0.3
                new[f] = (z + g - sigma * plain_weight(z, n), n + g * g)
            state.update(new)
    return state


def test_classifier_against_a_plain_version(spark):
    good = ["The Report of 2019 covers the city's water supply.", "Water flows; the city's REPORT says so.", "Die Stadt prüft den Bericht."]
    bad = ["BUY BUY BUY now!!! $$$", "click click here >>> win $100", "!!! now now WIN"]
    texts = {i: ((good if i % 2 else bad)[i % 3] + (" again" * (i % 4))) for i in range(60)}
    texts.update({60: "", 61: None, 62: "  \n ", 63: "'", 64: "water " * 260_000 + "WIN $$$", 65: "x" * 1_300_000})
    labels = {i: i % 2 for i in texts}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.classify(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect()}

    held = {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 0}
    order = [r.doc_id for r in docs.orderBy(F.xxhash64(F.lit(7), F.col("doc_id"))).collect()]
    state = plain_fit([(texts[i], labels[i]) for i in order if i not in held])
    for i, text in texts.items():
        want = plain_score(plain_features(text), state)
        assert abs(got[i].score - want) < 1e-4, (i, got[i].score, want)
        assert got[i].held_out == (i in held) and got[i].predicted == int(got[i].score >= 0.3)
    assert len({round(r.score, 3) for r in got.values()}) > 10


def test_sample_is_bounded_in_bytes(spark):
    from trailcast.llm.samples import held_out, labelled_sample
    ids = [r.doc_id for r in spark.range(400).select(F.col("id").alias("doc_id")).where(~held_out()).collect()]
    long = set(ids[:6])
    texts = [(i, "x" * 900 if i in long else "y" * 20) for i in ids]
    docs = spark.createDataFrame(texts + [(ids[20], None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k % 4 == 0)) for k, i in enumerate(ids)], "doc_id long, quality int")

    every = labelled_sample(docs, labels, "quality", 1000).collect()
    assert len(every) == len(ids) and all(abs(r.weight - 1) < 1e-12 for r in every)
    few = labelled_sample(docs, labels, "quality", 1000, max_bytes=1600).collect()
    for k in (0, 1):
        own = [r for r in few if r.label == k]
        share = sum(1 for j in range(len(ids)) if int(j % 4 == 0) == k) / len(ids)
        assert sum(len(r.text or "") for r in own) < 1600 + 900
        assert abs(sum(r.weight for r in own) / len(few) - share) < 1e-12
    zeros = [r for r in few if r.label == 0]                     # 80 short texts fill it: no long one
    assert len(zeros) in (80, 81) and all(len(r.text or "") < 100 for r in zeros)
    one = labelled_sample(docs.where(F.length("text") > 100), labels, "quality", 1000, max_bytes=160).collect()
    assert sorted(r.label for r in one) == [0, 1]                # never none
    assert labelled_sample(docs.limit(0), labels, "quality", 5).count() == 0
