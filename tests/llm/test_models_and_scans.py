"""Embeddings, classifiers, native scans and the pipeline."""
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trailcast.llm import embeddings, licenses, quality, queries, secret_scan, simhash, toxicity

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("block", [512, 8])
def test_embedding_links(spark, block):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((12, 20))
    x = [c + rng.standard_normal(20) * s for c in centre for s in rng.choice([0.0, 0.1, 0.2, 0.3], 12)]
    rows = [(i, [float(v) for v in np.float32(v)], int(i % 5 == 0) if i % 11 else None) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 20, [float("nan")] + [1.0] * 19, [None] + [1.0] * 19, [float("inf")] * 20, [1.0, 2.0]]
    rows += [(1000 + i, v, 1) for i, v in enumerate(odd)] + [(rows[1][0] + 500, rows[1][1], rows[1][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, block=block).collect()}
    ok = [r for r in rows if r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    unit = {r[0]: np.array(r[1]) / np.linalg.norm(np.array(r[1])) for r in ok}
    links = {r[0]: {s[0] for s in ok if s[0] != r[0] and s[2] == r[2] and len(s[1]) == len(r[1]) and unit[r[0]] @ unit[s[0]] >= 0.93} for r in ok}
    true = sum(map(len, links.values()))
    assert len(got) == len(rows) and true > 100
    assert all(r.n_links <= len(links.get(i, ())) for i, r in got.items())
    assert sum(r.n_links for r in got.values()) >= 0.98 * true
    for i, r in got.items():
        assert r.kept == (r.component_id == i) and (i in links or (r.n_links, r.component_id) == (0, i))
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("query, least", [(queries.op4_quality_classifier, 0.97), (queries.op9_toxicity, 0.95)])
def test_held_out_accuracy(spark, query, least):
    label = "quality" if query is queries.op4_quality_classifier else "toxic"
    rows = query(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r[label] for r in rows]) >= least
    assert all(0 <= r.score <= 1 for r in rows)


def test_classifiers_without_labels(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "you idiot", "z")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for rows in (quality.classify(docs, none).collect(), toxicity.classify(docs, none).collect()):
        assert len(rows) == 3 and all(0 <= r.score <= 1 for r in rows)
    assert [r.doc_id for r in toxicity.remove_toxic(docs, toxicity.learn([], [], [])).collect()] == [1, 2]


def test_folding_lexicon_and_exceptions():
    assert toxicity.fold("1d10t \u0456d\u0456\u043et \uff49\uff44\uff49\uff4f\uff54").split() == ["idiot"] * 3
    assert toxicity.fold("455 5 THE!! sh$t \u00e9").split() == ["the", "shst", "e"]
    lex = toxicity.learn([], [], [])
    weight = lambda t: sum(lex.word_weights(toxicity.fold(t)).values())
    assert weight("such an 1d10t") == weight("such an idiot") > 0
    assert weight("the trash can") == 0 < weight("you trash") and weight("idiotic") == 0 == weight("57 10")


def test_folding_drops_marks_and_invisible_characters():
    for text in ("i\u0301diot", "id\u200biot", "idi\u200dot", "id\u00adiot", "\ufeffidiot", "idio\u0336t\u20dd"):
        assert toxicity.fold(text) == " idiot "
        assert sum(toxicity.learn([], [], []).word_weights(toxicity.fold(f"such an {text}")).values()) > 0
    assert toxicity.fold("cafe\u0301 e\u0301te\u0301").split() == toxicity.fold("caf\u00e9 \u00e9t\u00e9").split() == ["cafe", "ete"]


def test_licenses_match_their_oracle(spark):
    from trailcast.catalog.check import compare, duckdb_conn
    df = queries.op6_license_scan(spark, "/root/testdata/sf0.001")
    cur = duckdb_conn("/root/testdata/sf0.001").execute(queries.ORACLE["op6_license_scan"])
    got = compare([tuple(r) for r in df.collect()], df.columns, cur.fetchall(), [d[0] for d in cur.description])
    assert got["ok"], got
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "foo RELEASED under the MIT license, bar", 1), (4, "license", 1), (5, "a released under the GPL license", 1)], "doc_id long, text string, band long")
    assert [(r.doc_id, r.license_id, r.containment) for r in licenses.scan(docs).collect()] == [(3, "MIT", 1.0)]


def test_secrets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    forest = secret_scan.fit(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = secret_scan.scan(docs, forest).collect()
    plain = re.compile(r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{12,}")
    assert {(r.doc_id, r.start, r.length) for r in rows} == {(i, m.start(), len(m[0])) for i, t in texts.items() for m in plain.finditer(t or "")}
    planted = {(i, m.start()) for i, t in texts.items() for m in re.finditer(r'AKIA[0-9A-Z]{16}|(?<=token = ")[0-9a-f]{40}|(?<=password=)[0-9a-f]{18}', t or "")}
    assert {(r.doc_id, r.start) for r in rows if r.secret} == planted
    for r in secret_scan.redact(docs, forest).collect():
        want, cut = texts[r.doc_id], sorted((x for x in rows if x.doc_id == r.doc_id and x.secret), key=lambda x: -x.start)
        for x in cut:
            want = want[:x.start] + "[SECRET]" + want[x.start + x.length:]
        assert r.text == want and r.n_chars == len(want)
    odd = spark.createDataFrame([(1, None, None), (2, "", "a"), (3, "x" * 200_000 + " password=abc123abc123abc1 \u0001", "b")], "doc_id long, text string, source string")
    assert [(r.doc_id, r.secret) for r in secret_scan.scan(odd, forest).collect()] == [(3, True)]
    assert secret_scan.redact(odd, forest).columns == odd.columns


def test_native_scans_run_no_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    forest = secret_scan.Forest([(0, 14.0, 0.0, 1.0)])
    for df in (licenses.scan(docs), secret_scan.scan(docs, forest), secret_scan.redact(docs, forest)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        after = stage(spark, left, "/root/testdata/sf0.001")
        assert after.dtypes == docs.dtypes
        left = after
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(r.doc_id for r in left.select("doc_id").collect())
    fps = [int(r.fingerprint, 16) for r in simhash.near_duplicates(left).collect()]
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(fps) for b in fps[:i])
    assert out.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_licenses_of_whole_notices(spark):
    """Standard notices, as files carry them, give their license and no other."""
    gnu = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU {0}General Public License as published by
# the Free Software Foundation, either version {1} of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU {0}General Public License for more details."""
    bsd = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
    cases = [(gnu.format("", "3"), {"GPL-3.0"}), (gnu.format("", "2"), {"GPL-2.0"}), (gnu.format("Lesser ", "2.1").replace("program", "library"), {"LGPL-2.1"}),
             (gnu.format("Lesser ", "3").replace("program", "library"), {"LGPL-3.0"}), (gnu.format("Affero ", "3"), {"AGPL-3.0"}), (gnu.format("Library ", "2").replace("program", "library"), {"LGPL-2.0"}),
             (bsd, {"BSD"}), (bsd + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", {"BSD", "BSD-3-Clause OR BSD-4-Clause"}),
             (isc + ", provided that the above copyright notice and this permission notice appear in all copies.", {"ISC"}), (isc + '. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE', {"0BSD"}),
             ("This work is licensed under the GNU General Public License, version 2.", {"GPL-2.0"}), ("SPDX-License-Identifier: LGPL-2.1-or-later", {"LGPL-2.1"}),
             ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", {"CC-BY-SA-3.0"}), ("Available under CC BY-NC-ND 4.0", {"CC-BY-NC-ND-4.0"}),
             ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", {"EPL-2.0"}),
             ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", {"MIT"}),
             ("Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.", {"Zlib"})]
    docs = spark.createDataFrame([(i, "x y z\n" + t + "\nq r s") for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {}
    for r in licenses.scan(docs).collect():
        got.setdefault(r.doc_id, set()).add(r.license_id)
    shared = lambda x: x == "GNU" or " OR " in x
    alone = {i: {x for x in got.get(i, ()) if x in want or not shared(x)} for i, (_, want) in enumerate(cases)}
    assert alone == {i: want for i, (_, want) in enumerate(cases)}


def test_every_license_has_a_piece_of_its_own():
    from trailcast.llm.license_texts import NOTICES
    names = {p["license_id"] for p in licenses.pieces_of()}
    assert set(NOTICES) <= names and len(names) > 40


def test_secrets_in_context(spark):
    """Values after a key word or in a URL, whatever their characters and however short."""
    forest = secret_scan.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    secret = [("x password={} y", "hunter2"), ("password: {}", "Tr0ub4dor&3!x"), ('token = "{}"', "QWERTYqwertyASDFGHzxcvbnLKJH"), ("postgres://bob:{}@db/x", "s3cr3tpw"),
              ('{{"password": "{}", "user": 1}}', "correct horse battery staple"), ("DB_PASSWORD_PROD='{}'", "Passw0rd!"), ("redis://:{}@cache:6379", "p@ss:w0rd"), ("pwd = {}.", "zebra#99"),
              ("Authorization: Bearer {}", "abcDEFghiJKLmnop")]
    plain = ["password=${DB_PASSWORD}", "token: null,", 'password = get_password(user)', "password: required", "max_tokens: 4096", "token = self.token"]
    texts = [t.format(v) for t, v in secret] + plain
    docs = spark.createDataFrame([(i, t, "src/app.conf") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {(r.doc_id, r.start, r.length): r.secret for r in secret_scan.scan(docs, forest).collect()}
    want = {(i, texts[i].index(v), len(v)) for i, (_, v) in enumerate(secret)}
    assert want <= set(got)
    assert {k for k, s in got.items() if s} == want
    redacted = {r.doc_id: r.text for r in secret_scan.redact(docs, forest).collect()}
    assert [redacted[i] for i in range(len(texts))] == [t.format("[SECRET]") for t, _ in secret] + plain
