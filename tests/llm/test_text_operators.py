"""BPE, token files, SimHash, decontamination, suffix dedup against brute force."""
import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailcast.llm import bpe, decontaminate, simhash, suffix_dedup, textops, token_files
from trailcast.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, row string, own boolean"     # clashing extra columns
ODD = [None, "", " \n", "a", "x" * 3000, "it's we've 'tis ''s\n's 5's", "<|endoftext|>a", "É日本 12³\tİΣς"]


def docs_of(spark, texts, parts=2):
    rows = [(i, t, "r", True) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_tokenizers_library(name):
    from tokenizers import Tokenizer
    rng = random.Random(5)
    alphabet = "ab cd'é\n\t  sSΣİ12½Ⅷ一日́<|endoftext|>.!😀 \x1c\x85 "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += [t or "" for t in ODD] + [f"a{chr(c)}1 {chr(c) * 2}b" for c in range(0x110000) if not 0xD800 <= c < 0xE000][::301]
    path = bpe.tokenizer_file(name)
    known, own = Tokenizer.from_file(path), bpe.vocabulary(path)
    ids, at = bpe.encode_texts(texts, own)
    for k, e in enumerate(known.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[k]:at[k + 1]].tolist() == e.ids, texts[k]
        assert own.decode(e.ids) == known.decode(e.ids, skip_special_tokens=False)


def test_long_words_merge_like_short_ones():
    own = bpe.vocabulary(bpe.tokenizer_file("byte_bpe_50k.json"))
    rng = random.Random(1)
    for n in (130, 400):
        parts = [own.ids[c] for c in (rng.choice("theandingo") for _ in range(n))]
        few, bpe.HEAP_PARTS = bpe.HEAP_PARTS, 1 << 30
        try:
            slow = bpe.merge_parts(parts, own.merges)
        finally:
            bpe.HEAP_PARTS = few
        assert bpe.merge_parts(parts, own.merges) == slow


def test_round_trip_rows(spark):
    path = bpe.tokenizer_file("word_bpe_49k.json")
    own = bpe.vocabulary(path)
    rows = {r.doc_id: r for r in bpe.round_trip(docs_of(spark, ODD + ODD), path).collect()}
    assert len(rows) == 2 * len(ODD)
    for k, text in enumerate(ODD + ODD):
        ids, _ = bpe.encode_texts([text or ""], own)
        assert rows[k].n_tokens == len(ids)
        assert rows[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids.tolist())).encode()).hexdigest()
        assert rows[k].decoded_sha256 == hashlib.sha256(own.decode(ids.tolist()).encode()).hexdigest()
    assert bpe.round_trip(docs_of(spark, []), path).count() == 0
    coded = bpe.decode(bpe.encode(docs_of(spark, ["the cat"]), path), path)
    assert coded.first().decoded == "the</w> cat</w>"


def test_wavelet_file_answers():
    rng = np.random.default_rng(3)
    for ids in (rng.integers(0, 50_000, 3000), rng.zipf(1.3, 5000) % 70_000, np.array([7]), np.zeros(600, int)):
        ids = ids.astype(np.int32)
        file = token_files.TokenFile(token_files.build_file(ids, [5, None], np.array([0, 1, len(ids)])))
        assert file.tokens().tolist() == ids.tolist() and file.doc_ids == [5, None]
        for i in rng.integers(0, len(ids), 30).tolist():
            t = int(ids[i])
            assert file.access(i) == t
            assert file.count(t) == int((ids == t).sum()) and file.count(t, 0, i) == int((ids[:i] == t).sum())
            assert file.locate(t, file.count(t, 0, i)) == i
        assert file.count(69_999_999) == 0


def test_token_files_rows(spark):
    path = bpe.tokenizer_file("byte_bpe_50k.json")
    own = bpe.vocabulary(path)
    texts = ODD * 4
    rows = token_files.index_of_documents(docs_of(spark, texts, 3), path, shard_bytes=4000).collect()
    start = 0
    for r in sorted(rows, key=lambda r: r.doc_id):
        ids = bpe.encode_texts([texts[r.doc_id] or ""], own)[0].tolist() + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(rows) == len(texts) and token_files.index_of_documents(docs_of(spark, []), path).count() == 0


def plain_fingerprint(text):
    import xxhash
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, linked):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(values))]


def test_simhash_rows(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(6)]
    texts = [None, "", "\n", "One two", "one  TWO"] + base + [b.replace(" ", "\t", 5) + " z" * (k % 3) for k, b in enumerate(base * 4)]
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    roots = components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    assert {i: (int(r.fingerprint, 16), r.component_id) for i, r in rows.items()} == {i: (fps[i], roots[i]) for i in range(len(texts))}
    docs = docs_of(spark, texts)
    kept = simhash.keep_one(docs.union(docs))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(roots))
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("bucket", [2048, 3])
def test_links_span_the_components(spark, bucket):
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 1 << 63, 3)
    near = [int(c) ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 4), replace=False)) for c in centre for _ in range(40)]
    fps = sorted({*near, *rng.integers(0, 1 << 63, 100).tolist()})
    df = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(3)
    links = [(r.a, r.b) for r in simhash.links_within(df, Scratch(spark, "test"), 3, bucket).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    pairs = {frozenset(x) for x in links}
    place = {f: i for i, f in enumerate(fps)}
    want = components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    got = components(fps, lambda a, b: frozenset((a, b)) in pairs)
    groups = lambda x: {frozenset(i for i in place.values() if x[i] == r) for r in set(x)}
    assert groups(want) == groups(got)


def test_thresholds_sum_up_and_are_cheapest():
    costs = [[0, 5, 50, 90], [0, 1, 3, 80], [0, 9, 10, 11]]
    cost, plan = simhash.allocate(costs, 1)
    every = [(sum(c[t + 1] for c, t in zip(costs, p)), p) for p in ((a, b, c) for a in range(-1, 3) for b in range(-1, 3) for c in range(-1, 3)) if sum(p) == 1]
    assert sum(plan) == 1 and cost == min(every)[0]


def brute_hits(texts, items, window=13):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = textops.word_list(text)
        for a in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[a:a + window])].add(item)
    out = []
    for t in texts:
        w, found = textops.word_list(t), set()
        hit = [False] * len(w)
        for key, own in windows.items():
            for a in range(len(w) - len(key) + 1):
                if tuple(w[a:a + len(key)]) == key:
                    found |= own
                    hit[a:a + len(key)] = [True] * len(key)
        n = sum(hit)
        out.append((len(w), n, len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), n > 0 and 20 * n >= len(w)))
    return out


@pytest.mark.parametrize("block_bytes, piece", [(3 << 20, 1 << 16), (40, 1 << 16), (60, 12)])
def test_contamination_rows(spark, monkeypatch, block_bytes, piece):
    monkeypatch.setattr(decontaminate, "PIECE_BYTES", piece)
    rng = random.Random(8)
    words = ["a", "b", "Ça", "d1", "E"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(9, some(3)), (10, some(16)), (11, None), (12, ""), (13, some(3)), (100, some(14)), (2, "a")]
    texts = [None, "", "--"] + [some(rng.randint(1, 60)) for _ in range(40)] + [f"{some(4)}, {items[1][1]}! {some(3)}", items[5][1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contamination(docs_of(spark, texts), bench, shard_words=50, block_bytes=block_bytes).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows}
    assert got == dict(enumerate(brute_hits(texts, items)))
    clean = decontaminate.remove_contaminated(docs_of(spark, texts), bench)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, g in got.items() if not g[-1])
    empty = decontaminate.contamination(docs_of(spark, texts), bench.limit(0)).collect()
    assert len(empty) == len(texts) and not any(r.contaminated for r in empty)


def test_pieces_hold_every_window():
    text = " ".join(f"w{i % 97}" for i in range(3000))
    words = decontaminate.textops.word_list(text)
    windows = lambda ws: {tuple(ws[i:i + 13]) for i in range(max(1, len(ws) - 12))}
    for limit in (10, 100, 5000, 1 << 20):
        parts = [decontaminate.textops.word_list(p) for p in decontaminate.pieces_of(text, 13, limit)]
        assert set().union(*map(windows, parts)) == windows(words) and all(len(p) >= 13 for p in parts)
        assert all(len(" ".join(p)) <= limit or len(p) == 13 for p in parts)
    assert decontaminate.pieces_of(None, 13, 10) == [""] and decontaminate.pieces_of("\n".join(["ab"] * 40), 13, 30)[0] == " ".join(["ab"] * 13)


def test_blocks_are_bounded_by_bytes(spark):
    """Items of many newline-separated words, and one very long item: blocks stay near the bound."""
    from trailcast.llm.scratch import Scratch
    items = [(i, "\n".join(f"x{i}y{j}" for j in range(400))) for i in range(100)] + [(100, " ".join(f"long{j}" for j in range(60_000)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pieces, n = decontaminate.deal_blocks(bench, "item_id", "text", 13, 200_000, Scratch(spark, "deal"))
    sizes = [r.s for r in pieces.groupBy("block").agg(F.sum(F.octet_length("text")).alias("s")).collect()]
    assert n >= 5 and max(sizes) < 2 * 200_000 + decontaminate.PIECE_BYTES
    assert pieces.agg(F.max(F.octet_length("text"))).first()[0] <= decontaminate.PIECE_BYTES


def test_phrases_and_proximity(spark):
    docs = docs_of(spark, ["x cat y dog z cat dog", "dog a b c cat", None])
    found = decontaminate.matches(docs, [(1, "cat dog")]).collect()
    assert [(r.query, r.doc_id, r.start) for r in found] == [(1, 0, 5)]
    near = {(r.doc_id, r.start) for r in decontaminate.matches(docs, [(1, "cat dog")], span=3).collect()}
    assert near == {(0, 1), (0, 3), (0, 5)}
    assert {r.doc_id for r in decontaminate.matches(docs, [(1, "cat dog")], span=5).collect()} == {0, 1}


def brute_repeats(texts, n):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[a:a + n] for r in raws for a in range(len(r) - n + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for a in range(len(r) - n + 1):
            gone[a:a + n] |= seen[r[a:a + n]] > 1
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("n, gram, block", [(40, 8, 256), (25, 5, 2)])
def test_repeated_bytes_go(spark, n, gram, block):
    rng = random.Random(3)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(20, 200))) for _ in range(8)]
    texts = [None, "", "x"] + ["".join(rng.choice(base)[rng.randint(0, 9):rng.randint(10, 200)] if rng.random() < .6 else "".join(rng.choice("abé") for _ in range(30)) for _ in range(rng.randint(1, 4))) for _ in range(50)]
    texts += ["ab" * 60, "a" * 90, texts[9], texts[9]]
    rows = suffix_dedup.remove_repeats(docs_of(spark, texts, 3), n, gram, block).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == dict(enumerate(brute_repeats(texts, n)))
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in rows)
    assert suffix_dedup.remove_repeats(docs_of(spark, [])).count() == 0


def test_colliding_hashes_are_verified():
    data = np.frombuffer(b"abcdeabcdfabcde", np.uint8)

    class Blind(suffix_dedup.Suffixes):
        def extension(self, a, b):
            return np.full(len(a), self.length)

    starts, group = np.array([0, 5, 10]), np.zeros(3, np.int64)
    real, suffix_dedup.Suffixes = suffix_dedup.Suffixes, Blind
    try:
        order, same = suffix_dedup.repeated_windows(data, starts, group, 5)
    finally:
        suffix_dedup.Suffixes = real
    assert starts[order].tolist() == [0, 10, 5] and same.tolist() == [False, True, False]
