"""Wavelet-matrix files of several blocks a plane: every answer against the plain ids, and the
blocks an answer decompresses."""
import numpy as np
import pytest

from trailcast.llm import token_files


def _file(ids):
    return token_files.TokenFile(token_files.build_file(ids, [1], np.array([0, len(ids)])))


@pytest.mark.parametrize("n", [0, 1, token_files.BLOCK - 1, token_files.BLOCK, token_files.BLOCK + 1, 3 * token_files.BLOCK, 200_003])
def test_answers_at_block_boundaries(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 3000).astype(np.int32)
    ids[n // 2:n // 2 + 70_000] = 7                      # a block of nothing else
    file = _file(ids)
    assert (file.tokens() == ids).all() and file.starts.tolist() == [0, n] and file.doc_ids == [1]
    edges = [i for b in range(0, n + 1, token_files.BLOCK) for i in (b - 1, b, b + 1)] + [n // 2, n - 1]
    for i in {i for i in edges if 0 <= i < n} | set(rng.integers(0, max(n, 1), 50 if n else 0).tolist()):
        assert file.access(i) == ids[i]
    for token in (set(ids[:5].tolist()) | {7, 1, 3000, 99_999} if n else {7}):
        places = np.flatnonzero(ids == token)
        assert file.count(token) == len(places)
        lo, hi = sorted(rng.integers(0, n + 1, 2).tolist())
        assert file.count(token, lo, hi) == ((places >= lo) & (places < hi)).sum()
        for j in {0, len(places) // 2, len(places) - 1} if len(places) else ():
            assert file.locate(token, j) == places[j]
        with pytest.raises(IndexError):
            file.locate(token, len(places))
    with pytest.raises(IndexError):
        file.access(n)


def test_an_answer_reads_few_blocks(monkeypatch):
    """At most a block of each plane for an access, two for a count, one for a locate on the way
    back; a file of fifteen blocks a plane."""
    ids = np.random.default_rng(1).integers(0, 1000, 15 * token_files.BLOCK)
    file = _file(ids)
    read = []
    unpack = token_files._unpack
    monkeypatch.setattr(token_files, "_unpack", lambda blob: read.append(len(blob)) or unpack(blob))
    for ask, most in ((lambda: file.access(500_000), 10), (lambda: file.count(5, 100_000, 900_000), 20), (lambda: file.locate(17, 300), 30)):
        file._blocks.clear()
        read.clear()
        ask()
        assert 0 < len(read) <= most
    assert max(read) < token_files.BLOCK // 8 + 100


def test_open_blocks_are_bounded():
    ids = np.random.default_rng(2).integers(0, 4000, 30 * token_files.BLOCK)
    file = _file(ids)
    for i in np.random.default_rng(3).integers(0, len(ids), 400).tolist():
        assert file.access(i) == ids[i]
    assert len(file._blocks) == token_files.OPEN_BLOCKS


def test_size_of_a_file():
    """Counts and offsets cost under one percent of the file; independent zipf ids take less than
    two bytes each."""
    ids = np.minimum(np.random.default_rng(4).zipf(1.2, 1_000_000), 50_000).astype(np.int32)
    blob = token_files.build_file(ids, [1], np.array([0, len(ids)]))
    file = token_files.TokenFile(blob)
    assert file.planes * file._body < 0.01 * len(blob)
    assert len(blob) < 2 * len(ids)
