"""Argument rules."""
import pytest

from trailcast.config import EvalConfig, PrefixConfig


@pytest.mark.parametrize("kw", [dict(reranker="suffix_overlap"), dict(rerank_pool_k=5),
                                dict(reranker="suffix_overlap", rerank_pool_k=2, top_k=3),
                                dict(reranker="suffix_overlap", rerank_pool_k=0, top_k=1),
                                dict(boundaries=(10, 5)), dict(top_k=0)])
def test_eval_rules(kw):
    with pytest.raises(ValueError):
        EvalConfig(**kw).validate()


def test_unknown_names():
    with pytest.raises(ValueError):
        EvalConfig(encoder="nope").validate(known_encoders={"hashing": None})
    with pytest.raises(ValueError):
        EvalConfig(reranker="nope", rerank_pool_k=5).validate(known_rerankers={"x": None})


@pytest.mark.parametrize("kw", [dict(split_mode="both"), dict(gap=0), dict(base=-1), dict(m=-1),
                                dict(test_share=1.5)])
def test_prefix_rules(kw):
    with pytest.raises(ValueError):
        PrefixConfig(**kw).validate()


def test_candidate_limit():
    assert EvalConfig(top_k=3).candidate_limit == 3
    assert EvalConfig(top_k=3, reranker="suffix_overlap", rerank_pool_k=10).candidate_limit == 10
