
from __future__ import annotations

import functools
import importlib

from trailcast.session import configure

MODULES = ["prefix_q", "metrics_q", "vector_q", "text_q", "runs_q"]


def _modules():
    out = []
    for m in MODULES:
        try:
            out.append(importlib.import_module(f"trailcast.catalog.{m}"))
        except ModuleNotFoundError as e:
            if e.name != f"trailcast.catalog.{m}":
                raise
    return out


def _configured(fn):
    @functools.wraps(fn)
    def run(spark, sf_dir):
        configure(spark)
        return fn(spark, sf_dir)
    return run


def all_queries():
    q = {}
    for m in _modules():
        q.update({k: _configured(v) for k, v in m.QUERIES.items()})
    return q


def all_oracles():
    o = {}
    for m in _modules():
        o.update(m.ORACLE)
    return o


def flagship(spark, sf_dir):
    try:
        from trailcast.catalog.vector_q import q_flagship
        return q_flagship(spark, sf_dir)
    except ModuleNotFoundError:
        from trailcast.catalog.prefix_q import q_prefix_dedup
        return q_prefix_dedup(spark, sf_dir)
