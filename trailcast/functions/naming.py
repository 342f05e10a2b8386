"""Names of dataset variants, vector collections and evaluation configurations
(B9, B10, I18, I19) as Column expressions, plus driver-side twins for job wiring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The name format and the key fields have to be these.
VARIANT_PATTERN = "^(?:last_(\\d+)_)?b(\\d+)_g(\\d+)_(.+)$"

# Fields of the evaluation configuration, in key order; split_type is kept in the
# struct but not in the key.
CONFIG_KEY_FIELDS = ["dataset", "base", "gap", "m", "top_k", "max_rows", "model_id", "llm",
                     "prompt_variant", "reranker_model", "rerank_pool_k"]


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def strip_split_suffix(stem: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(stem, "_train$", ""), "_test$", "")


def variant_name(stem, base, gap, m, split_mode="trace", cross_dedup=False) -> Column:
    """``[last_{m}_]b{base}_g{gap}_{stem}`` + ``_row`` (row split) or ``_trace_dedup``."""
    stem, base, gap, m = _lit(stem), _lit(base), _lit(gap), _lit(m)
    split_mode, cross_dedup = _lit(split_mode), _lit(cross_dedup)
    core = F.concat(
        F.when(m > 1, F.concat(F.lit("last_"), m.cast("string"), F.lit("_"))).otherwise(F.lit("")),
        F.lit("b"), base.cast("string"), F.lit("_g"), gap.cast("string"), F.lit("_"),
        strip_split_suffix(stem))
    return (F.when(split_mode == "row", F.concat(core, F.lit("_row")))
            .when(cross_dedup, F.concat(core, F.lit("_trace_dedup")))
            .otherwise(core))


def variant_name_py(stem: str, base: int, gap: int, m: int, split_mode: str = "trace",
                    cross_dedup: bool = False) -> str:
    stem = stem.removesuffix("_train").removesuffix("_test")
    core = (f"last_{m}_" if m > 1 else "") + f"b{base}_g{gap}_{stem}"
    if split_mode == "row":
        return core + "_row"
    return core + "_trace_dedup" if cross_dedup else core


def collection_name(model_id, variant) -> Column:
    return F.concat(_lit(model_id), F.lit("_"), _lit(variant))


def parse_variant(dataset: Column) -> Column:
    """struct(base, gap, m) parsed from a variant name; no match -> all null, m defaults 1."""
    ok = dataset.isNotNull() & dataset.rlike(VARIANT_PATTERN)

    def grp(i):
        return F.regexp_extract(dataset, VARIANT_PATTERN, i)

    return F.struct(
        F.when(ok, grp(2).cast("long")).alias("base"),
        F.when(ok, grp(3).cast("long")).alias("gap"),
        F.when(ok, F.coalesce(F.nullif(grp(1), F.lit("")), F.lit("1")).cast("long")).alias("m"),
    )


def split_type(dataset: Column) -> Column:
    return F.when(F.coalesce(dataset.endswith("_row"), F.lit(False)), F.lit("row_level")) \
        .otherwise(F.lit("trace_level"))


def eval_config(dataset, model_id, llm, prompt_variant, top_k, max_rows,
                reranker_model, rerank_pool_k) -> Column:
    dataset = _lit(dataset)
    v = parse_variant(dataset)
    return F.struct(
        dataset.cast("string").alias("dataset"), v["base"].alias("base"), v["gap"].alias("gap"),
        v["m"].alias("m"), _lit(top_k).cast("long").alias("top_k"),
        _lit(max_rows).cast("long").alias("max_rows"), _lit(model_id).cast("string").alias("model_id"),
        _lit(llm).cast("string").alias("llm"),
        _lit(prompt_variant).cast("string").alias("prompt_variant"),
        _lit(reranker_model).cast("string").alias("reranker_model"),
        _lit(rerank_pool_k).cast("long").alias("rerank_pool_k"),
        split_type(dataset).alias("split_type"))


def eval_config_key(config: Column) -> Column:
    """``dataset=..|base=..|...`` with missing values printed as None."""
    parts = [F.concat(F.lit(f"{name}="), F.coalesce(config[name].cast("string"), F.lit("None")))
             for name in CONFIG_KEY_FIELDS]
    return F.concat_ws("|", *parts)
