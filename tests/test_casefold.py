"""Case folding: Python's rule for every character, without the long class on plain text."""
import re

from pyspark.sql import functions as F

from trailcast.functions import text


def test_every_character_folds_as_python_does(spark):
    chars = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    own = {c for c in chars if c.lower() == c != c.casefold()}
    assert {c for c in chars if re.match(text._FOLDS, c)} == own
    words = [f"Ab{c}Z" for c in sorted(own)] + ["", "PLAIN", "Straße", None]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r.x for r in rows.select(text.casefold(F.col("w")).alias("x")).collect()] == [w if w is None else w.casefold() for w in words]


def test_plain_text_is_not_held_against_the_class(spark):
    assert len(text._FOLDS) < len(text._FOLDED)              # ranges
    plan = spark.range(1).select(text.casefold(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"octet_length\(.*?\) > (char_)?length\(", plan)
