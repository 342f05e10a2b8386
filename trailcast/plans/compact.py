"""A prefix table stored in the size of its log.

Rendered prefixes hold a trace's activities once per anchor, so their text grows with the square
of a trace. The compact form stores what they are made of: the event blocks of each trace, once,
and a narrow row (split, row_id, trace_pos, anchor) for every prefix that split and dedup leave.
:meth:`CompactPrefixes.view` renders the text on read, for all rows or only for those that a
condition on the narrow columns leaves; blocks without a wanted anchor aren't read into the
rendering."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trailcast.config import PrefixConfig
from trailcast.operators.prefixes import render_places, with_earlier_text
from trailcast.plans.build import PREFIX_COLUMNS, winners


@dataclass
class CompactPrefixes:
    """``blocks``: case_id, blk, arr, trace_pos, n; ``places``: split, row_id, trace_pos, anchor."""
    blocks: DataFrame
    places: DataFrame
    cfg: PrefixConfig
    longest: int

    def view(self, where: Column | str | None = None) -> DataFrame:
        """The prefix table (columns of :func:`trailcast.plans.build.build_dataset`), or the rows
        that a condition on split, row_id, trace_pos and anchor leaves."""
        places, blocks = self.places, self.blocks
        if where is not None:
            places = places.where(where)
            blocks = blocks.join(places.select("trace_pos").distinct(), "trace_pos", "left_semi")
        text = with_earlier_text(blocks, self.cfg, self.longest)
        return render_places(text, places, self.cfg, ["split", "row_id"]).select(*PREFIX_COLUMNS)


def compact_dataset(log: DataFrame, cfg: PrefixConfig = PrefixConfig(), **rank_opts) -> CompactPrefixes:
    """Split and deduplicate a log without rendering any prefix."""
    blocks, won, stats = winners(log, cfg, **rank_opts)
    return CompactPrefixes(blocks.drop("split"), won.select("split", "row_id", "trace_pos", "anchor"), cfg, stats.longest)


def write_compact(data: CompactPrefixes, path: str) -> str:
    """Tables ``blocks`` and ``places`` (by split) and one row of settings below ``path``."""
    data.blocks.write.mode("overwrite").parquet(f"{path}/blocks")
    data.places.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("split").parquet(f"{path}/places")
    settings = json.dumps({"cfg": asdict(data.cfg), "longest": data.longest, "blocks": data.blocks.schema.jsonValue(), "places": data.places.schema.jsonValue()})
    data.blocks.sparkSession.range(1).select(F.lit(settings).alias("value")).write.mode("overwrite").text(f"{path}/settings")
    return path


def read_compact(spark: SparkSession, path: str) -> CompactPrefixes:
    settings = json.loads(spark.read.text(f"{path}/settings").first()[0])
    cfg = PrefixConfig(**settings["cfg"])
    read = lambda name: spark.read.schema(StructType.fromJson(settings[name])).parquet(f"{path}/{name}")
    return CompactPrefixes(read("blocks"), read("places"), cfg, settings["longest"])
