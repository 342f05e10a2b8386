"""trailcast: next-activity analytics on event logs, written as Spark DataFrame operators.

Layers:
  sources/    readers that turn event logs, prefix tables, run histories into DataFrames
  sinks/      writers (partitioned, overwrite / append)
  functions/  Column -> Column scalar expressions (text rendering, parsing, naming)
  operators/  DataFrame -> DataFrame operators (ranking, traces, prefixes, splits,
              similarity join, rerank, prompts, prediction, metrics, runs)
  plans/      composite jobs (build dataset, build vectors, evaluate, evaluate grid)
  streaming/  incremental prefix emission for live event streams
"""

__version__ = "0.1.0"
