"""surgekit — column-generic Spark operators for media / engagement analytics.

Layers:
  functions/  Column expressions (no Python UDFs)
  sources/    readers, writers, contracts, raw envelopes, model store, fixture adapter
  operators/  generic table operators (dedup, diff, quantiles, quality, labels, features, ML ...)
  plans/      staging -> intermediate -> mart compositions and the query catalog
  streaming/  Structured Streaming forms of ingest / rollup / snapshot operators
"""

__version__ = "0.1.0"
