"""tokenforge: corpus preparation, pseudo-labelling and distillation analytics
as Spark DataFrame jobs.

Sub-packages
------------
functions  Column -> Column helpers (array / string / math expressions, no UDF)
operators  DataFrame -> DataFrame operators (index, splits, samples, losses, ...)
sources    scans and sinks (parquet / json-lines corpora, indexed token store)
plans      the registered end-to-end queries and their SQL oracles
streaming  Structured Streaming versions of the stateful operators
"""

__version__ = "0.1.0"
