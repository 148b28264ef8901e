"""perfweave: benchmark-telemetry analytics on Spark.

Step-timing logs roll up into a trial fact table; trials are enriched with
GPU specifications, turned into feature columns, evaluated out of sample
(K-fold and leave-one-GPU-out) and summarised in grouped error reports.
Companion jobs build vocabularies and encode text corpora.
"""

__version__ = "0.1.0"
