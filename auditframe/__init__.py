"""auditframe: Spark-native analytics for paired-code audit data.

Pair building, deduplication, three-phase model inference bookkeeping and
score reporting, all expressed as DataFrame plans.
"""

__version__ = "0.1.0"
