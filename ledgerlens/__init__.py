"""Spark-native event-log reputation engine.

Raw contract logs -> decoded registrations and feedback -> recency-weighted,
confidence-shrunk scores -> global rank -> fixed-schema agent summary, plus the
serving, enrichment and name queries that run on top of the summary.
"""

__version__ = "0.1.0"
