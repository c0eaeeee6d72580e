"""Loomline: record, text, graph and event-stream analytics as plain Spark jobs.

Every operator is a ``DataFrame -> DataFrame`` function for ``df.transform``.
"""

__version__ = "0.1.0"
