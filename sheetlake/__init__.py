"""sheetlake: analytics over corpora of extracted technical-drawing pages, on Spark.

Every operator is a function from DataFrames to DataFrames.  A corpus is a set
of long tables (primitives, points, texts, pages, images, ...) keyed by
``doc_id, page``; nothing is nested per page, so one very large page or document
is just more rows.
"""

__version__ = "0.1.0"
