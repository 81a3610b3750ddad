"""themeloom: theme mapping of large text corpora, written as Spark DataFrame jobs.

Subpackages
-----------
sources    readers, sinks, the dataset catalog and the corpus adapters
functions  Column -> Column helpers (text cleaning, headings, vectors)
operators  DataFrame -> DataFrame operators (filters, dedupe, joins, stats,
           ranking, retrieval, topics, responses)
plans      whole jobs composed from the operators
streaming  incremental (Structured Streaming) variants of the append-only sources
"""

from themeloom.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
