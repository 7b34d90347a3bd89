"""Conversation-log analytics, corpus preparation and retrieval on Spark.

Every operator takes DataFrames and returns a lazy DataFrame.
"""

from murmur.session import prepare, scratch_dir

__all__ = ["prepare", "scratch_dir"]
