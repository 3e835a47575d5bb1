"""Batch analytics on Spark for hyperlink mining, text deduplication and coreference scoring."""
