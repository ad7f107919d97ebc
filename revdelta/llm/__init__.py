"""Operators that prepare text corpora for training, as Spark jobs."""
