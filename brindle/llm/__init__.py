"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it. Each
module holds one operator with its own general interface; ``queries`` binds
them to the tables of the test data.
"""
