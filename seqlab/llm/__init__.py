"""Operators of a training-data pipeline: decontamination, near-duplicate removal,
secret and licence scans, quality scoring, sharding and mixing.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.  Common
conventions, which each operator's docstring only adds to:

* every input row gives one output row unless the operator removes rows;
* a null text counts as an empty one;
* rows with equal ``doc_id`` and equal text are one document and get one result;
* columns that an operator does not name are ignored, whatever they are called.
"""
