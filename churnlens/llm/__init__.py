"""Corpus operators for training-data preparation.

One module per operator, ``queries.py`` for the registered queries and
``sql.py`` for their DuckDB twins.  Nothing outside this folder (and
``corpus_pipeline.py``) imports it.
"""
