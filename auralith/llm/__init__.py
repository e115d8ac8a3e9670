"""Operators for preparing large language-model training corpora.

Self-contained operators (one module each), the registered queries that apply them to the driver tables
(``queries.py``) and small shared helpers (``blocks.py`` for vectorised word scanning inside tasks, ``graphs.py`` for
connected components, ``store.py`` for lineage cuts). Nothing outside this package imports it.
"""
