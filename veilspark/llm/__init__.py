"""Operators for preparing training text at corpus scale.

Each module holds one operator with its own general interface; ``queries``
holds the registered queries and their SQL.  Nothing outside this folder
imports it, apart from ``corpus_pipeline.py`` and the guarded import in
``__spark_entry__.py``.
"""
