"""Operators of a training-data pipeline over documents, pages and embeddings.

Nothing outside this package imports it; ``__spark_entry__.py`` adds the
queries of :mod:`cindergrid.llm.queries` only when the package is present.
"""
