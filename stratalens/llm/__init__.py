"""Training-data operators: ten distributed building blocks for corpus preparation.

Nothing outside this folder imports it; ``corpus_pipeline.py`` and
``__spark_entry__.py`` reach it through :mod:`stratalens.llm.queries`.
"""
