"""Training-data operators: each module holds one operator and its thin query.

Nothing outside this folder, ``tests/llm/`` and ``corpus_pipeline.py`` imports it.
"""
