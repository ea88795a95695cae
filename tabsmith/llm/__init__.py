"""Operations of a large-scale training-data pipeline (text and vectors).

One module per operator (``op*.py``); ``queries.py`` registers the checked
queries, ``shards.py`` and ``textkit.py`` hold what several operators share.
Nothing outside this package imports it.
"""
