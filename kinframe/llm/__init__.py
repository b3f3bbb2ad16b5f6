"""Operations of a large training-data pipeline, as Spark jobs.

Nothing else in the library imports this subpackage. Each module holds one
operator with a general interface plus the thin ``opN_*`` query over the tables
of a data folder; :mod:`kinframe.llm.registry` collects queries and SQL.
"""
