"""Operations of a training-data pipeline.

Nothing outside this package imports it; ``queries`` holds the registered
queries and ``oracles`` their SQL.
"""
