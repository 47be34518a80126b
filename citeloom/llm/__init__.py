"""Operations of a training-data pipeline on Spark DataFrames.

Every module holds one operator with its own interface; ``queries`` holds the
thin registered queries over the standard tables.
"""
