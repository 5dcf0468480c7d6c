"""Operations of a training-data pipeline over text, as Spark jobs.

Nothing else in the library imports this subpackage.
"""
