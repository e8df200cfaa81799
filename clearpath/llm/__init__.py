"""Operations of a training-data pipeline, each a Spark job over whole tables.

Nothing else in ``clearpath`` imports this subpackage. Modules hold one operator
each; ``registry`` lists their queries and the SQL that states the same results.
"""
