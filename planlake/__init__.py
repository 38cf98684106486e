"""Spark-first analytics over corpora of structural plan drawings held as entity tables."""
