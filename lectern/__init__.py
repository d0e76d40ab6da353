"""Spoken-edition analytics on Spark: corpus-scale script planning, linting and catalog queries."""
