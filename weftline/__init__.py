"""Declarative generation, enrichment, validation and profiling of tables on Spark."""
