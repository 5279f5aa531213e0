"""Spark-first analytics over code and text corpora: tables in, tables out."""
