"""Typed dataflow on Spark: declared, checked and compiled to one lazy DataFrame plan."""
