"""Declarations, their checks, and their compilation to one lazy DataFrame plan."""
