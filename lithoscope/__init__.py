"""Lithoscope: a PySpark engine that analyses source repositories as tables."""
