"""Gridded hazard analytics as Spark DataFrame functions.

A raster is a *cell table*: one row per cell, addressed by ``r`` (row), ``c``
(column) and the flat index ``cell = r * width + c``.  Every operator takes and
returns DataFrames; nothing is evaluated until the caller runs an action, apart
from a few bounded summaries that are documented where they occur.
"""
