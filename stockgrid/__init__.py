"""stockgrid: replenishment analytics as Spark DataFrame jobs.

Subpackages: ``functions`` (column expressions), ``sources`` (inputs and
storage layout), ``operators`` (the grid and everything around it), ``plans``
(named queries with oracle SQL), ``sinks`` (CSV and gated export) and
``streaming`` (drop-folder ingestion, override stream). ``refresh`` runs the
whole flow over upload files.
"""

__version__ = "0.1.0"
