"""raceboard: competition-results analytics on Spark DataFrames.

Layers (each a plain DataFrame -> DataFrame function, nothing collected):

* ``sources``   staging schemas, CSV ingest, the test-table adapter, sinks
* ``functions`` column expressions (dates, names, colours, predicates)
* ``operators`` reusable relational building blocks (ranking, running totals,
                unpivot, dense metric grids, lap sequences, palettes)
* ``plans``     the warehouse: conformed tables, reports, queries, chart data
* no streaming part: the source workload is a batch rebuild
"""

from raceboard.session import checkpoint_root, get_spark

__all__ = ["get_spark", "checkpoint_root"]
