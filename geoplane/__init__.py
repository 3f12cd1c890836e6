"""geoplane: geospatial feature-collection analytics expressed as Spark plans.

Feature collections are ordinary DataFrames: an ``id`` column, property
columns, a ``geom`` struct (see :mod:`geoplane.schema`) and four top-level
bounding-box columns ``_xmin, _ymin, _xmax, _ymax`` that Parquet statistics
can prune on.  Every operator is a function from DataFrames/Columns to
DataFrames/Columns, so Catalyst sees one declarative plan per query.
"""

__version__ = "0.1.0"
