"""quern: a PySpark-native document-entity engine.

Named, typed collections of nested documents, stored as Parquet, appended to in
transactions and scanned lazily as DataFrames.  See README.md.
"""

__version__ = "0.1.0"
