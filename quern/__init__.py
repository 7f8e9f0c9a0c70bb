"""quern: corpus analytics on PySpark.

Readers, text functions, relational and order-dependent operators, reports and
streaming variants for building text corpora.  Everything is a function from
DataFrames to DataFrames; Catalyst plans it.
"""

__version__ = "0.1.0"
