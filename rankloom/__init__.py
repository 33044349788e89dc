"""rankloom: batch retrieval, ranking and evaluation over a text catalog, on Spark.

Every public function takes and returns DataFrames or Columns; nothing is
collected to the driver except one-row scalars and size checks.
"""

__version__ = "0.1.0"
