"""Fleet-scale index-health and maintenance analytics on Spark.

Everything takes and returns DataFrames or Columns. There is no session global:
``now`` and the session id of a maintenance run are always arguments.
"""

__version__ = "0.1.0"
