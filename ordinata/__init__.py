"""Ordinata: ranking-oriented binary classification as Spark queries.

Set-oriented work (scans, preparation, losses, metrics, order statistics, reports) is written with the DataFrame
and SQL API; order-dependent learners run as grouped-map tasks over a task grid.
"""

__version__ = "0.1.0"
