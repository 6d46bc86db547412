"""noticeflow: a Spark-native engine for short-lived public notices (job listings).

Every operator is a DataFrame -> DataFrame function (or a Column expression) built
from Spark's own joins, aggregations, windows and column functions.
"""

__version__ = "0.1.0"
