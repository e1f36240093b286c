"""Types of columns that Python functions return, as objects, so that modules load before a session exists."""

from pyspark.sql import types as T

POINTS = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
STRING = T.StringType()
STRINGS = T.ArrayType(T.StringType())
