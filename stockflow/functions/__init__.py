"""Column expressions (G1-G13). All are built from pyspark.sql.functions so
they stay inside whole-stage codegen; none is a Python UDF."""

from stockflow.functions.scalars import *  # noqa: F401,F403
