"""stockflow: demand-to-delivery analytics as Spark DataFrame operators.

Every public function takes DataFrames (and plain parameters) and returns
DataFrames; nothing is collected to the driver. See README.md for the map
from operators to modules.
"""

from stockflow.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
