"""lotwise: dealer analytics for a wholesale vehicle marketplace, on Spark.

Every operator takes DataFrames plus an explicit ``as_of`` date and returns a
lazy DataFrame computed for all dealers at once.  Nothing in the library
collects data to the driver or calls a Python UDF.
"""

from lotwise.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
