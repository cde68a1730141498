"""CreditLens: consumer credit-risk analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from creditlens.session import build_session, shared_dir, write_stage

__all__ = ["build_session", "shared_dir", "write_stage"]

# Functions of this package travel to the workers whole, so that a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
