"""rosterforge: competitive-event, retrieval and detection analytics on Spark."""

import sys

from pyspark import cloudpickle

from rosterforge.session import build_session, durable_checkpoint

# Ship the package's functions with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "durable_checkpoint"]
