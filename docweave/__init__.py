"""Set-at-a-time document conversion on Spark: HTML corpora in, Markdown, ledgers and metrics out."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Kernels travel with the job, so executors needn't have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
