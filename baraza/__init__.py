"""Corpus, retrieval, conversation and moderation jobs for public-document question answering on Spark."""

import sys

from pyspark import cloudpickle

# Helpers used inside tasks travel with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
