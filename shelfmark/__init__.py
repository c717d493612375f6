"""shelfmark: a document knowledge base expressed as Spark jobs.

Every step works on whole tables: blocks of many documents, chunks of many
documents, hits of many queries.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python tasks travel with their code, so executors need
# no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
