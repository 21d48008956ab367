"""gridweave: table structure analytics as Spark DataFrame transformations.

Input tables hold detection boxes, class scores and text boxes keyed by an
image (or page / cluster) id. Every public operator takes DataFrames and
returns DataFrames; the heavy lifting is Catalyst expressions, joins and
aggregations, with Python workers only for pixel preparation and scoring.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package run inside Python workers (pixel jobs, scorers).
# Pickling them by value means executors need no installed copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from gridweave.session import ensure_checkpoint_dir, get_session  # noqa: E402

__all__ = ["get_session", "ensure_checkpoint_dir"]
__version__ = "0.1.0"
