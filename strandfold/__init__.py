"""Expression-cohort analytics on Spark: long tables in, long tables out."""

import sys

from pyspark import cloudpickle

from .models.burden import BurdenModel
from .models.multilabel import MultiLabelModel
from .operators.cohort import Cohort

# Task functions travel with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["BurdenModel", "Cohort", "MultiLabelModel"]
