"""Spark-native analytics for sparse gene-by-cell count matrices."""

import sys

from pyspark import cloudpickle

# Vectorised functions travel to the executors with their code, so the package needs to be
# installed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from quillcell.matrix import Matrix  # noqa: E402
from quillcell.params import PipelineParams  # noqa: E402
from quillcell.session import build_session  # noqa: E402

__version__ = "0.1.0"
__all__ = ["Matrix", "PipelineParams", "build_session"]
