"""scrubspark: table cleaning, profiling and data-quality grading on Spark DataFrames.

Every operator takes and returns a ``pyspark.sql.DataFrame``.  Statistics that
drive a transform (means, quartiles, modes) are fitted by small aggregate jobs
and applied as literals, in the estimator/transformer style of Spark ML, so the
transform itself is a plain projection that keeps whole-stage codegen and
filter push-down.
"""

from scrubspark.session import checkpoint_dir, get_spark

__all__ = ["get_spark", "checkpoint_dir"]
