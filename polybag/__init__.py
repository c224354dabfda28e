"""polybag: multi-label, multi-instance dataset preparation and evaluation on Spark.

Operators are plain functions from DataFrame to DataFrame.  Import them from

* ``polybag.sources``    readers and writers (label CSV, images, run logs, reports)
* ``polybag.functions``  column expressions and NumPy pixel kernels
* ``polybag.operators``  labels, splits, bags, batches, scores, metrics, losses, views, runs
* ``polybag.plans``      whole jobs: build a dataset, evaluate, probe
* ``polybag.streaming``  the incremental forms of the same metrics
"""

__version__ = "0.1.0"
