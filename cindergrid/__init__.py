"""cindergrid: entity-by-period panel analytics expressed as Spark jobs.

Every operator takes DataFrames plus column names and returns a DataFrame;
nothing is tied to one dataset.  Sub-packages:

* ``sources``   readers (parquet/CSV/JSON, latest-record pick) and writers
* ``functions`` column-level helpers (null-keeping clip, coercion, labels)
* ``operators`` cleaning, panel/window features, splits and sampling,
                statistics, metrics, kernels, reports
* ``models``    Spark ML wrappers with the reference's settings
* ``plans``     composite jobs and the driver-table queries
* ``streaming`` intentionally empty (the reference has no streams)
"""

from cindergrid.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
