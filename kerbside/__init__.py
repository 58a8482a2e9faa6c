"""kerbside: household collection schedules as Spark DataFrame operators.

Every public operator is a function ``DataFrame -> DataFrame`` built from
Spark's own Column expressions.  Lookups take a *request DataFrame* and
answer all of it in one job; a single lookup is a one-row request.
"""

from kerbside.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
