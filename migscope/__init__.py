"""migscope: migration-assessment and data-reconciliation jobs on Spark.

Subpackages
-----------
sources    corpus scans, admission, line explode, generated corpora, sinks
functions  Column-level helpers (JS-compatible trim/round, ordered first-seen lists)
operators  per-file mining jobs (COBOL, DDL, PostgreSQL features, Java, ORM) and
           migration data checks (reconciliation, diff, orphans, ...)
plans      project roll-ups, scores, risks, report rows, dimension tables
streaming  Structured Streaming twins (incremental landing, delta sync, alerts)
"""

from migscope.session import get_spark, checkpoint_dir  # noqa: F401
