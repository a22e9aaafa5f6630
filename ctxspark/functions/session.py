"""What operators need of a session: a folder that the driver and all executors share, and unions that can be trusted."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, from the session's settings. Where none is set, a temporary one serves in a single process;
    on a cluster that is an error, since executors could not read a folder of the driver's own."""
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have is None:
        have = spark.conf.get("spark.checkpoint.dir", None)
        if not have:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            have = tempfile.mkdtemp(prefix="ctxspark-")
        sc.setCheckpointDir(have)
        have = sc.getCheckpointDir()
    return have


def sound_unions(spark: SparkSession) -> None:
    """Keeps Spark 4.1 from taking a union's parts for partitioned alike. Where adaptive execution has coalesced them
    differently, grouping such a union by their key gives a key several rows."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
