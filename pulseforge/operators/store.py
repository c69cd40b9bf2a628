"""Tables that cut a lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written where all executors find it: in spark.checkpoint.dir. Only where that is unset, and on a local master, a folder of this machine is."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not root and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(root or f"file://{tempfile.mkdtemp(prefix='pulseforge-')}")
    return df.checkpoint()


def laid_out(df: DataFrame, moved: bool = True) -> DataFrame:
    """df, checkpointed so that later plans know how its rows are dealt, and joins by the same keys leave them where they are. An
    adaptive plan does not tell its layout, so this one is planned without. Unless moved, joins in it by more keys than rows are dealt by
    leave them, too."""
    conf = df.sparkSession.conf
    wanted = {"spark.sql.adaptive.enabled": "false"} | ({} if moved else {"spark.sql.requireAllClusterKeysForCoPartition": "false"})
    before = {name: conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            conf.set(name, value)
        return checkpointed(df.select("*"))
    finally:
        for name, value in before.items():
            conf.set(name, value)


def laid_by_record(df: DataFrame) -> DataFrame:
    """df, dealt by record and written so: what follows by record leaves its rows where they are."""
    return laid_out(df.repartition("record_id"))
