"""Tables written to the folder that driver and executors share: they cut lineage and can be read more than once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tracegrain.session import shared_folder


def written(df: DataFrame, name: str, *replaced: DataFrame) -> DataFrame:
    """df as a written table; those it replaces, which nothing reads any more once it stands, are deleted."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for old in replaced:
        dropped(old)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def dropped(table: DataFrame) -> None:
    path = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table.written_at)
    path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
