"""Tables written to the shared folder, to cut lineage and to be read more than once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tracegrain.session import shared_folder


def written(df: DataFrame, name: str, *replaced: DataFrame) -> DataFrame:
    """df as a Parquet table in the folder that driver and executors share; a lost executor costs nothing of it.

    replaced: tables written before that nothing reads any more once this one stands; they are deleted.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for table in replaced:
        dropped(table)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.written_at = path
    return found


def dropped(table: DataFrame) -> None:
    """Delete a table that `written` made. Nothing may read it or what was derived from it lazily afterwards."""
    path = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table.written_at)
    path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
