"""SQL that only reads: checked on the parsed plan, not on how the text begins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Logical nodes that change something or run a command, by how their names end or begin.
COMMANDS = ("Command", "Statement", "CreateView", "CreateTable", "CreateNamespace", "DropTable", "DropView", "DropNamespace", "SetCatalogAndNamespace", "DeleteFromTable", "UpdateTable", "MergeIntoTable", "CacheTable", "UncacheTable", "RefreshTable", "TruncateTable", "LoadData", "AlterTable", "ReplaceTable", "AddColumns", "RenameTable")


def is_read_only(spark: SparkSession, sql: str) -> bool:
    """Whether a statement is one query. Anything that cannot be parsed is not."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception:
        return False

    def nodes(p):
        yield p.getClass().getSimpleName()
        below = p.children()
        inner = p.innerChildren()
        for some in (below, inner):
            for i in range(some.size()):
                child = some.apply(i)
                if hasattr(child, "children") and hasattr(child, "innerChildren"):
                    yield from nodes(child)

    return not any(name.endswith(COMMANDS) or name.startswith(("Insert", "Create", "Drop", "Alter", "Replace")) for name in nodes(plan))


def query(spark: SparkSession, sql: str, limit: int | None = None) -> DataFrame:
    if not is_read_only(spark, sql):
        raise PermissionError("only queries are allowed")
    df = spark.sql(sql)
    return df if limit is None else df.limit(limit)
