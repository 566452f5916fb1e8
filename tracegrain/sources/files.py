"""Readers of statistics files, logs and dumps, and the sinks beside Parquet. All lazy, all by Spark's own readers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrain.functions.scalars import cpu_list

#: Header names of statistics files, the first that is present wins.
OP_NAMES = ("OP Type", "Op Type", "op_type", "OpType", "Type")
OP_TIMES = ("Total Time(us)", "Total Time (us)", "total_time", "TotalTime")
API_NAMES = ("api name", "API Name", "api_name", "ApiName", "Name", "name")
API_TIMES = ("Time(us)", "Total Time(us)", "Total Time (us)", "total_time", "TotalTime", "Self Time(us)", "Self Time (us)")
COUNTS = ("Count", "count", "Call Count")


def first_present(columns: list[str], names: tuple[str, ...], required: bool = True) -> str | None:
    found = next((n for n in names if n in columns), None)
    if found is None and required:
        raise ValueError(f"none of {', '.join(names)} in {', '.join(columns)}")
    return found


def csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, by header."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def statistics(spark: SparkSession, path: str, names: tuple[str, ...] = OP_NAMES, times: tuple[str, ...] = OP_TIMES) -> DataFrame:
    """op, time and count of a statistics file, whatever its header calls them; bad times count 0, bad or missing counts 1."""
    rows = csv(spark, path)
    op, time, count = first_present(rows.columns, names), first_present(rows.columns, times), first_present(rows.columns, COUNTS, required=False)
    number = lambda c, default: F.coalesce(F.nanvl(F.trim(F.col(f"`{c}`")).try_cast("double"), F.lit(default)), F.lit(default))
    return rows.select(F.col(f"`{op}`").alias("op"), number(time, 0.0).alias("time"), (number(count, 1.0) if count else F.lit(1.0)).alias("n"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that are none are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def _values(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    import json

    decode = json.JSONDecoder().raw_decode
    for column in texts:
        out = []
        for text in column.to_pylist():
            found, at = [], 0
            text = text or ""
            while at < len(text):
                if text[at].isspace():
                    at += 1
                    continue
                try:
                    value, at = decode(text, at)
                except json.JSONDecodeError:
                    break
                if isinstance(value, dict):
                    found.append(json.dumps(value, ensure_ascii=False))
            out.append(found)
        yield pa.array(out, pa.list_(pa.string()))


def concatenated_json(spark: SparkSession, path: str) -> DataFrame:
    """One row (path, index, value) for each object of files of concatenated, pretty-printed JSON, in order; stops at what is no JSON."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return texts.select("path", F.posexplode(F.arrow_udf(_values, "array<string>")("value")).alias("index", "value"))


def _members(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    import json

    kind = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
    for column in texts:
        out = []
        for text in column.to_pylist():
            try:
                data = json.loads(text or "{}").get("data", {})
            except (ValueError, AttributeError):
                data = {}
            out.append([{"name": k, "value": json.dumps(v)} for k, v in data.items()] if isinstance(data, dict) else [])
        yield pa.array(out, kind)


def tensor_dump(spark: SparkSession, path: str) -> DataFrame:
    """rank, exec_order, name and value of dump.json files under rankN folders; the order of a file's keys is the order of execution."""
    texts = spark.read.text(path, wholetext=True).select(F.coalesce(F.regexp_extract("_metadata.file_path", r"rank(\d+)/[^/]*$", 1).try_cast("int"), F.lit(0)).alias("rank"), "value")
    return texts.select("rank", F.posexplode(F.arrow_udf(_members, "array<struct<name:string,value:string>>")("value")).alias("exec_order", "m")).select("rank", "exec_order", "m.name", "m.value")


def has_nan(parameters: Column) -> Column:
    """Whether any element of a JSON list or object of tensors has Max or Min 'nan'."""
    listed = F.coalesce(F.from_json(parameters, "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))
    named = F.coalesce(F.map_values(F.from_json(parameters, "map<string,map<string,string>>")), F.array().cast("array<map<string,string>>"))
    bad = lambda m: F.coalesce((F.lower(F.trim(m["Max"])) == "nan") | (F.lower(F.trim(m["Min"])) == "nan"), F.lit(False))
    return F.exists(F.concat(listed, named), bad)


def processes(spark: SparkSession, path: str) -> DataFrame:
    """pid, ppid, user and command of `ps -eo pid,ppid,user,args` text; kernel threads are left out."""
    parts = r"^\s*(\d+)\s+(\d+)\s+(\S+)\s+(.*)$"
    rows = spark.read.text(path).filter(F.col("value").rlike(parts))
    x = rows.select(*(F.regexp_extract("value", parts, i).cast(kind).alias(name) for i, (name, kind) in enumerate((("pid", "bigint"), ("ppid", "bigint"), ("user", "string"), ("command", "string")), 1)))
    return x.filter("pid <> 2 and ppid <> 2")


def cpu_quota(text: Column) -> Column:
    """CPUs of a cgroup's `quota period`; null for `max`."""
    parts = F.split(F.trim(text), r"\s+")
    return F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double"))


def topology(spark: SparkSession, path: str) -> DataFrame:
    """source, target and link of a whitespace matrix with a header line; a device's link to itself is left out."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")).alias("i", "line"), F.col("_metadata.file_path").alias("path"))
    cells = rows.select("path", "i", F.split(F.trim("line"), r"\s+").alias("c"))
    head = cells.filter("i = 0").select("path", F.col("c").alias("head"))
    x = cells.filter("i > 0").join(head, "path").select(F.col("c")[0].alias("source"), F.posexplode("head").alias("j", "target"), "c").withColumn("link", F.get("c", F.col("j") + 1))
    return x.filter("link is not null and source <> target").select("source", "target", "link")


def _numbered(spark: SparkSession, pattern: str, number: str) -> DataFrame:
    """number (from the path) and text of small files, each whole."""
    rows = spark.read.text(pattern, wholetext=True)
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), number, 1).try_cast("int").alias("number"), F.trim(F.regexp_replace("value", r"[\r\n]+", " ")).alias("text")).filter("number is not null")


def node_distances(spark: SparkSession, root: str) -> DataFrame:
    """node and distances of `devices/system/node/nodeN/distance`; empty files and rows with anything but numbers are left out."""
    rows = _numbered(spark, f"{root}/devices/system/node/node*/distance", r"/node(\d+)/distance$")
    parts = F.split("text", r"\s+")
    return rows.filter((F.col("text") != "") & F.forall(parts, lambda x: x.rlike(r"^[+-]?\d+$"))).select(F.col("number").alias("node"), F.transform(parts, lambda x: x.try_cast("int")).alias("distances"))


def thread_siblings(spark: SparkSession, root: str) -> DataFrame:
    """cpu and siblings (ordered) of the CPUs that are online; a CPU without a readable list is its own."""
    online = spark.read.text(f"{root}/devices/system/cpu/online", wholetext=True).select(F.explode(cpu_list(F.col("value"))).alias("cpu"))
    rows = _numbered(spark, f"{root}/devices/system/cpu/cpu*/topology/thread_siblings_list", r"/cpu(\d+)/topology/thread_siblings_list$")
    parts = F.split(F.regexp_replace("text", r"\s", ""), ",")
    low, high = (lambda x: F.split_part(x, F.lit("-"), F.lit(1)).try_cast("int")), (lambda x: F.element_at(F.split(x, "-"), -1).try_cast("int"))
    sound = F.forall(F.filter(parts, lambda x: x != ""), lambda x: x.rlike(r"^\d+(-\d+)?$") & (low(x) <= high(x)))
    listed = rows.filter((F.col("text") != "") & sound).select(F.col("number").alias("cpu"), cpu_list(F.col("text")).alias("siblings"))
    return online.join(listed, "cpu", "left").select("cpu", F.coalesce("siblings", F.array("cpu")).alias("siblings"))


def sections(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, title and body of the `## ` sections of Markdown texts."""
    parts = F.filter(F.split(text, r"(?m)^## "), lambda p: p != "")
    x = texts.select(key, F.posexplode(parts).alias("index", "part"))
    return x.select(key, "index", F.trim(F.substring_index("part", "\n", 1)).alias("title"), F.regexp_replace(F.regexp_replace("part", r"^[^\n]*\n?", ""), r"^\s+|\s+$", "").alias("body"))


def ranks_of(paths: DataFrame, most_depth: int = 6) -> DataFrame:
    """rank and folder of profiler_info_N.json files (path), not deeper than most_depth; the last path of a rank counts."""
    x = paths.withColumn("rank", F.nullif(F.regexp_extract("path", r"profiler_info_(\d+)\.json$", 1), F.lit("")).try_cast("int")).filter("rank is not null")
    x = x.filter(F.size(F.split("path", "/")) <= most_depth + 1)
    return x.groupBy("rank").agg(F.max("path").alias("path")).select("rank", F.regexp_replace("path", "/[^/]*$", "").alias("folder"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; lists and structs as JSON."""
    plain = [F.to_json(F.col(c)).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in df.dtypes]
    df.select(*plain).write.mode("overwrite").csv(path, header=True)


def markdown(df: DataFrame, most: int = 100) -> str:
    """A Markdown table of at most `most` rows, numbers with four digits; a longer result is an error."""
    rows = guarded(df, most)
    text = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(text, r)) + " |" for r in rows)])


def guarded(df: DataFrame, most: int) -> list:
    """Rows of a result that must not exceed `most`."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"RESULT_TOO_LARGE: more than {most} rows")
    return rows
