"""Ordered rows: first differences, runs, transitions, n-grams of operators and walks up a hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.operators.scans import with_keys
from tracegrain.tables import dropped, written

MISSING = "<MISSING>"


def ngrams(rows: DataFrame, keys: list[str], order: list[str], name: str, n: int = 3) -> DataFrame:
    """How often each sequence of n names follows within a group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = rows.select(*[F.lead(name, i).over(w).alias(f"_{i}") for i in range(n)])
    return x.filter(F.col(f"_{n - 1}").isNotNull()).groupBy(F.concat_ws(">", *[f"_{i}" for i in range(n)]).alias("pattern")).agg(F.count("*").alias("n"))


def runs(rows: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Runs of equal names in a row; a name that comes again begins a new run."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = (~F.col(name).eqNullSafe(F.lag(name).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    x = rows.withColumn("_new", changed).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*keys, "run").agg(F.first(name).alias(name), F.min(order).alias("first_at"), F.max(order).alias("last_at"), F.count("*").alias("n"))


def first_difference(rows: DataFrame, keys: list[str], order: str, input_equal: Column, output_equal: Column, *carry: str) -> DataFrame:
    """The first row of each group whose inputs are equal and whose outputs are not."""
    hit = F.struct(F.col(order).alias("at"), *[F.col(c) for c in carry])
    return rows.filter(input_equal & ~output_equal).groupBy(*keys).agg(F.min(hit).alias("x")).select(*keys, "x.*")


def transition(rows: DataFrame, keys: list[str], order: str, good: Column) -> DataFrame:
    """Last good row before the first bad one, the first bad one, and how many rows lie between."""
    bad = rows.withColumn("_good", good).groupBy(*keys).agg(F.min(F.when(~F.col("_good"), F.col(order))).alias("first_bad"))
    x = rows.withColumn("_good", good).join(bad, keys).filter(F.col("first_bad").isNull() | (F.col(order) < F.col("first_bad")))
    last = x.groupBy(*keys).agg(F.max(F.when(F.col("_good"), F.col(order))).alias("last_good"))
    return bad.join(last, keys, "left").withColumn("between", F.greatest(F.col("first_bad") - F.col("last_good") - 1, F.lit(0)))


def previous_good(rows: DataFrame, keys: list[str], order: str, good: Column, name: str) -> DataFrame:
    """For each row, the nearest good row before it in its group."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("previous_good", F.last(F.when(good, F.col(name)), ignorenulls=True).over(w))


def map_differences(left: DataFrame, right: DataFrame, keys: list[str], key: str, value: str) -> DataFrame:
    """Keys whose values differ between two key-value tables; what one lacks is `<MISSING>`."""
    a = left.select(*keys, key, F.col(value).alias("left_value"))
    b = right.select(*keys, key, F.col(value).alias("right_value"))
    both = a.join(b, [*keys, key], "full").withColumn("left_value", F.coalesce("left_value", F.lit(MISSING))).withColumn("right_value", F.coalesce("right_value", F.lit(MISSING)))
    return both.filter("left_value <> right_value")


def json_md5(column: Column) -> Column:
    """name -> md5 of a JSON object whose members are objects; empty for malformed text."""
    members = F.from_json(column, "map<string,string>")
    return F.coalesce(F.map_filter(F.transform_values(members, lambda _, v: F.get_json_object(v, "$.md5")), lambda _, v: v.isNotNull()), F.create_map().cast("map<string,string>"))


def counterpart(node: Column, ours: str = "NPU_", theirs: str = "Bench_") -> Column:
    """A node's id on the other side: the first mark replaced."""
    return F.regexp_replace(node, f"^(.*?){ours}", f"$1{theirs}")


def ancestors(nodes: DataFrame, starts: DataFrame, key: str, parent: str, depth: int = 50) -> DataFrame:
    """Each start's way up: start, node, depth. A way ends at its root, at `depth`, or before it would repeat a node.

    By pointer doubling on written tables: each round joins all ways so far with pointers of twice the last length, so a way of n
    nodes takes log n joins. A key may be a struct (rank and name, say); it has one parent.
    """
    jumps = written(nodes.select(F.col(key).alias("node"), F.col(parent).alias("above")).filter("node is not null and above is not null").dropDuplicates(["node"]), "jumps")
    ways = written(starts.select(F.col(key).alias("start")).distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("depth")), "ways")
    length = 1
    while length <= depth:
        longer = ways.join(jumps, "node").select("start", F.col("above").alias("node"), (F.col("depth") + length).alias("depth")).filter(F.col("depth") <= depth)
        more = written(longer, "ways")
        if more.isEmpty():
            dropped(more)
            break
        ways = written(ways.unionByName(more), "ways", ways, more)
        further = jumps.join(jumps.select(F.col("node").alias("above"), F.col("above").alias("_next")), "above").select("node", F.col("_next").alias("above"))
        jumps, length = written(further, "jumps", jumps), 2 * length
    # a circle comes round to nodes that the way has: the first visit counts
    return ways.groupBy("start", "node").agg(F.min("depth").alias("depth"))


def chains(links: DataFrame, starts: DataFrame, key: list[str], parent: str, depth: int = 1000) -> DataFrame:
    """Each start's chain of callers: the key's columns, chain (the last key column of each node, from the start upwards).

    links: the key's columns and the parent's name, within the other key columns. A chain holds at most `depth` + 1 names.
    """
    scope, name = key[:-1], key[-1]
    node = F.struct(*(F.col(c) for c in key))
    above = F.when(F.col(parent).isNotNull(), F.struct(*(F.col(c) for c in scope), F.col(parent).alias(name)))
    found = ancestors(links.select(node.alias("_node"), above.alias("_above")), starts.select(node.alias("_node")), "_node", "_above", depth)
    steps = F.sort_array(F.collect_list(F.struct("depth", F.col(f"node.{name}").alias("name"))))
    return found.groupBy("start").agg(F.transform(steps, lambda x: x["name"]).alias("chain")).select("start.*", "chain")


#: Beginnings of op names that fill or copy memory, and of those that give -inf by right.
NOT_COMPUTING = ("torch.empty", "torch.full", "torch.zeros", "torch.ones", "tensor.to", "tensor.clone", "tensor.detach")
NPU_FILLS = r"^npu\.\w*_(empty|full)"
LEGAL_MINUS_INF = ("tensor.masked_fill", "torch.masked_fill", "tensor.where", "torch.where", "tensor.triu", "torch.triu", "tensor.tril", "torch.tril")


def _begins(op: Column, names: tuple[str, ...]) -> Column:
    """Whether the name is one of those, or goes on behind a dot or underscore."""
    pattern = "^(" + "|".join(n.replace(".", r"\.") for n in names) + r")(?![a-z0-9])(?!_(?!\d|\b))"
    return F.lower(op).rlike(pattern)


def computes(op: Column) -> Column:
    """Whether NaN and infinity of the op's values tell anything: not for ops that fill or copy memory."""
    return ~(_begins(op, NOT_COMPUTING) | F.lower(op).rlike(NPU_FILLS))


def anomalous(op: Column, *ends: Column) -> Column:
    """Whether one of a tensor's ends (Max, Min; texts) is nan or infinite; -inf counts only where the op does not give it by right."""
    values = F.array(*(F.lower(F.btrim(e, F.lit(" \t\r\n"))) for e in ends))
    legal = _begins(op, LEGAL_MINUS_INF)
    return F.coalesce(F.exists(values, lambda v: v.isin("nan", "inf", "+inf") | ((v == "-inf") & ~legal)), F.lit(False))


def first_anomalies(tensors: DataFrame, links: DataFrame, stacks: DataFrame, rank: str, op: str, order: str, bad_input: Column, bad_output: Column, parent: str, stack: str, depth: int = 1000) -> DataFrame:
    """Of each rank the first op in execution order with an anomaly in its input or output: rank, op, exec_order, kind, chain and stack.

    kind: input, output or both. links (rank, op, parent): which op called which; stacks (rank, op, stack). Ops that do not compute are passed over.
    """
    x = tensors.filter(computes(F.col(op))).select(rank, op, F.col(order).alias("exec_order"), bad_input.alias("_i"), bad_output.alias("_o")).filter("_i or _o")
    kind = F.when(F.col("_i") & F.col("_o"), "both").when(F.col("_i"), "input").otherwise("output")
    first = x.groupBy(rank).agg(F.min_by(F.struct(op, "exec_order", kind.alias("kind")), F.struct("exec_order", op)).alias("x")).select(rank, "x.*")
    first = written(first, "anomalies")
    found = with_keys(first, chains(links.select(rank, op, parent), first, [rank, op], parent, depth), [rank, op])
    return with_keys(found, stacks.select(rank, op, stack).dropDuplicates([rank, op]), [rank, op])


#: Kinds of node that a drawn way shows, and what they are called.
DRAWN = {"0": "Module", "1": "API"}


def drawn(way: Column) -> Column:
    """Lines of a way (array of struct of kind and name, from the root down): its modules and APIs, each two spaces further in."""
    names = F.create_map(*(F.lit(x) for pair in DRAWN.items() for x in pair))
    shown = F.filter(way, lambda n: F.coalesce(n["kind"].isin(*DRAWN), F.lit(False)))
    arrow = lambda i: F.when(i > 0, "\u2192 ").otherwise("")
    return F.array_join(F.transform(shown, lambda n, i: F.concat(F.repeat(F.lit("  "), i), arrow(i), F.coalesce(n["name"], F.lit("?")), F.lit(" ["), names[n["kind"]], F.lit("]"))), "\n")
