"""Scalar rules as column expressions: names, numbers, sets of CPUs, shapes and scores. No Python runs on rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- names ----


def op_type(name: Column) -> Column:
    """Type of a communication op: what stands before @ and __, without hcom_; else the first token; `unknown` if empty."""
    head = F.substring_index(F.substring_index(name, "@", 1), "__", 1)
    kind = F.when(head.startswith("hcom_"), F.regexp_replace(head, "^hcom_", "")).otherwise(F.substring_index(head, "_", 1))
    return F.when(F.coalesce(kind, F.lit("")) == "", "unknown").otherwise(kind)


def op_and_suffix(key: Column) -> tuple[Column, Column]:
    """An op key cut at its first @."""
    return F.substring_index(key, "@", 1), F.when(key.contains("@"), F.regexp_extract(key, "^[^@]*@(.*)$", 1)).otherwise("")


def api_parts(name: Column) -> Column:
    """api, direction and index of `api.input.index` or `api.output.index`; input is tried first; nulls if neither fits."""

    def parts(direction: str) -> Column:
        pattern = rf"^(.*)\.{direction}\.(.+)$"
        return F.when(name.rlike(pattern), F.struct(F.regexp_extract(name, pattern, 1).alias("api"), F.lit(direction).alias("direction"), F.regexp_extract(name, pattern, 2).alias("index")))

    return F.coalesce(parts("input"), parts("output"))


def number_after(text: Column, label: str, default: int = 0) -> Column:
    """First number after a label, such as the rank in a file name."""
    return F.coalesce(F.regexp_extract(text, rf"{label}(\d+)", 1).try_cast("int"), F.lit(default))


def layer_index(key: Column) -> Column:
    return F.nullif(F.regexp_extract(key, r"\.layers\.(\d+)\.", 1), F.lit("")).try_cast("int")


#: Kinds of block and what their parameters' names contain, the first match wins.
BLOCKS = (("mlp", (".mlp.",)), ("attn", ("self_attn", "self_attention", "attention")), ("norm", ("norm",)), ("embed", ("embed",)))


def block_kind(key: Column) -> Column:
    """Block that a parameter belongs to; the first that its name contains."""
    small = F.lower(key)
    found = F.lit("other")
    for kind, parts in reversed(BLOCKS):
        found = F.when(reduce(Column.__or__, [small.contains(w) for w in parts]), kind).otherwise(found)
    return found


#: Thread classes and the patterns that name them, the first match wins; and what each class is worth.
THREAD_CLASSES = (
    ("sq_task", r"^dev(\d+)_sq(?:_task)?$"),
    ("npu_fixed", r"^(release_thread|acl_thread|pt_data_pin|pt_autograd_\d+|data_pin)$"),
    ("communication", r"hccl|nccl|comm(?:unication)?"),
    ("blas_worker", r"blas|mkl|openblas"),
    ("openmp_worker", r"omp|openmp"),
    ("dataloader", r"dataloader|data_worker|pt_data"),
    ("api_server", r"api[_-]?server|openai"),
    ("scheduler", r"scheduler|manager"),
    ("tokenizer", r"tokenizer"),
    ("engine_worker", r"worker|engine|local[_-]?rank"),
)
THREAD_SCORES = {"main_scheduler": 100, "sq_task": 95, "communication": 85, "npu_fixed": 80, "dataloader": 70, "engine_worker": 65, "tokenizer": 60, "scheduler": 60, "api_server": 55, "blas_worker": 50, "openmp_worker": 50, "unknown": 0}


def thread_class(name: Column, tid: Column, pid: Column) -> Column:
    found = F.lit(None).cast("string")
    for kind, pattern in reversed(THREAD_CLASSES):
        found = F.when(name.rlike(f"(?i){pattern}"), kind).otherwise(found)
    return F.coalesce(found, F.when(tid == pid, "main_scheduler").otherwise("unknown"))


def thread_score(kind: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in THREAD_SCORES.items() for x in pair))[kind], F.lit(0))


def redacted_command(command: Column) -> Column:
    """A command line with the values of secret-looking `key=value` and `--key value` replaced."""
    key = r"(?i)([\w-]*(?:token|password|passwd|secret|api[_-]?key|access[_-]?key|credential)[\w-]*)"
    return F.regexp_replace(F.regexp_replace(command, key + r"=(\S+)", "$1=REDACTED"), r"(--?)" + key.replace("(?i)", "(?i:") + r")\s+(?!-)(\S+)", "$1$2 REDACTED")


def redacted_text(text: Column) -> Column:
    """Free text with the value of `key = "value"` replaced, spaces around the sign included (an extension)."""
    return F.regexp_replace(text, r"""(?i)\b(token|password|passwd|secret|api[_-]?key)(["']?\s*[:=]\s*["']?)([^\s"']+)""", "$1$2REDACTED")


def shortened(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def file_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"(?U)[^\w\-]+", "-"), "-+", "-"), "^-+|-+$", "")


def glob_pattern(glob: str) -> str:
    """A Java regular expression for a shell glob of *, ? and literal text."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, f"\\Q{c}\\E") for c in glob) + "$"


def matches_globs(value: Column, globs: list[str]) -> Column:
    """At least one plain glob fits and none with a leading `!` does; false without plain globs."""
    plain = [g for g in globs if not g.startswith("!")]
    barred = [g[1:] for g in globs if g.startswith("!")]
    fits = lambda some: reduce(Column.__or__, [value.rlike(glob_pattern(g)) for g in some], F.lit(False))
    return fits(plain) & ~fits(barred)


def starts_with_any(value: Column, prefixes: list[str]) -> Column:
    return reduce(Column.__or__, [value.startswith(p) for p in prefixes], F.lit(False))


# ---- numbers ----


def safe_double(value: Column) -> Column:
    """0 for what is null, blank, no number, NaN or infinite."""
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), 0.0).otherwise(number)


def ratio(slow: Column, fast: Column) -> Column:
    """slow over fast; where fast is 0: infinite if slow is not, else 1."""
    return F.when(fast != 0, slow / F.nullif(fast, F.lit(0.0))).when(slow != 0, float("inf")).otherwise(1.0)


def relative_error(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(b), F.lit(1e-12))


def error_bucket(a: Column, b: Column, ok: float = 1e-4, warn: float = 1e-2) -> Column:
    error = relative_error(a, b)
    return F.when(error.isNull(), "missing").when(error <= ok, "ok").when(error <= warn, "warn").otherwise("alert")


def bytes_text(size: Column) -> Column:
    """A size for people; halves go to the even digit."""
    of = lambda unit, power, digits: F.format_string(f"%.{digits}f {unit}", F.bround(size / 1024.0**power, digits))
    return F.when(size < 1024, of("B", 0, 0)).when(size < 1024**2, of("KB", 1, 1)).when(size < 1024**3, of("MB", 2, 1)).otherwise(of("GB", 3, 2))


def token_estimate(text: Column) -> Column:
    return F.floor(F.char_length(text) / 4)


def efficiency(calls: Column, budget: int = 20, penalty: float = 0.02, floor: float = 0.5) -> Column:
    """1 less a penalty for each call over budget, between floor and 1."""
    return F.greatest(F.lit(floor), F.least(F.lit(1.0), 1.0 - F.greatest(calls - budget, F.lit(0)) * penalty))


def gated_score(rubric: Column, gates: Column) -> Column:
    """A rubric of 0 to 5 as a share, 0 if a gate failed."""
    return F.when(gates, F.greatest(F.lit(0.0), F.least(F.lit(5.0), rubric)) / 5.0).otherwise(0.0)


def cpu_percent(start: Column, end: Column, seconds: Column, ticks: int = 100) -> Column:
    return F.when(seconds > 0, F.greatest(F.lit(0.0), (end - start) * 100.0 / ticks / F.nullif(seconds, F.lit(0.0)))).otherwise(0.0)


def gemm_flops(m: Column, n: Column, k: Column, batch: Column | int = 1) -> Column:
    return F.lit(2.0) * batch * m * n * k


def attention_flops(batch: Column, heads: Column, q: Column, kv: Column, dq: Column, dv: Column, sparse_mode: int = 0) -> Column:
    """Both products of attention; causal modes 2 and 3 skip what the mask hides."""
    full = F.lit(2.0) * batch * heads * q * kv * (dq + dv)
    if sparse_mode == 0:
        return full
    hidden = F.when(q == kv, F.lit(0.5)).when(q > kv, 0.5 * kv / q).otherwise(1 - 0.5 * q / kv)
    return full * hidden


def mfu(flops: Column, seconds: Column, peak_tflops: Column | float) -> Column:
    return flops / F.nullif(seconds, F.lit(0.0)) / 1e12 / peak_tflops


def mfu_band(share: Column) -> Column:
    return F.when(share < 0.2, "low").when(share < 0.3, "between").when(share <= 0.6, "fair").when(share <= 0.7, "between").otherwise("high")


def wait_pattern(start_span: Column, end_span: Column, skew: Column, earliest: Column, longest: Column) -> Column:
    strong = (start_span > 0) & (end_span <= F.greatest(F.lit(1.0), 0.1 * start_span)) & (skew > 0) & (earliest == longest)
    return F.when(strong, "strong_wait_like").when((end_span < start_span) & (skew > 0), "weak_wait_like").otherwise("not_obvious")


# ---- sets and shapes ----


def cpu_list(text: Column) -> Column:
    """CPUs of a range list such as 0-3,8, ordered; a reversed range is an error."""
    parts = F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", ""), ","), lambda p: p != "")

    def cpus(part: Column) -> Column:
        low, high = F.split_part(part, F.lit("-"), F.lit(1)).cast("int"), F.element_at(F.split(part, "-"), -1).cast("int")
        return F.when(low > high, F.raise_error(F.concat(F.lit("reversed CPU range "), part)).cast("array<int>")).otherwise(F.sequence(low, F.greatest(low, high)))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, cpus))))


def cpu_text(cpus: Column) -> Column:
    """Ordered distinct CPUs as a range list."""

    def ranges(own: Column) -> Column:
        # neighbours tell where a range begins and ends
        start = F.filter(own, lambda x, i: (i == 0) | (F.get(own, i - 1) != x - 1))
        stop = F.filter(own, lambda x, i: (i == F.size(own) - 1) | (F.get(own, i + 1) != x + 1))
        return F.zip_with(start, stop, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit("-"), b.cast("string"))))

    # as an element of an array the set is worked out once, not for each CPU
    return F.array_join(F.get(F.transform(F.array(cpus), ranges), F.lit(0)), ",")


def is_subset(part: Column, whole: Column) -> Column:
    """Whether all of a non-empty set is in the other; an empty one is in none."""
    return (F.size(part) > 0) & (F.size(F.array_except(part, whole)) == 0)


def numel(shape: Column) -> Column:
    return F.aggregate(shape, F.lit(1).cast("bigint"), lambda a, x: a * x)


def shape_relation(a: Column, b: Column) -> Column:
    bare = lambda s: F.filter(s, lambda x: x != 1)
    return (
        F.when(a.isNull() | b.isNull(), "unknown").when(a == b, "exact_match").when(bare(a) == bare(b), "singleton_compatible_numel_match")
        .when(numel(a) == numel(b), "numel_match").otherwise("numel_mismatch")
    )


def priority(mismatch: Column, relation: Column) -> Column:
    """P1 to P4 of a compared value, by numeric bucket and shape relation."""
    same = relation.isin("exact_match", "singleton_compatible_numel_match")
    return F.when((mismatch == "alert") & same, "P1").when(mismatch == "alert", "P2").when(mismatch == "warn", "P3").otherwise("P4")


def deltas(cumulative: Column) -> Column:
    """Lengths from cumulative ends."""
    return F.transform(cumulative, lambda x, i: x - F.when(i == 0, 0).otherwise(F.get(cumulative, i - 1)))
