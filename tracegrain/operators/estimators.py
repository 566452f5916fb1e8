"""Capacity estimates of a served model: weights, parallelism, cache and batch sizes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GIB = 1024.0**3


def dtype_bytes(dtype: Column) -> Column:
    small = F.lower(dtype)
    return F.when(small.isin("int8", "fp8", "w8a8"), 1.0).when(small.isin("int4", "w4a8"), 0.5).when(small.isin("fp32", "float32"), 4.0).otherwise(2.0)


def parameters(hidden: Column, inter: Column, layers: Column, heads: Column, kv_heads: Column, vocab: Column) -> Column:
    """Attention, gated feed-forward and both embeddings of a dense decoder."""
    head = hidden / heads
    attention = 2 * hidden * hidden + 2 * hidden * kv_heads * head
    return layers * (attention + 3 * hidden * inter) + 2 * vocab * hidden


def tensor_parallel(cards: Column, heads: Column) -> Column:
    """The largest divisor of the cards that also divides the heads."""
    fits = F.filter(F.sequence(F.lit(1), cards), lambda n: (cards % n == 0) & (heads % n == 0))
    return F.array_max(fits)


def cache_bytes_per_token(layers: Column, kv_heads: Column, head: Column, tp: Column, size: Column | float = 2.0) -> Column:
    return 2 * layers * F.ceil(kv_heads / tp) * head * size


def batch_capacity(cache_bytes: Column, per_token: Column, tokens: Column) -> Column:
    return F.floor(cache_bytes / (per_token * tokens))


def first_of(*candidates: Column) -> Column:
    """The first estimate that is known: a ladder from measured to derived."""
    return F.coalesce(*candidates)


#: Limits of sequences in one batch by platform and kind of model, and of tokens in one batch by platform.
MOST_SEQUENCES = {("npu", False): 512, ("npu", True): 384, ("gpu", False): 4096, ("gpu", True): 512}
MOST_TOKENS = {"npu": 32768, "gpu": 131072}
#: Margin above input and output by how many of grouped heads and small weights a model has.
MARGINS = (1024, 2048, 3192)
ALIGNED_TO, SHORT_TOTAL, SHORT_CONTEXT = 1024, 5000, 8192
#: Factor of the prefill share by what is aimed at.
PREFILL_FACTORS = {"throughput": 0.22, "balanced": 0.15, "ttft": 0.08}
#: Memory bandwidth in GB/s by platform, and milliseconds of a step that no batch size changes.
BANDWIDTH = {"npu": 1000.0, "gpu": 1500.0}
STEP_OVERHEAD_MS = 5.0
#: What stands for no limit.
UNLIMITED = 10**9


def _chosen(key: Column, values: dict, otherwise) -> Column:
    out = F.lit(otherwise)
    for name, value in values.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def sequences_ceiling(platform: Column, experts: Column, override: Column) -> Column:
    """The most sequences in one batch; the override, where it is above 0, counts on npu only."""
    usual = F.when(experts, _chosen(platform, {p: v for (p, e), v in MOST_SEQUENCES.items() if e}, 512)).otherwise(_chosen(platform, {p: v for (p, e), v in MOST_SEQUENCES.items() if not e}, 4096))
    return F.when((platform == "npu") & (override > 0), override).otherwise(usual)


def tokens_ceiling(platform: Column, override: Column) -> Column:
    return F.when((platform == "npu") & (override > 0), override).otherwise(_chosen(platform, MOST_TOKENS, 131072))


def context_margin(heads: Column, kv_heads: Column, dtype: Column) -> Column:
    """Sparser caches leave room for a wider margin."""
    sparse = (F.greatest(kv_heads, F.lit(1)) < F.greatest(heads, F.lit(1))).cast("int") + (dtype_bytes(dtype) <= 1.0).cast("int")
    return F.element_at(F.array(*(F.lit(m) for m in MARGINS)), sparse + 1)


def model_length(most: Column, tokens_in: Column, tokens_out: Column, margin: Column) -> Column:
    """Context to serve: fixed for short work, else what the work needs with the margin, rounded up; never above the model's own."""
    total = tokens_in + tokens_out
    needed = F.ceil((total + margin) / ALIGNED_TO) * ALIGNED_TO
    return F.least(most.cast("bigint"), F.when(total < SHORT_TOTAL, F.lit(SHORT_CONTEXT).cast("bigint")).otherwise(needed))


def prefill_share(target: Column, tokens_in: Column, length: Column) -> Column:
    """Share of the sequences that are in prefill at one time, from 0.02 to 0.5; unknown aims count as balanced."""
    ratio = tokens_in / F.greatest(length, F.lit(1))
    return F.greatest(F.lit(0.02), F.least(F.lit(0.5), _chosen(target, PREFILL_FACTORS, PREFILL_FACTORS["balanced"]) * ratio * ratio))


def bandwidth_ceiling(platform: Column, slo_ms: Column, tokens: Column, per_token: Column) -> Column:
    """The most sequences whose caches can be read within the time for one output token; UNLIMITED where no time, tokens or bytes are given."""
    left = F.greatest(F.lit(1.0), slo_ms - STEP_OVERHEAD_MS)
    fits = F.floor(left * _chosen(platform, BANDWIDTH, BANDWIDTH["gpu"]) / (tokens * per_token / 1e9 * 1000.0))
    bounded = F.coalesce((slo_ms > 0) & (tokens > 0) & (per_token > 0), F.lit(False))
    return F.when(bounded, F.greatest(F.lit(1), fits)).otherwise(F.lit(UNLIMITED)).cast("bigint")
