"""Texts as column expressions: numbers for people, call paths, titles, maps of ranks, severities, findings and dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracegrain.functions.scalars import shortened, starts_with_any


def tokens_text(n: Column) -> Column:
    """1.2M, 123K or the whole number itself. Rounded as C's printf rounds the double of the quotient: halves by what it truly holds."""
    n = n.cast("bigint")
    thousands, rest = F.floor(n / 1_000), n % 1_000
    thousands += ((rest > 500) | ((rest == 500) & (thousands % 2 == 1))).cast("int")  # a half of a thousand is a double, so it goes to even
    tenths, rest = F.floor(n / 100_000), n % 100_000
    # most halves of a tenth are no doubles: v = n / 1e6 is above q / 20 if 4 v > q - 16 v, and doubles hold all three
    v, q = n / 1_000_000.0, (tenths * 2 + 1).cast("double")
    above, below = v * 4 > q - v * 16, v * 4 < q - v * 16
    tenths += ((rest > 50_000) | ((rest == 50_000) & (above | (~below & (tenths % 2 == 1))))).cast("int")
    millions = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("M"))
    return F.when(n >= 1_000_000, millions).when(n >= 1_000, F.concat(thousands.cast("string"), F.lit("K"))).otherwise(n.cast("string"))


#: Frames that a call path leaves out begin with these.
SKIPPED_FRAMES = ("torch::unwind::", "torch::CapturedTraceback::", "std::promise", "std::error_code")


def call_path(frames: Column, most: int = 5) -> Column:
    """Readable call path of JSON frames {name or filename, line}: at most `most`, names cut at 80, line 0 left out."""
    list_of = F.from_json(frames, "array<struct<name:string,filename:string,line:bigint>>")
    named = F.transform(list_of, lambda f: F.struct(F.coalesce(f["name"], f["filename"], F.lit("??")).alias("name"), F.coalesce(f["line"], F.lit(0)).alias("line")))
    kept = F.filter(named, lambda f: ~starts_with_any(f["name"], list(SKIPPED_FRAMES)))
    shown = F.transform(F.slice(kept, 1, most), lambda f: F.when(f["line"] != 0, F.concat(shortened(f["name"], 80), F.lit(":"), f["line"].cast("string"))).otherwise(shortened(f["name"], 80)))
    return F.array_join(shown, " \u2192 ")


def escaped(text: Column) -> Column:
    """Text for a page: the five signs that mean something there, & first."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")), text)


def table_title(title: Column) -> Column:
    """Name of a table from its heading: upper case, escaped underscores as such, up to a space or parenthesis."""
    return F.regexp_extract(F.upper(F.replace(F.trim(title), F.lit("\\_"), F.lit("_"))), r"^([^\s(\uff08]*)", 1)


#: Parts of a training name and of the name it is fused into elsewhere.
FUSED = (("linear_q_down_proj", "fused_qkv_a_proj"), ("linear_kv_down_proj", "fused_qkv_a_proj"))


def fused_pair(train: Column, rollout: Column) -> Column:
    """Whether two keys differ only in that one side fuses the projection."""
    return reduce(Column.__or__, [F.lower(train).contains(a) & F.lower(rollout).contains(b) for a, b in FUSED])


def rank_map(text: Column) -> Column:
    """Items rank=pid:npu,... as rank, pid, npu and error (format, rank, pid or npu), in order; blank items are left out."""
    items = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")

    def item(x: Column) -> Column:
        parts = [F.trim(F.regexp_extract(x, r"^([^=]*)=([^:]*):(.*)$", i)) for i in (1, 2, 3)]
        numbers = [p.try_cast("int") for p in parts]
        error = F.when(~x.rlike(r"^[^=]*=[^:]*:.*$"), "format").when(numbers[0].isNull(), "rank").when(numbers[1].isNull(), "pid").when(numbers[2].isNull(), "npu")
        return F.struct(*(n.alias(name) for n, name in zip(numbers, ("rank", "pid", "npu"), strict=True)), error.alias("error"))

    return F.transform(items, item)


def severity(text: Column, aliases: dict[str, str], default: str) -> Column:
    """Severity by its alias, whatever the case; the default on blank, `error` where no alias fits."""
    small = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    names = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.when(small == "", default).otherwise(F.coalesce(F.try_element_at(names, small), F.lit("error")))


def ago(seconds: Column) -> Column:
    """Time that has passed, in the largest whole unit."""
    out = F.lit("just now")
    for unit, size in (("minute", 60), ("hour", 3600), ("day", 86_400), ("week", 604_800)):
        n = F.floor(seconds / size)
        out = F.when(seconds >= size, F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))).otherwise(out)
    return out


def stamp(time: Column) -> Column:
    """ISO 8601 in the session's zone, which is UTC."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def cell_state(cpu: Column, allowed: Column, target: Column) -> Column:
    """State of a CPU in two sets: overlap, target, allowed or none."""
    a, b = F.coalesce(F.array_contains(allowed, cpu), F.lit(False)), F.coalesce(F.array_contains(target, cpu), F.lit(False))
    return F.when(a & b, "overlap").when(b, "target").when(a, "allowed").otherwise("none")


def without_colours(text: Column) -> Column:
    """Text without terminal colour codes."""
    return F.regexp_replace(text, r"\x1b\[[0-9;]*m", "")


def squeezed(text: Column) -> Column:
    """Text with each run of white space as one space, and none at its ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def json_path(text: Column, path: str, default: str) -> Column:
    """Value at a dotted path of a JSON object, or the default."""
    return F.coalesce(F.get_json_object(text, "$." + path), F.lit(default))


def half_even(value: Column, digits: int) -> Column:
    """Rounding of a double's own decimal digits, halves to even."""
    return F.bround(value, digits)


def coverage(text: Column, items: list[str]) -> Column:
    """Share of the items that a text contains, whatever the case; 1 without items, 0 without text."""
    if not items:
        return F.lit(1.0)
    small = F.lower(F.coalesce(text, F.lit("")))
    return reduce(Column.__add__, [small.contains(x.lower()).cast("int") for x in items]) / F.lit(float(len(items)))


def fenced_object(text: Column, tag: str) -> Column:
    """Text of the JSON object in the first fenced block whose opening line is the tag (a pattern, in either case); null without one."""
    block = F.regexp_extract(text, rf"(?is)```{tag}\s*\n\s*(.*?)\s*```", 1)
    return F.when(block.startswith("{") & F.try_parse_json(block).isNotNull(), block)


def commit_of(text: Column) -> Column:
    """The first commit id of a text: 7 to 40 hex digits as a word, with a letter among them unless it is a whole id; '' without one."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)\b([0-9a-f]{7,40})\b"), 1)
    return F.coalesce(F.get(F.filter(words, lambda w: (F.length(w) == 40) | w.rlike("(?i)[a-f]")), F.lit(0)), F.lit(""))


def branch_of(text: Column) -> Column:
    """What is left of a text of branch and commit without the commit id, words for it and separators; '' if that says unknown."""
    text = F.trim(F.coalesce(text, F.lit("")))
    commit = commit_of(text)
    # ids are hex digits only, so they need no quoting
    bare = F.when(commit == "", text).otherwise(F.regexp_replace(text, F.concat(F.lit(r"(?i)\b"), commit, F.lit(r"\b")), F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?i)\b(commit(?:\s+id)?|sha|revision)\b", ""), r"[()@,，:/|]+", " ")
    bare = F.trim(F.regexp_replace(bare, r"\s+", " "))
    return F.when(F.lower(bare).isin("unknown", "n/a", "na"), "").otherwise(bare)


def score_of(text: Column, label: str) -> Column:
    """What stands as `x/100` after a label and a colon; '' without one."""
    return F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), label + r"[:：]\s*`?([^`\n]+/100)`?", 1))


def numbered_under(text: Column, heading: str) -> Column:
    """Texts of the numbered lines between a bullet that begins with heading and the next bullet."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(x))
    top = F.array_position(F.transform(lines, lambda x: x.startswith(f"- {heading}")), True).cast("int")
    under = F.when(top > 0, F.slice(lines, top + 1, F.size(lines))).otherwise(F.array().cast("array<string>"))
    # a further bullet of the same heading goes on, as the list does
    stops = F.transform(under, lambda x: x.startswith("- ") & ~x.startswith(f"- {heading}"))
    end = F.array_position(stops, True).cast("int")
    kept = F.when(end > 0, F.slice(under, 1, F.greatest(end - 1, F.lit(0)))).otherwise(under)
    return F.transform(F.filter(kept, lambda x: x.rlike(r"^\d+\.\s+")), lambda x: F.regexp_replace(x, r"^\d+\.\s+", ""))
