"""Text functions as column expressions. The three tokenizers and their stop lists are not interchangeable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema


def has_any(text: Column, marks: list[str]) -> Column:
    return text.rlike("|".join(f"\\Q{m}\\E" for m in marks))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """Whitespace-separated words; null: null."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def index_tokens(text: Column) -> Column:
    """Words without what is not a letter or digit, lower case, no stop words; repeats stay."""
    bare = F.transform(words(text), lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]", "")))
    return F.filter(bare, lambda w: (w != "") & ~w.isin(schema.INDEX_STOP))


def normalized(text: Column) -> Column:
    """ASCII letters, digits and single spaces, lower case."""
    kept = F.regexp_replace(text, r"[^A-Za-z0-9\s]", "")
    return F.trim(F.regexp_replace(F.lower(kept), r"\s+", " "))


def content_tokens(text: Column) -> Column:
    """The set of normalized words without the second stop list."""
    return F.array_distinct(F.filter(F.split(normalized(text), " "), lambda w: (w != "") & ~w.isin(schema.CONTENT_STOP)))


def containment(a: Column, b: Column) -> Column:
    """Shared elements over the smaller set's size; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def sentences(text: Column, least: int = 6, most: int = 12) -> Column:
    """Words up to one that ends with `.`, `!` or `?`; sentences of at least `least` words, the first `most` of them."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"))

    def step(acc: Column, w: Column) -> Column:
        now = F.concat(acc["open"], F.array(w))
        ends = w.rlike(r"[.!?]$")
        kept = F.when(ends & (F.size(now) >= least), F.concat(acc["done"], F.array(F.array_join(now, " ")))).otherwise(acc["done"])
        return F.struct(kept.alias("done"), F.when(ends, F.array().cast("array<string>")).otherwise(now).alias("open"))

    def finish(acc: Column) -> Column:
        return F.when(F.size(acc["open"]) >= least, F.concat(acc["done"], F.array(F.array_join(acc["open"], " ")))).otherwise(acc["done"])

    return F.slice(F.aggregate(words(text), start, step, finish), 1, most)


def label(text: Column) -> Column:
    """The first 12 words and an ellipsis, or the text itself when it has no more."""
    w = words(text)
    return F.when(F.size(w) > 12, F.concat(F.array_join(F.slice(w, 1, 12), " "), F.lit("…"))).otherwise(text)


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def tool_class(tool: Column, text: Column) -> Column:
    """Write, Check or Read of a tool call; an unknown shell command counts as Write."""
    name, low = ascii_lower(tool), ascii_lower(F.coalesce(text, F.lit("")))
    shell = F.when(has_any(low, schema.CHECK_COMMANDS), "Check").when(has_any(low, schema.READ_COMMANDS), "Read").otherwise("Write")
    return F.when(name.isin(schema.WRITE_TOOLS), "Write").when(name.isin(schema.CHECK_TOOLS), "Check").when(name.isin(schema.SHELL_TOOLS), shell).otherwise("Read")


def check_passed(text: Column, strict: bool = False) -> Column:
    """An explicit all-clear passes, else a failure mark fails, else it passes. strict: `10 failed` is no `0 failed`."""
    low = ascii_lower(F.coalesce(text, F.lit("")))
    clear = low.rlike(r"(^|[^0-9])0 (failed|failures|failing)|all tests passed|no failures") if strict else has_any(low, schema.CLEAR_MARKS)
    return clear | ~has_any(low, schema.FAIL_MARKS)


def note_text(line: Column) -> Column:
    """A list line without bullet, numbering, trailing marks and emphasis."""
    bare = F.regexp_replace(F.trim(line), r"^[-*+>]+", "")
    bare = F.trim(F.regexp_replace(bare, r"^[0-9.)]+", ""))
    return F.regexp_replace(F.regexp_replace(bare, r"[.;]+$", ""), r"[*_`]", "")


def note_class(line: Column) -> Column:
    """OpenItem, Decision, Rule or null of a Markdown list line."""
    text = note_text(line)
    return F.when(is_listed(line), note_kind(text, F.lower(text)))


def is_listed(line: Column) -> Column:
    return F.trim(line).rlike(r"^[-*+>0-9]")


def note_kind(text: Column, low: Column) -> Column:
    """What the text of a list line is, given it in lower case too."""
    asks = low.contains("?") | low.startswith("todo") | low.startswith("tbd") | low.startswith("open question")
    kind = F.when(asks, "OpenItem").when(has_any(low, schema.DECISION_MARKERS), "Decision").when(has_any(low, schema.RULE_MARKERS), "Rule")
    skipped = (F.octet_length(text) < 8) | text.startswith("|") | text.startswith("#")
    return F.when(~skipped, kind)


def stable_id(text: Column) -> Column:
    kept = F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", ""))
    return F.concat(F.lit("imp-"), F.substring(F.sha2(kept, 256), 1, 16))


def domain_credibility(url: Column) -> Column:
    """Fixed values by fragment, first match first."""
    low = F.lower(url)
    tiers = [
        (["wikipedia.org", "nature.com"], 0.95), ([".gov", ".edu"], 0.85), (["reuters.com", "apnews.com", "bbc.com"], 0.80),
        (["nytimes.com", "wsj.com", "economist.com"], 0.75),
    ]
    out = F.lit(0.50)
    for marks, value in reversed(tiers):
        out = F.when(has_any(low, marks), F.lit(value)).otherwise(out)
    return out
