"""Text exposition of metric scrapes -> labelled samples.

Input rows are ``(instance, scrape_ts, line_no, line)``; output rows are
``(instance, scrape_ts, name, labels, label_key, value)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from telemill.functions.columns import computed_once

# The published grammar of the text exposition format: a metric name, labels in braces whose
# values are quoted with backslash escapes (so a brace inside a value is text), a value and
# perhaps a time stamp.
QUOTED = r'"(?:[^"\\]++|\\.)*+"'
LABEL = rf"[A-Za-z_]\w*+\s*+=\s*+{QUOTED}"
PAIR = r'^[A-Za-z_]\w*+="[^"\\]*+"\z'
LINE = (r"^([A-Za-z_:][\w:]*+)(?:\s*+\{((?:" + rf'[^"}}]++|{QUOTED}' + r")*+)\}\s*+|\s++)"
        r"(\S++)(?:\s.*+)?$")
_CUT = "\x01"
NUMBER = r"(?i)^[+-]?(\d+(\.\d*)?([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|nan)$"


def to_number(text) -> Column:
    """Decimal, ``Inf`` and ``NaN`` spellings; anything else is null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def label_key(labels) -> Column:
    """Canonical text of a label set: ``k="v"`` pairs in name order."""
    labels = F.col(labels) if isinstance(labels, str) else labels
    return F.array_join(
        F.transform(F.sort_array(F.map_entries(labels)),
                    lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")


def _canonical(text: Column) -> Column:
    """The label pairs of a line in name order, values as they are written there."""
    # A single plain pair is as it should be; only the rest is taken apart.
    return F.when(text.rlike(PAIR), text).otherwise(_sorted_pairs(text))


def _sorted_pairs(text: Column) -> Column:
    pairs = F.transform(F.regexp_extract_all(text, F.lit(LABEL), 0), lambda p: F.struct(
        F.trim(F.substring_index(p, "=", 1)).alias("name"),
        F.ltrim(F.substr(p, F.instr(p, "=") + 1)).alias("quoted")))
    return F.array_join(F.transform(F.sort_array(pairs), lambda p: F.concat(
        p["name"], F.lit("="), p["quoted"])), ",")


def _value(quoted: Column) -> Column:
    """A quoted label value without its quotes and escapes."""
    inner = F.substr(quoted, F.lit(2), F.length(quoted) - 2)
    for escape, plain in (("\\\\", _CUT), ('\\"', '"'), ("\\n", "\n"), (_CUT, "\\")):
        inner = F.replace(inner, F.lit(escape), F.lit(plain))
    return inner


def labels_of(label_key) -> Column:
    """The label map that a canonical key stands for."""
    canonical = F.col(label_key) if isinstance(label_key, str) else label_key
    return F.map_from_entries(F.transform(
        F.regexp_extract_all(canonical, F.lit(LABEL), 0), lambda p: F.struct(
            F.substring_index(p, "=", 1).alias("key"),
            _value(F.substr(p, F.instr(p, "=") + 1)).alias("value"))))


def read_scrapes(lines: DataFrame) -> DataFrame:
    """Parse; comments, blanks and unreadable values are skipped.

    With a ``line_no`` column a series repeated inside one scrape keeps its last line.
    """
    text = F.trim(F.col("line"))
    rows = lines.select(*[c for c in ("instance", "scrape_ts", "line_no") if c in lines.columns],
                        text.alias("line"))
    rows = rows.filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    # One pass of the line pattern, and one of the label pattern, per line; a line that does not match has no cut.
    rows = rows.filter(~F.contains("line", F.lit(_CUT)) | F.col("line").rlike(LINE))
    rows = computed_once(rows, _part=F.split(F.regexp_replace(
        "line", LINE, f"$1{_CUT}$2{_CUT}$3"), _CUT)).filter(F.size("_part") > 2)
    samples = computed_once(
        rows, name=F.col("_part")[0],
        label_key=F.when(F.col("_part")[1] == "", "").otherwise(_canonical(F.col("_part")[1])),
        value=to_number(F.col("_part")[2])).filter(F.col("value").isNotNull()).drop(
        "line", "_part")
    if "line_no" in lines.columns:
        # Only flat values are aggregated; the label map follows from the key.
        samples = samples.groupBy("instance", "scrape_ts", "name", "label_key").agg(
            F.max_by("value", "line_no").alias("value"))
    keys = [c for c in ("instance", "scrape_ts") if c in samples.columns]
    return samples.select(*keys, "name", labels_of("label_key").alias("labels"),
                          "label_key", "value")
