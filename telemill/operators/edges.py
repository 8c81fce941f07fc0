"""The call graph as it was traced: caller -> callee with span and error counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from telemill.functions.columns import bucket


def _edges(spans: DataFrame, wanted=None) -> DataFrame:
    """(window_start, src_service, dst_service, spans, errors) of spans with a parent.

    ``spans`` needs trace_id, span_id, parent_span_id, service_name, is_error, window_start.  Only children that are
    ``wanted`` (a condition) count; their parents may be any span.

    * Parents collapse to one row per (trace, span): ids repeat across runs, and without
      this every child would match each historical copy of its parent.
    * Children collapse to counts per parent before the join.  A parent with a third of all
      children then joins as a handful of rows, so the join has no hot key on either side.
    """
    parents = spans.groupBy("trace_id", "span_id").agg(
        F.min("service_name").alias("src_service"))
    children = (
        spans.filter(F.col("parent_span_id") != "").filter(F.lit(True) if wanted is None else wanted)
        .groupBy("trace_id", F.col("parent_span_id").alias("span_id"), "window_start",
                 F.col("service_name").alias("dst_service"))
        .agg(F.count("*").alias("spans"), F.count_if("is_error").alias("errors")))
    return (
        children.join(parents, ["trace_id", "span_id"])
        .groupBy("window_start", "src_service", "dst_service")
        .agg(F.sum("spans").alias("spans"), F.sum("errors").alias("errors")))


def edge_changes(rows: DataFrame, changed: DataFrame, width: str = "minute") -> DataFrame:
    """How edges per minute change when spans come and go; columns as the model, counts may be negative.

    ``rows`` are spans with the booleans ``before`` and ``after``: whether the span is in the window before
    and after the change.  ``changed`` are those that differ.  Only keys of changed spans are looked at: as a parent
    (a new one may bring a smaller name, a leaving one may uncover a larger one) or as the parent of a changed
    child.  Everything else keeps its contribution, so it is never grouped or joined.
    """
    own = changed.select("trace_id", "span_id")
    above = changed.filter(F.col("parent_span_id") != "").select("trace_id", F.col("parent_span_id").alias("span_id"))
    keys = own.union(above).distinct()
    parents = rows.select("trace_id", "span_id", "service_name", "before", "after").join(
        keys, ["trace_id", "span_id"], "left_semi").groupBy("trace_id", "span_id").agg(
        F.min(F.when(F.col("before"), F.col("service_name"))).alias("src_before"),
        F.min(F.when(F.col("after"), F.col("service_name"))).alias("src_after"))
    children = rows.filter(F.col("parent_span_id") != "").select(
        "trace_id", F.col("parent_span_id").alias("span_id"), "service_name", "is_error", "before", "after",
        bucket("event_time", width).alias("window_start")).join(keys, ["trace_id", "span_id"], "left_semi").groupBy(
        "trace_id", "span_id", "window_start", F.col("service_name").alias("dst_service")).agg(*[
            F.count_if(F.col(w) & e).alias(f"{n}_{w}") for w in ("before", "after")
            for n, e in (("spans", F.lit(True)), ("errors", F.col("is_error")))])
    both = children.join(parents, ["trace_id", "span_id"]).select("window_start", "dst_service", F.explode(F.array(
        F.struct(F.col("src_before").alias("src_service"), (-F.col("spans_before")).alias("spans"),
                 (-F.col("errors_before")).alias("errors")),
        F.struct(F.col("src_after").alias("src_service"), F.col("spans_after").alias("spans"),
                 F.col("errors_after").alias("errors")))).alias("_e"))
    return merge_edges(both.select("window_start", "_e.*", "dst_service").filter("src_service IS NOT NULL"), keep_all=True)


def merge_edges(edges: DataFrame, keep_all: bool = False) -> DataFrame:
    """Edges and their changes summed per minute; what sums to no span is gone, unless all is asked for."""
    out = edges.groupBy("window_start", "src_service", "dst_service").agg(
        F.sum("spans").alias("spans"), F.sum("errors").alias("errors"))
    return out.filter("spans <> 0 OR errors <> 0" if keep_all else "spans > 0")


def call_edges_1m(operations: DataFrame, since=None, width: str = "minute") -> DataFrame:
    """Edges per minute; ``since`` bounds both sides of the join.  Self-edges stay."""
    rows = operations
    if since is not None:
        since = F.lit(since)
        rows = rows.filter((F.col("event_time") >= since)
                           & (F.col("event_date") >= F.to_date(since)))
    return _edges(rows.select(
        "trace_id", "span_id", "parent_span_id", "service_name", "is_error",
        bucket("event_time", width).alias("window_start")))


def call_edges(traces: DataFrame, since=None, limit: int | None = 24,
               drop_self: bool = True) -> DataFrame:
    """Edges of the whole window straight from bronze spans; self-edges dropped."""
    rows = traces
    if since is not None:
        since = F.lit(since)
        rows = rows.filter((F.col("Timestamp") > since)
                           & (F.col("TimestampDate") >= F.to_date(since)))
    edges = _edges(rows.select(
        F.col("TraceId").alias("trace_id"), F.col("SpanId").alias("span_id"),
        F.col("ParentSpanId").alias("parent_span_id"), F.col("ServiceName").alias("service_name"),
        (F.col("StatusCode") == "Error").alias("is_error"), F.lit(None).cast("timestamp")
        .alias("window_start")))
    edges = edges.select(F.col("src_service").alias("src"), F.col("dst_service").alias("dst"),
                         "spans", "errors")
    if drop_self:
        edges = edges.filter(F.col("src") != F.col("dst"))
    return _top(edges, limit)


def call_edges_from_rollup(edges_1m: DataFrame, since=None, limit: int | None = 24) -> DataFrame:
    """The same board from the minute model; that model keeps self-edges."""
    rows = edges_1m
    if since is not None:
        first = F.lit(since).cast("timestamp")
        rows = rows.filter(F.col("window_start") > first)
        if "event_date" in rows.columns:
            rows = rows.filter(F.col("event_date") >= F.to_date(first))
    return _top(rows.groupBy(F.col("src_service").alias("src"), F.col("dst_service").alias("dst"))
                .agg(F.sum("spans").alias("spans"), F.sum("errors").alias("errors")), limit)


def call_edges_stitched(edges_1m: DataFrame, traces: DataFrame, covered: DataFrame, since=None,
                        limit: int | None = 24, drop_self: bool = True) -> DataFrame:
    """The board from the minute model on ``covered`` days and from bronze spans on all others, in one plan.

    A child belongs to its own day; its parent may lie on any day of the window.
    """
    model, rows = edges_1m.join(covered, F.col("event_date") == F.col("covered_day"), "left_semi"), traces
    if since is not None:
        first = F.lit(since).cast("timestamp")
        model = model.filter((F.col("window_start") > first) & (F.col("event_date") >= F.to_date(first)))
        rows = rows.filter((F.col("Timestamp") > first) & (F.col("TimestampDate") >= F.to_date(first)))
    spans = rows.join(covered, F.col("TimestampDate") == F.col("covered_day"), "left").select(
        F.col("TraceId").alias("trace_id"), F.col("SpanId").alias("span_id"), F.col("ParentSpanId").alias("parent_span_id"),
        F.col("ServiceName").alias("service_name"), (F.col("StatusCode") == "Error").alias("is_error"),
        F.lit(None).cast("timestamp").alias("window_start"), F.col("covered_day").isNull().alias("open"))
    both = model.select("src_service", "dst_service", "spans", "errors").unionByName(
        _edges(spans, F.col("open")).drop("window_start"))
    out = both.groupBy(F.col("src_service").alias("src"), F.col("dst_service").alias("dst")).agg(
        F.sum("spans").alias("spans"), F.sum("errors").alias("errors"))
    return _top(out.filter(F.col("src") != F.col("dst")) if drop_self else out, limit)


def _top(edges: DataFrame, limit: int | None) -> DataFrame:
    return edges if limit is None else edges.orderBy(F.desc("spans"), "src", "dst").limit(limit)
