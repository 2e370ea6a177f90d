"""HTTP archives and performance traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.functions.pieces import PIECE_ITEMS, pieces
from fieldglass.operators.ordering import BUCKET_ROWS, earlier_max, previous_in_group, running_sum

HAR_SCHEMA = (
    "log struct<entries: array<struct<startedDateTime: string, time: double, "
    "request: struct<method: string, url: string>, "
    "response: struct<status: int, content: struct<size: bigint, mimeType: string>>, "
    "timings: struct<blocked: double, dns: double, connect: double, send: double, wait: double, receive: double, "
    "ssl: double>>>>"
)
PHASES = ("blocked", "dns", "connect", "send", "wait", "receive", "ssl")


def _epoch_ms(text: Column) -> Column:
    return F.floor(F.unix_micros(F.try_to_timestamp(text)) / 1000).cast("long")


def har_requests(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """One row per request. ``offset_ms`` counts from the document's first start.

    The first start is taken inside the row, before the entries are unfolded.
    A phase of -1 means "does not apply" and becomes null.
    """
    entries = F.from_json(text, HAR_SCHEMA)["log"]["entries"]
    first = F.array_min(F.transform(F.col("_e"), lambda e: _epoch_ms(e["startedDateTime"])))
    unfolded = (
        df.select(*keys, entries.alias("_e"))
        .select(*keys, "_e", first.alias("_first"))
        .select(*keys, "_first", F.posexplode("_e").alias("idx", "_entry"))
        .withColumn("started_ms", _epoch_ms(F.col("_entry.startedDateTime")))
    )
    status = F.col("_entry.response.status")
    return unfolded.select(
        *keys,
        "idx",
        "started_ms",
        (F.col("started_ms") - F.col("_first")).alias("offset_ms"),
        F.col("_entry.request.method").alias("method"),
        F.col("_entry.request.url").alias("url"),
        F.try_parse_url(F.col("_entry.request.url"), F.lit("HOST")).alias("host"),
        status.alias("status"),
        F.floor(status / 100).cast("int").alias("status_class"),
        F.regexp_extract("_entry.response.content.mimeType", r"^([^;\s]*)", 1).alias("type"),
        F.col("_entry.response.content.size").alias("size"),
        F.col("_entry.time").alias("time"),
        *[F.when(F.col(f"_entry.timings.{p}") >= 0, F.col(f"_entry.timings.{p}")).alias(p) for p in PHASES],
    )


def har_timing(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Requests, total time, phase totals and wall time per document."""
    return requests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("time").alias("time"),
        *[F.sum(p).alias(p) for p in PHASES],
        F.max(F.col("offset_ms") + F.col("time")).alias("wall_ms"),
    )


def har_failures(requests: DataFrame) -> DataFrame:
    """Requests and failures (status 0 or from 400) per host."""
    failed = (F.col("status") >= 400) | (F.col("status") == 0)
    return requests.groupBy("host").agg(F.count(F.lit(1)).alias("requests"), F.count_if(failed).alias("failures"))


def har_filter(
    requests: DataFrame,
    method: str | None = None,
    status_class: int | None = None,
    type_: str | None = None,
    domain: str | None = None,
    text: str | None = None,
) -> DataFrame:
    """Requests that meet every facet given; ``domain`` includes its subdomains."""
    out = requests
    if method:
        out = out.where(F.upper("method") == method.upper())
    if status_class is not None:
        out = out.where(F.col("status_class") == status_class)
    if type_:
        out = out.where(F.col("type") == type_)
    if domain:
        low = F.lower("host")
        out = out.where((low == domain.lower()) | low.endswith("." + domain.lower()))
    if text:
        out = out.where(F.contains(F.lower("url"), F.lit(text.lower())))
    return out


TRACE_SCHEMA = "traceEvents array<struct<name: string, ph: string, pid: bigint, tid: bigint, ts: double, dur: double>>"


def trace_events(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """One row per trace event, ``idx`` being its place in the document."""
    events = F.from_json(text, TRACE_SCHEMA)["traceEvents"]
    return df.select(*keys, F.posexplode(events).alias("idx", "_e")).select(*keys, "idx", "_e.*")


def trace_spans(events: DataFrame, keys: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Complete spans: X events as they are, B events paired with their E.

    Within a track the nesting depth is the running count of open spans, an E
    event taking the depth of the span it closes. On one depth B and E then
    alternate, so the event before an E on its depth is its B. An E that
    finds no B is left out.
    """
    track = [*keys, "pid", "tid"]
    complete = events.where("ph = 'X'").select(*track, "name", F.col("ts").alias("start"), "dur")
    marks = events.where("ph IN ('B', 'E')").withColumn("_step", F.when(F.col("ph") == "B", 1).otherwise(-1))
    nested = running_sum(marks, track, ["ts", "idx"], "_step", "_open", bucket_rows).withColumn(
        "_depth", F.when(F.col("ph") == "B", F.col("_open")).otherwise(F.col("_open") + 1)
    )
    paired = previous_in_group(nested, [*track, "_depth"], ["ts", "idx"], ["ph", "name", "ts"], bucket_rows)
    closed = paired.where("ph = 'E' AND prev_ph = 'B'").select(
        *track, F.col("prev_name").alias("name"), F.col("prev_ts").alias("start"), (F.col("ts") - F.col("prev_ts")).alias("dur")
    )
    return complete.unionByName(closed)


def paired_marks(phases, pids, tids, times, durations) -> list[tuple[int, float | None, float | None]]:
    """Complete spans of one document's events: the place of the event that names each, its start and its duration.

    Marks are taken in order of time, equal times as listed. An end closes the span
    opened last on its track; one without an open span is passed over, and so is a
    begin that is never closed.
    """
    out, open_on = [], {}
    marks = [i for i, p in enumerate(phases) if p in ("B", "E")]
    marks.sort(key=lambda i: (times[i] is None, times[i] or 0.0))
    for i in marks:
        track = open_on.setdefault((pids[i], tids[i]), [])
        if phases[i] == "B":
            track.append(i)
        elif track:
            at = track.pop()
            known = times[at] is not None and times[i] is not None
            out.append((at, times[at], times[i] - times[at] if known else None))
    return out + [(i, times[i], durations[i]) for i, p in enumerate(phases) if p == "X"]


def trace_document_spans(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """The spans of ``trace_spans``, from whole documents: marks are paired inside the document's row, without a shuffle."""

    def spans_of(batch):
        import pyarrow as pa

        events = batch.column(batch.num_columns - 1)
        flat = events.flatten()
        name, ph, pid, tid, ts, dur = (flat.field(n).to_pylist() for n in ("name", "ph", "pid", "tid", "ts", "dur"))
        owners, rows, at = [], [], 0
        for i, size in enumerate(events.value_lengths().to_pylist()):
            part = slice(at, at + (size or 0))
            for k, start, length in paired_marks(ph[part], pid[part], tid[part], ts[part], dur[part]):
                owners.append(i)
                rows.append((pid[at + k], tid[at + k], name[at + k], start, length))
            at = part.stop
        kept = pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).take(pa.array(owners, pa.int64()))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*kept.columns, *made], names=[*kept.schema.names, "pid", "tid", "name", "start", "dur"])

    def run(batches):
        for whole in batches:
            counts = [n or 0 for n in whole.column(whole.num_columns - 1).value_lengths().to_pylist()]
            for batch in pieces(whole, counts, PIECE_ITEMS):
                yield spans_of(batch)

    given = df.select(*keys, F.from_json(text, TRACE_SCHEMA)["traceEvents"].alias("_events"))
    added = T._parse_datatype_string("pid long, tid long, name string, start double, dur double")
    return given.mapInArrow(run, T.StructType([*[given.schema[k] for k in keys], *added.fields]))


def trace_tracks(spans: DataFrame, keys: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Spans, extent and busy time per track; null tracks are tracks like any other.

    Busy is the time in which at least one span is open: a span adds what it has beyond
    the greatest end of the spans that start before it, so nested spans count once. Spans
    without a start or duration count as spans only.
    """
    track = [*keys, "pid", "tid"]
    ended = spans.withColumn("_end", F.col("start") + F.col("dur"))
    reached = earlier_max(ended, track, ["start", "_end", "name"], "_end", "_reached", bucket_rows)
    begin = F.greatest(F.col("start"), F.col("_reached"))  # nulls are passed over
    own = F.when(F.col("_end") > begin, F.col("_end") - begin)
    return reached.groupBy(*track).agg(
        F.count(F.lit(1)).alias("spans"),
        F.min("start").alias("first"),
        (F.max("_end") - F.min("start")).alias("extent"),
        F.coalesce(F.sum(own), F.lit(0.0)).alias("busy"),
    )


def trace_top_events(spans: DataFrame, keys: list[str], count: int = 10) -> DataFrame:
    """The names with the longest total duration of each document, with their spans and longest one.

    Names are summed up before they are ranked; equal totals rank by name.
    """
    by_name = spans.groupBy(*keys, "name").agg(
        F.count(F.lit(1)).alias("spans"), F.sum("dur").alias("total"), F.max("dur").alias("longest")
    )
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("total"), F.asc_nulls_first("name"))
    return by_name.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)
