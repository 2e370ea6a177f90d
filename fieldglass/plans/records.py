"""Record extraction over documents derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldglass.functions.json_text import allow_duplicate_keys
from fieldglass.functions.octets import big_endian, little_endian
from fieldglass.operators import profile, search
from fieldglass.plans.registry import query, table
from fieldglass.plans.shapes import joined
from fieldglass.records import engineering, packets, reports, web
from fieldglass.sources import captures

KEYS = ["doc_id"]


def _event_docs(spark, sf, item, prefix: str, suffix: str, glue: str = ","):
    """Documents of a hundred events, one item text per event."""
    events = table(spark, sf, "events")
    docs = joined(events, F.floor(F.col("event_id") / 100), "event_id", item, glue)
    return docs.select("doc_id", F.concat(F.lit(prefix), "body", F.lit(suffix)).alias("body"))


def _part_docs(spark, sf, item, prefix: str, suffix: str, glue: str = ","):
    """Documents of twenty parts, one item text per part."""
    parts = table(spark, sf, "part")
    docs = joined(parts, F.floor(F.col("p_partkey") / 20), "p_partkey", item, glue)
    return docs.select("doc_id", F.concat(F.lit(prefix), "body", F.lit(suffix)).alias("body"))


# ------------------------------------------------------------- HTTP archives


def har_docs(spark, sf):
    item = F.expr(
        "to_json(named_struct('startedDateTime', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\"), 'time', value, "
        "'request', named_struct('method', if(event_id % 3 = 0, 'POST', 'GET'), 'url', "
        "concat('https://h', user_id % 7, '.example.com/', event_type, '?id=', event_id)), "
        "'response', named_struct('status', element_at(array(200, 301, 404, 500, 0), cast(event_id % 5 + 1 as int)), "
        "'content', named_struct('size', event_id * 10, 'mimeType', if(event_id % 2 = 0, 'text/html; charset=utf-8', 'application/json'))), "
        "'timings', named_struct('blocked', -1, 'wait', event_id % 50, 'receive', event_id % 20)))"
    )
    return _event_docs(spark, sf, item, '{"log":{"version":"1.2","creator":{"name":"x"},"entries":[', "]}}")


def _har(spark, sf):
    return web.har_requests(har_docs(spark, sf), KEYS, F.col("body"))


_HAR = (
    "(SELECT event_id // 100 AS doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS idx, (epoch_us(ts) // 1000) AS started_ms, "
    "(epoch_us(ts) // 1000) - min((epoch_us(ts) // 1000)) OVER (PARTITION BY event_id // 100) AS offset_ms, "
    "CASE WHEN event_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method, "
    "concat('https://h', user_id % 7, '.example.com/', event_type, '?id=', event_id) AS url, "
    "concat('h', user_id % 7, '.example.com') AS host, [200, 301, 404, 500, 0][event_id % 5 + 1] AS status, "
    "[2, 3, 4, 5, 0][event_id % 5 + 1] AS status_class, CASE WHEN event_id % 2 = 0 THEN 'text/html' ELSE 'application/json' END AS type, "
    "event_id * 10 AS size, value AS time, CAST(NULL AS DOUBLE) AS blocked, CAST(event_id % 50 AS DOUBLE) AS wait, "
    "CAST(event_id % 20 AS DOUBLE) AS receive FROM events WINDOW w AS (PARTITION BY event_id // 100 ORDER BY event_id)) h"
)
_HAR_COLUMNS = (
    "doc_id, idx, started_ms, offset_ms, method, url, host, status, status_class, type, size, time, blocked, wait, receive"
)


@query("har_requests", f"SELECT {_HAR_COLUMNS} FROM {_HAR}")
def har_requests(spark, sf):
    return _har(spark, sf).select(*_HAR_COLUMNS.split(", "))


@query(
    "har_timing",
    "SELECT doc_id, count(*) AS requests, round(sum(time), 4) AS time, sum(wait) AS wait, sum(receive) AS receive, "
    f"round(max(offset_ms + time), 4) AS wall_ms FROM {_HAR} GROUP BY 1",
)
def har_timing(spark, sf):
    out = web.har_timing(_har(spark, sf), KEYS)
    return out.select("doc_id", "requests", F.round("time", 4).alias("time"), "wait", "receive", F.round("wall_ms", 4).alias("wall_ms"))


@query(
    "har_failures",
    f"SELECT host, count(*) AS requests, count(*) FILTER (WHERE status >= 400 OR status = 0) AS failures FROM {_HAR} GROUP BY 1",
)
def har_failures(spark, sf):
    return web.har_failures(_har(spark, sf))


@query(
    "har_filter",
    f"SELECT doc_id, idx, url FROM {_HAR} WHERE method = 'GET' AND status_class = 4 AND type = 'text/html' "
    "AND host = 'h3.example.com' AND contains(lower(url), 'click')",
)
def har_filter(spark, sf):
    kept = web.har_filter(_har(spark, sf), "get", 4, "text/html", "h3.example.com", "CLICK")
    return kept.select("doc_id", "idx", "url")


# --------------------------------------------------------------------- traces


def trace_docs(spark, sf):
    """Every event as a complete span, a begin/end pair and, for even keys, a pair inside it."""
    item = F.expr(
        "concat('{\"name\":\"x\",\"ph\":\"X\",\"pid\":1,\"tid\":9,\"ts\":', event_id * 10, ',\"dur\":', event_id % 9, '},"
        "{\"name\":\"', event_type, '\",\"ph\":\"B\",\"pid\":1,\"tid\":', user_id % 4, ',\"ts\":', event_id * 10, '},', "
        "if(event_id % 2 = 0, concat('{\"name\":\"in\",\"ph\":\"B\",\"pid\":1,\"tid\":', user_id % 4, ',\"ts\":', event_id * 10 + 2, '},"
        "{\"name\":\"in\",\"ph\":\"E\",\"pid\":1,\"tid\":', user_id % 4, ',\"ts\":', event_id * 10 + 4, '},'), ''), "
        "'{\"ph\":\"E\",\"pid\":1,\"tid\":', user_id % 4, ',\"ts\":', event_id * 10 + 7, '}', "
        "if(event_id % 5 = 0, concat(',{\"name\":\"loose\",\"ph\":\"X\",\"ts\":', event_id * 3, ',\"dur\":', user_id % 90, '}'), ''))"
    )
    return _event_docs(spark, sf, item, '{"traceEvents":[', "]}")


_SPANS = (
    "(SELECT event_id // 100 AS doc_id, 1 AS pid, 9 AS tid, 'x' AS name, event_id * 10 AS start, event_id % 9 AS dur FROM events "
    "UNION ALL SELECT event_id // 100, 1, user_id % 4, event_type, event_id * 10, 7 FROM events "
    "UNION ALL SELECT event_id // 100, 1, user_id % 4, 'in', event_id * 10 + 2, 2 FROM events WHERE event_id % 2 = 0 "
    "UNION ALL SELECT event_id // 100, NULL, NULL, 'loose', event_id * 3, user_id % 90 FROM events WHERE event_id % 5 = 0) s"
)


def _spans(spark, sf):
    return web.trace_document_spans(trace_docs(spark, sf), KEYS, F.col("body"))


@query("trace_spans", f"SELECT doc_id, pid, tid, name, CAST(start AS DOUBLE) AS start, CAST(dur AS DOUBLE) AS dur FROM {_SPANS}")
def trace_spans(spark, sf):
    return _spans(spark, sf)


@query(
    "trace_tracks",
    "WITH s AS (SELECT *, start + dur AS stop, max(start + dur) OVER (PARTITION BY doc_id, pid, tid ORDER BY start, start + dur, name "
    f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM {_SPANS}), "
    # An island begins where nothing before reaches the start.
    "i AS (SELECT *, sum(CASE WHEN reached IS NULL OR reached < start THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, pid, tid "
    "ORDER BY start, stop, name ROWS UNBOUNDED PRECEDING) AS island FROM s), "
    "m AS (SELECT doc_id, pid, tid, count(*) AS spans, min(start) AS first, max(stop) AS last, max(stop) - min(start) AS own FROM i "
    "GROUP BY doc_id, pid, tid, island) "
    "SELECT doc_id, pid, tid, CAST(sum(spans) AS BIGINT) AS spans, CAST(min(first) AS DOUBLE) AS first, "
    "CAST(max(last) - min(first) AS DOUBLE) AS extent, CAST(sum(own) AS DOUBLE) AS busy FROM m GROUP BY 1, 2, 3",
)
def trace_tracks(spark, sf):
    return web.trace_tracks(_spans(spark, sf), KEYS)


@query(
    "trace_top_events",
    "SELECT doc_id, name, spans, total, longest, CAST(rank AS INTEGER) AS rank FROM (SELECT doc_id, name, count(*) AS spans, "
    "CAST(sum(dur) AS DOUBLE) AS total, CAST(max(dur) AS DOUBLE) AS longest, "
    f"row_number() OVER (PARTITION BY doc_id ORDER BY sum(dur) DESC, name) AS rank FROM {_SPANS} GROUP BY 1, 2) t WHERE rank <= 3",
)
def trace_top_events(spark, sf):
    return web.trace_top_events(_spans(spark, sf), KEYS, 3)


# -------------------------------------------------------------------- reports


def sarif_docs(spark, sf):
    item = F.expr(
        "concat('{\"ruleId\":\"R', p_size, '\",', if(p_partkey % 3 = 0, '', concat('\"level\":\"', if(p_partkey % 3 = 1, 'error', 'note'), '\",')), "
        "'\"message\":{\"text\":\"', p_name, '\"},\"locations\":[{\"physicalLocation\":{\"artifactLocation\":{\"uri\":\"src/', p_brand, "
        "'.c\"},\"region\":{\"startLine\":', p_partkey, '}}}]}')"
    )
    return _part_docs(spark, sf, item, '{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"lint"}},"results":[', "]}]}")


_SARIF = (
    "(SELECT p_partkey // 20 AS doc_id, 'lint' AS tool, concat('R', p_size) AS rule, ['warning', 'error', 'note'][p_partkey % 3 + 1] AS level, "
    "p_name AS message, concat('src/', p_brand, '.c') AS uri, p_partkey AS line FROM part) s"
)


def _sarif(spark, sf):
    return reports.sarif_results(sarif_docs(spark, sf), KEYS, F.col("body"))


@query("sarif_results", f"SELECT * FROM {_SARIF}")
def sarif_results(spark, sf):
    return _sarif(spark, sf)


@query("sarif_counts", f"SELECT tool, rule, level, count(*) AS n FROM {_SARIF} GROUP BY 1, 2, 3")
def sarif_counts(spark, sf):
    return reports.count_by(_sarif(spark, sf), "tool", "rule", "level")


@query("sarif_filter", f"SELECT doc_id, line FROM {_SARIF} WHERE level = 'error' AND rule = 'R7'")
def sarif_filter(spark, sf):
    return reports.facet_filter(_sarif(spark, sf), level="error", rule="R7", tool=None).select("doc_id", "line")


def junit_docs(spark, sf):
    item = F.expr(
        "concat('<testcase classname=\"', event_type, '\" name=\"t', event_id, '\" time=\"', cast(value as string), '\">', "
        "element_at(array('', '<failure message=\"f\">trace</failure>', '<skipped/>', '<error message=\"e\"/>', ''), cast(event_id % 5 + 1 as int)), "
        "'</testcase>')"
    )
    # A third of the cases lie in an inner suite, a third in a suite inside that.
    nested = F.when(F.col("event_id") % 3 == 1, F.concat(F.lit('<testsuite name="in">'), item, F.lit("</testsuite>"))).when(
        F.col("event_id") % 3 == 2,
        F.concat(F.lit("<testsuite name='mid &amp; low'><properties/><testsuite name=\"deep\">"), item, F.lit("</testsuite></testsuite>")),
    )
    docs = _event_docs(spark, sf, F.coalesce(nested, item), '<testsuite name="s">', "</testsuite>", "")
    wrapped = F.concat(F.lit('<?xml version="1.0"?><testsuites>'), "body", F.lit("</testsuites>"))
    return docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, wrapped).otherwise(F.col("body")).alias("body"))


_JUNIT = (
    "(SELECT event_id // 100 AS doc_id, ['s', 'in', 'deep'][event_id % 3 + 1] AS suite, "
    "['/s', '/s/in', '/s/mid & low/deep'][event_id % 3 + 1] AS suite_path, event_type AS class_name, concat('t', event_id) AS name, value AS time, "
    "['passed', 'failure', 'skipped', 'error', 'passed'][event_id % 5 + 1] AS outcome FROM events) j"
)


def _junit(spark, sf):
    return reports.junit_cases(junit_docs(spark, sf), KEYS, F.col("body"))


@query("junit_cases", f"SELECT * FROM {_JUNIT}")
def junit_cases(spark, sf):
    return _junit(spark, sf)


@query(
    "junit_totals",
    "SELECT doc_id, suite, suite_path, count(*) AS cases, "
    + ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in ("passed", "failure", "error", "skipped"))
    + f", round(sum(time), 4) AS time FROM {_JUNIT} GROUP BY 1, 2, 3",
)
def junit_totals(spark, sf):
    return reports.junit_totals(_junit(spark, sf), KEYS).withColumn("time", F.round("time", 4))


@query("junit_filter", f"SELECT doc_id, name FROM {_JUNIT} WHERE outcome = 'failure'")
def junit_filter(spark, sf):
    return reports.facet_filter(_junit(spark, sf), outcome="failure").select("doc_id", "name")


def sbom_docs(spark, sf):
    component = F.expr(
        "concat('{\"bom-ref\":\"p', p_partkey, '\",\"name\":\"', p_name, '\",\"version\":\"', p_size, '\",\"purl\":\"pkg:generic/', p_partkey, "
        "'\",\"licenses\":[{\"license\":{\"', if(p_partkey % 2 = 0, 'id', 'name'), '\":\"', p_brand, '\"}}],"
        "\"components\":[{\"bom-ref\":\"q', p_partkey, '\",\"name\":\"inner\",\"components\":[{\"bom-ref\":\"r', p_partkey, '\",\"name\":\"innermost\"}]}]}')"
    )
    edge = F.expr("concat('{\"ref\":\"p', p_partkey, '\",\"dependsOn\":[\"p', p_partkey + 1, '\",\"r', p_partkey + 1, '\"]}')")
    parts = _part_docs(spark, sf, component, '{"bomFormat":"CycloneDX","components":[', "],")
    edges = _part_docs(spark, sf, edge, '"dependencies":[', "]}").withColumnRenamed("body", "edges")
    return parts.join(edges, "doc_id").select("doc_id", F.concat("body", "edges").alias("body"))


_SBOM_PLACE = "concat('/components/', row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) - 1"


@query(
    "sbom_components",
    f"SELECT p_partkey // 20 AS doc_id, {_SBOM_PLACE}) AS path, concat('p', p_partkey) AS ref, p_name AS name, CAST(p_size AS VARCHAR) AS version, "
    "concat('pkg:generic/', p_partkey) AS purl, p_brand AS licences FROM part "
    f"UNION ALL SELECT p_partkey // 20, {_SBOM_PLACE}, '/components/0'), concat('q', p_partkey), 'inner', NULL, NULL, NULL FROM part "
    f"UNION ALL SELECT p_partkey // 20, {_SBOM_PLACE}, '/components/0/components/0'), concat('r', p_partkey), 'innermost', NULL, NULL, NULL FROM part",
)
def sbom_components(spark, sf):
    parts = reports.sbom_components(sbom_docs(spark, sf), KEYS, F.col("body"))
    return parts.withColumn("licences", F.array_join("licences", ","))


@query("sbom_licences", "SELECT p_brand AS licence, count(*) AS components FROM part GROUP BY 1")
def sbom_licences(spark, sf):
    return reports.licence_counts(reports.sbom_components(sbom_docs(spark, sf), KEYS, F.col("body")))


@query(
    "sbom_dependencies",
    "SELECT p_partkey // 20 AS doc_id, concat('p', p_partkey) AS ref, concat(k, p_partkey + 1) AS depends_on FROM part, (VALUES ('p'), ('r')) t(k)",
)
def sbom_dependencies(spark, sf):
    return reports.sbom_dependencies(sbom_docs(spark, sf), KEYS, F.col("body"))


@query(
    "sbom_dangling",
    "SELECT p_partkey // 20 AS doc_id, concat('p', p_partkey) AS ref, concat(k, p_partkey + 1) AS depends_on FROM part a, (VALUES ('p'), ('r')) t(k) "
    "WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_partkey = a.p_partkey + 1 AND b.p_partkey // 20 = a.p_partkey // 20)",
)
def sbom_dangling(spark, sf):
    docs = sbom_docs(spark, sf)
    parts = reports.sbom_components(docs, KEYS, F.col("body"))
    edges = reports.sbom_dependencies(docs, KEYS, F.col("body"))
    return reports.sbom_dangling(parts, edges, KEYS)


# ----------------------------------------------------------- maps and tracks


def gpx_docs(spark, sf):
    item = F.expr(
        "concat('<trkpt lat=\"', cast(event_id % 90 as string), '.5\" lon=\"', cast(user_id % 180 as string), '.25\"><ele>', "
        "cast(event_id % 37 as string), '</ele><time>', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"), '</time></trkpt>')"
    )
    return _event_docs(
        spark, sf, item, '<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><name>t</name><trkseg>', "</trkseg></trk></gpx>", ""
    )


_POINTS = (
    "(SELECT event_id // 100 AS doc_id, event_id, event_id % 90 + 0.5::DOUBLE AS lat, user_id % 180 + 0.25::DOUBLE AS lon, "
    "CAST(event_id % 37 AS DOUBLE) AS ele, epoch_ms(date_trunc('second', ts)) AS ms FROM events)"
)


@query(
    "track_summary",
    "SELECT doc_id, 0 AS track, count(*) AS points, round(coalesce(sum(CASE WHEN plat IS NOT NULL THEN 2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(lat - plat) / 2), 2) "
    "+ cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2)))) END), 0), 2) AS length_m, "
    "(max(ms) - min(ms)) / 1000.0 AS elapsed_s, min(ele) AS min_ele, max(ele) AS max_ele, "
    "coalesce(sum(CASE WHEN pele IS NOT NULL THEN greatest(ele - pele, 0) END), 0) AS gain_m FROM ("
    "SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(ele) OVER w AS pele "
    f"FROM {_POINTS} p WINDOW w AS (PARTITION BY doc_id ORDER BY event_id)) s GROUP BY 1",
)
def track_summary(spark, sf):
    points = reports.gpx_points(gpx_docs(spark, sf), KEYS, F.col("body"))
    return reports.track_summary(points, KEYS).withColumn("length_m", F.round("length_m", 2))


@query(
    "kml_points",
    "SELECT event_id // 100 AS doc_id, CAST(row_number() OVER (PARTITION BY event_id // 100 ORDER BY event_id) - 1 AS INTEGER) AS idx, "
    "CAST(event_id % 90 AS DOUBLE) AS lat, CAST(user_id % 180 AS DOUBLE) AS lon, CAST(event_id % 37 AS DOUBLE) AS ele FROM events",
)
def kml_points(spark, sf):
    item = F.expr("concat(user_id % 180, ',', event_id % 90, ',', event_id % 37)")
    docs = _event_docs(
        spark, sf, item, "<kml><Placemark><LineString><coordinates> ", " </coordinates></LineString></Placemark></kml>", " "
    )
    return reports.kml_points(docs, KEYS, F.col("body")).select("doc_id", "idx", "lat", "lon", "ele")


_PLACE_SQL = "event_id % 90 + 0.5::DOUBLE AS lat, user_id % 180 + 0.25::DOUBLE AS lon"


@query(
    "gpx_places",
    "SELECT doc_id, kind, CASE WHEN kind = 'route' THEN 0 END AS route, CASE WHEN kind = 'route' THEN 'r' END AS route_name, "
    "CAST(row_number() OVER (PARTITION BY doc_id, kind ORDER BY event_id) - 1 AS INTEGER) AS idx, name, lat, lon, at_us FROM ("
    f"SELECT event_id // 100 AS doc_id, event_id, CASE WHEN event_id % 2 = 0 THEN 'waypoint' ELSE 'route' END AS kind, concat('p', event_id) AS name, {_PLACE_SQL}, "
    "CASE WHEN event_id % 2 = 0 THEN epoch_us(date_trunc('second', ts)) END AS at_us FROM events) e",
)
def gpx_places(spark, sf):
    """Even events as waypoints with a time, odd ones as points of a route."""
    place = lambda tag: F.expr(
        f"concat('<{tag} lat=\"', cast(event_id % 90 as string), '.5\" lon=\"', cast(user_id % 180 as string), '.25\"><name>p', event_id, '</name>', "
        "if(event_id % 2 = 0, concat('<time>', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"), '</time>'), ''), "
        f"'</{tag}>')"
    )
    events = table(spark, sf, "events")
    doc = F.floor(F.col("event_id") / 100)
    ways = joined(events.where("event_id % 2 = 0"), doc, "event_id", place("wpt"), "", "ways")
    stops = joined(events.where("event_id % 2 = 1"), doc, "event_id", place("rtept"), "", "stops")
    both = ways.join(stops, "doc_id", "full")
    body = F.concat(
        F.lit('<gpx xmlns="http://www.topografix.com/GPX/1/1">'), F.coalesce("ways", F.lit("")), F.lit("<rte><name>r</name>"), F.coalesce("stops", F.lit("")), F.lit("</rte></gpx>")
    )
    return reports.gpx_places(both.select("doc_id", body.alias("body")), KEYS, F.col("body")).drop("ele")


@query(
    "kml_places",
    f"SELECT event_id // 100 AS doc_id, CAST(row_number() OVER (PARTITION BY event_id // 100 ORDER BY event_id) - 1 AS INTEGER) AS idx, "
    f"concat('a & ', event_id) AS name, {_PLACE_SQL}, CAST(event_id % 37 AS DOUBLE) AS ele, epoch_us(date_trunc('second', ts)) AS at_us FROM events",
)
def kml_places(spark, sf):
    """Places with a time stamp or, for odd events, a time span."""
    time = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    item = F.expr(
        f"concat('<Placemark><name>a &amp; ', event_id, '</name>', if(event_id % 2 = 0, concat('<TimeStamp><when>', {time}, '</when></TimeStamp>'), "
        f"concat('<TimeSpan><begin>', {time}, '</begin></TimeSpan>')), '<Point><coordinates> ', user_id % 180, '.25,', event_id % 90, '.5,', "
        "event_id % 37, ' </coordinates></Point></Placemark>')"
    )
    return reports.kml_places(_event_docs(spark, sf, item, "<kml>", "</kml>", ""), KEYS, F.col("body"))


@query(
    "geojson_features",
    "SELECT c_custkey // 50 AS doc_id, CAST(row_number() OVER (PARTITION BY c_custkey // 50 ORDER BY c_custkey) - 1 AS INTEGER) AS idx, "
    "CAST(c_custkey AS VARCHAR) AS id, ['Point', 'LineString', 'Polygon', 'GeometryCollection'][c_custkey % 4 + 1] AS geometry_type, "
    "concat('{\"seg\":\"', c_mktsegment, '\"}') AS properties, CAST(c_nationkey AS DOUBLE) AS west, CAST(c_custkey % 90 AS DOUBLE) AS south, "
    "CAST(c_nationkey + CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 3 THEN 9 ELSE 2 END AS DOUBLE) AS east, "
    "CAST(c_custkey % 90 + CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END AS DOUBLE) AS north, "
    "[1, 2, 4, 3][c_custkey % 4 + 1] AS n_vertices FROM customer",
)
def geojson_features(spark, sf):
    allow_duplicate_keys(spark)
    item = F.expr(
        "concat('{\"type\":\"Feature\",\"id\":', c_custkey, ',\"properties\":{\"seg\":\"', c_mktsegment, '\"},\"geometry\":{\"type\":\"', "
        "element_at(array('Point', 'LineString', 'Polygon', 'GeometryCollection'), cast(c_custkey % 4 + 1 as int)), "
        "if(c_custkey % 4 = 3, '\",\"geometries\":', '\",\"coordinates\":'), case c_custkey % 4 "
        "when 3 then concat('[{\"type\":\"Point\",\"coordinates\":[', c_nationkey, ',', c_custkey % 90, ']},{\"type\":\"GeometryCollection\",\"geometries\":"
        "[{\"type\":\"GeometryCollection\",\"geometries\":[{\"type\":\"LineString\",\"coordinates\":[[', c_nationkey + 9, ',', c_custkey % 90 + 3, '],[', "
        "c_nationkey + 1, ',', c_custkey % 90 + 1, ']]}]}]}]') "
        "when 0 then concat('[', c_nationkey, ',', c_custkey % 90, ']') "
        "when 1 then concat('[[', c_nationkey, ',', c_custkey % 90, '],[', c_nationkey + 2, ',', c_custkey % 90 + 1, ']]') "
        "else concat('[[[', c_nationkey, ',', c_custkey % 90, '],[', c_nationkey + 2, ',', c_custkey % 90, '],[', c_nationkey + 2, ',', "
        "c_custkey % 90 + 3, '],[', c_nationkey, ',', c_custkey % 90, ']]]') end, '}}')"
    )
    docs = joined(table(spark, sf, "customer"), F.floor(F.col("c_custkey") / 50), "c_custkey", item, ",")
    body = F.concat(F.lit('{"type":"FeatureCollection","features":['), "body", F.lit("]}"))
    return reports.geojson_features(docs, KEYS, body)


@query(
    "notebook_cells",
    "SELECT doc_id // 10 AS doc_id, CAST(row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) - 1 AS INTEGER) AS idx, "
    "CASE WHEN doc_id % 3 = 0 THEN 'markdown' ELSE 'code' END AS cell_type, CASE WHEN doc_id % 2 = 0 THEN text ELSE concat(text, source) END AS source, "
    "CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 2 END AS n_outputs, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN 'error,stream' "
    "ELSE 'display_data,stream' END AS output_types, doc_id % 3 = 1 AS failed FROM documents",
)
def notebook_cells(spark, sf):
    allow_duplicate_keys(spark)
    item = F.expr(
        "concat('{\"cell_type\":\"', if(doc_id % 3 = 0, 'markdown', 'code'), '\",\"source\":', "
        "if(doc_id % 2 = 0, substring(to_json(array(text)), 2, length(to_json(array(text))) - 2), to_json(array(text, source))), "
        "if(doc_id % 3 = 0, '', concat(',\"outputs\":[{\"output_type\":\"stream\"},{\"output_type\":\"', if(doc_id % 3 = 1, 'error', 'display_data'), '\"}]')), '}')"
    )
    docs = joined(table(spark, sf, "documents"), F.floor(F.col("doc_id") / 10), "doc_id", item, ",")
    body = F.concat(F.lit('{"cells":['), "body", F.lit('],"nbformat":4}'))
    return reports.notebook_cells(docs, KEYS, body)


# ------------------------------------------------------------------- CAN logs


def can_docs(spark, sf):
    line = F.expr(
        "case event_id % 4 when 0 then concat(event_id, '.5 ', user_id % 3, ' ', lower(hex(event_id)), ' Rx d 2 7E 01') "
        "when 1 then concat(event_id, '.25 CANFD ', user_id % 3, ' Tx ', lower(hex(event_id)), 'x 0 1 5 0 0F 3C 99') "
        "when 2 then concat('comment ', event_id) else concat(event_id, '.0 other text') end"
    )
    return _event_docs(spark, sf, line, "log of a bench run\n", "\n", "\n")


def _can_lines(spark, sf):
    return engineering.can_lines(can_docs(spark, sf), KEYS, "body")


@query(
    "can_events",
    "SELECT doc_id, time, type, channel, dir, can_id, dlc, data, line FROM (SELECT event_id // 100 AS doc_id, "
    "concat(event_id, CASE WHEN event_id % 4 = 0 THEN '.5' ELSE '.25' END) AS time, CASE WHEN event_id % 4 = 0 THEN 'CAN' ELSE 'CANFD' END AS type, "
    "CAST(user_id % 3 AS VARCHAR) AS channel, CASE WHEN event_id % 4 = 0 THEN 'Rx' ELSE 'Tx' END AS dir, "
    "concat(lower(to_hex(event_id)), CASE WHEN event_id % 4 = 0 THEN '' ELSE 'x' END) AS can_id, "
    "CASE WHEN event_id % 4 = 0 THEN '2' ELSE '0' END AS dlc, CASE WHEN event_id % 4 = 0 THEN '7E 01' ELSE '0F 3C 99' END AS data, "
    "row_number() OVER (PARTITION BY event_id // 100 ORDER BY event_id) + 1 AS line, event_id FROM events) c WHERE event_id % 4 < 2",
)
def can_events(spark, sf):
    return engineering.can_events(_can_lines(spark, sf), KEYS)


@query(
    "can_summary",
    "SELECT type, channel, count(*) AS n FROM (SELECT CASE WHEN event_id % 4 = 0 THEN 'CAN' ELSE 'CANFD' END AS type, "
    "CAST(user_id % 3 AS VARCHAR) AS channel FROM events WHERE event_id % 4 < 2) c GROUP BY 1, 2",
)
def can_summary(spark, sf):
    return reports.count_by(engineering.can_events(_can_lines(spark, sf), KEYS), "type", "channel")


@query(
    "can_headers",
    "SELECT event_id // 100 AS doc_id, count(*) FILTER (WHERE event_id % 4 = 2) + 1 AS headers FROM events GROUP BY 1",
)
def can_headers(spark, sf):
    lines = _can_lines(spark, sf)
    return lines.groupBy("doc_id").agg(F.count_if(F.col("kind") == "header").alias("headers"))


@query(
    "can_search",
    "SELECT event_id // 100 AS doc_id, concat(lower(to_hex(event_id)), 'x') AS can_id FROM events WHERE event_id % 4 = 1",
)
def can_search(spark, sf):
    """Search over an extracted table: every FD frame of the log."""
    events = engineering.can_events(_can_lines(spark, sf), KEYS)
    return search.search_rows(events, "canfd", "").select("doc_id", "can_id")


# ------------------------------------------------------------ network databases


def dbc_docs(spark, sf):
    line = F.expr(
        "concat('BO_ ', p_partkey, ' Frame', p_partkey, ': ', p_size % 9, ' Pump\\n SG_ Flow : 0|16@1+ (0.75,0) [0|912.25] \"lpm\" Valve,Probe\\n', "
        "' SG_ State m1 : 8|8@0- (1,-', p_size, ') [0|3] \"\" ', if(p_partkey % 2 = 0, 'Probe', 'Relay'), "
        "'\\nCM_ BO_ ', p_partkey, ' \"frame ', p_name, '\";\\nCM_ SG_ ', p_partkey, ' State \"a \\\\\"b\\\\\"\";\\n', "
        "'VAL_ ', p_partkey, if(p_partkey % 7 = 0, ' Lost', ' State'), ' 0 \"Off\" 1 \"On\";')"
    )
    return _part_docs(spark, sf, line, 'VERSION "7.2"\nBU_: Pump Valve Probe Relay\n', "\n", "\n")


def _dbc(spark, sf):
    return engineering.dbc_lines(dbc_docs(spark, sf), KEYS, "body")


_PLACE = "row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) * 6 - 3"


@query(
    "dbc_messages",
    "SELECT p_partkey // 20 AS doc_id, p_partkey AS message_id, concat('0x', upper(to_hex(p_partkey))) AS id_hex, "
    "concat('Frame', p_partkey) AS name, CAST(p_size % 9 AS BIGINT) AS dlc, 'Pump' AS transmitter, concat('frame ', p_name) AS comment, "
    f"{_PLACE} AS line FROM part",
)
def dbc_messages(spark, sf):
    return engineering.dbc_messages(_dbc(spark, sf), KEYS)


@query(
    "dbc_signals",
    "SELECT p_partkey // 20 AS doc_id, p_partkey AS message_id, signal, multiplexer, CAST(start_bit AS BIGINT) AS start_bit, "
    "CAST(length AS BIGINT) AS length, byte_order, value_type, CAST(factor AS DOUBLE) AS factor, CAST(off AS DOUBLE) AS \"offset\", "
    "CAST(0 AS DOUBLE) AS minimum, CAST(maximum AS DOUBLE) AS maximum, unit, receivers, comment, place + step AS line FROM ("
    f"SELECT *, {_PLACE} AS place FROM part) p, LATERAL (SELECT 'Flow' AS signal, NULL AS multiplexer, 0 AS start_bit, 16 AS length, "
    "'little_endian' AS byte_order, 'unsigned' AS value_type, 0.75 AS factor, 0 AS off, 912.25 AS maximum, 'lpm' AS unit, "
    "'Valve,Probe' AS receivers, NULL AS comment, 1 AS step UNION ALL SELECT 'State', 'm1', 8, 8, 'big_endian', 'signed', 1, -p_size, 3, '', "
    "CASE WHEN p_partkey % 2 = 0 THEN 'Probe' ELSE 'Relay' END, 'a \"b\"', 2) s",
)
def dbc_signals(spark, sf):
    return engineering.dbc_signals(_dbc(spark, sf), KEYS).withColumn("receivers", F.array_join("receivers", ","))


@query(
    "dbc_comments",
    "SELECT p_partkey // 20 AS doc_id, target, p_partkey AS message_id, signal, text FROM part, LATERAL (SELECT 'message' AS target, "
    "NULL AS signal, concat('frame ', p_name) AS text UNION ALL SELECT 'signal', 'State', 'a \"b\"') c",
)
def dbc_comments(spark, sf):
    return engineering.dbc_comments(_dbc(spark, sf), KEYS).drop("line")


@query(
    "dbc_values",
    "SELECT p_partkey // 20 AS doc_id, p_partkey AS message_id, CASE WHEN p_partkey % 7 = 0 THEN 'Lost' ELSE 'State' END AS signal, value, label "
    "FROM part, (VALUES (0, 'Off'), (1, 'On')) v(value, label)",
)
def dbc_values(spark, sf):
    return engineering.dbc_values(_dbc(spark, sf), KEYS).drop("line")


@query(
    "dbc_warnings",
    f"SELECT doc_id, line, 'Lost' AS signal, 'value table without its signal' AS warning FROM (SELECT p_partkey // 20 AS doc_id, p_partkey, "
    f"{_PLACE} + 5 AS line FROM part) p WHERE p_partkey % 7 = 0",
)
def dbc_warnings(spark, sf):
    return engineering.dbc_warnings(_dbc(spark, sf), KEYS)


@query(
    "dbc_nodes",
    "SELECT DISTINCT p_partkey // 20 AS doc_id, idx, node, 2 AS line FROM part, (VALUES (0, 'Pump'), (1, 'Valve'), (2, 'Probe'), (3, 'Relay')) t(idx, node)",
)
def dbc_nodes(spark, sf):
    return engineering.dbc_nodes(_dbc(spark, sf), KEYS)


def _valued_dbc(spark, sf):
    """Every third state has a second value table, which replaces the first."""
    line = F.expr(
        "concat('BO_ ', p_partkey, ' Frame: 8 Pump\\n SG_ State : 8|8@1+ (1,0) [0|3] \"\" Probe\\nVAL_ ', p_partkey, ' State 0 \"Off\" 1 \"On\";', "
        "if(p_partkey % 3 = 0, concat('\\nVAL_ ', p_partkey, ' State 2 \"', p_brand, '\" 0 \"Stop\";'), ''))"
    )
    docs = _part_docs(spark, sf, line, 'VERSION "1"\nVERSION "7.2"\nBS_: 500,1,2\n', "\n", "\n")
    return engineering.dbc_lines(docs, KEYS, "body")


@query(
    "dbc_signal_values",
    "SELECT p_partkey // 20 AS doc_id, p_partkey AS message_id, 'State' AS signal, CASE WHEN p_partkey % 3 = 0 THEN concat('2=', p_brand, ',0=Stop') "
    "ELSE '0=Off,1=On' END AS labels FROM part",
)
def dbc_signal_values(spark, sf):
    lines = _valued_dbc(spark, sf)
    found = engineering.dbc_signal_values(engineering.dbc_signals(lines, KEYS), lines, KEYS)
    labels = F.array_join(F.transform("values", lambda e: F.concat_ws("=", e["value"].cast("string"), e["label"])), ",")
    return found.select("doc_id", "message_id", "signal", labels.alias("labels"))


@query("dbc_header", "SELECT DISTINCT p_partkey // 20 AS doc_id, '7.2' AS version, '500,1,2' AS bus FROM part")
def dbc_header(spark, sf):
    return engineering.dbc_header(_valued_dbc(spark, sf), KEYS)


@query("dbc_filter", "SELECT p_partkey // 20 AS doc_id, p_partkey AS message_id FROM part WHERE p_partkey % 2 = 1 AND contains(p_name, 'ring')")
def dbc_filter(spark, sf):
    lines = _dbc(spark, sf)
    messages, signals = engineering.dbc_messages(lines, KEYS), engineering.dbc_signals(lines, KEYS)
    return engineering.dbc_filter(messages, signals, KEYS, "Relay", " RING ").select("doc_id", "message_id")


@query(
    "dbc_summary",
    "SELECT p_partkey // 20 AS doc_id, count(*) AS messages, count(*) FILTER (WHERE p_partkey > 2047) AS extended, "
    "CAST(max(p_size % 9) AS BIGINT) AS max_dlc, count(*) * 2 AS signals FROM part GROUP BY 1",
)
def dbc_summary(spark, sf):
    return engineering.dbc_totals(dbc_docs(spark, sf), KEYS, "body")


# ------------------------------------------------------------------ inventories


@query(
    "a2l_blocks",
    "SELECT p_partkey // 20 AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN 'MEASUREMENT' ELSE 'GROUP' END AS kind, "
    "CASE WHEN p_partkey % 2 = 0 THEN concat('M', p_partkey) ELSE p_name END AS name, p_partkey % 2 = 0 AS important, "
    "row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) * 2 - 1 AS line FROM part",
)
def a2l_blocks(spark, sf):
    line = F.expr("if(p_partkey % 2 = 0, concat('  /begin MEASUREMENT M', p_partkey, ' \"\"'), concat('/begin group \"', p_name, '\"'))")
    docs = _part_docs(spark, sf, F.concat(line, F.lit("\n/end X")), "", "", "\n")
    return engineering.a2l_blocks(docs, KEYS, "body")


@query(
    "step_entities",
    "SELECT p_partkey // 20 AS doc_id, concat('#', p_partkey) AS entity, upper(replace(p_type, ' ', '_')) AS kind, "
    "row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) + 4 AS line FROM part",
)
def step_entities(spark, sf):
    return engineering.step_entities(_step_docs(spark, sf), KEYS, "body")


def _step_docs(spark, sf):
    line = F.expr("concat('#', p_partkey, ' = ', lower(replace(p_type, ' ', '_')), '(1,2);')")
    head = "HEADER;\nFILE_NAME('a;b(1) it''s',$,('a','b;'),('works'),'v3','cad','none');\nFILE_SCHEMA(('CONFIG_DESIGN','AP214'));\nENDSEC;\n"
    return _part_docs(spark, sf, line, head, "\nENDSEC;", "\n")


@query(
    "step_top_kinds",
    "SELECT upper(replace(p_type, ' ', '_')) AS kind, count(*) AS n FROM part GROUP BY 1",
)
def step_top_kinds(spark, sf):
    return profile.top_kinds(engineering.step_entities(_step_docs(spark, sf), KEYS, "body"), F.col("kind"))


@query(
    "step_header",
    "SELECT DISTINCT p_partkey // 20 AS doc_id, 'a;b(1) it''s' AS name, NULL::VARCHAR AS timestamp, 'a, b;' AS author, 'works' AS organization, "
    "'v3' AS preprocessor, 'cad' AS system, 'none' AS authorization, 'CONFIG_DESIGN, AP214' AS schema FROM part",
)
def step_header(spark, sf):
    return engineering.step_header(_step_docs(spark, sf), KEYS, F.col("body"))


def _arxml_docs(spark, sf):
    item = F.expr(
        "concat('<FRAME UUID=\"1\"><SHORT-NAME>F', p_partkey, '&amp;', p_brand, '</SHORT-NAME></FRAME><FRAME-REF DEST=\"FRAME\">/P/F', p_partkey, '</FRAME-REF>')"
    )
    head = (
        '<AUTOSAR xmlns="urn:x"><!-- <AR-PACKAGE> --><AR-PACKAGES><AR-PACKAGE><SHORT-NAME>Pkg</SHORT-NAME><AR-PACKAGES><AR-PACKAGE UUID="a>b">'
        "<SHORT-NAME>In</SHORT-NAME><AR-PACKAGES><AR-PACKAGE><SHORT-NAME>Deep</SHORT-NAME><ELEMENTS>"
    )
    tail = "</ELEMENTS></AR-PACKAGE></AR-PACKAGES></AR-PACKAGE></AR-PACKAGES></AR-PACKAGE></AR-PACKAGES></AUTOSAR>"
    return _part_docs(spark, sf, item, head, tail, "")


@query(
    "arxml_elements",
    "SELECT p_partkey // 20 AS doc_id, 'FRAME' AS kind, concat('F', p_partkey, '&', p_brand) AS name, "
    "concat('/Pkg/In/Deep/F', p_partkey, '&', p_brand) AS path FROM part UNION ALL "
    "SELECT DISTINCT p_partkey // 20, 'AR-PACKAGE', n, p FROM part, (VALUES ('Pkg', '/Pkg'), ('In', '/Pkg/In'), ('Deep', '/Pkg/In/Deep')) t(n, p)",
)
def arxml_elements(spark, sf):
    return engineering.arxml_elements(_arxml_docs(spark, sf), KEYS, F.col("body"))


@query(
    "arxml_references",
    "SELECT p_partkey // 20 AS doc_id, 'FRAME-REF' AS tag, 'FRAME' AS dest, concat('/P/F', p_partkey) AS target FROM part",
)
def arxml_references(spark, sf):
    return engineering.arxml_references(_arxml_docs(spark, sf), KEYS, F.col("body"))


def _reqif_docs(spark, sf):
    item = F.expr(
        "concat('<', element_at(array('SPEC-OBJECT', 'SPECIFICATION', 'SPEC-RELATION', 'DATATYPE-DEFINITION-STRING', 'SPEC-OBJECT-TYPE'), "
        "cast(p_partkey % 5 + 1 as int)), ' IDENTIFIER=\"i', p_partkey, '\"', if(p_partkey % 2 = 0, concat(' LONG-NAME=\"', p_name, '\"'), ''), '/>')"
    )
    head = (
        '<REQ-IF-HEADER IDENTIFIER="h"><COMMENT>of &lt;all&gt; parts</COMMENT><REQ-IF-TOOL-ID>maker</REQ-IF-TOOL-ID><TITLE>Spec</TITLE>'
        "<SOURCE-TOOL-ID>tool</SOURCE-TOOL-ID></REQ-IF-HEADER>"
    )
    return _part_docs(spark, sf, item, head, "", "")


@query(
    "reqif_elements",
    "SELECT p_partkey // 20 AS doc_id, ['SPEC-OBJECT', 'SPECIFICATION', 'SPEC-RELATION', 'DATATYPE-DEFINITION-STRING', 'SPEC-OBJECT-TYPE']"
    "[p_partkey % 5 + 1] AS kind, concat('i', p_partkey) AS identifier, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '-' END AS long_name FROM part",
)
def reqif_elements(spark, sf):
    return engineering.reqif_elements(_reqif_docs(spark, sf), KEYS, F.col("body"))


@query(
    "reqif_header",
    "SELECT DISTINCT p_partkey // 20 AS doc_id, 'Spec' AS title, 'h' AS identifier, 'of <all> parts' AS comment, 'maker' AS tool, 'tool' AS source_tool, '' AS created FROM part",
)
def reqif_header(spark, sf):
    return engineering.reqif_header(_reqif_docs(spark, sf), KEYS, F.col("body"))


# --------------------------------------------------------------------- captures

_ETHERNET = "02A4C6001F3D02B7E9520A68"


def _packet_hex():
    """Hex of one packet per event: DNS query, TCP segment, tagged ARP request."""
    user, k = F.col("user_id"), F.col("event_id")
    name_hex = F.concat(big_endian(F.length("event_type"), 1), F.hex(F.encode("event_type", "UTF-8")), F.lit("076578616D706C6500"))
    dns = F.concat(big_endian(k % 65536, 2), F.lit("01000001000000000000"), name_hex, F.lit("00010001"))
    dns_size = F.length(dns) / 2
    address = F.concat(F.lit("0A00"), big_endian(user % 65536, 2))
    ip = lambda size, proto: F.concat(
        F.lit("4500"), big_endian(size + 20, 2), F.lit("0000000040"), F.lit(proto), F.lit("0000"), address, F.lit("08080808")
    )
    port = big_endian(F.lit(40000) + k % 1000, 2)
    udp = F.concat(port, F.lit("0035"), big_endian(dns_size + 8, 2), F.lit("0000"), dns)
    tcp = F.concat(port, F.lit("2710"), big_endian(k, 4), F.lit("000000005002FFFF00000000"))
    arp = F.concat(F.lit("81000005080600010800060400" + "01" + "02B7E9520A68"), address, F.lit("00000000000008080808"))
    return (
        F.when(k % 3 == 0, F.concat(F.lit(_ETHERNET + "0800"), ip(dns_size + 8, "11"), udp))
        .when(k % 3 == 1, F.concat(F.lit(_ETHERNET + "0800"), ip(F.lit(20), "06"), tcp))
        .otherwise(F.concat(F.lit(_ETHERNET), arp))
    )


def _capture_bodies(events, record):
    """``(doc_id, body)``: the records of a hundred events. They are written before the shuffle; inside the aggregate
    they would be interpreted row by row."""
    doc = F.floor(F.col("event_id") / 100)
    written = events.select("event_id", record.alias("_record")).repartition(doc)
    return joined(written, doc, "event_id", F.col("_record"), "")


def pcap_docs(spark, sf):
    """Classic captures of a hundred events; odd ones are big endian with nanoseconds."""
    events = table(spark, sf, "events").withColumn("_p", _packet_hex())
    odd = F.floor(F.col("event_id") / 100) % 2 == 1
    word = lambda v: F.when(odd, big_endian(v, 4)).otherwise(little_endian(v, 4))
    size = F.length("_p") / 2
    record = F.concat(word(F.col("event_id")), word(F.col("user_id")), word(size), word(size + 4), "_p")
    docs = _capture_bodies(events, record)
    head = F.when(F.col("doc_id") % 2 == 1, "A1B23C4D00020004000000000000000000040000" + "00000001").otherwise(
        "D4C3B2A1020004000000000000000000" + "00000400" + "01000000"
    )
    return docs.select(F.concat(F.lit("c"), "doc_id").alias("capture"), F.unhex(F.concat(head, "body")).alias("content"))


_PACKETS = (
    "(SELECT concat('c', event_id // 100) AS capture, row_number() OVER (PARTITION BY event_id // 100 ORDER BY event_id) AS n, "
    "event_id AS ts_s, user_id AS ts_fraction, CASE WHEN event_id // 100 % 2 = 1 THEN 'ns' ELSE 'us' END AS unit, "
    "CASE event_id % 3 WHEN 0 THEN 67 + length(event_type) + 1 WHEN 1 THEN 54 ELSE 46 END AS cap_len, "
    "['DNS', 'IPv4/TCP', 'ARP'][event_id % 3 + 1] AS protocol, "
    "concat('10.0.', user_id % 65536 // 256, '.', user_id % 256, CASE WHEN event_id % 3 = 2 THEN ' (02:b7:e9:52:0a:68)' ELSE "
    "concat(':', 40000 + event_id % 1000) END) AS source, "
    "['8.8.8.8:53', '8.8.8.8:10000', '8.8.8.8 (00:00:00:00:00:00)'][event_id % 3 + 1] AS destination, "
    "CASE event_id % 3 WHEN 0 THEN concat('Query id=0x', lpad(lower(to_hex(event_id % 65536)), 4, '0'), "
    "', rcode=NOERROR, questions=1, answers=0, ', event_type, '.example A') "
    "WHEN 1 THEN concat('TCP SYN, seq=', event_id, ', ack=0, win=65535, 0 byte payload') "
    "ELSE concat('Who has 8.8.8.8? Tell 10.0.', user_id % 65536 // 256, '.', user_id % 256, ' VLAN 5') END AS info, event_type FROM events) p"
)
_PACKET_COLUMNS = "capture, n, ts_s, ts_fraction, unit, cap_len, protocol, source, destination, info"


def _packets(spark, sf):
    return packets.dissect(captures.pcap_records(pcap_docs(spark, sf)))


@query("packets", f"SELECT {_PACKET_COLUMNS} FROM {_PACKETS}")
def packets_query(spark, sf):
    return _packets(spark, sf).select(*_PACKET_COLUMNS.split(", "))


@query("capture_summary", f"SELECT protocol, count(*) AS packets, CAST(sum(cap_len) AS BIGINT) AS bytes FROM {_PACKETS} GROUP BY 1")
def capture_summary(spark, sf):
    return packets.protocol_totals(_packets(spark, sf))


@query(
    "capture_endpoints",
    "SELECT least(source, destination) AS a, greatest(source, destination) AS b, count(*) AS packets, CAST(sum(cap_len) AS BIGINT) AS bytes "
    f"FROM {_PACKETS} GROUP BY 1, 2",
)
def capture_endpoints(spark, sf):
    return packets.endpoint_totals(_packets(spark, sf))


@query(
    "capture_top_names",
    f"SELECT concat(event_type, '.example') AS name, count(*) AS n FROM {_PACKETS} WHERE protocol = 'DNS' GROUP BY 1",
)
def capture_top_names(spark, sf):
    return packets.top_names(_packets(spark, sf))


@query(
    "capture_truncated",
    "SELECT DISTINCT concat('c', event_id // 100) AS capture FROM events WHERE event_id // 100 % 3 = 0",
)
def capture_truncated(spark, sf):
    """Every third capture loses its last three bytes."""
    docs = pcap_docs(spark, sf)
    cut = F.substring(F.col("capture"), 2, 20).cast("long") % 3 == 0
    content = F.when(cut, F.substring(F.col("content"), F.lit(1), F.length("content") - 3)).otherwise(F.col("content"))
    damaged = docs.select("capture", content.alias("content"))
    return captures.truncated_captures(damaged, captures.pcap_records(damaged)).select("capture")


def pcapng_docs(spark, sf):
    """Next-generation captures: a section, two interfaces, a packet block per event."""
    events = table(spark, sf, "events").withColumn("_p", _packet_hex())
    pad = (F.lit(4) - (F.length("_p") / 2).cast("int") % 4) % 4
    padded = F.concat("_p", F.repeat(F.lit("00"), pad))
    size = F.length(padded) / 2 + 32
    word = lambda v: little_endian(v, 4)
    captured = F.length("_p") / 2
    enhanced = F.concat(
        F.lit("06000000"), word(size), word(F.col("event_id") % 2), word(F.lit(1)), word(F.col("event_id")), word(captured),
        word(captured), padded, word(size),
    )
    docs = _capture_bodies(events, enhanced)
    section = "0A0D0D0A1C0000004D3C2B1A01000000FFFFFFFFFFFFFFFF1C000000"
    interface = lambda link: f"0100000014000000{link}00000000040014000000"
    content = F.unhex(F.concat(F.lit(section + interface("0100") + interface("0100")), "body"))
    return docs.select(F.concat(F.lit("g"), "doc_id").alias("capture"), content.alias("content"))


@query(
    "pcapng_packets",
    "SELECT concat('g', event_id // 100) AS capture, event_id % 2 AS interface_id, 4294967296 + event_id AS ts_units, protocol, source, destination, info "
    f"FROM (SELECT *, ts_s AS event_id FROM {_PACKETS}) q",
)
def pcapng_packets(spark, sf):
    found = packets.pcapng_packets(captures.pcapng_blocks(pcapng_docs(spark, sf)))
    return packets.dissect(found).select("capture", "interface_id", "ts_units", "protocol", "source", "destination", "info")


@query(
    "pcapng_blocks",
    "SELECT concat('g', event_id // 100) AS capture, 'Enhanced Packet' AS kind, count(*) AS n FROM events GROUP BY 1 UNION ALL "
    "SELECT DISTINCT concat('g', event_id // 100), k, c FROM events, (VALUES ('Section Header', 1), ('Interface Description', 2)) v(k, c)",
)
def pcapng_blocks(spark, sf):
    return packets.block_counts(captures.pcapng_blocks(pcapng_docs(spark, sf)))
