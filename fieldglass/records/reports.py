"""Analysis and test reports, bills of material, maps, tracks and notebooks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions.binding import let
from fieldglass.functions.formatting import unescape_xml
from fieldglass.functions.json_text import strict_json
from fieldglass.functions.json_walk import walk as walk_json
from fieldglass.functions.json_walk import with_records
from fieldglass.functions.xml_walk import attribute, element_rows
from fieldglass.operators.ordering import BUCKET_ROWS, previous_in_group

SARIF_SCHEMA = (
    "runs array<struct<tool: struct<driver: struct<name: string>>, results: array<struct<ruleId: string, level: string, "
    "message: struct<text: string>, locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, "
    "region: struct<startLine: bigint>>>>>>>>"
)


def sarif_results(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """One row per result; the level defaults to ``warning``, the place is the first location."""
    runs = F.from_json(text, SARIF_SCHEMA)["runs"]
    results = df.select(*keys, F.explode(runs).alias("_r")).select(
        *keys, F.col("_r.tool.driver.name").alias("tool"), F.explode("_r.results").alias("_x")
    )
    place = F.get(F.col("_x.locations"), F.lit(0))["physicalLocation"]
    return results.select(
        *keys,
        "tool",
        F.col("_x.ruleId").alias("rule"),
        F.coalesce("_x.level", F.lit("warning")).alias("level"),
        F.col("_x.message.text").alias("message"),
        place["artifactLocation"]["uri"].alias("uri"),
        place["region"]["startLine"].alias("line"),
    )


def facet_filter(df: DataFrame, **facets: str | None) -> DataFrame:
    """Rows equal to every facet that is given."""
    for name, value in facets.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def junit_cases(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """One row per test case with its outcome: error, failure, skipped or passed.

    Suites may lie inside suites: ``suite`` names the innermost one, ``suite_path`` all
    of them from the outside in.
    """
    rows = element_rows(df, keys, text, ["testcase"], name_attribute="name").withColumnRenamed("element", "_c")
    found = lambda part: F.array_contains("_c.children", part)
    return rows.select(
        *keys,
        F.col("_c.parent_name").alias("suite"),
        F.col("_c.base").alias("suite_path"),
        attribute(F.col("_c.attributes"), "classname").alias("class_name"),
        F.col("_c.name").alias("name"),
        attribute(F.col("_c.attributes"), "time").try_cast("double").alias("time"),
        F.when(found("error"), "error").when(found("failure"), "failure").when(found("skipped"), "skipped").otherwise("passed").alias("outcome"),
    )


def junit_totals(cases: DataFrame, keys: list[str]) -> DataFrame:
    """Cases per outcome and total time per suite; a suite's inner suites count for themselves."""
    by = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return cases.groupBy(*keys, "suite", "suite_path").agg(
        F.count(F.lit(1)).alias("cases"), by("passed"), by("failure"), by("error"), by("skipped"), F.sum("time").alias("time")
    )


SBOM_COMPONENT = (
    "struct<`bom-ref`: string, name: string, version: string, purl: string, "
    "licenses: array<struct<license: struct<id: string, name: string>, expression: string>>>"
)
SBOM_EDGES = "dependencies array<struct<ref: string, dependsOn: array<string>>>"
#: Components lie in the document, in its metadata, and in each other.
_COMPONENT_PATH = r"^(/metadata/component|/components/[0-9]+)(/components/[0-9]+)*\Z"


def sbom_components(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """One row per component, however deep inside others; licences as identifiers, else names, else expressions.

    ``path`` is the component's place in the document.
    """
    place = re.compile(_COMPONENT_PATH)
    read = with_records(
        df.select(*keys, text.alias("_text")), "_text", "_spots", lambda r: not r[0] and r[7] == "{" and place.match(r[1]) is not None
    )

    def components(both: Column) -> Column:
        def component(r: Column) -> Column:
            place = F.concat(F.lit("$"), F.replace(F.regexp_replace(r["path"], "/([0-9]+)", "[$1]"), F.lit("/"), F.lit(".")))
            return F.struct(r["path"].alias("path"), F.try_variant_get(both["doc"], place, SBOM_COMPONENT).alias("c"))

        return F.transform(both["spots"], component)

    found = let(F.struct(strict_json(F.col("_text")).alias("doc"), F.col("_spots").alias("spots")), components)
    rows = read.select(*keys, F.inline(found).alias("_path", "_c"))
    licences = F.transform(
        F.col("_c.licenses"), lambda x: F.coalesce(x["license"]["id"], x["license"]["name"], x["expression"])
    )
    return rows.select(
        *keys,
        F.col("_path").alias("path"),
        F.col("_c.bom-ref").alias("ref"),
        F.col("_c.name").alias("name"),
        F.col("_c.version").alias("version"),
        F.col("_c.purl").alias("purl"),
        licences.alias("licences"),
    )


def sbom_dependencies(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """One row per direct dependency edge."""
    edges = F.from_json(text, SBOM_EDGES)["dependencies"]
    return df.select(*keys, F.explode(edges).alias("_d")).select(
        *keys, F.col("_d.ref").alias("ref"), F.explode("_d.dependsOn").alias("depends_on")
    )


def sbom_dangling(components: DataFrame, dependencies: DataFrame, keys: list[str]) -> DataFrame:
    """Edges to a component that the same document does not list."""
    known = components.select(*keys, F.col("ref").alias("depends_on")).distinct()
    return dependencies.join(known, [*keys, "depends_on"], "left_anti")


def licence_counts(components: DataFrame) -> DataFrame:
    return components.select(F.explode("licences").alias("licence")).groupBy("licence").agg(F.count(F.lit(1)).alias("components"))


def _positions(geometry: Column) -> Column:
    """All positions of a geometry as ``array<array<double>>``."""
    kind = F.try_variant_get(geometry, "$.type", "string")
    at = lambda dtype: F.try_variant_get(geometry, "$.coordinates", dtype)
    line, area, areas = "array<array<double>>", "array<array<array<double>>>", "array<array<array<array<double>>>>"
    return (
        F.when(kind == "Point", F.array(at("array<double>")))
        .when(kind.isin("LineString", "MultiPoint"), at(line))
        .when(kind.isin("Polygon", "MultiLineString"), F.flatten(at(area)))
        .when(kind == "MultiPolygon", F.flatten(F.flatten(at(areas))))
    )


def _collected_positions(geometry: Column, collected: Column) -> Column:
    """All positions of a geometry collection, through the collections inside it."""
    inner = F.filter(
        walk_json(F.when(collected, F.to_json(geometry))),
        lambda r: ~r["closes"] & (r["token"] == "{") & r["path"].rlike("^(/geometries/[0-9]+)+$"),
    )

    def part(r: Column) -> Column:
        place = F.concat(F.lit("$"), F.regexp_replace(r["path"], "/geometries/([0-9]+)", ".geometries[$1]"))
        return let(F.try_variant_get(geometry, place, "variant"), _positions)

    return F.flatten(F.filter(F.transform(inner, part), lambda p: p.isNotNull()))


def geojson_features(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """One row per feature: id, geometry type, properties, bounding box, vertices.

    A bare feature or geometry counts as one feature. The parts of a geometry
    collection are taken together, collections inside it too.
    """
    doc = F.col("_doc")
    kind = F.try_variant_get(doc, "$.type", "string")
    many = F.try_variant_get(doc, "$.features", "array<variant>")
    features = F.when(kind == "FeatureCollection", many).otherwise(F.array(doc))
    rows = df.select(*keys, strict_json(text).alias("_doc")).select(*keys, F.posexplode(features).alias("idx", "_f"))
    f = F.col("_f")
    is_feature = F.try_variant_get(f, "$.type", "string") == "Feature"
    geometry = F.when(is_feature, F.try_variant_get(f, "$.geometry", "variant")).otherwise(f)
    located = rows.select(*keys, "idx", "_f", is_feature.alias("_feature"), geometry.alias("_g"))
    collected = F.try_variant_get("_g", "$.type", "string") == "GeometryCollection"
    spots = F.when(collected, _collected_positions(F.col("_g"), collected)).otherwise(_positions(F.col("_g")))
    placed = located.withColumn("_p", spots)
    axis = lambda i: F.transform("_p", lambda v: F.get(v, F.lit(i)))
    return placed.select(
        *keys,
        "idx",
        F.try_variant_get("_f", "$.id", "string").alias("id"),
        F.try_variant_get("_g", "$.type", "string").alias("geometry_type"),
        F.when(F.col("_feature"), F.to_json(F.try_variant_get("_f", "$.properties", "variant"))).alias("properties"),
        F.array_min(axis(0)).alias("west"),
        F.array_min(axis(1)).alias("south"),
        F.array_max(axis(0)).alias("east"),
        F.array_max(axis(1)).alias("north"),
        F.coalesce(F.size("_p"), F.lit(0)).alias("n_vertices"),
    )


def notebook_cells(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """One row per cell; a source given as lines is joined."""
    cells = F.try_variant_get("_doc", "$.cells", "array<variant>")
    rows = df.select(*keys, strict_json(text).alias("_doc")).select(*keys, F.posexplode(cells).alias("idx", "_c"))
    lines = F.array_join(F.try_variant_get("_c", "$.source", "array<string>"), "")
    outputs = F.coalesce(F.try_variant_get("_c", "$.outputs", "array<variant>"), F.array().cast("array<variant>"))
    kinds = F.transform(outputs, lambda o: F.try_variant_get(o, "$.output_type", "string"))
    return rows.select(
        *keys,
        "idx",
        F.try_variant_get("_c", "$.cell_type", "string").alias("cell_type"),
        F.coalesce(lines, F.try_variant_get("_c", "$.source", "string")).alias("source"),
        F.size(outputs).alias("n_outputs"),
        F.array_join(F.array_sort(F.array_distinct(kinds)), ",").alias("output_types"),
        F.exists(kinds, lambda k: k == "error").alias("failed"),
    )


GPX_SCHEMA = (
    "trk array<struct<name: string, trkseg: array<struct<trkpt: array<struct<_lat: double, _lon: double, ele: double, time: string>>>>>>"
)
EARTH_RADIUS_M = 6371000.0


def gpx_points(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """One row per track point, numbered within its segment."""
    tracks = df.select(*keys, F.from_xml(text, GPX_SCHEMA).alias("_d")).select(*keys, F.posexplode("_d.trk").alias("track", "_t"))
    segments = tracks.select(*keys, "track", F.col("_t.name").alias("name"), F.posexplode("_t.trkseg").alias("segment", "_s"))
    points = segments.select(*keys, "track", "name", "segment", F.posexplode("_s.trkpt").alias("idx", "_p"))
    return points.select(
        *keys,
        "track",
        "name",
        "segment",
        "idx",
        F.col("_p._lat").alias("lat"),
        F.col("_p._lon").alias("lon"),
        F.col("_p.ele").alias("ele"),
        F.unix_micros(F.try_to_timestamp("_p.time")).alias("at_us"),
    )


_PLACE = "_lat: double, _lon: double, ele: double, time: string, name: string"
GPX_PLACES = f"wpt array<struct<{_PLACE}>>, rte array<struct<name: string, rtept: array<struct<{_PLACE}>>>>"


def gpx_places(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """Waypoints and the points of routes, in order: ``kind``, the route's number and name, the point's name and place."""
    read = df.select(*keys, F.from_xml(text, GPX_PLACES).alias("_d"))
    ways = read.select(*keys, F.lit("waypoint").alias("kind"), F.lit(None).cast("int").alias("route"), F.lit(None).cast("string").alias("route_name"), F.posexplode("_d.wpt").alias("idx", "_p"))
    routes = read.select(*keys, F.lit("route").alias("kind"), F.posexplode("_d.rte").alias("route", "_r"))
    stops = routes.select(*keys, "kind", "route", F.col("_r.name").alias("route_name"), F.posexplode("_r.rtept").alias("idx", "_p"))
    return ways.unionByName(stops).select(
        *keys,
        "kind",
        "route",
        "route_name",
        "idx",
        F.col("_p.name").alias("name"),
        F.col("_p._lat").alias("lat"),
        F.col("_p._lon").alias("lon"),
        F.col("_p.ele").alias("ele"),
        F.unix_micros(F.try_to_timestamp("_p.time")).alias("at_us"),
    )


def kml_places(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """The points of a map document's places, in order, with the name and time of the place.

    A place is a ``Placemark``; its time is that of its time stamp, or the begin of its span.
    """
    marks = F.regexp_extract_all(text, F.lit(r"(?s)<Placemark\b[^>]*>(.*?)</Placemark>"), F.lit(1))
    rows = df.select(*keys, F.posexplode(marks).alias("idx", "_m"))
    inside = lambda tag: F.regexp_extract("_m", rf"(?s)<{tag}\b[^>]*>\s*(.*?)\s*</{tag}>", 1)
    spot = F.regexp_extract("_m", r"(?s)<Point\b[^>]*>.*?<coordinates>\s*(.*?)\s*</coordinates>", 1)
    when = F.when(inside("when") != "", inside("when")).otherwise(inside("begin"))
    part = lambda i: F.get(F.split("_spot", ","), F.lit(i)).try_cast("double")
    return rows.withColumn("_spot", spot).where("_spot <> ''").select(
        *keys,
        "idx",
        unescape_xml(inside("name")).alias("name"),
        part(1).alias("lat"),
        part(0).alias("lon"),
        part(2).alias("ele"),
        F.unix_micros(F.try_to_timestamp(when)).alias("at_us"),
    )


def kml_points(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """Points of the line strings of a map document, one track per line string."""
    lines = F.regexp_extract_all(text, F.lit(r"(?s)<LineString\b[^>]*>.*?<coordinates>\s*(.*?)\s*</coordinates>"), 1)
    tracks = df.select(*keys, F.posexplode(lines).alias("track", "_l"))
    points = tracks.select(*keys, "track", F.posexplode(F.split("_l", r"\s+")).alias("idx", "_p"))
    part = lambda i: F.get(F.split("_p", ","), F.lit(i)).try_cast("double")
    return points.select(
        *keys,
        "track",
        F.lit(None).cast("string").alias("name"),
        F.lit(0).alias("segment"),
        "idx",
        part(1).alias("lat"),
        part(0).alias("lon"),
        part(2).alias("ele"),
        F.lit(None).cast("long").alias("at_us"),
    )


def _haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def track_summary(points: DataFrame, keys: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Points, great-circle length, elapsed time and elevations per track.

    Steps are taken within a segment; a gap between segments adds no length.
    """
    steps = previous_in_group(points, [*keys, "track", "segment"], ["idx"], ["lat", "lon", "ele"], bucket_rows)
    # Guarded, because least() inside the formula would skip over nulls.
    known = F.col("prev_lat").isNotNull() & F.col("prev_lon").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    length = F.when(known, _haversine(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon")))
    rise = F.col("ele") - F.col("prev_ele")
    climb = F.when(rise > 0, rise)
    return steps.groupBy(*keys, "track").agg(
        F.count(F.lit(1)).alias("points"),
        F.coalesce(F.sum(length), F.lit(0.0)).alias("length_m"),
        ((F.max("at_us") - F.min("at_us")) / 1e6).alias("elapsed_s"),
        F.min("ele").alias("min_ele"),
        F.max("ele").alias("max_ele"),
        F.coalesce(F.sum(climb), F.lit(0.0)).alias("gain_m"),
    )


def count_by(df: DataFrame, *names: str) -> DataFrame:
    return df.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


