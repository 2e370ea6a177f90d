"""Delimited text: detection of the delimiter and whole-width scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.functions.binding import let

# Delimiter candidates, first wins a tie.
CANDIDATES = (",", "\t", ";", "|")
# The order in which the plain sniffing score tries candidates.
SNIFF_CANDIDATES = (",", ";", "\t", "|")
SAMPLE_LINES = 10


def _normalized(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), r"\r\n?", "\n")


def _unquoted(text: Column) -> Column:
    """Text with quoted spans emptied, so that what they hold is not counted.

    Doubled quotes need no care: they close and reopen a span. An unclosed
    span reaches to the end.
    """
    return F.regexp_replace(text, r'"[^"]*("|\z)', '"')


def sample_lines(text: Column, size: int = SAMPLE_LINES) -> Column:
    """The delimiters of the first non-empty logical lines.

    Quoted line breaks do not end a line, and quoted delimiters do not count.
    """
    lines = F.split(_unquoted(_normalized(text)), "\n")
    first = F.slice(F.filter(lines, lambda line: line != ""), 1, size)
    return F.transform(first, lambda line: F.regexp_replace(line, r"[^,;\t|]+", ""))


def _score(lines: Column, delimiter: str, priority: int) -> Column:
    counts = F.transform(lines, lambda s: F.length(s) - F.length(F.replace(s, F.lit(delimiter), F.lit(""))))

    def of_hits(hits: Column) -> Column:
        n = F.size(hits)
        mean = F.try_divide(F.aggregate(hits, F.lit(0.0), lambda a, c: a + c), n)
        spread = F.try_divide(F.aggregate(hits, F.lit(0.0), lambda a, c: a + (c - mean) * (c - mean)), n)
        share = n / F.size(lines)
        return F.struct(
            F.coalesce(mean * share * share, F.lit(0.0)).alias("score"),
            F.coalesce(-spread, F.lit(float("-inf"))).alias("steadiness"),
            F.lit(-priority).alias("priority"),
            F.lit(delimiter).alias("delimiter"),
        )

    return let(F.filter(counts, lambda c: c > 0), of_hits)


def detect_delimiter(text: Column, name: Column | None = None, size: int = SAMPLE_LINES) -> Column:
    """``struct(delimiter, confidence)`` of a text.

    The score of a candidate is its mean count over the lines that hold it,
    times the squared share of such lines; ties go to the steadier one, then
    to the earlier one. A ``.tsv`` name settles it.
    """
    found = let(sample_lines(text, size), _detect)
    if name is None:
        return found
    tsv = F.struct(F.lit("\t").alias("delimiter"), F.lit(1.0).alias("confidence"))
    return F.when(F.lower(name).endswith(".tsv"), tsv).otherwise(found)


def _detect(lines: Column) -> Column:
    ranked = F.reverse(F.array_sort(F.array(*[_score(lines, d, i) for i, d in enumerate(CANDIDATES)])))

    def verdict(r: Column) -> Column:
        best, second = F.get(r, F.lit(0)), F.get(r, F.lit(1))
        confidence = F.try_divide(best["score"] - second["score"], best["score"] + second["score"])
        return F.when(
            (F.size(lines) > 0) & (best["score"] > 0),
            F.struct(best["delimiter"].alias("delimiter"), confidence.alias("confidence")),
        )

    nothing = F.struct(F.lit(",").alias("delimiter"), F.lit(0.0).alias("confidence"))
    return F.coalesce(let(ranked, verdict), nothing)


def _marks(line: Column) -> Column:
    """Only the candidate delimiters of a line, those in quotes left out."""
    outside = F.when(F.contains(line, F.lit('"')), _unquoted(line)).otherwise(line)
    return F.regexp_replace(outside, r"[^,;\t|]+", "")


def sniff_delimiter(lines: Column) -> Column:
    """The plain score used when a text's kind is guessed: 100 per line that
    holds the candidate plus its occurrences; null when no line holds any."""

    def scored(marks: Column, delimiter: str, i: int) -> Column:
        counts = F.transform(marks, lambda s: F.length(s) - F.length(F.replace(s, F.lit(delimiter), F.lit(""))))
        score = F.aggregate(counts, F.lit(0), lambda a, n: a + n + F.when(n > 0, 100).otherwise(0))
        return F.struct(score.alias("score"), F.lit(-i).alias("order"), F.lit(delimiter).alias("delimiter"))

    def best(marks: Column) -> Column:
        return F.array_max(F.array(*[scored(marks, d, i) for i, d in enumerate(SNIFF_CANDIDATES)]))

    return let(let(F.transform(lines, _marks), best), lambda b: F.when(b["score"] > 0, b["delimiter"]))


# Marks a missing cell while reading; empty cells stay empty.
_MISSING = "\x00"


def _options(delimiter: str, multiline: bool) -> dict:
    return dict(
        sep=delimiter,
        quote='"',
        escape='"',
        header=False,
        multiLine=multiline,
        encoding="UTF-8",
        nullValue=_MISSING,
        mode="PERMISSIVE",
    )


def max_width(spark: SparkSession, path: str | list[str], delimiter: str = ",", multiline: bool = True) -> int:
    """Cells in the widest record: one scan, one number to the driver.

    The scan allows twice the width of the first record; a record that
    overflows it is reported by the reader, and the scan is widened.
    """
    options = _options(delimiter, multiline)
    room = max(8, 2 * len(spark.read.options(**options).csv(path).columns))
    while True:
        schema = ", ".join(f"_c{i} string" for i in range(room)) + ", _bad string"
        rows = spark.read.options(**options, columnNameOfCorruptRecord="_bad").schema(schema).csv(path)
        filled = [F.when(F.col(f"_c{i}").isNotNull(), i + 1).otherwise(0) for i in range(room)]
        over = F.col("_bad").isNotNull() & F.col(f"_c{room - 1}").isNotNull()
        found = rows.agg(F.max(F.greatest(*filled)).alias("width"), F.max(over).alias("over")).first()
        if not found["over"]:
            return found["width"] or 0
        room *= 2


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    delimiter: str = ",",
    has_header: bool = True,
    multiline: bool = True,
) -> DataFrame:
    """All-text scan as wide as the widest row.

    Short rows are padded with empty cells; cells beyond the header get
    ``Column N`` names. A first pass finds the width, because a reader given
    only a header drops the extra cells. ``multiline=False`` keeps large files
    splittable when no field holds a line break. Blank lines inside the file
    are skipped by the reader.
    """
    width = max_width(spark, path, delimiter, multiline)
    if width == 0:
        return spark.createDataFrame([], "`Column 1` string")
    options = _options(delimiter, multiline)
    schema = ", ".join(f"_c{i} string" for i in range(width))
    names: list[str | None] = [None] * width
    if has_header:
        first = spark.read.options(**options).schema(schema).csv(path).first()
        names = [h.lstrip("\ufeff") if h is not None else None for h in first]
        # Every file starts with the header line; the reader drops it per file.
        options["header"] = True
    rows = spark.read.options(**options).schema(schema).csv(path)

    def cell(i: int) -> Column:
        """Line breaks as line feeds; the one that ended the row is not part of it."""
        text = F.col(f"_c{i}")
        ends_row = F.col(f"_c{i + 1}").isNull() if i + 1 < width else F.lit(True)
        kept = F.when(ends_row, F.regexp_replace(text, r"\r\z", "")).otherwise(text)
        unified = F.when(F.contains(text, F.lit("\r")), F.regexp_replace(kept, r"\r\n?", "\n")).otherwise(text)
        return F.coalesce(unified, F.lit(""))

    titled = [f"Column {i + 1}" if n is None else n.rstrip("\r") for i, n in enumerate(names)]
    return rows.select(*[cell(i).alias(n) for i, n in enumerate(titled)])
