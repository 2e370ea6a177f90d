"""Secret scans that link the parts of multipart credentials.

Each text is read once for strong parts (assigned secrets, access identifiers,
long hexadecimal runs) and weak ones (short assigned secrets, user names,
endpoints). Weak parts alone mean nothing. They become candidates only where a
complementary part stands in the same scope: a secret needs an identifier or an
endpoint, an identifier or endpoint needs a secret, strong or weak. Scopes are
joined as intervals: parts are dealt to blocks of one scope width, each block
meets itself and its two neighbours, and parts count as together when their
starts are at most a scope width apart.

The join runs on Spark over the parts of all documents. For every block only the
first and last start of each role are carried (they decide for the blocks
beside it), so a text with very many parts makes no pairs.

Null texts are empty and have no parts. Repeated rows, even with one id, are told
apart by their place in the written table. Very long texts are read whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.llm.register import query, table
from fieldglass.llm.shared import stage

#: Characters between parts of one credential.
SCOPE = 200
BASE_KINDS = ("assign", "access", "hex")
ASSIGNED, ACCESS, HEX = 12, 18, 16
#: Which side of a credential each kind is. Strong parts serve both their own side and as partners.
ROLES = {
    "assign": "secret",
    "hex": "secret",
    "access": "name",
    "weak_secret": "secret",
    "weak_user": "name",
    "weak_endpoint": "name",
}

_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
_ASSIGN_SIGNS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_USER = re.compile(r"(?:user(?:name)?|login|account|client_id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.@-]+", re.IGNORECASE | re.ASCII)
_USER_SIGNS = ("user", "login", "account", "client_id")
# An address, a mailbox or four numbers; the first two are sought from their signs outwards.
_AFTER_SCHEME = re.compile(r"[^\s\"'<>]+", re.ASCII)
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"\b\d{1,3}(?:\.\d{1,3}){3}\b", re.ASCII)
_LETTER = re.compile(r"[a-z]")
_SCHEME_SIGNS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-")
_BOX_SIGNS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
#: A weak secret is shorter than a reported one, but not trivial.
WEAK_SECRET = 6


def _run_before(text: str, at: int, first: int, signs: frozenset) -> int:
    """Where the run of signs that ends before ``at`` begins, not before ``first``."""
    while at > first and text[at - 1] in signs:
        at -= 1
    return at


def _address(text: str, first: int) -> tuple[int, int] | None:
    """The first ``scheme://rest`` whose parts lie from ``first`` on."""
    at = text.find("://", first)
    while at >= 0:
        begin = _LETTER.search(text, _run_before(text, at, first, _SCHEME_SIGNS), at)
        rest = _AFTER_SCHEME.match(text, at + 3)
        if begin and rest:
            return begin.start(), rest.end()
        at = text.find("://", at + 1)
    return None


def _mailbox(text: str, first: int) -> tuple[int, int] | None:
    """The first ``name@domain`` whose parts lie from ``first`` on."""
    at = text.find("@", first)
    while at >= 0:
        begin = _run_before(text, at, first, _BOX_SIGNS)
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            return begin, domain.end()
        at = text.find("@", at + 1)
    return None


def _four_numbers(text: str, first: int) -> tuple[int, int] | None:
    found = _NUMBERS.search(text, first)
    return found and found.span()


def endpoints(text: str) -> list[tuple[int, int]]:
    """Addresses, mailboxes and four numbers, leftmost first and none inside another.

    A run of signs is read once from each ``://`` or ``@`` behind it, so a long text without
    a break takes time in proportion to its length.
    """
    seekers = (_address, _mailbox, _four_numbers)
    found = [seek(text, 0) for seek in seekers]
    out, end = [], 0
    while any(found):
        begin, _, kind = min((span[0], i, i) for i, span in enumerate(found) if span)
        end = found[kind][1]
        out.append((begin, end))
        found = [seek(text, end) if span and span[0] < end else span for seek, span in zip(seekers, found, strict=True)]
    return out


def parts_of(text: str) -> list[tuple[str, int, int]]:
    """Strong and weak parts of a text: kind, start, end in characters."""
    found = []
    low = text.lower()
    if any(sign in low for sign in _ASSIGN_SIGNS):
        for m in _ASSIGN.finditer(text):
            n = len(m[2])
            if n >= ASSIGNED:
                found.append(("assign", m.start(), m.end()))
            elif n >= WEAK_SECRET:
                found.append(("weak_secret", m.start(), m.end()))
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    if any(sign in low for sign in _USER_SIGNS):
        found += [("weak_user", m.start(), m.end()) for m in _USER.finditer(text)]
    if "://" in text or "@" in text or text.count(".") >= 3:
        found += [("weak_endpoint", a, b) for a, b in endpoints(text)]
    return found


#: Columns that the operator adds to documents while it works.
PARTS, ROW, LINKED = "__credential_parts", "__credential_row", "__credential_linked"
SPANS = "array<struct<kind:string,start:int,end:int>>"


def scan_parts(docs: DataFrame) -> DataFrame:
    """The rows with all parts of their texts as a further column."""

    def scan(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in parts_of(t or "")] for t in texts]
            yield batch.append_column(PARTS, pa.array(found, kind))

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField(PARTS, T._parse_datatype_string(SPANS))]))


def _weak(parts: str = PARTS) -> Column:
    return F.exists(parts, lambda p: p.kind.startswith("weak"))


def _row() -> Column:
    """A row's place in the written table."""
    return F.concat_ws(":", "_metadata.file_name", "_metadata.row_index")


def link_parts(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``_row, _linked``: the weak parts that have a partner in scope, by row of a written table."""
    role = F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), F.col("kind"))
    # Documents without a weak part need no join.
    parts = (
        scanned.where(_weak())
        .select(_row().alias("_row"), F.inline(PARTS))
        .select("_row", "kind", "start", "end", role.alias("role"), F.floor(F.col("start") / scope).alias("block"))
    )
    # Partners of a role, by block: the first and the last start there.
    edges = parts.groupBy("_row", "block", "role").agg(F.min("start").alias("_first"), F.max("start").alias("_last"))
    # All starts of one block lie in one scope.
    weak = parts.where(F.col("kind").startswith("weak"))
    wanted = F.when(F.col("role") == "secret", "name").otherwise("secret")
    blocks = F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)
    around = weak.select("*", wanted.alias("wanted"), F.explode(blocks).alias("near"))
    other = edges.select("_row", F.col("block").alias("near"), F.col("role").alias("wanted"), "_first", "_last")
    close = (
        (F.col("near") == F.col("block"))
        | ((F.col("near") < F.col("block")) & (F.col("start") - F.col("_last") <= scope))
        | ((F.col("near") > F.col("block")) & (F.col("_first") - F.col("start") <= scope))
    )
    return (
        around.join(other, ["_row", "near", "wanted"])
        .where(close)
        .select("_row", "kind", "start", "end")
        .distinct()
        .groupBy("_row")
        .agg(F.collect_list(F.struct("kind", "start", "end")).alias("_linked"))
    )


def _strong(parts: str = PARTS) -> Column:
    return F.filter(parts, lambda p: ~p.kind.startswith("weak"))


def _with_spans(scanned: DataFrame, scope: int) -> DataFrame:
    """A written table of scanned rows, its parts cut down to the spans that are reported."""
    linked = F.coalesce(LINKED, F.array().cast(SPANS))
    plain = scanned.where(~_weak()).withColumn(PARTS, _strong())
    found = link_parts(scanned, scope).select(F.col("_row").alias(ROW), F.col("_linked").alias(LINKED))
    joined = scanned.where(_weak()).withColumn(ROW, _row()).join(found, ROW, "left")
    return plain.unionByName(joined.withColumn(PARTS, F.concat(_strong(), linked)).drop(ROW, LINKED))


def find_credentials(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``doc_id, spans`` of every document: strong parts, and weak ones with a partner in scope."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = _with_spans(stage(scan_parts(given).drop("text"), "credential-parts"), scope)
    return found.withColumnRenamed(PARTS, "spans")


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The documents with their credentials masked; other columns stay; a column ``n_chars`` follows a changed text."""
    found = _with_spans(stage(scan_parts(docs), "credential-parts"), scope)

    def replace(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            spans = batch.column(batch.schema.get_field_index(PARTS)).to_pylist()
            new = [
                masked(t, [(s["start"], s["end"], s["kind"]) for s in found]) if found else t
                for t, found in zip(texts, spans, strict=True)
            ]
            at = batch.schema.get_field_index("text")
            batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            if "n_chars" in batch.schema.names:
                at = batch.schema.get_field_index("n_chars")
                counts = [
                    len(t) if found else n
                    for n, t, found in zip(batch.column(at).to_pylist(), new, spans, strict=True)
                ]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(counts, batch.schema.field(at).type))
            yield batch.select([n for n in batch.schema.names if n != PARTS])

    return found.mapInArrow(replace, docs.schema)


def _joined(spans: Column, kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` by start, then kind in the order given."""
    rank = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    ordered = F.sort_array(F.transform(spans, lambda p: F.struct(p.start, F.element_at(rank, p.kind).alias("rank"), p.end, p.kind)))
    return F.array_join(F.transform(ordered, lambda p: F.concat_ws(":", p.kind, p.start, p.end)), ",")


_SQL = r"""
with texts as (
    select doc_id, replace(coalesce(text, ''), chr(1), chr(2)) as text from documents
), kinds(kind, pattern) as (
    values ('assign', '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
        ('access', 'AKIA[A-Z0-9]+'), ('hex', '[0-9a-f]+'),
        ('weak_user', '(?:[Uu][Ss][Ee][Rr](?:[Nn][Aa][Mm][Ee])?|[Ll][Oo][Gg][Ii][Nn]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt]|[Cc][Ll][Ii][Ee][Nn][Tt]_[Ii][Dd])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.@-]+'),
        ('weak_endpoint', '[a-z][a-z0-9+.-]*://[^\s"''<>]+|[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|\b\d{1,3}(?:\.\d{1,3}){3}\b')
), cut as (
    select doc_id, kind, string_split(regexp_replace(text, pattern, chr(1) || '\0' || chr(1), 'g'), chr(1)) as bits
    from texts, kinds
), bits as (
    select doc_id, kind, unnest(bits) as bit, generate_subscripts(bits, 1) as i from cut
), placed as (
    select doc_id, kind, bit, i, (sum(length(bit)) over (partition by doc_id, kind order by i))::bigint as stop from bits
), hits as (
    select doc_id, kind, bit, stop - length(bit) as start, stop,
        length(regexp_extract(bit, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) as worth
    from placed where i % 2 = 0
), parts as (
    select doc_id, case when kind = 'assign' and worth < 12 then 'weak_secret' else kind end as kind, start, stop
    from hits
    where case kind when 'assign' then worth >= 6 when 'access' then length(bit) >= 18
        when 'hex' then length(bit) >= 16 else true end
), sided as (
    select *, kind in ('assign', 'hex', 'weak_secret') as secret,
        case kind when 'assign' then 0 when 'access' then 1 when 'hex' then 2 when 'weak_secret' then 3
            when 'weak_user' then 4 else 5 end as rank
    from parts
), told as (
    select doc_id, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access,
        count(*) filter (where kind = 'hex') as n_hex,
        string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) filter (where rank < 3) as base,
        string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) as spans
    from sided p
    where rank < 3 or exists (
        select 1 from sided o where o.doc_id = p.doc_id and o.secret <> p.secret and abs(o.start - p.start) <= 200)
    group by doc_id
)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
    sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join told t on d.doc_id = t.doc_id
"""


@query("op9_secret_scan", _SQL)
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, with linked weak candidates."""
    found = find_credentials(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda p: p.kind.isin(*BASE_KINDS))

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda p: p.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[of(k) for k in BASE_KINDS],
        F.sha2(_joined(base, BASE_KINDS), 256).alias("base_sha256"),
        _joined(F.col("spans"), tuple(ROLES)).alias("spans"),
    )
