"""One pass over the tags of an XML text, with a stack of open elements.

Every closed element gives one record with what stands around and inside it, so
elements nested to any depth come out of one plan. As in ``json_walk`` the pass runs
over Arrow batches, a slice at a time.

An end tag that does not belong to the innermost open element is passed over, and an
element that is never closed gives no record.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.functions.formatting import XML_ENTITIES, unescape_xml
from fieldglass.functions.pieces import text_pieces

TOKEN = re.compile(
    r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^>]*+>"
    r"""|</?+[^\s/>!?][^\s/>]*+(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^<]++""",
    re.DOTALL,
)
_TAG = re.compile(r"</?([^\s/>]*)")

#: ``at`` orders elements as they are opened; ``base`` joins the names of the enclosing
#: elements; ``children`` are the distinct tags inside; ``text`` is what stands before the first child.
RECORD = (
    "struct<at:int,tag:string,attributes:string,name:string,base:string,text:string,children:array<string>,"
    "parent:string,parent_name:string>"
)


def attribute(attributes: Column, name: str) -> Column:
    """The value of an attribute, or null."""
    quoted = F.regexp_extract(attributes, _attribute_pattern(name), 1)
    return F.when(quoted != "", unescape_xml(F.substring(quoted, F.lit(2), F.length(quoted) - 2)))


def _attribute_pattern(name: str) -> str:
    return rf"""(?s)(?:^|\s){name}\s*=\s*("[^"]*+"|'[^']*+')"""


def _plain(text: str) -> str:
    if "&" in text:
        for char, entity in reversed(XML_ENTITIES):
            text = text.replace(entity, char)
    return text


class _Element:
    __slots__ = ("at", "attributes", "base", "children", "name", "tag", "text")

    def __init__(self, at: int, tag: str, attributes: str, name: str | None, base: str):
        self.at, self.tag, self.attributes, self.name, self.base = at, tag, attributes, name, base
        self.text: list[str] = []
        self.children: dict[str, None] = {}


def elements_of(text: str, name_attribute: str | None = None, name_tag: str | None = None) -> list[tuple]:
    """The closed elements of one text, inner ones first."""
    named = re.compile(_attribute_pattern(name_attribute)) if name_attribute else None
    out: list[tuple] = []
    stack = [_Element(-1, "", "", None, "")]

    def close(element: _Element) -> None:
        around = stack[-1]
        own = "".join(element.text)
        out.append(
            (element.at, element.tag, element.attributes, element.name, element.base, own, list(element.children), around.tag, around.name)
        )
        around.children[element.tag] = None
        if element.tag == name_tag and around.name is None and own.strip(" \t\r\n"):
            around.name = _plain(own.strip(" \t\r\n"))

    for at, m in enumerate(TOKEN.finditer(text)):
        token = m[0]
        top = stack[-1]
        if not token.startswith("<"):
            if not top.children:
                top.text.append(token)
        elif token.startswith("</"):
            if len(stack) > 1 and _TAG.match(token)[1] == top.tag:
                stack.pop()
                close(top)
        elif token.startswith("<![CDATA["):
            if not top.children:
                # Literal text; escaped, so that reading entities gives it back.
                top.text.append(token[9:-3].replace("&", "&amp;").replace("<", "&lt;"))
        elif token[1] not in "!?":
            tag = _TAG.match(token)[1]
            single = token.endswith("/>")
            attributes = token[1 + len(tag) : -2 if single else -1]
            found = named.search(attributes) if named else None
            base = top.base if top.name is None else f"{top.base}/{top.name}"
            element = _Element(at, tag, attributes, _plain(found[1][1:-1]) if found else None, base)
            if single:
                close(element)
            else:
                stack.append(element)
    return out


def element_rows(
    df: DataFrame, keys: list[str], text: Column, tags: list[str], name_attribute: str | None = None, name_tag: str | None = None
) -> DataFrame:
    """The keys and ``element``, a ``RECORD``, for each closed element with one of the tags, inner ones first; none for null.

    An element is named by ``name_attribute``, or by the text of its first child
    ``name_tag``.
    """
    wanted = frozenset(tags)

    def run(batches):
        import pyarrow as pa

        names = ["at", "tag", "attributes", "name", "base", "text", "children", "parent", "parent_name"]
        kinds = [pa.int32(), *[pa.string()] * 5, pa.list_(pa.string()), pa.string(), pa.string()]
        fields = [pa.field(n, k) for n, k in zip(names, kinds, strict=True)]
        for batch in batches:
            for piece in text_pieces(batch):
                owners, rows = [], []
                for i, one in enumerate(piece.column(piece.num_columns - 1).to_pylist()):
                    found = [] if one is None else [e for e in elements_of(one, name_attribute, name_tag) if e[1] in wanted]
                    owners += [i] * len(found)
                    rows += found
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
                made = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], fields=fields)
                own = [c.take(pa.array(owners, pa.int64())) for c in piece.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*own, made], names=[*piece.schema.names[:-1], "element"])

    given = df.select(*keys, text.alias("_text"))
    record = T.StructField("element", T._parse_datatype_string(RECORD))
    return given.mapInArrow(run, T.StructType([*given.schema.fields[:-1], record]))
