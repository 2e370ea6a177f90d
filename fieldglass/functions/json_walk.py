"""One pass over the tokens of a JSON text, with a stack of open containers.

The plan is the same for every depth: a deep document costs its own row time and
nothing else. The pass runs over Arrow batches, because folding with a stack in
array expressions copies what it has gathered at every token.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.functions.json_text import strict_json
from fieldglass.functions.pieces import PIECE_BYTES, byte_sizes, pieces, text_pieces

# A key with its colon, a string, a bracket, or another scalar; commas carry nothing.
TOKEN = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?+|[\[\]{}]|[^\s\[\]{},:"]++', re.DOTALL)

#: Tokens of the shapes of documents that a task keeps at most.
SHAPE_TOKENS = 50_000

#: One record per value and one per closed container (``closes``; ``ordinal`` is then its number of children).
RECORD = (
    "struct<closes:boolean,path:string,parent_path:string,key:string,parent_kind:string,depth:int,ordinal:int,"
    "token:string,filled:boolean>"
)


def _spelled(quoted: str) -> str:
    if "\\" not in quoted:
        return quoted[1:-1]
    # Half a surrogate pair has no place in a text.
    return json.loads(quoted).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def records_of(text: str) -> list[list]:
    """The records of one valid document in written order.

    Of repeated keys the last value counts, at its place.
    """
    tokens = TOKEN.findall(text)
    out = _placed_records(tokens)
    for r in out:
        r[7] = tokens[r[7]]
    return out


def _placed_records(tokens: list[str]) -> list[list]:
    """The records of a document's tokens, each with the place of its token instead of the token."""
    out: list[list] = []
    # Of each open container: its record, kind, path, number of children, and the records of its keys so far.
    stack: list[list] = []
    key, dropped = "$", []

    def value(place: int) -> None:
        if not stack:
            out.append([False, "", None, "$", None, 0, 0, place, False, -1])
            return
        at, kind, path, count, seen = stack[-1]
        name = key if kind == "object" else str(count)
        if seen is not None:
            if name in seen:
                dropped.append(seen[name])
            seen[name] = len(out)
        step = name.replace("~", "~0").replace("/", "~1") if "~" in name or "/" in name else name
        out.append([False, f"{path}/{step}", path, name, kind, len(stack), count, place, False, at])
        stack[-1][3] = count + 1

    for place, token in enumerate(tokens):
        first = token[0]
        if first == '"' and token[-1] == ":":
            key = _spelled(token[:-1].rstrip())
        elif first in "{[":
            value(place)
            stack.append([len(out) - 1, "object" if first == "{" else "array", out[-1][1], 0, {} if first == "{" else None])
        elif first in "}]":
            at, _, path, count, _ = stack.pop()
            opened = out[at]
            opened[8] = count > 0
            out.append([True, path, opened[2], None, opened[4], opened[5], count, place, count > 0, at])
        else:
            value(place)
    return _without(out, dropped) if dropped else out


def _without(records: list[list], dropped: list[int]) -> list[list]:
    """The records without the values at the given places and all inside them, children counted anew."""
    gone = set(dropped)
    kept, counts = [], {}
    for i, r in enumerate(records):
        if (r[9] in gone) or (not r[0] and i in gone):
            gone.add(i)
            continue
        kept.append(r)
        if r[0]:
            r[6] = counts.get(r[9], 0)
        elif r[9] >= 0:
            r[6] = counts.get(r[9], 0)
            counts[r[9]] = r[6] + 1
    return kept


class Shapes:
    """What ``made(records, tokens)`` gives for documents that differ in their scalars only, computed once for all of them.

    A shape is a document's keys and brackets in order. What is kept is bounded by
    the records in it; a document of a shape not kept costs its own walk.
    """

    def __init__(self, made):
        self.made, self.known, self.held = made, {}, 0

    def of(self, text: str):
        """The document's tokens and what its shape gives."""
        tokens = TOKEN.findall(text)
        shape = tuple([t if t[-1] in ":[]{}" else None for t in tokens])
        found = self.known.get(shape)
        if found is None:
            found = self.made(_placed_records(tokens), tokens)
            if self.held + len(tokens) > SHAPE_TOKENS:
                self.known, self.held = {}, 0
            if len(tokens) <= SHAPE_TOKENS:
                self.known[shape] = found
                self.held += len(tokens)
        return tokens, found


def _columns_of(records: list[list], width: int) -> tuple[list[int], list[tuple]]:
    """The places of the records' tokens and the records as columns."""
    return [r[7] for r in records], list(zip(*records, strict=True))[:width] if records else [()] * width


class _Taken:
    """Rows of many documents: their tokens, and where in the columns of their shapes the rest lies."""

    def __init__(self, width: int):
        self.columns: list[list] = [[] for _ in range(width)]
        self.starts, self.counts, self.tokens, self.bases = [], [], [], {}

    def add(self, tokens: list[str], places: list[int], columns: list[tuple]) -> None:
        base = self.bases.get(id(places))
        if base is None:
            # The list is held too, so that no other one gets its id.
            base = self.bases[id(places)] = (len(self.columns[0]), places)
            for own, more in zip(self.columns, columns, strict=True):
                own += more
        self.starts.append(base[0])
        self.counts.append(len(places))
        self.tokens += [tokens[p] for p in places]

    def arrays(self, kinds: dict):
        """The columns numbered in ``kinds`` as Arrow arrays, row by row."""
        import numpy as np
        import pyarrow as pa

        counts = np.array(self.counts, dtype=np.int64)
        ends = np.cumsum(counts)
        at = np.arange(int(counts.sum())) + np.repeat(np.array(self.starts, dtype=np.int64) - (ends - counts), counts)
        rows = pa.array(at)
        return {i: pa.array(self.columns[i], kind).take(rows) for i, kind in kinds.items()}


def _walked(texts):
    """The records of a column of texts; only a slice of them is held as Python objects."""
    import pyarrow as pa

    shapes = Shapes(lambda records, _: _columns_of(records, 9))
    parts = [_walked_piece(p, shapes) for p in pieces(texts, byte_sizes(texts), PIECE_BYTES)]
    return pa.concat_arrays(parts) if len(parts) > 1 else parts[0] if parts else _walked_piece(texts, shapes)


def _walked_piece(texts, shapes=None, keep=None):
    import pyarrow as pa

    kinds = [pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_()]
    names = ["closes", "path", "parent_path", "key", "parent_kind", "depth", "ordinal", "token", "filled"]
    offsets, rows, taken = [0], [], _Taken(9)
    for text in texts.to_pylist():
        if text is not None:
            try:
                if keep is None:
                    tokens, found = shapes.of(text)
                    taken.add(tokens, *found)
                else:
                    rows += [r for r in records_of(text) if keep(r)]
            except (IndexError, ValueError):  # not valid; its records are not used
                pass
        offsets.append(len(rows) if keep else len(taken.tokens))
    if keep is None:
        made = taken.arrays({i: kind for i, kind in enumerate(kinds) if i != 7})
        parts = [pa.array(taken.tokens, pa.string()) if i == 7 else made[i] for i in range(9)]
    else:
        columns = list(zip(*rows, strict=True))[:9] if rows else [[]] * 9
        parts = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    fields = [pa.field(n, k) for n, k in zip(names, kinds, strict=True)]
    items = pa.StructArray.from_arrays(parts, fields=fields)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items, mask=texts.is_null())


_NODE = [("path", "string"), ("parent_path", "string"), ("key", "string"), ("depth", "int"), ("ordinal", "int"), ("place", "int"), ("token", "string"), ("filled", "boolean")]


def value_rows(df: DataFrame, text: str, depth: int | None = None) -> DataFrame:
    """One row per value of each valid document: the frame's other columns and those of ``_NODE``, no deeper than ``depth``.

    ``place`` numbers the values of a document as they are written.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def values(records: list[list], _) -> tuple[list[int], list[tuple]]:
            found = [r for r in records if not r[0] and (depth is None or r[5] <= depth)]
            rows = [(r[1], r[2], r[3], r[5], r[6], place, r[8]) for place, r in enumerate(found)]
            return [r[7] for r in found], list(zip(*rows, strict=True))

        shapes = Shapes(values)
        text_, int_, bool_ = pa.string(), pa.int32(), pa.bool_()
        kinds = dict(enumerate([text_, text_, text_, int_, int_, int_, bool_]))
        for batch in (piece for whole in batches for piece in text_pieces(whole)):
            owners, taken = [], _Taken(len(kinds))
            for i, one in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if one is not None:
                    tokens, found = shapes.of(one)
                    taken.add(tokens, *found)
                    owners.append(i)
            own = pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1])
            kept = own.take(pa.array(np.repeat(np.array(owners, dtype=np.int64), taken.counts))) if owners else own.slice(0, 0)
            made = taken.arrays(kinds)
            columns = [*(made[i] for i in range(6)), pa.array(taken.tokens, text_), made[6]]
            yield pa.RecordBatch.from_arrays([*kept.columns, *columns], names=[*kept.schema.names, *[n for n, _ in _NODE]])

    others = [f for f in df.schema.fields if f.name != text]
    valid = F.when(strict_json(F.col(text)).isNotNull(), F.col(text)).alias(text)
    given = df.select(*[f.name for f in others], valid)
    added = [T.StructField(n, {"string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType()}[k]) for n, k in _NODE]
    return given.mapInArrow(run, T.StructType([*others, *added]))


def framed_scalars(df: DataFrame, text: str, frame) -> DataFrame:
    """Replace each valid document by ``_before`` and ``_scalars``: its scalars' tokens and the text that goes before each.

    ``frame(record, container)`` gives the text before and after a record's scalar. The last of ``_before`` is what follows the last scalar. Scalars that
    ``plain_scalar`` can spell are part of the texts. Both are null for invalid documents.
    """

    def run(batches):
        import pyarrow as pa

        def framed(records: list[list], tokens: list[str]) -> list[tuple[str, int | None]]:
            made, held = [], ""
            for r in records:
                scalar = tokens[r[7]] not in ("{", "[", "}", "]")
                before, after = frame(r, not scalar)
                held += before
                if scalar:
                    made.append((held, r[7]))
                    held = ""
                held += after
            return [*made, (held, None)]

        shapes = Shapes(framed)
        for batch in (piece for whole in batches for piece in text_pieces(whole)):
            befores, scalars = [], []
            for one in batch.column(batch.num_columns - 1).to_pylist():
                if one is None:
                    befores.append(None)
                    scalars.append(None)
                    continue
                tokens, pieces_ = shapes.of(one)
                before, odd, held = [], [], []
                for literal, place in pieces_:
                    held.append(literal)
                    if place is not None:
                        said = plain_scalar(tokens[place])
                        if said is None:
                            before.append("".join(held))
                            odd.append(tokens[place])
                            held = []
                        else:
                            held.append(said)
                befores.append([*before, "".join(held)])
                scalars.append(odd)
            made = [pa.array(c, pa.list_(pa.string())) for c in (befores, scalars)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "_before", "_scalars"])

    others = [f for f in df.schema.fields if f.name != text]
    valid = F.when(strict_json(F.col(text)).isNotNull(), F.col(text)).alias(text)
    texts = T.ArrayType(T.StringType())
    schema = T.StructType([*others, T.StructField("_before", texts), T.StructField("_scalars", texts)])
    return df.select(*[f.name for f in others], valid).mapInArrow(run, schema)


# Scalars that say what they are written as: numbers no engine writes otherwise, texts without escapes or marks of XML.
PLAIN = re.compile(r'-?[1-9][0-9]{0,14}|0|-?(?:0|[1-9][0-9]{0,8})\.[0-9]{0,5}[1-9]|true|false|"[^"\\<>&\']*"')


def plain_scalar(token: str) -> str | None:
    """The text of a scalar that needs no conversion, empty for ``null``; None for all others."""
    if token == "null":
        return ""
    if PLAIN.fullmatch(token) is None:
        return None
    return token[1:-1] if token[0] == '"' else token


def with_records(df: DataFrame, text: str, name: str, keep=None) -> DataFrame:
    """Add the records of each document as an array of ``RECORD``, those for which ``keep(record)`` is true; null for invalid texts."""

    def run(batches):
        import pyarrow as pa

        shapes = Shapes(lambda records, _: _columns_of(records, 9))
        for batch in batches:
            for piece in text_pieces(batch):
                made = _walked_piece(piece.column(piece.num_columns - 1), shapes, keep)
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], made], names=[*piece.schema.names[:-1], name])

    given = df.withColumn("_valid", F.when(strict_json(F.col(text)).isNotNull(), F.col(text)))
    record = T.StructField(name, T._parse_datatype_string(f"array<{RECORD}>"))
    return given.mapInArrow(run, T.StructType([*df.schema.fields, record]))


def walk(text: Column) -> Column:
    """The records of a document as an array of ``RECORD``; null for invalid texts.

    Validity is decided by the parser, whatever the pass makes of an invalid text. It
    cannot stand inside the function of a transform or filter.
    """
    return F.when(strict_json(text).isNotNull(), F.arrow_udf(_walked, f"array<{RECORD}>")(text))


def token_kind(token: Column) -> Column:
    """Node kind of a value's token."""
    first = F.substring(token, 1, 1)
    return (
        F.when(first == "{", "object")
        .when(first == "[", "array")
        .when(first == '"', "string")
        .when(first.isin("t", "f"), "boolean")
        .when(first == "n", "null")
        .otherwise("number")
    )
