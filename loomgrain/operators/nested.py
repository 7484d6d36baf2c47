"""Deeply nested JSON records as flat tables with parent-child links (problem 5).

Each record is parsed as a stream with an explicit stack, so depth is no limit. Values come
out as path-value-ordinal triples; triples are grouped by their repeated ancestor, which is the deepest
list on their path, and each group is pivoted into one table: a column for each field of the shape and a map
of all others. Lists that have no table of their own come out item by item in one further table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from json.decoder import scanstring
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrain.cluster import spread

_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"
_SCALAR = re.compile(rf"({_NUMBER}|true|false|null)(?![\w.+-])")
#: A member of an object whose name and value need no unescaping, up to the comma or brace behind it.
_MEMBER = re.compile(rf'[ \t\n\r]*"([^"\\\x00-\x1f]*)"[ \t\n\r]*:[ \t\n\r]*(?:"([^"\\\x00-\x1f]*)"|({_NUMBER}|true|false|null))[ \t\n\r]*([,}}])')
_SURROGATE = re.compile("[\ud800-\udfff]")
#: What may stand around a text without being part of it: white space and a byte order mark.
_AROUND = "﻿ \t\n\r"
#: Levels up to which an object's own path is kept; the paths of deeper values are put together when asked for.
_KEPT_LEVELS = 32


class NotJson(ValueError):
    """The text is not one complete JSON value."""


@lru_cache(maxsize=4096)
def plain_name(name: str) -> str:
    """A name as all its spellings have it in common: stalenessTier and staleness_tier give stalenesstier.

    A name's own [] is written [\\], so that it is no list's; a lone surrogate is written as U+FFFD.
    """
    return _text(name.replace("_", "").lower().replace("[]", "[\\]"))


def _text(value: str) -> str:
    return _SURROGATE.sub("�", value)


class Triple(NamedTuple):
    """path: plain names joined by dots, [] after each list; ordinals: the position in each of these lists."""

    path: str
    value: str | None
    ordinals: tuple[int, ...]
    kind: str  # object, list, string, number, boolean, null


def _string(text: str, at: int) -> tuple[str, int]:
    try:
        return scanstring(text, at, True)
    except ValueError as e:
        raise NotJson(str(e)) from None


def events(text: str) -> Iterator[tuple[str, str | None, int, int]]:
    """(event, value, begin, end) in the order of the text.

    event is "{", "[", "}", "]", "key", or a scalar's kind: string, number, boolean or null; begin and end are
    its places in text. Raises NotJson where text isn't one complete value; events may have been given before.
    """
    skip, at, n = _SPACE.match, 0, len(text)
    at = skip(text, at).end()
    stack: list[str] = []
    state = "value"  # value, first (in an object or list that has just begun), key, after
    while True:
        c = text[at : at + 1]
        if state == "value" or (state == "first" and stack[-1] == "[" and c != "]"):
            if c == "{" or c == "[":
                yield c, None, at, at + 1
                stack.append(c)
                at = skip(text, at + 1).end()
                state = "first"
                continue
            begin = at
            if c == '"':
                value, at = _string(text, at + 1)
                yield "string", value, begin, at
            else:
                m = _SCALAR.match(text, at)
                if not m:
                    raise NotJson(f"no value at {at}")
                at = m.end()
                yield ("null", None, begin, at) if c == "n" else ("boolean" if c in "tf" else "number", m[0], begin, at)
            state = "after"
        elif state in ("first", "key") and stack[-1] == "{" and c == '"':
            begin = at
            name, at = _string(text, at + 1)
            yield "key", name, begin, at
            at = skip(text, at).end()
            if text[at : at + 1] != ":":
                raise NotJson(f"no colon at {at}")
            at = skip(text, at + 1).end()
            state = "value"
            continue
        elif state in ("first", "after") and stack and c == ("}" if stack[-1] == "{" else "]"):
            stack.pop()
            yield c, None, at, at + 1
            at += 1
            state = "after"
        elif state == "after" and stack and c == ",":
            at = skip(text, at + 1).end()
            state = "key" if stack[-1] == "{" else "value"
            continue
        else:
            raise NotJson(f"unexpected {c!r} at {at}")
        at = skip(text, at).end()
        if not stack:
            if at < n:
                raise NotJson(f"more text at {at}")
            return


class _Level:
    """An object or list that is open: its path, and that of its items if it is a list."""

    __slots__ = ("above", "name", "own", "ordinals", "count", "is_list", "depth")

    def __init__(self, above: _Level | None, name: str, own: str | None, ordinals: tuple[int, ...], is_list: bool) -> None:
        self.above, self.name, self.own, self.ordinals, self.is_list, self.count = above, name, own, ordinals, is_list, -1
        self.depth = 0 if above is None else above.depth + 1

    def path(self) -> str:
        if self.own is not None:
            return self.own
        names, level = [], self
        while level is not None and level.own is None:
            names.append(level.name)
            level = level.above
        return (level.own if level is not None else "") + "".join(reversed(names))


def triples(text: str, lists: frozenset[str] = frozenset(), only: frozenset[str] | None = None) -> Iterator[Triple]:
    """The path-value-ordinal triples of a record, all or those of the paths in `only`.

    Each object, each list and each scalar gives one, at any depth. At a path in `lists` a lone object stands for a
    list with it as its item at 0. Raises NotJson at the place where text isn't JSON.
    """
    deepest = _KEPT_LEVELS if only is None else max((p.count(".") + p.count("[]") for p in only), default=0) + 1
    skip, member, at, n = _SPACE.match, _MEMBER.match, 0, len(text)
    at = skip(text, at).end()
    level: _Level | None = None
    name, state = "", "value"
    while True:
        if level is not None and not level.is_list and state in ("first", "key"):
            # members of plain scalars, one match each
            base = level.own
            while m := member(text, at):
                at = m.end()
                if only is None or (base is not None and level.depth <= deepest):
                    key, word = plain_name(m[1]), m[3]
                    path = (f"{base}.{key}" if base else key) if base is not None else f"{level.path()}.{key}"
                    if only is None or path in only:
                        if word is None:
                            yield Triple(path, _text(m[2]), level.ordinals, "string")
                        elif word == "null":
                            yield Triple(path, None, level.ordinals, "null")
                        else:
                            yield Triple(path, word, level.ordinals, "boolean" if word[0] in "tf" else "number")
                state = "key"
                if m[4] == "}":
                    level = level.above
                    state = "after"
                    break
            at = skip(text, at).end()
            if state == "after":
                if level is None:
                    if at < n:
                        raise NotJson(f"more text at {at}")
                    return
                continue
        c = text[at : at + 1]
        if state == "value" or (state == "first" and level.is_list and c != "]"):
            if level is None:
                name, ordinals = "", ()
            elif level.is_list:
                level.count += 1
                name, ordinals = "", (*level.ordinals, level.count)
            else:
                ordinals = level.ordinals
            asked = only is None or level is None or level.depth < deepest
            path = None
            if asked and (level is None or level.own is not None or c not in "{["):
                base = "" if level is None else level.path()
                path = base + name if base else name[1:]
            if c == "{" or c == "[":
                if path is not None and c == "{" and path in lists:
                    path, ordinals, name = path + "[]", (*ordinals, 0), name + "[]"
                if asked and (only is None or path in only):
                    yield Triple(path if path is not None else level.path() + name, None, ordinals, "object" if c == "{" else "list")
                if c == "[":
                    name += "[]"
                    path = None if path is None else path + "[]"
                kept = path if level is None or level.depth < _KEPT_LEVELS else None
                level = _Level(level, name, kept, ordinals, c == "[")
                at = skip(text, at + 1).end()
                state = "first"
                continue
            if c == '"':
                value, at = _string(text, at + 1)
                kind, value = "string", _text(value)
            else:
                m = _SCALAR.match(text, at)
                if not m:
                    raise NotJson(f"no value at {at}")
                at = m.end()
                kind, value = ("null", None) if c == "n" else ("boolean" if c in "tf" else "number", m[0])
            if asked and (only is None or path in only):
                yield Triple(path, value, ordinals, kind)
            state = "after"
        elif state in ("first", "key") and not level.is_list and c == '"':
            key, at = _string(text, at + 1)
            name = "." + plain_name(key)
            at = skip(text, at).end()
            if text[at : at + 1] != ":":
                raise NotJson(f"no colon at {at}")
            at = skip(text, at + 1).end()
            state = "value"
            continue
        elif state in ("first", "after") and level is not None and c == ("]" if level.is_list else "}"):
            level = level.above
            at += 1
            state = "after"
        elif state == "after" and level is not None and c == ",":
            at = skip(text, at + 1).end()
            state = "value" if level.is_list else "key"
            continue
        else:
            raise NotJson(f"unexpected {c!r} at {at}")
        at = skip(text, at).end()
        if level is None:
            if at < n:
                raise NotJson(f"more text at {at}")
            return


@dataclass(frozen=True)
class Shape:
    """What a record's root looks like, and which of its lists become tables.

    tables: table name → path of its list, such as changes[].symbols[]. fields: paths under each item that become columns; others go to a map.
    names: further names that a root has; an object with `enough` of them is a root even without a list of the tables.
    """

    tables: dict[str, str]
    fields: dict[str, tuple[str, ...]]
    names: frozenset[str]
    enough: int = 4

    @property
    def lists(self) -> frozenset[str]:
        return frozenset(p[: i] for p in self.tables.values() for i in range(len(p)) if p.startswith("[]", i))

    @property
    def tops(self) -> frozenset[str]:
        """The names of the lists that a root itself holds."""
        return frozenset(p[:-2] for p in self.tables.values() if p.count("[]") == 1)

    def covers(self, path: str) -> bool:
        """Whether the path is that of a table's item or lies below one."""
        return any(path == p or path.startswith((p + ".", p + "[")) for p in self.tables.values())


def owner(path: str) -> str:
    """The repeated ancestor: the path up to its deepest list."""
    return path[: path.rfind("[]") + 2] if "[]" in path else ""


#: The impact packet.
PACKET = Shape(
    {"change": "changes[]", "symbol": "changes[].symbols[]", "decision": "relevantdecisions[]", "route": "changes[].apiroutes[]"},
    {
        "change": ("path", "status", "oldpath", "isstaged", "analysisstatus.symbols", "analysisstatus.imports", "analysisstatus.runtimeusage"),
        "symbol": ("name", "kind", "ispublic", "qualifiedname", "cognitivecomplexity", "cyclomaticcomplexity", "linestart", "lineend", "bytestart", "byteend", "entrypointkind"),
        "decision": ("filepath", "heading", "excerpt", "similarity", "rerankscore", "stalenesstier", "stalenessdays"),
        "route": ("method", "path", "pathpattern", "handlersymbolname", "framework", "routesource", "mountprefix", "isdynamic", "routeconfidence", "evidence", "owningservice"),
    },
    frozenset(("schemaversion", "timestamputc", "headhash", "branchname", "treeclean", "risklevel", "riskreasons", "temporalcouplings", "hotspots", "knowledgegraph", "sdkdependenciesdelta")),
)


class _Parsed:
    """A JSON text as its events, with the place of each opening's closing."""

    def __init__(self, text: str) -> None:
        self.text, self.events, self.close = text, list(events(text)), {}
        opened = []
        for i, e in enumerate(self.events):
            if e[0] in "{[":
                opened.append(i)
            elif e[0] in "}]":
                self.close[opened.pop()] = i

    def children(self, i: int) -> Iterator[tuple[str | None, int]]:
        """(plain name, place) of each member or item of the object or list at i."""
        at, end, name = i + 1, self.close[i], None
        while at < end:
            event, value, _, _ = self.events[at]
            if event == "key":
                name = plain_name(value)
                at += 1
                continue
            yield name, at
            at = self.close.get(at, at) + 1

    def span(self, i: int) -> str:
        return self.text[self.events[i][2] : self.events[self.close[i]][3]]


def _may_be_json(value: str) -> bool:
    return value.lstrip(_AROUND)[:1] in ("{", "[", '"')


def find_root(text: str, shape: Shape) -> str | None:
    """The text of the root, wherever it lies in objects, lists and JSON text in strings; None if there is none.

    The layers are searched from the outside, each in the order of the text. A root is an object with a list of
    the shape's tables that holds objects (or a lone object in its place), or with enough of the shape's names. Only if there is none, an
    object counts that has such a list of anything else but null. Raises NotJson if text itself isn't JSON.
    """
    layer = [(_Parsed(text.strip(_AROUND)), 0)]
    weak = None
    while layer:
        below = []
        for parsed, i in layer:
            event, value, _, _ = parsed.events[i]
            if event == "string":
                if _may_be_json(value):
                    try:
                        below.append((_Parsed(value.strip(_AROUND)), 0))
                    except NotJson:
                        pass
                continue
            if event not in "{[":
                continue
            inside = list(parsed.children(i))
            if event == "{":
                for name, k in inside:
                    kind = parsed.events[k][0]
                    if name in shape.tops and kind != "null":
                        if kind == "{" or (kind == "[" and any(parsed.events[x][0] == "{" for _, x in parsed.children(k))):
                            return parsed.span(i)
                        weak = weak or (parsed, i)
                if len({name for name, _ in inside} & shape.names) >= shape.enough:
                    return parsed.span(i)
            below.extend((parsed, k) for _, k in inside if parsed.events[k][0] in "{[" or parsed.events[k][0] == "string")
        layer = below
    return weak[0].span(weak[1]) if weak else None


def record_triples(text: str | None, shape: Shape, only: frozenset[str] | None = None, owners: frozenset[str] | None = None) -> list[Triple]:
    """Triples at and below the items of the shape's tables; none if the record can't be read.

    All of them, or those of the paths in `only`, or those whose repeated ancestor is in `owners`.
    """
    if not text:
        return []
    try:
        text = text.strip(_AROUND)
        asked = None if only is None else only | {top + "[]" for top in shape.tops} | shape.names
        found = list(triples(text, shape.lists, asked))
        # most texts are roots themselves, which shows in their triples; all others are searched
        items = {top + "[]" for top in shape.tops}
        if not any(t.kind == "object" and t.path in items for t in found) and len({t.path for t in found} & shape.names) < shape.enough:
            root = find_root(text, shape)
            if root is None:
                return []
            found = triples(root, shape.lists, only)
        kept: dict[str, bool] = {}
        out = []
        for t in found:
            own = t.path
            if own not in kept:
                kept[own] = shape.covers(own) and (owners is None or owner(own) in owners) and (only is None or own in only)
            if kept[own] and (own.endswith("[]") or t.kind not in ("object", "list")):
                out.append(t)
        return out
    except NotJson:
        return []


def shred(df: DataFrame, id_column: str, text_column: str, shape: Shape = PACKET, only: frozenset[str] | None = None, owners: frozenset[str] | None = None) -> DataFrame:
    """__id, path, value, ordinals, kind: the triples of all records, in one pass; only and owners as in record_triples."""
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in batches:
            who, columns = [], ([], [], [], [])
            for i, text in enumerate(batch.column(1).to_pylist()):
                for t in record_triples(text, shape, only, owners):
                    who.append(i)
                    for c, v in zip(columns, (t.path, t.value, t.ordinals, t.kind)):
                        c.append(v)
            ids = batch.column(0).take(pa.array(who, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.list_(pa.int64())), pa.array(columns[3], pa.string())], names=["__id", "path", "value", "ordinals", "kind"])

    return spread(df.select(F.col(id_column), F.col(text_column).cast("string"))).mapInArrow(run, f"__id {kind}, path string, value string, ordinals array<bigint>, kind string")


def _owner() -> Column:
    """owner() of the column path."""
    return F.regexp_extract("path", r"(?s)^(.*\[\])", 1)


def _map(entries: Column) -> Column:
    """A map of name-value structs, some null; of values with the same name the greatest."""
    of = F.array_sort(F.collect_set(entries))
    last = F.filter(of, lambda x, i: F.coalesce(F.get(of, i + 1)["name"] != x["name"], F.lit(True)))
    return F.map_from_entries(last)


def flat_table(found: DataFrame, table: str, shape: Shape = PACKET) -> DataFrame:
    """One table of the shape: __id, parent_pos (-1 at the top), pos, a column for each field, and more.

    A field's dots are _ in its column. more holds all other fields under their paths below the item, and
    under the empty path the item itself where it is no object. Triples are grouped by record and by the
    ordinals of their repeated ancestor and pivoted. Redelivered records fall together. A null item of a
    list is no record. An item that is no object has null fields.
    """
    path = shape.tables[table]
    depth = path.count("[]")
    if depth > 2:
        raise ValueError("parent_pos names one parent: a table lies in one list or in a list of one")
    own = found.filter(_owner() == path).withColumnsRenamed({"path": "__path", "value": "__value", "kind": "__kind"})
    ordinal = lambda k: F.get("ordinals", F.lit(k))
    parent = ordinal(depth - 2) if depth > 1 else F.lit(-1).cast("bigint")
    cells = [F.max(F.when(F.col("__path") == f"{path}.{f}", F.col("__value"))).alias(f.replace(".", "_")) for f in shape.fields[table]]
    other = ~F.col("__path").isin([f"{path}.{f}" for f in shape.fields[table]]) & ((F.col("__path") != path) | ~F.col("__kind").isin("object", "list", "null"))
    more = _map(F.when(other, F.struct(F.substring("__path", len(path) + 2, 1 << 30).alias("name"), F.col("__value").alias("value"))))
    present = F.max((F.col("__path") == path) & (F.col("__kind") != "null"))
    return own.groupBy("__id", parent.alias("parent_pos"), ordinal(depth - 1).alias("pos")).agg(present.alias("__present"), *cells, more.alias("more")).filter("__present").drop("__present")


def list_items(found: DataFrame, shape: Shape = PACKET) -> DataFrame:
    """The items of all lists below the tables' items that are no tables themselves: __id, list_path, ancestors, pos, kind, value, fields.

    ancestors holds the positions of the items around it, outermost first; value is that of an item that is no object, fields
    holds the others' fields under their paths below the item. Null items come out too, with kind null.
    """
    own = found.withColumn("list_path", _owner()).filter(~F.col("list_path").isin(list(shape.tables.values())))
    itself = F.col("path") == F.col("list_path")
    fields = _map(F.when(~itself, F.struct(F.expr("substring(path, length(list_path) + 2)").alias("name"), "value")))
    item = F.max(F.when(itself, F.struct("kind", "value")))
    grouped = own.groupBy("__id", "list_path", "ordinals").agg(item.alias("item"), fields.alias("fields"))
    size = F.size("ordinals")
    return grouped.select("__id", "list_path", F.slice("ordinals", F.lit(1), size - 1).alias("ancestors"), F.get("ordinals", size - 1).alias("pos"), "item.kind", "item.value", "fields")


def packet_records(snapshots: DataFrame) -> DataFrame:
    """snapshot_id, record_kind, parent_pos, pos, item_key of all records of the packets."""
    # all tables at once: one grouping over the few fields that are asked for
    paths = {f"{p}.{f}": (kind, p, p.count("[]")) for kind, f in (("change", "path"), ("symbol", "name"), ("decision", "stalenesstier")) for p in [PACKET.tables[kind]]}
    items = [PACKET.tables[kind] for kind in ("change", "symbol", "decision")]
    found = shred(snapshots.filter("id is not null and packet_json is not null"), "id", "packet_json", only=frozenset((*paths, *items)))
    parent = F.when(F.size("ordinals") > 1, F.get("ordinals", F.size("ordinals") - 2)).otherwise(F.lit(-1).cast("bigint"))
    kind = F.coalesce(*(F.when(F.col("path").isin(p, key), k) for key, (k, p, _) in paths.items()))
    value = F.when(F.col("path").isin(list(paths)), F.col("value"))
    grouped = found.select("*", kind.alias("record_kind"), value.alias("key")).groupBy("__id", "record_kind", parent.alias("parent_pos"), F.get("ordinals", F.size("ordinals") - 1).alias("pos")).agg(
        F.max("key").alias("item_key"),
        F.max(F.col("path").isin(items) & (F.col("kind") != "null")).alias("present"),
    )
    key = F.when(F.col("record_kind") == "decision", F.lower("item_key")).otherwise(F.col("item_key"))
    return grouped.filter("present and (record_kind <> 'decision' or item_key is not null)").select(F.col("__id").cast("bigint").alias("snapshot_id"), "record_kind", "parent_pos", "pos", key.alias("item_key"))
