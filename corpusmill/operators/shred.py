"""Shredding of nested JSON text into an adjacency table, and entity tables from it.

Every value of a JSON text becomes a node: its number in reading order, its parent, the label under
which it hangs, its ordinal among its siblings and, for scalars, its text.  Elements of an array
carry the array's label.  JSON that is stored as text inside JSON is opened in place, however often
it was encoded.  Entity tables come from joining object nodes with their scalar children and
pivoting the children's labels into columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE_SCHEMA = "key string, stamp long, delivery long, field string, node int, parent int, label string, ordinal int, kind string, scalar string"
_ARROW = pa.schema([("key", pa.string()), ("stamp", pa.int64()), ("delivery", pa.int64()), ("field", pa.string()), ("node", pa.int32()), ("parent", pa.int32()), ("label", pa.string()), ("ordinal", pa.int32()), ("kind", pa.string()), ("scalar", pa.string())])
_ROWS_AT_ONCE = 20_000
_blank = re.compile(r"[ \t\n\r]*").match
_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity").match


class _Pairs(list):
    """Members of a JSON object in reading order, repeated keys included."""


def _load(text: str):
    try:
        return json.loads(text, object_pairs_hook=_Pairs)
    except RecursionError:
        return _load_deep(text)


def _load_deep(text: str):
    """The value of a JSON text nested too deeply for the parser, read with a stack of our own."""
    root: list = []
    open_: list[tuple[list, str | None]] = []
    at = _blank(text, 0).end()

    def expect(mark: str) -> None:
        nonlocal at
        if text[at : at + 1] != mark:
            raise ValueError(f"{mark} expected at {at}")
        at = _blank(text, at + 1).end()

    def key() -> str:
        nonlocal at
        if text[at : at + 1] != '"':
            raise ValueError(f"key expected at {at}")
        name, at = json.decoder.scanstring(text, at + 1)
        at = _blank(text, at).end()
        expect(":")
        return name

    def put(value) -> None:
        box, name = open_[-1] if open_ else (root, None)
        box.append((name, value) if isinstance(box, _Pairs) else value)

    while True:
        mark = text[at : at + 1]
        if mark in ("{", "["):
            box = _Pairs() if mark == "{" else []
            put(box)
            expect(mark)
            open_.append((box, None))
            if text[at : at + 1] != ("}" if mark == "{" else "]"):
                if mark == "{":
                    open_[-1] = (box, key())
                continue
        elif mark == '"':
            value, at = json.decoder.scanstring(text, at + 1)
            put(value)
        else:
            scalar = _SCALAR(text, at)
            if not scalar:
                raise ValueError(f"value expected at {at}")
            put(json.loads(scalar.group()))
            at = scalar.end()
        while True:  # behind a value
            at = _blank(text, at).end()
            if not open_:
                if at < len(text):
                    raise ValueError(f"more than one value, at {at}")
                return root[0]
            box = open_[-1][0]
            if box and text[at : at + 1] == ",":
                expect(",")
                if isinstance(box, _Pairs):
                    open_[-1] = (box, key())
                break
            expect("}" if isinstance(box, _Pairs) else "]")
            open_.pop()


def _open(value):
    """The object or array inside a string, else the value itself."""
    inner = value
    while isinstance(inner, str):
        head = inner.lstrip()[:1]
        if head not in ("{", "[", '"'):
            return value
        try:
            inner = _load(inner)
        except ValueError:
            return value
    return inner if isinstance(inner, list) else value


def shred_text(text: str | None) -> list[tuple]:
    """Nodes ``(node, parent, label, ordinal, kind, scalar)`` of a JSON text in reading order.

    None, blank and incomplete texts have no nodes; no depth of nesting is too deep.
    """
    if text is None:
        return []
    try:
        root = _load(text)
    except ValueError:
        return []
    out: list[tuple] = []
    stack = [(root, -1, None, 0)]
    while stack:
        value, parent, label, ordinal = stack.pop()
        value = _open(value)
        node = len(out)
        if isinstance(value, _Pairs):
            out.append((node, parent, label, ordinal, "object", None))
            stack.extend((v, node, k, i) for i, (k, v) in reversed(list(enumerate(value))))
        elif isinstance(value, list):
            out.append((node, parent, label, ordinal, "array", None))
            stack.extend((v, node, label, i) for i, v in reversed(list(enumerate(value))))
        elif value is None:
            out.append((node, parent, label, ordinal, "null", None))
        elif isinstance(value, bool):
            out.append((node, parent, label, ordinal, "boolean", "true" if value else "false"))
        elif isinstance(value, str):
            out.append((node, parent, label, ordinal, "string", value.encode("utf-8", "replace").decode()))
        else:
            out.append((node, parent, label, ordinal, "number", repr(value)))
    return out


def _run(fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            keys, stamps, deliveries = (batch[c].to_pylist() for c in ("key", "stamp", "delivery"))
            for i, texts in enumerate(zip(*(batch[f"f{k}"].to_pylist() for k in range(len(fields))))):
                head = (keys[i], stamps[i], deliveries[i])
                rows.append((*head, None, -1, -1, None, 0, "delivery", None))
                for field, text in zip(fields, texts):
                    nodes = shred_text(text) or [(-1, -1, None, 0, "reject", "unreadable" if text and text.strip() else "absent")]
                    rows.extend((*head, field, *node) for node in nodes)
                if len(rows) >= _ROWS_AT_ONCE:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)
                    rows = []
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)

    return run


def shred(df: DataFrame, key: str, fields: list[str], stamp: str | None = None) -> DataFrame:
    """The adjacency table of the JSON text columns ``fields``.

    ``stamp`` (a timestamp) tells repeated deliveries of a key apart; ``delivery`` names one
    delivery by content, so exact repeats have the same nodes.  Every row has a node -1 of kind
    ``delivery`` without a field, and one of kind ``reject`` for each field without nodes, whose scalar
    says why: ``absent`` (null or blank) or ``unreadable`` (no complete JSON).  Rows without a key are
    left out.  Other columns are ignored.
    """
    when = F.unix_micros(F.col(stamp).cast("timestamp")) if stamp else F.lit(0)
    source = df.where(F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias("key"),
        F.coalesce(when, F.lit(0)).cast("long").alias("stamp"),
        F.xxhash64(when, *fields).alias("delivery"),
        *[F.col(f).cast("string").alias(f"f{k}") for k, f in enumerate(fields)],
    )
    return source.mapInArrow(_run(fields), NODE_SCHEMA)


def plain(label: Column) -> Column:
    """A label without letter case, blanks and punctuation: chunk_id, chunkId and Chunk-ID agree."""
    return F.lower(F.regexp_replace(label, r"[^\p{L}\p{N}]+", ""))


def entities(nodes: DataFrame, labels: dict[str, list[str]], numbers_of: str | None = None) -> DataFrame:
    """Object nodes joined with their scalar children, the children pivoted into columns.

    labels: for each column the plain labels that feed it; of several non-blank children the first
    in reading order holds.  numbers_of: a field whose objects also list all their numeric children
    in ``numbers`` (numbers stored as text count).  Exact repeats of a delivery fall together.
    """
    at = ["key", "stamp", "delivery", "field"]
    is_object = F.col("kind").isin("object", "delivery")
    tagged = nodes.where("kind in ('delivery', 'object', 'string', 'number', 'boolean')").withColumn("plain", plain(F.col("label")))
    wanted = {x for names in labels.values() for x in names}
    keep = is_object | F.col("plain").isin(sorted(wanted))
    number = F.when(F.col("kind").isin("string", "number"), F.expr(r"case when trim(scalar) rlike '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$' then try_cast(trim(scalar) as double) end"))
    if numbers_of is not None:
        keep = keep | ((F.col("field") == numbers_of) & number.isNotNull())
    filled = ~F.col("kind").isin("object", "delivery", "boolean") & F.expr(r"scalar rlike '(?U)\\S'")
    columns = [F.min_by("scalar", F.when(F.col("plain").isin(names) & filled, F.col("node"))).alias(c) for c, names in labels.items()]
    present = [F.coalesce(F.max(F.when(~is_object, F.col("plain").isin(names))), F.lit(False)).alias(f"has_{c}") for c, names in labels.items()]
    if numbers_of is not None:
        columns.append(F.collect_set(F.when((F.col("field") == numbers_of) & number.isNotNull(), F.struct("label", number.alias("value")))).alias("numbers"))
    own = F.max(F.when(is_object, F.struct("parent", "ordinal", F.col("plain").alias("entity")))).alias("own")
    # the object node and its scalar children meet under the object's number: the join and the pivot
    # are one aggregation, combined in each task before its only shuffle
    joined = tagged.where(keep).withColumn("object", F.when(is_object, F.col("node")).otherwise(F.col("parent"))).groupBy(*at, "object").agg(own, *columns, *present)
    return joined.where("own is not null").select(*at, F.col("object").alias("node"), "own.*", *labels, *(["numbers"] if numbers_of is not None else []), *[f"has_{c}" for c in labels])


def latest_delivery(rows: DataFrame) -> DataFrame:
    """Of each key only the rows of its last delivery (ties: the smaller delivery name).

    Nodes -1 speak for the deliveries that have nothing else and are dropped in the end.
    """
    last = Window.partitionBy("key").orderBy(F.desc("stamp"), "delivery")
    return rows.withColumn("_turn", F.dense_rank().over(last)).where("_turn = 1 and (node >= 0 or field is not null)").drop("_turn")
