"""Access to flattened execution payloads.

A payload is one JSON array. Element 0 is the root; inside objects and arrays a
*string* is the index of another element, while numbers and booleans stand for
themselves. Each payload is parsed once, in Arrow batches where it is read: a small
helper follows the wanted paths from element to element and returns what they lead
to, and subtrees that are wanted whole. Which of it counts is decided by column
expressions. Payload texts go no further than that one step.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.errors import resolve
from runlens.schemas import ERROR

# Characters of a subtree's text that a cell can hold. Sharing makes longer ones out of small payloads;
# they cannot be written as a tree, like a cycle.
TEXT_LIMIT = 1 << 28

UNKNOWN_NODE = "Unknown Node"
UNKNOWN_TYPE = "Unknown Type"
NO_DETAIL = "Unknown error detail"

# --- the wanted paths ---------------------------------------------------------
# Member names are those of the payload format.

_ERROR = [("description",), ("message",), ("name",), ("stack",), ("node", "id"), ("node", "name"), ("node", "type"),
          ("httpCode",), ("statusCode",), ("status",), ("context", "httpCode"), ("cause", "httpCode"),
          ("cause", "statusCode"), ("cause", "status"), ("response", "status"), ("response", "statusCode")]
_FRAME = ("executionData", "nodeExecutionStack", -1)
_SOURCE = (*_FRAME, "source", "main", 0)
_BODY = [("resultData",), ("resultData", "lastNodeExecuted"), ("executionData", "runtimeData", "source"),
         (*_SOURCE, "previousNode"), (*_SOURCE, "previousNodeOutput"), *[("resultData", "error", *p) for p in _ERROR]]
_WHOLE = {"input": (*_FRAME, "data"), "metadata": ("executionData", "metadata")}
#: The result sits at the root, or in the first member of a list-like root, which may carry the error directly.
LEAVES = [*_BODY, (0,), *[(0, *p) for p in _BODY], (0, "message"), *[(0, "error", *p) for p in _ERROR]]
_AT = {path: i for i, path in enumerate(LEAVES)}


# --- following them -----------------------------------------------------------

def _reference(items: list, value: object) -> object:
    """The element a string member points at; any other member is the value itself."""
    if not isinstance(value, str):
        return value
    at = int(value) if value.isascii() and value.isdigit() and len(value) < 10 else len(items)
    return items[at] if at < len(items) else None


def _member(items: list, container: object, key: str | int) -> object:
    if isinstance(container, dict):
        return _reference(items, container.get(str(key)))
    if isinstance(container, list) and isinstance(key, int) and container:
        return _reference(items, container[key])
    return None


def _tree(paths: list[tuple]) -> dict:
    """Paths as nested mappings, so that a common start is followed once; the place of a path lies under None."""
    tree: dict = {}
    for i, path in enumerate(paths):
        node = tree
        for key in path:
            node = node.setdefault(key, {})
        node[None] = i
    return tree


def _collect(items: list, container: object, tree: dict, out: list) -> None:
    for key, below in tree.items():
        if key is not None and (value := _member(items, container, key)) is not None:
            if None in below:
                out[below[None]] = value
            if len(below) > (None in below):
                _collect(items, value, below, out)


def opened(text: str | None, decoder: json.JSONDecoder) -> list | None:
    """The elements of a payload, or of the payload inside it; None unless the text is a JSON array."""
    def parsed(text: object) -> list | None:
        try:
            items = decoder.decode(text) if isinstance(text, str) else None
        except (ValueError, RecursionError):
            return None
        return items if isinstance(items, list) else None

    items = parsed(text)
    inner = parsed(_member(items, items[0], "data")) if items else None
    return items if inner is None else inner


def _refuse(name: str) -> None:
    raise ValueError(name)


def _inside(value: object, follow) -> list[tuple[str | None, object]]:
    """Names and followed members of a container; a reference that leads nowhere leaves an object."""
    if isinstance(value, dict):
        return [(k, follow(v)) for k, v in value.items() if not (isinstance(v, str) and follow(v) is None)]
    return [(None, follow(v)) for v in value]


def _leaf(value: object) -> str:
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        value = int(value)
    return json.dumps(value, ensure_ascii=False)


def _tree_size(root: object, follow) -> int | None:
    """Characters of the text of ``root``, each container counted once however often it is met; None if it contains itself."""
    size: dict[int, int | None] = {}
    todo: list = [(root, False)]
    while todo:
        value, left = todo.pop()
        if not isinstance(value, (dict, list)) or (not left and size.get(id(value), 0)):
            continue
        inner = _inside(value, follow)
        if left:
            size[id(value)] = 2 + sum((len(k) + 4 if k is not None else 1) + (size[id(v)] if isinstance(v, (dict, list)) else len(_leaf(v)))
                                      for k, v in inner)
            continue
        if id(value) in size:  # entered and not left
            return None
        size[id(value)] = 0
        todo.append((value, True))
        for _, v in inner:
            if isinstance(v, (dict, list)):
                if size.get(id(v)) == 0:
                    return None
                todo.append((v, False))
    return size.get(id(root), 0)


def _written(root: object, follow, indent: int | None) -> str:
    """JSON text of ``root`` with every shared container in full, without recursion.

    '' when it contains itself, or when sharing makes it longer than ``TEXT_LIMIT``.
    """
    size = _tree_size(root, follow)
    if size is None or size > TEXT_LIMIT:
        return ""
    parts: list[str] = []
    todo: list = [(root, 1)]
    while todo:
        step = todo.pop()
        if isinstance(step, str):
            parts.append(step)
            continue
        value, depth = step
        if not isinstance(value, (dict, list)):
            parts.append(_leaf(value))
            continue
        mark, end = ("{", "}") if isinstance(value, dict) else ("[", "]")
        inner = _inside(value, follow)
        line = "\n" + " " * (indent * depth) if indent else ""
        todo.append(("\n" + " " * (indent * (depth - 1)) if indent and inner else "") + end)
        for i in range(len(inner) - 1, -1, -1):
            name, child = inner[i]
            label = "" if name is None else json.dumps(name, ensure_ascii=False) + (": " if indent else ":")
            todo += [(child, depth + 1), ("," if i else mark) + line + label]
        if not inner:
            todo.append(mark)
    return "".join(parts)


def _marked(value: object) -> str:
    """A value with a letter for its kind before it: text, number, boolean, container."""
    if isinstance(value, str):
        return "s" + value
    if isinstance(value, bool):
        return "btrue" if value else "bfalse"
    return ("o" if isinstance(value, (dict, list)) else "n") + _leaf(value)


def _whole(items: list, path: tuple, indent: int | None = None) -> str:
    """JSON text of the subtree at ``path``, '' when absent, without content or not to be written."""
    node: object = items[0] if items else None
    for key in path:
        node = _member(items, node, key)
    if node in (None, "", 0, False):
        return ""
    return _written(node, lambda v: _reference(items, v), indent)


def decode(df: DataFrame, data: str = "data", *, subtrees: bool = False, full: bool = False) -> DataFrame:
    """The rows that can be decoded, without the text but with what it holds: ``n_items``, ``leaves`` (one marked value
    per path of :data:`LEAVES`), and on request the ``subtrees`` of both shapes and the ``full`` trace.

    A payload whose root has a text member ``data`` is a payload inside a
    payload; when that text decodes, it takes the place of the outer one.
    """
    keep = [c for c in df.columns if c != data]
    tree = _tree(LEAVES)
    whole = [*_WHOLE.values(), *[(0, *p) for p in _WHOLE.values()]] if subtrees else []
    strings = pa.list_(pa.string())

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = json.JSONDecoder(parse_constant=_refuse)
        for batch in batches:
            rows, kept = [], []
            for i, text in enumerate(batch.column(data)):
                items = opened(text.as_py(), decoder)
                if items is None:
                    continue
                out: list = [None] * len(LEAVES)
                if items:
                    _collect(items, items[0], tree, out)
                kept.append(i)
                rows.append((len(items), [None if v is None else _valid(_marked(v)) for v in out], [_valid(_whole(items, p)) for p in whole],
                             _valid(_whole(items, (), 2)) if full else None))
            columns = list(zip(*rows)) or [[], [], [], []]
            part = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in keep), pa.array(columns[0], pa.int32()), pa.array(columns[1], strings),
                 pa.array(columns[2], strings), pa.array(columns[3], pa.string())],
                names=[*keep, "n_items", "leaves", "subtrees", "full"])

    shape = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema]
    return df.mapInArrow(follow, ", ".join([*shape, "n_items int", "leaves array<string>", "subtrees array<string>", "full string"]))


def _valid(text: str | None) -> str | None:
    """Half a surrogate pair cannot be stored and becomes a question mark."""
    return text if text is None or text.isascii() else text.encode("utf-8", "replace").decode()


# --- columns ------------------------------------------------------------------

def leaf(*path: str | int) -> str:
    """What a path leads to, as SQL; see :func:`decode`."""
    return f"leaves[{_AT[path]}]"


def _truthy(value: str) -> str:
    """NULL unless the value counts as true: no null, false, 0 or empty text."""
    return (f"case left({value}, 1) when 's' then if(length({value}) > 1, {value}, null) when 'o' then {value} "
            f"when 'b' then if({value} = 'btrue', {value}, null) when 'n' then if(try_cast(substr({value}, 2) as double) = 0, null, {value}) end")


def _text(value: str) -> str:
    """Text of a leaf, NULL when empty or absent."""
    return f"substr({_truthy(value)}, 2)"


def _number(value: str) -> str:
    """A number, or the leading digits of a text."""
    return (f"case left({value}, 1) when 's' then try_cast(regexp_extract({value}, '^s\\\\s*([+-]?[0-9]+)', 1) as double) "
            f"when 'n' then try_cast(substr({value}, 2) as double) end")


def _first(*values: str) -> str:
    return f"coalesce({', '.join(values)})"


def http_status(*error: str | int) -> str:
    """HTTP status of an error: the first candidate that is a whole number in 100..599. Text counts by its leading digits."""
    def at(*path: str) -> str:
        return leaf(*error, *path)

    def truthy(part: str, *keys: str) -> str:
        return _first(*[_truthy(at(part, k)) for k in keys])

    places = [at("httpCode"), at("statusCode"), at("status"), at("context", "httpCode"),
              truthy("cause", "httpCode", "statusCode", "status"), truthy("response", "status", "statusCode")]
    codes = [f"get(filter(array({_number(p)}), v -> v = floor(v) and v between 100 and 599), 0)" for p in places]
    return f"cast({_first(*codes)} as bigint)"


_PLAIN = f"({_truthy(leaf('resultData'))}) is not null"
_ROOT = ("resultData", "error")
_LISTED, _DIRECT = (0, *_ROOT), (0, "error")


def _pick(plain: str, *listed: str) -> str:
    """Values of the shape at hand; a list-like root counts only when it has a first member."""
    return f"if({_PLAIN}, {plain}, if(({_truthy(leaf(0))}) is not null, {_first(*listed)}, null))"


def _either(*path: str) -> str:
    return _pick(_text(leaf(*_ROOT, *path)), _text(leaf(*_LISTED, *path)), _text(leaf(*_DIRECT, *path)))


def _body(*path: str | int) -> str:
    return _pick(_text(leaf(*path)), _text(leaf(0, *path)))


def _message(*fallbacks: str) -> str:
    def texts(*error: str | int) -> list[str]:
        return [_text(leaf(*error, key)) for key in ("description", "message")]

    return _first(_pick(_first(*texts(*_ROOT)), *texts(*_LISTED), *texts(*_DIRECT)), *fallbacks)


def _node_name() -> str:
    return _first(_body("resultData", "lastNodeExecuted"), _either("node", "name"), f"'{UNKNOWN_NODE}'")


def extract(df: DataFrame, data: str = "data", *, with_subtrees: bool = True) -> DataFrame:
    """Error fields of decoded payloads, unresolved; undecodable rows are dropped.

    Input needs ``execution_id``, ``workflow_id``, ``started_at`` and the payload
    text. Output has the columns of the error table except the category.
    """
    def dump(i: int) -> Column:
        return F.expr(_pick(f"subtrees[{i}]", f"subtrees[{i + len(_WHOLE)}]", "''")) if with_subtrees else F.lit("")

    # The upstream node is read from the plain shape only.
    return decode(df, data, subtrees=with_subtrees).select(
        F.col("execution_id").alias("id"),
        "workflow_id",
        F.expr(_first(_either("node", "id"), "''")).alias("node_id"),
        F.expr(_node_name()).alias("node_name"),
        F.expr(_first(_either("node", "type"), f"'{UNKNOWN_TYPE}'")).alias("node_type"),
        F.expr(_first(_either("name"), "''")).alias("error_type"),
        F.expr(_message("''")).alias("error_message"),
        F.expr(_first(_either("stack"), "''")).alias("error_stack"),
        F.expr(f"if({_PLAIN}, {_first(_text(leaf(*_SOURCE, 'previousNode')), chr(39) * 2)}, '')").alias("source_node"),
        F.expr(f"if({_PLAIN}, try_cast(substr({leaf(*_SOURCE, 'previousNodeOutput')}, 2) as bigint), null)").alias("source_output_index"),
        F.coalesce(dump(0), F.lit("")).alias("input_data"),
        F.coalesce(dump(1), F.lit("")).alias("metadata"),
        F.expr(_first(_body("executionData", "runtimeData", "source"), "''")).alias("execution_source"),
        F.expr(_pick(http_status(*_ROOT), http_status(*_LISTED), http_status(*_DIRECT))).alias("http_code"),
        F.col("started_at").alias("timestamp"),
    )


def extract_errors(df: DataFrame, as_of: Column, data: str = "data", *,
                   with_subtrees: bool = True) -> DataFrame:
    """Extraction, resolution and classification: rows of the error table."""
    rows = resolve(extract(df, data, with_subtrees=with_subtrees))
    rows = rows.withColumn("timestamp", F.coalesce("timestamp", as_of))
    return rows.select(*ERROR.fieldNames())


def trace_lookup(df: DataFrame, data: str = "data", *, full: bool = False) -> DataFrame:
    """On-demand view of payloads: node and message, and the whole trace on request.

    Unlike the extraction above, the list-like shape falls back to the root's own
    ``message``. Undecodable payloads give no row.
    """
    own_message = _pick("null", _text(leaf(0, "message")))
    columns = [F.col("execution_id"), F.col("workflow_id"), F.expr(_node_name()).alias("node_name"),
               F.expr(_message(own_message, f"'{NO_DETAIL}'")).alias("message")]
    if full:
        columns.append(F.col("full").alias("full_error"))
    return decode(df, data, full=full).select(*columns)


def capped(payloads: DataFrame, cap: int | None = None, data: str = "data") -> DataFrame:
    """Payload text, if asked only up to ``cap`` bytes; the true size is always kept."""
    size = F.octet_length(data)
    text = F.col(data) if cap is None else F.when(size <= cap, F.col(data))
    return payloads.withColumns({data: text, "data_bytes": size.cast("bigint")})
