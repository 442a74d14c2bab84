"""Model answers, read as JSON text row by row in Arrow batches: whatever can be read is kept, and no answer ends a job.

Of equal keys the last one counts; ``NaN`` and ``Infinity`` are numbers; nesting and digits have no limit; half of a
surrogate pair becomes ``?``.  Variants do none of this, and they sort keys and shorten numbers.
"""

from __future__ import annotations

import itertools
import json
import re
import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

# The functions below travel to the executors with the job, so no install is needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_dumps = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode
_TIMESTAMP = re.compile(r"\d{4}-\d{2}-\d{2}T", re.ASCII)
_HALF_PAIR = re.compile(r"\\u[dD][89a-fA-F]")
_MOST_DIGITS = 4000
_TOKEN = re.compile(
    r'[ \t\n\r]*+(?:(?P<mark>[{}\[\],:])|(?P<string>"(?:[^"\\\x00-\x1f]++|\\.)*+")'
    r'|(?P<number>-?(?:0|[1-9][0-9]*+)(?P<broken>(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+))|(?P<word>true|false|null|NaN|-?Infinity))')
_WORDS = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}

PARTS = ("data", "confidences", "excerpts")
_MAP = "map<string,string>"
_LEAVES = "array<struct<path:string,value_json:string,raw_confidence:string,raw_excerpt:string>>"
_SIDE_KEYS = frozenset(("model", "_confidence", "_excerpts"))


class Written(str):
    """JSON text that stands for itself."""


def _scalar(token: re.Match):
    if token["string"] is not None:
        return json.loads(token["string"])
    if token["word"] is not None:
        return _WORDS[token["word"]]
    number = token["number"]
    if token["broken"]:
        return float(number)
    return int(number) if len(number) <= _MOST_DIGITS else Written(number)


def read_deep(text: str):
    """A JSON value of any depth and any number of digits; ValueError if it is none."""
    open_, keys, at, state = [], [], 0, "value"
    while True:
        token = _TOKEN.match(text, at)
        if token is None:
            raise ValueError(f"no JSON at {at}")
        at, mark = token.end(), token["mark"]
        if state in ("key", "first key") and token["string"] is not None:
            keys.append(json.loads(token["string"]))
            state = "colon"
            continue
        if state == "colon" and mark == ":":
            state = "value"
            continue
        if state == "next" and mark == ",":
            state = "key" if isinstance(open_[-1], dict) else "value"
            continue
        if state in ("value", "first value") and mark in ("{", "["):
            open_.append({} if mark == "{" else [])
            state = "first key" if mark == "{" else "first value"
            continue
        if mark == "}" and state in ("first key", "next") and isinstance(open_[-1], dict):
            value = open_.pop()
        elif mark == "]" and state in ("first value", "next") and isinstance(open_[-1], list):
            value = open_.pop()
        elif mark is None and state in ("value", "first value"):
            value = _scalar(token)
        else:
            raise ValueError(f"{token[0]!r} at {at}")
        if not open_:
            if text[at:].strip(" \t\n\r"):
                raise ValueError(f"more text at {at}")
            return value
        if isinstance(open_[-1], dict):
            open_[-1][keys.pop()] = value
        else:
            open_[-1].append(value)
        state = "next"


def write_deep(value) -> str:
    """JSON text of a value of any depth."""
    parts, todo = [], [value]
    while todo:
        value = todo.pop()
        if isinstance(value, Written):
            parts.append(value)
        elif isinstance(value, dict):
            inside = [Written("{")]
            for i, (key, member) in enumerate(value.items()):
                inside += (Written(f"{',' if i else ''}{_dumps(key)}:"), member)
            todo += reversed([*inside, Written("}")])
        elif isinstance(value, list):
            inside = [Written("[")]
            for i, member in enumerate(value):
                inside += (Written(","), member) if i else (member,)
            todo += reversed([*inside, Written("]")])
        else:
            parts.append(_dumps(value))
    return "".join(parts)


def _write(value) -> str:
    try:
        return _dumps(value)
    except RecursionError:
        return write_deep(value)


def _batch_writer() -> Callable[[object], str]:
    """:func:`_write` for many values: ``_dumps`` makes an encoder anew for every value, and an answer has a dozen."""
    if json.encoder.c_make_encoder is None:
        return _write
    chunks = json.encoder.c_make_encoder(None, None, json.encoder.encode_basestring, None, ":", ",", False, False, True)

    def write(value) -> str:
        try:
            return "".join(chunks(value, 0))
        except RecursionError:
            return write_deep(value)

    return write


def read(text: str, write: Callable[[object], str] = _write) -> tuple[object, Callable[[object], str]]:
    """The value of a JSON text, None if it is none, and how its parts are written."""
    try:
        return json.loads(text), write
    except json.JSONDecodeError:
        return None, write
    except (RecursionError, ValueError):                          # too deep, or a number of too many digits
        try:
            return read_deep(text), write_deep
        except ValueError:
            return None, write


def _object(value) -> dict:
    return value if isinstance(value, dict) else {}


def parts(text: str, is_tool: bool, data_key: str, write: Callable[[object], str] = _write) -> tuple[dict, dict, dict, Callable[[object], str]]:
    """Data, confidences and excerpts of an answer, each empty where it is no object."""
    value, write = read(text, write)
    body = _object(value)
    data = _object(body.get(data_key)) if is_tool else body
    return data, _object(body.get("_confidence")), _object(body.get("_excerpts")), write


def _mend(row: str, columns: list[list], starts: list[int]) -> None:
    """Takes halves of surrogate pairs out of what a row added to the columns."""
    if _HALF_PAIR.search(row):
        for column, at in zip(columns, starts, strict=True):
            column[at:] = [v if v is None else v.encode("utf-8", "replace").decode() for v in column[at:]]


def _is_schedule(value: dict) -> bool:
    """Objects keyed by timestamps are kept whole: the first three keys, as written, tell."""
    keys = list(itertools.islice(value, 3))
    return bool(keys) and all(_TIMESTAMP.match(k) for k in keys)


def leaves(data: dict) -> dict[str, object]:
    """Dot path and value of every leaf, in the order they are written; of equal paths the last value."""
    found, stack = {}, [("", iter(data.items()))]
    while stack:                                                  # no recursion, so depth is not limited
        prefix, items = stack[-1]
        for key, value in items:
            if key in _SIDE_KEYS:
                continue
            if isinstance(value, dict) and not _is_schedule(value):
                stack.append((f"{prefix}{key}.", iter(value.items())))
                break
            found[prefix + key] = value
        else:
            stack.pop()
    return found


def _confidence_text(value) -> str | None:
    """A confidence as text: ``true`` counts as 1 and ``false`` as 0; what is neither number nor text is none."""
    if value is None or isinstance(value, (dict, list)):
        return None
    return str(int(value)) if isinstance(value, bool) else str(value)


def _excerpt_text(value, write) -> str | None:
    return value if value is None or isinstance(value, str) else write(value)


def _rows(texts: pa.Array, tools: pa.Array):
    return zip(texts.to_pylist(), tools.to_pylist(), strict=True)


def answer_parts(text: Column, is_tool: Column, data_key: str) -> Column:
    """struct<data, confidences, excerpts>, each a map from key to JSON text, in written order."""
    @F.arrow_udf(f"struct<{','.join(f'{p}:{_MAP}' for p in PARTS)}>")
    def opened(texts: pa.Array, tools: pa.Array) -> pa.Array:
        offsets, keys, values = [[0] for _ in PARTS], [[] for _ in PARTS], [[] for _ in PARTS]
        writer = _batch_writer()
        for row, is_tool in _rows(texts, tools):
            if row is not None:
                *maps, write = parts(row, is_tool, data_key, writer)
                starts = [len(k) for k in keys]
                for k, members in enumerate(maps):
                    keys[k] += members
                    values[k] += map(write, members.values())
                _mend(row, [*keys, *values], starts * 2)
            for k, ends in enumerate(offsets):
                ends.append(len(keys[k]))
        return pa.StructArray.from_arrays([
            pa.MapArray.from_arrays(pa.array(offsets[k], pa.int32()), pa.array(keys[k], pa.string()), pa.array(values[k], pa.string()))
            for k in range(len(PARTS))], PARTS)

    return opened.asNondeterministic()(text, is_tool)


def answer_leaves(text: Column, is_tool: Column, data_key: str) -> Column:
    """array<struct<path, value_json, raw_confidence, raw_excerpt>> of an answer's fields.

    Lists and timestamp-keyed objects are leaves; an empty object yields nothing; a JSON null is a leaf without
    value; numbers are written as ``1.0`` and ``10000000.0``.
    """
    @F.arrow_udf(_LEAVES)
    def flat(texts: pa.Array, tools: pa.Array) -> pa.Array:
        offsets, columns = [0], [[], [], [], []]
        paths, values, sures, quotes = columns
        writer = _batch_writer()
        for row, is_tool in _rows(texts, tools):
            if row is not None:
                data, sure, quote, write = parts(row, is_tool, data_key, writer)
                found = leaves(data)
                at = len(paths)
                paths += found
                values += [None if v is None else write(v) for v in found.values()]
                sures += [_confidence_text(sure.get(p)) for p in found] if sure else [None] * len(found)
                quotes += [_excerpt_text(quote.get(p), write) for p in found] if quote else [None] * len(found)
                _mend(row, columns, [at] * len(columns))
            offsets.append(len(paths))
        rows = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], ["path", "value_json", "raw_confidence", "raw_excerpt"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)

    return flat.asNondeterministic()(text, is_tool)
