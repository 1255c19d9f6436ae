"""Plain-Python readings of JSON texts, shared by the nested-record and the drift operators.

Readings (the same in both operators):

* a text that is null, empty or not JSON has no value (``MISSING``);
* a string that begins with ``[`` or ``{`` and is JSON counts as the value it holds, at any depth;
* a lone object at a path where other records hold an array of objects counts as element 0.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any


class MISSING:
    """Stands for no value. A class, since closures sent to tasks keep the identity of classes only."""


def _no_constant(name: str):
    raise ValueError(name)


_decode = json.JSONDecoder(parse_constant=_no_constant).decode


def read_json(text: str | None) -> Any:
    """The JSON value of a text, or MISSING; never raises."""
    if not text:
        return MISSING
    try:
        return _decode(text)
    except (ValueError, RecursionError):
        return MISSING


def opened(value: Any) -> Any:
    """A string that itself is a JSON array or object is replaced by what it holds."""
    while isinstance(value, str) and value[:1] in ("[", "{"):
        inner = read_json(value)
        if inner is MISSING:
            return value
        value = inner
    return value


def safe(text: str) -> str:
    """Lone surrogates (possible in JSON escapes) cannot be stored as UTF-8."""
    try:
        text.encode("utf-8")
        return text
    except UnicodeEncodeError:
        return text.encode("utf-8", "replace").decode("utf-8")


def kind_of(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    return "object" if isinstance(value, dict) else "array"


def array_paths(value: Any, maps: frozenset[str] = frozenset()) -> set[str]:
    """Paths (indices written ``[]``, keys of ``maps`` ``*``) at which this record holds an array with an object in it."""
    found: set[str] = set()
    todo = [("", value)]
    while todo:
        path, x = todo.pop()
        x = opened(x)
        if isinstance(x, dict):
            is_map = path.rpartition(".")[2] in maps
            for k, v in x.items():
                k = "*" if is_map else k
                todo.append((f"{path}.{k}" if path else k, v))
        elif isinstance(x, list):
            held = [opened(v) for v in x]
            if any(isinstance(v, dict) for v in held):
                found.add(path)
            todo.extend((f"{path}[]", v) for v in held)
    return found


def last_step(path: str) -> str:
    return path.rpartition(".")[2]


def element_rows(value: Any, arrays: frozenset[str], entries: frozenset[str] = frozenset()) -> Iterator[tuple[str, str, str, tuple[int, ...], str | None, Any]]:
    """(place, child, parent, ordinals, key, element) of every object that is an element of an array, and of every entry of the ``entries`` maps.

    ``place`` is the path with ``[]`` for indices and ``*`` for keys of maps, ``child`` the element's own path,
    ``parent`` that of the nearest enclosing element or '', ``key`` that of an entry. ``arrays`` is the merged schema's set of
    array-of-object paths.
    """
    todo: list[tuple[str, str, str, tuple[int, ...], Any]] = [("", "", "", (), value)]
    while todo:
        norm, path, parent, at, x = todo.pop()
        x = opened(x)
        if isinstance(x, dict) and norm in arrays:
            x = [x]
        if isinstance(x, dict) and norm and last_step(norm) in entries:
            for i, (k, v) in enumerate(x.items()):
                v, here = opened(v), f"{path}.{k}"
                yield f"{norm}.*", here, parent, (*at, i), k, v
                if isinstance(v, dict):
                    todo.extend((f"{norm}.*.{kk}", f"{here}.{kk}", here, (*at, i), w) for kk, w in v.items() if isinstance(w, (dict, list, str)))
                elif isinstance(v, list):
                    todo.append((f"{norm}.*", here, here, (*at, i), v))
        elif isinstance(x, dict):
            for k, v in x.items():
                if isinstance(v, (dict, list, str)):
                    todo.append((f"{norm}.{k}" if norm else k, f"{path}.{k}" if path else k, parent, at, v))
        elif isinstance(x, list):
            for i, v in enumerate(x):
                v, here = opened(v), f"{path}[{i}]"
                if isinstance(v, dict):
                    yield f"{norm}[]", here, parent, (*at, i), None, v
                    for k, w in v.items():
                        if isinstance(w, (dict, list, str)):
                            todo.append((f"{norm}[].{k}", f"{here}.{k}", here, (*at, i), w))
                elif isinstance(v, list):
                    todo.append((f"{norm}[]", here, parent, (*at, i), v))


# what a field's text stands for
KINDS = {"s": "string", "i": "bigint", "n": "double", "b": "boolean", "a": "string", "o": "string", "z": "string"}


def as_json(value: Any) -> str:
    return safe(json.dumps(value, ensure_ascii=False, separators=(",", ":")))


def own_fields(obj: Any, arrays: frozenset[str], place: str, entries: frozenset[str] = frozenset(), kept: frozenset[str] = frozenset()) -> dict[str, tuple[str, str | None]]:
    """field -> (kind, text) of what stays in the element's own row; nothing of the element is lost.

    Scalars stay as they are and nulls as nulls (kinds as in ``KINDS``), inner objects are dotted; empty objects,
    the maps named in ``kept`` and arrays stay as JSON. Of an array whose objects are rows of their own only
    other elements stay, in their places. An element that is no object has one field, ``value``.
    """
    out: dict[str, tuple[str, str | None]] = {}
    todo: list[tuple[str, Any]] = [("", obj if isinstance(obj, dict) else {"value": obj})]
    while todo:
        name, x = todo.pop()
        x = opened(x) if name else x
        full = f"{place}.{name}" if place and name else name or place
        if isinstance(x, dict):
            if name and (full in arrays or last_step(name) in entries):
                continue
            if name and (not x or last_step(name) in kept):
                out[safe(name)] = ("o", as_json(x))
            else:
                todo.extend((f"{name}.{k}" if name else k, v) for k, v in x.items())
        elif isinstance(x, list):
            rows = [full in arrays and isinstance(opened(v), dict) for v in x]
            if not all(rows) or not x:
                out[safe(name)] = ("a", as_json([None if row else v for row, v in zip(rows, x)]))
        elif x is None:
            out[safe(name)] = ("z", None)
        elif isinstance(x, str):
            out[safe(name)] = ("s", safe(x))
        else:
            out[safe(name)] = ("b" if isinstance(x, bool) else "i" if isinstance(x, int) else "n", json.dumps(x))
    return out


OBJECTS = "objects"


def typed_fields(value: Any, maps: frozenset[str]) -> Iterator[tuple[str, str, Any]]:
    """(path, type, scalar or None) of every field with a value other than null; map keys are ``*``.

    Arrays that hold an object also give (path, ``OBJECTS``, None): where other records have a lone object there,
    ``as_elements`` reads it as their element.
    """
    todo: list[tuple[str, Any, bool]] = [("", value, False)]
    while todo:
        path, x, field = todo.pop()
        x = opened(x)
        if x is None:
            continue
        if field:
            yield path, kind_of(x), x if not isinstance(x, (dict, list)) else None
        if isinstance(x, dict):
            is_map = last_step(path) in maps
            for k, v in x.items():
                k = "*" if is_map else k
                todo.append((f"{path}.{k}" if path else k, v, True))
        elif isinstance(x, list):
            held = [opened(v) for v in x]
            if any(isinstance(v, dict) for v in held):
                yield path, OBJECTS, None
            todo.extend((f"{path}[]", v, False) for v in held)


def as_elements(path: str, arrays: frozenset[str]) -> str:
    """A path on which lone objects at the places of arrays are read as elements: ``a.b`` as ``a[].b``."""
    done, rest = "", path
    while rest:
        step, dot, rest = rest.partition(".")
        done = f"{done}.{step}" if done else step
        if dot and done in arrays:
            done += "[]"
    return done
