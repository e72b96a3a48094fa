"""JSON encodings as plain Python: columnar tables, column dictionaries, interned subtrees.

Encoded nodes are objects with one reserved key that starts with ``~``; data keys that start
with ``~`` get one more, so decoding is exact. Canonical JSON has sorted keys and no spaces.

  {"~t": {"k": keys, "r": rows}} or with "d": a dictionary or null for each column
  {"~i": {"d": entries, "v": value}} and {"~r": index} · {"~x": sha256} for a stored subtree
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter

from . import costs

TABLE, INTERNED, REF, STORED = "~t", "~i", "~r", "~x"


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


def parse(text: str):
    return json.loads(text, parse_constant=_refuse)


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def size_of(value) -> int:
    return len(canonical(value).encode("utf-8", "surrogatepass"))


def _map_keys(value, f):
    if isinstance(value, dict):
        return {f(k): _map_keys(v, f) for k, v in value.items()}
    return [_map_keys(v, f) for v in value] if isinstance(value, list) else value


def escape(value):
    return _map_keys(value, lambda k: "~" + k if k.startswith("~") else k)


def unescape(value):
    return _map_keys(value, lambda k: k[1:] if k.startswith("~~") else k)


def columnarize(value):
    """Arrays of two or more objects with the same keys become tables."""
    if isinstance(value, dict):
        return {k: columnarize(v) for k, v in value.items()}
    if not isinstance(value, list) or len(value) < 2:
        return value
    if all(isinstance(x, dict) for x in value) and len({frozenset(x) for x in value}) == 1:
        keys = sorted(value[0])
        rows = [[columnarize(x[k]) for k in keys] for x in value]
        return _with_dictionaries(keys, rows)
    return [columnarize(x) for x in value]


def _with_dictionaries(keys: list[str], rows: list[list]):
    plain = {TABLE: {"k": keys, "r": rows}}
    if len(rows) < 3 or not keys:
        return plain
    dicts, columns = [], []
    for column in zip(*rows, strict=True):
        codes: dict[str, int] = {}
        coded = [codes.setdefault(canonical(v), len(codes)) for v in column]
        use = len(codes) < len(rows)
        dicts.append([json.loads(c) for c in codes] if use else None)
        columns.append(coded if use else list(column))
    if all(d is None for d in dicts):
        return plain
    coded = {TABLE: {"k": keys, "r": [list(r) for r in zip(*columns, strict=True)], "d": dicts}}
    return coded if size_of(coded) < size_of(plain) else plain


def _is_node(value, key: str) -> bool:
    return isinstance(value, dict) and len(value) == 1 and key in value


def restore(value):
    if _is_node(value, TABLE):
        t = value[TABLE]
        dicts = t.get("d") or [None] * len(t["k"])
        return [{k: restore(d[c] if d is not None else c) for k, d, c in zip(t["k"], dicts, r, strict=True)} for r in t["r"]]
    if isinstance(value, dict):
        return {k: restore(v) for k, v in value.items()}
    return [restore(v) for v in value] if isinstance(value, list) else value


def subtree_counts(value) -> Counter[str]:
    """Serialised subtrees of 32 bytes or more, with how often each occurs."""
    seen: Counter[str] = Counter()

    def walk(v):
        text = canonical(v)
        if len(text.encode("utf-8", "surrogatepass")) >= costs.INTERN_MIN_BYTES:
            seen[text] += 1
        for x in v.values() if isinstance(v, dict) else v if isinstance(v, list) else ():
            walk(x)

    walk(value)
    return seen


def intern(value):
    """Subtrees that occur twice or more move to a dictionary, if the document gets smaller."""
    often = {t for t, n in subtree_counts(value).items() if n >= 2}
    if not often:
        return value
    index: dict[str, int] = {}
    entries: list = []

    def rewrite(v):
        text = canonical(v)
        if text in index:
            return {REF: index[text]}
        if isinstance(v, dict):
            new = {k: rewrite(x) for k, x in v.items()}
        elif isinstance(v, list):
            new = [rewrite(x) for x in v]
        else:
            new = v
        if text in often:
            index[text] = len(entries)
            entries.append(new)
            return {REF: index[text]}
        return new

    body = rewrite(value)
    whole = {INTERNED: {"d": entries, "v": body}}
    return whole if size_of(whole) < size_of(value) else value


def unintern(value):
    if not _is_node(value, INTERNED):
        return value
    entries: list = []

    def put(v):
        if _is_node(v, REF):
            return entries[v[REF]]
        if isinstance(v, dict):
            return {k: put(x) for k, x in v.items()}
        return [put(x) for x in v] if isinstance(v, list) else v

    for e in value[INTERNED]["d"]:
        entries.append(put(e))
    return put(value[INTERNED]["v"])


def compress(text: str) -> str:
    return canonical(intern(columnarize(escape(parse(text)))))


def decompress(text: str) -> str:
    return canonical(unescape(restore(unintern(json.loads(text)))))


def store_subtrees(value, known: set[str], blobs: dict[str, bytes]):
    """Replace arrays and objects of 100 bytes or more that are known already; the others are stored. Bottom up."""
    if isinstance(value, dict):
        value = {k: store_subtrees(v, known, blobs) for k, v in value.items()}
    elif isinstance(value, list):
        value = [store_subtrees(v, known, blobs) for v in value]
    else:
        return value
    raw = canonical(value).encode("utf-8", "surrogatepass")
    if len(raw) < costs.CROSS_CALL_MIN_BYTES:
        return value
    ref = hashlib.sha256(raw).hexdigest()
    if ref in known and costs.CROSS_REF < len(raw):
        return {STORED: ref}
    known.add(ref)
    blobs[ref] = raw
    return value


def resolve(value, get):
    """Put stored subtrees back; ``get`` raises KeyError for one that is missing."""
    if _is_node(value, STORED):
        return resolve(json.loads(get(value[STORED])), get)
    if isinstance(value, dict):
        return {k: resolve(v, get) for k, v in value.items()}
    return [resolve(v, get) for v in value] if isinstance(value, list) else value


def stored_refs(value) -> list[str]:
    if _is_node(value, STORED):
        return [value[STORED]]
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return [r for x in inner for r in stored_refs(x)]


def type_name(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    return "number" if isinstance(value, int | float) else "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"
