"""Line views of a text as plain Python: what Arrow batches run for each document.

A view is a list of segments (op, n, ref, text):
  L literal line · R repeat the last line, n in all · E n lines elided, stored as blob ref
  D same as the literal at view index n · W the whole content is blob ref.
Stored blobs come back beside the view, so nothing is lost. Sizes follow ``costs``.
"""

from __future__ import annotations

import hashlib
import re
from itertools import groupby

from . import costs

MARK = "\ue000"
GUARD = "\ue001"

Segment = tuple[str, int, str, str]


def escape_line(line: str) -> str:
    return MARK + GUARD + line if line.startswith(MARK) else line


def unescape_line(line: str) -> str:
    return line[2:] if line.startswith(MARK + GUARD) else line


def size_of(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def blob_id(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def literal(line: str) -> Segment:
    return ("L", 0, "", line)


def repeat_runs(lines: list[str], min_repeat: int = costs.MIN_REPEAT) -> list[Segment]:
    """Collapse runs of equal lines where that is cheaper."""
    out: list[Segment] = []
    for line, run in groupby(lines):
        r = sum(1 for _ in run)
        b = size_of(line)
        if r >= min_repeat and b + 1 + costs.number(costs.REPEAT, r) < (b + 1) * r:
            out += [literal(line), ("R", r, "", "")]
        else:
            out += [literal(line)] * r
    return out


def back_references(view: list[Segment]) -> list[Segment]:
    """Later copies of a literal become references to its view index where that is cheaper."""
    first: dict[str, int] = {}
    out = []
    for k, seg in enumerate(view):
        op, _, _, line = seg
        if op == "L" and not line.startswith(MARK):
            at = first.setdefault(line, k)
            if at != k and costs.number(costs.DEDUP, at) < size_of(line):
                seg = ("D", at, "", "")
        out.append(seg)
    return out


def elide(lines: list[str], blobs: dict[str, bytes]) -> list[Segment]:
    if not lines:
        return []
    raw = "\n".join(lines).encode("utf-8", "surrogatepass")
    ref = blob_id(raw)
    blobs[ref] = raw
    return [("E", len(lines), ref, "")]


def escaped(text: str) -> list[str]:
    return [escape_line(x) for x in text.split("\n")]


def compress_text(text: str, min_repeat: int = costs.MIN_REPEAT, threshold: int = costs.LINE_THRESHOLD, head: int = costs.HEAD_LINES, tail: int = costs.TAIL_LINES) -> tuple[list[Segment], dict[str, bytes]]:
    blobs: dict[str, bytes] = {}
    lines = escaped(text)
    n = len(lines)
    if n <= threshold:
        return back_references(repeat_runs(lines, min_repeat)), blobs
    h = min(head, n)
    t = min(tail, n - h)
    view = repeat_runs(lines[:h], min_repeat) + elide(lines[h : n - t], blobs) + repeat_runs(lines[n - t :] if t else [], min_repeat)
    return back_references(view), blobs


def segment_bytes(seg: Segment) -> int:
    op, n, _, line = seg
    if op == "L":
        return size_of(line)
    return {"R": lambda: costs.number(costs.REPEAT, n), "E": lambda: costs.number(costs.ELIDE, n), "D": lambda: costs.number(costs.DEDUP, n), "W": lambda: costs.RAW}[op]()


def view_bytes(view: list[Segment]) -> int:
    return sum(map(segment_bytes, view)) + max(0, len(view) - 1)


def expand(view: list[Segment], get) -> str:
    """The text of a view. ``get`` gives the bytes of a blob and raises KeyError without it."""
    out: list[str] = []
    literals: dict[int, str] = {}
    for k, (op, n, ref, line) in enumerate(view):
        if op == "L":
            literals[k] = line
            out.append(line)
        elif op == "D":
            out.append(literals.get(n, ""))
        elif op == "R":
            out += [out[-1]] * (n - 1) if out else []
        elif op == "E":
            out += get(ref).decode("utf-8", "surrogatepass").split("\n")
        else:
            return get(ref).decode("utf-8", "surrogatepass")
    return "\n".join(map(unescape_line, out))


def refs_of(view: list[Segment]) -> list[str]:
    return [ref for op, _, ref, _ in view if op in "EW"]


_RENDERED = re.compile(MARK + r"([REDW]):([0-9]*):([0-9a-f]*)" + MARK + r"\Z")


def render(view: list[Segment]) -> str:
    """A view as one string; markers cannot be forged because literals that start like one are escaped."""
    return "\n".join(line if op == "L" else f"{MARK}{op}:{n}:{ref}{MARK}" for op, n, ref, line in view)


def read(body: str) -> list[Segment]:
    out: list[Segment] = []
    for line in body.split("\n"):
        m = _RENDERED.match(line)
        out.append((m[1], int(m[2] or 0), m[3], "") if m else literal(line))
    return out


# Budgeted views.


def anomaly_score(line: str) -> int:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), line)
    score = 1
    for words, points in ((("error", "fatal", "panic", "exception", "critical"), 10), (("warn",), 5), (("fail", "denied", "refused", "timeout", "crash", "abort", "killed"), 8)):
        score += points if any(w in low for w in words) else 0
    return score + (2 if size_of(line) > 200 else 0)


def keep_view(lines: list[str], keep: set[int], blobs: dict[str, bytes]) -> list[Segment]:
    view: list[Segment] = []
    for kept, part in groupby(range(len(lines)), key=keep.__contains__):
        at = list(part)
        view += [literal(lines[k]) for k in at] if kept else elide([lines[k] for k in at], blobs)
    return back_references(view)


def compress_budget(text: str, max_bytes: int) -> tuple[list[Segment], dict[str, bytes]]:
    """The plain view if it fits; else the ends and the most telling lines, halved in number until they fit or only the ends are left."""
    view, blobs = compress_text(text)
    if view_bytes(view) <= max_bytes:
        return view, blobs
    lines = escaped(text)
    ends = list(dict.fromkeys((0, len(lines) - 1)))
    inner = sorted(range(1, len(lines) - 1), key=lambda k: -anomaly_score(lines[k]))
    order = ends + inner
    for halved in range(1, len(lines).bit_length() + 1):
        blobs = {}
        view = keep_view(lines, set(order[: max(len(ends), len(lines) >> halved)]), blobs)
        if view_bytes(view) <= max_bytes:
            break
    return view, blobs


# Format-aware views: rules in order of precedence, (class, pattern of the line); class None and lines without a rule stay.
# What the formats' lines look like.
RULES: dict[str, list[tuple[str | None, re.Pattern]]] = {
    "pytest": [
        (None, re.compile(r"===|---|___|FAILED |ERROR |    |>|E |short test summary")),
        ("noise", re.compile(r"(?s).* PASSED")),
        ("noise", re.compile(r"\s*(?=\S)[.FEs \[\]%0-9]{1,79}(?<=\S)\s*\Z")),
    ],
    "cargo": [
        ("building", re.compile(r"   Compiling |   Downloading ")),
        ("passing", re.compile(r"(?s)(?=test ).* \.\.\. ok\Z")),
    ],
    "package-manager": [
        (None, re.compile(r"(?s).*(?:error|warn|successfully installed|successfully downloaded|failed|vulnerability|vulnerabilities)", re.I | re.A)),
        (None, re.compile(r"(?s)(?=.*added ).*packages|requirement already satisfied", re.I | re.A)),
        ("progress", re.compile(r"downloading|installing|collecting|npm notice|obtaining|using cached", re.I | re.A)),
    ],
}


def class_of(fmt: str, line: str) -> str | None:
    return next((c for c, rule in RULES[fmt] if rule.match(line)), None)


def _elide_classes(lines: list[str], classes: list[str | None], blobs: dict[str, bytes]) -> list[Segment]:
    out: list[Segment] = []
    for klass, part in groupby(range(len(lines)), key=classes.__getitem__):
        at = [lines[k] for k in part]
        out += [literal(x) for x in at] if klass is None else elide(at, blobs)
    return out


def _git_diff(lines: list[str], blobs: dict[str, bytes]) -> list[Segment]:
    out: list[Segment] = []
    for context, part in groupby(lines, key=lambda x: x.startswith(" ")):
        at = list(part)
        if context and len(at) > 6:
            out += [literal(x) for x in at[:3]] + elide(at[3:-3], blobs) + [literal(x) for x in at[-3:]]
        else:
            out += [literal(x) for x in at]
    return out


def _keys(line: str) -> tuple[str, ...] | None:
    from .jsontree import parse

    try:
        value = parse(line.strip())
    except ValueError:
        return None
    return tuple(sorted(value)) if isinstance(value, dict) else None


def _jsonl(lines: list[str], blobs: dict[str, bytes]) -> list[Segment] | None:
    first = next((k for k, x in enumerate(lines) if x.strip()), None)
    schema = _keys(lines[first]) if first is not None else None
    if schema is None:
        return None
    classes = ["record" if k > first and x.strip() and _keys(x) == schema else None for k, x in enumerate(lines)]
    return _elide_classes(lines, classes, blobs)


def compress_format(text: str, name: str) -> tuple[list[Segment], dict[str, bytes]]:
    """A view by the rules of a format; formats that are compact already stay literal."""
    blobs: dict[str, bytes] = {}
    lines = escaped(text)
    if name in RULES:
        return _elide_classes(lines, [class_of(name, x) for x in lines], blobs), blobs
    if name == "git-diff":
        return _git_diff(lines, blobs), blobs
    if name == "jsonl":
        view = _jsonl(lines, blobs)
        if view is not None:
            return view, blobs
    return [literal(x) for x in lines], blobs
