"""Content class, token estimates, line scores and format detection as native columns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import costs

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Substrings that mark logs and code.
LOG_MARKERS = (" INFO ", " WARN ", " ERROR ", " DEBUG ", " TRACE ", " FATAL ", "[INFO]", "[WARN]", "[ERROR]", "[DEBUG]", "[TRACE]", "INFO:", "WARN:", "ERROR:", "DEBUG:")
CODE_MARKERS = ("fn ", "pub fn", "async fn", "impl ", "struct ", "enum ", "trait ", "def ", "class ", "import ", "from ", "return ", "function ", "const ", "let ", "var ", "=>", "func ", "package ", "type ", "public class", "private ", "protected ", "#include", "namespace ", "template<", "SELECT ", "FROM ", "WHERE ", "INSERT INTO")
# Words that score a line.
SEVERE = ("error", "fatal", "panic", "exception", "critical")
WARNING = ("warn",)
FAILING = ("fail", "denied", "refused", "timeout", "crash", "abort", "killed")


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def alternation(words: tuple[str, ...]) -> str:
    """A regular expression for any of the words as they are."""
    return "|".join("".join("\\" + ch if ch in "[]()<>{}.*+?^$|\\#=" else ch for ch in w) for w in words)


def text_lines(text: Column) -> Column:
    """Lines as a reader sees them: \\n or \\r\\n ends a line, and a last empty one is none."""
    parts = F.split(text, "\n", -1)
    n = F.size(parts)
    cut = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), n - 1)).otherwise(parts)
    return F.transform(cut, lambda x: F.regexp_replace(x, "\r\\z", ""))


def first_lines(text: Column, n: int) -> Column:
    """The first n lines as ``text_lines`` has them, without splitting the rest."""
    parts = F.split(text, "\n", n + 1)
    size = F.size(parts)
    whole = F.when((size <= n) & (F.element_at(parts, -1) == ""), F.slice(parts, F.lit(1), size - 1)).otherwise(F.slice(parts, 1, n))
    return F.transform(whole, lambda x: F.regexp_replace(x, "\r\\z", ""))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return any_of([text.contains(w) for w in words])


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def content_class(text: Column, indent: str = r"\s", long_hex: bool = True) -> Column:
    """json, logs, code, hex or prose; null is prose like the empty text.

    Only the first 4096 bytes are looked at for logs, code and hex, which is the rule itself; a cut inside a
    character leaves nothing to look at for logs and code. ``indent`` is what may stand before a date; without
    ``long_hex`` a text of more than 4096 bytes is never hex.
    """
    text = F.coalesce(text, F.lit(""))
    sample = F.substring(F.encode(text, "utf-8"), 1, costs.SAMPLE_BYTES)
    opener = text.rlike(r'\A[ \t\n\f\r]*(\{|\[["{\[ntf0-9-])')

    def of_seen(seen: Column) -> Column:
        dated = F.exists(first_lines(seen, 10), lambda x: x.rlike(rf"\A{indent}*([0-9]{{4}}-|[0-9]{{10}})"))
        return F.when(contains_any(seen, LOG_MARKERS), "logs").when(dated, "logs").when(contains_any(seen, CODE_MARKERS), "code")

    def of_bytes(single: Column) -> Column:
        """One character for each byte of the sample that is no white space."""
        hexed = F.length(F.regexp_replace(single, r"[^0-9A-Fa-f+/=_-]+", ""))
        # hex when hexed / all >= 0.7, in whole numbers
        said = (F.length(single) > 0) & (hexed * 10 >= F.length(single) * 7)
        return F.when(said if long_hex else said & (F.octet_length(text) <= costs.SAMPLE_BYTES), "hex").otherwise("prose")

    told = let(F.when(F.is_valid_utf8(sample), F.decode(sample, "utf-8")).otherwise(F.lit("")), of_seen)
    rest = let(F.regexp_replace(F.decode(sample, "iso-8859-1"), r"[ \t\n\f\r]+", ""), of_bytes)
    return F.when(text == "", "prose").when(opener, "json").otherwise(F.coalesce(told, rest))


def bytes_per_token(klass: Column) -> Column:
    out = F.when(klass == "json", costs.BYTES_PER_TOKEN["json"])
    for k in ("code", "logs", "hex"):
        out = out.when(klass == k, costs.BYTES_PER_TOKEN[k])
    return out.otherwise(costs.BYTES_PER_TOKEN["prose"])


def estimated_tokens(n_bytes: Column, klass: Column) -> Column:
    return n_bytes / bytes_per_token(klass)


def anomaly_score(line: Column) -> Column:
    low = ascii_lower(line)
    flag = lambda words, n: F.when(contains_any(low, words), n).otherwise(0)
    return F.lit(1) + flag(SEVERE, 10) + flag(WARNING, 5) + flag(FAILING, 8) + F.when(F.octet_length(line) > 200, 2).otherwise(0)


# What a line of a format looks like; (?d) makes a line feed the only line end.
PYTEST = r"(?md)^(===.*test session starts|PASSED|FAILED|(?=.*::test_).*(PASSED|FAILED))"
CARGO = r"(?md)^(   (Compiling|Finished|Running) |test result:|error\[E|warning\[|test .*( \.\.\. ok| \.\.\. FAILED))"
DIFF = r"(?md)^(diff --git |@@ )"
STATUS = r"(?md)^((Changes to be committed:|Changes not staged for commit:|Untracked files:)$|On branch |\tmodified:|\tnew file:)"
PACKAGE = r"(?md)^(npm warn |npm notice |Downloading |Collecting |Requirement already satisfied|Successfully installed |(?=.*added ).*packages)"


def detect_format(text: Column) -> Column:
    """Name of the first format that the first 40 lines show, else null."""

    def of_lines(ls: Column) -> Column:
        filled = F.filter(ls, lambda x: x != "")
        hashes = F.size(F.filter(F.slice(ls, 1, 10), lambda x: x.rlike(r"\A[0-9A-Fa-f]{7,12} ")))
        log = (F.size(filled) > 1) & (hashes == F.least(F.size(filled), F.lit(10)))
        records = F.size(F.filter(filled, lambda x: F.trim(x).rlike(r"(?s)\A(\{.*\}|\[.*\])\z")))
        jsonl = (F.size(filled) >= 2) & (records * 2 >= F.size(filled))

        def of_head(h: Column) -> Column:
            diff = h.rlike(DIFF) | (h.rlike(r"(?md)^--- a/") & h.rlike(r"(?md)^\+\+\+ b/"))
            early = F.when(h.rlike(PYTEST), "pytest").when(h.rlike(CARGO), "cargo").when(diff, "git-diff").when(h.rlike(STATUS), "git-status")
            return early.when(log, "git-log").when(h.rlike(PACKAGE), "package-manager").when(jsonl, "jsonl")

        return F.when(F.size(ls) > 0, let(F.array_join(ls, "\n"), of_head))

    return let(first_lines(F.coalesce(text, F.lit("")), 40), of_lines)


def format_or_hint(text: Column, hint: Column) -> Column:
    """A known hint wins; an unknown or null hint leaves it to detection."""
    return F.when(hint.isin("pytest", "cargo", "git-diff", "git-status", "git-log", "package-manager", "jsonl"), hint).otherwise(detect_format(text))


def human_tokens(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1e6)).when(n >= 1_000, F.format_string("%.1fk", n / 1e3)).otherwise(F.format_string("%.0f", n.cast("double")))


def human_bytes(n: Column) -> Column:
    out = F.when(n < 1024, F.format_string("%d B", n.cast("long")))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = out.when(n < 1024 ** (k + 1), F.format_string(f"%.1f {unit}", n / 1024**k))
    return out.otherwise(F.format_string("%.1f PB", n / 1024**5))


def preview(text: Column) -> Column:
    """The first 80 characters, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.left(text, F.lit(80)), r"\s+", " "))


def saved_percent(original: Column, compressed: Column) -> Column:
    return F.format_string("%.1f%%", F.when(original > 0, F.greatest(F.lit(0), original - compressed) * 100.0 / original).otherwise(F.lit(0.0)))


def compression_ratio(original: Column, compressed: Column) -> Column:
    return F.when(original > 0, compressed / original).otherwise(F.lit(1.0))


def is_valid_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\A[0-9a-fA-F]{64}\z"), F.lit(False))


def glob_regex(pattern: str) -> str:
    """A glob (* and ?) as an anchored regular expression over a whole line."""
    return r"(?s)\A" + "".join(".*" if ch == "*" else "." if ch == "?" else "\\" + ch if not (ch.isalnum() or ch in " _" or ord(ch) > 127) else ch for ch in pattern) + r"\z"


def first_sentence(text: Column, limit: int = 200) -> Column:
    """Up to the first full stop or line end, and no more characters than the limit."""
    return F.left(F.regexp_extract(text, r"\A[^.\n]*\.?", 0), F.lit(limit))


def session_key(tool_input: Column) -> Column:
    """``session:`` and the first field of a JSON tool input that names what it works on."""
    field = lambda k: F.nullif(F.get_json_object(tool_input, f"$.{k}"), F.lit(""))
    found = F.coalesce(*[field(k) for k in ("command", "file_path", "url", "pattern", "query", "prompt")])
    return F.concat(F.lit("session:"), F.left(found, F.lit(600)))


def response_text(response: Column) -> Column:
    """The text of a JSON tool response."""
    field = lambda k: F.nullif(F.get_json_object(response, f"$.{k}"), F.lit(""))
    return F.coalesce(field("stdout"), field("file.content"), *[field(k) for k in ("content", "output", "text", "result")], response)
