"""Secret masking in one left-to-right pass, for display only: stored bytes are never masked."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VALUE = r"""(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^ \t\r\n&"']*)"""

# Kinds in order of precedence, with the pattern of each.
KINDS: list[tuple[str, str]] = [
    ("aws_key", r"AKIA[A-Z0-9]{16}(?![A-Z0-9])"),
    ("github_token", r"ghp_[A-Za-z0-9]{36}"),
    ("github_oauth", r"gho_[A-Za-z0-9]{36}"),
    ("github_pat", r"github_pat_[A-Za-z0-9_]{82}"),
    ("slack_token", r"xox[abp]-[A-Za-z0-9-]{15,}"),
    ("google_api_key", r"AIza[A-Za-z0-9_-]{35}"),
    ("npm_token", r"npm_[A-Za-z0-9]{36}"),
    ("bearer_token", r"""Bearer [^ \t\n\r"']{20,}"""),
    ("auth_token", rf"_authToken=(?={{0}}){_VALUE}".replace("{0}", r"""["']?[^ \t\r\n&"']{8}""")),
    ("password", rf"""(?<![A-Za-z0-9])password=(?=["']?.{{8}})(?P<v1>{_VALUE})"""),
    ("secret", rf"""(?<![A-Za-z0-9])secret=(?=["']?.{{8}})(?P<v2>{_VALUE})"""),
    ("token", rf"""(?<![A-Za-z0-9])token=(?=["']?.{{10}})(?P<v3>{_VALUE})"""),
    ("api_key", rf"""(?<![A-Za-z0-9])api_key=(?=["']?.{{10}})(?P<v4>{_VALUE})"""),
    ("private_key", r"-----BEGIN[^\n]*PRIVATE KEY[^\n]*[\s\S]*?-----END[^\n]*(?:\n|\Z)"),
    ("url_credentials", r"""https?://[^:@/]*:[^@/]{4,}@[^ \t\n\r"'<>]*"""),
    ("jwt", r"(?=[A-Za-z0-9_.=-]{100})eyJ[A-Za-z0-9_=-]{17,}\.[A-Za-z0-9_=-]{20,}\.[A-Za-z0-9_=-]{20,}"),
]
#: Least bytes of an assigned value.
LEAST = {"auth_token": 8, "password": 8, "secret": 8, "token": 10, "api_key": 10}

_ALL = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS))
# Prefixes by which an assigned value gets a precise kind.
_PRECISE = [
    ("aws_key", re.compile(r"AKIA[A-Z0-9]{12,16}")),
    ("github_pat", re.compile(r"github_pat_[A-Za-z0-9_]{71,82}")),
    ("github_token", re.compile(r"ghp_[A-Za-z0-9]{32,36}")),
    ("github_oauth", re.compile(r"gho_[A-Za-z0-9]{32,36}")),
    ("slack_token", re.compile(r"xox[abp]-[\s\S]{15,}")),
    ("google_api_key", re.compile(r"AIza[\s\S]{31,}")),
    ("npm_token", re.compile(r"npm_[A-Za-z0-9]{32,36}")),
]


def _kind(m: re.Match) -> str | None:
    kind = next(k for k, _ in KINDS if m[k] is not None)
    if kind in LEAST:
        value = m[0].split("=", 1)[1]
        bare = value.strip("\"'") if value[:1] in "\"'" else value
        if len((value[1:] if value[:1] in "\"'" and value else value).encode()) < LEAST[kind]:
            return None
        if kind != "auth_token":
            return next((k for k, p in _PRECISE if p.match(bare)), kind)
    return kind


#: Every kind holds one of these, so a text without them has no secret.
HINTS = ("AKIA", "ghp_", "gho_", "github_pat_", "xox", "AIza", "npm_", "Bearer ", "_authToken=", "password=", "secret=", "token=", "api_key=", "-----BEGIN", "://", "eyJ")


def mask(text: str) -> tuple[str, int]:
    """The masked text and the number of secrets."""
    if not any(h in text for h in HINTS):
        return text, 0
    out, at, n = [], 0, 0
    pos = 0
    while m := _ALL.search(text, pos):
        kind = _kind(m)
        if kind is None:
            pos = m.start() + 1
            continue
        out += [text[at : m.start()], f"[MASKED:{kind}:{m[0][-4:]}]"]
        at = pos = m.end()
        n += 1
        if m.end() == m.start():
            pos += 1
    return "".join(out) + text[at:], n


@F.pandas_udf(T.StructType([T.StructField("masked", T.StringType()), T.StructField("n_masked", T.LongType())]))
def mask_secrets(text: pd.Series) -> pd.DataFrame:
    """Struct (masked, n_masked); null stays null with no secret."""
    return pd.DataFrame([(None, 0) if t is None else mask(t) for t in text], columns=["masked", "n_masked"])


def prefix_counts(text: Column) -> dict[str, Column]:
    """Native counts of the kinds that a plain pattern tells."""
    plain = {"github_token": r"ghp_[A-Za-z0-9]{36}", "npm_token": r"npm_[A-Za-z0-9]{36}", "google_api_key": r"AIza[A-Za-z0-9_-]{35}"}
    return {k: F.regexp_count(text, F.lit(p)) for k, p in plain.items()}
