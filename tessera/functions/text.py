"""Names and mentions as comparable text, and the token-set similarity of two of them."""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INSIDE = re.compile(r"(?<=\w)['’](?=\w)")
_MARKS = re.compile(r"[^\w\s]")
_ARTICLE = re.compile(r"^(?:the|an|a)\s+")


def mention_form(text: str | None) -> str:
    """NFKC, case folded, apostrophes inside words gone, other marks as spaces, one leading article dropped."""
    s = unicodedata.normalize("NFKC", text or "").casefold()
    s = " ".join(_MARKS.sub(" ", _INSIDE.sub("", s)).split())
    return _ARTICLE.sub("", s, count=1)


def name_form(text: str | None) -> str:
    """NFKC, lower case, one leading @ dropped, spaces collapsed, a leading `the` dropped; marks stay."""
    s = unicodedata.normalize("NFKC", text or "").lower().strip()
    s = re.sub(r"\s+", " ", s[1:] if s.startswith("@") else s)
    return s[4:] if s.startswith("the ") else s


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


@lru_cache(65_536)
def token_set_ratio(a: str, b: str) -> float:
    """0 to 100: the best of comparing the two differences and each difference with the common tokens."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    gap = 1 if both else 0
    n, m = len(both) + gap + len(left), len(both) + gap + len(right)
    edits = len(left) + len(right) - 2 * _common(left, right)
    scores = [100 * (1 - edits / (n + m))]
    if both:
        scores += [100 * (1 - (gap + len(left)) / (len(both) + n)), 100 * (1 - (gap + len(right)) / (len(both) + m))]
    return max(scores)


@F.pandas_udf(T.StringType())
def normalize_mention(s: pd.Series) -> pd.Series:
    return s.map(mention_form)


@F.pandas_udf(T.StringType())
def normalize_name(s: pd.Series) -> pd.Series:
    return s.map(name_form)


@F.pandas_udf(T.ArrayType(T.StringType()))
def normalize_mentions(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else [mention_form(x) for x in v])


@F.pandas_udf(T.ArrayType(T.StringType()))
def normalize_names(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else [name_form(x) for x in v])


@F.pandas_udf(T.DoubleType())
def set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([0.0 if x is None or y is None else token_set_ratio(x, y) for x, y in zip(a, b, strict=True)])


def mention_key(kind: Column, name: Column) -> Column:
    return F.concat_ws(":", kind, name)


def gold_forms(surface: Column, aliases: Column) -> Column:
    """Distinct non-empty normalised forms, the surface's first."""
    forms = F.concat(F.array(surface), F.coalesce(aliases, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(normalize_mentions(forms), lambda x: x != ""))


def opaque_id(key: bytes):
    """A keyed, url-safe id of 43 characters: HMAC-SHA256 in base64 without padding."""
    import base64

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else base64.urlsafe_b64encode(hmac.new(key, x.encode(), hashlib.sha256).digest()).decode().rstrip("="))

    return run


def derive_key(password: str, salt: bytes, rounds: int = 600_000) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, rounds)


def sealed(c: Column, key: bytes) -> Column:
    """AES-GCM under the key, base64."""
    return F.base64(F.aes_encrypt(c, F.lit(key), F.lit("GCM")))


def opened(c: Column, key: bytes) -> Column:
    return F.aes_decrypt(F.unbase64(c), F.lit(key), F.lit("GCM")).cast("string")
