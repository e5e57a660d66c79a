"""String functions as Column expressions: tokenisers, redaction, ids, paths, URLs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Markers of to-do comments; what hides a secret, and the patterns of secrets to hide, in this order.
TODO_MARKERS = ("TODO", "FIXME", "XXX")
HIDDEN = "[REDACTED]"
HIDE_KEY = r"(?:sk-|ghp_|xoxb-)[\w\-]+"
HIDE_BEARER = r"(Bearer )\S+"
HIDE_URL_PASSWORD = r"(://[^:/\s]+:)[^/\s]+(@)"
HIDE_ASSIGNED = r"(?i)(\b(?:\w*_)?(?:API_KEY|TOKEN|SECRET|PASSWORD|PASSWD)=)\S+"
#: Prefixes by which the secret check knows keys.
SECRET_PREFIXES = r"\b(?:sk-[A-Za-z0-9_-]{16,}|ghp_[A-Za-z0-9]{20,}|gho_[A-Za-z0-9]{20,}|AKIA[A-Z0-9]{12,}|xox[abp]-[A-Za-z0-9-]{10,})"


def camel_split(c: Column) -> Column:
    """Blanks at the borders of camel case: ``HTTPServer2go`` -> ``HTTP Server2go``."""
    c = F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.regexp_replace(c, r"([A-Z]+)([A-Z][a-z])", "$1 $2")


def digit_split(c: Column) -> Column:
    c = F.regexp_replace(c, r"([A-Za-z])([0-9])", "$1 $2")
    return F.regexp_replace(c, r"([0-9])([A-Za-z])", "$1 $2")


def _nonempty(tokens: Column) -> Column:
    return F.filter(tokens, lambda x: x != "")


def symbol_tokens(c: Column) -> Column:
    """Chunks of letters and digits in lower case, then the parts of chunks that have several; null gives none."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9]+", " ")
    chunks = _nonempty(F.split(plain, " "))
    parts = F.flatten(F.transform(chunks, lambda x: F.transform(F.filter(F.array(_nonempty(F.split(digit_split(camel_split(x)), " "))), lambda y: F.size(y) >= 2), lambda y: F.array_join(y, " "))))
    return F.transform(F.concat(chunks, F.flatten(F.transform(parts, lambda x: F.split(x, " ")))), lambda x: F.lower(x))


def identifier_parts(c: Column) -> Column:
    """Identifier split for reranking: separators and camel case, no split between letters and digits."""
    return _nonempty(F.split(F.lower(F.regexp_replace(camel_split(F.coalesce(c, F.lit(""))), r"[_./\-\s]+", " ")), " "))


def query_tokens(c: Column) -> Column:
    """Words of a query without punctuation round them; under three bytes they are dropped."""
    words = F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+")
    bare = F.transform(words, lambda x: F.regexp_replace(x, r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""))
    return F.filter(bare, lambda x: F.octet_length(x) >= 3)


def redact(c: Column) -> Column:
    """API keys, bearer tokens, passwords in URLs (any ``@`` in them included) and assignments to secrets' names, hidden; null stays."""
    for pattern, kept in ((HIDE_KEY, HIDDEN), (HIDE_BEARER, "$1" + HIDDEN), (HIDE_URL_PASSWORD, f"$1{HIDDEN}$2"), (HIDE_ASSIGNED, "$1" + HIDDEN)):
        c = F.regexp_replace(c, pattern, kept)
    return c


def truncate_bytes(c: Column, n: int) -> Column:
    """At most n bytes of UTF-8, never inside a character."""
    cut = F.substring(F.encode(c, "UTF-8"), 1, n)
    kept = [F.substring(cut, 1, n - i) for i in range(4)]
    out = F.lit(None).cast("string")
    for k in reversed(kept):
        out = F.when(F.is_valid_utf8(k.cast("string")), k.cast("string")).otherwise(out)
    return F.when(F.octet_length(c) <= n, c).otherwise(out)


def stable_id(*columns: Column, length: int = 64) -> Column:
    """Hex SHA-256 of the parts joined by NUL; a null part counts as empty."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, length)


def canonical_url(c: Column) -> Column:
    """host/owner/name of a git URL in any spelling."""
    c = F.regexp_replace(F.trim(c), r"^(?:[a-z+]+://)?(?:[^@/]+@)?", "")
    c = F.regexp_replace(c, r"^([^/:]+):(?:\d+/)?", "$1/")
    return F.lower(F.regexp_replace(c, r"(?:\.git)?/*$", ""))


def token_estimate(row: Column) -> Column:
    return F.floor(F.octet_length(F.to_json(row)) / 4).cast("long")


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))
