"""Generated, minified, third-party and data files among source code, by layout statistics.

Every file is read once, whole.  Thresholds on layout, tuned for each language (longest and
mean line, white space, letters and digits, number density of literals and of serially
numbered names, encoded runs), tell minified, data and unmarked generated files.  Layout
can't tell generated or third-party code that is laid out like hand-written code: its
leading comment, its path or a hint does.  Unmarked third-party copies are files whose
five-word shingles are to 0.8 or more among those of one marked third-party package.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codelattice.operators.references import orphan_rows
from codelattice.plans.materialize import Workspace

SHINGLE, SIMILAR = 5, 0.8
#: Directories that hold dependencies, in lower case, by convention of package managers.
VENDOR = frozenset("vendor node_modules godeps _vendor third_party thirdparty third-party bower_components external extern deps jspm_packages site-packages carthage pods".split())
#: Per language: share of the text in packed lines, in data lines, of digits, and of names
#: that are serially numbered.  Dense text has lines of at least ``mean_line`` on average and
#: ``longest`` at most, and no more than ``blanks`` of white space; up to ``alnum`` letters
#: and digits it is minified code, wrapped or not, from ``encoded`` on it is encoded data.
#: Go and TypeScript lie half way between the outer 0.2 % of the hand-written and the
#: outer 2 % of the other files of the test tables at 0.1; JavaScript and Python, of which
#: there is too little, follow their usual layout (Python: indented, at most 100 columns).
THRESHOLDS = {
    "default": {"packed": 0.50, "data": 0.65, "digits": 0.22, "numbered": 0.10, "mean_line": 60, "longest": 80, "blanks": 0.07, "alnum": 0.70, "encoded": 0.90},
    "go": {"packed": 0.50, "data": 0.65, "digits": 0.18, "numbered": 0.08, "mean_line": 55, "longest": 70, "blanks": 0.08, "alnum": 0.74, "encoded": 0.88},
    "typescript": {"packed": 0.45, "data": 0.65, "digits": 0.24, "numbered": 0.11, "mean_line": 50, "longest": 60, "blanks": 0.08, "alnum": 0.72, "encoded": 0.88},
    "javascript": {"packed": 0.40, "data": 0.65, "digits": 0.24, "numbered": 0.11, "mean_line": 50, "longest": 60, "blanks": 0.09, "alnum": 0.72, "encoded": 0.88},
    "python": {"packed": 0.40, "data": 0.65, "digits": 0.20, "numbered": 0.09, "mean_line": 50, "longest": 70, "blanks": 0.10, "alnum": 0.74, "encoded": 0.86},
}
#: A body of fewer characters is dense only with lines this long, and data only if so much of it is in data lines: one constant is no data file.
SHORT, SHORT_LINE, SHORT_DATA = 200, 100, 0.90
#: A packed line has at least so many characters, at most this share of blanks and at least this share of operators.
PACKED_LENGTH, PACKED_BLANKS, PACKED_SIGNS = 300, 0.10, 0.15

_EXTENSION = {"go": "go", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python"}
_COMMENT = re.compile(r"\s*(?:/\*.*?(?:\*/|\Z)|//[^\n]*|#(?!include|define)[^\n]*|<!--.*?-->|\s+)", re.S)
_PREAMBLE = re.compile(r"\s*(?:package\s+\w+;?|[\"']use strict[\"'];?)[ \t]*(?=\n|\Z)")
#: A mark by itself; else a mark names an origin (something made the file) and a consequence (what editing it leads to, or how to make it anew).
_TAG = re.compile(r"@generated\b|\bauto-?generated\b|<auto-generated|\bmachine[- ](?:made|generated|written)\b|\bcode generated (?:by|from)\b|\b(?:generated|produced|created|written|made|built|emitted) automatically\b|\bautomatically (?:generated|produced|created|written|made|built|emitted)\b", re.I)
_ORIGIN = re.compile(r"\b(?:generated|produced|emitted|compiled)\b[^.\n]{0,60}?\b(?:by|from|with)\b|\b(?:written|created|made|built) (?:by|with) (?:the |a )?\S+ (?:tool|generator|compiler|script|plugin|task|job)\b", re.I)
_CONSEQUENCE = re.compile(r"\b(?:do not|don't|never|instead of)\b.{0,30}\b(?:edit|modify|touch)(?:ing)?\b.{0,20}\b(?:this|file|output|hand|it|here)\b|\b(?:changes|edits)\b.{0,40}\b(?:lost|overwritten|discarded)\b|\b(?:re-?run|run it again|regenerate|re-?create)\b", re.I | re.S)
_DO_NOT_EDIT = re.compile(r"\bdo not edit\b|\b(?:do not|don't|never) modify by hand\b", re.I)
_NOT_GENERATED = re.compile(r"\bnot (?:auto-?)?generated\b|\bused to be \w+\b|\bkept by hand\b|\bedit (?:freely|it as usual)\b|\bgenerated \w+ call\b", re.I)
_BUNDLE = re.compile(r"\A/\*!.*\bbundle\b", re.I | re.S)
#: Who holds the rights, under which terms it may be passed on, or where it was taken from.
_NOTICE = re.compile(
    r"\bcopyright\b|\(c\) ?\d{4}|©|\ball rights reserved\b|\bSPDX-License|\bpermission (?:to use|is hereby)\b|\blicen[cs]ed under\b|\b(?:free|open|same|public|permissive) (?:\w+ )?(?:licen[cs]es?|terms)\b|"
    r"\bthis file is part of\b|\b(?:taken over|taken|copied|adapted|vendored|imported|ported) from\b|\bcontributors of\b|\bupstream (?:project|source|version)\b",
    re.I,
)
_NUMBERED = re.compile(r"\b([A-Za-z_]{2,}?)(\d+)\b")
_NAME = re.compile(r"\b[A-Za-z_]\w*\b")
_RUN = re.compile(r"[A-Za-z0-9+/=_-]{40,}")
_STRINGS = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`")
_WORD = re.compile(r"[^\W_]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_SIGN = str.maketrans("", "", "".join(chr(c) for c in range(128) if chr(c) not in "(){}[];,=?:!&|.<>+-*/"))


def clean(content: str | None) -> str:
    """Without byte-order mark and with plain line ends."""
    return (content or "").lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")


def heading(text: str) -> tuple[str, str]:
    """The leading comments (also those behind a package line) and the rest of the text."""
    at, found, preamble = 0, [], ""
    while at < len(text):
        m = _COMMENT.match(text, at)
        if m and m.end() > at:
            found.append(m[0])
            at = m.end()
            continue
        m = None if preamble else _PREAMBLE.match(text, at)
        if not m:
            break
        preamble, at = m[0], m.end()
    return "".join(found), preamble + "\n" + text[at:]


def lead_lines(text: str, n: int = 12) -> str:
    """Comment lines among the first lines, wherever they stand between code lines."""
    return "\n".join(x for x in text.split("\n", n)[:n] if x.lstrip()[:2] in ("//", "/*", "* ", "*\t") or x.lstrip()[:1] in ("#", "*"))


def layout(text: str) -> dict[str, float]:
    """Layout statistics of a whole text."""
    n = max(1, len(text))
    lines = text.split("\n")
    packed = data = 0
    longest = max(map(len, lines))
    for x in lines:
        s = x.strip()
        if not s:
            continue
        if len(x) >= PACKED_LENGTH:
            blanks = sum(map(str.isspace, x)) / len(x)
            signs = len(x.translate(_SIGN)) / len(x)
            run = _RUN.search(x)
            if run and len(max(_RUN.findall(x), key=len)) >= 0.5 * len(x):
                data += len(x) + 1
            elif blanks <= PACKED_BLANKS and signs >= PACKED_SIGNS:
                packed += len(x) + 1
        elif _is_data(s):
            data += len(x) + 1
    digits = sum(map(str.isdigit, text))
    names = _NAME.findall(text)
    stems: dict[str, set[int]] = {}
    for stem, k in _NUMBERED.findall(text):
        if len(k) < 7:
            stems.setdefault(stem.lower(), set()).add(int(k))
    serial = {s for s, ks in stems.items() if len(ks) >= 12 and max(ks) - min(ks) < 3 * len(ks)}
    numbered = sum(1 for x in names if x.rstrip("0123456789").lower() in serial and x[-1].isdigit())
    return {
        "longest": longest, "mean_line": n / len(lines), "blanks": sum(map(str.isspace, text)) / n, "alnum": sum(map(str.isalnum, text)) / n,
        "digits": digits / n, "packed": packed / n, "data": data / n, "numbered": numbered / max(1, len(names)),
    }


def _is_data(s: str) -> bool:
    """A line that holds only literals: numbers, strings, brackets, commas, or one encoded run."""
    if _RUN.fullmatch(s.strip("\"'`,+ ()")):
        return True
    if not any(c.isdigit() for c in s) and '"' not in s and "'" not in s:
        return False
    rest = _STRINGS.sub("", s)
    rest = re.sub(r"\b(?:0[xX][0-9a-fA-F]+|\d[\d_.]*(?:[eE][+-]?\d+)?|true|false|null|nil)\b", "", rest)
    return len(s) >= 12 and not re.search(r"[A-Za-z_]", rest)


def marked_generated(marks: str) -> bool:
    """Does a heading say that something else than a hand made the file?"""
    if _NOT_GENERATED.search(marks):
        return False
    return bool(_TAG.search(marks) or _DO_NOT_EDIT.search(marks) or (_ORIGIN.search(marks) and _CONSEQUENCE.search(marks)))


def foreign_notice(head: str, owners: tuple[str, ...]) -> bool:
    """Does a heading hold rights or terms of somebody who is none of the ``owners``?"""
    return bool(_NOTICE.search(head)) and not any(x.lower() in head.lower() for x in owners)


def by_layout(path: str, language: str | None, body: str) -> str | None:
    """What the layout statistics of a body say: minified, data, generated or nothing."""
    if not body.strip():
        return None
    name = (path or "").rsplit("/", 1)[-1]
    kind = language or _EXTENSION.get(name.rsplit(".", 1)[-1].lower(), "default")
    limit = THRESHOLDS.get(str(kind).lower(), THRESHOLDS["default"])
    x = layout(body.strip("\n"))
    short = len(body.strip()) < SHORT
    if x["packed"] >= limit["packed"]:
        return "minified"
    if x["data"] >= (SHORT_DATA if short else limit["data"]) or (x["digits"] >= limit["digits"] and not short):
        return "data"
    if x["mean_line"] >= (SHORT_LINE if short else limit["mean_line"]) and x["longest"] >= limit["longest"] and x["blanks"] <= limit["blanks"]:
        if x["alnum"] <= limit["alnum"]:
            return "minified"
        if x["alnum"] >= limit["encoded"]:
            return "data"
    return "generated" if x["numbered"] >= limit["numbered"] else None


def verdict(path: str, language: str | None, content: str | None, external: bool, owners: tuple[str, ...] = ()) -> tuple[str | None, str, str]:
    """(reason or None, body without its heading, heading); layout decides first, except what is third-party whatever its layout."""
    text = clean(content)
    head, body = heading(text)
    segments = {s.lower() for s in (path or "").split("/")[:-1]}
    if external or segments & VENDOR or foreign_notice(head, owners):
        return "third-party", body, head
    reason = by_layout(path, language, body)
    if reason is None and _BUNDLE.match(text):
        reason = "minified"
    if reason is None and marked_generated(head + "\n" + lead_lines(text)):
        reason = "generated"
    return reason, body, head


def origin(path: str, head: str) -> str:
    """Which package a third-party file belongs to: the name below a dependency directory, else the words of its notice, else its folder."""
    parts = (path or "").split("/")
    for i in range(len(parts) - 2, -1, -1):
        if parts[i].lower() in VENDOR and i + 1 < len(parts) - 1:
            return "package " + parts[i + 1].lower()
    words = _LETTERS.findall(head.lower())
    return "notice " + " ".join(words) if words else "folder " + "/".join(parts[:-1])


_BASE = np.uint64(0x9E3779B97F4A7C15)


def fingerprints(body: str) -> list[int]:
    """Distinct hashes of all five-word shingles; a body of fewer words has one, of the whole."""
    w = _WORD.findall(body)
    if not w:
        return []
    code = np.array([zlib.crc32(x.encode("utf-8", "replace")) for x in w], np.uint64)
    n = max(1, len(w) - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(min(SHINGLE, len(w))):
            h = h * _BASE + code[j : j + n]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h).view(np.int64).tolist()


def not_handwritten(files: DataFrame, nodes: DataFrame | None = None, similar: float = SIMILAR, owners: tuple[str, ...] = ()) -> DataFrame:
    """``(repo_id, file_path, reason)``: generated, minified, third-party or data files, one row a file.

    ``files`` (repo_id, file_path, language, content), ``nodes`` (repo_id, file_path,
    external) as a hint: true marks a dependency, false and null say nothing.  A notice of
    one of the ``owners`` marks no third party.  A file that stands on several branches is
    a case if one of its contents is.  A null or empty content has no layout: only its path
    and the hint can make it a case.  Repeated rows count once; a null path is an empty one;
    further columns are not read.
    """
    work = Workspace(files.sparkSession, "handwritten")
    rows = files.select("repo_id", "file_path", F.col("language").cast("string").alias("language"), F.col("content").cast("string").alias("content"))
    if nodes is not None:
        hint = nodes.where("external AND lower(kind) NOT IN ('package', 'module')").select("repo_id", "file_path").distinct().withColumn("external", F.lit(True))
        rows = rows.join(hint, ["repo_id", "file_path"], "left")
    else:
        rows = rows.withColumn("external", F.lit(None).cast("boolean"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            reasons, bodies, prints, origins = [], [], [], []
            for path, lang, content, ext in zip(*(b.column(c).to_pylist() for c in ("file_path", "language", "content", "external")), strict=True):
                reason, body, head = verdict(path, lang, content, bool(ext), owners)
                words = " ".join(_WORD.findall(body))
                reasons.append(reason)
                bodies.append(hashlib.blake2b(words.encode("utf-8", "replace"), digest_size=16).hexdigest())
                # a bare package line is no code that could be copied
                prints.append(fingerprints(body) if reason in (None, "third-party") and not _PREAMBLE.fullmatch(body.strip()) else [])
                origins.append(zlib.crc32(origin(path, head).encode("utf-8", "replace")) if reason == "third-party" else None)
            out = [pa.array(reasons, pa.string()), pa.array(bodies, pa.string()), pa.array(prints, pa.list_(pa.int64())), pa.array(origins, pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("repo_id"), b.column("file_path"), *out], ["repo_id", "file_path", "reason", "body", "prints", "origin"])

    seen = work.write(rows.mapInArrow(run, "repo_id string, file_path string, reason string, body string, prints array<long>, origin long"), "verdicts")
    # equal bodies are one class; a class has its fingerprints once, however often it is copied
    size = F.size("prints")
    known = seen.where(F.col("reason").isNull() & (size > 0)).groupBy("body").agg(F.first("prints").alias("prints"))
    marked = seen.where((F.col("reason") == "third-party") & (size > 0)).groupBy("body", "origin").agg(F.first("prints").alias("prints"))
    owned = work.write(marked.select(F.explode("prints").alias("fp"), "origin").distinct(), "owned")
    third = work.write(owned.groupBy("fp").agg(F.count(F.lit(1)).alias("origins")), "third")
    # a copy may miss ``spare`` shingles, so it misses no more of any part of them: a part
    # larger than that is looked up first, the rest only of bodies that may still be copies
    spare = (size - F.ceil(similar * size)).cast("int")
    part = F.least(size, spare + F.ceil(size / 10).cast("int"))
    classes = work.write(known.select("body", "prints", spare.alias("spare"), part.alias("part")), "classes")

    def lacking(prints: DataFrame, name: str) -> DataFrame:
        return orphan_rows(prints, ["fp"], third).groupBy("body").agg(F.count(F.lit(1)).alias(name))

    first = work.write(classes.select("body", F.explode(F.slice("prints", F.lit(1), F.col("part"))).alias("fp")), "first")
    maybe = classes.join(lacking(first, "missed"), "body", "left").where(F.coalesce("missed", F.lit(0)) <= F.col("spare")).withColumn("left", F.col("spare") - F.coalesce("missed", F.lit(0)))
    maybe = work.write(maybe.select("body", "left", "spare", "prints", "part"), "maybe")
    rest = work.write(maybe.select("body", F.explode(F.slice("prints", F.col("part") + 1, size)).alias("fp")), "rest")
    maybe = maybe.join(lacking(rest, "missing"), "body", "left").where(F.coalesce("missing", F.lit(0)) <= F.col("left"))
    maybe = work.write(maybe.select("body", "prints", "spare"), "covered")
    copies = _of_one_origin(maybe, owned, third).select("body", F.lit("third-party").alias("copied"))
    out = seen.select("repo_id", "file_path", "reason", "body").join(copies, "body", "left").select("repo_id", "file_path", F.coalesce("reason", "copied").alias("reason"))
    return out.where("reason IS NOT NULL").groupBy("repo_id", "file_path").agg(F.min("reason").alias("reason"))


def _of_one_origin(bodies: DataFrame, owned: DataFrame, third: DataFrame) -> DataFrame:
    """Bodies (body, prints, spare) that lack at most ``spare`` shingles of some single origin: idioms common to many packages make no copy.

    One of a body's ``spare`` + 1 rarest shingles must be the origin's, so only those look
    for origins; what they find is counted in full.
    """
    each = bodies.select("body", "spare", F.explode("prints").alias("fp"))
    held = each.join(third, "fp").groupBy("body", "spare").agg(F.array_sort(F.collect_list(F.struct("origins", "fp"))).alias("held"))
    lost = bodies.select("body", F.size("prints").alias("n"))
    rare = held.join(lost, "body").select("body", F.explode(F.slice("held", F.lit(1), F.col("spare") + 1 - (F.col("n") - F.size("held")))).alias("h")).select("body", F.col("h.fp").alias("fp"))
    pairs = rare.join(owned, "fp").select("body", "origin").distinct()
    hits = pairs.join(bodies.select("body", "spare", "prints"), "body").select("body", "origin", "spare", F.size("prints").alias("n"), F.explode("prints").alias("fp")).join(owned, ["fp", "origin"], "left_semi")
    return hits.groupBy("body", "origin", "spare", "n").agg(F.count(F.lit(1)).alias("k")).where("k >= n - spare").select("body").distinct()
