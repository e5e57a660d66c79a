"""Words of a text without regard to letter case, punctuation, markup and line layout."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_TAG = re.compile(r"</?[A-Za-z!][^<>]{0,300}>")
_GUTTER = re.compile(r"(?m)^[ \t>+\-|#*/]*\d{1,5}[ \t]*[|:\t][ \t]")
_LINK = re.compile(r"\]\(\s*[^()\s]*\s*\)")
_ESCAPE = re.compile(r"\\+(?:[nrtbf](?![a-z])|u00[0-9a-f]{2}|[\"'/\\])|\\+[nrt]")
_HYPHEN = re.compile("(?<=[^\\W\\d_])(?:\u00ad|[-\u2010]\r?\n[ \t>+*#|/]*)(?=[^\\W\\d_])|[\u200b\u200c\u200d\u2060\ufeff]")
WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """The text in lower case, with tags, entities, escapes, link targets and line numbers taken out."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "](" in text:
        text = _LINK.sub("] ", text)
    if "\\" in text:
        text = _ESCAPE.sub(" ", text)
    if "-\n" in text or "-\r" in text or not text.isascii():
        text = _HYPHEN.sub("", text)
    if "|" in text or ":" in text or "\t" in text:
        text = _GUTTER.sub(" ", text)
    return text.lower()


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``limit`` bytes of text, at least one row each: long texts don't add up."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("int64")
    part = (size.cumsum() - size) // limit
    at = 0
    while at < batch.num_rows:
        end = int(part.searchsorted(part[at], side="right"))
        yield batch.slice(at, end - at)
        at = end


def words(text: str | None) -> list[str]:
    return WORD.findall(plain(text)) if text else []


def coded(texts: list[str | None], vocabulary: dict[str, int]):
    """All texts' words as one array of vocabulary numbers (0: not in it), and where each text ends."""
    get, flat, ends, n = vocabulary.get, [], [], 0
    for t in texts:
        w = words(t)
        n += len(w)
        ends.append(n)
        flat.append([get(x, 0) for x in w])
    return np.fromiter(chain.from_iterable(flat), np.int64, n), np.array(ends, np.int64)
