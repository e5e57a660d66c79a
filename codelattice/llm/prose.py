"""Running prose of a text, its language, and measures of how hard it reads."""

from __future__ import annotations

import html
import re

import numpy as np

_FENCE = re.compile(r"^[ \t>]*(?:```|~~~).*?(?:^[ \t>]*(?:```|~~~)[ \t]*$|\Z)", re.M | re.S)
_PRE = re.compile(r"<(pre|code|script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_TAG = re.compile(r"</?[A-Za-z!][^<>]{0,300}>")
_BREAK = re.compile(r"</?(?:p|br|div|li|h\d|tr|td|ul|ol|blockquote)\b[^<>]{0,300}>", re.I)
_QUOTE = re.compile(r"^[ \t]*(?:>[ \t]?)+")
#: Lines that aren't prose: headings, lists, tables, logs, JSON, traces, rules, short key: value lines.
_NOT_PROSE = re.compile(
    r"(?:\s{4,}\S|\t|#|[-*+•][ \t]|\d+[.)][ \t]|\||\[|\{|\}|\d{4}-\d\d-\d\d|\d\d:\d\d:\d\d|at [\w.$/<>]+\(|File \"|Traceback|goroutine |panic:|\$ |@@ |diff |(?:[A-Z]\w*|[a-z]+):[ \t]?\S{0,40}$|[=\-*_]{3,}\s*$|[a-z]+(?:\([\w/ -]*\))?!?: )"
)
_OPENERS = ("func ", "return ", "import ", "const ", "let ", "var ", "class ", "def ", "if ", "for ", "package ", "export ", "type ")
_SIGNS = (":=", "==", "=>", "!=", "</")
_CALL = re.compile(r"\w\(\w*\)|\w\.\w+\(")
_OPENED = re.compile(r"[({=;:]")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?]+|,|\x00")
_VOWELS = re.compile(r"[aeiouy]+")


def _is_code(line: str) -> bool:
    end = line.rstrip()[-1:]
    if end in "{};" or any(x in line for x in _SIGNS):
        return True
    if "(" in line and _CALL.search(line):
        return True
    lead = line.lstrip()
    return lead.startswith(_OPENERS) and _OPENED.search(lead) is not None


#: Frequent function words of four languages, and joining words of English.
FUNCTION_WORDS = {
    "en": frozenset("the of and to in is that it for on with as was be by this are or an at from not have has no each you can they we my then but so when while which its".split()),
    "de": frozenset("der die das und ist nicht ein eine zu den von mit sich auf für es im dem wird auch wir aber nur jede jeder kein keine dann oder wenn sie".split()),
    "es": frozenset("el la los las de que y en un una es no se por con para del al lo como pero cada este esta ya cuando son su más".split()),
    "fr": frozenset("le la les des de et un une est pas que pour dans ce cette il elle on ne sur avec au aux du mais chaque quand son plus nous se".split()),
}
COORDINATORS = frozenset("and but or so yet nor".split())
SUBORDINATORS = frozenset("because although though until unless when while before after since whereas whether that which notwithstanding provided".split())
PRONOUNS = frozenset("i you he she it we they me him her us them my your his our their this that these those".split())


def running(text: str | None) -> str:
    """The running prose of a text in lower case, a NUL after each block.

    Fenced and preformatted code, headings, lists, tables, logs, JSON, traces and lines that
    look like code are left out; quote marks, tags and entities are taken off.
    """
    if not text:
        return ""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "`" in text or "~~~" in text:
        text = _FENCE.sub("\n\n", text)
    if "<" in text:
        text = _TAG.sub(" ", _BREAK.sub("\n", _PRE.sub("\n", text)))
    if "&" in text:
        text = html.unescape(text)
    kept = []
    for line in text.split("\n"):
        if line[:8].lstrip()[:1] == ">":
            line = _QUOTE.sub("", line)
        if not line or line.isspace() or _NOT_PROSE.match(line) or _is_code(line):
            kept.append("\0")
        else:
            kept.append(line)
    return " ".join(kept).lower() + " \0"


def syllables(word: str) -> int:
    n = len(_VOWELS.findall(word))
    if word.endswith("e") and not word.endswith("le") and n > 1:
        n -= 1
    return max(1, n)


LANGUAGES = tuple(FUNCTION_WORDS)
_COMMA, _STOP, _BLOCK = 0, 1, 2


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers: for these sizes a sort is quicker than hashing."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _per_group(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, order_key: np.ndarray, *qs: float) -> list[np.ndarray]:
    """Nearest-rank quantiles of each group; ``order_key`` is each value's group."""
    v = values[np.lexsort((values, order_key))]
    return [v[starts + np.minimum(sizes - 1, (q * sizes).astype(np.int64))] for q in qs]


class Measures:
    """Reading measures of whole batches of texts; each word's numbers are worked out once.

    Sentences under three words, and unclosed ones under eight, are no running prose.
    """

    NAMES = (
        "words sentences sent_mean sent_sd sent_p10 sent_p50 sent_p90 sent_max word_mean word_sd word_p50 word_p90 long7 long10 long13 syll_mean syll3 syll5 "
        "distinct common coordinators subordinators joiners_per_sentence pronouns commas kincaid ari hard_p10 hard_p50 hard_p90 easy_sentences hard_sentences "
        "overlap repeat_share kincaid_p10 kincaid_p50 kincaid_p90 kincaid_sd long_sentences joined_sentences"
    ).split()
    #: Distinct words remembered between batches; beyond, the memory starts anew.
    REMEMBER = 300_000

    def __init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        self.number = {",": _COMMA, "\0": _BLOCK}
        self.rows: list[tuple] = [(0,) * (6 + len(LANGUAGES))] * 3

    def _new(self, w: str) -> int:
        if w[0] in ".!?":
            self.number[w] = _STOP
            return _STOP
        at = self.number[w] = len(self.rows)
        self.rows.append((len(w), syllables(w), w in FUNCTION_WORDS["en"], w in COORDINATORS, w in SUBORDINATORS, w in PRONOUNS, *(w in FUNCTION_WORDS[k] for k in LANGUAGES)))
        return at

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words of prose, function words of each language, measures) of each text; measures of empty ones are 0."""
        if len(self.rows) > self.REMEMBER:
            self._forget()
        get, new = self.number.get, self._new
        flat: list[int] = []
        ends = []
        for t in texts:
            flat += [i if (i := get(w)) is not None else new(w) for w in _TOKEN.findall(running(t))]
            ends.append(len(flat))
        m = len(texts)
        ids = np.array(flat, np.int64)
        doc = np.repeat(np.arange(m), np.diff(np.array([0, *ends])))
        table = np.array(self.rows, np.float32)
        stop = (ids == _STOP) | (ids == _BLOCK)
        # the sentence of each token: a stop belongs to the one it ends
        sent = np.cumsum(stop) - stop
        k = int(sent[-1]) + 1 if len(sent) else 0
        word = ids > _BLOCK
        size = np.bincount(sent[word], minlength=k)
        closed = np.zeros(k, bool)
        closed[sent[ids == _STOP]] = True
        good = (size >= 3) & (closed | (size >= 8))
        comma_s, comma_d = sent[ids == _COMMA], doc[ids == _COMMA]
        commas = np.bincount(comma_d[good[comma_s]], minlength=m) if k else np.zeros(m)
        keep = word & good[sent] if k else word
        ids, doc, sent = ids[keep], doc[keep], sent[keep]
        n = np.bincount(doc, minlength=m)
        langs = np.stack([np.bincount(doc, weights=table[ids, 6 + j], minlength=m) for j in range(len(LANGUAGES))], axis=1)
        out = np.zeros((m, len(self.NAMES)))
        if not len(ids):
            return n, langs, out
        # compact numbers of the documents and sentences that have words
        own = np.flatnonzero(n)
        d = (np.cumsum(n > 0) - 1)[doc]
        n1 = n[own]
        start = np.append(0, np.cumsum(n1)[:-1])
        s_first = np.append(True, sent[1:] != sent[:-1])
        s_start = np.flatnonzero(s_first)
        s_size = np.diff(np.append(s_start, len(ids)))
        s_doc = d[s_start]
        s_n = np.bincount(s_doc, minlength=len(own))
        ds = np.append(0, np.cumsum(s_n)[:-1])
        length, syll, common, coord, sub, pron = (table[ids, j].astype(np.float64) for j in range(6))
        mean = lambda x: np.add.reduceat(x, start) / n1
        smean = lambda x: np.add.reduceat(x, ds) / s_n
        sd = lambda f, x: np.sqrt(np.maximum(0, f(x * x) - f(x) ** 2))
        per = lambda x: np.add.reduceat(x, s_start) / s_size
        size = s_size.astype(np.float64)
        hard = per(length)
        kin = 0.39 * size + 11.8 * per(syll) - 15.59
        joins = np.add.reduceat(coord + sub, s_start)
        v = len(self.rows)
        distinct = np.bincount(_distinct(d * v + ids) // v, minlength=len(own))
        sn = np.cumsum(s_first) - 1
        content = common == 0
        pairs = _distinct(sn[content] * v + ids[content])
        pair_s = pairs // v
        pair_doc = s_doc[pair_s]
        after = pairs + v
        at = np.minimum(np.searchsorted(pairs, after), max(0, len(pairs) - 1))
        shared = (pairs[at] == after) & (s_doc[np.minimum(pair_s + 1, len(s_doc) - 1)] == pair_doc) if len(pairs) else np.zeros(0, bool)
        n_pairs = np.bincount(pair_doc, minlength=len(own))
        n_content = np.bincount(d[content], minlength=len(own))
        wm, ym, sm = mean(length), mean(syll), n1 / s_n
        out[own] = np.stack([
            np.log1p(n1), np.log1p(s_n), sm, sd(smean, size), *_per_group(size, ds, s_n, s_doc, 0.1, 0.5, 0.9), np.maximum.reduceat(size, ds),
            wm, sd(mean, length), *_per_group(length, start, n1, d, 0.5, 0.9),
            mean(length >= 7), mean(length >= 10), mean(length >= 13), ym, mean(syll >= 3), mean(syll >= 5),
            distinct / n1**0.7, mean(common), mean(coord), mean(sub), (mean(coord) + mean(sub)) * sm, mean(pron), commas[own] / s_n,
            0.39 * sm + 11.8 * ym - 15.59, 4.71 * wm + 0.5 * sm - 21.43, *_per_group(hard, ds, s_n, s_doc, 0.1, 0.5, 0.9), smean(hard < 4.2), smean(hard > 7),
            np.bincount(pair_doc[shared], minlength=len(own)) / np.maximum(1, n_pairs), n_pairs / np.maximum(1, n_content),
            *_per_group(kin, ds, s_n, s_doc, 0.1, 0.5, 0.9), sd(smean, kin), smean(size > 18), smean(joins >= 2),
        ], axis=1)
        return n, langs, out


def language(counts: np.ndarray, n: int, noted: str | None) -> str | None:
    """Language by the function words of the prose; the noted one (any case, any region) where they don't tell."""
    noted = (noted or "").strip().lower().replace("_", "-").split("-")[0] or None
    if n < 15:
        return noted
    order = np.argsort(-counts)
    best, second = counts[order[0]], counts[order[1]]
    if best >= 0.08 * n and best >= 1.3 * second:
        return LANGUAGES[order[0]]
    return noted or (LANGUAGES[order[0]] if best else None)
