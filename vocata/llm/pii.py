"""Personal information inside free text, found by a linear-chain CRF and replaced.

Words, numbers and signs are labelled begin / inside / outside of five types. Features
are word shapes, affixes and identities of the token, of its neighbours and of the chunks
(runs of non-spaces) around it. The model is trained from a small labelled table that
:func:`.pii_table.labelled_lines` writes from neutral patterns in six languages.
Decoding is Viterbi in numpy batches over the runs of tokens that can hold anything: a
token is skipped only if an upper bound on the score of every span that could touch it
shows that staying outside wins, so the result is that of decoding everything.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .pii_table import labelled_lines

TYPES = ("email", "phone", "id_number", "address", "name")
LABELS = ("O", *(f"{p}-{t}" for t in TYPES for p in "BI"))
#: Rows taken from each filler table for training, and training documents written.
SAMPLE_ROWS, TRAINING_DOCS = 2000, 3200
#: Share of the words whose spelling is hidden in training.
HIDDEN = 0.15
_SPACE = r"[^\S\r\n\x0b\x0c\x85\u2028\u2029]"
_TOKEN = re.compile(rf"{_SPACE}*(?:\r\n|[\r\n\x0b\x0c\x85\u2028\u2029]|[^\W\d_]+|\d+|\S)")
_BREAK = "\r\n\x0b\x0c\x85\u2028\u2029"
_EDGE, _FLAGS, _VEIL = "\x00edge", "\x00flag", "\x00veil"


def form_features(form: str) -> list[str]:
    """Features of a token as it stands in the text, with the spaces before it."""
    if form.startswith(_VEIL):  # a word of which only the shape is seen
        return [f for f in form_features(form[len(_VEIL) :]) if f[:2] not in ("w=", "e=", "p=")]
    if form.startswith("\x00"):
        return [form]
    core = form.strip(" \t\xa0") if form[-1] in _BREAK else form.lstrip()
    gap = "s" if core != form else "n"
    if core[0] in _BREAK:
        return ["break"]
    if core.isdigit():
        n = min(len(core), 12)
        return ["b", f"gap={gap}", f"d={n}", f"d={n}{gap}", f"d={n}{core[0]}", "digits"]
    if core[0].isalpha():
        low = core.lower()
        shape = "X" if len(core) == 1 and core.isupper() else "XX" if core.isupper() else "Xx" if core[0].isupper() and core[1:].islower() else "x" if core.islower() else "xX"
        return ["b", f"gap={gap}", f"w={low}", f"sh={shape}", f"sh={shape}{gap}", f"e={low[-3:]}", f"p={low[:3]}", f"l={min(len(core), 9)}{shape}"]
    return ["b", f"gap={gap}", f"c={core}", f"c={core}{gap}"]


class Forms:
    """Numbers of the distinct token spellings met so far; numbers share a form by length and first digits."""

    def __init__(self):
        self.code: dict[str, int] = {}
        self.keys: list[str] = []
        for k in (_EDGE, *(f"{_FLAGS}{i}" for i in range(16))):
            self.add(k)

    def add(self, tok: str) -> int:
        core = tok.lstrip()
        key = (tok[: len(tok) - len(core)][:1] + core[:1] + "0" * (len(core) - 1)) if core.isdigit() else tok
        i = self.code.get(key)
        if i is None:
            i = self.code[key] = len(self.keys)
            self.keys.append(key)
        if len(self.code) < 2_000_000:
            self.code[tok] = i
        return i

    def of(self, toks: list[str]) -> np.ndarray:
        codes = list(map(self.code.get, toks))
        if None in codes:
            codes = [self.add(t) if i is None else i for i, t in zip(codes, toks)]
        return np.array(codes, np.int32)


class Document:
    """Tokens of a batch of texts, one after the other with edges between, as arrays."""

    def __init__(self, texts: Sequence[str], forms: Forms, veil: Callable[[list[str]], list[str]] | None = None):
        toks: list[str] = []
        starts, edge = [], ["\x00edge"] * 4
        for t in texts:
            toks += edge
            starts.append(len(toks))
            toks += _TOKEN.findall(t)
        toks += edge
        self.form = forms.of(toks)
        seen = forms.of(veil(toks)) if veil else self.form
        n = len(toks)
        size = np.fromiter(map(len, toks), np.int64, n)
        self.inner = self.form != 0
        size[~self.inner] = 0
        self.end = np.cumsum(size)
        self.begin = self.end - size  # with the spaces before the token
        self.first = np.array(starts, np.int64)
        self.text_at = self.begin[self.first] if len(starts) else np.empty(0, np.int64)
        kind = np.array([_kind(k) for k in forms.keys], np.uint8)[self.form]
        self.line_end = (kind & 8 > 0) | ~self.inner
        # chunks: a new one at each token after a space or break, and at edges
        spaced = kind & 16 > 0
        head = spaced | self.line_end | np.r_[True, self.line_end[:-1]]
        self.head = np.flatnonzero(head)
        chunk = np.cumsum(head) - 1
        flags = np.bitwise_or.reduceat(kind & 7, self.head) if n else kind
        last = len(self.head) - 1
        heads = lambda d: seen[self.head[np.clip(chunk + d, 0, last)]]
        at = np.arange(n)
        own = [seen[np.clip(at + d, 0, n - 1)] for d in (0, -1, 1, -2, 2)]
        # the last two words before, on the same line, of chunks without digits: what a number is called
        word = np.where((kind & 4 > 0) & (flags[chunk] & 2 == 0), at, -1)
        before = np.r_[-1, np.maximum.accumulate(word)[:-1]]
        line = np.r_[-1, np.maximum.accumulate(np.where(self.line_end, at, -1))[:-1]]
        for _ in range(2):
            before = np.where(before > line, before, -1)
            own.append(np.where(before >= 0, seen[before], 0))
            before = np.where(before >= 0, np.r_[-1, np.maximum.accumulate(word)[:-1]][before], -1)
        flag = (flags[chunk] + 8 * head).astype(np.int32) + 1
        self.slots = np.stack([*own, flag, *(heads(d) for d in (1, 2, 3, 4, -1, -2, 0))])


def _kind(key: str) -> int:
    """Bits of a form: 1 at sign, 2 digit, 4 letter, 8 line break, 16 space before."""
    if key.startswith("\x00"):
        return 0
    core = key.lstrip(" \t\xa0") if key[-1] in _BREAK else key.lstrip()
    return (core == "@") | 2 * core[0].isdigit() | 4 * core[0].isalpha() | 8 * (core[0] in _BREAK) | 16 * (len(core) < len(key))


def train(names: Sequence[str], places: Sequence[str], phrases: Sequence[str], docs: int = TRAINING_DOCS, seed: int = 11, epochs: int = 4, held: bool | None = None, titles: Sequence[str] = (), firms: Sequence[str] = ()) -> crf.Model:
    """A model from :func:`.pii_table.labelled_lines`; the same arguments give the same model."""
    return _train(tuple(names), tuple(places), tuple(phrases), docs, seed, epochs, held, tuple(titles), tuple(firms))


@lru_cache(maxsize=4)
def _train(names, places, phrases, docs, seed, epochs, held, titles, firms) -> crf.Model:
    table = labelled_lines(names, places, phrases, docs, seed, held, titles, firms)
    forms, rng = Forms(), np.random.default_rng(seed)

    def veil(toks: list[str]) -> list[str]:
        """Hides the spelling of some words, so that shapes and surroundings are learned as well."""
        hide = rng.random(len(toks)) < HIDDEN
        return [_VEIL + t if h and t.lstrip()[:1].isalpha() else t for t, h in zip(toks, hide)]

    doc = Document(["".join(t for t, _ in runs) for runs in table], forms, veil)
    gold = np.zeros(len(doc.form), np.int64)
    lengths = np.zeros(len(table), np.int64)
    for i, runs in enumerate(table):
        at, first = int(doc.text_at[i]), int(doc.first[i])
        stop = int(doc.first[i + 1]) - 4 if i + 1 < len(table) else len(doc.form) - 4
        lengths[i] = stop - first
        for text, kind in runs:
            if kind:
                lo = int(np.searchsorted(doc.end[first:stop], at, side="right")) + first
                hi = int(np.searchsorted(doc.end[first:stop], at + len(text), side="left")) + first
                b = LABELS.index(f"B-{kind}")
                gold[lo], gold[lo + 1 : hi + 1] = b, b + 1
            at += len(text)
    closed = lambda a, b: b[0] == "I" and a[1:] != b[1:] or (b[0] == "I" and a == "O")
    return crf.train([form_features(k) for k in forms.keys], doc.slots, gold, doc.first, lengths, LABELS, closed, epochs=epochs, batches=24, outside=0, seed=seed)


class Finder:
    """Decodes texts with a model; keeps the score tables of the forms it met."""

    def __init__(self, model: crf.Model):
        self.model, self.forms = model, Forms()
        self.known = 0
        self.table = np.zeros((model.weights.shape[0], 0, len(LABELS)), np.float32)
        # what beginning, going on and ending a span of each type can add at most, against staying outside
        t, stay = model.trans, model.trans[0, 0]
        self.begin = t[:, 1::2].max(axis=0) - stay
        self.go_on = np.maximum(np.diag(t[1::2, 2::2]), np.diag(t[2::2, 2::2])) - stay
        ends = np.stack([t[1::2, 0], t[2::2, 0]]) - stay
        self.leave = np.maximum(0, ends.max(axis=0))
        self.slack = self.leave - np.minimum(0, ends.min(axis=0)) + 1e-3

    def emissions(self, doc: Document) -> np.ndarray:
        if len(self.forms.keys) > self.known:
            new = self.model.tables([form_features(k) for k in self.forms.keys[self.known :]])
            self.table = np.concatenate([self.table, new], axis=1)
            self.known = len(self.forms.keys)
        e = np.take(self.table[0], doc.slots[0], axis=0)
        more = np.empty_like(e)
        for s in range(1, len(doc.slots)):
            e += np.take(self.table[s], doc.slots[s], axis=0, out=more, mode="clip")
        return e

    def live(self, e: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """Tokens that a span of positive gain can touch.

        The most that a span begun at a token gains by going on is a maximum over suffix
        sums, found for all tokens at once. A span that gains nothing even so is not part of
        the best labelling, and a best span holds no token from which going on only loses.
        """
        d = (e[:, 1:] - e[:, :1]).astype(np.float64)
        d[~inner] = crf.FORBIDDEN
        on = d[:, 1::2] + self.go_on
        upto = on.cumsum(axis=0)
        ahead = np.maximum.accumulate(upto[::-1])[::-1] - upto + on  # best sum from here to any later token
        more = np.r_[np.maximum(0, ahead[1:]), np.zeros((1, on.shape[1]))]
        may = d[:, 0::2] + self.begin + more + self.leave + 1e-3 > 0
        stops = ahead < -self.slack
        at = np.arange(len(e), dtype=np.int32)[:, None]
        came = np.maximum.accumulate(np.where(may, at, -1))
        broke = np.maximum.accumulate(np.where(stops, at, 0))
        return (may | (~stops & (came >= broke))).any(axis=1) & inner

    def spans(self, texts: Sequence[str]) -> list[list[tuple[int, int, str]]]:
        """``(start, end, type)`` of the personal information in each text, in order."""
        if len(self.forms.keys) > 500_000:
            self.__init__(self.model)
        doc = Document(texts, self.forms)
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if not doc.inner.any():
            return out
        e = self.emissions(doc)
        active = self.live(e, doc.inner)
        if not active.any():
            return out
        starts = np.flatnonzero(active & ~np.r_[False, active[:-1]])
        lengths = np.flatnonzero(active & ~np.r_[active[1:], False]) + 1 - starts
        labels = np.zeros(len(doc.form), np.int8)
        m = self.model
        for b in crf.padded(lengths, 60_000):
            cells, index = crf.lay_out(e, starts[b], lengths[b])
            path = crf.viterbi(cells, lengths[b], m.trans, m.first, m.last)
            inside = np.arange(len(cells))[:, None] < lengths[b][None, :]
            labels[index[inside]] = path[inside]
        first = np.flatnonzero((labels > 0) & (labels % 2 == 1))
        if len(first):
            goes_on = np.r_[(labels[1:] > 0) & (labels[1:] % 2 == 0), False]
            stops = np.flatnonzero((labels > 0) & ~goes_on)
            final = stops[np.searchsorted(stops, first)]
            which = np.searchsorted(doc.first, first, side="right") - 1
            for i, j, d in zip(first, final, which):
                base = int(doc.text_at[d])
                lo, hi, kind = int(doc.begin[i]) - base, int(doc.end[j]) - base, TYPES[(labels[i] - 1) // 2]
                if span := tidy(texts[d], lo, hi, kind):
                    out[d].append((*span, kind))
        return out


_DIGIT = re.compile(r"\d")
_LETTERS = re.compile(r"[^\W\d_]+")


def tidy(text: str, lo: int, hi: int, kind: str) -> tuple[int, int] | None:
    """The decoded span without spaces and punctuation around it, or None if it cannot be of its type.

    An exact check after decoding: an email has an at sign or its word, a phone number 7 to
    15 digits, an id number 5 digits, an address a digit and a word, a name two words.
    """
    s = text[lo:hi]
    front = " \t\r\n\xa0.,;:|/<>[]{}\"'=-–•*" + (")" if kind == "phone" else "()")
    back = " \t\r\n\xa0.,;:|/<>[]{}\"'=-–•*()"
    a = len(s) - len(s.lstrip(front))
    b = len(s.rstrip(back))
    s = s[a:b]
    if kind == "email" and "<" in s:
        a, s = a + s.rindex("<") + 1, s[s.rindex("<") + 1 :]
    n = len(_DIGIT.findall(s))
    words = _LETTERS.findall(s)
    good = {
        "email": lambda: "@" in s or re.search(r"(?i)[\s(\[{]at[\s)\]}]", s) is not None,
        "phone": lambda: 7 <= n <= 15,
        "id_number": lambda: n >= 5,
        "address": lambda: n >= 1 and len(words) >= 1,
        "name": lambda: len(words) >= 2 and n == 0 and any(len(w) > 1 for w in words),
    }[kind]()
    return (lo + a, lo + b) if s and good else None


def _decode(model, text: str, out: Sequence[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(model.value)
        for pdf in batches:
            for at in range(0, len(pdf), 800):
                part = pdf.iloc[at : at + 800]
                found = finder.spans(part[text].tolist())
                yield part.assign(spans=[[{"start": a, "end": b, "pii_type": k} for a, b, k in x] for x in found])[list(out)]

    return run


def find_pii(df: DataFrame, keys: Sequence[str], text: str, model: crf.Model) -> DataFrame:
    """``(keys..., text, spans)`` with ``spans`` the array of ``(start, end, pii_type)`` in order.

    Positions are code points from 0. Null texts are left out; empty texts and texts
    without words have no spans. Only the keys and the text are read, so clashing names
    of other columns are harmless; a row delivered twice comes out twice.
    """
    rows = df.select(*keys, F.col(text).alias("_text")).filter("_text IS NOT NULL")
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size: it grows with the training table alone
    kinds = dict(rows.dtypes)
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, "_text")) + ", spans array<struct<start:int,end:int,pii_type:string>>"
    return rows.mapInPandas(_decode(shared, "_text", [*keys, "_text", "spans"]), fields)


def found_values(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys..., pii_type, pii_text)``, distinct, of the result of :func:`find_pii`."""
    one = found.select(*keys, "_text", F.explode("spans").alias("s"))
    return one.select(*keys, "s.pii_type", F.expr("substring(_text, s.start + 1, s.end - s.start)").alias("pii_text")).distinct()


def scrubbed(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys..., scrubbed_text, n_found)``: each span replaced by its type in brackets, such as ``[EMAIL]``."""
    before = F.expr("transform(spans, (s, i) -> concat(substring(_text, if(i = 0, 0, spans[i - 1].end) + 1, s.start - if(i = 0, 0, spans[i - 1].end)), '[', upper(s.pii_type), ']'))")
    rest = F.expr("substring(_text, coalesce(try_element_at(spans, -1).end, 0) + 1)")
    return found.select(*keys, F.concat(F.array_join(before, ""), rest).alias("scrubbed_text"), F.size("spans").alias("n_found"))
