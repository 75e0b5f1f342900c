"""Language of documents and of the segments of mixed documents, by a linear-chain CRF.

Words are labelled with languages from affix, character n-gram and lexicon features and
learned transitions. Forward-backward over a whole document gives each word a
distribution; the words of a sentence vote with it, so a skill name borrowed from another
language does not change its sentence. The model is trained on a bounded sample of labelled
documents whose noisy labels are cleaned first by a word-count classifier.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import crf

# The languages with their ISO 639 codes and English names.
LANGUAGES = ("en", "fr", "de", "es", "pt", "nl")
CODES = {"en": "en", "fr": "fr", "de": "de", "es": "es", "pt": "pt", "nl": "nl", "eng": "en", "fra": "fr", "deu": "de", "spa": "es", "por": "pt", "nld": "nl"}
ENGLISH_NAMES = {"english": "en", "french": "fr", "german": "de", "spanish": "es", "portuguese": "pt", "dutch": "nl"}
# Frequent function words of each language, its lexicon.
LEXICON = {
    "en": "the and of to in is that for with was are this from have not you we they which their would about",
    "fr": "le la les des et une est pour dans que qui avec sur pas nous vous ils sont être cette mais leur",
    "de": "der die das und ist nicht mit für ein eine von zu den im wir sie auf auch werden haben wird dass",
    "es": "el los las una y es para con que por del como más pero sus está son esta nos sin muy también",
    "pt": "o os as um uma e é para com que por não do da dos mais mas são está nos sem muito também",
    "nl": "de het een en van is niet met voor op dat zijn wij je ook maar wordt hebben deze naar bij uit",
}
#: Labelled documents taken for training at most, and the longest text that may be one of them.
SAMPLE_DOCS, SAMPLE_CHARS = 3000, 20_000
#: A sentence is relabelled if the word counts make another language likelier by this much (natural logarithm).
CLEARLY = 2.0
_WORD = re.compile(r"[^\W\d_]+")
_END = re.compile(r"[.!?…]+[\"'”’)\]]*(?=\s|$)|[\r\n\x0b\x0c\x85\u2028\u2029]+|(?<=\s)[-*•▪●◦·🔹]+(?=\s)")


def label_language(label: Column) -> Column:
    """The language that a label names rightly, else null: a two- or three-letter code, with a
    region behind ``-`` or ``_`` if any, or the English name, trimmed and in any case."""
    clean = F.lower(F.regexp_replace(label, r"^\s+|\s+$", ""))
    code = F.regexp_extract(clean, r"^([a-z]{2,3})(?:[-_][a-z0-9]{2,8})?$", 1)
    of = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return F.coalesce(F.try_element_at(of(CODES), code), F.try_element_at(of(ENGLISH_NAMES), clean))


def sentences(text: str) -> list[tuple[int, int]]:
    """``(start, end)`` of the sentences of a text: cut at full stops before a space, at line
    ends and at bullets, without the spaces and bullets around them."""
    out, at = [], 0
    for m in _END.finditer(text):
        stop = m.end() if text[m.start()] in ".!?…" else m.start()
        if stop > at:
            out.append((at, stop))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    trimmed = []
    for a, b in out:
        s = text[a:b]
        left = len(s) - len(s.lstrip(" \t\xa0-*•▪●◦·🔹"))
        right = len(s.rstrip())
        if right > left:
            trimmed.append((a + left, a + right))
    return trimmed


_IN_LEXICON: dict[str, list[str]] = {}
for _lang, _words in LEXICON.items():
    for _w in _words.split():
        _IN_LEXICON.setdefault(_w, []).append(_lang)


def word_features(word: str) -> list[str]:
    w = f"^{word}$"
    known = [f"lex={lang}" for lang in _IN_LEXICON.get(word, ())]
    return [f"w={word}", *known, *(f"p={word[:i]}" for i in (2, 3, 4) if len(word) >= i), *(f"s={word[-i:]}" for i in (2, 3, 4) if len(word) >= i), *{f"g={w[i:i + 3]}" for i in range(len(w) - 2)}]


def _split(text: str) -> list[tuple[int, int, list[str]]]:
    return [(a, b, _WORD.findall(text[a:b].lower())) for a, b in sentences(text)]


@lru_cache(maxsize=4)
def train(labelled: tuple[tuple[str, str], ...], epochs: int = 6, seed: int = 5) -> crf.Model:
    """A model from ``(text, language)`` rows whose labels may be wrong in part.

    Word counts by label give each sentence a likely language; sentences that clearly
    speak against the label of their document are relabelled. Two in five documents are
    paired and one to four successive sentences of each are chained, so transitions
    between languages are seen in training.
    """
    docs = [(LANGUAGES.index(lang), _split(text)) for text, lang in labelled]
    counts = [Counter() for _ in LANGUAGES]
    for lang, parts in docs:
        for _, _, words in parts:
            counts[lang].update(set(words))
    size = np.array([sum(c.values()) + 1.0 for c in counts])
    cache: dict[str, np.ndarray] = {}

    def score(w: str) -> np.ndarray:
        if w not in cache:
            share = np.array([c[w] for c in counts]) / size
            cache[w] = np.log((share + 1e-6) / (share + 1e-6).sum())
        return cache[w]

    rng = np.random.default_rng(seed)
    chains: list[list[tuple[list[str], int]]] = []
    for lang, parts in docs:
        chain = []
        for _, _, words in parts:
            if words:
                total = np.sum([score(w) for w in words], axis=0)
                best = int(total.argmax())
                chain.append((words, best if total[best] - total[lang] > CLEARLY else lang))
        if chain:
            chains.append(chain)
    order = rng.permutation(len(chains))
    sequences, i = [], 0
    while i < len(order):
        n = 1 if rng.random() < 0.6 else 2
        part = []
        for j in order[i : i + n]:
            at = int(rng.integers(len(chains[j]))) if n > 1 else 0
            part += chains[j][at : at + int(rng.integers(1, 5))] if n > 1 else chains[j]
        sequences.append(part)
        i += n
    code: dict[str, int] = {}
    form, gold, lengths = [], [], []
    for seq in sequences:
        lengths.append(sum(len(w) for w, _ in seq))
        for words, lang in seq:
            form += [code.setdefault(w, len(code)) for w in words]
            gold += [lang] * len(words)
    lengths = np.array(lengths)
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    return crf.train([word_features(w) for w in code], np.array([form]), np.array(gold), starts, lengths, LANGUAGES, epochs=epochs, seed=seed)


class Tagger:
    """Labels batches of texts; keeps the scores of the words it met."""

    def __init__(self, model: crf.Model):
        self.model, self.code, self.table = model, {}, np.zeros((0, len(LANGUAGES)), np.float32)

    def __call__(self, texts: Sequence[str]) -> list[tuple[str | None, float, list[tuple[int, int, str, float]]]]:
        """Per text: language of most characters, its confidence, and the runs ``(start, end, language, confidence)``.

        A text without words has no language and no runs; sentences without words belong
        to the run around them.
        """
        if len(self.code) > 500_000:
            self.__init__(self.model)
        split = [_split(t) for t in texts]
        words = [w for parts in split for _, _, ws in parts for w in ws]
        fresh = [w for w in dict.fromkeys(words) if w not in self.code]
        if fresh:
            for w in fresh:
                self.code[w] = len(self.code)
            self.table = np.concatenate([self.table, self.model.tables([word_features(w) for w in fresh])[0]])
        form = np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))
        lengths = np.array([sum(len(ws) for _, _, ws in parts) for parts in split], np.int64)
        starts = np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)
        post = np.zeros((len(words), len(LANGUAGES)))
        has = np.flatnonzero(lengths)
        m = self.model
        for b in crf.padded(lengths[has], 200_000):
            k = has[b]
            cells, index = self._cells(form, starts[k], lengths[k])
            p, _, _ = crf.forward_backward(cells, lengths[k], m.trans, m.first, m.last)
            inside = np.arange(len(cells))[:, None] < lengths[k][None, :]
            post[index[inside]] = p[inside]
        # mean of the words of each sentence, and the likeliest language
        sizes = np.array([len(ws) for parts in split for _, _, ws in parts if ws], np.int64)
        heads = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
        means = np.add.reduceat(post, heads, axis=0) / sizes[:, None] if len(sizes) else post
        bests, tops = means.argmax(axis=1).tolist() if len(sizes) else [], means.max(axis=1).tolist() if len(sizes) else []
        out, s = [], -1
        for d, parts in enumerate(split):
            at, runs, chars = int(starts[d]), [], np.zeros(len(LANGUAGES))
            sure = np.zeros(len(LANGUAGES))
            for a, b, ws in parts:
                if not ws:
                    continue
                s += 1
                at += len(ws)
                best, top = bests[s], tops[s]
                if len(ws) <= 2 and top < 0.75:  # a heading that could be either
                    best = runs[-1][2] if runs else int(post[at : at + 8].sum(axis=0).argmax()) if at < starts[d] + lengths[d] else best
                    top = float(means[s, best])
                chars[best] += b - a
                sure += means[s] * (b - a)
                if runs and runs[-1][2] == best:
                    runs[-1][1] = b
                    runs[-1][3].append((b - a, top))
                else:
                    runs.append([a, b, best, [(b - a, top)]])
            if not runs:
                out.append((None, 0.0, []))
                continue
            best = int(chars.argmax())
            named = [(a, b, LANGUAGES[k], float(sum(n * c for n, c in v) / sum(n for n, _ in v))) for a, b, k, v in runs]
            out.append((LANGUAGES[best], float(sure[best] / sure.sum()), named))
        return out

    def _cells(self, form: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        t = np.arange(int(lengths.max()))[:, None]
        index = starts[None, :] + np.minimum(t, lengths[None, :] - 1)
        return self.table[form[index]], index


def tag(df: DataFrame, doc_id: str, text: str, label: str, model: crf.Model) -> DataFrame:
    """``(doc_id, label_lang, lang, confidence, runs)`` of every text that is not null.

    ``label_lang`` is the language that the label names, null if it names none; ``runs`` are
    ``(start, end, lang, confidence)`` in order, positions in code points from 0. Texts
    without words have a null language. A row delivered twice comes out once; other columns
    are not read. ``doc_id`` may be null.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), label_language(F.col(label)).alias("label_lang"), F.col(text).alias("_text")).filter("_text IS NOT NULL")
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size: it grows with the training sample alone
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(shared.value)
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                said = tagger(part["_text"].tolist())
                yield pd.DataFrame({
                    "doc_id": part["doc_id"], "label_lang": part["label_lang"], "lang": [x[0] for x in said], "confidence": [x[1] for x in said],
                    "runs": [[{"start": a, "end": b, "lang": k, "confidence": c} for a, b, k, c in x[2]] for x in said],
                })

    runs = "array<struct<start:int,end:int,lang:string,confidence:double>>"
    return rows.mapInPandas(run, f"doc_id {kind}, label_lang string, lang string, confidence double, runs {runs}").dropDuplicates()
