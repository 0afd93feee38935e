"""Language identification of mixed-language text (operator 2).

A word's script narrows the languages it can belong to, character trigrams
score it for those, and a Viterbi path over the words, with a penalty for each
change of language, labels spans.  A text's language is the one whose spans
hold the most letters.
"""

from __future__ import annotations

import bisect
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workers import small_batches, tidy

#: Bounds of the fit: labelled rows that are read (on average) of a language, and of all languages together.
SAMPLE_ROWS, SAMPLE_TOTAL = 2_000, 200_000
#: What a change of language costs, and what a trigram counts, as the three that overlap on a letter are not independent.
SWITCH, GRAM_WEIGHT = 8.0, 0.5
#: A language uses a script that at least this share of its letters is in.
SCRIPT_SHARE = 0.01
#: Words labelled together, words that a worker remembers, and their greatest length.
TOGETHER, REMEMBERED, REMEMBERED_CHARS = 200_000, 200_000, 40

UNDETERMINED = "und"
#: First code points of ranges and the scripts there, after the Unicode blocks.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0900, "Devanagari"),
    (0x0980, "Indic"), (0x0E00, "Thai"), (0x0E80, "Asian"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1C80, "Cyrillic"),
    (0x1C90, "Georgian"), (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x2C00, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"),
    (0x2DE0, "Cyrillic"), (0x2E00, "Han"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"), (0x3200, "Han"),
    (0xA000, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAB30, "Latin"), (0xAB70, "Other"), (0xAC00, "Hangul"),
    (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB10, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"),
    (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"), (0x40000, "Other"),
)
_STARTS = [start for start, _ in SCRIPTS]


def _class_of(major: str) -> str:
    """The characters of one of Unicode's major categories, as ranges inside a pattern's brackets."""
    inside = [unicodedata.category(chr(c))[0] == major for c in range(sys.maxunicode + 1)]
    edges = [c for c in range(1, len(inside)) if inside[c] != inside[c - 1]] + [len(inside)]
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2], edges[1::2], strict=False))


#: A word is letters with the marks that belong to them, and the two joiners that some scripts write inside of words.
_LETTER, _MARK = _class_of("L"), _class_of("M")
_WORD = re.compile(f"[{_LETTER}][{_LETTER}{_MARK}\u200c\u200d]*")

#: A text without any of these has no marks and no joiners, and its words are what a much faster pattern finds.
_RARE = re.compile("[\u0300-\u1fff\u200c\u200d\u2070-\U0010ffff]")
_PLAIN_WORD = re.compile(r"[^\W\d_²³¹¼½¾]+")


def words_of(text: str) -> list[str]:
    """Words of a text, composed first, so that a letter and its accent are one."""
    text = unicodedata.normalize("NFC", text)
    return (_WORD if not text.isascii() and _RARE.search(text) else _PLAIN_WORD).findall(text)


def script_of(char: str) -> str:
    return SCRIPTS[bisect.bisect_right(_STARTS, ord(char)) - 1][1]


def letters_of(word: str) -> str:
    """A word as it is compared: in lower case."""
    return word.lower()


def grams_of(letters: str) -> list[str]:
    """Trigrams of a word with its two borders."""
    marked = f"<{letters}>"
    return [marked[i : i + 3] for i in range(len(marked) - 2)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words' trigrams and scripts, counted by language; a partition's rows are a bounded sample's."""
    grams, scripts = Counter(), Counter()
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for word, n in Counter(words_of(text)).items():
                letters = letters_of(word)
                for gram in grams_of(letters):
                    grams[lang, gram] += n
                scripts[lang, script_of(letters[0])] += n * len(letters)
    rows = [(k[0], 0, k[1], n) for k, n in grams.items()] + [(k[0], 1, k[1], n) for k, n in scripts.items()]
    if rows:
        lang, kind, key, n = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(kind, pa.int32()), pa.array(key), pa.array(n, pa.int64())], names=["lang", "kind", "key", "n"])


@dataclass
class Model:
    """Languages, the score of each trigram in each (row 0: one that is not known), and the languages of each script."""

    langs: list[str]
    gram: dict[str, int]
    score: np.ndarray
    allowed: dict[str, np.ndarray]


def held_out(doc_id):
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id as the empty text, held in."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from rows that are not held out and have text and language.

    ``sample_rows`` of a language are read on average, chosen by a hash of id
    and text; of a language with fewer, all.  A rare language is so learned as
    well.  Of all languages together SAMPLE_TOTAL are read at most on average,
    each then having fewer; so what is counted and sent to the driver, trigrams
    by language, is bounded by the sample, whatever labels there are.
    """
    small_batches(docs.sparkSession)
    lang, text, key = F.col(lang_col).cast("string"), F.col(text_col), F.col(id_col)
    rows = docs.where(lang.isNotNull() & text.isNotNull() & ~held_out(key)).select(lang.alias("lang"), text.alias("text"), F.pmod(F.xxhash64(key, text), F.lit(1 << 30)).alias("draw"))
    per_lang = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    n_langs = max(1, per_lang.count())
    share = per_lang.select("lang", (F.lit(min(float(sample_rows), SAMPLE_TOTAL / n_langs) * (1 << 30)) / F.col("n")).alias("upto"))
    # One row for each label; a table of very many labels is joined without a broadcast.
    sample = rows.join(F.broadcast(share) if n_langs <= SAMPLE_ROWS else share, "lang").where("draw < upto").select("lang", "text")
    counts = sample.mapInArrow(tidy(_count), "lang string, kind int, key string, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    found = counts.select("lang", "kind", "key", "n").collect()
    langs = sorted({r["lang"] for r in found})
    place = {x: i for i, x in enumerate(langs)}
    gram: dict[str, int] = {}
    for r in sorted((r for r in found if r["kind"] == 0), key=lambda r: r["key"]):
        gram.setdefault(r["key"], len(gram) + 1)
    count = np.full((len(gram) + 1, len(langs)), 0.5)
    allowed: dict[str, np.ndarray] = {}
    letters = Counter()
    for r in found:
        if r["kind"] == 0:
            count[gram[r["key"]], place[r["lang"]]] += r["n"]
        else:
            letters[r["lang"]] += r["n"]
    for r in found:
        if r["kind"] == 1 and r["n"] >= SCRIPT_SHARE * letters[r["lang"]]:
            allowed.setdefault(r["key"], np.zeros(len(langs), bool))[place[r["lang"]]] = True
    return Model(langs, gram, (GRAM_WEIGHT * np.log(count / count.sum(axis=0))).astype(np.float32) if langs else np.zeros((1, 0), np.float32), allowed)


class Words:
    """Scores of words, their letters, and those of them that some learned language could have written; remembered up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.scores = np.empty((0, len(self.model.langs)), np.float32)
        self.letters = np.empty(0, np.int64)
        self.fitting = np.empty(0, np.int64)

    def look_up(self, words: list[str]) -> np.ndarray:
        """Rows of the words in ``scores`` and ``letters``."""
        if len(self.place) > REMEMBERED:
            self.clear()
        at = list(map(self.place.get, words))
        if None in at:
            fresh = list(dict.fromkeys(w for w, i in zip(words, at, strict=True) if i is None))
            first = len(self.letters)
            self._add(fresh)
            new = {w: first + i for i, w in enumerate(fresh)}
            at = [new[w] if i is None else i for w, i in zip(words, at, strict=True)]
            self.place.update((w, i) for w, i in new.items() if len(w) <= REMEMBERED_CHARS)
        return np.array(at, np.int64)

    def _add(self, words: list[str]) -> None:
        known, model = self.model.gram.get, self.model
        grams: list[int] = []
        starts, sizes = [], []
        allow = np.ones((len(words), len(model.langs)), bool)
        for i, word in enumerate(words):
            letters = letters_of(word)
            starts.append(len(grams))
            sizes.append(len(letters))
            grams += [known(g, 0) for g in grams_of(letters)]
            languages = model.allowed.get(script_of(letters[0]))
            allow[i] = False if languages is None else languages
        scores = np.add.reduceat(model.score[np.array(grams)], np.array(starts), axis=0)
        scores -= scores.max(axis=1, keepdims=True)
        # Of a word that no language's script fits, nothing follows; else the languages that its script rules out score far less.
        scores[~allow] -= 50
        scores[~allow.any(axis=1)] = 0
        self.scores = np.concatenate([self.scores, np.maximum(scores, -60)])
        sizes = np.array(sizes, np.int64)
        self.letters = np.concatenate([self.letters, sizes])
        self.fitting = np.concatenate([self.fitting, np.where(allow.any(axis=1), sizes, 0)])


def best_path(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The label of each word on the best path of its text; texts of the given lengths follow each other.

    All texts move on by one word at a time, the longest first, so that each
    step is a few operations on whole arrays.
    """
    n, rank = len(scores), np.argsort(-lengths, kind="stable")
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.empty(len(lengths), np.int64)
    place[rank] = np.arange(len(lengths))
    position = np.arange(n) - np.repeat(starts, lengths)
    order = np.lexsort((np.repeat(place, lengths), position))
    active = np.bincount(position, minlength=1)
    offset = np.concatenate([[0], np.cumsum(active)])
    timed = scores[order]
    stays = np.empty(timed.shape, bool)
    best = np.empty(n, np.int32)
    value = timed[: active[0]].copy()
    for t in range(1, len(active)):
        a, o = active[t], offset[t]
        before = value[:a]
        top = before.max(axis=1)
        best[o : o + a] = before.argmax(axis=1)
        top -= np.float32(switch)
        np.greater_equal(before, top[:, None], out=stays[o : o + a])
        value[:a] = np.maximum(before, top[:, None]) + timed[o : o + a]
    state = value.argmax(axis=1).astype(np.int32)
    timed_labels = np.empty(n, np.int32)
    for t in range(len(active) - 1, -1, -1):
        a, o = active[t], offset[t]
        timed_labels[o : o + a] = state[:a]
        if t:
            keep = stays[np.arange(o, o + a), state[:a]]
            state[:a] = np.where(keep, state[:a], best[o : o + a])
    labels = np.empty(n, np.int32)
    labels[order] = timed_labels
    return labels


def label_texts(texts: list[str | None], words: Words) -> list[tuple[str, float]]:
    """Language and score of each text; the score is the share of its letters that lie in spans of that language.

    Letters of words in scripts that no learned language uses count for none,
    so a text of such words alone has the first language and score 0.
    """
    langs, out = words.model.langs, []
    at = 0
    while at < len(texts):
        flat: list[str] = []
        lengths: list[int] = []
        while at < len(texts) and (not lengths or len(flat) < TOGETHER):
            found = words_of(texts[at] or "")
            flat += found
            lengths.append(len(found))
            at += 1
        sizes = np.array(lengths, np.int64)
        sums = np.zeros((len(sizes), max(1, len(langs))), np.int64)
        totals = np.zeros(len(sizes), np.int64)
        filled = sizes > 0
        if flat and langs:
            rows = words.look_up(flat)
            labels = best_path(words.scores[rows], sizes[filled])
            text = np.repeat(np.arange(len(sizes)), sizes)
            sums = np.bincount(text * len(langs) + labels, weights=words.fitting[rows], minlength=sums.size).reshape(sums.shape)
            totals = np.bincount(text, weights=words.letters[rows], minlength=len(sizes))
        for line, total in zip(sums, totals, strict=True):
            best = int(line.argmax())
            out.append((langs[best], float(line[best] / total)) if total else (UNDETERMINED, 0.0))
    return out


def spans(text: str | None, words: Words) -> list[tuple[int, int, str]]:
    """Spans of one language: start and end in characters of the composed text, and the language; none without letters or languages."""
    found = list(_WORD.finditer(unicodedata.normalize("NFC", text or "")))
    if not found or not words.model.langs:
        return []
    rows = words.look_up([m.group() for m in found])
    labels = best_path(words.scores[rows], np.array([len(found)]))
    out: list[tuple[int, int, str]] = []
    for m, label in zip(found, labels, strict=True):
        lang = words.model.langs[label]
        if out and out[-1][2] == lang:
            out[-1] = (out[-1][0], m.end(), lang)
        else:
            out.append((m.start(), m.end(), lang))
    return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, lang_pred, score.

    Only the text decides.  A null text, or one without a letter, is ``und``
    with score 0, as is every text if nothing was learned.  A text in scripts
    that no learned language uses has the first language by name, as a value
    must be given, with score 0.  Equal shares go to the language that comes
    first by name.  Repeated rows and null ids pass through; other columns are
    ignored.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(sent.value)
        for batch in batches:
            found = label_texts(batch.column("text").to_pylist(), words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_certain(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text has a language, or several, with all their columns.

    What goes is ``und``, and what is written in scripts of no learned language (score 0).
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(sent.value)
        for batch in batches:
            found = label_texts(batch.column(at).to_pylist(), words)
            yield batch.filter(pa.array([lang != UNDETERMINED and score > 0 for lang, score in found], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
