"""Problem 2: the language of each record, and of each line of a record in several languages, with a confidence."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.arrowmap import map_rows
from granary.llm.budget import LANGUAGES, language_code
from granary.llm.features import BITS, Ftrl, Grams, softmax, temperature
from granary.llm.related import _MARKUP, _TAIL
from granary.llm.words import plain, words_of

#: The classifier is fitted on at most so many labelled records of a language, spread over the table by a hash.
SAMPLE = 300
#: Credits and references hold no sentence: no full stop at the end, and few words.
_STOP = re.compile(r"[.!?।॥…][\s\"'”’)\]*_]*$")
SHORT = 10
#: A line tells a record's languages only if it has so many words and this confidence.
LINE_WORDS, LINE_SURE = 5, 0.8


class LanguageModel:
    """Sparse multinomial logistic regression on TF-IDF character n-grams, with calibrated confidence.

    The features of a text are the mean of its words' features, so a text's scores are the mean of scores kept by word.
    """

    def __init__(self, labels: tuple[str, ...], table: np.ndarray, bias: np.ndarray, heat: float):
        self.labels, self.table, self.bias, self.heat = labels, table, bias, heat
        self.grams = Grams()
        self._rows: dict[str, int] = {}
        self._scores = np.zeros((1024, len(labels)), np.float64)
        self._sizes = np.zeros(1024)

    def __getstate__(self):  # noqa: ANN204
        return self.labels, self.table, self.bias, self.heat

    def __setstate__(self, state) -> None:  # noqa: ANN001
        self.__init__(*state)

    def _row(self, w: str) -> int:
        k = len(self._rows)
        if k >= 400_000:
            self._rows.clear()
            k = 0
        if k >= len(self._sizes):
            self._scores = np.vstack([self._scores, np.zeros_like(self._scores)])
            self._sizes = np.concatenate([self._sizes, np.zeros_like(self._sizes)])
        g = self.grams(w)
        self._scores[k] = self.table[g].sum(axis=0)
        self._sizes[k] = len(g)
        self._rows[w] = k
        return k

    def logits(self, words: list[str]) -> np.ndarray:
        if len(self._rows) + len(words) >= 400_000:
            self._rows.clear()
        rows = self._rows
        at = [rows[w] if w in rows else self._row(w) for w in words]
        size = self._sizes[at].sum()
        return self.bias if not size else self._scores[at].sum(axis=0) / size + self.bias

    def probabilities(self, words: list[str]) -> np.ndarray:
        return softmax(self.logits(words) / self.heat)

    def predict(self, words: list[str]) -> tuple[str, float]:
        p = self.probabilities(words)
        i = int(p.argmax())
        return self.labels[i], float(p[i])


def _learn(x: list[list[str]], y: np.ndarray, grams: Grams, idf: np.ndarray, outputs: int, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (with the inverse document frequencies in them) and biases."""
    model, bias = Ftrl(outputs), Ftrl(outputs, l1=0.0, bits=1)
    one = np.array([0])
    scale = 6.0  # features are means; so a step moves a score by about its rate
    rows = []
    for words in x:
        c = Counter(g for w in words for g in grams(w))
        idx = np.fromiter(c, np.int64, len(c))
        v = np.fromiter(c.values(), np.float64, len(c))
        rows.append((idx, scale * v / v.sum() * idf[idx]))
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            idx, v = rows[i]
            w, b = model.weights(idx), bias.weights(one)
            p = softmax(v @ w + b[0])
            p[y[i]] -= 1
            model.update(idx, w, v[:, None] * p)
            bias.update(one, b, p[None, :])
    return (model.weights() * (scale * idf)[:, None]).astype(np.float32), bias.weights(one)[0]


def fit(texts: list[str], labels: list[str], rounds: int = 2, seed: int = 7) -> LanguageModel:
    """Fit on labelled texts, line by line. Wrong labels are found by a first fit and left out of the second.

    A tenth of the records is held out for the temperature. Labels without a text can't be predicted.
    """
    names = tuple(c for c in LANGUAGES if c in set(labels)) or tuple(sorted(set(labels)))
    if not names:
        raise ValueError("no labelled text")
    code = {c: i for i, c in enumerate(names)}
    x, y, of = [], [], []
    for k, (t, label) in enumerate(zip(texts, labels)):
        for line in re.split(r"[\r\n]+", plain(t or "")):
            words = words_of(line)
            if len(words) >= LINE_WORDS and label in code:
                x.append(words), y.append(code[label]), of.append(k)
    y, of = np.array(y, int), np.array(of, int)
    if not len(y):
        raise ValueError("no labelled text")
    grams = Grams()
    df = np.zeros(1 << BITS)
    for words in x:
        df[list({g for w in words for g in grams(w)})] += 1
    idf = np.log((1 + len(x)) / (1 + df)) + 1
    held = of % 10 == 9
    keep = ~held if (~held).any() else np.ones(len(y), bool)
    for again in range(2):
        at = np.flatnonzero(keep)
        table, bias = _learn([x[i] for i in at], y[at], grams, idf, len(names), 1 if not again else rounds, seed + again)
        model = LanguageModel(names, table, bias, 1.0)
        logits = np.array([model.logits(w) for w in x])
        if not again:
            sure = softmax(logits)
            keep &= sure[np.arange(len(y)), y] > 0.1
            if not keep.any():
                break
    test = np.flatnonzero(held & (softmax(logits)[np.arange(len(y)), y] > 0.01))
    model.heat = temperature(logits[test], y[test]) if len(test) >= 20 else 1.0
    return model


def labelled_sample(df: DataFrame, language: str, text: str, key: str, most: int = SAMPLE) -> tuple[list[str], list[str]]:
    """Texts and codes of at most ``most`` labelled records of each language, chosen by a hash of the key over the whole table."""
    x = df.select(F.col(key).alias("k"), language_code(F.col(language)).alias("c"), F.col(text).cast("string").alias("t")).where("c IS NOT NULL AND length(t) > 20")
    counts = {r.c: r.n for r in x.groupBy("c").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], []
    rate = F.create_map(*[F.lit(v) for c, n in counts.items() for v in (c, min(1.0, 1.3 * most / n))])
    part = F.pmod(F.xxhash64("k", F.lit(11)), F.lit(1_000_003)) / 1_000_003.0
    got: dict[str, list] = {}
    for r in x.where(part <= rate[F.col("c")]).select("c", "t", part.alias("o")).collect():
        got.setdefault(r.c, []).append((r.o, r.t))
    texts, labels = [], []
    for c in sorted(got):
        for _, t in sorted(got[c])[:most]:
            texts.append(t), labels.append(c)
    return texts, labels


def languages_of(text: str | None, model: LanguageModel) -> list[tuple[int, str, float]]:
    """(0, language, confidence) of a text in one language; (i, language, confidence) of each non-blank line, numbered
    from 1, of a text in several; nothing for a null or blank text.

    A text has several languages if lines of five words or more, each with a confidence of 0.8 or more, differ. Short
    lines (credits, references, markup) and unsure ones never make it so; in a text that has several they take the
    language of the line above (or below the first), unless they are sure themselves.
    """
    if not text or text.isspace():
        return []
    p = plain(text)
    lines = [x for x in re.split(r"[\r\n]+", p) if x and not x.isspace()]
    if not lines:
        return []
    words = [words_of(x) for x in lines]
    every = [w for x in words for w in x]
    if len(lines) > 1:
        bare = [_TAIL.sub("", _MARKUP.sub("", x.strip())).strip() for x in lines]
        size = [len(w) if len(w) >= SHORT or _STOP.search(b) else 0 for w, b in zip(words, bare)]
        got = [(*model.predict(w), n) for w, n in zip(words, size)]
        sure = {c for c, s, n in got if n >= LINE_WORDS and s >= LINE_SURE}
        if len(sure) > 1:
            out, last = [], None
            for i, (c, s, n) in enumerate(got):
                if not (n >= LINE_WORDS and (s >= 0.5 or c in sure)):
                    c = last or next((d for d, t, m in got[i:] if m >= LINE_WORDS and t >= LINE_SURE), c)
                last = c
                out.append((i + 1, c, s))
            return out
    return [(0, *model.predict(every))]


def record_languages(df: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", language: str = "language") -> DataFrame:
    """(key, segment, language, confidence, label) with the label's code (null if it names no language), once per key and segment.

    Segment 0 is a record in one language, segments from 1 on are the non-blank lines of a record in several. One pass;
    the fitted model (a few MB whatever the corpus) is broadcast. Rows with a null key and blank texts give nothing.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def start():  # noqa: ANN202
        m = shared.value

        def f(k, t, c):  # noqa: ANN001
            if k is not None:
                for seg, lang, conf in languages_of(t, m):
                    yield k, seg, lang, conf, c

        return f

    kind = df.schema[key].dataType.simpleString()
    x = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), language_code(F.col(language)).alias("c"))
    out = map_rows(x, f"k {kind}, segment int, language string, confidence double, label string", start)
    return out.groupBy("k", "segment").agg(F.min(F.struct("language", "confidence", "label")).alias("x")).select(F.col("k").alias(key), "segment", "x.*")
