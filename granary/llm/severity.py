"""Problem 9: how abusive, hateful or sexually explicit documents are.

Reviewed passages carry grades; a cumulative-link ordinal regression over sparse text features predicts them. A document
is as severe as its severest passage, for one passage suffices.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import seeds
from granary.llm.arrowmap import map_rows
from granary.llm.features import Ftrl, bucket
from granary.llm.fold import fold
from granary.llm.words import TAG, WORD

#: Grades in order of severity: harmless; aimed at or indecent towards a person; demeaning a group or calling for harm to it.
GRADES = {"none": 0, "abusive": 1, "sexual": 1, "hateful": 2}
#: About so many of a corpus's passages join the reviewed ones as presumably harmless, and so many of each label.
BACKGROUND, BACKGROUND_LEAST = 4000, 100
#: So many of the most frequent labels (by their first two letters) are drawn from apart; labels beyond them as one.
STRATA = 200
#: How much a background passage and a seed passage count at least beside a reviewed one, chosen by the recall of reviewed
#: wordings that were left out of the fit whole. The background of a label counts as STRATUM passages at least, up to 1 each,
#: so that languages the reviewers did not see are learned too.
BACKGROUND_WEIGHT, SEED_WEIGHT, STRATUM = 0.1, 2.0, 150
#: The first threshold is at least so high: evidence is needed to call a passage offensive, for few are.
FIRST = 0.75
FOLDS = 4
#: The chance of an offence above which a document is reported. Of reviewed wordings left out of the fit whole, 78 % are found
#: at it (76 % at 0.5), with one background sentence in 4,000 more reported than at 0.5.
REPORTED = 0.45
#: At most so many reviewed passages are used.
REVIEWED = 50_000
SHORT, LONGEST = 3, 12
_ENDS = re.compile(r"(?<=[.!?।॥…])[\"'”’)\]*_]*\s+|[\r\n]+|<br\s*/?>|</p>")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*]){2,}[^\W\d_](?![^\W_])")
_LEET = str.maketrans("@30$15!", "aeosisi")
_TOKEN = re.compile(r"[^\s,;:()\[\]{}\"“”।॥…?/\\|<>~^=+]+")
_RUN = re.compile(r"(.)\1{2,}")
_TWICE = re.compile(r"^(.{2,})\1$")


@lru_cache(200_000)
def undisguised(token: str) -> tuple[str, ...]:
    """The words of a token in small letters: digits and signs put for letters, letters drawn out and words run together
    twice are undone. A hidden letter stays as "*"."""
    t = token.lower().strip("!.'’*_-`&%#")
    if any(c in "@$03451!" for c in t) and any(c.isascii() and c.isalpha() for c in t) and not t.isdigit():
        t = t.translate(_LEET)
    if "*" in t and any(c.isalpha() for c in t):
        out = [x for x in re.split(r"[^\w*ऀ-ൿ]+", t) if x]
    else:
        out = WORD.findall(t)
    done = []
    for w in out:
        w = _RUN.sub(r"\1", w)
        m = _TWICE.match(w)
        done.append(m.group(1) if m and len(w) >= 6 else w)
    return tuple(done)


def passages(text: str) -> list[list[str]]:
    """The words of each sentence or line of a text, disguises undone. Sentences of fewer than SHORT words in a row are one
    passage, of at most LONGEST words; what is still short is part of the passage after it, or of the one before it at the end."""
    if "<" in text:
        text = TAG.sub("\n" if "<p" in text or "<br" in text else "", text)
    text = fold(text)
    out: list[list[str]] = []
    short: list[str] = []
    for s in _ENDS.split(text):
        if s and not s.isspace():
            if s.count(" ") * 3 > len(s) or "-" in s or "*" in s or "_" in s or "." in s:
                s = _SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m.group()), s)
            words = ["0" if w.isdigit() else w for t in _TOKEN.findall(s) for w in undisguised(t)]
            if len(words) < SHORT:
                short += words
                if len(short) < LONGEST:
                    continue
                words, short = short, []
            elif len(short) >= SHORT:
                out.append(short)
                short = []
            out.append(short + words)
            short = []
    if short and (len(short) >= SHORT or not out):
        out.append(short)
    elif short:
        out[-1] = out[-1] + short
    return out


def _word_features(w: str) -> dict[int, float]:
    """A word and its parts of three to five letters; those of a word beyond 20 letters count less."""
    f = {bucket("=" + w): 1.0}
    e = f"_{w}_"
    part = 0.25 * min(1.0, 20 / len(w))
    for n in (3, 4, 5):
        for i in range(len(e) - n + 1):
            g = bucket(e[i : i + n])
            f[g] = f.get(g, 0.0) + part
    return f


def _length(words: list[str]) -> float:
    """What a passage's sum is divided by; short ones count as six words, for they say little."""
    return max(len(words), 6) ** 0.5


class SeverityModel:
    """Cumulative-link (proportional odds) model: one weight for each feature, shared by all thresholds.

    The features of a passage are its words, their parts and pairs of neighbours, over the root of its length,
    so a passage's score is a sum of scores that are kept by word and pair.
    """

    def __init__(self, weights: np.ndarray, cuts: np.ndarray, vocabulary: frozenset[str]):
        self.weights, self.cuts, self.vocabulary = weights, cuts, vocabulary
        self._kept: dict = {}

    def __getstate__(self):  # noqa: ANN204
        return self.weights, self.cuts, self.vocabulary

    def __setstate__(self, state) -> None:  # noqa: ANN001
        self.__init__(*state)

    def _word(self, w: str) -> float:
        if "*" in w:
            r = re.compile(re.escape(w).replace(r"\*", "."))
            fits = [v for v in self.vocabulary if len(v) == len(w) and r.fullmatch(v)]
            got = max((self._word(v) for v in fits), default=0.0)
        else:
            got = float(sum(self.weights[k] * v for k, v in _word_features(w).items()))
        if len(self._kept) < 500_000:
            self._kept[w] = got
        return got

    def score(self, words: list[str]) -> float:
        kept, s = self._kept, 0.0
        for w in words:
            got = kept.get(w)
            s += self._word(w) if got is None else got
        for p in zip(words, words[1:]):
            got = kept.get(p)
            if got is None:
                got = float(self.weights[bucket(p[0] + " " + p[1])])
                if len(kept) < 500_000:
                    kept[p] = got
            s += got
        return s / _length(words)

    def expected(self, score: float) -> float:
        """Expected grade at a score: the chances to exceed each threshold, summed."""
        return float((1 / (1 + np.exp(np.clip(self.cuts - score, -50, 50)))).sum())

    def offends(self, score: float) -> float:
        return float(1 / (1 + np.exp(np.clip(self.cuts[0] - score, -50, 50))))

    def rate(self, text: str | None) -> tuple[float, float]:
        """(expected grade, chance of any offence) of the severest passage; zeros for a null or blank text."""
        if not text or text.isspace():
            return 0.0, 0.0
        best = max((self.score(w) for w in passages(text)), default=None)
        return (0.0, 0.0) if best is None else (self.expected(best), self.offends(best))


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    f: dict[int, float] = {}
    for w in words:
        for k, v in _word_features(w).items():
            f[k] = f.get(k, 0.0) + v
    for a, b in zip(words, words[1:]):
        k = bucket(a + " " + b)
        f[k] = f.get(k, 0.0) + 1.0
    return np.fromiter(f, np.int64, len(f)), np.fromiter(f.values(), np.float64, len(f)) / _length(words)


def _learn(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    model, top = Ftrl(1, alpha=0.3, l1=0.02, l2=0.02), max(GRADES.values())
    cuts = FIRST + np.arange(top)
    rng = np.random.default_rng(seed)
    order = np.arange(len(rows))
    for r in range(rounds):
        rng.shuffle(order)
        step = 0.05 / (1 + r)
        for i in order:
            idx, v = rows[i]
            w = model.weights(idx)
            s = float(v @ w[:, 0])
            f = 1 / (1 + np.exp(np.clip(s - cuts, -30, 30)))  # chance to be at most each grade but the last
            k = y[i]
            hi, lo = (f[k] if k < top else 1.0), (f[k - 1] if k else 0.0)
            g = weight[i] * (1 - hi - lo) * -1.0
            model.update(idx, w, (v * -g)[:, None])
            p = max(hi - lo, 1e-3)
            if k < top:
                cuts[k] += step * weight[i] * min(1.0, hi * (1 - hi) / p)
            if k:
                cuts[k - 1] -= step * weight[i] * min(1.0, lo * (1 - lo) / p)
            cuts[0] = max(cuts[0], FIRST)  # a passage of which nothing is known is harmless
            for j in range(1, top):  # thresholds stay in order and apart
                cuts[j] = max(cuts[j], cuts[j - 1] + 0.3)
    return model.weights()[:, 0].astype(np.float32), cuts


def seed_passages() -> list[tuple[str, int]]:
    """The passages of ``seeds`` and their grades; groups get made-up names, so that no real one is learned."""
    names = ("Marani", "Telgar", "Bokhi", "Sindra")
    hateful = [(t.replace("X", names[i % len(names)]), GRADES["hateful"]) for i, t in enumerate(seeds.HATEFUL)]
    return [*((t, GRADES["abusive"]) for t in seeds.ABUSIVE), *hateful, *((t, GRADES["sexual"]) for t in seeds.SEXUAL), *((t, 0) for t in seeds.HARMLESS)]


def fit(texts: list[str], labels: list[str], background: list[tuple[str, str]] = (), seeded: list[tuple[str, int]] | None = None, rounds: int = 12, seed: int = 7) -> SeverityModel:
    """Fit on reviewed passages (labels of GRADES; others are left out), seed passages, and presumably harmless ones.

    Each sentence of a harmless reviewed passage is harmless; of an offensive one only the first is sure to bear on the
    grade. Background passages may offend unnoticed: each is rated by a model fitted on the other parts of the background
    (cross-validation in FOLDS parts), and has the grade which that finds if it finds it offensive. A language that the
    reviewers did not see is thus learned as harmless from its other passages, while what offends like the reviewed passages
    is not.
    """
    x, y, heavy = [], [], []
    for t, g in ((t, GRADES[k]) for t, k in zip(texts, labels) if k in GRADES and t):
        parts = passages(t)
        for p in parts if g == 0 else parts[:1]:
            x.append(p), y.append(g), heavy.append(1.0)
    if not x:
        raise ValueError("no reviewed passage")
    for t, g in seed_passages() if seeded is None else seeded:
        x.append([w for p in passages(t) for w in p]), y.append(g), heavy.append(SEED_WEIGHT)
    n = len(x)
    sizes = Counter(label for _, label in background)
    for t, label in background:
        for p in passages(t)[:1]:
            x.append(p), y.append(0), heavy.append(min(1.0, max(BACKGROUND_WEIGHT, STRATUM / sizes[label])))
    rows, y, heavy = [_features(w) for w in x], np.array(y), np.array(heavy)
    vocabulary = frozenset(w for words, g in zip(x[:n], y) if g for w in words if "*" not in w)
    part = np.array([-1] * n + [bucket(" ".join(w)) % FOLDS for w in x[n:]])
    for f in range(FOLDS if len(x) > n else 0):
        others = np.flatnonzero(part != f)
        model = SeverityModel(*_learn([rows[i] for i in others], y[others], heavy[others], rounds // 2, seed), vocabulary)
        for i in np.flatnonzero(part == f):
            s = model.score(x[i])
            if model.offends(s) >= 0.5:
                y[i], heavy[i] = max(1, round(model.expected(s))), 1.0
    return SeverityModel(*_learn(rows, y, heavy, rounds, seed), vocabulary)


def background_sample(df: DataFrame, text: str, language: str | None = None, most: int = BACKGROUND, least: int = BACKGROUND_LEAST) -> list[tuple[str, str]]:
    """(sentence, label) from the corpus: about ``most`` of all, and about ``least`` of each label (its first two letters), if it has them.

    Texts are drawn by their hash, and of each text the sentences of the least hashes (several where texts are few), so the
    sample is the same however the rows lie. Copies of a text count once.
    """
    stratum = F.lower(F.substring(F.trim(language), 1, 2)) if language else F.lit("")
    x = df.where(F.length(F.trim(F.col(text))) > 0).select(F.col(text).alias("t"), F.coalesce(stratum, F.lit("")).alias("l"))
    n = max(1, x.count())
    sizes = {r.l: r.n for r in x.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "l").limit(STRATA).collect()}
    each = -(-most // n)
    of_label = F.element_at(F.create_map(*[F.lit(v) for k, c in sorted(sizes.items()) for v in (k, min(1.0, max(most / n, least / c)))]), F.col("l")) if sizes else F.lit(None)
    share = F.coalesce(of_label, F.lit(min(1.0, most / n)))
    part = F.pmod(F.xxhash64("t", F.lit(5)), F.lit(1_000_003)) / 1_000_003.0
    lines = F.filter(F.split("t", r"(?<=[.!?।॥])\s+|[\r\n]+"), lambda s: F.length(F.trim(s)) > 0)
    drawn = x.where(part < share).select("l", F.explode(F.slice(F.array_sort(F.transform(lines, lambda s: F.struct(F.xxhash64(s, F.lit(7)).alias("h"), s.alias("s")))), 1, each)).alias("s"))
    rows = drawn.groupBy("s.h", "s.s").agg(F.min("l").alias("l")).collect()
    return [(s, label) for _, s, label in sorted((r.h, r.s, r.l) for r in rows) if passages(s)]


def rated(df: DataFrame, model: SeverityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df without text, with severity (expected grade, 0 to 2) and chance (of any offence) of each row, in one pass.

    Null, empty and blank texts have 0 and 0. Rows are neither dropped nor merged, whatever their keys.
    Columns named severity or chance are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in df.columns if c not in (text, "severity", "chance")]

    def start():  # noqa: ANN202
        m = shared.value

        def f(*row):  # noqa: ANN002
            yield (*row[:-1], *m.rate(row[-1]))

        return f

    schema = df.select(*rest).schema.add("severity", "double").add("chance", "double")
    return map_rows(df.select(*rest, F.col(text).cast("string").alias(text)), schema, start)
