"""Language by script and lexicon: counts of scripts, marker scores, cascades of rules with method and confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.text import let

# Ranges of scripts, scripts that a label allows, markers of languages.
SCRIPTS = {
    "devanagari": r"[\x{900}-\x{97f}]", "bengali": r"[\x{980}-\x{9ff}]", "gurmukhi": r"[\x{a00}-\x{a7f}]", "gujarati": r"[\x{a80}-\x{aff}]",
    "odia": r"[\x{b00}-\x{b7f}]", "tamil": r"[\x{b80}-\x{bff}]", "telugu": r"[\x{c00}-\x{c7f}]", "kannada": r"[\x{c80}-\x{cff}]",
    "malayalam": r"[\x{d00}-\x{d7f}]", "arabic": r"[\x{600}-\x{6ff}]", "latin": r"[A-Za-z\x{c0}-\x{24f}]",
}
#: Latin as the cleaner's guess counts it: with the signs between its letters.
LATIN_BLOCK = r"[\x{41}-\x{24f}]"
LABELS = {
    "devanagari": "hi", "bengali": "bn", "gurmukhi": "pa", "gujarati": "gu", "odia": "or", "tamil": "ta", "telugu": "te", "kannada": "kn",
    "malayalam": "ml", "arabic": "ur", "latin": "en",
}
ALLOWED = {
    "hi": ("devanagari",), "mr": ("devanagari",), "sa": ("devanagari",), "ne": ("devanagari",), "bn": ("bengali",), "as": ("bengali",),
    "pa": ("gurmukhi",), "gu": ("gujarati",), "or": ("odia",), "ta": ("tamil",), "te": ("telugu",), "kn": ("kannada",), "ml": ("malayalam",),
    "ur": ("arabic",), "en": ("latin",), "hinc-latn": ("latin",), "hinc-deva": ("devanagari", "latin"),
}
#: Labels that stand for no one language; any script agrees with them.
ANY = ("unknown", "multi")
MARKERS = {
    "hi": (
        "है", "हैं", "था", "थी", "थे", "और", "नहीं", "कि", "की", "को", "में", "से", "पर", "यह", "वह", "किया", "गया", "हुआ", "लिए", "साथ",
        "बहुत", "कुछ", "अपने", "उनके", "जो", "तो", "भी", "अब", "कर", "हो", "रहा", "रही", "रहे", "वाले", "जब", "क्यों", "कैसे",
    ),
    "mr": (
        "आहे", "आहेत", "आणि", "नाही", "होते", "होती", "होता", "मध्ये", "या", "त्या", "च्या", "झाले", "झाली", "केले", "करणे", "असे",
        "असते", "म्हणून", "त्यांनी", "यांनी", "पण", "काही", "सर्व", "आपल्या", "त्याच्या", "मराठी", "कविता", "अभंग", "देव", "श्री",
    ),
    "sa": (
        "च", "एव", "इति", "तथा", "अपि", "तु", "वै", "न", "स", "तत्", "यत्", "अथ", "श्लोक", "अध्याय", "वाक्यम्", "किम्", "अस्ति", "भवति",
        "उवाच", "सर्वे", "धर्म", "कर्म", "ब्रह्म", "मोक्ष", "आत्मा", "परम", "तस्मात्", "यथा", "तेन", "एष", "इदम्",
    ),
}
ROMANISED = (
    "hai", "hain", "tha", "thi", "the", "aur", "ya", "yaar", "ka", "ki", "ke", "ko", "me", "mein", "se", "par", "tak", "bhi", "nahi",
    "nahin", "kya", "kyu", "kyun", "kaise", "kab", "abhi", "kal", "aaj", "raha", "rahi", "rahe", "gaya", "gayi", "gaye", "diya", "liya",
    "dena", "lena", "karo", "kar", "karna", "karte", "karta", "karti", "hua", "hui", "hoga", "hogi", "matlab", "bhai", "dost", "kaam",
    "paisa", "paise", "ghar", "school", "office", "meeting", "jaldi", "tension", "accha", "achha", "thoda", "bahut", "bohot", "zyada",
    "kam", "bada", "chhota", "mujhe", "tumhe", "tumko", "hamara", "hamari", "apna", "apni", "unka", "uska", "mera", "meri", "sakta",
    "sakte", "sakti", "chahiye", "padega", "padta", "lagta", "lagti", "banaya", "bana",
)
#: Romanised Hindi as the cleaner's guess knows it.
CLEANER_ROMANISED = (
    "hai", "hain", "tha", "thi", "aur", "ya", "yaar", "ka", "ki", "ke", "ko", "me", "mein", "se", "par", "tak", "bhi", "nahin", "nahi",
    "kya", "kyu", "kyun", "kaise", "kabhi", "abhikal", "kal", "aaj", "ja", "raha", "rahi", "gaya", "gayi", "diya", "de", "do", "dena",
    "le", "lo", "aa", "ho", "hota", "hoti", "hua", "hokar", "samajh", "padh", "likh", "bol", "suna", "dekh", "karo", "kar", "na",
    "bhool", "jaldi", "tension", "paisa", "rupee", "school", "college", "office", "meeting", "class", "exam", "notes", "rate", "chhota",
    "bada", "zyada", "kam", "bohot", "bahut", "thoda", "accha", "achha", "bura", "saras", "mujhe", "tumhe", "tumko", "hamara", "unka",
    "uska", "iskaiskaiskaiska",
)
WORD = r"[\p{L}\p{M}\p{N}_\x{200c}\x{200d}]+"
#: Scripts that an answer in a language is expected in; others can't be checked by script.
EXPECTED = {"hi": "devanagari", "hinc-deva": "devanagari", "sa": "devanagari", "mr": "devanagari", "en": "latin", "hinc-latn": "latin"}


def script_count(text: Column, script: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SCRIPTS[script])), F.lit(0))


def script_counts(text: Column, scripts: dict[str, str] = SCRIPTS) -> Column:
    """How many letters of each script a text has, as an array in the order of ``scripts``, and how many other characters.

    Each script's letters are taken out of what the ones before it left, so later scripts look through next to nothing.
    """

    def after(rest: Column, patterns: list[str], counts: list[Column]) -> Column:
        if not patterns:
            return F.array(*counts, F.length(rest))
        return let(F.regexp_replace(rest, patterns[0] + "+", ""), lambda r: after(r, patterns[1:], [*counts, F.length(rest) - F.length(r)]))

    return after(F.coalesce(text, F.lit("")), list(scripts.values()), [])


def script_share(text: Column, script: str) -> Column:
    """Part of the letters that are of a script; 0 where there are none."""
    return let(script_counts(text), lambda c: c[list(SCRIPTS).index(script)] / _letters(c))


def _letters(counts: Column) -> Column:
    return F.greatest(F.aggregate(F.slice(counts, 1, len(SCRIPTS)), F.lit(0), lambda a, b: a + b), F.lit(1))


def _part(words: Column, lexicon: tuple[str, ...]) -> Column:
    """Part of the words that a lexicon holds; it is looked up by hash."""
    return F.coalesce(F.size(F.filter(words, lambda w: w.isin(*lexicon))) / F.greatest(F.size(words), F.lit(1)), F.lit(0.0))


def marker_scores(text: Column) -> Column:
    """Parts of the words of two letters or more that mark hi, mr and sa, as an array; zeros where there are none."""
    words = F.filter(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.length(w) > 1)
    return let(words, lambda ws: F.array(*[_part(ws, MARKERS[k]) for k in MARKERS]))


def romanised_score(text: Column, lexicon: tuple[str, ...] = ROMANISED, word: str = r"[a-z']+") -> Column:
    """Part of the Latin words that are romanised Hindi."""
    return let(F.regexp_extract_all(F.lower(text), F.lit(word), F.lit(0)), lambda ws: _part(ws, lexicon))


def identify(text: Column, declared: Column) -> Column:
    """The language by rules: mixed scripts, the first script with half the letters, markers in Devanagari, romanised Hindi."""
    return identified(text, declared)["language"]


def _verdict(language: Column | str, method: Column | str, confidence: Column | float) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(language).alias("language"), lit(method).alias("method"), lit(confidence).cast("double").alias("confidence"))


def identified(text: Column, declared: Column) -> Column:
    """(language, method, confidence) by rules; the declared label decides only where Devanagari text has no clear markers."""
    at = {s: i for i, s in enumerate(SCRIPTS)}

    def rules(c: Column, n: Column) -> Column:
        dev, lat = c[at["devanagari"]] / n, c[at["latin"]] / n
        out = F.when((dev >= 0.40) & (lat >= 0.20), _verdict("hinc-deva", "script-mixed(devanagari+latin)", F.least(F.lit(0.75), 0.35 + dev * lat * 2)))
        for s, label in LABELS.items():
            if s not in ("devanagari", "latin"):
                out = out.when(c[at[s]] / n >= 0.5, _verdict(label, f"script({s})", F.least(F.lit(0.9), 0.45 + c[at[s]] / n)))
        out = out.when(dev >= 0.5, let(marker_scores(text), lambda m: _of_devanagari(m, declared)))
        roman = let(romanised_score(text), lambda r: F.when(r >= 0.18, _verdict("hinc-latn", "latin+romanized-hindi-lexicon", F.least(F.lit(0.6), 0.25 + r))).otherwise(_verdict("en", "script(latin)", F.least(F.lit(0.9), 0.45 + lat))))
        return out.when(lat >= 0.5, roman).otherwise(_verdict("unknown", "script", 0.0))

    return let(script_counts(text), lambda c: let(_letters(c), lambda n: rules(c, n)))


def _of_devanagari(m: Column, declared: Column) -> Column:
    """hi, mr or sa: the one whose markers are a twentieth of the words and twice as many as any other's; else the declared, else hi."""
    out = F.lit(None)
    for i, k in enumerate(MARKERS):
        others = F.greatest(*[m[j] for j in range(len(MARKERS)) if j != i])
        clear = (m[i] >= 0.05) & (m[i] >= 2 * others) & (m[i] >= others)
        verdict = _verdict(k, f"script(devanagari)+marker-lexicon({k})", F.least(F.lit(0.85), 0.4 + m[i] * 4))
        out = F.when(clear, verdict) if i == 0 else out.when(clear, verdict)
    prior = _verdict(declared, F.concat(F.lit("script(devanagari)+declared-prior("), declared, F.lit(")")), 0.4)
    return out.when(declared.isin(*MARKERS), prior).otherwise(_verdict("hi", "script(devanagari)+default", 0.3))


def reconciled(text: Column, declared: Column) -> Column:
    """``identified``, but a declared label that the script allows is kept where the markers say another, at half confidence."""

    def keep(got: Column) -> Column:
        known = declared.isin(*ALLOWED, *ANY) & (declared != "unknown") & (declared != got["language"])
        inherited = _verdict(declared, F.concat(got["method"], F.lit("+declared-prior")), F.least(got["confidence"], F.lit(0.5)))
        return F.when(known & script_agrees(text, declared), inherited).otherwise(got)

    return let(identified(text, declared), keep)


def guessed(text: Column) -> Column:
    """(language, method, confidence) as the cleaner guesses it from scripts: Devanagari is hi, other scripts are named."""
    scripts = {"latin": LATIN_BLOCK, **{s: p for s, p in SCRIPTS.items() if s not in ("latin", "arabic")}}
    indic = [s for s in scripts if s not in ("latin", "devanagari")]

    def rules(c: Column) -> Column:
        n = F.greatest(F.aggregate(c, F.lit(0), lambda a, b: a + b), F.lit(1))
        at = {s: c[i] for i, s in enumerate(scripts)}
        dev, lat = at["devanagari"] / n, at["latin"] / n
        other = (n - at["devanagari"] - at["latin"]) / n
        most = F.greatest(*[at[s] for s in indic])
        named = F.coalesce(*[F.when(at[s] == most, F.lit(f"script:{s}")) for s in indic])
        other_one = F.when(most == 0, _verdict("unknown", "script-heuristic", 0.0)).otherwise(_verdict(named, "script-heuristic", 0.4))
        roman = let(romanised_score(text, CLEANER_ROMANISED), lambda r: F.when(r >= 0.18, _verdict("hinc-latn", "latin+romanized-hindi-lexicon", F.least(F.lit(0.6), 0.25 + r))).otherwise(_verdict("en", "script-heuristic", F.least(F.lit(0.9), 0.45 + lat - r))))
        return (
            F.when((dev >= 0.4) & (lat >= 0.20), _verdict("hinc-deva", "script-heuristic-mixed", F.least(F.lit(0.7), 0.35 + dev * lat * 2)))
            .when(dev >= 0.5, _verdict("hi", "script-heuristic", F.least(F.lit(0.95), 0.55 + dev)))
            .when((other >= 0.5) & (F.length(text) > 0), other_one)
            .when(lat >= 0.5, roman)
            .otherwise(_verdict("unknown", "script-heuristic", 0.0))
        )

    return let(script_counts(text, scripts), rules)


def script_profile(text: Column) -> Column:
    """(devanagari, latin): parts of the letters of these two scripts, ASCII only for Latin, to three places."""
    deva, latin = F.regexp_count(text, F.lit(SCRIPTS["devanagari"])), F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.struct(*[F.coalesce(F.round(F.try_divide(x, deva + latin), 3), F.lit(0.0)).alias(k) for k, x in (("devanagari", deva), ("latin", latin))])


def script_agrees(text: Column, label: Column, least: float = 0.5) -> Column:
    """Whether a script that the label allows has its share; labels outside the table agree with anything."""
    at = {s: i for i, s in enumerate(SCRIPTS)}

    def agrees(c: Column, n: Column) -> Column:
        out = F
        for k, ss in ALLOWED.items():
            out = out.when(label == k, F.greatest(*[c[at[s]] / n for s in ss], F.lit(0.0)) >= least)
        return out.otherwise(F.lit(True))

    return let(script_counts(text), lambda c: let(_letters(c), lambda n: agrees(c, n)))


def code_switches(text: Column, least: int = 2) -> Column:
    """Whether two words or more hold Latin letters and two or more Devanagari ones."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    both = lambda ws: (F.size(F.filter(ws, lambda w: w.rlike("[A-Za-z]"))) >= least) & (F.size(F.filter(ws, lambda w: w.rlike(SCRIPTS["devanagari"]))) >= least)
    return let(words, both)
