"""Text normal forms, tokens, stems and small string functions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Invisible marks (ranges of code points), letter folding, stem affixes.
INVISIBLE = "".join(chr(c) for a, b in ((0x61C, 0x61C), (0x640, 0x640), (0x64B, 0x65F), (0x670, 0x670), (0x6D6, 0x6ED), (0x200B, 0x200F), (0xFEFF, 0xFEFF)) for c in range(a, b + 1))
FOLD = ("آأإٱىؤئةیک", "اااايويهيك")
ALEF_VARIANTS = ("ٱٲٳٵ", "ا" * 4)
STEM_PREFIXES = ("وال", "بال", "كال", "فال", "لل", "ال")
STEM_SUFFIXES_3 = ("كم", "هم")
STEM_SUFFIXES_2 = ("ها", "ان", "ات", "ون", "ين", "يه", "ه", "ي")
ARTICLES = ("وبال", "فبال", "وال", "بال", "فال", "كال", "لل", "ال")
EASTERN_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
QUOTES = "\"'“”«»‘’"
EDGE_NOISE = QUOTES + ".،, ؛;"
URDU_ONLY = "ٹڈڑھہۃیےںچژگک"
SCRIPTS = {"bn": "ঀ-৿", "ta": "஀-௿", "ru": "Ѐ-ӿ"}
STOP_WORDS = {
    "en": "the of a an about is that which and in on to hadith verse ayah quran prophet says said where what",
    "fr": "le la les de des du un une qui que est sur dans pour hadith verset coran prophete dit",
    "tr": "ve bir ile icin bu ne olan daha gibi hadis ayet kuran peygamber dedi hangi",
    "id": "yang dan dari untuk ini itu dengan pada adalah hadits hadis ayat quran nabi tentang apa",
}


def squeeze(c: Column) -> Column:
    """White space runs become one blank, none at the edges. (The class is Unicode's; the flag for it would be slower.)"""
    return F.trim(F.regexp_replace(c, r"[\s\x85\p{Z}]+", " "))


def fold(c: Column) -> Column:
    return F.translate(c, *FOLD)


def visible(c: Column) -> Column:
    return F.translate(c, INVISIBLE, "")


def _kept(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(c, *ALEF_VARIANTS), "[^ء-ي٠-٩a-zA-Z0-9]+", " "))


def normalize(c: Column) -> Column:
    """Matching form of Arabic-script text: marks off, letters folded, all but letters, digits and blanks off. Case stays."""
    return _kept(fold(visible(F.coalesce(c, F.lit("")))))


def plain(c: Column) -> Column:
    """As normalize, with the spelling left as it is."""
    return _kept(visible(F.coalesce(c, F.lit(""))))


def normalize_latin(c: Column) -> Column:
    """Lower case, all but letters and digits become blanks. The pattern goes first: lower() may add marks."""
    return F.trim(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]+", " ")))


def surface_text(lang: Column, c: Column) -> Column:
    return F.when(lang.isin("ar", "ur"), normalize(c)).otherwise(normalize_latin(c))


def tokens(c: Column) -> Column:
    """Words of an already normalised text."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def light_stem(w: Column) -> Column:
    """Light stem of an Arabic word: conjunction, one article, then suffixes in their order."""
    s = F.regexp_replace(w, "^و(?=.{3})", "")
    s = F.regexp_replace(s, f"^(?:{'|'.join(STEM_PREFIXES)})(?=.{{2}})", "")
    for x in STEM_SUFFIXES_3:
        s = F.regexp_replace(s, f"(?<=.{{3}}){x}$", "")
    for x in STEM_SUFFIXES_2:
        s = F.regexp_replace(s, f"(?<=.{{2}}){x}$", "")
    return s


def bare(w: Column) -> Column:
    """A word without its joined article or preposition; a lone conjunction stays."""
    return F.regexp_replace(w, f"^(?:{'|'.join(ARTICLES)})(?=.{{2}})", "")


def clean_display(c: Column) -> Column:
    """Direction marks off, blanks squeezed, quotes and stops peeled off both edges."""
    edge = "[" + EDGE_NOISE.replace('"', '\\"') + "]+"
    body = squeeze(F.translate(F.coalesce(c, F.lit("")), "‎‏؜​﻿", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(body, f"^{edge}", ""), f"{edge}$", ""))


def join_open_tanween(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"([ࣰ-ࣲ]) ([اى][ً-ٰٟۖ-ۭ]*)(?=\s|$)", "$1$2")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def western_digits(c: Column) -> Column:
    return F.translate(c, EASTERN_DIGITS, "0123456789" * 2)


def mostly_arabic(c: Column) -> Column:
    word = F.regexp_count(c, F.lit(r"(?U)\w"))
    return F.coalesce(F.regexp_count(c, F.lit("[؀-ۿ]")) / F.nullif(word, F.lit(0)) > 0.5, F.lit(False))


def detect(c: Column) -> Column:
    """Language by script, then by stop words: ar, ur, bn, ta, ru, en, fr, tr, id."""
    text = F.coalesce(c, F.lit(""))
    count = lambda ranges: F.regexp_count(text, F.lit(f"[{ranges}]"))
    urdu, arabic, latin = count(URDU_ONLY), count("؀-ۿ"), count("a-zA-Z")
    by_script = {lang: count(r) for lang, r in SCRIPTS.items()}
    top = F.greatest(*by_script.values())
    first = F.coalesce(*[F.when(n == top, F.lit(lang)) for lang, n in by_script.items()])
    words = F.array_distinct(tokens(normalize_latin(text)))
    hits = {lang: F.size(F.array_intersect(words, F.array(*map(F.lit, w.split())))) for lang, w in STOP_WORDS.items()}
    most = F.greatest(*hits.values())
    by_words = F.when(most > 0, F.coalesce(*[F.when(n == most, F.lit(lang)) for lang, n in hits.items()])).otherwise("en")
    return (
        F.when(F.trim(text) == "", "ar")
        .when((top > 0) & (top >= F.greatest(arabic, latin)), first)
        .when((arabic > 0) & (arabic >= latin), F.when(urdu >= 2, "ur").otherwise("ar"))
        .when(latin > 0, by_words)
        .otherwise("ar")
    )


def middle(words: Column, width: int) -> Column:
    """`width` words from the middle of a text."""
    start = F.greatest(F.lit(0), F.floor((F.size(words) - width) / 2)) + 1
    return F.array_join(F.slice(words, start.cast("int"), F.lit(width)), " ")


def quoted_url(c: Column) -> Column:
    """Percent-encoding with %20 for a blank; slashes stay."""
    return F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def clipped(c: Column, most: int = 420) -> Column:
    """The first `most` characters, double quotes made single."""
    return F.replace(F.substring(F.coalesce(c, F.lit("")), 1, most), F.lit('"'), F.lit("'"))


def token_estimate(c: Column, per_char: float = 1.06) -> Column:
    return (F.floor(F.length(c) * per_char) + 2).cast("long")


def last_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\((\d+)\)\s*$", 1), F.lit(""))


def muslim_citation(running: Column, cited: Column) -> Column:
    """struct<number, intro>: the cited number's whole part; without one, small running numbers are the introduction."""
    number = F.coalesce(F.floor(cited.try_cast("decimal(12,2)")).cast("long"), running.cast("long"))
    return F.struct(number.alias("number"), (cited.isNull() & (running <= 92)).alias("intro"))


def skeleton(c: Column) -> Column:
    """Letters and blanks only, hamza and alef forms as one: what a comparison of two editions looks at."""
    letters = F.translate(visible(F.coalesce(c, F.lit(""))), "آأإٱٲٳٵؤئء", "اااااااوي")
    return squeeze(F.regexp_replace(letters, r"(?U)[^\p{L}\s]", ""))


def short_name(c: Column, prefixes: list[str]) -> Column:
    """A name without the first of the prefixes that it starts with."""
    return F.regexp_replace(c, "^(?:" + "|".join(prefixes) + r")\s+", "")


def filled(template: str, **values: Column) -> Column:
    """The template with {name} replaced by each column, null as empty."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def message(verdict: Column, specific: Column, texts: dict[str, str], hint: str, below: float = 0.35) -> Column:
    """The text of a verdict, any other one's under "else"; no_match of a vague request gets the hint behind it."""
    own = F.try_element_at(F.create_map(*[F.lit(x) for pair in texts.items() for x in pair]), verdict)
    return F.concat(F.coalesce(own, F.lit(texts.get("else", ""))), F.when((verdict == "no_match") & (specific < below), F.lit(" " + hint)).otherwise(""))


def percent(p: Column) -> Column:
    """A share as whole per cent between 0 and 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.round(p * 100))).cast("int")
