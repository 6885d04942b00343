"""Grade labels, severity and scope, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import normalize

# Terms and phrases of rulings and how they are written, severity classes, labels and actions.
TERMS = {
    "sahih": "صحيح", "daif": "ضعيف", "hasan": "حسن", "mawdu": "موضوع",
    "shadh": "شاذ", "munkar": "منكر", "matruk": "متروك", "batil": "باطل",
    "maqtu": "مقطوع", "mauquf": "موقوف", "muquf": "موقوف", "mutawatir": "متواتر",
    "mursal": "مرسل", "munqati": "منقطع", "mudallas": "مدلّس", "muallaq": "معلّق",
    "isnaad": "الإسناد", "sanad": "السند", "hadith": "الحديث",
    "lighairihi": "لغيره", "very": "شديد", "agreed": "متفق", "upon": "عليه",
    "bukhari": "البخاري", "muslim": "مسلم", "muttafaq": "متفق عليه", "and": "و", "ghairihi": "غيره",
}
PHRASES = {
    "very daif": "ضعيف جدًا", "sahih agreed upon": "صحيح متفق عليه",
    "sahih bukhari and muslim": "صحيح متفق عليه (البخاري ومسلم)",
    "sahih muslim": "صحيح (أخرجه مسلم)", "sahih bukhari": "صحيح (أخرجه البخاري)",
    "sahih isnaad": "صحيح الإسناد", "isnaad sahih": "صحيح الإسناد",
    "hasan isnaad": "حسن الإسناد", "isnaad hasan": "حسن الإسناد",
    "daif isnaad": "ضعيف الإسناد", "isnaad daif": "ضعيف الإسناد", "sanad daif": "ضعيف السند",
    "hasan sahih": "حسن صحيح", "sahih lighairihi": "صحيح لغيره", "hasan lighairihi": "حسن لغيره",
    "sahih hadith": "حديث صحيح", "sahih mutawatir": "صحيح متواتر",
    "sahih muquf": "صحيح موقوف", "sahih mauquf": "صحيح موقوف", "sahih maqtu": "صحيح مقطوع",
}
CLASSES = {
    "mawdu": ("mawdu", "batil"),
    "daif": ("daif", "shadh", "munkar", "matruk", "munqati", "mursal", "muallaq"),
    "sahih": ("sahih", "mutawatir"),
    "hasan": ("hasan",),
}
SCOPE_TERMS = ("isnaad", "sanad")
SEVERITY_LABELS = {"sahih": "صحيح", "hasan": "حسن", "daif": "ضعيف", "mawdu": "موضوع", "unknown": "غير محدد"}
ACTIONS = {"sahih": "safe_to_cite", "hasan": "safe_to_cite", "daif": "warn_do_not_cite", "mawdu": "warn_fabricated", "unknown": "warn_unverified"}
SEVERITY_ORDER = {"quran": 0, "sahih": 1, "hasan": 1, "unknown": 2, "daif": 3, "mawdu": 3}
#: Phrases of free rulings, in the order in which they are looked for: refusals and negations before the words in them.
FREE_RULINGS = (
    ("none", ("سكت عنه", "لم يحكم عليه", "لم يذكر حكمه")),
    ("mawdu", ("موضوع", "باطل", "مكذوب", "لا اصل له")),
    ("daif", ("لا يصح", "ليس بصحيح", "غير صحيح", "لم يصح", "لا يثبت", "غير ثابت")),
    ("daif", ("ضعيف", "منكر", "شاذ", "متروك", "واه", "مستور", "مدرج", "معلول", "منقطع", "مرسل")),
    ("sahih", ("صحيح", "ثابت", "علي شرط", "متفق عليه")),
    ("hasan", ("حسن",)),
)


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def terms(grade: Column) -> Column:
    """Latin terms of a grade, as written."""
    return F.regexp_extract_all(F.coalesce(grade, F.lit("")), F.lit("[a-zA-Z]+"), 0)


def severity(grade: Column) -> Column:
    """The worst class that any term names; unknown where none does."""
    low = F.transform(terms(grade), F.lower)
    out = F.lit(None).cast("string")
    for name, words in CLASSES.items():
        out = F.coalesce(out, F.when(F.arrays_overlap(low, F.array(*map(F.lit, words))), name))
    return F.coalesce(out, F.lit("unknown"))


def scope(grade: Column) -> Column:
    return F.when(F.arrays_overlap(F.transform(terms(grade), F.lower), F.array(*map(F.lit, SCOPE_TERMS))), "isnaad").otherwise("hadith")


def label(grade: Column) -> Column:
    """The grade's phrase, else its terms one by one; unknown terms pass; null for an empty grade or a dash."""
    own, known = terms(grade), literal_map(TERMS)
    phrase = F.try_element_at(literal_map(PHRASES), F.array_join(F.transform(own, F.lower), " "))
    each = F.array_join(F.transform(own, lambda t: F.coalesce(F.try_element_at(known, F.lower(t)), t)), " ")
    return F.when(F.trim(F.coalesce(grade, F.lit(""))).isin("", "-"), None).otherwise(F.coalesce(phrase, F.nullif(each, F.lit(""))))


def action(of: Column) -> Column:
    return F.try_element_at(literal_map(ACTIONS), of)


def severity_of_ruling(ruling: Column) -> Column:
    """Class of a free-text ruling; refusals, then negations, are looked for before the terms inside them."""
    text = normalize(ruling)
    out = F.when(text == "", "unknown")
    for name, phrases in FREE_RULINGS:
        hit = F.lit(False)
        for p in phrases:
            hit = hit | text.contains(p)
        out = out.when(hit, name)
    return out.otherwise("unknown")


def pick_grade(graders: Column, preferred: str) -> Column:
    """Of array<struct<grader, grade>>: the preferred one's usable grade, else the first usable one, else null."""
    usable = F.filter(graders, lambda g: g["grade"].isNotNull() & ~F.trim(g["grade"]).isin("", "-"))
    return F.coalesce(F.get(F.filter(usable, lambda g: g["grader"] == preferred), F.lit(0)), F.get(usable, F.lit(0)))


def main_grader(graders: Column, preferred: str, grade: Column) -> Column:
    """The preferred one if it gave this grade, else anyone who did, else the first."""
    same = F.filter(graders, lambda g: g["grade"] == grade)
    return F.coalesce(F.get(F.filter(same, lambda g: g["grader"] == preferred), F.lit(0)), F.get(same, F.lit(0)), F.get(graders, F.lit(0)))


#: graders' names for Arabic readers.
GRADERS = {
    "Al-Albani": "الألباني",
    "Zubair Ali Zai": "زبير علي زئي",
    "Shuaib Al Arnaut": "شعيب الأرناؤوط",
    "Abu Ghuddah": "عبد الفتاح أبو غدة",
    "Muhammad Muhyi Al-Din Abdul Hamid": "محمد محيي الدين عبد الحميد",
    "Muhammad Fouad Abd al-Baqi": "محمد فؤاد عبد الباقي",
    "Ahmad Muhammad Shakir": "أحمد محمد شاكر",
    "Bashar Awad Maarouf": "بشار عواد معروف",
}


def grader_label(name: Column) -> Column:
    """The grader's name in Arabic; unknown ones as they are."""
    return F.coalesce(F.try_element_at(literal_map(GRADERS), name), name)
