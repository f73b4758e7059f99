"""English word forms: suffixes stripped step by step, by rule tables, as expressions.

The steps are those of the published Porter2 algorithm. A step takes the longest of its suffixes with which the
word ends, and replaces it if the rest of the word is long enough: `_R1` and `_R2` say whether one or two runs
of vowels, each followed by another letter, stand before the suffix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: words left out of text queries ------------------------------------------
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()

# ---- fixed values: words with a stem of their own, and words that stay as they are -----------
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl",
    **{w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")},
}
#: these stay once a plural ending is gone
UNCHANGED = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")

# ---- fixed values: suffixes and what replaces them -------------------------------------------
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = dict.fromkeys(("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"), "")

_V, _C = "[aeiouy]", "[^aeiouy]"
#: after these beginnings the first region starts at once
_BEGIN = "(?:gener|commun|arsen)"
_R1 = f"^{_BEGIN}|{_V}{_C}"
_R2 = f"^{_BEGIN}.*{_V}{_C}|^(?!{_BEGIN}).*?{_V}{_C}.*{_V}{_C}"
#: a last syllable of one vowel between others, and a word that has no other
_SHORT_END = f"{_C}{_V}[^aeiouywxY]$|^{_V}{_C}$"
_SHORT = f"^{_C}+{_V}[^aeiouywxY]$|^{_V}{_C}$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _cut(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def _ending(word: Column, suffixes, body: Callable[[Column, Column], Column]) -> Column:
    """body(rest, suffix) for the longest suffix with which the word ends, else the word."""
    pattern = f"^(.*?)({'|'.join(suffixes)})$"
    parts = F.struct(F.regexp_extract(word, pattern, 1).alias("rest"), F.regexp_extract(word, pattern, 2).alias("suffix"))
    return _let(parts, lambda p: F.when(p["suffix"] == "", word).otherwise(body(p["rest"], p["suffix"])))


def _plural(w: Column) -> Column:
    return (
        F.when(w.endswith("sses"), _cut(w, 2))
        .when(w.rlike("ie[ds]$"), F.when(F.length(w) > 4, _cut(w, 2)).otherwise(_cut(w, 1)))
        .when(w.rlike("[us]s$"), w)
        .when(w.rlike(f"{_V}.+s$"), _cut(w, 1))
        .otherwise(w)
    )


def _past(w: Column) -> Column:
    def mended(rest: Column) -> Column:
        return (
            F.when(rest.rlike("(at|bl|iz)$"), F.concat(rest, F.lit("e")))
            .when(rest.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _cut(rest, 1))
            .when(rest.rlike(_SHORT), F.concat(rest, F.lit("e")))
            .otherwise(rest)
        )

    def body(rest: Column, suffix: Column) -> Column:
        long = F.when(rest.rlike(_R1), F.concat(rest, F.lit("ee"))).otherwise(w)
        return F.when(suffix.startswith("ee"), long).when(rest.rlike(_V), mended(rest)).otherwise(w)

    return _ending(w, ("eedly", "ingly", "edly", "eed", "ing", "ed"), body)


def _final_y(w: Column) -> Column:
    return F.regexp_replace(w, f"^(.+{_C})[yY]$", "$1i")


def _replaced(table: dict[str, str], region: str, conditions: dict[str, str]) -> Callable[[Column], Column]:
    """A step: the suffix goes if the rest of the word matches the region, and the suffix's condition if it has one."""

    def step(w: Column) -> Column:
        new = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])

        def body(rest: Column, suffix: Column) -> Column:
            allowed = rest.rlike(region)
            for name, needed in conditions.items():
                allowed = allowed & ((suffix != name) | rest.rlike(needed))
            return F.when(allowed, F.concat(rest, F.element_at(new, suffix))).otherwise(w)

        return _ending(w, table, body)

    return step


def _last(w: Column) -> Column:
    rest = _cut(w, 1)
    drops_e = rest.rlike(_R2) | (rest.rlike(_R1) & ~rest.rlike(_SHORT_END))
    return F.when(w.endswith("e"), F.when(drops_e, rest).otherwise(w)).when(w.endswith("ll") & rest.rlike(_R2), rest).otherwise(w)


_STEPS = (
    _past, _final_y, _replaced(SECOND, _R1, {"ogi": "l$", "li": "[cdeghkmnrt]$"}), _replaced(THIRD, _R1, {"ative": _R2}), _replaced(FOURTH, _R2, {"ion": "[st]$"}), _last,
)


def stem(word: Column) -> Column:
    """The stem of a lower-case word. Words of up to two letters, and those with digits, stay as they are."""

    def regular(w: Column) -> Column:
        def rest(v: Column) -> Column:
            out = v
            for step in _STEPS:
                out = _let(out, step)
            return F.when(v.isin(*UNCHANGED), v).otherwise(out)

        marked = F.regexp_replace(w, "^y|(?<=[aeiou])y", "Y")  # such a y is no vowel
        return F.translate(_let(_let(marked, _plural), rest), "Y", "y")

    known = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    return _let(word, lambda w: F.when((F.length(w) < 3) | ~w.rlike(r"^\p{L}+$"), w).otherwise(F.coalesce(F.try_element_at(known, w), regular(w))))


def stems_of(spark: SparkSession, words: list[str]) -> list[str]:
    """Stems of a few words; the expression is folded into a constant, no job runs."""
    if not words:
        return []
    return list(spark.sql("SELECT 1").select(F.array(*[stem(F.lit(w)) for w in words])).first()[0])


def common_start(stem: str) -> str:
    """With which letters every form of a stem begins: all but the last one, or the first one of the irregular short stems."""
    short = any(known == stem and not word.startswith(stem[:-1]) for word, known in IRREGULAR.items())
    return stem[:1] if short or len(stem) < 3 else stem[:-1]
