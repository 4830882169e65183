"""Language, script and model look-ups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-letter and three-letter language codes.
THREE_LETTERS = {"de": "deu", "es": "spa", "it": "ita", "pl": "pol", "en": "eng", "fr": "fra", "nl": "nld", "ru": "rus", "uk": "ukr"}
#: Script names and their ISO 15924 codes.
SCRIPTS = {"latin": "Latn", "cyrillic": "Cyrl", "arabic": "Arab", "hebrew": "Hebr", "greek": "Grek", "devanagari": "Deva", "han": "Hani", "hangul": "Hang"}
#: Translation models by language; `*` is any other.
CT2_MODELS = {
    "sr": "opus_sh_en_ct2", "bs": "opus_sh_en_ct2", "hr": "opus_sh_en_ct2", "sl": "opus_sl_en_ct2", "mk": "opus_mk_en_ct2", "fr": "opus_fr_en_ct2",
    "nl": "opus_nl_en_ct2", "ru": "opus_ru_en_ct2", "uk": "opus_uk_en_ct2", "*": "opus_fr_en_ct2",
}
#: Fixed values: (name part, tokens, margin, characters a token), in the order in which parts are looked for.
LIMITS = [
    ("opus", 512, 62, 3.5), ("translategemma", 2048, 200, 4.0), ("gemma", 2048, 200, 4.0), ("nllb", 1024, 74, 4.0), ("m2m100", 1024, 74, 4.0),
    ("mbart", 1024, 74, 4.0),
]
#: Limits of a backend that is no name part, and of anything else.
VLLM_LIMIT = (2048, 128, 4.0)
DEFAULT_LIMIT = (512, 62, 3.5)
#: Limits by exact name, of models and of backends alike.
NAMED_LIMITS = {name: tuple(limit) for name, *limit in LIMITS} | {"vllm": VLLM_LIMIT, "__default__": DEFAULT_LIMIT}
#: Characters a token by script.
SCRIPT_CHARACTERS = {"Latn": 4.0, "Cyrl": 3.0, "Arab": 3.5, "Grek": 3.5, "Hans": 1.5, "Hant": 1.5, "Jpan": 2.0, "Kore": 2.0}


def looked_up(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def three_letters(code: Column) -> Column:
    return F.coalesce(looked_up(THREE_LETTERS, code), code)


def ocr_argument(langs: Column) -> Column:
    codes = F.transform(langs, lambda c: three_letters(F.lower(F.trim(c))))
    return F.coalesce(F.nullif(F.array_join(F.array_distinct(codes), "+"), F.lit("")), F.lit("eng"))


def script_code(name: Column) -> Column:
    """ISO 15924 code of a script name; unknown names stay, blank ones are null."""
    return F.when(F.trim(F.coalesce(name, F.lit(""))) != "", F.coalesce(looked_up(SCRIPTS, F.lower(F.trim(name))), name))


def language_key(lang: Column) -> Column:
    return F.lower(F.split(F.coalesce(F.nullif(lang, F.lit("")), F.lit("__default__")), "-")[0])


def language_fallback(page: Column, doc: Column, declared: Column) -> Column:
    empty = F.lit("")
    return F.coalesce(F.nullif(page, empty), F.nullif(doc, empty), F.nullif(F.get(declared, F.lit(0)), empty), F.lit("en"))


def model_of(lang: Column, models: dict[str, str] = CT2_MODELS) -> Column:
    return F.coalesce(looked_up(models, language_key(lang)), F.lit(models["*"]))


def limit_of(model: Column, backend: Column, most_tokens: int | None = None, characters: float | None = None) -> Column:
    """struct(tokens, margin, characters): by exact name, else by name part in order, else by backend, else the default.

    most_tokens and characters, where given, take the place of what was found.
    """
    made = lambda t, m, c: F.struct(F.lit(t).alias("tokens"), F.lit(m).alias("margin"), F.lit(c).alias("characters"))
    low, out = F.lower(model), F.when(F.lit(False), made(*DEFAULT_LIMIT))
    for name, limit in NAMED_LIMITS.items():
        out = out.when(model == name, made(*limit))
    for part, *limit in LIMITS:
        out = out.when(low.contains(part), made(*limit))
    for name, limit in NAMED_LIMITS.items():
        out = out.when(backend == name, made(*limit))
    out = out.otherwise(made(*DEFAULT_LIMIT))
    if most_tokens is not None:
        out = out.withField("tokens", F.lit(most_tokens))
    return out if characters is None else out.withField("characters", F.lit(characters))


def most_characters(limit: Column, characters: Column | None = None) -> Column:
    return ((limit["tokens"] - limit["margin"]) * (limit["characters"] if characters is None else characters)).cast("int")


def script_characters(script: Column) -> Column:
    return F.coalesce(looked_up(SCRIPT_CHARACTERS, script), F.lit(3.5))
