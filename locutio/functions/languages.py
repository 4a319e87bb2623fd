"""Language codes and names, and detection of a text's language from function words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, squeeze

# Three-letter and two-letter codes.
CODES = {
    "spa": "es", "eng": "en", "por": "pt", "fra": "fr", "deu": "de", "ita": "it", "cat": "ca", "glg": "gl", "eus": "eu", "nld": "nl", "rus": "ru",
    "ukr": "uk", "pol": "pl", "ron": "ro", "ell": "el", "tur": "tr", "arb": "ar", "ara": "ar", "heb": "he", "pes": "fa", "fas": "fa", "hin": "hi",
    "ben": "bn", "urd": "ur", "ind": "id", "zsm": "ms", "jpn": "ja", "kor": "ko", "cmn": "zh", "vie": "vi", "tha": "th", "swe": "sv", "nob": "no",
    "nno": "no", "dan": "da", "fin": "fi", "ces": "cs", "slk": "sk", "hun": "hu", "bul": "bg", "hrv": "hr", "srp": "sr", "lit": "lt", "lav": "lv",
    "est": "et", "kat": "ka", "hye": "hy", "afr": "af", "swh": "sw", "tgl": "tl",
}
# Names of the languages.
NAMES = {
    "es": "Español", "en": "Inglés", "pt": "Portugués", "fr": "Francés", "de": "Alemán", "it": "Italiano", "ca": "Catalán", "gl": "Gallego",
    "eu": "Euskera", "nl": "Neerlandés", "ru": "Ruso", "uk": "Ucraniano", "pl": "Polaco", "ro": "Rumano", "el": "Griego", "tr": "Turco", "ar": "Árabe",
    "he": "Hebreo", "fa": "Persa", "hi": "Hindi", "bn": "Bengalí", "ur": "Urdu", "id": "Indonesio", "ms": "Malayo", "ja": "Japonés", "ko": "Coreano",
    "zh": "Chino", "vi": "Vietnamita", "th": "Tailandés", "sv": "Sueco", "no": "Noruego", "da": "Danés", "fi": "Finlandés", "cs": "Checo",
    "sk": "Eslovaco", "hu": "Húngaro", "bg": "Búlgaro", "hr": "Croata", "sr": "Serbio", "lt": "Lituano", "lv": "Letón", "et": "Estonio",
    "ka": "Georgiano", "hy": "Armenio", "af": "Afrikáans", "sw": "Suajili", "tl": "Tagalo", "und": "Indeterminado",
}

#: Texts below are undetermined; a segment below doesn't override its document; languages that a segment may switch to.
MIN_TEXT, MIN_SEGMENT, CANDIDATES = 20, 140, 6

#: Function words that tell the languages apart.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht ein eine den dem von zu mit auf für sich im auch wird hat".split(),
    "en": "the of and to in is that it was for on are with as this be at have by not".split(),
    "es": "el la los las de que y en un una por con para es no se del lo al más".split(),
    "fr": "le la les des et est un une que qui dans pour pas au du sur avec ce il elle".split(),
    "it": "il lo gli della di che è un una per con non del sono alla nel anche come più dei".split(),
    "pt": "o os as do da que e em um uma para com não é no na por mais dos foi".split(),
}


def _any_word() -> str:
    """A function word of any language, as a whole run of letters; words by their first letter, so that one pass does for all languages."""
    by_letter: dict[str, list[str]] = {}
    for w in sorted({w for words in FUNCTION_WORDS.values() for w in words}):
        by_letter.setdefault(w[0], []).append(w[1:])
    return rf"(?<!\p{{L}})(?:{'|'.join(c + '(?:' + '|'.join(rest) + ')' for c, rest in by_letter.items())})(?!\p{{L}})"


_ANY_WORD = _any_word()


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def two_letters(code: Column) -> Column:
    return F.coalesce(_lookup(CODES, code), code)


def language_name(code: Column) -> Column:
    return F.coalesce(_lookup(NAMES, code), F.upper(code))


def candidates(text: Column) -> Column:
    """Up to six languages by the number of their function words in text, most first, ties by code; none for a short text or without a hit."""

    def ranked(low: Column) -> Column:
        def told(found: Column) -> Column:
            scores = F.array(*(F.struct((-F.size(F.filter(found, lambda w: w.isin(words)))).alias("n"), F.lit(code).alias("code")) for code, words in FUNCTION_WORDS.items()))  # noqa: B023
            return F.slice(F.transform(F.array_sort(F.filter(scores, lambda s: s.n < 0)), lambda s: s.code), 1, CANDIDATES)

        return F.when(F.length(low) >= MIN_TEXT, let(F.regexp_extract_all(low, F.lit(_ANY_WORD), F.lit(0)), told)).otherwise(F.array().cast("array<string>"))

    return let(F.lower(squeeze(text)), ranked)


def detected(text: Column) -> Column:
    return F.coalesce(F.try_element_at(candidates(text), F.lit(1)), F.lit("und"))


def segment_language(segment: Column, document: Column, document_candidates: Column, own: Column | None = None) -> Column:
    """The document's language unless the segment is long enough and its own language is among the document's candidates."""
    own = detected(segment) if own is None else own
    switch = (F.length(squeeze(segment)) >= MIN_SEGMENT) & (own != "und") & F.array_contains(document_candidates, own)
    return F.when(switch, own).otherwise(document)
