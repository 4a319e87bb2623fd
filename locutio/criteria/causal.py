"""Strong causal language without comparison, counterfactual or a reasonable time window."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.repair import kind, as_text, to_boolean, to_enum
from ..operators.lexicon import Gate, ar_verb, listed
from ..functions.text import let
from .base import Criterion, either, marker, prompt_text

# Causal connectors. ``pattern = label`` where the label isn't the pattern with its accents.
STEMS = "caus provoc gener origin ocasion desat deton desencaden propici motiv impuls".split()
SPANISH = """
produjo = producir, produjeron = producir, producida = producir, producido = producir, producidas = producir, producidos = producir, produce = producir, producen = producir
causa de, derivó en, derivada de, desembocó en, se debe a, debido a, por culpa de, culpa de, gracias a, a raíz de, como consecuencia, consecuencia directa, consecuencia de
dio lugar a, trajo como resultado, es responsable de, responsable de, hizo que, llevó a, condujo a, por eso, por lo tanto, por ende, efecto de, resultado de, impacto de
repercutió, incidió en, merced a, a causa de, por obra de, destruyó, hundió, disparó la, frenó la, se explica por, obedece a, atribuible a, la razón por la que, es la razón
culpable de, culpó a, achaca, fruto de, producto de, por eso mismo
"""
ENGLISH = """
caused, causing, cause of, led to, leads to, leading to, resulted in, resulting in, result of, brought about, gave rise to, triggered, sparked, set off, prompted, fueled, fuelled
because of, because, due to, thanks to, owing to, as a result, responsible for, blame for, to blame, thats why = that's why, that is why, which is why, consequently, therefore, thereby
made possible, drove up, drove down, wiped out, destroyed, is why, are why, was why, were why, reason for, reason why, stems from, attributable to, brought on by
as a consequence, blamed, to blame for, created by, driven by, drove, drive out, drives, driving, spurred, pushed, forced, paved the way, contributed to, gave way to, set in motion, and so
"""
PORTUGUESE = "causou, provocou, gerou, levou a, resultou em, por causa de, devido a, graças a, desencadeou, responsável por"
FRENCH = "à cause de, a provoqué, a entraîné, en raison de, grâce à, a conduit à, responsable de, résulte de, a déclenché, par conséquent"
ITALIAN = "ha causato, ha provocato, a causa di, grazie a, ha portato a, ha generato, responsabile di, di conseguenza"
GERMAN = "verursacht, geführt zu, aufgrund, wegen, ausgelöst, bewirkt, verantwortlich für, dadurch, deshalb"

ENTRIES = [
    *(e for stem in STEMS for e in ar_verb(stem)),
    *(e for code, labels in (("es", SPANISH), ("en", ENGLISH), ("pt", PORTUGUESE), ("fr", FRENCH), ("it", ITALIAN), ("de", GERMAN)) for e in listed(code, labels)),
]

# Short and long keys of an answer.
KEYS = {"causal": "tiene_lenguaje_causal_fuerte", "contraste": "tiene_contrafactual_o_comparacion", "ventana": "ventana_temporal_mencionada"}


def window_of(s: Column) -> Column:
    """ninguna, corta, razonable or null from a folded string; the first rule that fits decides."""
    has = lambda *parts: s.rlike("|".join(parts))
    return (
        F.when((s == "") | s.contains("ningun") | s.isin("none", "n/a") | s.contains("no menciona"), "ninguna")
        .when(has("cort", "short", "dia", "semana"), "corta")
        .when(has("razon", "reasonable", "mes", "ano", "year"), "razonable")
    )


def score_of(causal: Column, contrast: Column, window: Column) -> Column:
    """The score that follows from the three fields."""
    with_contrast = F.when(window == "razonable", 0.25).otherwise(0.45)
    without = F.when(window == "razonable", 0.6).when(window == "corta", 0.9).otherwise(0.75)
    return F.when(~causal, 0.15).when(contrast, with_contrast).otherwise(without)


def reason_of(causal: Column, contrast: Column, window: Column) -> Column:
    term = F.when(window == "ninguna", "sin plazo declarado").when(window == "corta", "con un plazo de dias o semanas").otherwise("con un plazo de meses o anos")
    first, second = either(causal, "Lenguaje causal fuerte", "Sin lenguaje causal fuerte"), either(contrast, "con comparacion o contrafactual", "sin comparacion ni contrafactual")
    return F.concat(F.concat_ws(", ", first, second, term), F.lit("."))


class Causal(Criterion):
    id = "framing-causal"
    name = "Encuadre causal"
    description = "Busca frases que atribuyen un efecto a una causa sin contraste ni plazo creible."
    scope = "Mide como se arma la atribucion; no dice si lo atribuido ocurrio."
    system_prompt = prompt_text("causal")
    keys_reminder = "3 claves exactas (causal, contraste, ventana)"
    gate = Gate(ENTRIES)

    def verdict(self, answer: Column) -> Column:
        def read(short: str) -> Column:
            value, full = (F.try_variant_get(answer, f"$.{k}", "variant") for k in (short, KEYS[short]))
            return F.when(value.isNull() | F.is_variant_null(value), full).otherwise(value)

        def judged(f: Column) -> Column:
            causal, contrast, window = f.causal, f.contrast, f.window
            notes = F.array_compact(F.array(F.when(f.said != window, F.concat(F.lit('ventana normalizada a "'), window, F.lit('"')))))
            fields = {KEYS["causal"]: causal, KEYS["contraste"]: contrast, KEYS["ventana"]: window}
            return (
                F.when(~f.kind.startswith("OBJECT"), self._bad("la respuesta no es un objeto JSON"))
                .when(causal.isNull(), self._bad("causal no es booleano"))
                .when(contrast.isNull(), self._bad("contraste no es booleano"))
                .when(window.isNull(), self._bad("ventana fuera del enum permitido"))
                .otherwise(self._good(notes, score_of(causal, contrast, window), reason_of(causal, contrast, window), self.markers(causal, contrast, window), fields))
            )

        def read_window(raw: Column) -> Column:
            return F.struct(
                kind(answer).alias("kind"), let(read("causal"), to_boolean).alias("causal"), let(read("contraste"), to_boolean).alias("contrast"),
                let(to_enum(raw), window_of).alias("window"), F.when(kind(raw) == "STRING", as_text(raw)).alias("said"),
            )

        return let(let(read("ventana"), read_window), judged)

    @staticmethod
    def markers(causal: Column, contrast: Column, window: Column) -> Column:
        tone = F.when(window == "razonable", "bueno").when(window == "corta", "malo").otherwise("neutro")
        return F.array(
            marker(either(causal, "causal fuerte", "sin causal fuerte"), either(causal, "malo", "bueno")),
            marker(either(contrast, "con contraste", "sin contraste"), either(contrast, "bueno", "malo")),
            marker(F.concat(F.lit("ventana: "), window), tone),
        )
