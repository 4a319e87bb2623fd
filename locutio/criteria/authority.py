"""Appeals to experts, studies or common knowledge without a source that can be traced."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.repair import as_text, kind, to_boolean, to_enum, to_number, to_reason, to_score
from ..functions.text import fixed, let
from ..operators.lexicon import Gate, listed
from .base import Criterion, either, marker, prompt_text

# Markers of an appeal to authority.
SPANISH = """
los expertos, expertos coinciden, los especialistas, los científicos, los economistas, los analistas, los estudios, estudios demuestran, estudios muestran
la investigación, las investigaciones, la evidencia, la ciencia, está demostrado, está probado, está comprobado, está científicamente, es sabido
todo el mundo sabe, todos sabemos, nadie discute, nadie duda, el consenso, hay consenso, según los datos, los datos muestran, las cifras demuestran, según los expertos
organismos internacionales, la comunidad científica, quedó demostrado, ha quedado claro, saben que, sabemos que, ya saben, como saben, ustedes saben
"""
ENGLISH = """
experts, experts agree, specialists, scientists, economists, analysts, studies show, studies have shown, research shows, the research, the evidence, the science
it is proven, it has been proven, scientifically proven, proven that, everyone knows, we all know, no one disputes, nobody denies, the consensus, there is consensus
the data shows, the figures show, according to experts, it is well known, you know that, as you know, we know that
"""
PORTUGUESE = "os especialistas, os cientistas, estudos mostram, está provado, a ciência, todo mundo sabe"
FRENCH = "les experts, les scientifiques, les études montrent, il est prouvé, la science, tout le monde sait"

ENTRIES = [e for code, labels in (("es", SPANISH), ("en", ENGLISH), ("pt", PORTUGUESE), ("fr", FRENCH)) for e in listed(code, labels)]

# Keys of an answer.
KEYS = ("invoca_autoridad", "fuente_identificable", "alcance_de_la_evidencia", "score_autoridad_vaga", "justificacion")


def extent_of(s: Column) -> Column:
    """ninguno, vago, especifico or null from a folded string; the first rule that fits decides."""
    return (
        F.when((s == "") | s.contains("ningun") | s.isin("none", "n/a"), "ninguno")
        .when(s.rlike("vago|vague|generic|impreci"), "vago")
        .when(s.rlike("especif|specific|concret|detall"), "especifico")
    )


def coherent(score: Column, invokes: Column, source: Column, extent: Column) -> tuple[Column, Column]:
    """(score, notes): without an appeal, or with a source and specific evidence, a score of 0.3 or more becomes 0.2."""
    no_appeal = ~invokes & (score >= 0.3)
    defended = invokes & source & (extent == "especifico") & (score >= 0.3)
    notes = F.array_compact(
        F.array(
            F.when(no_appeal, F.lit("score bajado a 0.20 por incoherencia: no invoca autoridad")),
            F.when(defended, F.lit("score bajado a 0.20 por incoherencia: fuente identificable con evidencia especifica")),
        )
    )
    return fixed(F.when(no_appeal | defended, 0.2).otherwise(score), 2), notes


class Authority(Criterion):
    id = "apelacion-autoridad"
    name = "Autoridad sin fuente"
    description = "Busca frases que se apoyan en expertos, informes o sentido comun que nadie podria localizar."
    scope = "Mide si la fuente puede localizarse; no dice si acierta."
    system_prompt = prompt_text("authority")
    keys_reminder = "5 claves exactas"
    gate = Gate(ENTRIES)

    def verdict(self, answer: Column) -> Column:
        values = {k: F.try_variant_get(answer, f"$.{k}", "variant") for k in KEYS}
        present = F.coalesce(F.json_object_keys(F.to_json(answer)), F.array().cast("array<string>"))
        missing = F.array_except(F.array(*map(F.lit, KEYS)), present)
        read = F.struct(
            kind(answer).alias("kind"), missing.alias("missing"), let(values[KEYS[0]], to_boolean).alias("invokes"), let(values[KEYS[1]], to_boolean).alias("source"),
            let(let(values[KEYS[2]], to_enum), extent_of).alias("extent"), let(values[KEYS[2]], lambda v: F.when(kind(v) == "STRING", as_text(v))).alias("said"),
            let(values[KEYS[3]], to_number).alias("number"), let(values[KEYS[4]], to_reason).alias("reason"),
        )

        def judged(f: Column) -> Column:
            clipped, score_notes = to_score(f.number)
            score, coherence_notes = coherent(clipped, f.invokes, f.source, f.extent)
            renamed = F.when(f.said != f.extent, F.concat(F.lit('alcance normalizado a "'), f.extent, F.lit('"')))
            notes = F.concat(F.array_compact(F.array(renamed)), score_notes, coherence_notes)
            good = lambda v: self._good(notes, v, f.reason, self.markers(f.invokes, f.source, f.extent), dict(zip(KEYS, (f.invokes, f.source, f.extent, v, f.reason))))
            return (
                F.when(~f.kind.startswith("OBJECT"), self._bad("la respuesta no es un objeto JSON"))
                .when(F.size(f.missing) >= 3, self._bad(F.concat(F.lit("faltan las claves: "), F.array_join(f.missing, ", "))))
                .when(f.invokes.isNull(), self._bad("invoca_autoridad no es booleano"))
                .when(f.source.isNull(), self._bad("fuente_identificable no es booleano"))
                .when(f.extent.isNull(), self._bad("alcance_de_la_evidencia fuera del enum permitido"))
                .when(f.number.isNull() | F.isnan(f.number), self._bad("score_autoridad_vaga no es numerico"))
                .when(f.reason.isNull(), self._bad("justificacion ausente o demasiado corta (es obligatoria)"))
                .otherwise(let(score, good))
            )

        return let(read, judged)

    @staticmethod
    def markers(invokes: Column, source: Column, extent: Column) -> Column:
        return F.array(
            marker(either(invokes, "invoca autoridad", "sin apelacion a autoridad"), either(invokes, "malo", "bueno")),
            marker(either(source, "fuente identificable", "fuente sin identificar"), either(source, "bueno", "malo")),
            marker(F.concat(F.lit("evidencia: "), extent), either(extent == "especifico", "bueno", "malo")),
        )
