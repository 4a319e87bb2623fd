"""Claims from cues: sentences, or runs between pauses where a transcript has no punctuation, with times interpolated over characters.

Works on the array of cues of a document's row: text and anchors are built, cut and timed inside the row and only the finished claims are exploded, so
there is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.languages import candidates, detected, language_name, segment_language
from ..functions.text import claim_id, fixed, let, punctuation_density, running, squeeze
from .lexicon import Gate, gated

# Lengths of claims, pause and density.
MAX_LENGTH, MAX_UNPUNCTUATED, MIN_LENGTH = 420, 240, 15
MIN_PAUSE, MIN_DENSITY, MIN_TO_DECIDE = 0.65, 3.0, 200
SOFT_CUT = 0.4
# Abbreviations whose point ends no sentence.
ABBREVIATIONS = """sr sra srta dr dra lic ing prof gral av aprox etc ee uu ee.uu pag num art cap fig vs mr mrs ms st jr inc ltd co ca aka no ph dept jan
feb mar apr jun jul aug sep sept oct nov dec ene abr ago dic""".split()

_CUT = "\u0001"
_ABBR = "|".join(a.replace(".", "\\.") for a in sorted(ABBREVIATIONS, key=lambda a: (-len(a), a)))
#: A sentence end and the blank after it. The point is looked for first, or what stands before it would be compared with all abbreviations at each letter.
SENTENCE_END = rf"((?:[!?…]|(?=\.)(?<!(?<![\p{{L}}.])(?iu:{_ABBR})\.?)(?<!(?<![\p{{L}}.])\p{{Lu}})\.)[.!?…\"”»)]*) "


def piece_pattern(longest: int) -> str:
    """Pieces of a long span: up to the last blank of the window if that lies beyond its first 0.4, else a hard cut."""
    least = int(SOFT_CUT * longest) + 1
    return rf"(.{{1,{longest}}}$|.{{{least},{longest - 1}}} |.{{{longest}}}) *"


def joined_text(cues: Column) -> Column:
    return F.array_join(F.transform(cues, lambda c: c.texto), " ")


def unpunctuated(cues: Column) -> Column:
    return let(joined_text(cues), _is_unpunctuated)


def _is_unpunctuated(text: Column) -> Column:
    return (F.length(text) > MIN_TO_DECIDE) & (punctuation_density(text) < MIN_DENSITY)


def anchors(cues: Column) -> Column:
    """(desde, hasta, inicio, fin) of each cue with text in the joined text, blanks squeezed."""
    kept = F.filter(F.transform(cues, lambda c: F.struct(F.length(squeeze(c.texto)).alias("n"), c.inicio.alias("inicio"), F.greatest(c.fin, c.inicio).alias("fin"))), lambda c: c.n > 0)

    def placed(own: Column) -> Column:
        one = lambda at: F.transform(own, lambda c, i: F.struct(F.get(at, i).alias("desde"), (F.get(at, i) + c.n).alias("hasta"), c.inicio.alias("inicio"), c.fin.alias("fin")))
        return let(running(F.transform(own, lambda c: c.n + 1), F.lit(0), "int"), one)

    return let(kept, placed)


def _first_beyond(offset: Column, marks: Column) -> Column:
    """Index of the first mark that ends beyond offset, by halving."""
    halvings = F.sequence(F.lit(0), F.ceil(F.log2(F.size(marks) + 1)).cast("int"))

    def step(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc.lo + acc.hi, 1)
        left = offset < F.get(marks, mid).hasta
        return F.when(acc.lo >= acc.hi, acc).otherwise(F.struct(F.when(left, acc.lo).otherwise(mid + 1).alias("lo"), F.when(left, mid).otherwise(acc.hi).alias("hi")))

    return F.aggregate(halvings, F.struct(F.lit(0).alias("lo"), F.size(marks).alias("hi")), step, lambda acc: acc.lo)


def time_at(offset: Column, marks: Column) -> Column:
    """Seconds at a character: within a cue in proportion, between two cues the start of the later, outside the nearest end."""

    def at(offset: Column) -> Column:
        first, last = F.get(marks, F.lit(0)), F.get(marks, F.size(marks) - 1)

        def within(own: Column) -> Column:
            share = (offset - own.desde) / F.greatest(F.lit(1), own.hasta - own.desde)
            return F.when(offset < own.desde, own.inicio).otherwise(own.inicio + share * (own.fin - own.inicio))

        own = F.get(marks, _first_beyond(offset, marks))
        return F.when(F.size(marks) == 0, F.lit(0.0)).when(offset <= first.desde, first.inicio).when(offset >= last.hasta, last.fin).otherwise(let(own, within))

    return let(offset, at)


def _with_offsets(parts: Column) -> Column:
    """(desde, hasta, texto) of consecutive parts (texto, n) that make up the whole; hasta is n characters on."""

    def placed(own: Column) -> Column:
        one = lambda at: F.transform(own, lambda p, i: F.struct(F.get(at, i).alias("desde"), (F.get(at, i) + p.n).alias("hasta"), p.texto.alias("texto")))
        return let(running(F.transform(own, lambda p: F.length(p.texto)), F.lit(0), "int"), one)

    return let(parts, placed)


def sentences(text: Column) -> Column:
    """Sentences with the blank after them, so that they join to the text again."""
    return F.split(F.regexp_replace(text, SENTENCE_END, "$1 " + _CUT), _CUT)


def pause_blocks(text: Column, marks: Column) -> Column:
    """Runs of cues without a pause of 0.65 s, as parts of the text."""
    n = F.size(marks)
    later = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    cuts = F.transform(F.filter(later, lambda i: F.get(marks, i).inicio - F.get(marks, i - 1).fin >= MIN_PAUSE), lambda i: F.get(marks, i).desde)
    return let(F.concat(F.array(F.lit(0)), cuts), lambda edges: F.transform(edges, lambda a, k: F.substring(text, a + 1, F.coalesce(F.get(edges, k + 1), F.length(text)) - a)))


def divided(spans: Column, longest: int, blank_outside: bool) -> Column:
    """(texto, n) of spans, those over the longest length in pieces. blank_outside: the blank that ends a span isn't part of it."""

    def cut(span: Column) -> Column:
        def pieces(body: Column) -> Column:
            gap = F.substring(span, F.length(body) + 1, F.lit(1))
            whole = F.array(F.struct(span.alias("texto"), F.length(body).alias("n")))
            named = lambda found: F.transform(found, lambda m, i: F.struct(F.when(i == F.size(found) - 1, F.concat(m, gap)).otherwise(m).alias("texto"), F.least(F.length(m), F.lit(longest)).alias("n")))
            return F.when(F.length(body) <= longest, whole).otherwise(let(F.regexp_extract_all(body, F.lit("(" + piece_pattern(longest) + ")"), 1), named))

        return let(F.rtrim(span) if blank_outside else span, pieces)

    return F.flatten(F.transform(spans, cut))


def claims(docs: DataFrame, gate: Gate | None = None, lang: str | None = None, use_gate: bool = True, limit: int | None = None) -> DataFrame:
    """(doc_id, segmentos) -> a row for each claim: doc_id, id, indice, inicio, fin, texto, idioma, idioma_nombre, marcadores, preseleccionada.

    A claim has 15 characters or more and a letter; indice counts those. Null or empty segmentos give none.
    """
    keep = [c for c in docs.columns if c not in ("segmentos",)]
    cues = F.coalesce("segmentos", F.array().cast("array<struct<inicio:double,fin:double,texto:string>>"))
    base = docs.select(*keep, cues.alias("segmentos"))
    base = base.select(*keep, anchors(F.col("segmentos")).alias("_marks"), squeeze(joined_text(F.col("segmentos"))).alias("_text"), unpunctuated(F.col("segmentos")).alias("_bare"))
    base = base.where(F.col("_text") != "")
    parts = F.when(F.col("_bare"), divided(pause_blocks(F.col("_text"), F.col("_marks")), MAX_UNPUNCTUATED, False)).otherwise(divided(sentences(F.col("_text")), MAX_LENGTH, True))
    base = base.withColumn("_parts", _with_offsets(parts))
    kept = F.filter("_parts", lambda p: (F.length(F.trim(p.texto)) >= MIN_LENGTH) & p.texto.rlike("\\p{L}"))

    def claim(p: Column) -> Column:
        return F.struct(
            let(time_at(p.desde, F.col("_marks")), lambda t: fixed(t, 2)).alias("inicio"),
            let(time_at(F.greatest(p.desde, p.hasta - 1), F.col("_marks")), lambda t: fixed(t, 2)).alias("fin"),
            F.trim(p.texto).alias("texto"),
        )

    base = base.withColumn("_claims", F.transform(kept, claim))
    if lang is None:
        base = base.withColumn("_candidates", candidates(F.col("_text"))).withColumn("_doc", F.coalesce(F.try_element_at("_candidates", F.lit(1)), F.lit("und")))
    else:
        base = base.withColumn("_candidates", F.array().cast("array<string>")).withColumn("_doc", F.lit(lang))
    # outer, because an inner explode makes Catalyst push a test of the array's size, and with it the whole computation, below the projections
    rows = base.select(*keep, "_doc", "_candidates", F.posexplode_outer("_claims").alias("indice", "_c")).where("indice is not null").select(*keep, "indice", "_c.*", "_doc", "_candidates")
    own = F.col("_doc") if lang is not None else segment_language(F.col("texto"), F.col("_doc"), F.col("_candidates"), F.when(F.length("texto") >= 140, detected(F.col("texto"))).otherwise("und"))
    rows = rows.select(*keep, claim_id(F.col("indice")).alias("id"), "indice", "inicio", "fin", "texto", own.alias("idioma"))
    return gated(rows.withColumn("idioma_nombre", language_name(F.col("idioma"))), gate, use_gate, limit)


#: Cues of a block of running sums, and characters of a bin of offsets, as powers of two.
BLOCK_BITS, BIN_BITS = 12, 12


def placed_cues(cues: DataFrame) -> DataFrame:
    """(doc_id, desde, hasta, inicio, fin) of rows (doc_id, indice, inicio, fin, texto): where each cue with text stands in its document's joined text, as
    anchors gives it, but with a row a cue. Sums run within blocks of cues and over the blocks, so a document of any length is dealt over many tasks."""
    own = cues.select("doc_id", "indice", F.length(squeeze(F.col("texto"))).cast("bigint").alias("n"), "inicio", F.greatest("fin", "inicio").alias("fin"), F.shiftright("indice", BLOCK_BITS).alias("_block")).where("n > 0")
    blocks = own.groupBy("doc_id", "_block").agg(F.sum(F.col("n") + 1).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("doc_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum(F.col("n") + 1).over(Window.partitionBy("doc_id", "_block").orderBy("indice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    both = own.withColumn("_in", within).join(blocks.select("doc_id", "_block", before.alias("_before")), ["doc_id", "_block"])
    start = F.col("_before") + F.col("_in")
    return both.select("doc_id", start.alias("desde"), (start + F.col("n")).alias("hasta"), "inicio", "fin")


def timed_by_join(points: DataFrame, placed: DataFrame, offset: str = "offset", to: str = "segundos") -> DataFrame:
    """points (doc_id, offset, ...) plus the seconds at each offset, as time_at gives them: an as-of join with placed cues.

    A cue answers for the offsets from the end of the one before it to its own, so each offset meets one cue. Both sides are dealt by document and bin of
    offsets, one shuffle each; offsets outside the text take the nearest end. Documents without cues give 0.
    """
    spans = placed.select("doc_id", "desde", "hasta", "inicio", "fin", F.explode(F.sequence(F.shiftright(F.greatest(F.col("desde") - 1, F.lit(0)), BIN_BITS), F.shiftright(F.col("hasta") - 1, BIN_BITS))).alias("_bin"))
    ends = placed.groupBy("doc_id").agg(F.max(F.struct("hasta", "fin")).alias("_last"))
    at = F.col(offset)
    # offsets that no cue answers for lie anywhere
    asked = points.withColumn("_bin", F.shiftright(F.greatest(at.cast("bigint"), F.lit(0)), BIN_BITS))
    p, c = asked.alias("p"), spans.alias("c")
    here = F.greatest(F.col(f"p.{offset}"), F.lit(0))
    met = p.join(c, (F.col("p.doc_id") == F.col("c.doc_id")) & (F.col("p._bin") == F.col("c._bin")) & (here >= F.col("c.desde") - 1) & (here < F.col("c.hasta")), "left")
    share = (here - F.col("c.desde")) / F.greatest(F.lit(1), F.col("c.hasta") - F.col("c.desde"))
    own = F.when(here < F.col("c.desde"), F.col("c.inicio")).otherwise(F.col("c.inicio") + share * (F.col("c.fin") - F.col("c.inicio")))
    found = met.select(*(F.col(f"p.`{k}`") for k in points.columns), own.alias("_own"), F.col("c.inicio").isNotNull().alias("_met"))
    return found.join(ends, "doc_id", "left").select(*points.columns, F.when(F.col("_met"), F.col("_own")).when(F.col("_last").isNotNull(), F.col("_last.fin")).otherwise(0.0).alias(to))
