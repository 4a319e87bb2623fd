"""Transcripts from subtitle files and texts: one row a document, its cues an array of (inicio, fin, texto).

All parsing is array functions on the row that holds the file, so it needs no shuffle however many files there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bare_word, clean_line, let, running, seconds, squeeze, trimmed, word_count, words

CUES = "array<struct<inicio:double,fin:double,texto:string>>"
# Thresholds of the overlap repair and of estimated times.
MIN_OVERLAP, TAIL = 2, 60
ROLLING_WORDS, ROLLING_PAIRS, ROLLING_SHARE = 4, 4, 0.3
WORDS_A_SECOND, MIN_DURATION, MIN_MARKS = 2.5, 1.0, 3
PARSER_VERSION = 2
#: Words up to which an overlap is sought by trying each length.
FEW = 64

# How time lines and time marks are written.
_T = r"(?:\d{1,2}:)?\d{1,2}:\d{2}[.,]\d{1,3}"
TIMES = rf"({_T})\s*-->\s*({_T})"
MARKED = r"^\s*[\[(]?((?:\d{1,2}:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?)[\])]?\s*[-–:]?\s*(.+)$"

# File kinds by extension.
MEDIA = "mp3 wav m4a mp4 webm ogg flac mkv mov aac opus".split()
SUBTITLES = "srt vtt".split()
TEXTS = "txt md".split()


def is_url(entry: Column) -> Column:
    return trimmed(entry).rlike("(?i)^https?://")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^./\\]\.([^./\\]*)$", 1))


def entry_kind(entry: Column) -> Column:
    """url, medio, subtitulos or texto; null for what isn't supported."""
    ext = extension(entry)
    return F.when(is_url(entry), "url").when(ext.isin(MEDIA), "medio").when(ext.isin(SUBTITLES), "subtitulos").when(ext.isin(TEXTS), "texto")


def _no_repeats(lines: Column) -> Column:
    return let(lines, lambda own: F.filter(own, lambda x, i: (i == 0) | (x != F.get(own, i - 1))))


def _block_cue(block: Column) -> Column:
    def cue(lines: Column, at: Column) -> Column:
        head = F.get(lines, (at - 1).cast("int"))
        body = F.filter(F.transform(F.slice(lines, (at + 1).cast("int"), F.size(lines)), clean_line), lambda x: F.length(x) > 0)
        start, end = seconds(F.regexp_extract(head, TIMES, 1)), seconds(F.regexp_extract(head, TIMES, 2))
        return F.when(at > 0, F.struct(start.alias("inicio"), end.alias("fin"), squeeze(F.array_join(_no_repeats(body), " ")).alias("texto")))

    stripped = F.transform(F.split(block, "\n"), lambda x: F.regexp_replace(x, "(?U)\\s+$", ""))
    return let(stripped, lambda lines: let(F.array_position(F.transform(lines, lambda x: x.rlike(TIMES)), True), lambda at: cue(lines, at)))


def merge_equal(cues: Column) -> Column:
    """Cues in a row with one text become one: start of the first, largest end; an end is never before its start."""

    def merged(own: Column) -> Column:
        n = F.size(own)
        every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(every, lambda i: (i == 0) | (F.get(own, i).texto != F.get(own, i - 1).texto))

        def one(run: Column) -> Column:
            first = F.get(run, F.lit(0))
            return F.struct(first.inicio.alias("inicio"), F.greatest(first.inicio, F.array_max(F.transform(run, lambda c: c.fin))).alias("fin"), first.texto.alias("texto"))

        return let(starts, lambda at: F.transform(at, lambda i, k: let(F.slice(own, i + 1, F.coalesce(F.get(at, k + 1), n) - i), one)))

    return let(cues, merged)


def overlap_length(before: Column, after: Column) -> Column:
    """How many words at the end of before open after, compared bare; 0 below two."""
    return overlap_of(F.transform(words(before), bare_word), F.transform(words(after), bare_word))


def overlap_of(a: Column, b: Column) -> Column:
    """Overlap of two arrays of bare words: the longest end of a that opens b. Up to FEW words every length is tried, beyond that sums tell which may fit."""
    few = lambda x, y: F.least(F.size(x), F.size(y)) <= FEW
    return let(a, lambda x: let(b, lambda y: F.when(few(x, y), _overlap_of_few(x, y)).otherwise(_overlap_of_many(x, y))))


def _overlap_of_few(x: Column, y: Column) -> Column:
    m = F.least(F.size(x), F.size(y))
    lengths = F.when(m >= MIN_OVERLAP, F.sequence(m, F.lit(MIN_OVERLAP), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    # the last word of an overlap ends x, so only places of that word in y are tried in full
    ends = F.filter(lengths, lambda n: (F.get(y, n - 1) == F.get(x, F.size(x) - 1)) & (F.slice(x, F.size(x) - n + 1, n) == F.slice(y, F.lit(1), n)))
    return F.coalesce(F.get(ends, F.lit(0)), F.lit(0))


def _overlap_of_many(a: Column, b: Column) -> Column:
    """The same in steps that are linear in the words, whatever repeats in them.

    Two running sums over hashes of the words, one of them weighted by place, tell for every length whether the end and the beginning can be equal;
    those lengths are compared word by word from the longest on, until one is. Linear in the words, whatever repeats in them.
    """
    some = F.array().cast("array<int>")

    def found(x: Column, y: Column) -> Column:
        m = F.least(F.size(x), F.size(y))
        hashed = lambda w: F.transform(w, lambda t: F.xxhash64(t).bitwiseAND((1 << 24) - 1))
        tail, head = F.slice(x, F.size(x) - m + 1, m), F.slice(y, F.lit(1), m)

        def tried(h: Column, g: Column) -> Column:
            placed = lambda own: F.transform(own, lambda v, i: v * i)
            sums = lambda own, body: let(running(F.array_append(own, F.lit(0).cast("bigint")), F.lit(0).cast("bigint"), "bigint"), body)
            plain = lambda hs: sums(g, lambda gs: sums(placed(h), lambda hp: sums(placed(g), lambda gp: matched(hs, gs, hp, gp))))
            return sums(h, plain)

        def matched(hs: Column, gs: Column, hp: Column, gp: Column) -> Column:
            lengths = F.when(m >= MIN_OVERLAP, F.sequence(m, F.lit(MIN_OVERLAP), F.lit(-1))).otherwise(some)
            ends = lambda n: F.get(hs, m) - F.get(hs, m - n)
            # places of the end count from its own first word
            placed = lambda n: F.get(hp, m) - F.get(hp, m - n) - (m - n) * ends(n)
            may = F.filter(lengths, lambda n: (ends(n) == F.get(gs, n)) & (placed(n) == F.get(gp, n)))
            first = lambda acc, n: F.when(acc > 0, acc).when(F.slice(tail, m - n + 1, n) == F.slice(head, F.lit(1), n), n).otherwise(0)
            return F.aggregate(may, F.lit(0), first)

        return F.when(m < MIN_OVERLAP, 0).otherwise(let(hashed(tail), lambda h: let(hashed(head), lambda g: tried(h, g))))

    return let(a, lambda x: let(b, lambda y: F.coalesce(found(x, y), F.lit(0))))


def looks_rolling(cues: Column) -> Column:
    """Whether over 0.3 of the neighbouring cues of four words or more overlap, with four such pairs at least."""

    def judged(said: Column) -> Column:
        n = F.size(said)
        pairs = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
        long = F.filter(pairs, lambda i: (F.size(F.get(said, i - 1)) >= ROLLING_WORDS) & (F.size(F.get(said, i)) >= ROLLING_WORDS))
        hits = lambda own: F.size(F.filter(own, lambda i: overlap_of(F.get(said, i - 1), F.get(said, i)) > 0))
        return let(long, lambda own: (F.size(own) >= ROLLING_PAIRS) & (hits(own) / F.size(own) > ROLLING_SHARE))

    return let(F.transform(cues, lambda c: F.transform(F.split(c.texto, "(?U)\\s+"), bare_word)), judged)


def without_overlap(cues: Column) -> Column:
    """Each cue without the words that end what was said before; a cue that adds nothing moves the end of the one before."""
    start = F.struct(F.array().cast(CUES).alias("out"), F.array().cast("array<string>").alias("tail"))

    def step(acc: Column, cue: Column) -> Column:
        def nothing_new(_: Column) -> Column:
            before = F.slice(acc.out, F.lit(1), F.greatest(F.size(acc.out) - 1, F.lit(0)))
            last = F.get(acc.out, F.size(acc.out) - 1)
            moved = F.array(F.struct(last.inicio.alias("inicio"), F.greatest(last.fin, cue.fin).alias("fin"), last.texto.alias("texto")))
            return F.struct(F.concat(before, F.when(F.size(acc.out) > 0, moved).otherwise(F.array().cast(CUES))).alias("out"), acc.tail.alias("tail"))

        def more(rest: Column) -> Column:
            one = F.struct(cue.inicio.alias("inicio"), cue.fin.alias("fin"), F.array_join(rest, " ").alias("texto"))
            said = F.concat(acc.tail, F.transform(rest, bare_word))
            tail = let(said, lambda t: F.slice(t, F.greatest(F.lit(1), F.size(t) - TAIL + 1), TAIL))
            return F.struct(F.array_append(acc.out, one).alias("out"), tail.alias("tail"))

        def added(own: Column) -> Column:
            n = let(F.transform(F.slice(own, 1, TAIL), bare_word), lambda y: _overlap_of_few(acc.tail, y))  # no overlap is longer than the tail
            return let(F.slice(own, n + 1, F.greatest(F.size(own), F.lit(1))), lambda rest: F.when(F.size(rest) == 0, nothing_new(rest)).otherwise(more(rest)))

        return let(words(cue.texto), added)

    return F.aggregate(cues, start, step, lambda acc: acc.out)


def subtitle_cues(content: Column) -> Column:
    """Cues of an SRT or WebVTT file."""
    text = F.replace(F.regexp_replace(content, "^\\ufeff", ""), F.lit("\r\n"), F.lit("\n"))
    found = F.filter(F.transform(F.split(text, "\n{2,}"), _block_cue), lambda c: c.isNotNull() & (c.texto != ""))
    return merge_equal(found.cast(CUES))


def repaired(cues: Column) -> Column:
    return let(cues, lambda own: F.when(looks_rolling(own), without_overlap(own)).otherwise(own))


def _duration(text: Column) -> Column:
    return F.greatest(F.lit(MIN_DURATION), F.size(F.split(text, "(?U)\\s+")) / F.lit(WORDS_A_SECOND))


def plain_cues(content: Column) -> Column:
    """Paragraphs with times estimated from the number of words."""
    text = F.replace(content, F.lit("\r\n"), F.lit("\n"))
    parts = F.filter(F.transform(F.split(text, "\n{2,}"), squeeze), lambda p: p != "")

    def timed(own: Column) -> Column:
        one = lambda now: F.transform(own, lambda p, i: F.struct(F.get(now, i).alias("inicio"), (F.get(now, i) + _duration(p)).alias("fin"), p.alias("texto")))
        return let(running(F.transform(own, _duration), F.lit(0.0), "double"), one)

    return let(parts, timed)


def marked_cues(content: Column) -> Column:
    """Lines like ``[00:01:23] text``; none unless there are three."""
    lines = F.split(F.replace(content, F.lit("\r\n"), F.lit("\n")), "\n")
    marked = F.transform(F.filter(lines, lambda x: x.rlike(MARKED)), lambda x: F.struct(seconds(F.regexp_extract(x, MARKED, 1)).alias("inicio"), clean_line(F.regexp_extract(x, MARKED, 2)).alias("texto")))

    def timed(found: Column) -> Column:
        cues = F.transform(found, lambda c, i: F.struct(c.inicio.alias("inicio"), F.coalesce(F.get(found, i + 1).inicio, c.inicio + _duration(c.texto)).alias("fin"), c.texto.alias("texto")))
        return F.when(F.size(found) >= MIN_MARKS, cues).otherwise(F.array().cast(CUES))

    return let(F.filter(marked, lambda c: c.texto != ""), timed)


def asr_cues(chunks: Column, duration: Column, text: Column) -> Column:
    """Cues from recogniser chunks (desde, hasta, texto): a missing end is the next start or five seconds on; without chunks one cue of the whole."""
    some = F.filter(F.transform(chunks, lambda c: F.struct(c.desde.alias("desde"), c.hasta.alias("hasta"), squeeze(c.texto).alias("texto"))), lambda c: c.texto != "")
    whole = F.when(squeeze(text) != "", F.array(F.struct(F.lit(0.0).alias("inicio"), duration.alias("fin"), squeeze(text).alias("texto")))).otherwise(F.array().cast(CUES))

    def timed(kept: Column) -> Column:
        def cue(c: Column, i: Column) -> Column:
            begin = F.coalesce(c.desde, F.lit(0.0))
            end = F.coalesce(c.hasta, F.get(kept, i + 1).desde, F.least(duration, begin + 5))
            return F.struct(begin.alias("inicio"), F.greatest(begin, end).alias("fin"), c.texto.alias("texto"))

        return F.when(F.size(kept) > 0, F.transform(kept, cue)).otherwise(whole)

    return let(some, timed)


def asr_windows(duration: Column) -> Column:
    """Windows of a recogniser that reads 30 seconds and moves by 20."""
    return F.greatest(F.lit(1), F.ceil(duration / 20)).cast("bigint")


def transcripts(files: DataFrame) -> DataFrame:
    """(doc_id, path, content) -> (doc_id, motor, timestamps_reales, segmentos, problema); problema tells why a file has no cues."""
    ext = extension(F.col("path"))
    is_sub, is_text = ext.isin(SUBTITLES), ext.isin(TEXTS)
    none = F.array().cast(CUES)
    step = files.select("doc_id", "path", ext.alias("ext"), is_sub.alias("sub"), is_text.alias("txt"), F.when(is_sub, subtitle_cues(F.col("content"))).alias("subs"), F.when(is_text, marked_cues(F.col("content"))).alias("marks"), "content")
    by_mark = F.coalesce(F.size("marks") > 0, F.lit(False))
    step = step.select("*", by_mark.alias("marked"), F.when(F.col("sub"), repaired(F.col("subs"))).when(by_mark, F.col("marks")).when(F.col("txt"), plain_cues(F.col("content"))).otherwise(none).alias("segmentos"))
    empty, known = F.size("segmentos") == 0, F.col("sub") | F.col("txt")
    said = f"formato sin lector; se leen {', '.join(SUBTITLES + TEXTS)}"
    media = f"audio o video: primero hay que transcribirlo; se leen {', '.join(SUBTITLES + TEXTS)}"
    problem = F.when(F.col("ext").isin(MEDIA), media).when(~known, said).when(empty & F.col("sub"), "subtitulo sin un solo bloque con tiempos").when(empty, "esta vacio")
    motor = F.when(F.col("sub"), F.col("ext")).when(F.col("marked"), "texto-con-marcas").when(F.col("txt"), "texto").when(F.col("ext").isin(MEDIA), "medio")
    return step.select("doc_id", "path", motor.alias("motor"), (F.col("sub") | F.col("marked")).alias("timestamps_reales"), "segmentos", problem.alias("problema"), F.lit(PARSER_VERSION).alias("version_parseo"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files under path as (doc_id, path, content); doc_id is the key of name and bytes."""
    from ..functions.text import file_key

    files = spark.read.format("binaryFile").option("pathGlobFilter", "{*.[sS][rR][tT],*.[vV][tT][tT],*.[tT][xX][tT],*.[mM][dD]}").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(file_key(name, F.col("content")).alias("doc_id"), name.alias("path"), F.decode("content", "UTF-8").alias("content"))


def finished_files(files: DataFrame, prefix: str) -> DataFrame:
    """Rows (path, length) of finished downloads: the prefix, over 1024 bytes, no leftovers."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(name.startswith(prefix) & (F.col("length") > 1024) & ~name.rlike(r"(?i)\.(part|ytdl|temp|tmp|download)$"))


def root(lang: Column) -> Column:
    return F.lower(F.get(F.split(lang, "-"), F.lit(0)))


def original_track(lang: Column, published: Column, automatic: Column, forced_asr: Column | None = None) -> Column:
    """struct(lang, auto) of the track in the original language, never a translation; null if there is none."""
    own = root(lang)
    first = lambda arr, ok: F.get(F.filter(arr, ok), F.lit(0))
    by_author = F.when(lang.isNotNull() & (lang != ""), first(published, lambda x: root(x) == own)).otherwise(F.coalesce(first(published, lambda x: root(x) != "und"), F.get(published, F.lit(0))))
    if forced_asr is not None:
        by_author = F.when(~forced_asr, by_author)
    by_machine = F.coalesce(first(automatic, lambda x: F.lower(x).endswith("-orig")), F.when(lang.isNotNull() & (lang != ""), first(automatic, lambda x: root(x) == own)))
    return F.when(by_author.isNotNull(), F.struct(by_author.alias("lang"), F.lit(False).alias("auto"))).when(by_machine.isNotNull(), F.struct(by_machine.alias("lang"), F.lit(True).alias("auto")))


def link_tracks(json: Column) -> Column:
    """struct(idioma, publicados, automaticos) from a link's metadata as JSON; null if it can't be read."""
    kind = "language string, subtitles map<string,string>, automatic_captions map<string,string>"
    meta = F.from_json(json, kind)
    keys = lambda c: F.coalesce(F.map_keys(c), F.array().cast("array<string>"))
    return F.when(F.try_parse_json(json).isNotNull(), F.struct(meta.language.alias("idioma"), keys(meta.subtitles).alias("publicados"), keys(meta.automatic_captions).alias("automaticos")))


def download_problem(output: Column, code: Column) -> Column:
    """Kind of failure of a subtitle download, from the tool's output."""
    s = F.lower(output)
    first_error = F.get(F.filter(F.transform(F.split(output, "\n"), F.trim), lambda x: F.upper(x).startswith(F.lit("ERROR"))), F.lit(0))
    return (
        F.when(s.contains("403") | s.contains("forbidden"), "tool out of date (HTTP 403)")
        .when(s.contains("sign in to confirm") | s.contains("not a bot"), "sign-in required")
        .when(s.contains("429") | s.contains("too many requests"), "rate limited (HTTP 429)")
        .when(s.contains("video unavailable") | s.contains("private video"), "not publicly available")
        .when(s.contains("unsupported url"), "unsupported URL")
        .when(s.contains("no subtitles"), "no subtitles in the original language")
        .otherwise(F.coalesce(F.substring(first_error, 1, 200), F.concat(F.lit("exit code "), code.cast("string"))))
    )


def mono(samples: Column, channels: int) -> Column:
    """Interleaved samples averaged over their channels."""
    frames = F.floor(F.size(samples) / channels).cast("int")
    at = F.when(frames > 0, F.sequence(F.lit(0), frames - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.aggregate(F.slice(samples, i * channels + 1, channels), F.lit(0.0), lambda s, x: s + x) / channels)
