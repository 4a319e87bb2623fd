"""Summaries of runs, recall of the gate, and quality of verdicts against control sets. Empty denominators give null, but for the two that the
summary defines as 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fixed

ENOUGH_RECALL = 0.95


def summary(results: DataFrame, by: list[str], threshold: float = 0.7) -> DataFrame:
    """Counts and mean score of each group of by: one aggregation with partial sums."""
    score = F.col("evaluacion.score")
    done = F.col("evaluada") & F.col("evaluacion").isNotNull()
    return results.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if("preseleccionada").alias("preseleccionados"),
        F.count_if(done).alias("evaluados"),
        F.count_if(F.col("preseleccionada") & ~F.col("evaluada")).alias("fallidos"),
        F.count_if(done & (score >= threshold)).alias("sobre_umbral"),
        F.coalesce(fixed(F.avg(F.when(done, score)), 3), F.lit(0.0)).alias("score_promedio"),
    )


def language_histogram(results: DataFrame, by: list[str]) -> DataFrame:
    """by and a map from language name to number of claims."""
    counts = results.groupBy(*by, "idioma_nombre").agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("idioma_nombre", "n")))).alias("idiomas"))


def performance(results: DataFrame, by: list[str]) -> DataFrame:
    """by and what evaluation took: calls, load time, tokens, generation time, total time, cache hits and tokens a second. A text asked once counts once a
    group."""
    once = results.where("preseleccionada").groupBy(*by, "clave").agg(*(F.max(c).alias(c) for c in ("llamadas", "ms_carga", "tokens", "ms_generacion", "ms_llm")), F.count_if("desde_cache").alias("hits"))
    total = once.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("llamadas", "ms_carga", "tokens", "ms_generacion", "ms_llm")), F.sum("hits").alias("desde_cache"))
    rate = F.coalesce(fixed(F.try_divide(F.col("tokens"), F.col("ms_generacion")) * 1000, 1), F.lit(0.0))
    return total.select(*by, F.struct("llamadas", "ms_carga", "tokens", "ms_generacion", "ms_llm", "desde_cache", rate.alias("tokens_por_segundo")).alias("rendimiento"))


def full_summary(results: DataFrame, by: list[str], threshold: float = 0.7) -> DataFrame:
    """summary with idiomas, the number of claims by language name, and rendimiento, what evaluation took; null where nothing was selected."""
    return summary(results, by, threshold).join(language_histogram(results, by), by, "left").join(performance(results, by), by, "left")


def gate_recall(results: DataFrame, by: list[str], threshold: float = 0.7) -> DataFrame:
    """What the gate would have caught of the high scores of an ungated run, and what it would have saved. Columns: marcadores, evaluada, score."""
    marked, high = F.size("marcadores") > 0, F.col("evaluada") & (F.col("score") >= threshold)
    out = results.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if("evaluada").alias("evaluadas"),
        F.count_if(marked).alias("con_conector"),
        F.count_if(~marked).alias("sin_conector"),
        F.count_if(high).alias("altas"),
        F.count_if(high & marked).alias("capturadas"),
        F.count_if(high & ~marked).alias("perdidas"),
    )
    return out.select("*", F.try_divide("capturadas", "altas").alias("recall"), F.coalesce(F.try_divide("sin_conector", "total"), F.lit(0.0)).alias("ahorro"))


def recall_verdict(recall: Column) -> Column:
    """ok, mejorable or sin_altas."""
    return F.when(recall.isNull(), "sin_altas").when(recall >= ENOUGH_RECALL, "ok").otherwise("mejorable")


def recall_text(recall: Column, high: Column, caught: Column) -> Column:
    """What a recall says of the gate, in words."""
    share = F.concat(F.floor(recall * 100 + 0.5).cast("bigint").cast("string"), F.lit(" %"))
    counts = F.concat(caught.cast("string"), F.lit(" de "), high.cast("string"))
    return (
        F.when(recall.isNull(), F.lit("sin puntajes altos: la sensibilidad del prefiltro no se puede medir aqui"))
        .when(recall >= ENOUGH_RECALL, F.concat(F.lit("el prefiltro retiene "), counts, F.lit(" puntajes altos ("), share, F.lit("): se puede usar")))
        .otherwise(F.concat(F.lit("el prefiltro solo retiene "), counts, F.lit(" puntajes altos ("), share, F.lit("): faltan marcadores")))
    )


def missed(results: DataFrame, threshold: float = 0.7) -> DataFrame:
    """High scores without a marker, the highest first, ties in document order."""
    lost = results.where(F.col("evaluada") & (F.col("score") >= threshold) & (F.size("marcadores") == 0))
    return lost.orderBy(F.desc("score"), "doc_id", "indice")


def binary_counts(rows: DataFrame, by: list[str], expected: str = "esperado", obtained: str = "obtenido") -> DataFrame:
    """vp, vn, fp, fn of boolean columns and what follows from them."""
    e, o = F.col(expected), F.col(obtained)
    c = rows.groupBy(*by).agg(F.count_if(e & o).alias("vp"), F.count_if(~e & ~o).alias("vn"), F.count_if(~e & o).alias("fp"), F.count_if(e & ~o).alias("fn"))
    return with_rates(c)


def with_rates(counts: DataFrame) -> DataFrame:
    vp, vn, fp, fn = (F.col(x) for x in ("vp", "vn", "fp", "fn"))
    out = counts.select("*", (vp + vn + fp + fn).alias("total"), F.try_divide(vp + vn, vp + vn + fp + fn).alias("exactitud"), F.try_divide(vp, vp + fp).alias("precision"), F.try_divide(vp, vp + fn).alias("sensibilidad"))
    p, r = F.col("precision"), F.col("sensibilidad")
    return out.withColumn("f1", F.try_divide(2 * p * r, p + r))


def confusion(rows: DataFrame, labels: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, esperado, obtenido, n) over the known labels; pairs with any other label don't count."""
    return rows.where(F.col("esperado").isin(labels) & F.col("obtenido").isin(labels)).groupBy(*(by or []), "esperado", "obtenido").agg(F.count("*").alias("n"))


def confusion_table(rows: DataFrame, labels: list[str]) -> DataFrame:
    """(esperado, a column for each label): the confusion matrix as a table with a row for each label, pairs that don't occur as 0."""
    frame = rows.sparkSession.createDataFrame([(k, x) for k, x in enumerate(labels)], "orden int, esperado string")
    cells = confusion(rows, labels).groupBy("esperado").pivot("obtenido", labels).agg(F.sum("n"))
    return frame.join(cells, "esperado", "left").select("orden", "esperado", *(F.coalesce(F.col(f"`{x}`"), F.lit(0)).alias(x) for x in labels))


def confusion_accuracy(matrix: DataFrame, by: list[str] | None = None) -> DataFrame:
    return matrix.groupBy(*(by or [])).agg(F.sum("n").alias("total"), F.try_divide(F.sum(F.when(F.col("esperado") == F.col("obtenido"), F.col("n")).otherwise(0)), F.sum("n")).alias("exactitud"))


def score_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """Share of score within [score_min, score_max] and mean distance from the middle."""
    inside = F.col("score").between(F.col("score_min"), F.col("score_max"))
    distance = F.abs(F.col("score") - (F.col("score_min") + F.col("score_max")) / 2)
    return rows.groupBy(*by).agg(F.count("score").alias("casos"), F.avg(inside.cast("double")).alias("dentro_del_rango"), F.avg(distance).alias("error_medio"))


def compared(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """(modelo, id, campo, esperado, obtenido): a row for each expected field of each case, strings, difficult cases left out."""
    long = cases.where(~F.col("dificil")).select("id", F.explode("campos").alias("campo", "esperado"))
    return predictions.select("modelo", "id", F.col("campos").alias("_c")).join(long, "id").select("modelo", "id", "campo", "esperado", F.element_at("_c", F.col("campo")).alias("obtenido"))


def field_kinds(pairs: DataFrame) -> DataFrame:
    """(campo, binario, etiquetas): binary if every expected value is a boolean, else its sorted labels."""
    agg = pairs.groupBy("campo").agg(F.bool_and(F.col("esperado").isin("true", "false")).alias("binario"), F.array_sort(F.collect_set("esperado")).alias("etiquetas"))
    return agg


def field_accuracy(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("modelo", "campo").agg(F.avg(F.coalesce(F.col("esperado") == F.col("obtenido"), F.lit(False)).cast("double")).alias("exactitud"))


def all_fields(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """(modelo, casos, todos): share of cases with every field right and the score in range."""
    pairs = compared(cases, predictions).groupBy("modelo", "id").agg(F.bool_and(F.coalesce(F.col("esperado") == F.col("obtenido"), F.lit(False))).alias("campos_bien"))
    scored = predictions.join(cases.select("id", "score_min", "score_max"), "id").select("modelo", "id", F.coalesce(F.col("score").between(F.col("score_min"), F.col("score_max")), F.lit(False)).alias("score_bien"))
    both = pairs.join(scored, ["modelo", "id"])
    return both.groupBy("modelo").agg(F.count("*").alias("casos"), F.avg((F.col("campos_bien") & F.col("score_bien")).cast("double")).alias("todos"))


def compliance(predictions: DataFrame, repeats: DataFrame) -> DataFrame:
    """(modelo, casos, esquema_ok, deterministico): valid answers, and whether a repeated case gave the same answer."""
    valid = predictions.groupBy("modelo").agg(F.count("*").alias("casos"), F.count_if("ok").alias("esquema_ok"))
    same = repeats.groupBy("modelo").agg((F.count_distinct("respuesta") == 1).alias("deterministico"))
    return valid.join(same, "modelo", "left").select("modelo", "casos", "esquema_ok", F.coalesce("deterministico", F.lit(False)).alias("deterministico"))


def comparison(accuracy: DataFrame, fields: list[str]) -> DataFrame:
    """A row a model, a column a field."""
    return accuracy.groupBy("modelo").pivot("campo", fields).agg(F.first("exactitud"))


def best_and_fastest(models: DataFrame) -> DataFrame:
    """(mejor, rapido) of the models that meet the schema and repeat themselves."""
    fit = models.where((F.col("esquema_ok") == F.col("casos")) & F.col("deterministico"))
    best = F.max_by("modelo", F.struct(F.col("todos"), F.col("modelo")))
    fast = F.min_by("modelo", F.struct(F.col("ms_por_afirmacion"), F.col("modelo")))
    return fit.agg(best.alias("mejor"), fast.alias("rapido"))


def benchmark(calls: DataFrame, by: list[str]) -> DataFrame:
    """Mean time, unweighted mean speed, mean tokens, and minutes for a hundred claims. Columns: ms, tok_s, tokens."""
    out = calls.groupBy(*by).agg(F.avg("ms").alias("ms_medio"), F.avg("tok_s").alias("tok_s_medio"), F.avg("tokens").alias("tokens_medio"))
    return out.withColumn("minutos_100", F.col("ms_medio") * 100 / 60000)


def latency(calls: DataFrame, by: list[str]) -> DataFrame:
    """Where the time of calls after the first goes. Columns: n, ms_total, ms_prompt, ms_generacion."""
    out = calls.where("n > 1").groupBy(*by).agg(*(F.avg(c).alias(c) for c in ("ms_total", "ms_prompt", "ms_generacion")))
    share = lambda c: F.try_divide(c, F.col("ms_total"))
    rest = F.col("ms_total") - F.col("ms_prompt") - F.col("ms_generacion")
    return out.select("*", rest.alias("ms_resto"), share(F.col("ms_prompt")).alias("parte_prompt"), share(F.col("ms_generacion")).alias("parte_generacion"), share(rest).alias("parte_resto"))


def monotonic(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """(by, monotono): whether value never falls along order."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(order))
    return rows.select(by, F.coalesce(F.col(value) >= before, F.lit(True)).alias("_ok")).groupBy(by).agg(F.bool_and("_ok").alias("monotono"))


def where_it_runs(size: Column, in_gpu: Column) -> Column:
    share = F.when(size > 0, F.floor(in_gpu / size * 100 + 0.5)).otherwise(0).cast("bigint")
    return F.when(size.isNull(), "desconocido").when(share >= 95, "gpu").when(share <= 5, "cpu").otherwise(F.concat(F.lit("mixto ("), share.cast("string"), F.lit("% GPU)")))


def same_model(a: Column, b: Column) -> Column:
    full = lambda m: F.when(m.contains(":"), m).otherwise(F.concat(m, F.lit(":latest")))
    return full(a) == full(b)
