"""Command line: ``python -m locutio analizar PATH --grabado ANSWERS`` runs recorded answers over the files under PATH, ``--servidor URL`` asks a model server.

Defaults come from LOCUTIO_MODELO, _UMBRAL, _REINTENTOS, _CONCURRENCIA, _SERVIDOR, _PLAZO and _SALIDA."""

from __future__ import annotations

import argparse
import sys

from .operators.served import DEFAULT_URL, STATE_TIMEOUT, TIMEOUT, Served, Server, setting


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="locutio")
    p.add_argument("accion", choices=["analizar", "medir-prefiltro", "criterios", "verificar-entorno"], nargs="?", default="analizar")
    p.add_argument("entrada", nargs="?")
    p.add_argument("-m", "--modelo", default=setting("MODELO", "qwen2.5:3b"))
    p.add_argument("-u", "--umbral", type=float, default=float(setting("UMBRAL", "0.7")))
    p.add_argument("--criterio", default="framing-causal")
    p.add_argument("--idioma")
    p.add_argument("--limite", type=int)
    p.add_argument("--reintentos", type=int, default=int(setting("REINTENTOS", "2")))
    p.add_argument("--concurrencia", type=int, default=int(setting("CONCURRENCIA", "1")))
    p.add_argument("--sin-prefiltro", action="store_true")
    p.add_argument("--sin-cache", action="store_true")
    p.add_argument("--forzar", action="store_true", help="parse and ask again, whatever is stored")
    p.add_argument("--grabado", help="parquet of recorded answers (clave, intento, texto)")
    p.add_argument("--servidor", nargs="?", const=setting("SERVIDOR", DEFAULT_URL), help="ask the model server at this URL (default: the environment's, or this machine's)")
    p.add_argument("--plazo", type=float, default=float(setting("PLAZO", str(TIMEOUT))), help="seconds that a call may take")
    p.add_argument("--salida", default=setting("SALIDA", "salida"))
    p.add_argument("--reporte", action="store_true", help="also write a page and a CSV file for each document")
    return p


def main(argv: list[str] | None = None) -> int:
    """0: done; 1: the run failed; 2: wrong arguments."""
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    if a.accion == "verificar-entorno":
        state = Server(a.servidor or setting("SERVIDOR", DEFAULT_URL), STATE_TIMEOUT).state(a.modelo)
        print("\n".join(f"{k}: {v}" for k, v in state.items()))
        return 0 if state["tiene_modelo"] else 1
    from pyspark.sql import SparkSession

    from .criteria.registry import catalog, criterion
    from .operators.evaluate import Replay
    from .plans.run import Options, read_cache, run
    from .sources.subtitles import read_files

    spark = SparkSession.builder.appName("locutio").getOrCreate()
    if a.accion == "criterios":
        catalog(spark).show(truncate=False)
        return 0
    if not a.entrada or not (a.grabado or a.servidor):
        print("faltan la entrada, o --grabado o --servidor", file=sys.stderr)
        return 2
    try:
        options = Options(a.criterio, a.modelo, a.umbral, a.reintentos, a.concurrencia, a.idioma, not (a.sin_prefiltro or a.accion == "medir-prefiltro"), a.limite)
        criterion(a.criterio)
        options.write_cache, options.force, options.store = not a.sin_cache, a.forzar, a.salida
        options.cache = None if a.sin_cache else read_cache(spark, a.salida, a.criterio)
    except (ValueError, KeyError) as e:
        print(e, file=sys.stderr)
        return 2
    try:
        backend = Served(a.modelo, a.servidor, 1, a.concurrencia, a.plazo) if a.servidor else Replay(spark.read.parquet(a.grabado))
        done = run(read_files(spark, a.entrada), backend, options)
        done.write(a.salida)
        if a.reporte:
            done.report(a.salida)
        (done.recall() if a.accion == "medir-prefiltro" else done.summary).show(truncate=False)
    except Exception as e:  # noqa: BLE001  told to the caller by the exit code
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
