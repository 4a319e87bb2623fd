"""A backend that asks a model server over HTTP: a few kept connections in each task, calls in flight bounded, failures told apart by kind."""

from __future__ import annotations

import http.client
import json
import os
import threading
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluate import ANSWER, PAUSE

# Where such a server listens, the paths of its interface, and how it is asked.
DEFAULT_URL = "http://127.0.0.1:11434"
GENERATE, MODELS, VERSION, LOADED = "/api/generate", "/api/tags", "/api/version", "/api/ps"
ASKED = {"stream": False, "format": "json", "options": {"temperature": 0.0, "num_ctx": 2048, "num_predict": 250}}
#: Seconds that a call and a question about the server's state may take.
TIMEOUT, STATE_TIMEOUT = 120.0, 5.0


def setting(name: str, otherwise: str) -> str:
    """The environment's LOCUTIO_<name>, or otherwise."""
    return os.environ.get(f"LOCUTIO_{name}") or otherwise


class Refused(Exception):
    """A call that gave no answer; kind is one of the keys of ADVICE."""

    def __init__(self, kind: str, said: str) -> None:
        super().__init__(f"{kind}: {said}" if said else kind)
        self.kind = kind


#: What to do about each kind of failure.
ADVICE = {
    "sin conexion": "no responde nadie en esa direccion: hay que arrancar el servidor o corregir la URL",
    "tiempo agotado": "la llamada tardo demasiado: mas plazo, menos llamadas a la vez o un modelo menor",
    "sin memoria": "el modelo no cabe en la memoria del servidor: uno menor o mas cuantizado",
    "sin ejecutor": "al servidor le falta el programa que ejecuta modelos: hay que reinstalarlo",
    "sin modelo": "el servidor no tiene ese modelo: hay que descargarlo",
    "rechazada": "el servidor rechazo la llamada",
    "ilegible": "la respuesta no es el JSON de la interfaz",
}


def classified(status: int, body: str) -> str:
    """The kind of failure of a response that isn't a success."""
    low = body.lower()
    if "llama-server" in low or "binary not found" in low:
        return "sin ejecutor"
    if "out of memory" in low or "insufficient memory" in low:
        return "sin memoria"
    return "sin modelo" if status == 404 and "model" in low else "rechazada"


def advice(failure: Column) -> Column:
    """What to do about a failure's text; null for one of another kind."""
    kind = F.get(F.split(failure, ": "), F.lit(0))
    return F.element_at(F.create_map(*(F.lit(x) for pair in ADVICE.items() for x in pair)), kind)


class Server:
    """One server and a kept connection for each thread that asks it."""

    def __init__(self, url: str, timeout: float) -> None:
        parts = urlsplit(url)
        self.host, self.port, self.tls, self.prefix, self.timeout = parts.hostname or "", parts.port, parts.scheme == "https", parts.path.rstrip("/"), timeout
        self._own = threading.local()

    def _connection(self) -> http.client.HTTPConnection:
        if getattr(self._own, "connection", None) is None:
            kind = http.client.HTTPSConnection if self.tls else http.client.HTTPConnection
            self._own.connection = kind(self.host, self.port, timeout=self.timeout)
        return self._own.connection

    def _drop(self) -> None:
        if getattr(self._own, "connection", None) is not None:
            self._own.connection.close()
            self._own.connection = None

    def ask(self, path: str, body: dict | None = None) -> dict:
        """The JSON object that the server answers with."""
        data = None if body is None else json.dumps(body).encode()
        for again in (True, False):
            kept = getattr(self._own, "connection", None) is not None
            try:
                c = self._connection()
                c.request("GET" if data is None else "POST", self.prefix + path, data, {"Content-Type": "application/json"})
                response = c.getresponse()
                status, raw = response.status, response.read()
                break
            except TimeoutError as e:
                self._drop()
                raise Refused("tiempo agotado", str(e)) from e
            except (OSError, http.client.HTTPException) as e:
                self._drop()
                # a kept connection may have been closed meanwhile, which says nothing of the server
                if not (kept and again):
                    raise Refused("sin conexion", str(e)) from e
        text = raw.decode("utf-8", "replace")
        if not 200 <= status < 300:
            raise Refused(classified(status, text), f"HTTP {status} {text[:300]}")
        try:
            found = json.loads(text)
        except ValueError as e:
            raise Refused("ilegible", text[:300]) from e
        if not isinstance(found, dict):
            raise Refused("ilegible", text[:300])
        if found.get("error"):
            raise Refused(classified(status, str(found["error"])), str(found["error"])[:300])
        return found

    def state(self, model: str | None = None) -> dict:
        """disponible, modelos, version, error, and whether model is there (a name without a tag is its latest)."""
        tagged = lambda name: name if ":" in name else f"{name}:latest"
        try:
            names = [m.get("name") or "" for m in self.ask(MODELS).get("models") or []]
        except Refused as e:
            return {"disponible": False, "modelos": [], "version": None, "error": str(e), "tiene_modelo": False}
        try:
            version = self.ask(VERSION).get("version")
        except Refused:
            version = None
        names = [n for n in names if n]
        return {"disponible": True, "modelos": names, "version": version, "error": None, "tiene_modelo": model is not None and tagged(model) in map(tagged, names)}


class Served:
    """A backend of a model server. tasks times in_flight calls run at once at most, each task on its own connections.

    A call that fails is its key's failure in that attempt and not the job's; the evaluation's later rounds ask again. Answers keep the order of their keys.
    """

    def __init__(self, model: str, url: str = DEFAULT_URL, tasks: int = 1, in_flight: int = 1, timeout: float = TIMEOUT, keep_alive: str = "15m") -> None:
        self.model, self.url, self.tasks, self.in_flight, self.timeout, self.keep_alive = model, url, tasks, in_flight, timeout, keep_alive

    def answers(self, asked: DataFrame, attempt: int) -> DataFrame:
        url, timeout, in_flight = self.url, self.timeout, self.in_flight
        body = {"model": self.model, "keep_alive": self.keep_alive, **ASKED}
        schema = pa.schema([("clave", pa.string()), ("texto", pa.string()), ("fallo", pa.string()), ("ms", pa.float64()), ("ms_carga", pa.float64()), ("ms_generacion", pa.float64()), ("tokens", pa.int64())])

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            server = Server(url, timeout)

            def one(row: tuple[str, str, str]) -> tuple:
                key, system, prompt = row
                began = time.perf_counter()
                try:
                    got = server.ask(GENERATE, {**body, "system": system, "prompt": prompt})
                except Refused as e:
                    time.sleep(PAUSE)
                    return key, None, str(e), 0.0, 0.0, 0.0, 0
                ms = lambda name: float(round((got.get(name) or 0) / 1e6))  # noqa: E731  the server tells nanoseconds
                return key, got.get("response") or "", None, round((time.perf_counter() - began) * 1000, 3), ms("load_duration"), ms("eval_duration"), int(got.get("eval_count") or 0)

            with ThreadPoolExecutor(in_flight) as pool:
                for batch in batches:
                    for at in range(0, batch.num_rows, 64):
                        rows = list(pool.map(one, zip(*(c.to_pylist() for c in batch.slice(at, 64).columns))))
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        return asked.select("clave", "sistema", "prompt").repartition(self.tasks, "clave").mapInArrow(ask, ANSWER)
