"""The HTTP backend against a server of this test."""

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from locutio.criteria.registry import criterion
from locutio.operators import served
from locutio.operators.evaluate import evaluated

CLAIMS = "doc_id string, id string, texto string, idioma_nombre string, preseleccionada boolean"
BACK = '{"causal": true, "contraste": false, "ventana": "corta"}'


class Model(ThreadingHTTPServer):
    daemon_threads = True

    def __init__(self):
        super().__init__(("127.0.0.1", 0), Handler)
        self.asked, self.peers, self.now, self.most, self.lock = Counter(), set(), 0, 0, threading.Lock()

    @property
    def url(self):
        return f"http://127.0.0.1:{self.server_port}"


class Handler(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"

    def log_message(self, *_):
        pass

    def say(self, body, status=200):
        raw = body.encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def do_GET(self):  # noqa: N802
        self.say(json.dumps({"models": [{"name": "small:latest"}, {}], "version": "1.2"}))

    def do_POST(self):  # noqa: N802
        s = self.server
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        said = body["prompt"].split('Afirmacion: "')[1].split('"')[0]
        with s.lock:
            s.asked[said] += 1
            s.peers.add(self.client_address)
            s.now += 1
            s.most = max(s.most, s.now)
            n = s.asked[said]
        time.sleep(0.02)
        assert body["model"] == "small" and body["stream"] is False and body["options"]["temperature"] == 0.0 and body["system"]
        if "slow" in said:
            time.sleep(1.5)
        answer = {"response": "nada" if "twice" in said and n == 1 else BACK, "eval_count": 20, "eval_duration": 400_000_000, "load_duration": 5_000_000}
        with s.lock:
            s.now -= 1
        if "memory" in said:
            self.say("model requires more: out of memory", 500)
        elif "gone" in said:
            self.say('{"error": "model not found"}', 404)
        elif "garbled" in said:
            self.say("<html>")
        elif "fault" in said:
            self.say('{"error": "llama-server: no such file"}')
        else:
            self.say(json.dumps(answer))


@pytest.fixture
def server():
    s = Model()
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()
    s.server_close()


def test_answers_retries_and_failures(spark, server):
    said = ["fine because", "twice because", "memory because", "gone because", "garbled because", "fault because", "slow because"]
    rows = spark.createDataFrame([("d", str(k), t, "x", True) for k, t in enumerate(said)], CLAIMS)
    got = {r.texto.split()[0]: r for r in evaluated(rows, criterion("framing-causal"), served.Served("small", server.url, tasks=2, in_flight=3, timeout=0.8), "small", retries=1).collect()}
    assert got["fine"].evaluada and (got["fine"].tokens, got["fine"].ms_generacion, got["fine"].ms_carga, got["fine"].intentos) == (20, 400.0, 5.0, 1) and got["fine"].ms_llm > 0
    assert got["twice"].evaluada and got["twice"].intentos == 2 and got["twice"].tokens == 40
    kinds = {"memory": "sin memoria", "gone": "sin modelo", "garbled": "ilegible", "fault": "sin ejecutor", "slow": "tiempo agotado"}
    for k, kind in kinds.items():
        assert not got[k].evaluada and got[k].error.startswith(kind + ": ") and got[k].llamadas == 0, k
    assert server.asked["fine because"] == 1 and server.asked["memory because"] == 2
    told = spark.createDataFrame([(r.error,) for r in got.values() if r.error] + [("other",)], "e string").select(served.advice(F.col("e")).alias("a")).collect()
    assert sum(r.a is not None for r in told) == len(kinds)


def test_calls_in_flight_are_bounded_and_connections_kept(spark, server):
    rows = spark.createDataFrame([("d", str(k), f"claim {k} because", "x", True) for k in range(60)], CLAIMS)
    got = evaluated(rows, criterion("framing-causal"), served.Served("small", server.url, tasks=2, in_flight=3), "small", retries=0)
    assert got.where("evaluada").count() == 60 and sum(server.asked.values()) == 60
    assert 2 <= server.most <= 6 and len(server.peers) <= 12


def test_state_of_a_server(server):
    s = served.Server(server.url, 2.0)
    assert s.state("small") == {"disponible": True, "modelos": ["small:latest"], "version": "1.2", "error": None, "tiene_modelo": True}
    assert s.state("large")["tiene_modelo"] is False
    nobody = served.Server("http://127.0.0.1:9", 0.5).state("small")
    assert nobody["disponible"] is False and nobody["error"].startswith("sin conexion")


def test_command_line(spark, server, tmp_path, capsys):
    from locutio.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Prices rose because of the storm and nobody doubted it.")
    assert main(["verificar-entorno", "--servidor", server.url, "-m", "small"]) == 0 and "small:latest" in capsys.readouterr().out
    assert main(["verificar-entorno", "--servidor", "http://127.0.0.1:9", "-m", "small"]) == 1 and "sin conexion" in capsys.readouterr().out
    assert main(["analizar", str(tmp_path / "in"), "--servidor", server.url, "-m", "small", "--salida", str(tmp_path / "out"), "--concurrencia", "2", "--reporte"]) == 0
    assert sum(server.asked.values()) == 1 and len(list((tmp_path / "out" / "paginas").glob("doc_id=*/part-*"))) == 1
    # what is stored is not asked again
    assert main(["analizar", str(tmp_path / "in"), "--servidor", server.url, "-m", "small", "--salida", str(tmp_path / "out")]) == 0 and sum(server.asked.values()) == 1
