"""Models behind a small local server."""

import http.server
import json
import threading

import pytest

from quarry import Engine
from quarry.functions import models


class Handler(http.server.BaseHTTPRequestHandler):
    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        code, out = 200, {}
        if self.path == "/embed":
            text = body["prompt"]
            if len(text) > 40:
                code, out = 400, {"error": "the input exceeds the context length"}
            else:
                out = {"embedding": [float(text.count("bread")) + 0.01, float(text.count("soup")) + 0.01]}
        elif self.path == "/complete":
            out = {"response": f" {body['model']} {body['options']} {len(body['prompt'])} "}
        elif self.path == "/messages":
            out = {"content": [{"text": f"{self.headers['x-api-key']}: {body['messages'][0]['content']}"}]}
        elif self.path == "/about":
            out = {"set": {"parameters": "stop x\nnum_ctx   128\n", "model_info": {"bert.context_length": 512}}, "built": {"model_info": {"a.b": 1, "bert.context_length": 512}}}.get(body["model"], {})
        else:
            code, out = 404, {"error": "no such path"}
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(out).encode())

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def url():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_generators(url):
    assert models.HttpGenerator(f"{url}/complete", "m")("hello") == "m {'temperature': 0.0, 'seed': 42} 5"
    assert models.HttpGenerator(f"{url}/messages", "m", models.messages, headers={"x-api-key": "k"})("hello") == "k: hello"
    with pytest.raises(ValueError, match="no such path"):
        models.HttpGenerator(f"{url}/none", "m")("hello")


def test_engine_with_a_served_model(spark, url, tmp_path):
    (tmp_path / "a.txt").write_text("bread and butter\n")
    (tmp_path / "b.txt").write_text("soup of the day and so on, a line over the limit\n")
    embedder = models.HttpEmbedder(f"{url}/embed", "counts", 2, context_length=64)
    engine = Engine(spark, str(tmp_path / "root"), embedder, models.HttpGenerator(f"{url}/messages", "m", models.messages, headers={"x-api-key": "k"}), prompt="{question}? {context}")
    engine.index([str(tmp_path / "a.txt"), str(tmp_path / "b.txt")], size=60)
    assert engine.catalog.context_length == 64 and engine.catalog.compatible(["a", "b"])["embedding_model"] == "counts"
    found = engine.search("soup", min_score=None)
    assert found["sources"][0]["corpus"] == "b" and found["answer"].startswith("k: soup? Source 1 from b")


def test_the_context_length_is_asked_for(url):
    assert [models.context_length_of(f"{url}/about", m) for m in ("set", "built", "other")] == [128, 512, None]
    assert models.context_length_of("http://127.0.0.1:9/about", "set") is None
    assert models.HttpEmbedder(f"{url}/embed", "built", 2, about_url=f"{url}/about").context_length == 512
    assert models.HttpEmbedder(f"{url}/embed", "built", 2, context_length=9, about_url=f"{url}/about").context_length == 9


def test_models_on_the_command_line(spark, url, tmp_path, capsys):
    from quarry import cli

    (tmp_path / "a.txt").write_text("bread and butter\n")
    (tmp_path / "b.txt").write_text("soup of the day\nsoup again\n")
    options = ["--root", str(tmp_path / "r"), "--embed-url", f"{url}/embed", "--embed-model", "set", "--embed-dim", "2", "--embed-about-url", f"{url}/about"]
    options += ["--answer-url", f"{url}/messages", "--answer-form", "messages", "--temperature", "0.5", "--header", "x-api-key: k"]
    assert cli.main([*options, "index", str(tmp_path / "a.txt"), str(tmp_path / "b.txt")]) == 0
    engine = cli.engine_of(spark, cli.parser().parse_args([*options, "list"]))
    assert engine.catalog.context_length == 128 and engine.generator.temperature == 0.5
    capsys.readouterr()
    assert cli.main([*options, "search", "soup", "--min-score", "0"]) == 0
    assert '"answer": "k: Source 1 from b' in capsys.readouterr().out


def test_options_of_conversion_reach_the_converters(spark, tmp_path, monkeypatch):
    from quarry import cli
    from quarry.sources import convert

    seen = []

    def scan(data: bytes, dpi: int, lang: str, force_ocr: bool) -> tuple[str, int]:
        return f"{dpi} {lang} {force_ocr}", 1

    monkeypatch.setitem(convert.CONVERTERS, ".scan", scan)
    (tmp_path / "x.scan").write_bytes(b"?")
    assert cli.main(["convert", str(tmp_path / "x.scan"), "--output", str(tmp_path / "out"), "--format", "text", "--dpi", "150", "--lang", "eng", "--force-ocr"]) == 0
    seen += [p.read_text().strip() for p in (tmp_path / "out").rglob("*.txt")]
    assert seen == ["150 eng True"]
