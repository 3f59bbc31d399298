"""The HTTP provider against a server of this process."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from heronry.operators import rerank
from heronry.settings import ConfigError, Settings
from heronry.sources.endpoint import Endpoint


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *_):
        pass

    def _send(self, body, code=200):
        raw = body if isinstance(body, bytes) else json.dumps(body).encode()
        self.send_response(code)
        self.end_headers()
        self.wfile.write(raw)

    def do_GET(self):
        self._send({"data": [{"id": "b"}, {"id": "a"}]})

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path.endswith("/embeddings"):
            rows = [{"index": k, "embedding": [float(len(t))]} for k, t in enumerate(asked["input"])]
            return self._send({"data": rows[::-1]})
        if self.path.endswith("/rerank"):
            return self._send({"results": [{"index": k, "relevance_score": k / 10} for k in range(len(asked["documents"]))]})
        if "temperature" in asked or "max_tokens" in asked:
            return self._send({"error": "unsupported: " + ("max_tokens" if "max_tokens" in asked else "temperature")}, 400)
        usage = {"prompt_tokens": 9, "completion_tokens": 2, "prompt_tokens_details": {"cached_tokens": 4}}
        if asked.get("stream"):
            events = [{"choices": [{"delta": {"content": x}}]} for x in ("ice ", "moves")] + [{"choices": [], "usage": usage}]
            return self._send(b"".join(b"data: " + json.dumps(e).encode() + b"\n\n" for e in events) + b"data: [DONE]\n\n")
        content = asked["messages"][0]["content"]
        self._send({"model": "m", "choices": [{"message": {"content": content if isinstance(content, str) else content[1]["image_url"]["url"]}}], "usage": usage})


@pytest.fixture
def endpoint():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    yield Endpoint(Settings(base_url=url, rerank_base_url=url, rerank_model="r"))
    server.shutdown()


def test_calls(endpoint):
    reply = endpoint.chat("hello", max_tokens=5)  # both arguments are refused, and adapted
    assert (reply.text, reply.total_tokens, reply.cached_tokens, reply.model) == ("hello", 11, 4, "m")
    assert endpoint.embed(["a", "bcd"]) == [[1.0], [3.0]] and endpoint.embed([]) == []
    assert endpoint.models() == ["a", "b"]
    assert endpoint.transcribe(b"png", "read").text == "data:image/png;base64,cG5n"
    events = list(endpoint.stream("x"))
    assert [e[1] for e in events[:-1]] == ["ice ", "moves"] and events[-1][1].text == "ice moves" and events[-1][1].prompt_tokens == 9
    with pytest.raises(ConfigError):
        Endpoint(Settings())


def test_endpoint_reranking(spark, endpoint):
    pool = spark.createDataFrame([(0, f"c{k}", k) for k in range(3)], "query_id long, id string, rank long")
    chunks = spark.createDataFrame([(f"c{k}", f"text {k}") for k in range(3)], "id string, embed_text string")
    queries = spark.createDataFrame([(0, "which?")], "query_id long, query string")
    got = [(r.id, r.rerank) for r in rerank.model_reranker(queries, chunks, endpoint, "endpoint")(pool).orderBy("rank").collect()]
    assert got == [("c2", 0.2), ("c1", 0.1), ("c0", 0.0)]
