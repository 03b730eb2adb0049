"""Embedding and chat services over HTTP: one connection for each task, errors that may pass told from others."""

from __future__ import annotations

import http.client
import json
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

from ragloom.operators.ingest import Unavailable

#: Seconds a call may take.
TIMEOUT = 60.0


class Service:
    """A JSON service whose connection is kept; it is opened anew after an error."""

    def __init__(self, url: str, key: str | None = None, timeout: float = TIMEOUT):
        self.parts, self.timeout = urlsplit(url), timeout
        self.headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        self.connection: http.client.HTTPConnection | None = None

    def post(self, path: str, body: dict) -> http.client.HTTPResponse:
        """The response; Unavailable for 429, 500 and above and for network errors, ValueError for other refusals."""
        try:
            if self.connection is None:
                kind = http.client.HTTPSConnection if self.parts.scheme == "https" else http.client.HTTPConnection
                self.connection = kind(self.parts.netloc, timeout=self.timeout)
            self.connection.request("POST", self.parts.path.rstrip("/") + path, json.dumps(body).encode(), self.headers)
            response = self.connection.getresponse()
            if response.status < 400:
                return response
            said = response.read()[:300].decode("utf-8", "replace")
        except (OSError, http.client.HTTPException) as e:
            self.close()
            raise Unavailable(f"{type(e).__name__}: {e}") from e
        if response.status == 429 or response.status >= 500:
            raise Unavailable(f"status {response.status}: {said}")
        raise ValueError(f"status {response.status}: {said}")

    def close(self) -> None:
        if self.connection is not None:
            self.connection.close()
            self.connection = None


def embedder(url: str, model: str, local: bool = False, key: str | None = None) -> Callable[[], Callable[[str], list[float]]]:
    """What ingest.embed takes as make: /embeddings of an open interface, or /api/embeddings of a local server."""

    def make() -> Callable[[str], list[float]]:
        service = Service(url, key)

        def call(text: str) -> list[float]:
            if local:
                return json.loads(service.post("/api/embeddings", {"model": model, "prompt": text}).read())["embedding"]
            return json.loads(service.post("/embeddings", {"model": model, "input": text}).read())["data"][0]["embedding"]

        return call

    return make


def chat(url: str, model: str, local: bool = False, key: str | None = None, temperature: float = 0.0) -> Callable[[str], Iterator[str]]:
    """What pipeline.complete takes as model: the pieces of a streamed answer to a JSON list of messages."""

    def call(request: str) -> Iterator[str]:
        service = Service(url, key)
        try:
            body = {"model": model, "messages": json.loads(request), "stream": True, "temperature": temperature}
            for raw in service.post("/api/chat" if local else "/chat/completions", body):
                line = raw.decode("utf-8", "replace").strip()
                if not local:
                    if not line.startswith("data:"):
                        continue
                    line = line[5:].strip()
                if line and line != "[DONE]":
                    got = json.loads(line)
                    piece = got.get("message", {}).get("content") if local else (got.get("choices") or [{}])[0].get("delta", {}).get("content")
                    if piece:
                        yield piece
        finally:
            service.close()

    return call
