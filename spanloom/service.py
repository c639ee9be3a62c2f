"""HTTP service: a stream of trace documents in, a report out. `python -m spanloom.service --port 6566`.

GET /health; POST /v2/trace/analysis/stream (one window) and /v2/trace/analysis/compare (two windows, told apart by the documents' kind). Bodies
are framed messages (sources.wire). Documents are drained to the shared folder in parts of bounded size, so that the driver holds one part, and
analysed there by the batch plans; a request's folder goes when it is answered. A request that cannot be analysed is answered by an empty report."""

from __future__ import annotations

import argparse
import json
import logging
import threading
import uuid
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom import scratch, ship
from spanloom.config import Knobs
from spanloom.errors import InvalidRequest, NoTraces
from spanloom.operators import profile, sinks, structure, tree
from spanloom.sources import traces, wire

log = logging.getLogger(__name__)
PART_BYTES = 32 << 20
DOCUMENTS = "window int, trace_id string, document string"


class Service:
    """Analyses requests; `at_once` of them at a time."""

    def __init__(self, spark: SparkSession, at_once: int = 4, exemplars: int = 3):
        self.spark, self.exemplars, self.turn = ship.ensure(spark), exemplars, threading.Semaphore(at_once)

    def drain(self, chunks: Iterator[bytes]) -> tuple[DataFrame, wire.Stream]:
        """Documents of a body, written to the shared folder part by part, and what the stream says of them."""
        path = f"{scratch.shared_dir(self.spark)}/spanloom/request-{uuid.uuid4().hex}"
        stream, part, held, number = wire.Stream(), [], 0, 0
        scratch.keep(path)

        def flush() -> None:
            if part:
                self.spark.createDataFrame(part, DOCUMENTS).write.mode("append").parquet(path)
                part.clear()

        for chunk in chunks:
            for window, document in stream.feed(chunk):
                part.append((window, f"{number}", document.decode("utf-8", "replace")))
                held, number = held + len(document), number + 1
                if held >= PART_BYTES:
                    flush()
                    held = 0
        stream.close()
        flush()
        if not number:
            raise NoTraces("no traces came with the request")
        return self.spark.read.schema(DOCUMENTS).parquet(path), stream

    def profile(self, documents: DataFrame, stream: wire.Stream) -> tuple[DataFrame, DataFrame]:
        """Merged profile and exemplars of a window."""
        spans = traces.spans_of(traces.parsed(documents))
        own = scratch.cut(profile.per_trace(tree.nodes(spans, Knobs(root=(stream.service, stream.operation)))), "window")
        return profile.merged(own), profile.exemplars(own, self.exemplars)

    def analyse(self, chunks: Iterator[bytes]) -> bytes:
        with self.turn, scratch.scope(self.spark):
            documents, stream = self.drain(chunks)
            return sinks.protobuf(*self.profile(documents, stream))

    def compare(self, chunks: Iterator[bytes]) -> bytes:
        with self.turn, scratch.scope(self.spark):
            documents, stream = self.drain(chunks)
            found = {r["window"] for r in documents.select("window").distinct().collect()}
            if not {wire.BASELINE, wire.COMPARISON} <= found:
                raise InvalidRequest("a comparison needs traces of both windows")
            (one, shown), (two, _) = (self.profile(documents.where(F.col("window") == w), stream) for w in (wire.BASELINE, wire.COMPARISON))
            return sinks.protobuf(one, shown, structure.compare(one, two))


def body_of(handler: BaseHTTPRequestHandler, step: int = 1 << 16) -> Iterator[bytes]:
    """A request's body, piece by piece, of given length or chunked."""
    if "chunked" in handler.headers.get("Transfer-Encoding", ""):
        while size := int(handler.rfile.readline().split(b";")[0], 16):
            while size:
                piece = handler.rfile.read(min(step, size))
                if not piece:
                    raise InvalidRequest("the body is cut short")
                size -= len(piece)
                yield piece
            handler.rfile.readline()
        handler.rfile.readline()
        return
    left = int(handler.headers.get("Content-Length") or 0)
    while left:
        piece = handler.rfile.read(min(step, left))
        if not piece:
            raise InvalidRequest("the body is cut short")
        left -= len(piece)
        yield piece


def server(spark: SparkSession, host: str = "127.0.0.1", port: int = 6566, **knobs) -> ThreadingHTTPServer:
    service = Service(spark, **knobs)
    routes = {"/v2/trace/analysis/stream": service.analyse, "/v2/trace/analysis/compare": service.compare}

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def answer(self, code: int, kind: str, content: bytes) -> None:
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(content)))
            self.end_headers()
            self.wfile.write(content)

        def do_GET(self) -> None:
            found = self.path == "/health"
            self.answer(200 if found else 404, "application/json", json.dumps({"status": "OK" if found else "not found"}).encode())

        def do_POST(self) -> None:
            route = routes.get(self.path)
            if route is None:
                self.answer(404, "application/json", b'{"status": "not found"}')
                return
            body = body_of(self)
            try:
                report = route(body)
            except Exception:  # the caller gets an empty report, the log the reason
                log.exception("error in %s", self.path)
                report = wire.response(())
                self.close_connection = True  # what is left of the body is not read
            self.answer(200, "application/octet-stream", report)

        def log_message(self, *args) -> None:
            log.info(*args)

    return ThreadingHTTPServer((host, port), Handler)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--host", default="0.0.0.0")
    p.add_argument("--port", type=int, default=6566)
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    server(SparkSession.builder.appName("spanloom-service").getOrCreate(), a.host, a.port).serve_forever()


if __name__ == "__main__":
    main()
