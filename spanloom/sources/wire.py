"""Messages on the wire: varint length, then a protocol-buffer message; requests in, call-chain reports out.

Field numbers and names below are fixed values of the format."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from spanloom.errors import InvalidRequest

UNSPECIFIED, BASELINE, COMPARISON = 0, 1, 2


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(raw: bytes, at: int) -> tuple[int, int] | None:
    """Value and the place after it; None if the bytes end inside it."""
    value = shift = 0
    for i in range(at, len(raw)):
        value |= (raw[i] & 127) << shift
        if raw[i] < 128:
            return value, i + 1
        shift += 7
        if shift > 63:
            raise InvalidRequest("a varint is too long")
    return None


def text(number: int, value: str | bytes) -> bytes:
    raw = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(raw)) + raw if raw else b""


def message(number: int, raw: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(raw)) + raw


def number(field_: int, value: int) -> bytes:
    return varint(field_ << 3) + varint(value & (1 << 64) - 1) if value else b""


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(raw):
        tag, at = _need(read_varint(raw, at))
        if tag & 7 == 0:
            value, at = _need(read_varint(raw, at))
            yield tag >> 3, value
        elif tag & 7 == 2:
            n, at = _need(read_varint(raw, at))
            if at + n > len(raw):
                raise InvalidRequest("a message is cut short")
            yield tag >> 3, raw[at : at + n]
            at += n
        else:
            raise InvalidRequest(f"unexpected wire type {tag & 7}")


def _need(x: tuple[int, int] | None) -> tuple[int, int]:
    if x is None:
        raise InvalidRequest("a message is cut short")
    return x


def duration(micros: int) -> bytes:
    """Seconds (1) and nanoseconds (2)."""
    sign = -1 if micros < 0 else 1
    return number(1, sign * (abs(micros) // 1_000_000)) + number(2, sign * (abs(micros) % 1_000_000) * 1000)


def stats(micros: int, frequency: int) -> bytes:
    return message(1, duration(micros)) + number(2, frequency)


def summary(path: Iterable[tuple[str, str]], micros: int, frequency: int, exemplars: Iterable[tuple[str, str]] = (), change: tuple[int, int] | None = None) -> bytes:
    """A call chain: steps (1; exemplars, 5, on the last), base (4) and diff (5)."""
    steps = list(path)
    out = b""
    for i, (service, op) in enumerate(steps):
        shown = b"".join(message(5, text(1, t) + text(2, s)) for t, s in exemplars) if i == len(steps) - 1 else b""
        out += message(1, text(1, service) + text(2, op) + shown)
    out += message(4, stats(micros, frequency))
    return out + (message(5, stats(*change)) if change else b"")


def response(window1: Iterable[bytes], window2: Iterable[bytes] = (), change: Iterable[bytes] = ()) -> bytes:
    return b"".join(message(n, s) for n, group in ((1, window1), (2, window2), (3, change)) for s in group)


def request_metadata(service: str, operation: str) -> bytes:
    return framed(message(1, text(1, service) + text(2, operation)))


def request_trace(document: bytes, window: int = UNSPECIFIED) -> bytes:
    return framed(message(2, text(1, document) + number(2, window)))


def framed(raw: bytes) -> bytes:
    return varint(len(raw)) + raw


@dataclass
class Stream:
    """Takes chunks of a stream of requests; keeps service and operation, and gives out (window, trace document) as they complete."""

    service: str = ""
    operation: str = ""
    messages: int = 0
    size: int = 0
    _rest: bytes = field(default=b"", repr=False)

    def feed(self, chunk: bytes) -> Iterator[tuple[int, bytes]]:
        self._rest += chunk
        self.size += len(chunk)
        at = 0
        while (head := read_varint(self._rest, at)) and head[1] + head[0] <= len(self._rest):
            raw, at = self._rest[head[1] : head[1] + head[0]], head[1] + head[0]
            self.messages += 1
            for n, value in fields(raw):
                inner = dict(fields(value))
                if n == 1:
                    self.service, self.operation = inner.get(1, b"").decode(), inner.get(2, b"").decode()
                elif not self.messages - 1:
                    raise InvalidRequest("the first message must name service and operation")
                else:
                    yield inner.get(2, UNSPECIFIED), inner.get(1, b"")
        self._rest = self._rest[at:]

    def close(self) -> None:
        if self._rest:
            raise InvalidRequest("the stream ends inside a message")
        if not (self.service and self.operation):
            raise InvalidRequest("service and operation are required")
