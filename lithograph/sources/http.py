"""Byte ranges of files on HTTP servers, read in tasks: only from hosts that may be fetched from, redirects included."""

from __future__ import annotations

import http.client
import ipaddress
import socket
from collections.abc import Callable, Iterator
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame

MOST_REDIRECTS, CONNECT_SECONDS, READ_SECONDS = 5, 10, 30
PART = "url string, start long, status int, data binary, total long, error string"


def public(address: str) -> bool:
    """Whether an address is public; those that hold an IPv4 address are as public as that."""
    a = ipaddress.ip_address(address.split("%")[0])
    if a.version == 6:
        held = a.ipv4_mapped or a.sixtofour or (ipaddress.ip_address(int(a) & 0xFFFFFFFF) if a in ipaddress.ip_network("64:ff9b::/96") or int(a) >> 32 == 0 and int(a) > 1 else None)
        if a.teredo or a in ipaddress.ip_network("64:ff9b:1::/48"):
            return False
        if held is not None:
            a = held
    shared, benchmark, reserved = (ipaddress.ip_network(n) for n in ("100.64.0.0/10", "198.18.0.0/15", "192.0.0.0/24"))
    inside = a.version == 4 and any(a in n for n in (shared, benchmark, reserved))
    return not (inside or a.is_private or a.is_loopback or a.is_link_local or a.is_multicast or a.is_reserved or a.is_unspecified or (a.version == 6 and a.is_site_local))


def resolved(host: str, port: int) -> list[str]:
    """All addresses of a host, if all are public."""
    found = sorted({r[4][0] for r in socket.getaddrinfo(host, port, type=socket.SOCK_STREAM)})
    if not found or not all(map(public, found)):
        raise PermissionError(f"{host} isn't on public addresses")
    return found


def ranged(url: str, start: int, length: int, check: Callable[[str, int], list[str]] = resolved) -> tuple[int, bytes, int | None]:
    """(status, bytes, length of the whole file or None) of ``length`` bytes from ``start`` on.

    Each connection goes to an address that was checked. Servers that don't know ranges (no status 206) give status and
    no bytes.
    """
    for _ in range(MOST_REDIRECTS + 1):
        parts = urlsplit(url)
        if parts.scheme not in ("http", "https") or not parts.hostname:
            raise ValueError(f"not an HTTP URL: {url}")
        port = parts.port or (443 if parts.scheme == "https" else 80)
        kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
        connection = kind(parts.hostname, port, timeout=READ_SECONDS)
        address = check(parts.hostname, port)[0]
        connection._create_connection = lambda _, *a, to=(address, port), **k: socket.create_connection(to, CONNECT_SECONDS)
        try:
            connection.request("GET", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers={"Range": f"bytes={start}-{start + length - 1}"})
            answer = connection.getresponse()
            if answer.status in (301, 302, 303, 307, 308):
                url = urljoin(url, answer.headers["Location"])
                continue
            if answer.status != 206:
                return answer.status, b"", None
            total = answer.headers.get("Content-Range", "").rpartition("/")[2]
            return 206, answer.read(length), int(total) if total.isdigit() else None
        finally:
            connection.close()
    raise OSError(f"more than {MOST_REDIRECTS} redirects")


def ranges(wanted: DataFrame, check: Callable[[str, int], list[str]] = resolved) -> DataFrame:
    """PART rows of ``wanted`` (url, start, length); what can't be read has an error. A row is one request of one task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string()]
        names = [c.split()[0] for c in PART.split(", ")]
        for batch in batches:
            for url, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    row = (url, start, *ranged(url, start, length, check), None)
                except (OSError, ValueError, http.client.HTTPException) as broken:
                    row = (url, start, None, None, None, f"{type(broken).__name__}: {broken}")
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    return wanted.select("url", "start", "length").mapInArrow(read, PART)
