"""A Python data source of fetched pages, for use where there is a network.

    spark.dataSource.register(HttpPages)
    spark.read.format("http_pages").option("urls", json.dumps(urls)).load()

One row for each URL: url, status, text, error. A failed fetch is a row with status 0 and
its error, never an exception; URLs of private hosts aren't fetched.
"""

from __future__ import annotations

import http.client
import json
import socket
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

AGENT = "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/124.0 Safari/537.36"


def _addresses(host: str) -> list[str]:
    """What a host's name resolves to; nothing if it doesn't."""
    try:
        return [x[4][0] for x in socket.getaddrinfo(host, None)]
    except OSError:
        return []


def allowed(url: str, addresses=_addresses) -> bool:
    """Plain http(s) without credentials, not to a private or local host, nor to a name of one."""
    import ipaddress

    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").lower()
    except ValueError:
        return False
    if parts.scheme not in ("http", "https") or parts.username or parts.password or not host or host == "localhost" or host.endswith((".local", ".localhost")):
        return False
    try:
        return ipaddress.ip_address(host).is_global
    except ValueError:
        return all(ipaddress.ip_address(x.partition("%")[0]).is_global for x in addresses(host))


def _connected(address: tuple[str, int], timeout: float | None = None, source: tuple | None = None) -> socket.socket:
    """A connection to the very address that was checked: a name isn't resolved twice."""
    import ipaddress

    host, port = address
    found = _addresses(host)
    if not found or not all(ipaddress.ip_address(x.partition("%")[0]).is_global for x in found):
        raise OSError(f"no address of {host} is allowed" if found else f"{host} isn't known")
    error = None
    for ip in found:
        try:
            return socket.create_connection((ip, port), timeout, source)
        except OSError as e:
            error = e
    raise error


class _Plain(http.client.HTTPConnection):
    def __init__(self, *args, **named):
        super().__init__(*args, **named)
        self._create_connection = _connected


class _Secure(http.client.HTTPSConnection):
    def __init__(self, *args, **named):
        super().__init__(*args, **named)
        self._create_connection = _connected


class _PlainHandler(urllib.request.HTTPHandler):
    def http_open(self, req):
        return self.do_open(_Plain, req)


class _SecureHandler(urllib.request.HTTPSHandler):
    def https_open(self, req):
        return self.do_open(_Secure, req, context=self._context)


class _Checked(urllib.request.HTTPRedirectHandler):
    """Redirects are followed only to where a request may go."""

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        if not allowed(newurl):
            raise ValueError(f"redirect to {newurl} not allowed")
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def _open(request: urllib.request.Request, timeout: float):
    return urllib.request.build_opener(_Checked, _PlainHandler, _SecureHandler).open(request, timeout=timeout)


def fetch(url: str, timeout: float = 15, attempts: int = 3, wait: float = 1, opener=_open, check=allowed) -> tuple[int, str, str | None]:
    """(status, text, error) of one page; waits 1, 2, 4 ... seconds between attempts."""
    if not check(url):
        return 0, "", "url not allowed"
    error = None
    for k in range(attempts):
        if k:
            time.sleep(wait * 2 ** (k - 1))
        try:
            with opener(urllib.request.Request(url, headers={"User-Agent": AGENT, "Accept": "text/html,application/json;q=0.9,*/*;q=0.8"}), timeout=timeout) as r:
                return r.status, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"), None
        except urllib.error.HTTPError as e:
            return e.code, "", str(e)
        except (OSError, ValueError, http.client.HTTPException) as e:
            error = str(e) or type(e).__name__
    return 0, "", error


class _Urls(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        urls, per = json.loads(self.options.get("urls", "[]")), int(self.options.get("per_partition", 50))
        return [_Urls(urls[i : i + per]) for i in range(0, len(urls), per)] or [_Urls([])]

    def read(self, partition: _Urls) -> Iterator[tuple]:
        for url in partition.urls:
            yield (url, *fetch(url, float(self.options.get("timeout", 15)), int(self.options.get("attempts", 3))))


class HttpPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> str:
        return "url string, status int, text string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
