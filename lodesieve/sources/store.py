"""Hits from a log store's search interface over HTTP, as a Spark data source.

The window is cut into equal slices of time; every slice is a partition that pages through its own
hits on an executor, so a long window is read by many tasks, and a lost executor costs its slices only.
Repeats at page edges are dropped within a slice here and over all by ``hits.window_scan``.
"""

from __future__ import annotations

import base64
import json
import os
import random
import re
import socket
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fields, limits and waits of the search interface.

TIMESTAMP, CONTAINER = "@timestamp", "kubernetes.container.name"
MESSAGE_FIELDS = ["message", "msg", "log.message", "event.original"]
PAGE, MOST = 500, 50_000
RETRIES, REDIRECTS = 3, 5
FIRST_WAIT, LONGEST_WAIT, JITTER = 0.5, 30.0, 0.3
LARGEST_BODY = 64 << 20
TRANSIENT = (ConnectionResetError, ConnectionRefusedError, TimeoutError, socket.gaierror)

# End of fixed values.

USERINFO = re.compile(r"(?i)\b([a-z][a-z0-9+.\-]*://)[^/@\s]+@")


class StoreError(Exception):
    """A search that the store refused; its text holds no credentials."""


def scrubbed(text: str) -> str:
    return USERINFO.sub(r"\1", text)


def authorization(environment: dict[str, str]) -> str:
    """The header from a token, a key with its id, or a name with a password, whichever is set first; secrets come from the environment only."""
    get = lambda name: environment.get(f"LOG_STORE_{name}", "")
    coded = lambda a, b: base64.b64encode(f"{a}:{b}".encode()).decode()
    if get("TOKEN"):
        return f"Bearer {get('TOKEN')}"
    if get("KEY_ID") and get("KEY"):
        return f"ApiKey {coded(get('KEY_ID'), get('KEY'))}"
    if get("USER") and get("PASSWORD"):
        return f"Basic {coded(get('USER'), get('PASSWORD'))}"
    raise StoreError("set LOG_STORE_TOKEN, or LOG_STORE_KEY_ID and LOG_STORE_KEY, or LOG_STORE_USER and LOG_STORE_PASSWORD")


def origin(url: str) -> tuple[str, str | None, int]:
    u = urllib.parse.urlsplit(url)
    return u.scheme, u.hostname, u.port or (443 if u.scheme == "https" else 80)


def may_know(base: str, url: str) -> bool:
    """Whether credentials for one address go to another: the same origin, or the same host over https instead of http."""
    a, b = origin(base), origin(url)
    return a == b or a[0] == "http" and b[0] == "https" and a[1] == b[1]


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_):
        return None


@dataclass
class Store:
    """A client; ``proxied`` sends searches through a console's proxy path.  A proxy of its own is named by address."""

    url: str
    index: str
    auth: str
    proxied: bool = False
    proxy: str | None = None
    timeout: float = 30.0
    waits: list[float] = field(default_factory=list)  #: for tests: what was waited, instead of waiting

    def _once(self, method: str, url: str, body: dict | None) -> tuple[int, str, str | None]:
        headers = {"Content-Type": "application/json", "Accept": "application/json", "kbn-xsrf": "true"}
        if may_know(self.url, url):
            headers["Authorization"] = self.auth
        # an address of a proxy means a tunnel for https and whole addresses for http
        opener = urllib.request.build_opener(_Stay, urllib.request.ProxyHandler({"http": self.proxy, "https": self.proxy} if self.proxy else {}))
        request = urllib.request.Request(url, None if body is None else json.dumps(body).encode(), headers, method=method)
        try:
            response = opener.open(request, timeout=self.timeout)
        except urllib.error.HTTPError as error:
            response = error
        with response:
            data = response.read(LARGEST_BODY + 1)
            if len(data) > LARGEST_BODY:
                raise StoreError(f"a response of more than {LARGEST_BODY} bytes")
            return response.status, data.decode("utf-8", "replace"), response.headers.get("Location")

    def request(self, method: str, url: str, body: dict | None = None) -> tuple[int, str]:
        """Follows up to REDIRECTS redirects; 303, and 301 or 302 after a POST, go on as GET."""
        seen = [url]
        while True:
            status, text, location = self._once(method, url, body)
            if status not in (301, 302, 303, 307, 308) or not location:
                return status, text
            url = urllib.parse.urljoin(url, location)
            if url in seen:
                raise StoreError("redirects in a circle: " + " -> ".join(map(scrubbed, [*seen, url])))
            seen.append(url)
            if len(seen) > REDIRECTS + 1:
                raise StoreError(f"more than {REDIRECTS} redirects: " + " -> ".join(map(scrubbed, seen)))
            if status == 303 or status in (301, 302) and method == "POST":
                method, body = "GET", None

    def _wait(self, attempt: int) -> None:
        wait = min(LONGEST_WAIT, FIRST_WAIT * 2**attempt)
        wait += random.random() * wait * JITTER
        if self.waits:
            self.waits.append(wait)
        else:
            time.sleep(wait)

    def with_retries(self, method: str, url: str, body: dict | None = None) -> tuple[int, str]:
        for attempt in range(RETRIES + 1):
            last = attempt == RETRIES
            try:
                status, text = self.request(method, url, body)
                if status < 500 and status != 429 or last:
                    return status, text
            except (urllib.error.URLError, *TRANSIENT) as error:
                cause = error.reason if isinstance(error, urllib.error.URLError) else error
                if last or not isinstance(cause, TRANSIENT):
                    raise StoreError(scrubbed(str(error))) from None
            self._wait(attempt)
        raise AssertionError

    def alive(self) -> tuple[bool, int]:
        """Whether the store answers its status request, and how."""
        status, _ = self.request("GET", self.url + ("/api/status" if self.proxied else "/_cluster/health"))
        return 200 <= status < 300, status

    def search(self, body: dict) -> dict:
        path = f"/{urllib.parse.quote(self.index, safe='')}/_search"
        url = f"{self.url}/api/console/proxy?path={urllib.parse.quote(path, safe='')}&method=POST" if self.proxied else self.url + path
        status, text = self.with_retries("POST", url, body)
        if status == 404 and "index_not_found_exception" in text:
            raise StoreError(f"the index {self.index!r} isn't there")
        if status in (401, 403):
            raise StoreError(f"not allowed (HTTP {status}): check the credentials and the right to read the index")
        if not 200 <= status < 300:
            raise StoreError(f"HTTP {status}: {scrubbed(text[:500])}")
        try:
            return json.loads(text)
        except ValueError:
            raise StoreError(f"HTTP {status} without JSON, likely from something in front of the store: {scrubbed(text.strip()[:200])}") from None

    def hits(self, body: dict, most: int) -> Iterator[dict]:
        """Pages through a search; each id once."""
        seen: set[str] = set()
        after = None
        while len(seen) < most:
            page = self.search(body | ({"search_after": after} if after else {}))["hits"]["hits"]
            for hit in page:
                if hit.get("_id") not in seen and len(seen) < most:
                    seen.add(hit.get("_id"))
                    yield hit
            if len(page) < body["size"] or "sort" not in page[-1]:
                return
            after = page[-1]["sort"]


def search_body(start: str, stop: str, containers: list[str] | None = None, query: str | None = None, page: int = PAGE) -> dict:
    """A search from start (included) to stop (excluded): all hits by time, or, with a query, the latest first and all of them counted."""
    names = [c.strip() for c in containers or [] if c.strip()]
    only = {"bool": {"should": [{"terms": {f: names}} if len(names) > 1 else {"term": {f: names[0]}} for f in (f"{CONTAINER}.keyword", CONTAINER)], "minimum_should_match": 1}} if names else None
    inner: dict = {"filter": [{"range": {TIMESTAMP: {"gte": start, "lt": stop}}}] + [only] * bool(only)}
    if query:
        inner["must"] = [{"query_string": {"query": query, "fields": MESSAGE_FIELDS, "default_operator": "AND", "lenient": True, "allow_leading_wildcard": False, "max_determinized_states": 10_000}}]
    body = {"size": page, "sort": [{TIMESTAMP: {"order": "desc" if query else "asc"}}], "query": {"bool": inner}, "_source": ["message", "log", "msg", "event.original", TIMESTAMP, CONTAINER]}
    return body | ({"track_total_hits": True} if query else {})


def matched(response: dict) -> tuple[int, str] | None:
    """How many hits a search has, and whether that is all (eq) or a lower bound (gte); None if it doesn't say."""
    total = response.get("hits", {}).get("total")
    if isinstance(total, dict) and isinstance(total.get("value"), int):
        return total["value"], "gte" if total.get("relation") == "gte" else "eq"
    return (total, "eq") if isinstance(total, int) else None


@dataclass
class Slice(InputPartition):
    start: str
    stop: str


def slices(start: str, stop: str, n: int) -> list[Slice]:
    """Equal slices of a window, without gaps."""
    a, b = (datetime.fromisoformat(x.replace("Z", "+00:00")).replace(tzinfo=UTC).timestamp() for x in (start, stop))
    edges = [datetime.fromtimestamp(a + (b - a) * k / n, UTC).isoformat(timespec="microseconds").replace("+00:00", "Z") for k in range(n + 1)]
    return [Slice(x, y) for x, y in zip(edges, edges[1:], strict=False)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict, auth: str) -> None:
        self.options, self.auth = options, auth

    def partitions(self) -> list[Slice]:
        return slices(self.options["from"], self.options["to"], int(self.options.get("slices", 8)))

    def read(self, partition: Slice) -> Iterator[tuple]:
        o = self.options
        store = Store(o["url"].rstrip("/"), o["index"], self.auth, o.get("proxied", "").lower() == "true", o.get("proxy"))
        body = search_body(partition.start, partition.stop, o.get("containers", "").split(","), o.get("query"), int(o.get("page", PAGE)))
        for hit in store.hits(body, int(o.get("most", MOST))):
            source = hit.get("_source") or {}
            place = source
            for step in CONTAINER.split("."):
                place = place.get(step) if isinstance(place, dict) else None
            yield hit.get("_id"), hit.get("_index"), source.get(CONTAINER) or place, source.get(TIMESTAMP), json.dumps(source, separators=(",", ":"), ensure_ascii=False)


class LogStore(DataSource):
    """Options: url, index, from, to, auth_token (the whole header; Spark hides options so named in plans), and if wanted containers, query, slices, page, most (of a slice), proxied and proxy."""

    @classmethod
    def name(cls) -> str:
        return "log_store"

    def schema(self) -> str:
        return "id string, index string, container string, time string, source string"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options), self.options["auth_token"])


def read_store(spark: SparkSession, **options: str):
    """id, index, container, ts, message, message_field_length of the hits of a window."""
    from pyspark.sql import functions as F

    from lodesieve.sources.hits import resolved

    spark.dataSource.register(LogStore)
    rows = spark.read.format("log_store").options(auth_token=authorization(dict(os.environ)), **{k.rstrip("_"): str(v) for k, v in options.items()}).load()
    message, length = resolved(F.col("source"))
    return rows.select("id", "index", "container", F.col("time").try_cast("timestamp").alias("ts"), message.alias("message"), length.alias("message_field_length"))
