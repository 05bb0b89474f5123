"""Devices' status, properties and index from a JSON web service, as a Python data source for batch and stream reads.

``spark.dataSource.register(DeviceService)``, then ``spark.read.format("device_service").options(...).load()``, or ``readStream``. Each device is a
partition of its own, so devices are fetched side by side and one that fails doesn't hold up the others: what goes wrong is
a row with ``error`` and no ``body``. A body that is no JSON object, or has errors in it, is an error as well.

Options: ``url`` (of the service), ``backends`` (comma-separated; none: the index only), ``token_url`` and ``api_key`` (none: no token), ``grant_type``, ``headers`` (a JSON object of
more headers), ``timeout_seconds``, ``poll_interval_seconds`` (streams), ``status_path``, ``properties_path`` and ``index_path``.

A service tells the present only, so a stream's batch that is taken again after a failure has the later answers; its rows carry the poll's number, and a sink
that writes by batch keeps one of them.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "poll long, backend string, kind string, fetched_at timestamp, body string, error string"
#: Seconds before its end at which a token is no longer used.
TOKEN_MARGIN = 60
MOST_ERROR = 5000
PATHS = {"status": "/api/v1/backends/{backend}/status", "properties": "/api/v1/backends/{backend}/properties", "index": "/api/v1/backends"}


class Service:
    """A session with the service: one for each task, with its token."""

    def __init__(self, options: dict[str, str], now: Callable[[], float] = time.time):
        self.options, self.now = options, now
        self.timeout = float(options.get("timeout_seconds", 60))
        self.token, self.ends = None, 0.0

    def _asked(self, request: urllib.request.Request) -> object:
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.loads(answer.read())

    def bearer(self) -> str | None:
        """The token, asked for anew when it ends within ``TOKEN_MARGIN`` seconds."""
        if not self.options.get("token_url"):
            return None
        if self.token is None or self.ends - self.now() <= TOKEN_MARGIN:
            form = urllib.parse.urlencode({"grant_type": self.options.get("grant_type", "client_credentials"), "apikey": self.options.get("api_key", "")}).encode()
            began = self.now()
            answer = self._asked(urllib.request.Request(self.options["token_url"], form, {"Content-Type": "application/x-www-form-urlencoded"}))
            self.token, self.ends = answer["access_token"], began + max(TOKEN_MARGIN, int(answer.get("expires_in", 3600)))
        return self.token

    def get(self, path: str) -> dict:
        headers = {"Accept": "application/json", **json.loads(self.options.get("headers", "{}"))}
        if token := self.bearer():
            headers["Authorization"] = f"Bearer {token}"
        body = self._asked(urllib.request.Request(self.options["url"].rstrip("/") + path, headers=headers))
        if not isinstance(body, dict):
            raise TypeError(f"{path}: an object was expected, not {type(body).__name__}")
        if body.get("errors"):
            raise ValueError(f"{path}: the service gave errors: {json.dumps(body['errors'])}")
        return body

    def rows(self, poll: int, backend: str | None) -> Iterator[tuple]:
        for kind in ("status", "properties") if backend is not None else ("index",):
            path = self.options.get(f"{kind}_path", PATHS[kind]).format(backend=urllib.parse.quote(backend or "", safe=""))
            body = error = None
            try:
                body = json.dumps(self.get(path), ensure_ascii=False)
            except (OSError, ValueError, TypeError, KeyError) as e:  # a failed fetch is a row, not a failed job
                error = f"{type(e).__name__}: {e}"[:MOST_ERROR]
            yield poll, backend, kind, datetime.fromtimestamp(self.now(), timezone.utc), body, error


class Device(InputPartition):
    def __init__(self, backend: str | None, poll: int):
        self.backend, self.poll = backend, poll


def devices(options: dict[str, str], poll: int) -> list[Device]:
    """The index, and each device once."""
    named = dict.fromkeys(x.strip() for x in options.get("backends", "").split(",") if x.strip())
    return [Device(None, poll), *[Device(b, poll) for b in named]]


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Device]:
        return devices(self.options, 0)

    def read(self, partition: Device) -> Iterator[tuple]:
        yield from Service(self.options).rows(partition.poll, partition.backend)


class StreamReader(DataSourceStreamReader):
    """A poll each interval, numbered by the interval since 1970; of polls that were missed while the stream stood still only the last is made up for."""

    def __init__(self, options: dict[str, str]):
        self.options = options
        self.interval = float(options.get("poll_interval_seconds", 900))
        if self.interval <= 0:
            raise ValueError("poll_interval_seconds must be positive")

    def _poll(self) -> int:
        return int(time.time() / self.interval)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"poll": self._poll() - 1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"poll": self._poll()}

    def partitions(self, start: dict, end: dict) -> list[Device]:
        return devices(self.options, end["poll"]) if end["poll"] > start["poll"] else []

    def read(self, partition: Device) -> Iterator[tuple]:
        yield from Service(self.options).rows(partition.poll, partition.backend)

    def commit(self, end: dict) -> None:
        pass


class DeviceService(DataSource):
    @classmethod
    def name(cls) -> str:
        return "device_service"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self._plain())

    def streamReader(self, schema: StructType) -> StreamReader:  # noqa: N802
        return StreamReader(self._plain())

    def _plain(self) -> dict[str, str]:
        options = {k.lower(): v for k, v in self.options.items()}
        if not options.get("url"):
            raise ValueError("url is not set")
        return options
