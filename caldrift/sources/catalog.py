"""Configuration, inventories and file sources."""

from __future__ import annotations

import gzip
import io
import json
import os
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Names by which an anchor's, a device's and a poll's columns go, the best first.
ANCHOR_NAMES = ("last_update_date", "last_updated", "last_update", "backend_last_update_date", "backend_last_updated", "calibration_date", "backend_calibration_date")
BACKEND_NAMES = ("backend", "backend_name", "device", "device_name")
POLL_NAMES = ("poll_timestamp_utc", "observed_at_utc", "snapshot_timestamp_utc", "timestamp_utc", "poll_started_at", "created_at", "updated_at")
#: Points of the anchor's name, the best names first; all others have the last.
ANCHOR_POINTS = (("last_update_date",), 100), (("last_updated", "last_update"), 80), (ANCHOR_NAMES, 60)


@dataclass(frozen=True)
class CollectorConfig:
    backends: tuple[str, ...]
    poll_interval_seconds: int = 900
    timeout_seconds: int = 60
    edge_mode: str = "undirected"

    def __post_init__(self) -> None:
        if self.poll_interval_seconds <= 0 or self.timeout_seconds <= 0:
            raise ValueError("interval and timeout must be positive")
        if self.edge_mode not in ("undirected", "directed"):
            raise ValueError(f"unknown edge mode {self.edge_mode!r}")

    @classmethod
    def from_env(cls) -> CollectorConfig:
        names = tuple(x.strip() for x in os.environ.get("BACKENDS", "").split(",") if x.strip())
        if not names:
            raise ValueError("BACKENDS is empty")
        return cls(names, int(os.environ.get("POLL_INTERVAL_SECONDS", "900")), int(os.environ.get("HTTP_TIMEOUT_SECONDS", "60")), os.environ.get("EDGE_ID_MODE", "undirected"))


def read_frame(spark: SparkSession, sql: str, **params: object) -> DataFrame:
    """A parameterised query as a DataFrame."""
    return spark.sql(sql, args=params)


def read_csv(spark: SparkSession, path: str, schema: StructType, columns: list[str] | None = None) -> DataFrame:
    """Plain or gzip CSV with a header and a declared schema."""
    df = spark.read.csv(path, header=True, schema=schema, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return df.select(*columns) if columns else df


def read_csv_from_zip(spark: SparkSession, archive: str, member: str, schema: StructType, columns: list[str] | None = None) -> DataFrame:
    """A CSV, plain or gzip, inside each zip that the path or pattern ``archive`` names, in any file system that Spark reaches.

    Spark has no codec for the container, so each archive is one row of a binary file source, and an executor reads the member as a stream: what it
    holds is the compressed archive and one block of rows. Columns that aren't asked for are not parsed. An archive without the member is an error.
    """
    wanted = StructType([schema[c] for c in columns]) if columns else schema
    kinds = to_arrow_schema(wanted)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as z, z.open(member) as packed, gzip.open(packed) if member.endswith(".gz") else packed as plain:
                    convert = csv.ConvertOptions(column_types={f.name: f.type for f in kinds}, include_columns=kinds.names, strings_can_be_null=True, null_values=[""])
                    for part in csv.open_csv(plain, convert_options=convert):
                        yield part

    return spark.read.format("binaryFile").load(archive).select("content").mapInArrow(rows, wanted)


def schema_inventory(spark: SparkSession) -> list[tuple[str, str, str]]:
    """(table, column, type) of all tables and views of the session."""
    return [(t.name, c.name, c.dataType) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]


@dataclass(frozen=True)
class AnchorSource:
    table: str
    anchor: str
    backend: str
    poll: str
    score: int


def _first(names: tuple[str, ...], columns: list[str]) -> str | None:
    """The column, as it is spelt, that has the best of the names in any case."""
    known = {c.lower(): c for c in columns}
    return next((known[n] for n in names if n in known), None)


def _by_table(inventory: list[tuple[str, str, str]]) -> dict[str, list[str]]:
    tables: dict[str, list[str]] = {}
    for t, c, _ in inventory:
        tables.setdefault(t, []).append(c)
    return tables


def _table_points(t: str) -> int:
    return 20 * ("backend" in t.lower()) + 20 * ("propert" in t.lower() or "calibr" in t.lower())


def named_anchor_source(inventory: list[tuple[str, str, str]], table: str, anchor: str | None = None, backend: str | None = None, poll: str | None = None) -> AnchorSource:
    """The source in a table that the caller names, with or without its schema; columns that aren't named go by the known names."""
    tables = _by_table(inventory)
    found = [t for t in tables if t == table] or [t for t in tables if t == f"public.{table}"] or [t for t in tables if t.rsplit(".", 1)[-1] == table]
    if len(found) != 1:
        raise LookupError(f"{table!r} names {len(found)} tables")
    columns = tables[found[0]]
    picked = [given or _first(names, columns) for given, names in ((anchor, ANCHOR_NAMES), (backend, BACKEND_NAMES), (poll, POLL_NAMES))]
    if None in picked or not set(picked) <= set(columns):
        raise LookupError(f"{found[0]} has no such columns: anchor, backend and poll are {picked}, of {sorted(columns)}")
    return AnchorSource(found[0], *picked, 0)


def discover_anchor_source(inventory: list[tuple[str, str, str]]) -> AnchorSource:
    """The table whose columns look most like anchors: by the anchor's name, and by what the table's name says; of equal scores
    the last description. Works on catalog metadata alone."""
    found = []
    for t, columns in _by_table(inventory).items():
        anchor, backend, poll = (_first(names, columns) for names in (ANCHOR_NAMES, BACKEND_NAMES, POLL_NAMES))
        if anchor and backend and poll:
            low, points = t.lower(), next(n for names, n in ANCHOR_POINTS if anchor.lower() in names)
            found.append(AnchorSource(t, anchor, backend, poll, points + _table_points(t) + 10 * ("snapshot" in low) + 5 * low.startswith("public.")))
    if not found:
        raise LookupError("no table has anchor, backend and poll columns")
    return max(found, key=lambda s: (s.score, s.table, s.anchor))


#: Points of any anchor in a JSON column, and items of a list that are looked into.
JSON_POINTS, LIST_ITEMS = 40, 3


def key_path(body: object, names: frozenset[str]) -> list[str | int] | None:
    """Where the first key among ``names``, in any case, stands in a JSON value: an object's own keys come before what is below them.

    A stack of what is left to look at, depth first, so a document of any depth is searched.
    """
    left: list[tuple[object, tuple]] = [(body, ())]
    while left:
        value, path = left.pop()
        if isinstance(value, dict):
            own = next((k for k in value if k.lower() in names), None)
            if own is not None:
                return [*path, own]
            left += [(v, (*path, k)) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            left += [(v, (*path, k)) for k, v in reversed([*enumerate(value[:LIST_ITEMS])])]
    return None


def json_path(path: list[str | int]) -> str:
    plain = lambda k: k.replace("_", "a").isalnum() and not k[0].isdigit()
    return "$" + "".join(f"[{k}]" if isinstance(k, int) else f".{k}" if plain(k) else f"['{k}']" for k in path)


def discover_json_anchor(spark: SparkSession, inventory: list[tuple[str, str, str]], rows: int = 20) -> tuple[AnchorSource, str]:
    """Where no table has an anchor column: of the tables with device and poll columns and a JSON text or variant in which an anchor's name stands at
    any depth, the one of the best score (of equal ones the last description), and the path. ``anchor`` is the JSON column.

    The first ``rows`` that aren't null of each such column are searched, by executors; only the path comes back.
    """
    names = frozenset(ANCHOR_NAMES)

    @F.udf("string")
    def found_at(text: str) -> str | None:
        try:
            path = key_path(json.loads(text), names)
        except ValueError:
            return None
        return json_path(path) if path else None

    found: list[tuple[AnchorSource, str]] = []
    for t, columns in _by_table(inventory).items():
        backend, poll = _first(BACKEND_NAMES, columns), _first(POLL_NAMES, columns)
        for c, kind in [(c, kind) for table, c, kind in inventory if table == t and kind in ("string", "variant")] if backend and poll else ():
            value = F.to_json(F.col(c)) if kind == "variant" else F.col(c)
            path = spark.table(t).where(F.col(c).isNotNull()).select(value.alias("body")).limit(rows).select(found_at("body").alias("path")).where("path IS NOT NULL").first()
            if path:
                found.append((AnchorSource(t, c, backend, poll, JSON_POINTS + _table_points(t)), path.path))
    if not found:
        raise LookupError("no table has an anchor in a JSON column")
    return max(found, key=lambda x: (x[0].score, x[0].table, x[0].anchor))
