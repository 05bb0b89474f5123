"""Raw polls to typed snapshot rows: JSON as VARIANT, so that one malformed part doesn't void the rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caldrift.functions.expr import edge_id, operational_from_name, parse_timestamp, variant_operational, variant_truth


def _get(v: str, path: str, kind: str = "string") -> Column:
    return F.expr(f"try_variant_get({v}, '{path}', '{kind}')")


def parse_status(raw: DataFrame) -> DataFrame:
    """``raw`` (poll, status, summary as JSON texts) with pending_jobs, operational, status_name and status_msg, each the first
    of its sources that can be read; any ``state`` or ``operational`` but null is read, leniently."""
    v = raw.withColumn("s", F.expr("try_parse_json(status)")).withColumn("m", F.expr("try_parse_json(summary)"))
    name = F.coalesce(_get("s", "$.status"), _get("m", "$.status.name"))
    return v.select(
        "poll",
        F.coalesce(_get("m", "$.queue_length", "int"), _get("s", "$.length_queue", "int"), _get("s", "$.pending_jobs", "int")).alias("pending_jobs"),
        F.coalesce(*[variant_truth(F.expr(f"try_variant_get(s, '$.{c}', 'variant')")) for c in ("state", "operational")], operational_from_name(name)).alias("operational"),
        name.alias("status_name"),
        F.coalesce(_get("s", "$.message"), _get("s", "$.status_msg"), _get("m", "$.status.reason")).alias("status_msg"),
    )


def _variant(v: str, path: str) -> Column:
    return F.try_variant_get(F.col(v), path, "variant")


#: A property as it is read: in one step from the payload, with its value still a variant as JSON types decide. What isn't an object is null.
NAMED = "name: string, value: variant"
PROPERTY = f"struct<{NAMED}, unit: string, date: string>"


def _keys(item: Column) -> Column:
    """The keys of an object, by a look at its own members only (their values are read as flags, so nothing below them is copied); null for anything else."""
    return F.map_keys(F.try_variant_get(item, "$", "map<string, boolean>"))


def _first_named(items: Column, name: str) -> Column:
    """The first property of a name, in any case and trimmed, in an array of properties, or null."""
    return F.try_element_at(F.filter(items, lambda x: F.lower(F.trim(x["name"])) == name), F.lit(1))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: within a lambda every mention of an expression is worked out anew."""
    return F.try_element_at(F.transform(F.array(value), body), F.lit(1))


def _or_empty(found: Column, there: Column) -> Column:
    """A list that was found; where none was, an empty one if nothing that counts is there, and else null."""
    return F.when(found.isNotNull(), found).when(~F.coalesce(variant_truth(there), F.lit(False)), F.array())


def _entries(item: Column, path: str, kind: str) -> Column:
    """A list in a variant, its entries read as ``kind``; empty where there is nothing that counts; null where something else stands there."""
    return _let(F.try_variant_get(item, path, f"array<{kind}>"), lambda found: _or_empty(found, F.try_variant_get(item, path, "variant")))


def _integers(item: Column) -> Column:
    """The qubits of a gate; null where one isn't an integer."""
    numbers = F.transform(_entries(item, "$", "variant"), lambda x: F.coalesce(F.try_variant_get(x, "$", "int"), F.try_variant_get(x, "$", "string").try_cast("int")))
    return _let(numbers, lambda found: F.when(F.forall(found, lambda x: x.isNotNull()), found))


def _qubit(props: Column) -> Column:
    """An entry of ``qubits``: its list of properties, null if it is none, and the first of them named operational."""
    return F.struct(props.alias("props"), _first_named(props, "operational").alias("own"))


def _gate_type(qubits: str, parameters: str) -> str:
    return f"struct<gate: string, name: string, qubits: {qubits}, parameters: {parameters}, operational: variant>"


def _is_plain(gate: Column) -> Column:
    """Whether a gate's lists could be read as lists at once."""
    return gate["parameters"].isNotNull() & F.coalesce(F.forall(gate["qubits"], lambda x: x.isNotNull()), F.lit(False))


def _mended(gate: Column, parameter: str) -> Column:
    """A gate whose lists are read one by one: they may be left out, or not be lists."""
    return F.struct(gate["gate"].alias("gate"), gate["name"].alias("name"), _integers(gate["qubits"]).alias("qubits"), _entries(gate["parameters"], "$", parameter).alias("parameters"), gate["operational"].alias("operational"))


def _gate(item: Column) -> Column:
    """An entry of ``gates``: its name, qubits and list of parameters, null where they are none, the first parameter named operational, and the gate's own
    key of that name."""
    own = item["operational"]
    return F.struct(F.coalesce(item["gate"], item["name"]).alias("name"), item["qubits"].alias("qubits"), item["parameters"].alias("params"), _first_named(item["parameters"], "operational").alias("own"), own.alias("state"), own.isNotNull().alias("has_state"))


def _is_gate(gate: Column) -> Column:
    """Whether an entry of ``gates`` counts: one with a name, integer qubits and a list of parameters."""
    return gate["name"].isNotNull() & gate["qubits"].isNotNull() & gate["params"].isNotNull()


def _reported(gate: Column) -> Column:
    """A gate's state as a variant: of the first parameter of that name, or else its own key."""
    return F.when(gate["own"].isNotNull(), gate["own"]["value"]).otherwise(gate["state"])


def _found(gate: Column) -> Column:
    return gate["own"].isNotNull() | gate["has_state"]


def _payload_error() -> Column:
    """Why a properties payload fails as a whole, or null: missing, not an object, with errors, without qubits or gates, one of them
    not a list, or an operational state of a qubit or a gate that can't be read."""
    v = F.col("v")
    bad_qubit = lambda q: q["own"].isNotNull() & _let(q["own"]["value"], variant_operational).isNull()
    bad_gate = lambda g: _is_gate(g) & _found(g) & _let(_reported(g), variant_operational).isNull()
    return (
        F.when(v.isNull() | F.is_variant_null(v), "payload is null")
        .when(F.col("members").isNull(), "payload is not an object")
        .when(F.coalesce(variant_truth(_variant("v", "$.errors")), F.lit(False)), "payload reports errors")
        .when(~F.array_contains("members", "qubits") | ~F.array_contains("members", "gates"), "payload lacks qubits or gates")
        .when(F.col("decoded_qubits").isNull(), "qubits is no list")
        .when(F.coalesce(F.exists("decoded_qubits", bad_qubit), F.lit(False)), "a qubit's operational state is unreadable")
        .when(F.col("decoded_gates").isNull(), "gates is no list")
        .when(F.coalesce(F.exists("decoded_gates", bad_gate), F.lit(False)), "a gate's operational state is unreadable")
    )


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is worked out once a row: as the only element of an exploded array it can't be merged into each expression
    and filter that uses it, as a projection would be."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _decoded(raw: DataFrame, qubit: str = f"struct<{NAMED}>", parameter: str = f"struct<{NAMED}>") -> DataFrame:
    """``raw`` with the payload as VARIANT ``v``, its qubits and gates read once into arrays of structs, and its ``error``. Of the properties of qubits and
    the parameters of gates the given members are read; names and values are needed for the error."""
    read = _once(raw, "v", F.expr("try_parse_json(properties)"))
    read = _once(read, "members", _keys(F.col("v")))
    read = _once(read, "listed", F.try_variant_get(F.col("v"), "$.qubits", f"array<array<{qubit}>>"))
    read = _once(read, "decoded_qubits", F.transform(_or_empty(F.col("listed"), _variant("v", "$.qubits")), _qubit))
    # nearly all payloads' gates are read in one step; where one is odd its payload's are read again, list by list
    read = _once(read, "plain", F.try_variant_get(F.col("v"), "$.gates", f"array<{_gate_type('array<int>', f'array<{parameter}>')}>"))
    mended = F.transform(_entries(F.col("v"), "$.gates", _gate_type("variant", "variant")), lambda g: _mended(g, parameter))
    read = _once(read, "decoded_gates", F.transform(F.when(F.forall("plain", _is_plain), F.col("plain")).otherwise(mended), _gate))
    return _once(read, "error", _payload_error()).drop("members", "listed", "plain")


def payloads(raw: DataFrame) -> DataFrame:
    """``raw`` (poll, properties as a JSON text) with the payload as VARIANT ``v`` and its ``error``."""
    return _decoded(raw).drop("decoded_qubits", "decoded_gates")


def _measured() -> list[Column]:
    """value, unit and date of a property ``p``."""
    return [F.try_variant_get(F.col("p.value"), "$", "double").alias("value"), F.col("p.unit").alias("unit"), parse_timestamp(F.col("p.date")).alias("date")]


def _qubit_lists(raw: DataFrame) -> DataFrame:
    """(poll, qubit, props, own): each list in ``qubits`` of good payloads; the qubit is its place."""
    good = _decoded(raw, qubit=PROPERTY).where("error IS NULL")
    return good.select("poll", F.posexplode("decoded_qubits").alias("qubit", "q")).where("q.props IS NOT NULL").select("poll", "qubit", "q.props", "q.own")


def qubit_properties(raw: DataFrame) -> DataFrame:
    """(poll, qubit, property_name, value, unit, date): nameless and non-object properties are skipped."""
    rows = _qubit_lists(raw).select("poll", "qubit", F.explode("props").alias("p")).where("p.name IS NOT NULL")
    return rows.select("poll", "qubit", F.col("p.name").alias("property_name"), *_measured())


def qubit_properties_named(raw: DataFrame, name: str) -> DataFrame:
    """(poll, qubit, text): the value of each qubit's first property of a name, trimmed and in any case."""
    rows = _qubit_lists(raw).withColumn("p", _first_named(F.col("props"), name.strip().lower()))
    return rows.where("p IS NOT NULL").select("poll", "qubit", F.try_variant_get(F.col("p.value"), "$", "string").alias("text"))


def qubit_operational(raw: DataFrame) -> DataFrame:
    """(poll, qubit, reported, effective, is_explicit, date): from the first property named operational; a row for every listed qubit.

    A state that can't be read fails its whole payload, so none is left here.
    """
    value = variant_operational(F.col("own.value"))
    return _qubit_lists(raw).select("poll", "qubit", value.alias("reported"), F.coalesce(value, F.lit(True)).alias("effective"), F.col("own").isNotNull().alias("is_explicit"), parse_timestamp(F.col("own.date")).alias("date"))


def _gate_rows(raw: DataFrame, parameter: str = f"struct<{NAMED}>") -> DataFrame:
    """(poll, gate_name, qubits, g): gates of good payloads that count, as ``_gate`` has them."""
    gates = _decoded(raw, parameter=parameter).where("error IS NULL").select("poll", F.explode("decoded_gates").alias("g")).where(_is_gate(F.col("g")))
    return gates.select("poll", F.col("g.name").alias("gate_name"), "g.qubits", "g")


def _gate_keys(mode: str) -> list[Column]:
    q = F.col("qubits")
    return [F.array_join(q.cast("array<string>"), ",").alias("qubits_key"), F.when(F.size(q) == 2, edge_id(F.try_element_at(q, F.lit(1)), F.try_element_at(q, F.lit(2)), mode)).alias("edge_id")]


def gate_properties(raw: DataFrame, mode: str = "undirected") -> DataFrame:
    """(poll, gate_name, qubits_key, edge_id, parameter_name, value, unit, date)."""
    params = _gate_rows(raw, PROPERTY).select("poll", "gate_name", "qubits", F.explode("g.params").alias("p")).where("p.name IS NOT NULL")
    return params.select("poll", "gate_name", *_gate_keys(mode), F.col("p.name").alias("parameter_name"), *_measured())


def gate_operational(raw: DataFrame, mode: str = "undirected") -> DataFrame:
    """(poll, gate_name, qubits_key, edge_id, reported, effective, is_explicit): a parameter named operational, or else the
    gate's own key; a row also for gates without parameters. A state that can't be read fails its whole payload."""
    g = F.col("g")
    found, value = _found(g), F.when(_found(g), variant_operational(_reported(g)))
    return _gate_rows(raw).select("poll", "gate_name", *_gate_keys(mode), value.alias("reported"), F.coalesce(value, F.lit(True)).alias("effective"), found.alias("is_explicit"))


def device_index(raw: DataFrame) -> DataFrame:
    """(name, device): the last object of each name in ``devices``; others are skipped."""
    v = raw.select(F.expr("try_parse_json(body)").alias("v"))
    rows = v.select(F.posexplode(_entries(F.col("v"), "$.devices", "variant")).alias("pos", "d"))
    return rows.withColumn("name", _get("d", "$.name")).where("name IS NOT NULL").groupBy("name").agg(F.max_by(F.to_json("d"), "pos").alias("device"))
