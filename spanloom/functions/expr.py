"""Column expressions over the raw parts of a span (references, tags, logs, processes) and its names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parent_id(references: Column) -> Column:
    """The span of the last CHILD_OF reference; FOLLOWS_FROM does not count."""
    return F.try_element_at(F.filter(references, lambda r: r["refType"] == "CHILD_OF"), F.lit(-1))["spanID"]


def tag(tags: Column, key: str) -> Column:
    """Value of the first tag of that name, in any case."""
    return F.try_element_at(F.filter(tags, lambda t: F.lower(t["key"]) == key), F.lit(1))["value"]


def kind(tags: Column) -> Column:
    value = F.lower(tag(tags, "span.kind"))
    return F.when(value == "client", "CLIENT").when(value == "server", "SERVER").otherwise("UNKNOWN")


def is_error(tags: Column, logs: Column) -> Column:
    """A string-typed or truthy `error` tag, an HTTP status of 400 and more, a gRPC status other than OK, or a log field `error.object`,
    string-typed `error` or `event` = error."""
    truthy = lambda v: v.isNotNull() & ~F.lower(v).isin("", "false", "0")

    def bad_tag(t: Column) -> Column:
        key = F.lower(t["key"])
        return (
            ((key == "error") & ((F.lower(t["type"]) == "string") | truthy(t["value"])))
            | ((key == "http.status_code") & F.coalesce(t["value"].try_cast("int") >= 400, F.lit(False)))
            | ((key == "grpc.status") & (F.coalesce(t["value"], F.lit("")) != "") & (F.upper(t["value"]) != "OK"))
        )

    def bad_field(f: Column) -> Column:
        key = F.lower(f["key"])
        return (key == "error.object") | ((key == "error") & (F.lower(f["type"]) == "string")) | ((key == "event") & (F.lower(f["value"]) == "error"))

    return F.coalesce(F.exists(tags, bad_tag), F.lit(False)) | F.coalesce(F.exists(logs, lambda g: F.exists(g["fields"], bad_field)), F.lit(False))


def host(tags: Column) -> Column:
    return tag(tags, "hostname")


def region(tags: Column) -> Column:
    """The last region tag, else the first zone tag."""
    last = F.try_element_at(F.filter(tags, lambda t: F.lower(t["key"]) == "region"), F.lit(-1))["value"]
    return F.coalesce(last, tag(tags, "zone"))


def op_name(service: Column, op: Column) -> Column:
    return F.concat(F.lit("["), service, F.lit("] "), op)


def hex_id(number: Column) -> Column:
    """A signed 64-bit number as 16 hexadecimal digits."""
    return F.lower(F.lpad(F.hex(number), 16, "0"))


def plain(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-zA-Z0-9_]+", "_")


def plain_text(text: str) -> str:
    """The same of a Python string."""
    return re.sub("[^a-zA-Z0-9_]+", "_", text)


def trace_id_of_file(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/.]+)[^/]*$", 1)
