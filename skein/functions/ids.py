"""Deterministic identifiers as expressions: UUIDv5 names, content hashes, collection names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the URL namespace of RFC 9562.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """UUIDv5 of a name in the URL namespace; null for null."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), name.cast("binary")))
    variant = F.substr(F.lit("89ab"), F.conv(F.substr(h, F.lit(17), F.lit(1)), 16, 10).cast("int").bitwiseAND(3) + 1, F.lit(1))
    part = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def chunk_id(file_path: Column, chunk_index: Column, file_hash: Column) -> Column:
    return uuid5(F.concat(file_path, F.lit(":"), chunk_index.cast("string"), F.lit(":"), file_hash))


def node_id(file_path: Column, label: Column, name: Column, start_line: Column) -> Column:
    return uuid5(F.concat(file_path, F.lit(":"), label, F.lit(":"), name, F.lit(":"), start_line.cast("string")))


def glossary_id(file_path: Column, kind: Column, term: Column, symbol_id: Column) -> Column:
    return uuid5(F.concat(F.coalesce(file_path, F.lit("")), F.lit(":GlossaryEntry:"), kind, F.lit(":"), term, F.lit(":"), F.coalesce(symbol_id, F.lit(""))))


def content_hash(content: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the content; empty for null (unreadable)."""
    return F.coalesce(F.substr(F.sha2(content, 256), F.lit(1), F.lit(16)), F.lit(""))


def collection_name(base: Column, model: Column, dimensions: Column) -> Column:
    """Base, model and dimensions joined: the model without what is before its last / and behind its first :."""
    short = F.split_part(F.element_at(F.split(model, "/"), -1), F.lit(":"), F.lit(1))
    return F.concat_ws("_", base, short, dimensions.cast("string"))
