"""Identifiers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_DNS) -> Column:
    """Name-based UUID of version 5: SHA-1 of namespace and name, with version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "utf-8")))
    piece = lambda start, n: F.substring(digest, start, n)
    variant = F.lower(F.hex(F.conv(piece(17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", piece(1, 8), piece(9, 4), F.concat(F.lit("5"), piece(14, 3)),
                       F.concat(variant, piece(18, 3)), piece(21, 12))


def point_id(chunk_id: Column) -> Column:
    """Identifier under which a chunk is stored, the same at every run."""
    return uuid5(chunk_id)


def document_id(filename: Column, content: Column | None = None) -> Column:
    """16 hex digits: 8 of the name's MD5, 8 of the content's SHA-256, or random ones without content."""
    tail = F.replace(F.uuid(), F.lit("-"), F.lit("")) if content is None else F.sha2(content, 256)
    return F.concat(F.substring(F.md5(filename), 1, 8), F.substring(tail, 1, 8))
