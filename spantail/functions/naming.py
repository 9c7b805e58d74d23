"""Names of sparse attribute columns, and quoting for generated SQL."""

from __future__ import annotations

import re

#: FNV-1a, 64 bits.
_OFFSET, _PRIME = 0xCBF29CE484222325, 0x100000001B3


def attr_key_hash(key: str) -> str:
    """The upper 32 bits of the key's FNV-1a hash, in lower-case hex."""
    h = _OFFSET
    for byte in key.encode():
        h = (h ^ byte) * _PRIME % (1 << 64)
    return f"{h >> 32:08x}"


def attr_column(key: str) -> str:
    """The column of an attribute key: readable, and different for keys that read alike."""
    return f"attr_{re.sub('[^A-Za-z0-9_]', '_', key)}_{attr_key_hash(key)}"


def quote_ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quote_string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def qualified(database: str, table: str) -> str:
    return f"{quote_ident(database)}.{quote_ident(table)}" if database else quote_ident(table)
