"""What names say about columns and tables. Pure functions on strings."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

# Fixed values, down to HIERARCHY_PATTERNS: the rule constants that results depend on.
IDENTITY_PARTS = ["_id", "_key", "_code", "_ref", "_number", "sys_id", "uuid", "guid"]
MODERATE_PARTS = ["id", "key", "code", "ref", "number"]
KEY_BLACKLIST = ["email", "phone", "price", "amount", "cost", "total", "quantity", "date", "timestamp", "name", "description", "address", "status", "city", "state", "zip", "country", "supplier", "category"]
PRIMARY_KEY_BLACKLIST = [
    "email", "phone", "mobile", "fax", "contact", "price", "amount", "cost", "total", "subtotal",
    "tax", "discount", "quantity", "qty", "count", "balance", "payment", "salary", "wage", "date",
    "time", "timestamp", "created", "updated", "modified", "name", "description", "desc", "title", "label",
    "comment", "note", "status", "state", "type", "category", "class", "level", "priority", "address",
    "street", "city", "zip", "postal", "country", "product", "item", "sku", "barcode", "isbn",
    "supplier", "vendor", "manufacturer", "brand", "model", "order_date", "ship_date", "delivery_date", "due_date",
]
ENTITY_WORDS = ["supplier", "vendor", "manufacturer", "customer", "employee", "product", "order", "invoice", "contract", "location", "company"]
CATEGORICAL_WORDS = ["state", "status", "type", "category", "level", "grade", "class", "rank", "priority", "severity"]
CONTACT_WORDS = ["email", "phone", "address", "contact", "website", "city", "zip"]
NAME_WORDS = ["name", "description", "label", "title", "desc"]
COMMON_WORDS = ["id", "code", "name", "desc", "description", "number", "num", "value", "text", "data", "info", "type", "status"]
STRUCTURAL_WORDS = ["email", "phone", "address", "street", "city", "state", "zip", "postal", "country", "website", "url", "contact", "fax"]
TEMPORAL_WORDS = ["date", "time", "timestamp", "created", "updated", "modified", "occurred", "logged", "recorded"]
STATUS_WORDS = ["status", "state", "stage", "phase", "step", "condition"]
ITEM_WORDS = ["item", "line", "detail", "entry", "component", "part"]
SEQUENCE_WORDS = ["seq", "sequence", "order", "position", "index", "number", "rank"]
CHILD_SUFFIXES = ["_items", "_events", "_history", "_log", "_details", "_lines", "_entries", "_transactions"]
ADDRESS_WORDS = ["address", "addr", "location", "street"]
FULL_NAME_WORDS = ["name", "fullname", "full_name"]
ROLE_WORDS = {
    "identifiers": ["id", "key", "code", "number"],
    "descriptive": ["name", "description", "title", "label"],
    "temporal": ["date", "time", "timestamp", "created", "updated"],
    "quantitative": ["amount", "quantity", "price", "total", "count"],
}
BUSINESS_WORDS = ["name", "title", "description", "desc", "label", "category", "status", "state", "type", "kind", "tag", "skill", "attribute", "feature", "property", "quantity", "qty", "amount", "price", "cost", "value", "address", "email", "phone", "contact", "note", "comment", "remark", "message"]
RESERVED = {
    "ACCESS", "ADD", "ALL", "ALTER", "AND", "ANY", "AS", "ASC", "AUDIT", "BETWEEN",
    "BY", "CHAR", "CHECK", "CLUSTER", "COLUMN", "COMMENT", "COMPRESS", "CONNECT", "CREATE", "CURRENT",
    "DATE", "DECIMAL", "DEFAULT", "DELETE", "DESC", "DISTINCT", "DROP", "ELSE", "EXCLUSIVE", "EXISTS",
    "FILE", "FLOAT", "FOR", "FROM", "GRANT", "GROUP", "HAVING", "IDENTIFIED", "IMMEDIATE", "IN",
    "INCREMENT", "INDEX", "INITIAL", "INSERT", "INTEGER", "INTERSECT", "INTO", "IS", "LEVEL", "LIKE",
    "LOCK", "LONG", "MAXEXTENTS", "MINUS", "MLSLABEL", "MODE", "MODIFY", "NOAUDIT", "NOCOMPRESS", "NOT",
    "NOWAIT", "NULL", "NUMBER", "OF", "OFFLINE", "ON", "ONLINE", "OPTION", "OR", "ORDER",
    "PCTFREE", "PRIOR", "PRIVILEGES", "PUBLIC", "RAW", "RENAME", "RESOURCE", "REVOKE", "ROW", "ROWID",
    "ROWNUM", "ROWS", "SELECT", "SESSION", "SET", "SHARE", "SIZE", "SMALLINT", "START", "SUCCESSFUL",
    "SYNONYM", "SYSDATE", "TABLE", "THEN", "TO", "TRIGGER", "UID", "UNION", "UNIQUE", "UPDATE",
    "USER", "VALIDATE", "VALUES", "VARCHAR", "VARCHAR2", "VIEW", "WHENEVER", "WHERE", "WITH", "TIMESTAMP",
    "INTERVAL", "YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND", "TIMEZONE", "PARTITION", "SUBPARTITION",
    "ENABLE", "DISABLE", "SEQUENCE", "TYPE", "BODY", "PACKAGE", "PROCEDURE", "FUNCTION", "CURSOR", "EXCEPTION",
}
MAX_IDENTIFIER = 30
KEY_PARTS = ["_id", "_key", "_code", "_ref"]
HIERARCHY_PATTERNS = [r"parent_(.+)", r"(.+)_parent", r"manager_(.+)", r"supervisor_(.+)", r"chief_(.+)", r"head_(.+)"]


def has_any(name: str, parts) -> bool:
    low = name.lower()
    return any(p in low for p in parts)


@dataclass(frozen=True)
class Identity:
    """strength: 'high' (an identity part anywhere), 'moderate' (a looser sign) or '' (none)."""

    strength: str

    def __bool__(self) -> bool:
        return bool(self.strength)


def identity(name: str, mode: str = "textbook") -> Identity:
    """Whether a name reads like an identifier. In ``compat`` mode a loose part counts at either end of the name
    ('paid'); in ``textbook`` mode only as a whole word."""
    low = name.lower()
    if has_any(low, IDENTITY_PARTS):
        return Identity("high")
    words = [w for w in re.split(r"[^a-z0-9]+", low) if w]
    if any(w in MODERATE_PARTS for w in words):
        return Identity("moderate")
    if mode == "compat" and any(low.startswith(p) or low.endswith(p) for p in MODERATE_PARTS):
        return Identity("moderate")
    return Identity("")


def key_name(name: str, mode: str = "textbook") -> bool:
    """Whether a single column of this name may be a candidate key."""
    low = name.lower()
    exempt = mode == "textbook" and re.search(r"_(id|key|code)$", low)
    if has_any(low, KEY_BLACKLIST) and not exempt:
        return False
    return has_any(low, IDENTITY_PARTS) or low.startswith(("id", "key", "code")) or low.endswith(("id", "key", "code"))


def foreign_key_name(name: str) -> bool:
    low = name.lower()
    return has_any(low, KEY_PARTS) or low.endswith("id")


def base_name(column: str) -> str:
    """A key column's name without its key part: 'customer_id' -> 'customer'."""
    low = column.lower()
    for part in KEY_PARTS:
        low = low.replace(part, "")
    return low


def matching_parent(column: str, parents: list[str]) -> str | None:
    """The table whose name goes best with the column: equal to, holding or held by its base; the longest name."""
    base = base_name(column)
    fits = [p for p in parents if base and (base == p.lower() or base in p.lower() or p.lower() in base)]
    return max(fits, key=len) if fits else None


def hierarchical(column: str, table: str) -> bool:
    """Whether a column's name points to its own table: parent_x, x_parent, manager_x, ... with x in the table's
    name, or parent_<entity>_id beside <entity>_id."""
    low, own = column.lower(), table.lower()
    for pattern in HIERARCHY_PATTERNS:
        m = re.match(pattern, low)
        if m and m[1] in own:
            return True
    return False


def is_child_table(name: str) -> bool:
    return any(s in name.lower() for s in CHILD_SUFFIXES)


def role(name: str, unique_count: int) -> str:
    for bucket, words in ROLE_WORDS.items():
        if has_any(name, words):
            return bucket
    return "categorical" if unique_count < 50 else "other"


def business_name(name: str) -> bool:
    return not name.lower().endswith("_id") and has_any(name, BUSINESS_WORDS)


def sanitize(name: str, reserved_suffix: str = "_col") -> str:
    """A valid identifier of at most 30 characters; longer ones keep 25 and four digits of the name's md5."""
    out = re.sub(r"_+", "_", re.sub(r"[^A-Za-z0-9_]", "_", name))
    if not out or not out[0].isalpha() or not out[0].isascii():
        out = f"col_{out}"
    if out.upper() in RESERVED:
        out += reserved_suffix
    return shorten(out, name)


def shorten(identifier: str, source: str | None = None) -> str:
    if len(identifier) <= MAX_IDENTIFIER:
        return identifier
    return f"{identifier[:25]}_{hashlib.md5((source or identifier).encode()).hexdigest()[:4]}"


def unique_name(wanted: str, taken) -> str:
    """wanted, or wanted_1, wanted_2, ... whichever is free."""
    name, k = wanted, 0
    while name in taken:
        k += 1
        name = f"{wanted}_{k}"
    return name
