"""SQL statements as text for external databases, in PostgreSQL's and MySQL's dialects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

POSTGRES = "postgresql"
QUOTES = {POSTGRES: '"', "mysql": "`"}


def quote(name: str, dialect: str = POSTGRES) -> str:
    """Each part of a dotted name in the dialect's quotes."""
    q = QUOTES[dialect]
    return ".".join(part if part == "*" else f"{q}{part.replace(q, q + q)}{q}" for part in name.split("."))


def literal(value: Any) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, int | float):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def paging(limit: int | None, offset: int | None, dialect: str = POSTGRES) -> str:
    """MySQL's LIMIT offset, n; an offset without a limit is kept, unlike in most builders."""
    if limit is None and not offset:
        return ""
    if dialect == "mysql":
        return f" LIMIT {f'{offset}, ' if offset else ''}{limit if limit is not None else 2**63 - 1}"
    return (f" LIMIT {limit}" if limit is not None else "") + (f" OFFSET {offset}" if offset else "")


def select(table: str, columns: Sequence[str] = ("*",), where: str | None = None, group_by: Sequence[str] = (), having: str | None = None, order_by: str | None = None, limit: int | None = None, offset: int | None = None, distinct: bool = False, dialect: str = POSTGRES) -> str:
    parts = [f"SELECT {'DISTINCT ' if distinct else ''}{', '.join(quote(c, dialect) for c in columns)} FROM {quote(table, dialect)}"]
    parts += [f"WHERE {where}"] if where else []
    parts += ["GROUP BY " + ", ".join(quote(c, dialect) for c in group_by)] if group_by else []
    parts += [f"HAVING {having}"] if having else []
    parts += [f"ORDER BY {order_by}"] if order_by else []
    return " ".join(parts) + paging(limit, offset, dialect)


def insert(table: str, columns: Sequence[str], on_conflict: str | None = None, dialect: str = POSTGRES) -> str:
    """With named parameters; on_conflict: ignore or update (on the first column)."""
    names = ", ".join(quote(c, dialect) for c in columns)
    text = f"INTO {quote(table, dialect)} ({names}) VALUES ({', '.join(':' + c for c in columns)})"
    if dialect == "mysql":
        update = ", ".join(f"{quote(c, dialect)} = VALUES({quote(c, dialect)})" for c in columns)
        return ("INSERT IGNORE " if on_conflict == "ignore" else "INSERT ") + text + (f" ON DUPLICATE KEY UPDATE {update}" if on_conflict == "update" else "")
    update = ", ".join(f"{quote(c)} = EXCLUDED.{quote(c)}" for c in columns[1:])
    tail = {"ignore": " ON CONFLICT DO NOTHING", "update": f" ON CONFLICT ({quote(columns[0])}) DO UPDATE SET {update}"}.get(on_conflict or "", "")
    return f"INSERT {text}{tail}"


def update(table: str, columns: Sequence[str], where: str, dialect: str = POSTGRES) -> str:
    return f"UPDATE {quote(table, dialect)} SET {', '.join(f'{quote(c, dialect)} = :{c}' for c in columns)} WHERE {where}"


def delete(table: str, where: str, dialect: str = POSTGRES) -> str:
    return f"DELETE FROM {quote(table, dialect)} WHERE {where}"


def create_table(table: str, columns: Sequence[Mapping[str, Any]], primary_key: Sequence[str] = (), foreign_keys: Sequence[Mapping[str, str]] = (), indexes: Sequence[Mapping[str, Any]] = (), dialect: str = POSTGRES) -> list[str]:
    """CREATE TABLE of {name, type, nullable, default, unique} columns, then the indexes' own statements."""
    lines = []
    for c in columns:
        line = f"{quote(c['name'], dialect)} {c['type']}"
        line += "" if c.get("nullable", True) else " NOT NULL"
        line += f" DEFAULT {literal(c['default'])}" if c.get("default") is not None else ""
        lines.append(line + (" UNIQUE" if c.get("unique") else ""))
    lines += [f"PRIMARY KEY ({', '.join(quote(k, dialect) for k in primary_key)})"] if primary_key else []
    lines += [f"FOREIGN KEY ({quote(k['column'], dialect)}) REFERENCES {quote(k['table'], dialect)} ({quote(k['references'], dialect)})" for k in foreign_keys]
    return [f"CREATE TABLE IF NOT EXISTS {quote(table, dialect)} ({', '.join(lines)})", *(create_index(table, dialect=dialect, **i) for i in indexes)]


def create_index(table: str, name: str, columns: Sequence[str], unique: bool = False, where: str | None = None, dialect: str = POSTGRES) -> str:
    tail = f" WHERE {where}" if where and dialect == "postgresql" else ""
    return f"CREATE {'UNIQUE ' if unique else ''}INDEX {quote(name, dialect)} ON {quote(table, dialect)} ({', '.join(quote(c, dialect) for c in columns)}){tail}"
