"""SQL text of the canonical row hash, for the SQL twins only."""

from __future__ import annotations


def frame_sql(content: str, tag: str) -> str:
    return (f"(CASE WHEN {content} IS NULL THEN unhex('0000000000') ELSE "
            f"unhex('{tag}' || printf('%08X', octet_length({content}))) || {content} END)")


def column_sql(name: str, kind: str, scale: int | None) -> str:
    if kind == "NUMBER":
        width = 38 if scale == 0 else 18
        return frame_sql(f"encode(CAST(CAST({name} AS DECIMAL({width},{scale})) AS VARCHAR))", "02")
    if kind == "TIMESTAMP":
        return frame_sql(f"encode(strftime({name}, '%Y-%m-%dT%H:%M:%S.%fZ'))", "03")
    if kind == "STRING":
        text = f"encode(nfc_normalize(NULLIF({name}, '')))"
        lob = frame_sql(f"unhex(sha256({text}))", "05")
        return f"(CASE WHEN octet_length({text}) > 2000 THEN {lob} ELSE {frame_sql(text, '01')} END)"
    if kind == "LOB":
        return frame_sql(f"unhex(sha256(encode(nfc_normalize(NULLIF({name}, '')))))", "05")
    if kind == "BINARY":
        return frame_sql(name, "04")
    raise ValueError(kind)


def row_hash_sql(rules) -> str:
    """``rules``: (column, kind, scale) in mapping order."""
    digests = [f"unhex(sha256({column_sql(*r)}))" for r in rules]
    groups = [digests[i:i + 32] for i in range(0, len(digests), 32)]
    parts = [f"unhex(sha256(unhex('FE{len(g):08X}') || {' || '.join(g)}))" for g in groups]
    return f"sha256(unhex('FF{len(digests):08X}') || {' || '.join(parts)})"
