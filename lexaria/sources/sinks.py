"""Sinks: JSON written whole or not at all, appended JSON lines, CSV that never overwrites, Markdown tables, verified copies."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile

from pyspark.sql import DataFrame


def write_json(path: str, value: object) -> None:
    """One JSON file: written beside, synced and renamed, so that readers see the old or the new one."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, beside = tempfile.mkstemp(dir=folder, suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(value, f, ensure_ascii=False, indent=1, sort_keys=True)
            f.flush()
            os.fsync(f.fileno())
        os.replace(beside, path)
    except BaseException:
        os.unlink(beside)
        raise


def append_jsonl(df: DataFrame, path: str) -> None:
    """Rows as JSON lines next to those that are there."""
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV folder that must not be there yet."""
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def markdown(df: DataFrame, most: int = 10_000, digits: int = 4) -> str:
    """A small result as a Markdown table: numbers to the right, floats rounded, nulls as dashes; more rows than most are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no table to read")
    numeric = [t in ("int", "bigint", "double", "float", "smallint", "tinyint") or t.startswith("decimal") for _, t in df.dtypes]

    def cell(x: object) -> str:
        return "–" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x).replace("|", "\\|").replace("\n", " ")

    head = [f"| {' | '.join(df.columns)} |", f"|{'|'.join('---:' if n else '---' for n in numeric)}|"]
    return "\n".join(head + [f"| {' | '.join(map(cell, r))} |" for r in rows]) + "\n"


def sha256(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while piece := f.read(1 << 20):
            digest.update(piece)
    return digest.hexdigest()


def blob_sha1(data: bytes) -> str:
    """The name that git gives to these bytes."""
    return hashlib.sha1(b"blob %d\0" % len(data) + data).hexdigest()


def verified(path: str, expected: str, most: int = 64 << 20) -> str:
    """The path, if the file is no larger than most and has the SHA-256 (or git blob SHA-1) expected; else an error."""
    if os.path.getsize(path) > most:
        raise ValueError(f"{path} exceeds {most} bytes")
    with open(path, "rb") as f:
        found = blob_sha1(f.read()) if len(expected) == 40 else None
    if (found or sha256(path)) != expected:
        raise ValueError(f"{path} isn't what was expected")
    return path
