"""Registries of domain profiles: JSON files or one SQLite file, trusted by hash, as tables.

A registry has few rows and is read on the driver. What is trusted is the SHA-256 of its bytes, given by the caller or checked
by `verify(bytes)`, which may test a signature (none is built in); boundary files are trusted by the hash in their profile.
"""

from __future__ import annotations

import hashlib
import json
import os
import sqlite3
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from meshlark.errors import ContractError

# The columns of a profile that registries share.
DOMAIN_COLUMNS = {"domain_id": "bigint", "domain_code": "string", "name": "string", "origin_x_m": "double", "origin_y_m": "double", "root_side_m": "double"}
PROFILE_COLUMNS = {"profile_version": "string", "crs_authority": "string", "min_level": "bigint", "max_level": "bigint", "boundary_file": "string", "boundary_sha256": "string"}
SCALE_COLUMNS = {"algorithm": "string", "sample_count": "bigint", "max_error_pct": "double"}
TABLES = {"domains": DOMAIN_COLUMNS, "profiles": PROFILE_COLUMNS, "scale_metadata": SCALE_COLUMNS}
KEY = "domain_id"

Verify = Callable[[bytes], bool]


def _trusted(path: Path, sha256: str | None, verify: Verify | None) -> bytes:
    data = path.read_bytes()
    if sha256 is None and verify is None:
        raise ContractError("a registry needs a hash or a verifier to be trusted")
    if sha256 is not None and hashlib.sha256(data).hexdigest() != sha256:
        raise ContractError(f"{path.name} isn't the registry expected")
    if verify is not None and not verify(data):
        raise ContractError(f"{path.name} doesn't pass its verifier")
    return data


def _frame(spark: SparkSession, rows: list[dict], columns: dict[str, str]) -> DataFrame:
    schema = ", ".join(f"{c} {t}" for c, t in columns.items())
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], schema)


def joined(domains: DataFrame, profiles: DataFrame, scale: DataFrame) -> DataFrame:
    """A row for each domain: inner joins on its id. Domains, profiles and scale must meet one to one."""
    every = domains.join(profiles, KEY).join(scale, KEY)
    counts = [df.select(F.count(F.lit(1)).alias("n"), F.count_distinct(KEY).alias("d")).first() for df in (domains, profiles, scale, every)]
    if len({(c["n"], c["d"]) for c in counts}) > 1 or counts[0]["n"] != counts[0]["d"]:
        raise ContractError("domains, profiles and scale don't meet one to one")
    return every


def _checked(rows: DataFrame, boundaries: str | None) -> DataFrame:
    if boundaries is not None:
        for r in rows.select("boundary_file", "boundary_sha256").collect():
            path = Path(boundaries, r["boundary_file"]).resolve()
            if not path.is_relative_to(Path(boundaries).resolve()) or hashlib.sha256(path.read_bytes()).hexdigest() != r["boundary_sha256"]:
                raise ContractError(f"boundary {r['boundary_file']} isn't the one expected")
    return rows


def read_json(spark: SparkSession, path: str, sha256: str | None = None, verify: Verify | None = None, boundaries: str | None = None) -> DataFrame:
    """Profiles of a JSON registry: an object with a list under each name of TABLES."""
    doc = json.loads(_trusted(Path(path), sha256, verify))
    if not isinstance(doc, dict) or not set(TABLES) <= set(doc):
        raise ContractError(f"a registry has {', '.join(TABLES)}")
    parts = [_frame(spark, doc[t], {KEY: "bigint"} | c) for t, c in TABLES.items()]
    return _checked(joined(*parts), boundaries)


def read_sqlite(spark: SparkSession, path: str, sha256: str | None = None, verify: Verify | None = None, boundaries: str | None = None) -> DataFrame:
    """Profiles of a SQLite registry with the tables of TABLES, of the bytes that were trusted and no others."""
    data = _trusted(Path(path), sha256, verify)
    db = sqlite3.connect(":memory:")
    try:
        db.deserialize(data)
        db.row_factory = sqlite3.Row
        parts = []
        for t, c in TABLES.items():
            columns = {KEY: "bigint"} | c
            rows = [dict(r) for r in db.execute(f"SELECT {', '.join(columns)} FROM {t}")]
            parts.append(_frame(spark, rows, columns))
    except sqlite3.DatabaseError as e:
        raise ContractError(f"{path} is no registry: {e}") from None
    finally:
        db.close()
    return _checked(joined(*parts), boundaries)


def migrate(source: str, target: str, sha256: str | None = None, verify: Verify | None = None) -> str:
    """A JSON registry as a SQLite file, all or nothing; an existing target is never replaced. Returns the file's SHA-256."""
    doc = json.loads(_trusted(Path(source), sha256, verify))
    if Path(target).exists():
        raise ContractError(f"{target} exists")
    handle, part = tempfile.mkstemp(dir=Path(target).parent, prefix=".registry-")
    os.close(handle)
    kinds = {"bigint": "INTEGER", "double": "REAL", "string": "TEXT"}
    try:
        db = sqlite3.connect(part)
        with db:
            for t, c in TABLES.items():
                columns = {KEY: "bigint"} | c
                db.execute(f"CREATE TABLE {t} ({', '.join(f'{n} {kinds[k]}' + (' PRIMARY KEY' if n == KEY else '') for n, k in columns.items())})")
                db.executemany(f"INSERT INTO {t} VALUES ({', '.join('?' * len(columns))})", [tuple(r.get(n) for n in columns) for r in doc[t]])
        db.close()
        data = Path(part).read_bytes()
        os.link(part, target)  # fails where the target has come to exist
    except (KeyError, TypeError, sqlite3.Error) as e:
        raise ContractError(f"{source} can't be migrated: {e}") from None
    finally:
        os.unlink(part)
    return hashlib.sha256(data).hexdigest()
