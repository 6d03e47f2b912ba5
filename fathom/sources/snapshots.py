"""Tables that are replaced as a whole, or part by part, without a moment in which a reader finds neither the old nor the new.

A version's rows are written beside the others, read back, counted and summed, and only then named in a manifest:
versions/<number>.json, which appears at once or not at all.  Readers take the newest manifest.  A write that breaks
leaves files that no manifest names.  Earlier versions stay until they are dropped, and can be made the newest again.

    data/<random name>/...              Parquet, or for parts data/<random name>/<column>=<value>/...
    versions/00000001.json              number, created, note, rows, checksum, schema, paths
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Broken(RuntimeError):
    """What was read back isn't what the manifest says."""


def _files(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def checksum(df: DataFrame) -> tuple[int, str]:
    """Rows, and a sum over them that doesn't depend on their order."""
    row = F.xxhash64(*(_plain(f) for f in df.schema)).cast("decimal(38,0)")
    n, total = df.agg(F.count("*"), F.sum(row)).first()
    return n, str(total or 0)


def _plain(field: T.StructField) -> Column:
    """A column as something that can be hashed."""
    return F.to_json(F.struct(F.col(f"`{field.name}`"))) if isinstance(field.dataType, (T.MapType, T.VariantType)) else F.col(f"`{field.name}`")


def versions(root: str) -> list[dict]:
    """All manifests, the oldest first."""
    from pyarrow import fs as pafs

    fs, place = _files(root)
    found = fs.get_file_info(pafs.FileSelector(f"{place}/versions", allow_not_found=True))
    out = []
    for info in sorted(found, key=lambda i: i.base_name):
        if info.base_name.endswith(".json"):
            with fs.open_input_stream(info.path) as f:
                out.append(json.loads(f.read()))
    return out


def _name(root: str, manifest: dict) -> dict:
    """Makes manifest the newest version.  The name is taken once: a second writer of the same number is refused."""
    from pyarrow import fs as pafs

    fs, place = _files(root)
    fs.create_dir(f"{place}/versions", recursive=True)
    path, part = f"{place}/versions/{manifest['number']:08d}.json", f"{place}/versions/.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(json.dumps(manifest, sort_keys=True).encode())
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_file(part)
        raise FileExistsError(f"version {manifest['number']} of {root} is there already")
    fs.move(part, path)
    return manifest


def _manifest(root: str, note: str, **about) -> dict:
    known = versions(root)
    return {"number": known[-1]["number"] + 1 if known else 1, "created": datetime.now(UTC).isoformat(), "note": note, **about}


def publish(df: DataFrame, root: str, note: str = "", parts: str | None = None, emptied: tuple = ()) -> dict:
    """Replaces the table at root by df and returns the manifest; with parts (a column), only the values of it that df has.

    Null values of parts are a part of their own.  Parts of the values in emptied go even if df has nothing for them.
    """
    spark, data = df.sparkSession, f"{root}/data/{uuid.uuid4().hex}"
    paths: dict[str, str] = {}
    if parts is None:
        df.write.parquet(data)
        paths[""] = data
    else:
        name = lambda value: F.sha2(F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("null")), 256)
        keyed = df.withColumn("_part", name(F.col(parts)))
        keyed.write.partitionBy("_part").parquet(data)
        old = versions(root)
        gone = set(spark.range(1).select(*(name(F.lit(v)).alias(str(i)) for i, v in enumerate(emptied))).first()) if emptied else set()
        paths |= {p: path for p, path in old[-1]["paths"].items() if p not in gone} if old else {}
        # a folder for each part that df has
        paths |= {p: f"{data}/_part={p}" for p in _folders(data)}
    about = {"schema": df.schema.jsonValue(), "paths": paths}
    n, total = checksum(_read(spark, about))
    if parts is None and (n, total) != checksum(df):
        raise Broken(f"{data} doesn't hold what was to be written")
    return _name(root, _manifest(root, note, rows=n, checksum=total, **about))


def _folders(data: str) -> list[str]:
    from pyarrow import fs as pafs

    fs, place = _files(data)
    return [i.base_name.removeprefix("_part=") for i in fs.get_file_info(pafs.FileSelector(place)) if i.base_name.startswith("_part=")]


def _read(spark: SparkSession, manifest: dict) -> DataFrame:
    schema = T.StructType.fromJson(manifest["schema"])
    paths = list(manifest["paths"].values())
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, root: str, number: int | None = None, verify: bool = False) -> DataFrame:
    """The newest version of the table at root, or the one of a number; verify reads it once to compare it with its manifest."""
    known = {m["number"]: m for m in versions(root)}
    if not known or number is not None and number not in known:
        raise FileNotFoundError(f"{root} has no version {number or ''}")
    manifest = known[number or max(known)]
    df = _read(spark, manifest)
    if verify and checksum(df) != (manifest["rows"], manifest["checksum"]):
        raise Broken(f"version {manifest['number']} of {root} isn't what its manifest says")
    return df


def restore(spark: SparkSession, root: str, number: int, note: str = "") -> dict:
    """Makes an earlier version the newest again, if it is whole."""
    read(spark, root, number, verify=True)
    old = next(m for m in versions(root) if m["number"] == number)
    return _name(root, _manifest(root, note or f"version {number} again", **{k: old[k] for k in ("rows", "checksum", "schema", "paths")}))


def backup(df: DataFrame, path: str, reason: str, taken: str) -> DataFrame:
    """Writes df as JSON lines below path/rows, and path/header with taken_at, reason, count and columns, which it returns."""
    df.write.json(f"{path}/rows")
    header = df.sparkSession.read.json(f"{path}/rows", schema=df.schema).agg(F.count("*").alias("count"))
    header = header.select(F.lit(taken).alias("taken_at"), F.lit(reason).alias("reason"), "count", F.lit(",".join(df.columns)).alias("columns"))
    header.write.json(f"{path}/header")
    return df.sparkSession.read.json(f"{path}/header", schema=header.schema)
