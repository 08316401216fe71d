"""Files of crates as tables: digests and sizes, manifests, JSON documents; links and devices are told, never opened."""

from __future__ import annotations

import json
import os
import stat
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealwork.constants import BAG_FILE, CRATE_FILE
from sealwork.functions.text import media_type, pointer_tokens, resolve_tokens

FILES = "crate string, path string, sha256 string, size bigint, media_type string"
_LIST = "crate string, path string, kind string, address string"


def listing(spark: SparkSession, crates: dict[str, str]) -> DataFrame:
    """(crate, path, kind, address) of everything below the folders of crates (name -> folder); kind is file, link or irregular.

    The file system is listed on the driver, as it alone knows links from files; links are not followed and nothing is opened.
    """
    rows = []
    for crate, folder in crates.items():
        base = Path(folder)
        for here, folders, files in os.walk(base, followlinks=False):
            for name in sorted([*files, *(f for f in folders if (Path(here) / f).is_symlink())]):
                p = Path(here) / name
                mode = os.lstat(p).st_mode
                kind = "link" if stat.S_ISLNK(mode) else "file" if stat.S_ISREG(mode) else "irregular"
                rows.append((crate, p.relative_to(base).as_posix(), kind, str(p)))
    return spark.createDataFrame(rows, _LIST)


def scan_files(listed: DataFrame, excluded: tuple[str, ...] = (CRATE_FILE, BAG_FILE)) -> DataFrame:
    """(crate, path, sha256, size, media_type) of the regular files of a listing, but for ``excluded``; digests are made on the executors."""
    spark = listed.sparkSession
    wanted = listed.where((F.col("kind") == "file") & ~F.col("path").isin(*excluded)) if excluded else listed.where("kind = 'file'")
    addresses = [r[0] for r in wanted.select("address").collect()]
    if not addresses:
        return spark.createDataFrame([], FILES)
    content = spark.read.format("binaryFile").load(addresses)
    own = content.select(F.regexp_replace("path", "^file:/*", "/").alias("address"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))
    return wanted.join(own, "address").select("crate", "path", "sha256", "size", media_type(F.col("path")).alias("media_type"))


def read_manifest(spark: SparkSession, crates: dict[str, str], name: str = BAG_FILE) -> DataFrame:
    """(crate, path, sha256) of the lines ``<hex>  <path>`` of bag manifests; crates without one have no row."""
    rows = [(c, str(Path(f) / name)) for c, f in crates.items() if (Path(f) / name).is_file()]
    if not rows:
        return spark.createDataFrame([], "crate string, path string, sha256 string")
    where = spark.createDataFrame(rows, "crate string, address string")
    lines = spark.read.text([a for _, a in rows]).select("value", F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/").alias("address")).where("value <> ''")
    at = F.locate("  ", F.col("value"))
    return lines.join(where, "address").select("crate", F.expr("substring(value, locate('  ', value) + 2)").alias("path"), F.substring("value", F.lit(1), at - 1).alias("sha256"))


def manifest_lines(files: DataFrame) -> DataFrame:
    """(crate, line) of a bag manifest, to be written in the order of ``path``."""
    return files.select("crate", "path", F.concat_ws("  ", "sha256", "path").alias("line"))


def write_manifest(files: DataFrame, crate: str, folder: str, name: str = BAG_FILE) -> None:
    """Writes the bag manifest of one crate, sorted by path; it names every file but itself."""
    rows = manifest_lines(files.where((F.col("crate") == crate) & (F.col("path") != name))).orderBy("path").toLocalIterator()
    with open(Path(folder) / name, "w", encoding="utf-8", newline="\n") as out:
        out.writelines(r["line"] + "\n" for r in rows)


def read_documents(listed: DataFrame) -> DataFrame:
    """(crate, path, doc): text of the JSON files of a listing; files that are no JSON are left out."""
    spark = listed.sparkSession
    wanted = listed.where("kind = 'file' and lower(path) like '%.json'")
    addresses = [r[0] for r in wanted.select("address").collect()]
    if not addresses:
        return spark.createDataFrame([], "crate string, path string, doc string")
    text = spark.read.text(addresses, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/").alias("address"), F.col("value").alias("doc"))
    return wanted.join(text, "address").where(F.expr("try_parse_json(doc) is not null")).select("crate", "path", "doc")


def resolve_locations(entries: DataFrame, documents: DataFrame, location: str, out: str) -> DataFrame:
    """Adds ``out``: JSON text of the place ``path#pointer`` in the crate's documents, null if there is none."""
    at = F.locate("#", F.col(location))
    rows = entries.withColumn("_path", F.substring(location, F.lit(1), at - 1)).withColumn("_tokens", pointer_tokens(F.expr(f"substring({location}, locate('#', {location}) + 1)")))
    docs = documents.select("crate", F.col("path").alias("_path"), F.col("doc").alias("_doc"))
    return rows.join(docs, ["crate", "_path"], "left").withColumn(out, resolve_tokens(F.col("_doc"), F.col("_tokens"))).drop("_path", "_tokens", "_doc")


def write_crate(entities: list[dict], context: object, folder: str) -> bytes:
    """Writes a graph with sorted keys, sorted arrays, two blanks of indent, UTF-8 and a final line break; the bytes are given back."""

    def settled(v: object) -> object:
        if isinstance(v, dict):
            return {k: settled(x) for k, x in v.items()}
        if isinstance(v, list):
            return sorted(map(settled, v), key=lambda x: json.dumps(x, sort_keys=True))
        return v

    body = {"@context": context, "@graph": settled(entities)}
    data = (json.dumps(body, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode("utf-8")
    (Path(folder) / CRATE_FILE).write_bytes(data)
    return data
