"""Versioned snapshots of the graph's tables.

A version is a manifest, ``manifest-<number>``, that names the folder of each part of each table. Rows are dealt to parts
by the file they come from, so a change of few files writes the parts of those files and takes the others over. Folders
are written before the manifest, and a manifest's number is taken by creating it, so a reader sees one whole version
throughout, a writer that dies leaves the last version in place, and of two writers of the same version one fails.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.schema import EDGE, EVIDENCE, FILE_META, NODE, PARSED_FILE, UNRESOLVED
from codeloom.work import delete, file_system

TABLES = {
    "node": NODE, "edge": EDGE, "evidence": EVIDENCE, "unresolved_reference": UNRESOLVED, "file_meta": FILE_META, "parsed_file": PARSED_FILE,
    "supertypes": "sub string, sup string", "posting": "term string, id string, tf int, length int, file string",
    "text_length": "n long, total long, file string", "typed_pair": "from_id string, to_id string, type string, file string, line int",
}
#: Tables whose rows belong to no file, and the order within the files of those that are sorted.
WHOLE, ORDER = ["supertypes", "typed_pair"], {"posting": ["term", "id"], "edge": ["from_id", "to_id"]}
FILES_A_PART = 2000


class Conflict(Exception):
    """Another writer has made the version that was to be written."""


def part_of(table: str, parts: int) -> Column:
    """The part of a row: by its file, that of an edge being its start's."""
    if table in WHOLE or parts == 1:
        return F.lit(0)
    file = F.split("from_id", ":")[2] if table == "edge" else F.col("file")
    return F.pmod(F.xxhash64(file), F.lit(parts)).cast("int")


class SnapshotStore:
    """The ``keep`` latest versions stay, so readers of a replaced one can finish."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def _numbers(self) -> list[int]:
        fs, p = file_system(self.spark, self.path)
        if not fs.exists(p):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        return sorted((int(n.removeprefix("manifest-")) for n in names if n.startswith("manifest-")), reverse=True)

    def manifest(self) -> dict | None:
        """The latest manifest that is whole."""
        for n in self._numbers():
            fs, p = file_system(self.spark, f"{self.path}/manifest-{n}")
            stream = fs.open(p)
            try:
                return json.loads(bytes(stream.readAllBytes()).decode())
            except ValueError:  # its writer is at it, or has died
                continue
            finally:
                stream.close()
        return None

    def version(self) -> int | None:
        m = self.manifest()
        return m and m["version"]

    def read(self, table: str, manifest: dict | None = None, parts: list[int] | None = None) -> DataFrame:
        m = manifest or self.manifest()
        if m is None:
            raise LookupError("not indexed")
        folders = [f"{self.path}/data/{folder}/{table}/part={p}" for p, folder in sorted(m["tables"].get(table, {}).items()) if parts is None or int(p) in parts]
        return self.spark.read.schema(TABLES[table]).parquet(*folders) if folders else self.spark.createDataFrame([], TABLES[table])

    def tables(self, manifest: dict | None = None) -> dict[str, DataFrame]:
        m = manifest or self.manifest()
        return {t: self.read(t, m) for t in TABLES}

    def write(self, tables: dict[str, DataFrame], files: int, about: dict | None = None) -> int:
        """Write a new version of all tables; ``typed_pair``, if it isn't among them, is taken over."""
        return self._commit(self.manifest(), tables, max(1, -(-files // FILES_A_PART)), None, about)

    def replace(self, tables: dict[str, DataFrame], parts: list[int], about: dict | None = None) -> int:
        """Write a new version of the given parts of the given tables, and take all else over from the latest one."""
        old = self.manifest()
        return self._commit(old, tables, old["parts"], parts, about)

    def _commit(self, old: dict | None, tables: dict[str, DataFrame], n: int, parts: list[int] | None, about: dict | None) -> int:
        new = {"version": (old["version"] if old else 0) + 1, "parts": n, "about": about or (old or {}).get("about", {}), "tables": dict((old or {}).get("tables", {}))}
        folder = f"v{new['version']}-{uuid.uuid4().hex[:12]}"

        def put(name: str) -> None:
            df = tables[name]
            fields = self.spark.createDataFrame([], TABLES[name]).schema.fields
            df = df.select(*(df[f.name].cast(f.dataType).alias(f.name) for f in fields)).withColumn("part", part_of(name, n))
            path = f"{self.path}/data/{folder}/{name}"
            if n > 1 and name not in WHOLE:
                df = df.repartition(n if parts is None else len(parts), "part")
            if name in ORDER:
                df = df.sortWithinPartitions("part", *ORDER[name])
            if n > 1 and name not in WHOLE:
                df.write.mode("overwrite").partitionBy("part").parquet(path)
            else:
                df.drop("part").write.mode("overwrite").parquet(f"{path}/part=0")
            fs, p = file_system(self.spark, path)
            written = {f.getPath().getName().removeprefix("part="): folder for f in (fs.listStatus(p) if fs.exists(p) else []) if f.getPath().getName().startswith("part=")}
            kept = {} if parts is None or name in WHOLE else {k: v for k, v in new["tables"].get(name, {}).items() if int(k) not in parts}
            new["tables"][name] = kept | written

        with ThreadPoolExecutor(len(tables)) as pool:  # the tables' jobs run side by side
            list(pool.map(put, tables))
        fs, p = file_system(self.spark, f"{self.path}/manifest-{new['version']}")
        try:
            out = fs.create(p, False)
        except Exception as e:
            delete(self.spark, f"{self.path}/data/{folder}")
            raise Conflict(f"another process has written version {new['version']} of {self.path}; wait for it to end, or stop it, then try again") from e
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        self._clean(new)
        return new["version"]

    def _clean(self, latest: dict) -> None:
        """Drop manifests before the latest ``keep``, and folders that none of those names."""
        used = set()
        for k, n in enumerate(self._numbers()):
            fs, p = file_system(self.spark, f"{self.path}/manifest-{n}")
            if k >= self.keep:
                fs.delete(p, False)
                continue
            stream = fs.open(p)
            try:
                m = json.loads(bytes(stream.readAllBytes()).decode())
            except ValueError:
                return  # another writer is at work
            finally:
                stream.close()
            used |= {folder for t in m["tables"].values() for folder in t.values()}
        fs, p = file_system(self.spark, f"{self.path}/data")
        for f in fs.listStatus(p):
            name = f.getPath().getName()
            if name not in used and int(name[1:].split("-")[0]) < latest["version"]:
                fs.delete(f.getPath(), True)
