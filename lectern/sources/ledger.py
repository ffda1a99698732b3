"""A table with several writers and readers, in versions.

A version is a manifest: the Parquet parts that the table consists of, each with the version that added it, and
parts of removed keys, which end the rows of their key in all parts before them. A writer writes its parts
first, which nobody sees, and then publishes the next manifest under its number, which only one writer
can do. Who comes too late reads what was published meanwhile, takes it into account and tries the number after it. So no
commit is lost, none is doubled, and a reader sees one whole version, however long it reads.

Manifests are published by a hard link on local disks and by a rename that refuses to replace elsewhere. Both
are atomic on local disks and HDFS; on a store without such a rename, let one writer publish at a time.

A commit may carry the name of a stream and the number of its batch: a batch that was published is not published again, so a batch that is
run anew after a failure changes nothing. Every row has a row_id, unique in the table: its place in its part after the rows of the parts before.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

TRIES = 100


@dataclass(frozen=True)
class Part:
    folder: str
    version: int
    base: int  # row_id of its first row
    removes: bool = False


@dataclass(frozen=True)
class Version:
    number: int
    parts: tuple[Part, ...] = ()
    rows: int = 0  # row_ids given out
    batches: dict = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"number": self.number, "rows": self.rows, "batches": self.batches, "parts": [[p.folder, p.version, p.base, p.removes] for p in self.parts]})

    @staticmethod
    def of(text: str) -> Version:
        x = json.loads(text)
        return Version(x["number"], tuple(Part(*p) for p in x["parts"]), x["rows"], x["batches"])


class Ledger:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        """A table at path of rows of the schema; what is replaced or removed is told by the key column. Columns named row_id or starting with two underscores are the table's own."""
        self.spark, self.path, self.key = spark, path, key
        self.schema = T.StructType.fromDDL(schema)
        if key not in self.schema.names or any(n == "row_id" or n.startswith("__") for n in self.schema.names):
            raise ValueError("the schema must have the key, and no column named row_id or with two underscores first")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(path).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(f"{path}/versions"))

    # --- versions ---------------------------------------------------------------------

    def _manifest(self, number: int) -> str:
        return f"{self.path}/versions/{number:020d}.json"

    def _read(self, number: int) -> Version:
        stream = self._fs.open(self._path(self._manifest(number)))
        try:
            return Version.of(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def versions(self) -> list[int]:
        return sorted(int(s.getPath().getName()[:20]) for s in self._fs.listStatus(self._path(f"{self.path}/versions")) if s.getPath().getName().endswith(".json"))

    def latest(self) -> Version:
        there = self.versions()
        return self._read(there[-1]) if there else Version(0)

    def _publish(self, version: Version) -> bool:
        """Whether the version is now the table's; False if another writer has taken its number."""
        jvm, name = self.spark.sparkContext._jvm, self._manifest(version.number)
        draft = self._path(f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(version.text().encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                nio = jvm.java.nio.file.Paths
                jvm.java.nio.file.Files.createLink(nio.get(self._fs.makeQualified(self._path(name)).toUri()), nio.get(self._fs.makeQualified(draft).toUri()))
            else:
                rename = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(draft, self._path(name), rename)
        except Exception:
            if self._fs.exists(self._path(name)):
                return False
            raise
        finally:
            if self._fs.exists(draft):
                self._fs.delete(draft, False)
        return True

    # --- writing ----------------------------------------------------------------------

    def _write(self, rows: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def _drop(self, folder: str | None) -> None:
        if folder:
            self._fs.delete(self._path(f"{self.path}/{folder}"), True)

    def _rows(self, df: DataFrame) -> DataFrame:
        return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema), F.monotonically_increasing_id().alias("__place"))

    def _span(self, folder: str | None) -> int:
        if not folder:
            return 0
        top = self.spark.read.schema("__place bigint").parquet(f"{self.path}/{folder}").agg(F.max("__place").alias("x")).first().x
        return 0 if top is None else top + 1

    def commit(self, add: DataFrame | None = None, remove: DataFrame | None = None, batch: tuple[str, int] | None = None) -> Version:
        """Adds rows and ends all rows there were of the removed keys, as one version; with a batch that was published before, nothing."""
        seen = self.latest()
        if batch and seen.batches.get(batch[0], -1) >= batch[1]:
            return seen
        gone = self._write(remove.select(F.col(self.key).cast(self.schema[self.key].dataType).alias(self.key)).distinct()) if remove is not None else None
        new = self._write(self._rows(add)) if add is not None else None
        span = self._span(new)
        for _ in range(TRIES):
            if batch and seen.batches.get(batch[0], -1) >= batch[1]:
                self._drop(gone), self._drop(new)
                return seen
            n = seen.number + 1
            parts = [Part(gone, n, 0, True)] if gone else []
            parts += [Part(new, n, seen.rows)] if new else []
            made = Version(n, (*seen.parts, *parts), seen.rows + span, seen.batches | ({batch[0]: batch[1]} if batch else {}))
            if self._publish(made):
                return made
            seen = self.latest()
        raise RuntimeError(f"no version could be published in {TRIES} tries")

    def append(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> Version:
        return self.commit(rows, batch=batch)

    def upsert(self, rows: DataFrame, removed: DataFrame | None = None, batch: tuple[str, int] | None = None) -> Version:
        """Rows in place of all that the table has of their keys; keys in removed go as well."""
        keys = rows.select(self.key)
        return self.commit(rows, keys if removed is None else keys.union(removed.select(self.key)), batch)

    def delete(self, keys: DataFrame) -> Version:
        return self.commit(None, keys)

    def append_absent(self, rows: DataFrame) -> Version:
        """K7: rows of keys that the table hasn't; where writers race for a key, the first to publish has it."""
        seen, new = self.latest(), None
        fresh = self._absent(self._rows(rows), self.read(seen.number))
        for _ in range(TRIES):
            new, held = self._write(fresh), new
            self._drop(held)
            made = Version(seen.number + 1, (*seen.parts, Part(new, seen.number + 1, seen.rows)), seen.rows + self._span(new), seen.batches)
            if self._publish(made):
                return made
            seen = self.latest()
            mine = self.spark.read.schema(self._stored()).parquet(f"{self.path}/{new}")
            fresh = self._absent(mine, self.read(seen.number))
        raise RuntimeError(f"no version could be published in {TRIES} tries")

    def _absent(self, rows: DataFrame, there: DataFrame) -> DataFrame:
        taken = there.select(F.col(self.key).alias("__taken")).distinct()
        return rows.join(taken, F.col(self.key).eqNullSafe(F.col("__taken")), "left_anti")

    def compact(self) -> Version:
        """The table's rows as one part without removed ones; row_ids are given anew. Kept only if nobody published meanwhile."""
        seen = self.latest()
        new = self._write(self._rows(self.read(seen.number).drop("row_id")))
        made = Version(seen.number + 1, (Part(new, seen.number + 1, 0),), self._span(new), seen.batches)
        if self._publish(made):
            return made
        self._drop(new)
        return self.latest()

    # --- reading ------------------------------------------------------------------------

    def _stored(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("__place", T.LongType())])

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version (the last one) with row_id; later commits don't change what the DataFrame reads."""
        seen = self.latest() if version is None else self._read(version) if version else Version(0)
        data, gone = [p for p in seen.parts if not p.removes], [p for p in seen.parts if p.removes]
        if not data:
            return self.spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField("row_id", T.LongType())]))
        rows = self._numbered(data, self._stored())
        if gone:
            ends = self._numbered(gone, T.StructType([self.schema[self.key]])).groupBy(F.col(self.key).alias("__gone")).agg(F.max("__version").alias("__until"))
            rows = rows.join(ends, F.col(self.key).eqNullSafe(F.col("__gone")) & (F.col("__version") < F.col("__until")), "left_anti")
        return rows.select(*self.schema.names, (F.col("__base") + F.col("__place")).alias("row_id"))

    def _numbered(self, parts: list[Part], schema: T.StructType) -> DataFrame:
        """Rows of parts with the part's version and first row_id, by one scan however many parts there are."""
        of = self.spark.createDataFrame([(p.folder.rsplit("/", 1)[-1], p.version, p.base) for p in parts], "__part string, __version bigint, __base bigint").coalesce(1)
        rows = self.spark.read.schema(schema).parquet(*(f"{self.path}/{p.folder}" for p in parts))
        return rows.withColumn("__part", F.regexp_extract(F.col("_metadata.file_path"), "/data/([0-9a-f]{32})/", 1)).join(F.broadcast(of), "__part").drop("__part")  # a row for each part
