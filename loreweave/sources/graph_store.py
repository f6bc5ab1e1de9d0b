"""The durable graph: nodes and edges under one commit.

A commit writes its new rows aside, nodes first, then edges against them, and becomes visible with one file: the next manifest, which
names all folders of both tables and, for each stream of batches, the last one taken. So a stop at any point leaves the graph as it was,
and a batch that is given again adds nothing. Rows are dealt to buckets of whole projects; a batch reads those of its own projects.
Manifests are numbered and never overwritten: of two writers one fails and can try again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.scans import P
from ..operators.writes import add_edges, add_nodes

TABLES = ("nodes", "edges")
_FEW = 1000  # projects that a filter names one by one


class CommitConflict(RuntimeError):
    """Another writer published the same version; nothing of this commit is visible."""


class GraphStore:
    """Nodes and edges (project_id, id, seq, ...) in a folder that driver and executors share.

    Ids are unique in their project: the first write of one stays. Edges need both ends among the stored or new nodes. Null projects are a
    project of their own. Empty batches only move the stream's ledger. The columns are those of the first commit. After `compact_after`
    commits the folders are written together; what they held before stays readable until the next time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, compact_after: int = 20):
        self.spark, self.path, self.buckets, self.compact_after = spark, path.rstrip("/"), buckets, compact_after
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)

    def _path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def manifest(self) -> dict:
        """The newest one: version, ledger, the buckets of each folder of both tables, their schemas, folders that nothing reads any more."""
        found = [n for n in self._names("manifests") if n.endswith(".json")]
        if not found:
            return {"version": 0, "ledger": {}, "nodes": {}, "edges": {}, "schemas": {}, "retired": []}
        stream = self._fs.open(self._path(f"{self.path}/manifests/{found[-1]}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        final, aside = f"{self.path}/manifests/{manifest['version']:012d}.json", f"{self.path}/aside/{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(aside), False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        self._fs.mkdirs(self._path(f"{self.path}/manifests"))
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(aside).getFileSystem(self._conf).getUri(), self._conf)
        plain = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self._fs.makeQualified(self._path(aside)), self._fs.makeQualified(self._path(final)), plain)  # fails where there is one
        except Exception as e:
            self._fs.delete(self._path(aside), False)
            raise CommitConflict(f"version {manifest['version']} is taken") from e

    def _bucket(self):
        return F.pmod(F.xxhash64(P), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, folder: str) -> list[int]:
        """Ranges of whole rows of (bucket, project, seq), so that a project with a third of all rows is written by many tasks."""
        rows.withColumn("bucket", self._bucket()).repartitionByRange("bucket", P, "seq").sortWithinPartitions("bucket", P, "seq").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        return [int(n.removeprefix("bucket=")) for n in self._names(folder) if n.startswith("bucket=")]

    def _read(self, manifest: dict, table: str, buckets: list[int] | None = None) -> DataFrame | None:
        if table not in manifest["schemas"]:
            return None
        schema = StructType.fromJson(manifest["schemas"][table])
        paths = [f"{self.path}/{folder}/bucket={b}" for folder, own in manifest[table].items() for b in own if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of one version."""
        manifest = self.manifest()
        if not manifest["schemas"]:
            raise ValueError(f"nothing was committed to {self.path}")
        return self._read(manifest, "nodes"), self._read(manifest, "edges")

    def commit(self, stream: str, number: int, nodes: DataFrame, edges: DataFrame) -> bool:
        """Add a batch of a stream whose numbers rise. Whether it was new: one at or below the last number taken changes nothing."""
        manifest = self.manifest()
        if manifest["ledger"].get(stream, -1) >= number:
            return False
        schemas = manifest["schemas"] or {"nodes": nodes.schema.jsonValue(), "edges": edges.schema.jsonValue()}
        manifest["schemas"] = schemas
        nodes, edges = (d.select(*StructType.fromJson(schemas[t]).names) for t, d in zip(TABLES, (nodes, edges)))
        projects = nodes.select(P).union(edges.select(P)).distinct()
        buckets = {r["b"] for r in projects.select(self._bucket().alias("b")).distinct().collect()}
        few = [r[P] for r in projects.limit(_FEW + 1).collect()]

        def stored(table: str) -> DataFrame:
            rows = self._read(manifest, table, buckets)
            if len(few) > _FEW:
                return rows.join(projects.withColumnRenamed(P, "own"), F.col(P).eqNullSafe(F.col("own")), "left_semi")
            return rows.where(F.col(P).isin([p for p in few if p is not None]) | (F.col(P).isNull() if None in few else F.lit(False)))

        folder = f"data/{uuid.uuid4().hex}"
        added = self._write(add_nodes(stored("nodes"), nodes), f"{folder}/nodes")
        fresh = self._read({"schemas": schemas, "nodes": {f"{folder}/nodes": added}}, "nodes")
        self._between()
        linked = self._write(add_edges(stored("nodes").unionByName(fresh), stored("edges"), edges), f"{folder}/edges")
        for table, own in (("nodes", added), ("edges", linked)):
            if own:
                manifest[table][f"{folder}/{table}"] = own
        manifest["version"] += 1
        manifest["ledger"][stream] = number
        self._publish(manifest)
        if max(len(manifest[t]) for t in TABLES) >= self.compact_after:
            self.compact()
        return True

    def _between(self) -> None:
        """Called when a commit's nodes are written and its edges are not."""

    def compact(self) -> None:
        """Write the folders of each table together. Folders that the compaction before put out of use are removed now."""
        manifest = self.manifest()
        gone = manifest["retired"]
        folder = f"data/{uuid.uuid4().hex}"
        manifest["retired"] = [f for t in TABLES for f in manifest[t]]
        for table in TABLES:
            rows = self._read(manifest, table)
            own = self._write(rows, f"{folder}/{table}") if rows is not None and manifest[table] else []
            manifest[table] = {f"{folder}/{table}": own} if own else {}
        manifest["version"] += 1
        self._publish(manifest)
        for old in gone:
            self._fs.delete(self._path(f"{self.path}/{old}"), True)
        for name in self._names("manifests"):  # a reader holds folders, not manifests
            if int(name.split(".")[0]) < manifest["version"] - 1:
                self._fs.delete(self._path(f"{self.path}/manifests/{name}"), False)
