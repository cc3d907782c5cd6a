"""The catalog of set collections and id maps: partitioned Parquet under a log of versions.

A replacement is written to folders of a new version, which nobody reads yet, and becomes the
current one by a new entry in the log of its collection or map scope. Entries are numbered files,
made only if there is none of that number, so of two writers that started from the same entry one
commits and the other gets ``CatalogConflict``; nothing of a failed or beaten writer is ever read.
(The file system must make files without overwriting atomically, as HDFS does.) Old versions stay
until ``vacuum`` removes those superseded long enough ago, so readers that are already planned
keep their rows, and input may come from the catalog itself.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from setspan.functions.ids import clean
from setspan.operators.gene_sets import load_sets
from setspan.operators.idmap import canonical_direction
from setspan.operators.quality import TableContract
from setspan.operators.ora import sized_members
from setspan.operators.scan import broadcast_if_small, largest_group

KEY = ("db", "species", "ontology", "collection")
SCOPE = ("species", "source", "from_type")
# Names the version folder a collection's rows are read from.
VERSION = "data_version"
BLANK = "-"

# Logs with the keys of their entries, and the tables whose versions they name.
LOGS = {"dataset": KEY, "idmap": SCOPE, "by_gene": ("name",)}
LOG_OF = {"term": "dataset", "term_gene": "dataset", "idmap": "idmap"}
ENTRY = {"seq": "bigint", VERSION: "string", "gene_id_type": "string", "version": "string", "downloaded_at": "timestamp"}
# What a copy of the sets that is laid out by gene remembers of itself.
LAYOUT = {"buckets": "int", "most_of_a_gene": "bigint", "largest_set": "bigint"}

# Declared contract of the catalog tables.
CONTRACTS = {
    "dataset": TableContract(
        {**dict.fromkeys(KEY, "string"), "gene_id_type": "string", "version": "string", "downloaded_at": "timestamp"},
        [*KEY, "gene_id_type", "version", "downloaded_at"], KEY,
    ),
    "term": TableContract(
        {**dict.fromkeys(KEY, "string"), "term_id": "string", "name": "string", "description": "string"},
        [*KEY, "term_id", "name", "description"], [*KEY, "term_id"], [(KEY, "dataset", KEY)],
    ),
    "term_gene": TableContract(
        {**dict.fromkeys(KEY, "string"), "term_id": "string", "gene_id": "string"},
        [*KEY, "term_id", "gene_id"], [*KEY, "term_id", "gene_id"],
        [([*KEY, "term_id"], "term", [*KEY, "term_id"])],
    ),
    "idmap": TableContract(
        {**dict.fromkeys(SCOPE, "string"), "from_id": "string", "entrez_id": "string", "downloaded_at": "timestamp"},
        [*SCOPE, "from_id", "entrez_id", "downloaded_at"], ["species", "from_type", "from_id", "entrez_id", "source"],
    ),
}


class CatalogConflict(RuntimeError):
    """Somebody else replaced the same collection or map scope in the meantime."""


@dataclass(frozen=True)
class CollectionKey:
    db: str
    species: str = ""
    ontology: str = ""
    collection: str = ""

    def values(self) -> dict[str, str]:
        """Normalised: db, species and collection lower-case, ontology upper-case, blank is a dash."""
        raw = (self.db.lower(), self.species.lower(), self.ontology.upper(), self.collection.lower())
        return {k: v.strip() or BLANK for k, v in zip(KEY, raw)}


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- reading -------------------------------------------------------------------------------

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _at(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def _exists(self, path: str) -> bool:
        files, at = self._at(path)
        return files.exists(at)

    def _delete(self, path: str) -> None:
        files, at = self._at(path)
        files.delete(at, True)

    def _list(self, pattern: str) -> list[tuple[str, int]]:
        """(path, modification time in ms) of what fits a pattern."""
        files, at = self._at(pattern)
        return [(f.getPath().toString(), f.getModificationTime()) for f in files.globStatus(at) or []]

    def _log(self, log: str, values: dict[str, str] | None = None) -> str:
        folder = f"{self.root}/log/{log}"
        return folder if values is None else f"{folder}/{'.'.join(quote(values[k], safe='') for k in LOGS[log])}"

    def entries(self, log: str) -> DataFrame:
        """All entries of a log; files that are not written yet give no row."""
        schema = {**dict.fromkeys(LOGS[log], "string"), **ENTRY, **LAYOUT}
        ddl = ", ".join(f"`{c}` {t}" for c, t in schema.items())
        if not self._exists(self._log(log)):
            return self.spark.createDataFrame([], ddl)
        rows = self.spark.read.schema(ddl).option("recursiveFileLookup", "true").json(self._log(log))
        return rows.where(F.col(VERSION).isNotNull())

    def current(self, log: str) -> DataFrame:
        """The last entry of every collection or map scope."""
        keys = list(LOGS[log])
        last = self.entries(log).groupBy(*keys).agg(F.max_by(F.struct(*ENTRY, *LAYOUT), "seq").alias("_e"))
        return last.select(*keys, "_e.*")

    def head(self, log: str, values: dict[str, str]) -> int:
        """Number of the last entry of one collection or map scope, 0 if there is none."""
        names = [p.rsplit("/", 1)[1] for p, _ in self._list(f"{self._log(log, values)}/*.json")]
        return max((int(n.removesuffix(".json")) for n in names), default=0)

    def table(self, name: str) -> DataFrame:
        """A catalog table with its declared columns; empty when nothing was written yet."""
        contract = CONTRACTS[name]
        if name == "dataset":
            return self.current(name).select(*contract.columns)
        keys = list(LOGS[LOG_OF[name]])
        current = self.current(LOG_OF[name]).select(*keys, VERSION)  # one row a collection
        rows = self._raw(name).join(broadcast_if_small(current), [*keys, VERSION], "left_semi")
        return rows.select(*contract.columns)

    def _raw(self, name: str) -> DataFrame:
        """All rows of all versions."""
        columns = {**CONTRACTS[name].columns, VERSION: "string"}
        schema = ", ".join(f"`{c}` {t}" for c, t in columns.items())
        if not self._exists(self.path(name)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(name))

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in CONTRACTS}

    def _of(self, name: str, values: dict[str, str]) -> DataFrame:
        """The current rows of one collection or map scope, read from its version's folder alone."""
        log = LOG_OF[name]
        matches = [F.col(k) == v for k, v in values.items()]
        found = self.current(log)
        for m in matches:
            found = found.where(m)
        version = found.select(VERSION).first()  # one row
        rows = self._raw(name)
        for m in [*matches, F.col(VERSION) == (version[0] if version else "")]:
            rows = rows.where(m)
        return rows.select(*CONTRACTS[name].columns)

    @staticmethod
    def _leaf(partition: Sequence[str], values: dict[str, str]) -> str:
        return "/".join(f"{k}={values[k]}" for k in partition)

    def load(self, key: CollectionKey) -> DataFrame:
        """Terms of one collection with members; sets without genes keep a null gene."""
        values = key.values()
        return load_sets(self._of("term", values), self._of("term_gene", values), list(KEY))

    def has_rows(self, species: str, source: str, from_type: str) -> bool:
        """Whether a map scope is already filled; reads one row of its partition."""
        scope = dict(zip(SCOPE, (species.lower(), source, from_type.upper())))
        return not self._of("idmap", scope).isEmpty()

    # -- writing -------------------------------------------------------------------------------

    def _write(self, table: str, df: DataFrame, values: dict[str, str], version: str) -> None:
        """The rows of one version, next to those of others."""
        keys = LOGS[LOG_OF[table]]
        for column, value in {**values, VERSION: version}.items():
            df = df.withColumn(column, F.lit(value))
        df.write.mode("append").partitionBy(*keys, VERSION).parquet(self.path(table))

    def _discard(self, log: str, version: str) -> None:
        depth = "/*" * len(LOGS[log])
        for table in (t for t, name in LOG_OF.items() if name == log):
            for path, _ in self._list(f"{self.path(table)}{depth}/{VERSION}={version}"):
                self._delete(path)

    def _commit(self, log: str, values: dict[str, str], after: int, new: str, **fields) -> None:
        """Make version ``new`` the current one if the last entry is still number ``after``."""
        stamp = time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime()) + "Z"
        entry = {**values, "seq": after + 1, VERSION: new, "downloaded_at": stamp, **fields}
        files, at = self._at(f"{self._log(log, values)}/{after + 1:012d}.json")
        if self.head(log, values) != after:
            raise CatalogConflict(f"{log} {values} was replaced meanwhile")
        try:
            out = files.create(at, False)
        except Py4JJavaError as e:
            if files.exists(at):
                raise CatalogConflict(f"{log} {values} was replaced meanwhile") from e
            raise
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()

    # -- a layout for joins --------------------------------------------------------------------

    def store_by_gene(self, name: str, collections: Sequence[CollectionKey], buckets: int) -> None:
        """Keep the members of some collections once more, bucketed and sorted by gene.

        Rows are (collection, term_id, gene_id, set_size), distinct; the collection is its key's
        values joined by a slash. Tests read them without a shuffle of the sets, and the most
        memberships of a gene and the largest set are counted here, once, and not by every test.
        """
        values, new = {"name": name}, uuid.uuid4().hex
        after = self.head("by_gene", values)
        members = None
        for key in collections:
            rows = self._of("term_gene", key.values()).select(
                F.concat_ws("/", *KEY).alias("collection"), "term_id", "gene_id"
            )
            members = rows if members is None else members.unionByName(rows)
        sized = sized_members(members.dropna().distinct())
        place = f"{self.root}/by_gene/{name}/{VERSION}={new}"
        try:
            sized.repartition(buckets, "gene_id").write.bucketBy(buckets, "gene_id").sortBy("gene_id").option(
                "path", place
            ).saveAsTable(self._by_gene_table(new))
            stored = self.spark.table(self._by_gene_table(new))
            most = largest_group(stored, ["gene_id"])
            largest = stored.agg(F.max("set_size")).first()[0] or 0  # one number
            self._commit("by_gene", values, after, new, buckets=buckets, most_of_a_gene=most, largest_set=largest)
        except BaseException:
            self._delete(place)
            raise

    @staticmethod
    def _by_gene_table(version: str) -> str:
        return f"setspan_by_gene_{version}"

    def by_gene(self, name: str) -> tuple[DataFrame, dict]:
        """(members, facts) of a stored layout: ``buckets``, ``most_of_a_gene`` and ``largest_set``.

        Sessions that did not write it are told of the table where its files are.
        """
        found = self.current("by_gene").where(F.col("name") == name).first()  # one row
        if found is None:
            raise KeyError(name)
        table = self._by_gene_table(found[VERSION])
        if not self.spark.catalog.tableExists(table):
            place = f"{self.root}/by_gene/{name}/{VERSION}={found[VERSION]}"
            self.spark.sql(
                f"CREATE TABLE {table} (collection STRING, term_id STRING, gene_id STRING, set_size BIGINT) USING parquet "
                f"CLUSTERED BY (gene_id) SORTED BY (gene_id) INTO {found['buckets']} BUCKETS LOCATION '{place}'"
            )
        return self.spark.table(table), {c: found[c] for c in LAYOUT}

    def vacuum(self, keep_seconds: float = 7 * 86400) -> list[str]:
        """Remove versions superseded, and orphans written, longer ago than that; their folders.

        ``keep_seconds`` must exceed the longest job that reads or writes the catalog.
        """
        limit = (time.time() - keep_seconds) * 1000
        removed = []
        for log, keys in LOGS.items():
            # A row a replacement: when it was followed by the next one, null for the current one.
            followed = Window.partitionBy(*keys).orderBy("seq")
            known = {
                r[0]: r[1]
                for r in self.entries(log)
                .select(VERSION, (F.lead("downloaded_at").over(followed).cast("double") * 1000))
                .collect()
            }
            places = [f"{self.path(t)}{'/*' * len(keys)}" for t, name in LOG_OF.items() if name == log]
            for place in places or [f"{self.root}/{log}/*"]:
                for path, written in self._list(f"{place}/{VERSION}=*"):
                    version = path.rsplit("=", 1)[1]
                    since = known[version] if version in known else written
                    if since is not None and since <= limit:
                        self._delete(path)
                        removed.append(path)
        return removed

    def replace_sets(
        self,
        key: CollectionKey,
        term: DataFrame,
        term_gene: DataFrame,
        gene_id_type: str,
        version: str,
        after: int | None = None,
    ) -> None:
        """Replace one collection: blank ids skipped, blank names become the id, blank texts a dash.

        ``after`` is the ``head`` that the input was made from, by default the one found here.
        """
        values = key.values()
        after = self.head("dataset", values) if after is None else after
        terms = (
            term.select(clean("term_id").alias("term_id"), clean("name").alias("n"), clean("description").alias("d"))
            .where("term_id is not null")
            .groupBy("term_id")
            .agg(F.min("n").alias("n"), F.min("d").alias("d"))
            .select(
                "term_id", F.coalesce("n", "term_id").alias("name"), F.coalesce("d", F.lit(BLANK)).alias("description")
            )
        )
        genes = (
            term_gene.select(clean("term_id").alias("term_id"), clean("gene_id").alias("gene_id"))
            .where("term_id is not null and gene_id is not null")
            .distinct()
        )
        new = uuid.uuid4().hex
        try:
            self._write("term", terms.sortWithinPartitions("term_id", "name"), values, new)
            # The terms as written: a producer that is run twice cannot disagree with itself.
            written = self._raw("term")
            for column, value in {**values, VERSION: new}.items():
                written = written.where(F.col(column) == value)
            known = genes.join(written.select("term_id"), "term_id", "left_semi")
            self._write("term_gene", known.sortWithinPartitions("term_id", "gene_id"), values, new)
            self._commit("dataset", values, after, new, gene_id_type=gene_id_type, version=version)
        except BaseException:
            self._discard("dataset", new)
            raise

    def replace_idmap(
        self, species: str, source: str, from_type: str, to_type: str, pairs: DataFrame
    ) -> None:
        """Replace one map scope from (from_id, to_id) pairs in either direction.

        Pairs are turned towards ENTREZID; blanks and pairs of an id with itself are dropped and
        repeats removed. The whole source is staged before anything is replaced.
        """
        stored, forward = canonical_direction(from_type, to_type)
        left, right = ("from_id", "to_id") if forward else ("to_id", "from_id")
        rows = (
            pairs.select(clean(left).alias("from_id"), clean(right).alias("entrez_id"))
            .where("from_id is not null and entrez_id is not null and from_id <> entrez_id")
            .distinct()
        )
        values = dict(zip(SCOPE, (species.strip().lower(), source, stored)))
        after = self.head("idmap", values)
        new = uuid.uuid4().hex
        try:
            self._write("idmap", rows.withColumn("downloaded_at", F.current_timestamp()), values, new)
            self._commit("idmap", values, after, new)
        except BaseException:
            self._discard("idmap", new)
            raise

    def sync_idmap(
        self, species: str, source: str, from_type: str, to_type: str, producer, force: bool = False
    ) -> bool:
        """Run ``producer()`` and replace its scope, unless the scope already has rows."""
        stored, _ = canonical_direction(from_type, to_type)
        if not force and self.has_rows(species, source, stored):
            return False
        self.replace_idmap(species, source, from_type, to_type, producer())
        return True
