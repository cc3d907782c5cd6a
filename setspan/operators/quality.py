"""Catalog quality jobs: declared contracts, counts, minima, verdicts, ingest statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECK_COLUMNS = ("table_name", "check_name", "target", "expected", "actual", "passed")


@dataclass(frozen=True)
class TableContract:
    """Columns with types, not-null columns, primary key, foreign keys (columns -> table, columns)."""

    columns: Mapping[str, str]
    not_null: Sequence[str] = ()
    key: Sequence[str] = ()
    foreign: Sequence[tuple[Sequence[str], str, Sequence[str]]] = field(default_factory=tuple)


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _check(df: DataFrame, table: str, check: str, target: str, expected, actual, passed) -> DataFrame:
    return df.select(
        F.lit(table).alias("table_name"),
        F.lit(check).alias("check_name"),
        F.lit(target).alias("target"),
        F.lit(expected).cast("string").alias("expected"),
        actual.cast("string").alias("actual"),
        passed.alias("passed"),
    )


def check_structure(spark: SparkSession, tables: Mapping[str, DataFrame], contracts: Mapping[str, TableContract]):
    """Required tables, columns and types, read from schemas without touching data."""
    one = spark.range(1)
    rows = []
    for name, contract in contracts.items():
        found = dict(tables[name].dtypes) if name in tables else {}
        rows.append(
            _check(one, name, "table", name, "present", F.lit("present" if found else "missing"), F.lit(bool(found)))
        )
        for column, kind in contract.columns.items():
            actual = found.get(column, "missing")
            rows.append(_check(one, name, "type", column, kind, F.lit(actual), F.lit(actual == kind)))
    return stack(rows)


def _key_text(columns: Sequence[str]) -> Column:
    """A key's values as one text, the same for the same values in any table."""
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(columns)]))


def check_contract(
    spark: SparkSession, tables: Mapping[str, DataFrame], contracts: Mapping[str, TableContract]
) -> DataFrame:
    """All checks of all tables as rows ``CHECK_COLUMNS``.

    Every table is read once, whatever is asked of it: a row gives one entry for each check that
    it has a part in, as a null, as a value of a key, as a child or as a parent. Entries are counted
    by (check, key) before they are shuffled, so a key in a third of the rows is few entries.
    not_null counts rows, primary_key the values that occur more than once, foreign_key the rows
    whose key is null or not in the parent.
    """
    entries: dict[str, list[Column]] = {}
    checks: list[tuple[int, str, str, str]] = []

    def declare(table: str, check: str, target: str) -> int:
        checks.append((len(checks), table, check, target))
        return len(checks) - 1

    def entry(check: int, key: Column, child: int, parent: int) -> Column:
        return F.struct(
            F.lit(check).alias("id"), key.alias("key"), F.lit(child).alias("child"), F.lit(parent).alias("parent")
        )

    for name, contract in contracts.items():
        if name not in tables:
            continue
        found = set(tables[name].columns)
        mine = entries.setdefault(name, [])
        for c in contract.not_null:
            if c in found:
                mine.append(F.when(F.col(c).isNull(), entry(declare(name, "not_null", c), F.lit(""), 1, 0)))
        if contract.key and set(contract.key) <= found:
            mine.append(entry(declare(name, "primary_key", ",".join(contract.key)), _key_text(contract.key), 1, 0))
        for columns, parent, parent_columns in contract.foreign:
            if set(columns) <= found and parent in tables and set(parent_columns) <= set(tables[parent].columns):
                check = declare(name, "foreign_key", ",".join(columns))
                whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in parent_columns])
                mine.append(entry(check, _key_text(columns), 1, 0))
                entries.setdefault(parent, []).append(F.when(whole, entry(check, _key_text(parent_columns), 0, 1)))

    structure = check_structure(spark, tables, contracts)
    if not checks:
        return structure
    told = stack(
        [tables[n].select(F.explode(F.array_compact(F.array(*e))).alias("e")).select("e.*") for n, e in entries.items() if e]
    )
    counted = told.groupBy("id", "key").agg(F.sum("child").alias("child"), F.sum("parent").alias("parent"))
    found = counted.groupBy("id").agg(
        F.sum("child").alias("not_null"),
        F.count_if(F.col("child") > 1).alias("primary_key"),
        F.sum(F.when(F.col("parent") == 0, F.col("child")).otherwise(0)).alias("foreign_key"),
    )
    declared = spark.createDataFrame(checks, "id int, table_name string, check_name string, target string")
    number = F.coalesce(*[F.when(F.col("check_name") == c, F.col(c)) for c in ("not_null", "primary_key", "foreign_key")], F.lit(0))
    values = declared.join(F.broadcast(found), "id", "left").select(  # a row a check
        "table_name", "check_name", "target", F.lit("0").alias("expected"),
        number.cast("string").alias("actual"), (number == 0).alias("passed"),
    )
    return stack([structure, values])


def row_counts(tables: Mapping[str, DataFrame], aliases: Mapping[str, str] | None = None) -> DataFrame:
    """(table_name, row_count), repeated under alias names."""
    frames = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
              for n, df in tables.items()]
    counts = stack(frames)
    if not aliases:
        return counts
    names = F.create_map(*[F.lit(x) for alias, name in aliases.items() for x in (name, alias)])
    both = F.array_compact(F.array("table_name", F.try_element_at(names, F.col("table_name"))))
    return counts.select(F.explode(both).alias("table_name"), "row_count")


def check_minima(counts: DataFrame, minima: DataFrame) -> DataFrame:
    """Requirements (table_name, min_rows) against counts; a missing table counts as zero."""
    return (
        minima.join(counts, "table_name", "left")
        .select("table_name", "min_rows", F.coalesce("row_count", F.lit(0)).alias("row_count"))
        .withColumn("passed", F.col("row_count") >= F.col("min_rows"))
    )


# Row minima of the catalog profiles. The seed profile asks for nothing.
PROFILE_TABLES = {"geneset": 1, "geneset_gene": 1, "idmap": 1}
PROFILE_MAPS = (("hsa", "SYMBOL", "ENTREZID", 1), ("hsa", "ENTREZID", "SYMBOL", 1))
PROFILES = {
    "embedded-hsa-seed": ({}, ()),
    "embedded-hsa-basic": (PROFILE_TABLES, PROFILE_MAPS),
    "embedded-hsa-extended": (PROFILE_TABLES, PROFILE_MAPS),
    "embedded-hsa-extended-sru": (PROFILE_TABLES, PROFILE_MAPS),
}


def check_profile(
    spark: SparkSession, profile: str, counts: DataFrame, map_counts: DataFrame
) -> DataFrame:
    """Violations-or-not rows (subject, min_rows, row_count, passed) of a named profile.

    map_counts: (species, from_type, row_count) of the canonical map; both directions of a
    type share its rows.
    """
    name = profile.strip().lower()
    if name not in PROFILES:
        raise ValueError(f"unknown audit profile {profile!r}")
    tables, maps = PROFILES[name]
    schema = "subject string, species string, from_type string, min_rows bigint"
    wanted = [(t, None, None, n) for t, n in tables.items()] + [
        (f"idmap {s} {a}->{b}", s, a if b == "ENTREZID" else b, n) for s, a, b, n in maps
    ]
    need = spark.createDataFrame(wanted, schema)
    got = counts.select(
        F.col("table_name").alias("subject"), F.lit(None).cast("string").alias("species"),
        F.lit(None).cast("string").alias("from_type"), "row_count",
    )
    got_maps = map_counts.select(F.lit(None).cast("string").alias("subject"), "species", "from_type", "row_count")
    by_table = need.where("species is null").join(got.select("subject", "row_count"), "subject", "left")
    by_map = need.where("species is not null").join(
        got_maps.select("species", "from_type", "row_count"), ["species", "from_type"], "left"
    )
    return (
        by_table.unionByName(by_map)
        .select("subject", "min_rows", F.coalesce("row_count", F.lit(0)).alias("row_count"))
        .withColumn("passed", F.col("row_count") >= F.col("min_rows"))
    )


def verdict(checks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Healthy when every check passed, with the number of failures."""
    return checks.groupBy(*keys).agg(
        F.coalesce(F.bool_and("passed"), F.lit(True)).alias("healthy"),
        F.count_if(~F.col("passed")).alias("failures"),
    )


def ingest_stats(rows: DataFrame, source: str, dropped: str) -> DataFrame:
    """Seen, kept and dropped rows per source, from a boolean ``dropped`` column."""
    return rows.groupBy(source).agg(
        F.count(F.lit(1)).alias("seen"),
        F.count_if(~F.col(dropped)).alias("kept"),
        F.count_if(dropped).alias("dropped"),
    )


def write_observed(rows: DataFrame, dropped: Column, write, parts: Mapping[str, Column] | None = None) -> DataFrame:
    """Write the rows that are not dropped, and count them all while they pass: one scan.

    ``write`` is called once with the rows to keep and writes them. Returns (part, seen, kept,
    dropped), for all rows (part ``*``) and for each of ``parts``, named conditions.
    """
    named = {"*": F.lit(True), **(parts or {})}
    metrics = []
    for k, condition in enumerate(named.values()):
        inside = F.coalesce(condition, F.lit(False))
        metrics.append(F.count_if(inside).alias(f"seen{k}"))
        metrics.append(F.count_if(inside & F.coalesce(dropped, F.lit(False))).alias(f"dropped{k}"))
    seen = Observation()
    watched = rows.withColumn("_dropped", F.coalesce(dropped, F.lit(False))).observe(seen, *metrics)
    write(watched.where("not _dropped").drop("_dropped"))
    got = seen.get
    counts = [
        (name, got[f"seen{k}"], got[f"seen{k}"] - got[f"dropped{k}"], got[f"dropped{k}"]) for k, name in enumerate(named)
    ]
    return rows.sparkSession.createDataFrame(counts, "part string, seen bigint, kept bigint, dropped bigint")
