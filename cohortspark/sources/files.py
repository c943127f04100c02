"""Files of events and their metadata: finding pairs, checking, splitting, and writing sequences, edges and embeddings."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from functools import reduce
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.hashing import uniform
from ..operators.cleaning import inferred_metadata

META_SUFFIX = "_meta"


def list_files(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """All files below a folder with a suffix, through the file system the folder names."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found, out = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), []
    while found.hasNext():
        name = found.next().getPath().toString()
        if name.endswith(suffix):
            out.append(name)
    return sorted(out)


def data_and_meta(files: Sequence[str]) -> tuple[list[tuple[str, str | None]], list[str]]:
    """``[(data, its meta or None)]`` and the meta files without data."""
    stem = lambda f: str(PurePosixPath(f).with_suffix(""))
    metas = {stem(f)[: -len(META_SUFFIX)]: f for f in files if stem(f).endswith(META_SUFFIX)}
    data = [f for f in files if not stem(f).endswith(META_SUFFIX)]
    return [(f, metas.get(stem(f))) for f in data], sorted(m for s, m in metas.items() if s not in {stem(f) for f in data})


def has_event_columns(df: DataFrame, key: str, times: Sequence[str], name: str = "") -> bool:
    """Whether a file can take part: it has the key and either its times or is a background file."""
    return key in df.columns and ("background" in name or all(t in df.columns for t in times))


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", schema: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """CSV files below a path; with a schema nothing is read to infer one."""
    reader = spark.read.option("header", True).option("sep", delimiter).option("recursiveFileLookup", True).option("encoding", encoding)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def with_metadata(df: DataFrame, threshold: int = 100) -> tuple[DataFrame, DataFrame]:
    return df, inferred_metadata(df, threshold)


def is_wide(df: DataFrame, most: int = 20) -> bool:
    return len(df.columns) > most


def write_sequences(df: DataFrame, path: str, key: str = "person", block_mb: int = 64, seed: int = 0) -> None:
    """Rows in random order by a hash of the key, in row groups of bounded size."""
    order = F.xxhash64(F.col(key), F.lit(seed))
    df.repartition(order).sortWithinPartitions(order, key).write.option("parquet.block.size", block_mb << 20).mode("overwrite").parquet(path)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """``key=value/`` folders; each holds few files, as rows are placed by folder and a hash that splits large ones."""
    df.repartition(*by, F.pmod(F.xxhash64(*[c for c in df.columns if c not in by]), F.lit(8))).write.partitionBy(*by).mode("overwrite").parquet(path)


def read_walks(spark: SparkSession, path: str, **partition: object) -> DataFrame:
    """Walks of the given partition values, pruned before anything is read; an error if there are none or a source comes twice."""
    df = spark.read.parquet(path)
    for k, v in partition.items():
        df = df.filter(F.col(k) == F.lit(v))
    got = df.agg(F.count("*").alias("n"), F.count_distinct("SOURCE").alias("d")).first()
    if not got["n"] or got["n"] != got["d"]:
        raise ValueError(f"{path}: {got['n']} walks of {got['d']} sources")
    return df


def wide_embedding(df: DataFrame, vector: str, width: int, prefix: str = "emb") -> DataFrame:
    """An array as ``emb0 ... embN`` float columns."""
    return df.select(*[c for c in df.columns if c != vector], *[F.get(vector, F.lit(i)).cast("float").alias(f"{prefix}{i}") for i in range(width)])


def reconcile(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of a that b lacks, and of b that a lacks."""
    return a.subtract(b), b.subtract(a)


def to_json_documents(df: DataFrame, key: str) -> DataFrame:
    """Each row's other columns as one JSON text, which ``get_json_object`` and ``from_json`` can query."""
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("document"))


def flagged(df: DataFrame, key: str, members: DataFrame, flag: str) -> DataFrame:
    """``df`` with a flag of 1 where the key is one of ``members`` (one column), else 0; for loads that are updated by membership."""
    known = members.toDF("__m").filter("__m IS NOT NULL").distinct()
    return df.join(known, F.col(key) == F.col("__m"), "left").withColumn(flag, F.col("__m").isNotNull().cast("int")).drop("__m")


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows by the columns named: a reduced copy for a dry run."""
    return df.orderBy(*order).limit(n)


def subset_columns(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The columns that are in the list, and names that the list repeats."""
    twice = sorted({n for n in names if list(names).count(n) > 1})
    return df.select(*[c for c in df.columns if c in set(names)]), twice


def subset_files(spark: SparkSession, files: Sequence[str], names: Sequence[str], source: str, target: str) -> list[str]:
    """Write each parquet file below ``source`` with the columns of the list to the same place below ``target``; its metadata go along, of kept columns only."""
    written = []
    for data, meta in data_and_meta(files)[0]:
        df, _ = subset_columns(spark.read.parquet(data), names)
        df.write.mode("overwrite").parquet(data.replace(source, target, 1))
        written.append(data.replace(source, target, 1))
        if meta:
            spark.read.parquet(meta).filter(F.col("Name").isin(df.columns)).write.mode("overwrite").parquet(meta.replace(source, target, 1))
    return written


def route_by_width(spark: SparkSession, files: Sequence[str], target: str, most: int = 20) -> dict[str, str]:
    """Write files to ``good/`` or ``huge/`` by their number of columns, each in its own format; the schema alone decides."""
    out = {}
    for name in files:
        csv = name.endswith(".csv")
        df = spark.read.option("header", True).csv(name) if csv else spark.read.parquet(name)
        place = f"{target.rstrip('/')}/{'huge' if is_wide(df, most) else 'good'}/{PurePosixPath(name).name}"
        writer = df.write.mode("overwrite")
        writer.option("header", True).csv(place) if csv else writer.parquet(place)
        out[name] = place
    return out


def read_database(spark: SparkSession, url: str, query: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A query pushed to a database through JDBC; with a key and its bounds it is read in parts."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if key and bounds:
        return reader.option("dbtable", f"({query}) q").option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts).load()
    return reader.option("query", query).load()


def merge_chunks(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """Chunks written apart, as one table; columns are matched by name, those that a chunk lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(f) for f in folders])


def write_subsets(df: DataFrame, path: str, subsets: DataFrame, key: str) -> None:
    """One folder for each subset of ``(key, subset)`` with its rows of ``df``."""
    write_partitioned(df.join(subsets, key), path, ["subset"])


def by_position(values: DataFrame, position: str, mapping: DataFrame, node: str, idx: str) -> DataFrame:
    """Rows that know their position only get the id that the mapping gives it; an error if a position has none or two."""
    got = values.join(mapping.select(F.col(idx).alias(position), node), position, "left")
    n = got.agg(F.count("*").alias("n"), F.count(node).alias("known")).first()
    if n["n"] != n["known"] or n["n"] != values.count():
        raise ValueError("positions and ids don't match one to one")
    return got.drop(position)


def read_json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json_rows(df: DataFrame, path: str, key: str, shuffled: bool = False, seed: int = 0) -> None:
    """JSON lines, in random order by a hash of the key if wanted."""
    order = F.xxhash64(F.col(key), F.lit(seed))
    (df.repartition(order).sortWithinPartitions(order, key) if shuffled else df).write.mode("overwrite").json(path)


def catalogue(spark: SparkSession, sets: Sequence[dict]) -> DataFrame:
    """The embedding sets there are: ``name, year, type, root, url, emb_type, truth``; an error if a name and year come twice."""
    keys = [(s["name"], s.get("year")) for s in sets]
    if len(set(keys)) < len(keys):
        raise ValueError("an embedding set is listed twice")
    names = ("name", "year", "type", "root", "url", "emb_type", "truth")
    return spark.createDataFrame([tuple(s.get(n) for n in names) for s in sets], "name string, year int, type string, root string, url string, emb_type string, truth string")


def cached_stage(spark: SparkSession, path: str, arguments: dict, compute: Callable[[], DataFrame], on_change: str = "error") -> DataFrame:
    """The table written at ``path`` by a call with the same arguments, else computed and written there with them.

    ``on_change``: ``error`` or ``recompute`` where arguments differ from those on record. The record is written last, so a stage that broke off is computed again.
    """
    record = f"{path.rstrip('/')}_arguments"
    text = json.dumps(arguments, sort_keys=True, default=str)
    try:
        held = spark.read.text(record).first()
    except AnalysisException:
        held = None
    if held and held[0] != text and on_change == "error":
        raise ValueError(f"{path} was made with {held[0]}, not {text}")
    if not held or held[0] != text:
        compute().write.mode("overwrite").parquet(path)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(record)
    return spark.read.parquet(path)


def staged(spark: SparkSession, folder: str, steps: Sequence[tuple[str, dict, Callable[[dict[str, DataFrame]], DataFrame]]], on_change: str = "error") -> dict[str, DataFrame]:
    """Steps ``(name, arguments, compute from the earlier ones)`` one after the other, each cached; a step's record holds the arguments of all before it."""
    out: dict[str, DataFrame] = {}
    known: dict[str, dict] = {}
    for name, arguments, compute in steps:
        known = {**known, name: arguments}
        out[name] = cached_stage(spark, f"{folder.rstrip('/')}/{name}", known, lambda c=compute: c(out), on_change)
    return out


def synthetic(spark: SparkSession, n: int, numbers: dict[str, tuple[float, float, float, float]], categories: dict[str, Sequence[tuple[str, float]]]) -> DataFrame:
    """``n`` invented rows: ``id``, categories by their chances and normal numbers from ``(mean, deviation, tenth percentile, null share)``, not below
    the percentile. Every value is a hash of the id."""
    out = {}
    for name, chances in categories.items():
        u, upto, value = uniform("id", name), 0.0, F.lit(chances[-1][0])
        for v, p in reversed(chances[:-1]):
            upto = sum(q for w, q in chances[: [w for w, _ in chances].index(v) + 1])
            value = F.when(u < upto, F.lit(v)).otherwise(value)
        out[name] = value
    for name, (mean, std, low, null_share) in numbers.items():
        normal = F.sqrt(-2 * F.log(1 - uniform("id", f"{name}-r"))) * F.cos(2 * F.lit(math.pi) * uniform("id", f"{name}-a"))
        out[name] = F.when(uniform("id", f"{name}-null") >= null_share, F.greatest(F.lit(float(low)), F.lit(float(mean)) + F.lit(float(std)) * normal))
    return spark.range(n).withColumns(out)
