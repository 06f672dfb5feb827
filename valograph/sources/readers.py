"""Readers: Parquet tables, CSV with encoding fallback, GraphML, documents, nested payloads, file audit."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valograph.functions.scalars import clean_id
from valograph.operators.filematch import contained_pairs
from valograph.operators.relational import best_per_key
from valograph.session import ensure_checkpoint_dir, materialise

FALLBACK_ENCODING = "gb18030"  # also reads gbk

AUTHORSHIP_PAYLOAD = (
    "id string, authorships array<struct<author:struct<id:string,display_name:string>,author_position:string,"
    "is_corresponding:boolean,institutions:array<struct<id:string,display_name:string>>>>"
)
YEAR_COUNTS_PAYLOAD = "id string, counts_by_year array<struct<year:int,cited_by_count:bigint>>"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str | None = None, encoding: str | None = None) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes.

    Text that is not UTF-8 is brought to it first: by the given encoding, or by GB18030 where the bytes of a line, read
    as Latin-1 so that none is lost, are no valid UTF-8. A replacement character that the text holds itself is valid.
    """
    if encoding is None:
        lines = spark.read.options(sep="\x01", quote="", encoding="ISO-8859-1").csv(path, schema="line string")
        bad = F.col("line").isNotNull() & ~F.is_valid_utf8(F.encode("line", "ISO-8859-1").cast("string"))
        encoding = "utf-8" if lines.where(bad).isEmpty() else FALLBACK_ENCODING
    source = path if encoding.lower() in ("utf-8", "utf8") else _as_utf8(spark, path, encoding)
    reader = spark.read.options(header=True, multiLine=True, escape='"')
    return reader.csv(source, schema=schema) if schema else reader.csv(source, inferSchema=True)


def _as_utf8(spark: SparkSession, path: str, encoding: str) -> str:
    """Files decoded in the tasks and written as UTF-8 to the shared folder."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/valograph_text_{uuid.uuid4().hex}"
    read_documents(spark, path, lambda content: content.decode(encoding)).select("text").write.text(folder)
    return folder


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(id, attributes)`` and edges ``(src, dst, attributes)`` with attributes named as the keys declare."""
    key_schema = "_id string, `_attr.name` string"
    keys = spark.read.format("xml").option("rowTag", "key").schema(key_schema).load(path).where("_id is not null")
    names = F.map_from_entries(F.collect_list(F.struct(F.col("_id"), F.col("`_attr.name`"))))
    named = keys.agg(names.alias("_names"))
    data = "array<struct<_VALUE:string,_key:string>>"
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, data {data}").load(path).where("_id is not null")
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, data {data}").load(path).where("_source is not null")
    name = lambda d: F.coalesce(F.try_element_at(F.col("_names"), d["_key"]), d["_key"])  # noqa: E731  an undeclared key names itself
    pairs = F.transform(F.coalesce("data", F.array().cast(data)), lambda d: F.struct(name(d), d["_VALUE"]))
    attributes = F.map_from_entries(pairs).alias("attributes")
    with_names = lambda df: df.crossJoin(F.broadcast(named))
    return (
        with_names(nodes).select(F.col("_id").alias("id"), attributes),
        with_names(edges).select(F.col("_source").alias("src"), F.col("_target").alias("dst"), attributes),
    )


def read_documents(spark: SparkSession, path: str, extract=None) -> DataFrame:
    """Files as ``(path, file_name, text)``. ``extract`` turns bytes into text in the tasks; default is UTF-8."""
    files = spark.read.format("binaryFile").load(path)
    decode = extract or (lambda content: content.decode("utf-8", errors="replace"))

    def run(batches):
        for batch in batches:
            yield batch.assign(text=batch["content"].map(lambda b: decode(bytes(b))))[["path", "text"]]

    return files.select("path", "content").mapInPandas(run, "path string, text string").withColumn(
        "file_name", F.element_at(F.split("path", "/"), -1)
    )


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Names and sizes without reading contents."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "path", "length")


def audit_files(spark: SparkSession, roots: Sequence[str], wanted: Sequence[str]) -> DataFrame:
    """Each wanted file with the first root that has it, or not found."""
    found = None
    for position, root in enumerate(roots):
        one = list_files(spark, root).withColumn("_root", F.lit(position))
        found = one if found is None else found.unionByName(one)
    first = best_per_key(found, ["file_name"], [F.asc("_root")]).drop("_root")
    names = spark.createDataFrame([(n,) for n in wanted], "file_name string")
    return names.join(first, "file_name", "left").withColumn("found", F.col("path").isNotNull())


def bind_files(files: DataFrame, papers: DataFrame, id_pattern: str) -> DataFrame:
    """Papers with the file that belongs to them: by id in the name, else by equal title, else by title containment.

    Papers that share an id, or have none, are bound each by its own title. Files are folded to one per id and one per
    title key before they are joined. Containment, in either direction, goes
    through the rarest gram of the shorter key (``contained_pairs``); rows grow with the length of the keys.
    """
    solid = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    named = files.select("file_name", F.nullif(F.regexp_extract(stem, id_pattern, 1), F.lit("")).alias("id"), solid(stem).alias("key"))
    first = lambda df, c: df.groupBy(c).agg(F.min("file_name").alias("file_name"))
    ids, keys = first(named.where("id is not null"), "id"), materialise(first(named.where("key <> ''"), "key"))
    keyed = papers.withColumn("pkey", solid(F.col("title")))
    wanted = keyed.select("paper_id", "pkey").distinct()

    by_id = wanted.join(ids, wanted["paper_id"] == ids["id"]).select("paper_id", "pkey", "file_name", F.lit(1).alias("step"))
    by_title = wanted.where("pkey <> ''").join(keys, F.col("pkey") == F.col("key")).select("paper_id", "pkey", "file_name", F.lit(2).alias("step"))
    exact = by_id.unionByName(by_title)
    bound = exact.select(F.col("paper_id").alias("_id"), F.col("pkey").alias("_key"))
    own = F.col("paper_id").eqNullSafe(F.col("_id")) & (F.col("pkey") == F.col("_key"))
    open_keys = wanted.join(bound, own, "left_anti").where("pkey <> ''")
    titles = materialise(open_keys.select("pkey").distinct())
    in_file, in_title = contained_pairs(titles, keys, "pkey", "key"), contained_pairs(keys, titles, "key", "pkey")
    contained = first(in_file.select("pkey", "file_name").unionByName(in_title.select("pkey", "file_name")), "pkey")
    by_part = open_keys.join(contained, "pkey").select("paper_id", "pkey", "file_name", F.lit(3).alias("step"))
    best = best_per_key(exact.unionByName(by_part), ["paper_id", "pkey"], [F.asc("step"), F.asc("file_name")])
    best = best.withColumnsRenamed({"paper_id": "_id", "pkey": "_key"})
    return keyed.join(best, own, "left").drop("_id", "_key", "pkey")


def authorships_from_payload(payload: Column | str) -> Column:
    """JSON text of one work to a struct with its authorships."""
    return F.from_json(payload, AUTHORSHIP_PAYLOAD)


def flatten_authorships(payloads: DataFrame, payload: str) -> DataFrame:
    """One row per paper and author; institution ids and names joined by ``|``."""
    work = payloads.select(authorships_from_payload(payload).alias("w")).select("w.id", F.explode("w.authorships").alias("a"))
    join = lambda field: F.array_join(F.transform("a.institutions", lambda i: clean_id(i[field])), "|")
    return work.select(
        clean_id("id").alias("paper_id"),
        clean_id("a.author.id").alias("author_id"),
        F.col("a.author.display_name").alias("author_name"),
        F.col("a.author_position").alias("author_position"),
        F.coalesce("a.is_corresponding", F.lit(False)).alias("is_corresponding"),
        join("id").alias("institution_ids"),
        F.array_join(F.transform("a.institutions", lambda i: i["display_name"]), "|").alias("institution_names"),
    )


def future_citations(payloads: DataFrame, payload: str, first_year: int, last_year: int) -> DataFrame:
    """Citations per work within an explicit window of years."""
    work = payloads.select(F.from_json(payload, YEAR_COUNTS_PAYLOAD).alias("w")).select("w.*")
    inside = F.filter("counts_by_year", lambda y: y["year"].between(first_year, last_year))
    total = F.aggregate(inside, F.lit(0).cast("bigint"), lambda a, y: a + y["cited_by_count"])
    return work.select(clean_id("id").alias("paper_id"), F.coalesce(total, F.lit(0)).cast("bigint").alias("future_citations"))


def first_authors(authorships: DataFrame, order: Sequence[Column]) -> DataFrame:
    """First author per paper: the one placed ``first``, else the first named one."""
    is_first = F.when(F.lower("author_position") == "first", 0).otherwise(1)
    named = authorships.where(F.coalesce("author_name", F.lit("")) != "")
    return best_per_key(named, ["paper_id"], [is_first, *order]).select("paper_id", F.col("author_name").alias("first_author"))


def resolved_schema(fields: dict[str, str]) -> T.StructType:
    """Schema from name and type strings, for readers that must not infer."""
    return T.StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in fields.items()))
