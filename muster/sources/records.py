"""Sources and sinks of records: JSON lines, paged reads, batch-stamped appends, mirrors."""

from __future__ import annotations

import base64
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ranks

RESERVED = {"sort", "page", "per_page", "q", "filter"}
PAGE_MAX, BULK_MAX = 1000, 250


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank and malformed lines are passed over."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_pool(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records that have a natural key."""
    return read_jsonl(spark, path, schema).where("natural_key is not null")


def export(df: DataFrame) -> DataFrame:
    """A whole collection, without its store's ids."""
    return df.drop("id")


def find_one(df: DataFrame, **equal) -> DataFrame:
    return where_equal(df, equal).limit(1)


def ids_where(df: DataFrame, **equal) -> DataFrame:
    """Ids under equality filters: what a store gives in pages is one scan here."""
    return where_equal(df, equal).select("id")


def count(df: DataFrame, **equal) -> DataFrame:
    return where_equal(df, equal).agg(F.count("*").alias("n"))


def of_prefix(df: DataFrame, prefix: str, **equal) -> DataFrame:
    """Records whose natural key begins so, under equality filters."""
    return where_equal(df, equal).where(F.startswith("natural_key", F.lit(prefix)))


def where_equal(df: DataFrame, equal: dict) -> DataFrame:
    for k, v in equal.items():
        if k in RESERVED:
            raise ValueError(f"{k} is reserved")
        df = df.where(F.col(k) == F.lit(v))
    return df


def page(df: DataFrame, sort: str, page: int = 1, per_page: int = 250, tie: str = "id", **equal) -> DataFrame:
    """One page under equality filters; the order field:asc or field:desc must be given, ties go by the key."""
    if not sort or page < 1 or not 1 <= per_page <= PAGE_MAX:
        raise ValueError("a page needs an order, a number from 1 and 1 to 1000 rows")
    name, _, way = sort.partition(":")
    order = F.desc(name) if way == "desc" else F.asc(name)
    return where_equal(df, equal).orderBy(order, tie).offset((page - 1) * per_page).limit(per_page)


def append_batch(df: DataFrame, path: str, batch_id: str) -> None:
    """Appends JSON lines stamped with their batch, in a folder of the batch, so that it can go again."""
    df.withColumn("batch_id", F.lit(batch_id)).write.mode("append").partitionBy("batch_id").json(path)


def requests(df: DataFrame, key: str = "natural_key", size: int = BULK_MAX) -> DataFrame:
    """df with the number of the bulk request that carries each row: in order of key, at most size rows a request."""
    if not 1 <= size <= BULK_MAX:
        raise ValueError(f"a bulk request carries 1 to {BULK_MAX} rows")
    return ranks.running(df, [F.col(key).asc()], name="_n").withColumn("request", F.floor((F.col("_n") - 1) / size).cast("long")).drop("_n")


def append_missing(new: DataFrame, stored: DataFrame, path: str) -> None:
    """Writes only the rows whose natural key is not stored: a repeated write adds nothing."""
    missing(new, stored).write.mode("append").parquet(path)


def missing(new: DataFrame, stored: DataFrame) -> DataFrame:
    return new.dropDuplicates(["natural_key"]).join(stored.select("natural_key"), "natural_key", "left_anti")


def delete_batch(spark: SparkSession, path: str, batch_id: str) -> bool:
    """Removes a batch's folder; false if there is none, so it can be repeated."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id={batch_id}")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def replace_one(df: DataFrame, row: DataFrame, key: str) -> DataFrame:
    """df with the row of one key in place of what had it."""
    return df.join(row.select(key), key, "left_anti").unionByName(row)


def delete_one(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(~F.col(key).eqNullSafe(F.lit(value)))


def create_collection(spark: SparkSession, name: str, schema: str) -> None:
    """A table with the schema and the store's own fields, if there is none; one that is there gets the fields that it lacks. A field of another type is an error, and nothing is changed then."""
    wanted = T.StructType.fromDDL(f"{schema}, natural_key string, batch_id string")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in wanted)}) USING parquet")
    have = {f.name.lower(): f.dataType for f in spark.table(name).schema}
    if wrong := [f.name for f in wanted if have.get(f.name.lower(), f.dataType) != f.dataType]:
        raise ValueError(f"{name} has another type of {', '.join(wrong)}")
    if new := [f"`{f.name}` {f.dataType.simpleString()}" for f in wanted if f.name.lower() not in have]:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(new)})")


def mirrored(primary: Callable[[DataFrame], DataFrame], mirror: Callable[[DataFrame], None]) -> Callable[[DataFrame], None]:
    """A sink that writes to the first store, and to the second only what the first returns as landed."""

    def write(df: DataFrame) -> None:
        mirror(primary(df))

    return write


def double_wrapped(df: DataFrame, column: str) -> DataFrame:
    """Records whose data lies in data.data."""
    return df.where(wrapped_twice(F.col(column)))


def wrapped_twice(record: Column) -> Column:
    return F.coalesce(F.startswith(F.get_json_object(record, "$.data.data"), F.lit("{")), F.lit(False))


def enveloped(record: Column) -> Column:
    """A record in the store's envelope; one that is in it already is left."""
    return F.when(F.get_json_object(record, "$.data").isNotNull(), record).otherwise(F.concat(F.lit('{"data":'), record, F.lit("}")))


def opened(record: Column) -> Column:
    """What is in a record's envelope, of two if it is wrapped twice."""
    return F.when(wrapped_twice(record), F.get_json_object(record, "$.data.data")).otherwise(F.coalesce(F.get_json_object(record, "$.data"), record))


def restored(jobs: DataFrame, sessions: DataFrame, schema: str) -> DataFrame:
    """Collections out of the log of jobs: results of done jobs with their session's kind, in id order; results that do not parse are passed over."""
    out = jobs.join(sessions.select(F.col("id").alias("session_id"), F.col("kind").alias("collection")), "session_id").where("status = 'done' and result is not null")
    out = out.where(F.startswith(F.get_json_object("result", "$"), F.lit("{")))
    return out.withColumn("record", F.from_json("result", schema)).select("id", "collection", "record.*").orderBy("id")


def finished(jobs: DataFrame, kind: str, session: str | None = None) -> DataFrame:
    """Results of a kind, those that a new text is held against."""
    out = jobs.where((F.col("kind") == kind) & (F.col("status") == "done") & F.col("result").isNotNull())
    return out.where(F.col("session_id") == session) if session else out


def prices(catalog: DataFrame, used: DataFrame) -> DataFrame:
    """used (model, ...) with its prices; a model without one is an error, never free."""
    lost = used.join(catalog, "model", "left_anti").select("model").distinct().limit(5).collect()
    if lost:
        raise LookupError("no price for " + ", ".join(r["model"] for r in lost))
    return used.join(catalog, "model")


def unverified(catalog: DataFrame) -> DataFrame:
    return catalog.where("not verified").select("model")


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """x: what a JSON file holds; a byte order mark is passed over."""
    text = F.regexp_replace("value", "^\ufeff", "")
    return spark.read.text(path, wholetext=True).select(F.from_json(text, schema).alias("x"))


def service_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Services with a row for each segment that has a price range."""
    raw = _json(spark, path, "array<struct<service:string,needs:string,price:map<string,array<double>>>>").select(F.inline("x"))
    return raw.select("service", "needs", F.explode("price").alias("segment", "range")).select("service", "needs", "segment", F.col("range")[0].alias("low"), F.col("range")[1].alias("high"))


def name_book(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Lists of a name book; every male first name must have a patronymic."""
    entry = "array<struct<name:string,by_decade:map<string,double>,weight:double>>"
    raw = _json(spark, path, f"struct<male_first:{entry},female_first:{entry},patronymics:map<string,struct<male:string,female:string>>,surnames:array<struct<male:string,female:string,weight:double>>>").select("x.*")
    first = None
    for g, c in (("m", "male_first"), ("f", "female_first")):
        part = raw.select(F.explode(c).alias("x")).select(F.lit(g).alias("gender"), "x.name", F.explode("x.by_decade").alias("decade", "weight"))
        first = part if first is None else first.union(part)
    patronymics = raw.select(F.explode("patronymics").alias("father", "p")).select("father", "p.*")
    bare = raw.select(F.explode("male_first").alias("x")).select(F.col("x.name").alias("father")).join(patronymics, "father", "left_anti").distinct().limit(5).collect()
    if bare:
        raise ValueError("no patronymic for " + ", ".join(r["father"] for r in bare))
    return {"first": first.withColumn("decade", F.col("decade").cast("long")), "patronymics": patronymics, "surnames": raw.select(F.inline("surnames"))}


def photo_map(spark: SparkSession, path: str) -> DataFrame:
    """key, path of a JSON object of keys and paths."""
    return _json(spark, path, "map<string,string>").select(F.explode("x").alias("key", "path"))


def with_photos(records: DataFrame, photos: DataFrame, key: str = "natural_key", column: str = "photo") -> DataFrame:
    """records with the mapped photo where they have none of their own."""
    given = photos.select(F.col("key").alias("_key"), F.col("path").alias("_path"))
    return records.join(given, F.col(key) == F.col("_key"), "left").withColumn(column, F.coalesce(column, "_path")).drop("_key", "_path")


def upload_missing(photos: DataFrame, linked: DataFrame) -> DataFrame:
    """Photos (key, role, path) whose role is not linked yet, gathered by entity."""
    new = photos.join(linked.select("key", "role"), ["key", "role"], "left_anti")
    return new.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("role", "path"))).alias("photos"))


def linked_photos(entities: DataFrame, photos: DataFrame) -> DataFrame:
    """entities (key, images: array of (role, path)) with the photos of roles that they have none of, in order of role."""
    have = entities.select("key", F.explode("images").alias("x")).select("key", "x.role")
    out = entities.join(upload_missing(photos, have), "key", "left")
    return out.withColumn("images", F.sort_array(F.concat(F.coalesce("images", F.array().cast("array<struct<role:string,path:string>>")), F.coalesce("photos", F.array().cast("array<struct<role:string,path:string>>"))))).drop("photos")


def write_images(images: DataFrame, path: str) -> None:
    """Writes image bytes (key, file, data) of decoded_images() as Parquet below path, a folder for each file type."""
    images.withColumn("type", F.substring_index("file", ".", -1)).write.mode("append").partitionBy("type").parquet(path)


JPEG, PNG = b"\xff\xd8\xff", b"\x89PNG"


def extension(data: bytes) -> str:
    return "jpg" if data.startswith(JPEG) else "png" if data.startswith(PNG) else "bin"


def decoded_images(df: DataFrame, column: str) -> DataFrame:
    """key, data and file name of base64 images; written with any binary sink."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            data = [base64.b64decode(x) if x else b"" for x in b.column(column).to_pylist()]
            names = [f"{k}.{extension(d)}" for k, d in zip(b.column("key").to_pylist(), data, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(names), pa.array(data, pa.binary())], names=["key", "file", "data"])

    return df.select(F.regexp_replace("key", r"[^\p{L}\p{N}_.-]", "_").alias("key"), column).mapInArrow(run, T.StructType([T.StructField("key", T.StringType()), T.StructField("file", T.StringType()), T.StructField("data", T.BinaryType())]))
