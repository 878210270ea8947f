"""Queries of sources, requests, stores and the rest of the operators over the driver's tables, and their SQL."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api, engine
from .catalog import _COMPOSE, _DICTIONARY, _JOBS, _jobs, _pools, _u, _words, t
from .functions import rules
from .functions import text as T
from .operators import compose, profiles, prompts, queue, sampling, similarity
from .operators.lineage import folder
from .plans import dictionary
from .sources import paged, records, search

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict:
    return dict(ORACLES)


# ---- sources and sinks: written below the shared folder and read again


@query("SELECT s_suppkey, s_name FROM supplier")
def src_jsonl(spark, d):
    """JSON lines with blank and broken ones between."""
    path = folder(spark, "jsonl")
    s = t(spark, d, "supplier")
    s.select(F.to_json(F.struct("s_suppkey", "s_name"))).union(s.select(F.lit(""))).union(s.select(F.lit('{"s_suppkey": 1, "s_na'))).write.text(path)
    return records.read_jsonl(spark, path, "s_suppkey long, s_name string")


@query("SELECT 's:' || s_suppkey AS natural_key, s_name FROM supplier WHERE s_suppkey % 3 <> 0")
def src_pool(spark, d):
    path = folder(spark, "pool")
    key = F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("s:"), F.col("s_suppkey")))
    t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), key.alias("natural_key"), "s_name").write.json(path)
    return records.export(records.read_pool(spark, path, "id long, natural_key string, s_name string"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey % 2 = 1")
def src_batches(spark, d):
    """Two batches are appended, one of them goes again, twice."""
    path = folder(spark, "batches")
    p = t(spark, d, "part").select("p_partkey", "p_name")
    records.append_batch(p.where("p_partkey % 2 = 1"), path, "odd")
    records.append_batch(p.where("p_partkey % 2 = 0"), path, "even")
    assert records.delete_batch(spark, path, "even") and not records.delete_batch(spark, path, "even")
    return spark.read.schema("p_partkey long, p_name string").json(path).select("p_partkey", "p_name")


@query("SELECT n_name AS natural_key, n_regionkey FROM nation")
def src_append_missing(spark, d):
    """What a store has is not written again, however often it is sent."""
    path = folder(spark, "missing")
    n = t(spark, d, "nation").select(F.col("n_name").alias("natural_key"), "n_regionkey")
    n.where("n_regionkey < 2").write.parquet(path)
    for _ in range(2):
        records.append_missing(n.union(n), spark.read.parquet(path), path)
    return spark.read.parquet(path)


@query("SELECT p_partkey, (row_number() OVER (ORDER BY p_name, p_partkey) - 1) // 250 AS request FROM part")
def src_bulk_requests(spark, d):
    keyed = t(spark, d, "part").withColumn("natural_key", F.struct("p_name", "p_partkey"))
    return records.requests(keyed).select("p_partkey", "request")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0")
def src_mirror(spark, d):
    """The mirror gets only what landed in the first store."""
    first, second = folder(spark, "first"), folder(spark, "second")

    def primary(df: DataFrame) -> DataFrame:
        df.where("s_acctbal > 0").write.parquet(first)
        return spark.read.parquet(first)

    records.mirrored(primary, lambda df: df.write.parquet(second))(t(spark, d, "supplier"))
    return spark.read.parquet(second).select("s_suppkey", "s_name")


@query("SELECT r_regionkey, CASE WHEN r_regionkey = 2 THEN 'elsewhere' ELSE r_name END AS r_name FROM region WHERE r_regionkey <> 4")
def src_replace_delete(spark, d):
    r = t(spark, d, "region")
    one = r.where("r_regionkey = 2").withColumn("r_name", F.lit("elsewhere"))
    return records.delete_one(records.replace_one(r, one, "r_regionkey"), "r_regionkey", 4)


@query("SELECT o_orderkey AS id, n_name AS collection, o_orderpriority AS grade, o_totalprice AS total FROM orders JOIN nation ON n_nationkey = o_custkey % 25 WHERE o_orderstatus = 'F' AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0")
def src_restore(spark, d):
    """Results of done jobs; some are null, some do not parse."""
    o = t(spark, d, "orders")
    result = F.when(F.col("o_orderkey") % 5 == 0, '{"grade": ').when(F.col("o_orderkey") % 7 != 0, F.to_json(F.struct(F.col("o_orderpriority").alias("grade"), F.col("o_totalprice").alias("total"))))
    jobs = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 25).alias("session_id"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("dead").alias("status"), result.alias("result"))
    sessions = t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("kind"))
    return records.restored(jobs, sessions, "grade string, total double")


@query("SELECT id, key FROM (SELECT o_orderkey AS id, o_orderpriority || ':' || o_custkey AS key, o_orderstatus AS s, o_custkey % 10 AS session FROM orders) WHERE s = 'F' AND key LIKE '1-%' AND session = 3")
def src_filters(spark, d):
    """Finished results of a kind and session, by key prefix."""
    jobs = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("text").alias("kind"), (F.col("o_custkey") % 10).cast("string").alias("session_id"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("dead").alias("status"), F.lit("{}").alias("result"), F.concat_ws(":", "o_orderpriority", "o_custkey").alias("natural_key"))
    return records.of_prefix(records.finished(jobs, "text", "3"), "1-").select("id", F.col("natural_key").alias("key"))


@query("SELECT 'one' AS what, count(*) AS n FROM (SELECT 1 FROM customer WHERE c_custkey = 7 LIMIT 1) UNION ALL SELECT 'ids', count(*) FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3 UNION ALL SELECT 'count', count(*) FROM customer WHERE c_mktsegment = 'BUILDING'")
def src_find(spark, d):
    c = t(spark, d, "customer").withColumn("id", F.col("c_custkey"))
    n = lambda what, df: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    return n("one", records.find_one(c, c_custkey=7)).union(n("ids", records.ids_where(c, c_mktsegment="BUILDING", c_nationkey=3))).union(records.count(c, c_mktsegment="BUILDING").select(F.lit("count"), "n"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN true ELSE false END AS twice, s_name AS name FROM supplier")
def src_envelopes(spark, d):
    s = t(spark, d, "supplier")
    plain = F.to_json(F.struct(F.col("s_name").alias("name")))
    one = records.enveloped(records.enveloped(plain))
    stored = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit('{"data":'), one, F.lit("}"))).when(F.col("s_suppkey") % 3 == 1, one).otherwise(plain)
    rows = s.select("s_suppkey", stored.alias("record"))
    return rows.select("s_suppkey", records.wrapped_twice(F.col("record")).alias("twice"), F.get_json_object(records.opened(F.col("record")), "$.name").alias("name"))


@query("SELECT o_orderpriority AS model, round(sum(o_custkey / 1e6 * (0.1 * n_nationkey + 0.1)), 6) AS cost FROM orders JOIN nation ON n_nationkey = CAST(substr(o_orderpriority, 1, 1) AS INT) GROUP BY 1")
def src_prices(spark, d):
    """Prices of models in use; a model without one would be an error."""
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * 0.1 + 0.1).alias("price"))
    names = t(spark, d, "orders").select(F.col("o_orderpriority").alias("model")).distinct()
    catalog = names.join(n, F.substring("model", 1, 1).cast("int") == F.col("k")).select("model", "price")
    used = records.prices(catalog, t(spark, d, "orders").select(F.col("o_orderpriority").alias("model"), "o_custkey"))
    return used.groupBy("model").agg(F.round(F.sum(profiles.cost(F.col("o_custkey"), F.lit(0), F.col("price"), F.lit(0.0))), 6).alias("cost"))


_SERVICES = [{"service": "stay", "needs": "always", "price": {"low": [100, 200], "high": [900, 1500]}}, {"service": "visit", "needs": "doctor", "price": {"high": [50, 50]}}]
_BOOK = {
    "male_first": [{"name": "Adam", "by_decade": {"1960": 3, "1970": 1}, "weight": 1}, {"name": "Boris", "by_decade": {"1970": 2}, "weight": 1}],
    "female_first": [{"name": "Clara", "by_decade": {"1960": 1, "1970": 1}, "weight": 1}],
    "patronymics": {"Adam": {"male": "Adamovich", "female": "Adamovna"}, "Boris": {"male": "Borisovich", "female": "Borisovna"}},
    "surnames": [{"male": "Stone", "female": "Stone", "weight": 2}, {"male": "Novy", "female": "Novaya", "weight": 1}, {"male": "Kos", "female": "Kosa", "weight": 1}],
}


def _file(spark: SparkSession, name: str, value) -> str:
    """A JSON file with a byte order mark."""
    path = folder(spark, name)
    spark.createDataFrame([("﻿" + json.dumps(value),)], "x string").coalesce(1).write.text(path)
    return path


@query("SELECT * FROM (VALUES ('stay', 'always', 'low', 100.0::DOUBLE, 200.0::DOUBLE), ('stay', 'always', 'high', 900.0, 1500.0), ('visit', 'doctor', 'high', 50.0, 50.0)) v(service, needs, segment, low, high)")
def src_service_catalog(spark, d):
    return records.service_catalog(spark, _file(spark, "services", _SERVICES))


@query("SELECT * FROM (VALUES ('m', 12), ('f', 6)) v(gender, names)")
def smp_capacity(spark, d):
    book = records.name_book(spark, _file(spark, "book", _BOOK))
    return sampling.capacity(book["first"], book["patronymics"], book["surnames"])


@query(f"""WITH p AS (SELECT c_custkey AS id, 1965 + c_custkey % 10 AS year, CASE WHEN c_custkey % 2 = 0 THEN 'm' ELSE 'f' END AS gender FROM customer WHERE c_custkey % 10 >= 0),
    n(gender, name, decade, weight) AS (VALUES ('m', 'Adam', 1960, 3.0::DOUBLE), ('m', 'Adam', 1970, 1.0), ('m', 'Adam', 1930, 1.0), ('m', 'Adam', 1940, 1.0), ('m', 'Boris', 1970, 2.0), ('m', 'Boris', 1940, 2.0), ('f', 'Clara', 1960, 1.0), ('f', 'Clara', 1970, 1.0)),
    c AS (SELECT *, sum(weight) OVER (PARTITION BY gender, decade ORDER BY name) AS upto, sum(weight) OVER (PARTITION BY gender, decade) AS total FROM n),
    o AS (SELECT id, name FROM p JOIN c ON c.gender = p.gender AND c.decade = (year // 10) * 10 AND {_u("'7'", "'first'", "id")} * total >= upto - weight AND {_u("'7'", "'first'", "id")} * total < upto),
    f AS (SELECT id, name FROM p JOIN c ON c.gender = 'm' AND c.decade = ((year - 28) // 10) * 10 AND {_u("'7'", "'father'", "id")} * total >= upto - weight AND {_u("'7'", "'father'", "id")} * total < upto),
    s AS (SELECT id, {_u("'7'", "'surname'", "id")} * 4 AS u FROM p)
    SELECT p.id, CASE WHEN u < 2 THEN 'Stone' WHEN u < 3 THEN CASE gender WHEN 'm' THEN 'Novy' ELSE 'Novaya' END ELSE CASE gender WHEN 'm' THEN 'Kos' ELSE 'Kosa' END END || ' ' || o.name || ' ' || f.name || CASE gender WHEN 'm' THEN 'ovich' ELSE 'ovna' END AS full_name
    FROM p JOIN o ON o.id = p.id JOIN f ON f.id = p.id JOIN s ON s.id = p.id""")
def smp_full_names(spark, d):
    """Names by decade of birth, a father's by his own decade, surnames by gender; the book's fathers go back two decades more."""
    raw = json.loads(json.dumps(_BOOK))
    for who, weight in (("Adam", 1), ("Boris", 2)):
        next(x for x in raw["male_first"] if x["name"] == who)["by_decade"] |= {"1940": weight} | ({"1930": 1} if who == "Adam" else {})
    book = records.name_book(spark, _file(spark, "book", raw))
    people = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.lit(1965) + F.col("c_custkey") % 10).cast("long").alias("year"), F.when(F.col("c_custkey") % 2 == 0, "m").otherwise("f").alias("gender"))
    return sampling.full_names(people, book["first"], book["patronymics"], [(x["male"], x["female"], float(x["weight"])) for x in raw["surnames"]], 7).select("id", "full_name")


@query("SELECT 'part:' || p_partkey AS natural_key, p_name, p_brand, p_size, CASE WHEN p_partkey % 3 = 0 THEN 'first' WHEN p_partkey % 3 = 1 THEN 'both' ELSE 'second' END AS came FROM part WHERE p_size = 7")
def src_pages(spark, d):
    """Parts written to pages in two loads that share a third of their keys, of which the second writes what is missing; read back by an equality."""
    parts = t(spark, d, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("natural_key"), "p_name", "p_brand", "p_size", "p_partkey")
    path = folder(spark, "pages")
    came = F.when(F.col("p_partkey") % 3 == 0, "first").when(F.col("p_partkey") % 3 == 1, "both").otherwise("second")
    paged.write_missing(parts.where("p_partkey % 3 < 2").withColumn("came", came).drop("p_partkey"), path)
    paged.write_missing(parts.where("p_partkey % 3 > 0").withColumn("came", F.when(came == "both", "conflict").otherwise(came)).drop("p_partkey"), path)
    return paged.read(spark, path, "natural_key string, p_name string, p_brand string, p_size int, came string").where("p_size = 7")


_BM25 = f"""w AS (SELECT doc_id, {_words('text')} AS w FROM documents), z AS (SELECT count(*) AS docs, sum(len(w)) / count(*) AS mean FROM w),
    p AS (SELECT doc_id, any_value(len(w)) AS len, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM w) GROUP BY doc_id, term),
    i AS (SELECT term, ln(1 + (any_value(docs) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, z GROUP BY 1),
    b AS (SELECT query, doc_id AS key, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 9) AS score FROM a JOIN p USING (term) JOIN i USING (term), z GROUP BY 1, 2)"""


def _index(spark, d):
    return search.SearchIndex.build(t(spark, d, "documents"), folder(spark, "search"), key="doc_id", keep=("lang",))


@query(f"""WITH a AS (SELECT item_id AS query, unnest(list_distinct({_words('text')})) AS term FROM benchmark), {_BM25}
    SELECT query, key, CAST(row_number() OVER r AS INTEGER) AS rank, round(score, 6) AS score FROM b WINDOW r AS (PARTITION BY query ORDER BY score DESC, key) QUALIFY row_number() OVER r <= 10""")
def src_search(spark, d):
    """The ten documents that answer each benchmark item best."""
    items = t(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")
    return _index(spark, d).search(items, 10).withColumn("score", F.round("score", 6))


@query(f"""WITH a AS (SELECT doc_id AS query, unnest(list_distinct({_words('text')})) AS term FROM documents WHERE doc_id % 20 = 0), {_BM25},
    l AS (SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM b WHERE key IN (SELECT doc_id FROM documents WHERE lang = 'en') QUALIFY rank <= 20),
    c AS (SELECT q.vec_id AS query, e.vec_id AS key, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
    s AS (SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM c QUALIFY rank <= 20),
    f AS (SELECT query, key, round(sum(1 / (60 + rank)), 9) AS score FROM (FROM l UNION ALL FROM s) GROUP BY 1, 2)
    SELECT query, key, CAST(row_number() OVER r AS INTEGER) AS rank, score FROM f WINDOW r AS (PARTITION BY query ORDER BY score DESC, key) QUALIFY row_number() OVER r <= 10""")
def src_search_fused(spark, d):
    """English documents by the words of each twentieth document, and all vectors by its vector, as one list."""
    asked = t(spark, d, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query"), "text")
    vectors = t(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("v"))
    lexical = _index(spark, d).search(asked, 20, F.col("lang") == "en")
    semantic = search.nearest_vectors(vectors.where("key % 20 = 0").withColumnRenamed("key", "query"), vectors, 20)
    return search.fused([lexical, semantic], 10)


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'own.jpg' WHEN c_nationkey < 10 THEN 'n' || c_nationkey || '.png' END AS photo FROM customer")
def job_photo_map(spark, d):
    path = _file(spark, "photos", {f"nation:{k}": f"n{k}.png" for k in range(10)})
    c = t(spark, d, "customer").select("c_custkey", F.concat(F.lit("nation:"), "c_nationkey").alias("natural_key"), F.when(F.col("c_custkey") % 4 == 0, "own.jpg").alias("photo"))
    return records.with_photos(c, records.photo_map(spark, path)).select("c_custkey", "photo")


@query("""WITH e AS (SELECT o_orderkey AS key, o_custkey FROM orders), p AS (SELECT l_orderkey AS key, 'r' || l_linenumber AS role, l_linenumber || '.png' AS path, l_linenumber AS n FROM lineitem WHERE l_linenumber < 4 GROUP BY ALL)
    SELECT key, coalesce(string_agg(role || '=' || CASE WHEN n = 1 THEN 'first.png' ELSE path END, ',' ORDER BY role), 'r1=first.png') AS images FROM (SELECT e.key, 'r1' AS role, 1 AS n, '' AS path FROM e UNION SELECT e.key, role, n, path FROM e JOIN p ON p.key = e.key WHERE n > 1) GROUP BY 1""")
def src_link_photos(spark, d):
    """Entities have a first photo; those of other roles are added."""
    e = t(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.array(F.struct(F.lit("r1").alias("role"), F.lit("first.png").alias("path"))).alias("images"))
    n = F.col("l_linenumber").cast("string")
    p = t(spark, d, "lineitem").where("l_linenumber < 4").select(F.col("l_orderkey").alias("key"), F.concat(F.lit("r"), n).alias("role"), F.concat(n, F.lit(".png")).alias("path")).distinct()
    return records.linked_photos(e, p).select("key", F.array_join(F.transform("images", lambda x: F.concat_ws("=", x["role"], x["path"])), ",").alias("images"))


# ---- projections

_SHOWN = [
    {"key": "c_name", "title": "name", "group": "who", "domain": {"type": "enum"}},
    {"key": "c_mktsegment", "title": "segment", "directive": "works in", "mention": "background", "domain": {"type": "enum"}},
    {"key": "c_acctbal", "title": "balance", "mention": "required", "domain": {"type": "float"}},
    {"key": "c_nationkey", "title": "nation", "usage": "visual", "group": "look", "domain": {"type": "int"}},
    {"key": "c_custkey", "title": "number", "usage": "store_only", "domain": {"type": "int"}},
]
_BAL = "CASE WHEN c_acctbal = floor(c_acctbal) THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) ELSE printf('%.2f', c_acctbal) END"


@query(f"""SELECT c_custkey, '— works in: ' || c_mktsegment AS background, 'balance: ' || {_BAL} AS required,
    CAST(json_object('temperature', 0.9::DOUBLE, 'max_tokens', 2000, 'user', '[who]' || chr(10) || 'name: ' || c_name || chr(10) || chr(10) || '— works in: ' || c_mktsegment || chr(10) || chr(10) || 'balance: ' || {_BAL} || chr(10) || chr(10) || 'be brief', 'schema', '{{}}') AS VARCHAR) AS request FROM customer""")
def prj_requests(spark, d):
    shown = dictionary.Dictionary(_SHOWN)
    c = t(spark, d, "customer")
    return c.select("c_custkey", prompts.background(shown).alias("background"), F.array_join(prompts.required(shown), "; ").alias("required"), prompts.request(shown, "be brief", "{}").alias("request"))


@query("SELECT c_custkey, role, 'draw ' || role || chr(10) || '[who]' || chr(10) || 'name: ' || c_name || chr(10) || 'segment: ' || c_mktsegment AS prompt, ref FROM customer, (VALUES ('front', NULL), ('side', 'front')) r(role, ref)".replace("'[who]' || chr(10) || 'name: ' || c_name || chr(10) || 'segment: ' || c_mktsegment", "'[look]' || chr(10) || 'nation: ' || c_nationkey"))
def prj_images(spark, d):
    both = [p | {"usage": p.get("usage", "text")} for p in _SHOWN]
    out = prompts.image_requests(t(spark, d, "customer"), dictionary.Dictionary(both), [("front", "draw front", None), ("side", "draw side", "front")])
    return out.select("c_custkey", "role", "prompt", F.col("ref_role").alias("ref"))


@query("""SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN CAST(json_object('s_suppkey', s_suppkey, 's_name', s_name, 'bio', 'of ' || s_nationkey, 'entity_kind', 'place') AS VARCHAR) ELSE CAST(json_object('s_suppkey', s_suppkey, 'bio', 'of ' || s_nationkey, 'entity_kind', 'place') AS VARCHAR) END AS record,
    CASE WHEN s_acctbal > 0 THEN s_name END AS name FROM supplier""")
def prj_records(spark, d):
    """Records without nulls and echoes, and back again."""
    rows = t(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("s_name"), F.lit("5").alias("stated_age"), F.concat(F.lit("of "), "s_nationkey").alias("bio"))
    made = rows.withColumn("record", prompts.record(rows, "place", ["bio"], ["stated_age"]))
    plain = dictionary.Dictionary([{"key": "s_suppkey", "domain": {"type": "int"}}, {"key": "s_name", "domain": {"type": "enum"}}])
    back = prompts.restored(made, plain, "record").select("s_suppkey", F.col("s_name").alias("name"))
    return made.select("s_suppkey", "record").join(back, "s_suppkey")


@query(f"""SELECT c_custkey AS idx, 30 + c_custkey % 40 AS age, CASE WHEN {_u("'9'", "c_custkey", "'0'", "'region'", "'0'")} * 6 < 3 THEN 'north' WHEN {_u("'9'", "c_custkey", "'0'", "'region'", "'0'")} * 6 < 5 THEN 'south' ELSE 'west' END AS region,
    {_u("'9'", "c_custkey", "'0'", "'leads'", "'0'")} < CASE WHEN c_custkey % 20 >= 15 THEN 0.3 * 6 / (0.3 * 6 + 0.7) ELSE 0.3 END AS leads FROM customer""")
def prj_reshoot(spark, d):
    """Two parameters are drawn anew; the soft rule sees the others as they are."""
    whole = dictionary.loads(_DICTIONARY)
    k = F.col("c_custkey")
    rows = t(spark, d, "customer").select(k.alias("idx"), F.lit("any").alias("cohort"), (F.lit(30) + k % 40).cast("long").alias("age"), F.lit("moon").alias("region"), (k % 20).cast("long").alias("years"), F.lit(False).alias("leads"), F.array(F.lit("plan")).alias("skills"), F.lit(1.0).cast("double").alias("start"), F.lit(None).cast("string").alias("name"))
    return sampling.reshot(rows, whole, ["region", "leads"], 9).select("idx", "age", "region", "leads")


@query("SELECT * FROM (VALUES ('age', '21'), ('region', 'north'), ('years', '0'), ('leads', 'False'), ('skills', '[]'), ('start', 'None'), ('name', 'None')) v(key, value)")
def prj_defaults(spark, d):
    return spark.createDataFrame([(p["key"], str(dictionary.default(p["domain"]))) for p in dictionary.loads(_DICTIONARY).params], "key string, value string")


@query("""SELECT s_suppkey, '{"model":"m","messages":[{"role":"system","content":"be kind"},{"role":"user","content":"' || s_name || '"}],"max_tokens":50,"temperature":0.9,"reasoning_effort":"high","response_format":{"type":"json_schema","json_schema":{"name":"result","strict":true,"schema":{"a":1}}}}' AS strict,
    '{"model":"m","messages":[{"role":"system","content":"be kind"},{"role":"user","content":"' || s_name || '"}],"response_format":{"type":"json_object"}}' AS loose FROM supplier""")
def prj_model_request(spark, d):
    user = F.col("s_name")
    return t(spark, d, "supplier").select("s_suppkey", prompts.model_request("m", "be kind", user, '{"a":1}', 50, 0.9, "high", True, True).alias("strict"), prompts.model_request("m", "be kind", user, '{"a":1}', effort="high").alias("loose"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS text, event_id % 100 AS tokens_in, CASE WHEN event_id % 5 = 0 THEN 0 ELSE user_id END AS tokens_out, round((event_id % 100) / 1e6 * 0.2 + CASE WHEN event_id % 5 = 0 THEN 0 ELSE user_id END / 1e6 * 0.5, 9) AS cost FROM events")
def prj_model_response(spark, d):
    e = t(spark, d, "events")
    choices = F.when(F.col("event_id") % 3 == 0, F.lit("[]")).otherwise(F.concat(F.lit('[{"message":{"content":"'), "event_type", F.lit('"}}]')))
    usage = F.concat(F.lit('{"prompt_tokens":'), F.col("event_id") % 100, F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit(',"completion_tokens":'), "user_id")), F.lit("}"))
    body = F.concat(F.lit('{"choices":'), choices, F.lit(',"usage":'), usage, F.lit("}"))
    r = prompts.model_response(F.col("body"), F.lit(0.2), F.lit(0.5))
    return e.select("event_id", body.alias("body")).select("event_id", r.alias("r")).select("event_id", "r.text", "r.tokens_in", "r.tokens_out", F.round("r.cost", 9).alias("cost"))


# ---- sampling: one attempt of every domain, with soft rules, cohorts and constraints

_EVERY = {
    "params": [
        {"key": "grade", "identity": True, "domain": {"kind": "int", "min": 1, "max": 5, "weights": [5, 4, 3, 2, 1]}},
        {"key": "height", "domain": {"kind": "float", "min": 1.5, "max": 2.0}},
        {"key": "urban", "domain": {"kind": "bool", "p_true": 0.4}},
        {"key": "job", "domain": {"kind": "enum", "variants": [{"value": "clerk", "weight": 3}, "guard", {"value": "cook", "weight": 2}]}},
        {"key": "pay", "domain": {"kind": "int", "min": 10, "max": 90}},
        {"key": "born", "domain": {"kind": "computed", "expr": "2026 - grade * 2"}},
        {"key": "broken", "domain": {"kind": "computed", "expr": "1 / (grade - 3)"}},
        {"key": "note", "domain": {"kind": "derived"}},
    ],
    "soft": [
        {"name": "tall", "when": "height > 1.8", "then": [{"kind": "weight", "param": "job", "value": "guard", "factor": 4}]},
        {"name": "cooks", "when": "job == 'cook'", "then": [{"kind": "range", "param": "pay", "min": 40}]},
        {"name": "guards", "when": "job == 'guard'", "then": [{"kind": "force", "param": "pay", "value": 15}]},
    ],
}
_EVERY_COHORTS = [{"name": "town", "biases": [{"kind": "weight", "param": "urban", "value": "true", "factor": 3}, {"kind": "force", "param": "pay", "value": 77}]}, {"name": "land", "biases": []}]


def _draw(key: str) -> str:
    return _u("'7'", "c_custkey", "'0'", f"'{key}'", "'0'")


@query(f"""WITH u AS (SELECT c_custkey AS idx, c_custkey % 2 = 0 AS town, {_draw('grade')} * 15 AS g, 1.5 + {_draw('height')} * 0.5 AS height, {_draw('urban')} AS ur, {_draw('job')} AS j, {_draw('pay')} AS p FROM customer),
    v AS (SELECT *, CASE WHEN g < 5 THEN 1 WHEN g < 9 THEN 2 WHEN g < 12 THEN 3 WHEN g < 14 THEN 4 ELSE 5 END AS grade, ur < CASE WHEN town THEN 0.4 * 3 / (0.4 * 3 + 0.6) ELSE 0.4 END AS urban, CASE WHEN height > 1.8 THEN 4 ELSE 1 END AS gw FROM u),
    w AS (SELECT *, CASE WHEN j * (5 + gw) < 3 THEN 'clerk' WHEN j * (5 + gw) < 3 + gw THEN 'guard' ELSE 'cook' END AS job FROM v)
    SELECT idx, grade, round(height, 9) AS height, urban, job, CAST(CASE WHEN job = 'guard' THEN 15 WHEN town THEN 77 WHEN job = 'cook' THEN 40 + floor(p * 41) ELSE 10 + floor(p * 71) END AS BIGINT) AS pay,
      (2026 - grade * 2)::DOUBLE AS born, CASE WHEN grade <> 3 THEN round(1.0 / (grade - 3), 9) END AS broken, NULL::VARCHAR AS note, 'm:s:' || idx AS natural_key FROM w""")
def smp_attempt(spark, d):
    """One attempt for every customer: weighted whole numbers, a bool's odds, the first force (the soft rule's), narrowed ranges, a computed error as null."""
    every = dictionary.loads(json.dumps(_EVERY))
    cap = {"kind": "range", "param": "pay", "max": 80}
    cohorts = [c | {"biases": [dictionary.biased(b) for b in [*c["biases"], cap]]} for c in _EVERY_COHORTS]
    rows = t(spark, d, "customer").select(F.col("c_custkey").alias("idx"), F.when(F.col("c_custkey") % 2 == 0, "town").otherwise("land").alias("cohort"))
    out = sampling.drawn(rows, every, 7, 0, cohorts)
    return out.select("idx", "grade", F.round("height", 9).alias("height"), "urban", "job", "pay", "born", F.round("broken", 9).alias("broken"), "note", sampling.natural_key("m", F.lit("s"), F.col("idx")).alias("natural_key"))


@query("SELECT c_custkey AS id, concat_ws('|', 'nation=' || c_nationkey, 'balance=' || CASE WHEN c_acctbal = floor(c_acctbal) THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) ELSE printf('%.2f', c_acctbal) END, 'name=' || c_name) AS signature FROM customer")
def prj_signature(spark, d):
    plain = dictionary.Dictionary([{"key": "nation", "identity": True, "domain": {"type": "int", "min": 0, "max": 99}}, {"key": "balance", "identity": True, "domain": {"type": "float", "min": 0, "max": 1}}, {"key": "other", "domain": {"type": "derived"}}, {"key": "name", "identity": True, "domain": {"type": "enum", "variants": ["x"]}}])
    rows = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.lit("").alias("other"), F.col("c_name").alias("name"))
    return rows.select("id", sampling.signature(plain).alias("signature"))


# ---- profiles and reports


@query("SELECT round(avg(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END), 6) AS share FROM lineitem")
def agg_bool_profile(spark, d):
    returned = F.when(F.col("l_orderkey") % 2 == 0, F.col("l_returnflag") == "R").otherwise(F.nullif(F.col("l_returnflag") == "R", F.lit(False)))
    return profiles.bool_profile(t(spark, d, "lineitem").select(returned.alias("x")), "x").select(F.round("share", 6).alias("share"))


@query(f"WITH {_JOBS}, p AS (SELECT session_id, count(*) FILTER (status IN ('done', 'dead')) AS f, count(*) FILTER (status IN ('pending', 'running')) AS l FROM j GROUP BY 1) SELECT session_id, CASE WHEN f > 0 THEN round(100.0 / f * l, 6) END AS seconds FROM p")
def agg_eta(spark, d):
    p = profiles.progress(_jobs(spark, d))
    return p.select("session_id", F.round(profiles.eta(F.lit(100.0), F.col("done") + F.col("dead"), F.col("pending") + F.col("running")), 6).alias("seconds"))


@query("SELECT 'customer' AS pool, (SELECT count(*) FROM customer) AS local, 0 AS remote UNION ALL SELECT 'nation', (SELECT count(*) FROM nation), (SELECT count(*) FROM nation WHERE n_regionkey = 1) UNION ALL SELECT 'region', 0, (SELECT count(*) FROM region)")
def agg_census(spark, d):
    n, c, r = (t(spark, d, x) for x in ("nation", "customer", "region"))
    return api.collections({"customer": c, "nation": n}, {"nation": n.where("n_regionkey = 1"), "region": r})


@query("SELECT c_nationkey AS place, list_sort(list(c_custkey % 50))[count(*) // 2 + 1] AS median_age, round(avg(c_acctbal), 6) AS fit FROM customer GROUP BY 1")
def agg_team_age(spark, d):
    members = t(spark, d, "customer").select(F.col("c_nationkey").alias("place"), (F.col("c_custkey") % 50).alias("age"), F.col("c_acctbal").alias("fit"))
    return compose.team_ages(members).select("place", "median_age", F.round("fit", 6).alias("fit"))


_TURNS = f"d AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn, role, text) AS text FROM conversations GROUP BY 1), w AS (SELECT conv_id, {_words('text')} AS w FROM d), g AS (SELECT conv_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w), e AS (SELECT conv_id, len(s) AS n, unnest(s) AS g FROM g)"


@query(f"""WITH {_TURNS}, k AS (SELECT a.conv_id AS id, b.conv_id AS other, count(*) AS k, any_value(a.n) AS n, any_value(b.n) AS m FROM e a JOIN e b ON a.g = b.g AND a.conv_id <> b.conv_id GROUP BY 1, 2), r AS (SELECT id, other, CAST(k / (n + m - k) AS FLOAT) AS score, row_number() OVER (PARTITION BY id ORDER BY CAST(k / (n + m - k) AS FLOAT) DESC, other) AS p FROM k)
    SELECT DISTINCT least(id, other) AS a, greatest(id, other) AS b, round(CAST(score AS DOUBLE), 5) AS score FROM r WHERE p = 1 ORDER BY score DESC, a, b LIMIT 5""")
def api_similarity(spark, d):
    turns = t(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    _, pairs = api.similarity_report(turns.select("conv_id", F.array_join(F.transform("x", lambda x: x["text"]), " ").alias("text")), "conv_id")
    return pairs.select("a", "b", F.round(F.col("score").cast("double"), 5).alias("score"))


@query(f"WITH {_JOBS}, s AS (SELECT DISTINCT session_id FROM j) SELECT session_id AS id, count(*) AS total, count(*) FILTER (status = 'done') AS done FROM s LEFT JOIN j USING (session_id) GROUP BY 1")
def api_sessions(spark, d):
    j = _jobs(spark, d)
    sessions = j.select(F.col("session_id").alias("id")).distinct().withColumn("created_at", F.col("id"))
    return api.sessions_report(sessions, j).select("id", "total", "done")


@query(f"WITH {_JOBS}, a AS (SELECT *, CASE WHEN id % 9 = 0 THEN 'e' END AS last_error FROM j) SELECT 'done' AS what, id FROM (SELECT id FROM a WHERE status = 'done' ORDER BY ts DESC, id DESC LIMIT 10) UNION ALL SELECT 'error', id FROM (SELECT id FROM a WHERE last_error IS NOT NULL ORDER BY ts DESC, id DESC LIMIT 10)")
def api_activity(spark, d):
    j = _jobs(spark, d).withColumns({"updated_at": F.col("ts"), "last_error": F.when(F.col("id") % 9 == 0, "e")})
    done, wrong = api.activity(j)
    return done.select(F.lit("done").alias("what"), "id").union(wrong.select(F.lit("error"), "id"))


# ---- joins, composition


@query("SELECT doc_id, verdict, key FROM (SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS verdict FROM labels) LEFT JOIN (SELECT doc_id, 'text:' || doc_id AS key FROM documents WHERE doc_id % 3 <> 0) USING (doc_id)")
def job_annotations(spark, d):
    """Marks with the key of the job that they are on; some jobs are gone."""
    marks = t(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("verdict"))
    jobs = t(spark, d, "documents").where("doc_id % 3 != 0").select("doc_id", F.concat(F.lit("text:"), "doc_id").alias("key"))
    return marks.join(jobs, "doc_id", "left")


@query("""WITH i AS (SELECT l_orderkey AS entity, 'r' || l_linenumber AS role, CASE WHEN l_linenumber > 1 THEN 'r1' END AS ref_role, any_value(['pending', 'done', 'dead'][l_orderkey % 3 + 1]) AS status FROM lineitem GROUP BY ALL), x AS (SELECT a.*, b.status AS base FROM i a LEFT JOIN i b ON b.entity = a.entity AND b.role = a.ref_role)
    SELECT entity, role, CASE WHEN ref_role IS NULL THEN 'alone' WHEN base = 'done' THEN 'ready' WHEN base IS NULL OR base = 'dead' THEN 'alone' ELSE 'wait' END AS step FROM x""")
def job_images_ready(spark, d):
    state = F.element_at(F.array(*map(F.lit, ["pending", "done", "dead"])), (F.col("l_orderkey") % 3 + 1).cast("int"))
    images = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("entity"), F.concat(F.lit("r"), F.col("l_linenumber").cast("string")).alias("role"), F.when(F.col("l_linenumber") > 1, "r1").alias("ref_role"), state.alias("status"), F.lit("x.png").alias("path")).distinct()
    return queue.images_ready(images).select("entity", "role", "step")


class _Painter:
    """Draws the hash of a prompt and of what it builds on; some it cannot."""

    def render(self, prompts_, bases):
        whole = [p.encode() + b"|" + (b or b"") for p, b in zip(prompts_, bases, strict=True)]
        return [None if p.startswith("face 7") else hashlib.md5(w).hexdigest().encode() for p, w in zip(prompts_, whole, strict=True)]


@query("""WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS entity, c_custkey AS k, 'face ' || c_custkey % 10 || ' ' || c_name AS face FROM customer),
    f AS (SELECT *, CASE WHEN k % 10 <> 7 THEN md5(face || '|') END AS f FROM c), s AS (SELECT *, md5('scene ' || entity || '|' || coalesce(f, '')) AS s FROM f), b AS (SELECT *, md5('badge ' || entity || '|' || s) AS b FROM s)
    SELECT entity, 'face' AS role, 'alone' AS step, f AS data, CASE WHEN f IS NULL THEN 'dead' ELSE 'done' END AS status FROM b UNION ALL SELECT entity, 'scene', CASE WHEN f IS NULL THEN 'alone' ELSE 'ready' END, s, 'done' FROM b
    UNION ALL SELECT entity, 'badge', 'ready', b, 'done' FROM b UNION ALL SELECT entity, 'lone', 'alone', md5('lone ' || entity || '|'), 'done' FROM b""")
def str_image_line(spark, d):
    """Images of customers in passes: a face, a scene with it, a badge with the scene, and one whose base was never asked for."""
    key = F.col("c_custkey").cast("string")
    asked = lambda role, prompt, ref: F.struct(F.lit(role).alias("role"), prompt.alias("prompt"), F.lit(ref).cast("string").alias("ref_role"))
    roles = [asked("face", F.concat(F.lit("face "), (F.col("c_custkey") % 10).cast("string"), F.lit(" "), F.col("c_name")), None), asked("scene", F.concat(F.lit("scene "), key), "face"), asked("badge", F.concat(F.lit("badge "), key), "scene"), asked("lone", F.concat(F.lit("lone "), key), "nothing")]
    requests = t(spark, d, "customer").select(key.alias("entity"), F.inline(F.array(*roles)))
    return engine.draw_images(requests, _Painter()).withColumn("data", F.decode("data", "utf-8"))


@query("""WITH x AS (SELECT 'place:' || s_suppkey AS place, 30 + s_suppkey % 40 AS median_age, 'region ' || s_nationkey % 5 AS region, ['low','middle','high'][s_suppkey % 3 + 1] AS segment, ['name' || s_suppkey % 97] AS surnames FROM supplier),
    c AS (SELECT 'person:' || c_custkey AS director, 25 + c_custkey % 45 AS age, 'region ' || c_nationkey % 5 AS home_region, c_custkey % 2 = 0 AS founder, 'name' || (c_custkey // 5) % 97 AS root FROM customer WHERE c_custkey % 5 = 4),
    s AS (SELECT place, director, round(0.5 + CASE WHEN region = home_region THEN 0.3 ELSE 0 END + CASE WHEN founder AND segment = 'high' THEN 0.2 ELSE 0 END, 6) AS score FROM x JOIN c ON age >= greatest(35, median_age - 8) AND NOT list_contains(surnames, root))
    SELECT place, director, score FROM s QUALIFY row_number() OVER (PARTITION BY place ORDER BY score DESC, director) = 1""")
def job_director(spark, d):
    """The best director of each team within bounds of age and without its names; each may lead several."""
    s = t(spark, d, "supplier")
    teams = s.select(F.concat(F.lit("place:"), "s_suppkey").alias("place"), (F.lit(30) + F.col("s_suppkey") % 40).alias("median_age"), F.concat(F.lit("region "), (F.col("s_nationkey") % 5).cast("string")).alias("region"), F.element_at(F.array(*map(F.lit, ["low", "middle", "high"])), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("segment"), F.array(F.concat(F.lit("name"), (F.col("s_suppkey") % 97).cast("string"))).alias("surnames"))
    return compose.directors_for(teams, _pools(spark, d)[3], _COMPOSE).select("place", "director", F.round("score", 6).alias("score"))


@query("WITH p AS (SELECT s_suppkey AS place, row_number() OVER (ORDER BY md5('5|' || s_suppkey)) AS n FROM supplier), f AS (SELECT c_name AS name, row_number() OVER (ORDER BY md5('5|' || c_name), c_name) AS n FROM customer WHERE c_custkey % 9 <> 0) SELECT place, name FROM p JOIN f USING (n)")
def cmp_names(spark, d):
    """Free names in seeded order for places in seeded order."""
    c = t(spark, d, "customer")
    taken = c.where("c_custkey % 9 = 0").select(F.concat(F.lit("name:"), "c_name").alias("key"))
    return compose.assign_names(t(spark, d, "supplier").select(F.col("s_suppkey").alias("place")), c.select(F.col("c_name").alias("name")), 5, taken)


@query("""SELECT p_partkey, months, CASE WHEN f IS NOT NULL THEN CAST(round(x / step) * step AS BIGINT) END AS price FROM (SELECT *, CASE WHEN x >= 50000 THEN 5000 WHEN x >= 10000 THEN 1000 ELSE 100 END AS step FROM
    (SELECT p_partkey, [1.0, 1.5, 2.0, 3.0, 6.0, 4.0][p_partkey % 6 + 1]::DOUBLE AS months, [1.0, 1.5, 2.0, 3.0, 6.0, NULL][p_partkey % 6 + 1]::DOUBLE AS f, CAST(p_retailprice * 20 AS BIGINT) * [1.0, 1.5, 2.0, 3.0, 6.0, NULL][p_partkey % 6 + 1]::DOUBLE AS x FROM part))""")
def cmp_course(spark, d):
    months = F.element_at(F.array(*[F.lit(x) for x in (1.0, 1.5, 2.0, 3.0, 6.0, 4.0)]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return t(spark, d, "part").select("p_partkey", months.alias("months"), compose.course_price(F.round(F.col("p_retailprice") * 20).cast("long"), months).alias("price"))


@query("SELECT o_custkey AS place, bool_or(o_orderpriority IN ('1-URGENT', '2-HIGH')) AS always FROM orders GROUP BY 1")
def cmp_round_the_clock(spark, d):
    return t(spark, d, "orders").groupBy(F.col("o_custkey").alias("place")).agg(compose.round_the_clock(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"]).alias("always"))


def _centres(spark, d):
    """Centres by arithmetic, for what is made of them."""
    k = F.col("s_suppkey")
    person = lambda n: F.concat(F.lit("person:"), (k * 5 % 150 + n).cast("string"))
    return t(spark, d, "supplier").select(F.concat(F.lit("place:"), k).alias("place"), F.concat(F.lit("program:"), k).alias("program"), person(4).alias("director"), F.array(person(0), person(5)).alias("doctors"), F.array(person(1)).alias("psychologists"), F.array(person(2), person(3)).alias("consultants"), F.lit("low").alias("segment"), F.lit("both").alias("focus"), F.lit(0.5).alias("fit"), F.lit(2000).alias("founded_year"), F.lit("").alias("short"))


_PERSON = "SELECT 'person:' || c_custkey AS key, 'Name' || (c_custkey // 5) % 97 || ' ' || c_name AS full_name, c_mktsegment AS does, c_custkey FROM customer"


@query(f"""WITH p AS ({_PERSON}), c AS (SELECT s_suppkey AS k, s_suppkey * 5 % 150 AS b, s_nationkey FROM supplier), w AS (SELECT key, full_name || ' (' || does || ')' AS who, full_name FROM p)
    SELECT 'place:' || k AS place, 'region ' || s_nationkey % 5 AS region, 12 + k % 17 AS capacity, x.p_name AS program_title, l.full_name AS director_name, (b + 4) % 20 AS director_leading_years,
      concat_ws('. ', 'doctors: ' || concat_ws('; ', d1.who, d2.who), 'psychologists: ' || p1.who, 'consultants: ' || concat_ws('; ', c1.who, c2.who)) AS team,
      ['the house', 'the people', 'a day'][(('0x' || substr(md5('opening|place:' || k), 1, 8))::BIGINT % 3) + 1] AS opening, 5 AS n_staff
    FROM c JOIN part x ON x.p_partkey = k JOIN w l ON l.key = 'person:' || (b + 4) JOIN w d1 ON d1.key = 'person:' || b JOIN w d2 ON d2.key = 'person:' || (b + 5) JOIN w p1 ON p1.key = 'person:' || (b + 1) JOIN w c1 ON c1.key = 'person:' || (b + 2) JOIN w c2 ON c2.key = 'person:' || (b + 3)""")
def cmp_centre_rows(spark, d):
    places, programs, people, directors = _pools(spark, d)
    everybody = people.select("key", "role", "full_name", "does").unionByName(directors.select("key", F.lit("director").alias("role"), "full_name", F.lit("").alias("does")))
    out = compose.centre_rows(_centres(spark, d), places, programs, everybody, directors, ["the house", "the people", "a day"])
    return out.select("place", "region", "capacity", "program_title", "director_name", "director_leading_years", "team", "opening", F.size("staff_keys").alias("n_staff"))


@query("WITH c AS (SELECT s_suppkey AS k, s_suppkey * 5 % 150 AS b, s_name FROM supplier) SELECT DISTINCT unnest(['place:' || k, 'program:' || k, 'name:' || s_name, 'person:' || b, 'person:' || (b + 1), 'person:' || (b + 2), 'person:' || (b + 3), 'person:' || (b + 4), 'person:' || (b + 5)]) AS key FROM c")
def cmp_reserved(spark, d):
    names = t(spark, d, "supplier").select(F.concat(F.lit("place:"), "s_suppkey").alias("place"), "s_name")
    return compose.reserved(_centres(spark, d).join(names, "place"), "s_name")


# ---- texts


@query("SELECT c_custkey, c_name || 'ov Petr Ilich' || ' came. ' || 'Petr Ilich' || ' left.' AS first, 'Petr Ilich' || ' wrote.' AS second, 'no name' AS third FROM customer")
def txt_repair_name(spark, d):
    """The full name stays at its first place over all fields."""
    full = F.concat("c_name", F.lit("ov Petr Ilich"))
    c = t(spark, d, "customer").select("c_custkey", full.alias("full"), F.concat(full, F.lit(" came. "), full, F.lit(" left.")).alias("a"), F.concat(full, F.lit(" wrote.")).alias("b"))
    out = T.short_after_first([F.col("a"), F.col("b"), F.lit("no name")], F.col("full"))
    return c.select("c_custkey", out[0].alias("first"), out[1].alias("second"), out[2].alias("third"))


@query("SELECT c_custkey, ['Сергеева', 'Сергеевой', 'Сергеева', 'Сергеевна', 'Сережа', 'Наташа', 'Сергеева,'][c_custkey % 7 + 1] || ' тут' AS text FROM customer")
def txt_repair_surname(spark, d):
    """Misspelt forms are mended; cases, the father's name and other words are left."""
    said = F.element_at(F.array(*map(F.lit, ["Сергеева", "Сергеевой", "Сергейева", "Сергеевна", "Сережа", "Наташа", "Сергеаева,"])), (F.col("c_custkey") % 7 + 1).cast("int"))
    c = t(spark, d, "customer").select("c_custkey", F.concat(said, F.lit(" тут")).alias("said"))
    return c.select("c_custkey", T.repaired_surname(F.col("said"), F.lit("Сергеева Наталья Ивановна")).alias("text"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'long' WHEN 2 THEN 'banned best' WHEN 3 THEN 'digits' END AS fault, p_partkey % 2 = 0 AS named, lower(regexp_replace(p_brand, '#.*', '')) AS unfenced FROM part""")
def txt_centre_checks(spark, d):
    k = F.col("p_partkey")
    name = F.element_at(F.array(*map(F.lit, [" ", "a b c d", "the Best one", "house 7", "quiet shore"])), (k % 5 + 1).cast("int"))
    about = F.when(k % 2 == 0, F.concat(F.lit("led by Stone, "), "p_name")).otherwise(F.lit("led by somebody"))
    fenced = F.concat(F.lit("```json\n"), F.lower(F.regexp_replace("p_brand", "#.*", "")), F.lit("\n```"))
    return t(spark, d, "part").select(k, T.name_fault(name, ["best"]).alias("fault"), T.named(F.lit("Stone"), [about, F.lit("no")]).alias("named"), T.unfenced(fenced).alias("unfenced"))


_BASE = f"""w AS (SELECT doc_id, {_words('text')} AS w FROM documents), g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
    e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM g)"""


@query(f"""WITH {_BASE}, k AS (SELECT a.doc_id AS id, b.doc_id AS other, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k FROM e a JOIN e b ON a.g = b.g WHERE a.doc_id % 2 = 0 AND b.doc_id % 2 = 1 GROUP BY 1, 2),
    s AS (SELECT id, other, CAST(k / (n + m - k) AS FLOAT) AS score FROM k WHERE CAST(k / (n + m - k) AS FLOAT) > CAST(0.5 AS FLOAT)) SELECT id, round(CAST(max(score) AS DOUBLE), 5) AS score FROM s GROUP BY 1""")
def txt_too_close(spark, d):
    """New texts, those of even ids, against a base of accepted ones, the rest: how near the nearest over the threshold is."""
    s = similarity.sets(t(spark, d, "documents"), written=False)
    return similarity.too_close(s.where("id % 2 = 0"), s.where("id % 2 = 1"), 0.5).select("id", F.round(F.col("score").cast("double"), 5).alias("score"))


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'белий' WHEN 1 THEN 'морозов' WHEN 2 THEN 'морозов' ELSE 'кос' END AS root, replace(format('{:,}', CAST(abs(s_acctbal) * 100 AS BIGINT)), ',', ' ') AS grouped, regexp_replace(s_name, '[^A-Za-z0-9_.#-]', '_', 'g') AS safe, 'aa bb|cccccc|d e' AS wrapped FROM supplier""".replace("#-]", "-]"))
def prj_text_scalars(spark, d):
    k = F.col("s_suppkey")
    name = F.element_at(F.array(*map(F.lit, ["Белая", "Морозова", "Морозов", "Кос"])), (k % 4 + 1).cast("int"))
    return t(spark, d, "supplier").select(k, T.surname_root(name).alias("root"), T.grouped_thousands(F.round(F.abs("s_acctbal") * 100).cast("long")).alias("grouped"), T.safe_key(F.col("s_name")).alias("safe"), F.array_join(T.wrapped(F.lit("aa bb cccccc d  e"), 6), "|").alias("wrapped"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity = floor(l_quantity) AND l_quantity <> 0 AS BOOLEAN) AS truthy, CASE WHEN l_quantity = floor(l_quantity) THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE printf('%.2f', l_quantity) END AS shown, CASE WHEN l_returnflag = 'R' THEN 'да' ELSE 'нет' END AS flag, l_linenumber = 0 OR l_linenumber IS NULL AS absent FROM lineitem".replace("CAST(l_quantity = floor(l_quantity) AND l_quantity <> 0 AS BOOLEAN)", "l_quantity <> 0"))
def expr_values(spark, d):
    li = t(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", rules.truthy(F.col("l_quantity"), rules.NUMBER).alias("truthy"), rules.rendered(F.col("l_quantity"), rules.NUMBER).alias("shown"), rules.rendered(F.col("l_returnflag") == "R", rules.BOOL).alias("flag"), rules.absent(F.col("l_linenumber"), rules.NUMBER).alias("absent"))


# ---- queues


@query("""WITH l AS (SELECT event_id AS id, user_id AS batch_id, ['pending', 'inflight', 'unknown', 'committed', 'failed'][event_id % 5 + 1] AS status FROM events) SELECT batch_id, max_by(status, id) AS status, count(*) FILTER (status = 'inflight') AS attempts, max_by(status, id) IN ('unknown', 'inflight') AS open FROM l GROUP BY 1""")
def str_ledger(spark, d):
    state = F.element_at(F.array(*map(F.lit, ["pending", "inflight", "unknown", "committed", "failed"])), (F.col("event_id") % 5 + 1).cast("int"))
    entries = t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("batch_id"), F.lit("c").alias("collection"), F.lit(1).alias("expected"), state.alias("status"), F.lit(None).cast("string").alias("error"))
    now = queue.ledger(entries)
    return now.join(queue.unresolved(now).select("batch_id", F.lit(True).alias("open")), "batch_id", "left").select("batch_id", "status", "attempts", F.coalesce("open", F.lit(False)).alias("open"))


@query("""WITH l AS (SELECT o_custkey AS batch_id, count(*) AS expected, count(*) FILTER (o_orderkey % 3 <> 0) AS found FROM orders GROUP BY 1), v AS (SELECT batch_id, CASE WHEN found = expected THEN 'committed' WHEN found = 0 THEN 'absent' ELSE 'partial' END AS verdict FROM l)
    SELECT o_orderkey AS id, CASE WHEN verdict = 'committed' THEN o_custkey END AS batch_id, verdict = 'partial' AS deleted, CASE WHEN verdict = 'committed' THEN 'committed' ELSE 'failed' END AS next FROM orders JOIN v ON batch_id = o_custkey""")
def str_requeue(spark, d):
    """What did not land whole is rolled back: its jobs have no batch any more."""
    o = t(spark, d, "orders").select(F.lit("c").alias("collection"), F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("id"))
    ledger = o.groupBy("collection", "batch_id").agg(F.count("*").alias("expected"))
    verdicts = queue.resolution(queue.reconcile(ledger, o.where("id % 3 != 0")))
    jobs = queue.detached(o, verdicts.where("detach")).select("id", "batch_id")
    return jobs.join(o.select("id", F.col("batch_id").alias("was")), "id").join(verdicts.select(F.col("batch_id").alias("was"), F.col("delete").alias("deleted"), "next"), "was").select("id", "batch_id", "deleted", "next")


@query(f"WITH {_JOBS} SELECT session_id, id, (row_number() OVER (PARTITION BY session_id ORDER BY id) - 1) // 4 AS chunk FROM j WHERE status = 'running'")
def str_chunks(spark, d):
    return queue.chunks(_jobs(spark, d).where("status = 'running'")).select("session_id", "id", "chunk")


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'paused' WHEN event_id % 11 = 0 THEN 'failed' WHEN value >= 50 THEN 'paused' WHEN event_id % 3 = 0 THEN 'done' ELSE 'running' END AS status FROM events")
def str_next_state(spark, d):
    k = F.col("event_id")
    return t(spark, d, "events").select(k, queue.next_state(F.when(k % 7 == 0, "paused").otherwise("running"), F.col("value"), F.lit(50.0), k % 11 == 0, k % 3 == 0).alias("status"))


@query("""WITH c AS (SELECT event_id, [200, 401, 403, 429, 500, 503, 400][event_id % 7 + 1] AS status, ['', 'Region not supported', 'insufficient funds', 'x'][event_id % 4 + 1] AS body, event_id % 2 = 0 AS safe FROM events),
    k AS (SELECT *, CASE WHEN body LIKE 'Region%' THEN 'region' WHEN body LIKE 'insufficient%' THEN 'quota' WHEN status = 429 THEN 'rate' WHEN status >= 500 THEN 'server' WHEN status IN (401, 403) THEN 'credentials' ELSE 'other' END AS kind FROM c)
    SELECT event_id, kind, kind = 'rate' OR (kind = 'server' AND safe) AS retried, least(30.0::DOUBLE, 0.5 * pow(2, event_id % 9)) AS wait FROM k""")
def str_error_class(spark, d):
    k = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, [200, 401, 403, 429, 500, 503, 400])), (k % 7 + 1).cast("int"))
    body = F.element_at(F.array(*map(F.lit, ["", "Region not supported", "insufficient funds", "x"])), (k % 4 + 1).cast("int"))
    kind = queue.error_class(status, body)
    return t(spark, d, "events").select(k, kind.alias("kind"), queue.retried(kind, k % 2 == 0).alias("retried"), queue.backoff(k % 9).alias("wait"))
