"""All queries of the library over the driver's tables, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .functions import rules
from .functions import text as T
from .operators import acceptance, compose, nearest, profiles, prompts, queue, sampling, similarity
from .operators.lineage import folder
from .plans import dictionary
from .sources import records
from .streaming import unique

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


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- texts

_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP) + "]"


def _words(text: str) -> str:
    return rf"list_filter(string_split_regex(replace(lower(coalesce({text}, '')), 'ё', 'е'), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '' AND NOT list_contains({_STOP}, x))"


def _grams(w: str) -> str:
    return f"list_distinct(CASE WHEN len({w}) >= 3 THEN list_transform(range(1, len({w}) - 1), lambda i: {w}[i] || ' ' || {w}[i + 1] || ' ' || {w}[i + 2]) WHEN len({w}) > 0 THEN [array_to_string({w}, ' ')] ELSE [] END)"


_SETS = f"w AS (SELECT doc_id, {_words('text')} AS w FROM documents), g AS (SELECT doc_id, {_grams('w')} AS s FROM w), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM g)"


@query(f"WITH w AS (SELECT doc_id, {_words('text')} AS w FROM documents) SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct FROM w")
def txt_tokens(spark, d):
    w = t(spark, d, "documents").select("doc_id", T.words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@query(f"WITH {_SETS} SELECT doc_id, len(s) AS n_shingles FROM g")
def txt_shingle_count(spark, d):
    return similarity.sets(t(spark, d, "documents")).select(F.col("id").alias("doc_id"), F.size("s").cast("long").alias("n_shingles"))


@query(f"""WITH {_SETS}, c AS (SELECT min(doc_id) AS id, count(*) AS copies, any_value(s) AS s FROM g WHERE len(s) > 0 GROUP BY list_sort(s)),
    x AS (SELECT id, copies, len(s) AS n, unnest(s) AS g FROM c),
    p AS (SELECT a.id AS a, b.id AS b, a.copies AS copies_a, b.copies AS copies_b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
    SELECT a, b, copies_a, copies_b, round(k / (n + m - k), 6) AS score FROM p WHERE CAST(k / (n + m - k) AS FLOAT) > CAST(0.5 AS FLOAT)""")
def txt_near_dup_pairs(spark, d):
    pairs = similarity.near_pairs(similarity.sets(t(spark, d, "documents"), written=False), 0.5)
    return pairs.select("a", "b", "copies_a", "copies_b", F.round(F.col("score").cast("double"), 6).alias("score"))


@query(f"""WITH {_SETS}, v AS (SELECT item_id, {_words('text')} AS w FROM benchmark), i AS (SELECT item_id, {_grams('w')} AS s FROM v), j AS (SELECT item_id, len(s) AS n, unnest(s) AS g FROM i),
    k AS (SELECT j.item_id AS part, e.doc_id AS whole, count(*) AS k, any_value(j.n) AS n FROM j JOIN e USING (g) GROUP BY 1, 2)
    SELECT part, whole, round(k / n, 5) AS share FROM k WHERE CAST(k / n AS FLOAT) >= CAST(0.5 AS FLOAT)""")
def txt_containment_vs_benchmark(spark, d):
    found = similarity.contained(similarity.sets(t(spark, d, "benchmark"), "item_id"), similarity.sets(t(spark, d, "documents")), 0.5)
    return found.select("part", "whole", F.round(F.col("share").cast("double"), 5).alias("share"))


_NEAREST = f"""{_SETS}, k AS (SELECT a.doc_id AS id, b.doc_id AS other, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id WHERE a.doc_id % 20 = 0 GROUP BY 1, 2),
    s AS (SELECT id, other, CAST(k / (n + m - k) AS FLOAT) AS score FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS rank FROM s)"""


def _nearest(spark, d, k):
    """Queries are the rows whose id is divisible by 20, against all rows."""
    s = similarity.sets(t(spark, d, "documents"))
    return similarity.neighbours(s.where("id % 20 = 0"), s, k)


@query(f"WITH {_NEAREST} SELECT id, other, rank, round(CAST(score AS DOUBLE), 5) AS score FROM r WHERE rank <= 3")
def txt_nearest_k(spark, d):
    return _nearest(spark, d, 3).select("id", "other", F.col("rank").cast("long"), F.round(F.col("score").cast("double"), 5).alias("score"))


@query(f"WITH {_NEAREST} SELECT id, other, rank, round(CAST(score AS DOUBLE), 5) AS score FROM r WHERE rank <= 3")
def txt_index_nearest(spark, d):
    """The same from an index that was built on half of the rows and grew by the rest."""
    s = similarity.sets(t(spark, d, "documents"), written=False)
    index = nearest.SetIndex(spark, folder(spark, "sets"))
    for some in ("id % 2 = 0", "id % 4 = 1", "id % 8 = 3", "id % 8 = 7"):
        index.insert(s.where(some))
    found = nearest.SetIndex(spark, index.path).nearest(s.where("id % 20 = 0"), 3)
    return found.select("id", "other", F.col("rank").cast("long"), F.round(F.col("score").cast("double"), 5).alias("score"))


@query(f"WITH {_NEAREST}, o AS (SELECT CAST(score AS DOUBLE) AS x, row_number() OVER (ORDER BY score) AS i, count(*) OVER () AS n FROM r WHERE rank = 1) SELECT max(n) AS n, round(avg(x), 5) AS mean, round(max(x) FILTER (i = n // 2 + 1), 5) AS median, round(max(x), 5) AS max FROM o")
def txt_similarity_summary(spark, d):
    out = similarity.summary(_nearest(spark, d, 1), F.col("score"))
    return out.select("n", *[F.round(c, 5).alias(c) for c in ("mean", "median", "max")])


#: Only ids with an edge to a smaller one can fall: those with an edge to an id that has none fall at once, the rest are taken in order.
@query(f"""WITH RECURSIVE {_SETS}, p AS (SELECT b.doc_id AS id, a.doc_id AS other, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    c AS MATERIALIZED (SELECT id, other FROM p WHERE CAST(k / (n + m - k) AS FLOAT) > CAST(0.5 AS FLOAT)),
    x AS MATERIALIZED (SELECT DISTINCT id FROM c WHERE other NOT IN (SELECT id FROM c)),
    o AS MATERIALIZED (SELECT id, list(other) AS before, row_number() OVER (ORDER BY id) AS k FROM c WHERE id NOT IN (SELECT id FROM x) GROUP BY 1),
    r AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS stand UNION ALL SELECT o.k, CASE WHEN list_has_any(stand, before) THEN stand ELSE list_append(stand, id) END FROM r JOIN o ON o.k = r.k + 1)
    SELECT doc_id AS id, doc_id NOT IN (SELECT id FROM c) OR list_contains((SELECT stand FROM r ORDER BY k DESC LIMIT 1), doc_id) AS accepted FROM documents""")
def txt_unique_greedy(spark, d):
    s = similarity.sets(t(spark, d, "documents"), written=False)
    return similarity.unique(s, 0.5)


@query(ORACLES["txt_unique_greedy"])
def str_unique_stream(spark, d):
    """The same decisions, of texts that arrive as a stream, a quarter of them at a time."""
    docs, path = t(spark, d, "documents").select("doc_id", "text"), folder(spark, "unique")
    least, most = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    step = ((most or 0) - (least or 0)) // 4 + 1
    for k in range(4):
        docs.where(F.col("doc_id").between((least or 0) + k * step, (least or 0) + (k + 1) * step - 1)).coalesce(1).write.mode("append").parquet(f"{path}/arrived")
    arrived = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/arrived")
    unique.unique(arrived, f"{path}/out", 0.5, "doc_id").trigger(availableNow=True).start().awaitTermination()
    return unique.accepted(spark, f"{path}/out")


@query(r"""WITH y AS (SELECT page_id, list_sort(list_distinct(list_filter(list_transform(list_filter(string_split_regex(coalesce(html, ''), '[^\p{L}\p{N}]+'), lambda x: regexp_full_match(x, '[0-9]{4}')), lambda x: CAST(x AS INT)), lambda v: v BETWEEN 1900 AND 2100))) AS y FROM pages)
    SELECT page_id, len(y) AS n_years, array_to_string(y, ',') AS years FROM y""")
def txt_calendar_years(spark, d):
    y = t(spark, d, "pages").select("page_id", T.calendar_years(F.col("html")).alias("y"))
    return y.select("page_id", F.size("y").cast("long").alias("n_years"), F.array_join(F.col("y").cast("array<string>"), ",").alias("years"))


_VALUE = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in T.NUMBER_WORDS.items()) + "}"
_YEAR = "[" + ", ".join(f"'{w}'" for w in T.YEAR_WORDS) + "]"
_AT = "[" + ", ".join(f"'{w}'" for w in T.AT_WORDS) + "]"
#: What of a token list w is claimed: tens take a following unit, which then claims nothing itself; neighbours that are equal are one claim.
_CLAIMS = f"""m AS (SELECT *, {_VALUE} AS v FROM w),
    k AS (SELECT *, list_transform(w, lambda x, i: list_has_any(w[i + 1:i + 3], {_YEAR})) AS marked,
      list_transform(w, lambda x, i: coalesce(v[x] >= 20 AND v[w[i + 1]] < 10, false)) AS joins FROM m),
    c AS (SELECT *, list_filter(list_transform(w, lambda x, i: CASE WHEN NOT marked[i] OR (i > 1 AND marked[i - 1] AND joins[i - 1]) THEN NULL
      WHEN regexp_full_match(x, '[0-9]{{1,9}}') THEN CASE WHEN CAST(x AS INT) BETWEEN 1900 AND 2100 THEN NULL ELSE CAST(CAST(x AS INT) AS VARCHAR) || CASE WHEN i > 1 AND list_contains({_AT}, w[i - 1]) THEN '@' ELSE '' END END
      WHEN v[x] IS NOT NULL THEN CAST(v[x] + CASE WHEN joins[i] THEN v[w[i + 1]] ELSE 0 END AS VARCHAR) || CASE WHEN i > 1 AND list_contains({_AT}, w[i - 1]) THEN '@' ELSE '' END END), lambda x: x IS NOT NULL) AS c FROM k),
    u AS (SELECT *, list_filter(c, lambda x, i: i = 1 OR x <> c[i - 1]) AS claims FROM c)"""


def _claim_texts(spark, d):
    """Sentences of years, with numbers as digits and words, ages, calendar years and repeated claims."""
    k = F.col("o_orderkey")
    pick = lambda by, *xs: F.element_at(F.array(*map(F.lit, xs)), (by % len(xs) + 1).cast("int"))
    text = F.concat_ws(" ", F.lit("at"), (k % 60).cast("string"), F.lit("years, and after"), pick(k, "twenty", "пятьдесят", "двенадцать", "sixteen"), pick(F.floor(k / 3), "three", "old", "пять", "лет"), F.lit("long years in"), F.year("o_orderdate").cast("string"), F.lit("for a year. С"), pick(F.floor(k / 7), "девятнадцати", "двадцатью", "сорока", "один"), pick(k, "лет", "двух года", "год год", "годами"))
    return t(spark, d, "orders").select(k, F.filter(F.split(F.lower(text), T.SPLIT), lambda x: x != "").alias("w"))


_CLAIM_TEXTS = r"""w AS (SELECT o_orderkey, list_filter(string_split_regex(lower(concat_ws(' ', 'at', o_orderkey % 60, 'years, and after', ['twenty', 'пятьдесят', 'двенадцать', 'sixteen'][o_orderkey % 4 + 1], ['three', 'old', 'пять', 'лет'][(o_orderkey // 3) % 4 + 1],
    'long years in', year(o_orderdate), 'for a year. С', ['девятнадцати', 'двадцатью', 'сорока', 'один'][(o_orderkey // 7) % 4 + 1], ['лет', 'двух года', 'год год', 'годами'][o_orderkey % 4 + 1])), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM orders)"""


@query(f"WITH {_CLAIM_TEXTS}, {_CLAIMS} SELECT o_orderkey, len(claims) AS n_claims, array_to_string(claims, ',') AS claims FROM u")
def txt_year_claims(spark, d):
    claims = _claim_texts(spark, d).select("o_orderkey", T.year_claims(F.col("w")).alias("c"))
    return claims.select("o_orderkey", F.size("c").cast("long").alias("n_claims"), F.array_join(F.transform("c", lambda x: F.concat(x["n"].cast("string"), F.when(x["at_age"], "@").otherwise(""))), ",").alias("claims"))


@query(f"""WITH {_CLAIM_TEXTS}, {_CLAIMS}, n AS (SELECT o_orderkey, o_orderkey % 40 + 20 AS age, o_orderkey % 13 AS span, claims, list_transform(claims, lambda x: CAST(replace(x, '@', '') AS INT)) AS y FROM u)
    SELECT o_orderkey, array_to_string(list_sort(list_distinct(y)), ',') AS years,
      len(list_filter(list_zip(claims, y), lambda p: NOT ((p[2] > 0 AND p[2] <= span) OR p[2] BETWEEN age - span AND age OR (p[1] LIKE '%@' AND p[2] BETWEEN 18 AND age)))) = 0 AS explained FROM n""")
def txt_explained(spark, d):
    c = _claim_texts(spark, d).select("o_orderkey", T.year_claims(F.col("w")).alias("c"))
    age, span = F.col("o_orderkey") % 40 + 20, F.col("o_orderkey") % 13
    return c.select("o_orderkey", F.array_join(T.claimed_years(F.col("c")).cast("array<string>"), ",").alias("years"), T.explained(F.col("c"), age, F.array(span), F.lit(18)).alias("explained"))


_BANNED = ["stupid", "idiot", "pathetic", "disgusting", "scum"]


@query(f"""WITH f AS (SELECT doc_id, CASE {' '.join(f"WHEN contains(lower(text), '{b}') THEN '{b}'" for b in _BANNED)} END AS banned, regexp_extract(text, '(?:^|[^\\p{{L}}\\p{{N}}])([A-Za-z]{{3,}})(?:[^\\p{{L}}\\p{{N}}]|$)', 1) AS f, length(text) AS n FROM documents)
    SELECT doc_id, banned, nullif(f, '') AS foreign_word, CASE WHEN trim(coalesce(n, 0)::VARCHAR) = '0' THEN 'missing' WHEN n < 200 THEN 'short' WHEN banned IS NOT NULL THEN 'banned ' || banned END AS reason FROM f""")
def txt_reject_reason(spark, d):
    x = F.col("text")
    f = t(spark, d, "documents").select("doc_id", T.first_banned(x, _BANNED).alias("banned"), T.foreign_word(x).alias("foreign_word"), F.char_length(x).alias("n"))
    reason = F.when(F.coalesce("n", F.lit(0)) == 0, "missing").when(F.col("n") < 200, "short").when(F.col("banned").isNotNull(), F.concat(F.lit("banned "), "banned"))
    return f.select("doc_id", "banned", "foreign_word", reason.alias("reason"))


_DEFECTS = ["none", "parse", "short", "missing", "overlap", "banned", "foreign", "echo", "years", "lifetime"]
_BODY = "Она училась долго и потом нашла работу у моря, где лечила людей и писала письма о тихих днях"
_PATH = "Сначала был завод, потом школа на окраине, курсы вечером, первая группа и наставник из соседнего города"


#: Of two defects the test that comes first speaks; the order is that of _DEFECTS.
_ORDER = "[" + ", ".join(f"'{x}'" for x in _DEFECTS) + "]"


@query(f"""WITH p AS (SELECT p_partkey, {_ORDER} AS o, p_partkey % 10 + 1 AS a, p_partkey // 10 % 10 + 1 AS b FROM part), d AS (SELECT p_partkey, o[CASE WHEN a = 1 THEN b WHEN b = 1 THEN a ELSE least(a, b) END] AS defect FROM p)
    SELECT p_partkey, CASE WHEN defect = 'parse' THEN 'not_structured' WHEN defect = 'missing' THEN 'missing_field' WHEN defect = 'short' THEN 'too_short' WHEN defect IN ('overlap', 'banned', 'foreign') THEN 'forbidden' WHEN defect IN ('echo', 'years', 'lifetime') THEN 'fact_drift' END AS reject_kind,
      CASE defect WHEN 'parse' THEN 'unparsed' WHEN 'missing' THEN 'missing professional_path' WHEN 'short' THEN 'short biography' WHEN 'overlap' THEN 'overlap biography professional_path' WHEN 'banned' THEN 'banned лучший центр'
        WHEN 'foreign' THEN 'foreign predictability' WHEN 'echo' THEN 'echo stated_age' WHEN 'years' THEN 'unexplained years' WHEN 'lifetime' THEN 'year out of lifetime' END AS reject_reason FROM d""")
def txt_accept_chain(spark, d):
    """Answers with up to two defects, by the digits of the part's key."""
    defect = lambda k: F.element_at(F.array(*map(F.lit, _DEFECTS)), (k % 10 + 1).cast("int"))
    keys = t(spark, d, "part").select("p_partkey").repartition(4 * spark.sparkContext.defaultParallelism)  # keys are few bytes in few files; what is made of them is much work
    p = keys.withColumn("defects", F.array(defect(F.col("p_partkey")), defect(F.floor(F.col("p_partkey") / 10))))
    is_ = lambda name: F.array_contains("defects", name)
    ends = [("banned", ". Это Лучший центр"), ("foreign", " и predictability"), ("years", ". Здесь двадцать пять лет подряд"), ("lifetime", ". В 1931 приехала")]
    said = F.concat(*[F.when(is_(name), end).otherwise("") for name, end in ends])
    bio = F.concat(F.when(is_("short"), "Кратко").otherwise(_BODY), F.when((said == "") & ~is_("short"), ". Здесь пять лет").otherwise(said))
    path = F.when(is_("missing"), F.lit(None).cast("string")).when(is_("overlap"), F.lit(_BODY)).otherwise(F.lit(_PATH))
    age = F.when(is_("echo"), "41").otherwise("40")
    body = F.when(is_("parse"), "no object").otherwise(F.concat(F.lit("```json\n"), F.to_json(F.struct(bio.alias("biography"), path.alias("professional_path"), age.alias("stated_age"))), F.lit("\n```")))
    policy = acceptance.Policy({"biography": 40, "professional_path": 40}, ["лучший центр"], {"stated_age": "age"}, ["years"], age="age")
    return acceptance.judged(p.select("p_partkey", body.alias("answer"), F.lit(40).alias("age"), F.lit(7).alias("years")), policy).select("p_partkey", "reject_kind", "reject_reason")


@query("SELECT p_partkey, levenshtein(p_name, p_type) AS distance FROM part")
def txt_levenshtein(spark, d):
    return t(spark, d, "part").select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("distance"))


# ---- rules

_RULES = [("dear", "total > 100000 or has(priority, '1-URGENT')"), ("open_and_late", "not (status == 'F') and year >= 1997"), ("ratio", "total / (year - 1995) > 50000"), ("null_not", "not (nothing + 1 > 2)"), ("null_cmp", "not (nothing > 2)"), ("nulls", "nothing == null and total != null"), ("flags", "1 + late >= 2"), ("among", "in(priority, '1-URGENT', '2-HIGH') and in(year, '1996', 1997)")]


def _order_rows(spark, d):
    o = t(spark, d, "orders")
    year = F.when(F.col("o_orderkey") % 11 != 0, F.year("o_orderdate"))
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("total"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), year.alias("year"), (F.year("o_orderdate") > 1996).alias("late"))


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS total, o_orderstatus AS status, o_orderpriority AS priority, CASE WHEN o_orderkey % 11 <> 0 THEN year(o_orderdate) END AS year, year(o_orderdate) > 1996 AS late FROM orders)
    SELECT o_orderkey, coalesce(total > 100000, false) OR coalesce(priority = '1-URGENT', false) AS dear, status IS DISTINCT FROM 'F' AND coalesce(year >= 1997, false) AS open_and_late,
      coalesce(total / nullif(year - 1995, 0) > 50000, false) AS ratio, false AS null_not, true AS null_cmp, total IS NOT NULL AS nulls, late AS flags,
      coalesce(priority IN ('1-URGENT', '2-HIGH'), false) AND coalesce(year IN (1996, 1997), false) AS among FROM o""")
def expr_truth_table(spark, d):
    rows = _order_rows(spark, d)
    kinds = rules.kinds_of(rows)
    return rows.select("o_orderkey", *[rules.holds(r, kinds).alias(n) for n, r in _RULES])


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN NOT l_quantity <= 45 THEN 'quantity' WHEN NOT (l_discount < 0.08 OR l_quantity > 10) THEN 'discount' WHEN NOT (l_returnflag <> 'R' OR l_tax < 0.07) THEN 'returned' END AS violated FROM lineitem""")
def expr_hard_rules(spark, d):
    li = t(spark, d, "lineitem")
    hard = [("quantity", "l_quantity <= 45"), ("discount", "l_discount < 0.08 or l_quantity > 10"), ("returned", "l_returnflag != 'R' or l_tax < 0.07")]
    return li.select("l_orderkey", "l_linenumber", rules.first_violated(hard, rules.kinds_of(li)).alias("violated"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem
    WHERE l_quantity <= 10 AND l_returnflag <> 'N' AND l_linenumber IN (1, 2, 3) AND (l_discount >= 0.05 OR l_tax < 0.02) AND l_extendedprice / nullif(l_quantity - 3, 0) > 1500""")
def expr_filter(spark, d):
    """Rows by a rule, of which all but the division is left to the scan."""
    rule = "l_quantity <= 10 and l_returnflag != 'N' and 3 >= l_linenumber and (l_discount >= 0.05 or l_tax < 0.02) and l_extendedprice / (l_quantity - 3) > 1500"
    return rules.keep(t(spark, d, "lineitem"), rule).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


# ---- sampling

_DICTIONARY = """{"params": [
 {"key": "age", "domain": {"type": "int", "min": 21, "max": 70}, "identity": true, "group": "person", "title": "age"},
 {"key": "region", "domain": {"type": "enum", "variants": [{"value": "north", "weight": 3}, {"value": "south", "weight": 2}, "west", {"value": "moon", "weight": 0}]}, "identity": true, "group": "place", "title": "region"},
 {"key": "years", "domain": {"type": "int", "min": 0, "max": 40}, "identity": true, "group": "person", "title": "years of work"},
 {"key": "leads", "domain": {"type": "bool", "p_true": 0.3}, "group": "person", "title": "leads a team"},
 {"key": "skills", "domain": {"type": "multi_enum", "variants": [{"value": "plan", "weight": 4}, "teach", "write", "sail"], "min_pick": 1, "max_pick": 3}, "identity": true, "group": "person", "title": "skills"},
 {"key": "start", "domain": {"type": "computed", "expr": "2026 - years"}, "title": "start"},
 {"key": "name", "domain": {"type": "derived"}, "usage": "store_only"}],
 "hard_rules": [{"name": "grown_up", "expr": "years <= age - 20"}],
 "soft_rules": [{"name": "old_hands_lead", "when": "years >= 15", "then": [{"key": "leads", "type": "weight", "value": "true", "factor": 6}]}]}"""
_COHORTS = [{"name": "young", "share": 0.3, "biases": [{"key": "age", "type": "range", "max": 35}]}, {"name": "any", "share": 0.7}]


def _u(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::BIGINT / 4503599627370496.0)"


@query("""WITH n AS (SELECT n_nationkey AS k, count(c_custkey) AS share FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1), x AS (SELECT k, 1000.0 * share / (SELECT sum(share) FROM n) AS exact FROM n),
    r AS (SELECT k, floor(exact) AS base, row_number() OVER (ORDER BY exact - floor(exact) DESC, k) AS place FROM x) SELECT k, CAST(base + CASE WHEN place <= 1000 - (SELECT sum(base) FROM r) THEN 1 ELSE 0 END AS BIGINT) AS n FROM r""")
def smp_cohort_alloc(spark, d):
    """Quotas of cohorts, here one a nation, by how many customers it has."""
    share = t(spark, d, "nation").join(t(spark, d, "customer").groupBy("c_nationkey").count(), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return sampling.allocated(share.select(F.col("n_nationkey").alias("k"), F.col("count").alias("share")), 1000, key="k").select("k", "n")


@query()
def smp_population(spark, d):
    n = t(spark, d, "customer").count()
    out = sampling.population(spark, dictionary.loads(_DICTIONARY), n, 7, _COHORTS)
    return out.select("idx", "cohort", "attempt", "age", "region", "years", "leads", F.array_join("skills", ",").alias("skills"), "start")


@query(f"""WITH u AS (SELECT c_custkey AS id, {_u("'7'", "c_custkey", "'0'", "'age'", "'0'")} AS a, {_u("'7'", "c_custkey", "'0'", "'region'", "'0'")} AS r, {_u("'7'", "c_custkey", "'0'", "'leads'", "'0'")} AS b FROM customer)
    SELECT id, CAST(21 + floor(a * 50) AS BIGINT) AS age, CASE WHEN r * 6 < 3 THEN 'north' WHEN r * 6 < 5 THEN 'south' ELSE 'west' END AS region, b < 0.3 AS leads FROM u""")
def smp_domains(spark, d):
    raw = dictionary.loads(_DICTIONARY)
    plain = dictionary.Dictionary([raw.param(k) for k in ("age", "region", "leads")])
    rows = t(spark, d, "customer").select(F.col("c_custkey").alias("idx"), F.lit("any").alias("cohort"))
    return sampling.drawn(rows, plain, 7, 0, []).select(F.col("idx").alias("id"), "age", "region", "leads")


_SKILLS = [("plan", 4.0), ("teach", 1.0), ("write", 1.0), ("sail", 1.0)]


@query(f"""WITH c AS (SELECT c_custkey AS id, 1 + floor({_u("'7'", "c_custkey", "'0'", "'skills'", "'0'")} * 3) AS k FROM customer),
    r AS ({' UNION ALL '.join(f'''SELECT c_custkey AS id, '{v}' AS v, -ln(1 - {_u("'7'", "c_custkey", "'0'", "'skills'", f"'{i + 1}'")}) / {w} AS t FROM customer''' for i, (v, w) in enumerate(_SKILLS))}),
    o AS (SELECT id, v, row_number() OVER (PARTITION BY id ORDER BY t, v) AS n FROM r) SELECT id, string_agg(v, ',' ORDER BY n) AS skills FROM o JOIN c USING (id) WHERE n <= k GROUP BY id""")
def smp_multi_enum(spark, d):
    u = lambda k: sampling.uniform(7, F.col("c_custkey"), 0, "skills", k)
    picked = sampling.pick_many([u(i + 1) for i in range(4)], (F.lit(1) + F.floor(u(0) * 3)).cast("int"), [v for v, _ in _SKILLS], [w for _, w in _SKILLS])
    return t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array_join(picked, ",").alias("skills"))


@query("""WITH s AS (SELECT c_custkey AS id, concat_ws('|', 'nation=' || c_nationkey, 'segment=' || c_mktsegment) AS signature FROM customer) SELECT signature, min(id) AS first, count(*) - 1 AS losers FROM s GROUP BY 1""")
def smp_unique_signature(spark, d):
    plain = dictionary.Dictionary([{"key": "nation", "identity": True, "domain": {"type": "int", "min": 0, "max": 99}}, {"key": "segment", "identity": True, "domain": {"type": "enum", "variants": ["x"]}}])
    rows = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return rows.withColumn("signature", sampling.signature(plain)).groupBy("signature").agg(F.min("id").alias("first"), (F.count("*") - 1).alias("losers"))


@query(f"""WITH p AS (SELECT o_orderkey AS id, year(o_orderdate) - 30 AS year, floor((year(o_orderdate) - 30) / 10) * 10 AS decade FROM orders), n AS (SELECT n_name AS name, (n_nationkey % 5)::DOUBLE AS weight, 1960 + 10 * (n_nationkey % 2) AS decade FROM nation),
    c AS (SELECT *, sum(weight) OVER (PARTITION BY decade ORDER BY name) AS upto, sum(weight) OVER (PARTITION BY decade) AS total FROM n WHERE weight > 0), x AS (SELECT *, {_u("'7'", "'first'", "id")} AS u FROM p)
    SELECT id, year, CAST(x.decade AS BIGINT) AS decade, name FROM x JOIN c ON x.decade = c.decade AND u * total >= upto - weight AND u * total < upto""")
def smp_decade_pick(spark, d):
    people = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.year("o_orderdate") - 30).cast("long").alias("year"), F.lit("m").alias("gender"))
    names = t(spark, d, "nation").select(F.lit("m").alias("gender"), (F.lit(1960) + 10 * (F.col("n_nationkey") % 2)).cast("long").alias("decade"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 5).cast("double").alias("weight"))
    return sampling.profile_by_decade(people, names, 7).select("id", "year", F.col("decade").cast("long"), "name")


# ---- profiles


def _jobs(spark, d):
    """Events as jobs: the type is the state, the value the cost."""
    e = t(spark, d, "events")
    state = F.element_at(F.array(*map(F.lit, ["pending", "running", "done", "failed", "dead"])), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select(F.col("event_id").alias("id"), (F.col("user_id") % 20).alias("session_id"), F.col("event_type").alias("kind"), state.alias("status"), F.col("value").alias("cost"), (F.col("event_id") % 1000).alias("tokens"), "ts")


_JOBS = "j AS (SELECT event_id AS id, user_id % 20 AS session_id, event_type AS kind, ['pending','running','done','failed','dead'][event_id % 5 + 1] AS status, value AS cost, event_id % 1000 AS tokens, ts FROM events)"


@query(f"""WITH {_JOBS} SELECT session_id, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'dead') AS dead,
    count(*) AS total, round(sum(cost), 3) AS cost, CAST(sum(tokens) AS BIGINT) AS tokens, pending = 0 AND running = 0 AND failed = 0 AS settled, round((done + dead) / total, 6) AS percent FROM j GROUP BY 1""")
def agg_progress(spark, d):
    return profiles.progress(_jobs(spark, d)).withColumns({"cost": F.round("cost", 3), "percent": F.round("percent", 6)})


@query(f"WITH {_JOBS} SELECT kind, round(avg(cost) FILTER (status = 'done'), 5) AS mean_cost, round(sum(tokens / 1e6 * 0.2 + id / 1e6 * 0.5), 5) AS priced, round(40 * (coalesce(avg(cost) FILTER (status = 'done'), 0.0006) + 3 * 0.04), 3) AS estimate FROM j GROUP BY 1")
def agg_cost(spark, d):
    j = _jobs(spark, d)
    priced = j.groupBy("kind").agg(F.sum(profiles.cost(F.col("tokens"), F.col("id"), F.lit(0.2), F.lit(0.5))).alias("priced"))
    out = priced.join(profiles.mean_cost(j), "kind", "left")
    return out.select("kind", F.round("mean_cost", 5).alias("mean_cost"), F.round("priced", 5).alias("priced"), F.round(profiles.estimate(40, 3, F.col("mean_cost"), F.lit(None).cast("double")), 3).alias("estimate"))


def _marks(spark, d):
    joined = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    return joined.select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("verdict"), F.to_json(F.array("lang", "source")).alias("tags"))


@query("""WITH m AS (SELECT quality, lang, source FROM labels JOIN documents USING (doc_id)), g AS (SELECT unnest([lang, source]) AS tag FROM m), r AS (SELECT count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality <> 1) AS bad FROM m)
    SELECT tag, count(*) AS n, any_value(good) AS good, any_value(bad) AS bad, round(any_value(bad / (good + bad)), 6) AS reject_rate FROM g, r GROUP BY 1""")
def agg_feedback(spark, d):
    rates, tags = profiles.feedback(_marks(spark, d))
    return tags.join(F.broadcast(rates)).select("tag", "n", "good", "bad", F.round("reject_rate", 6).alias("reject_rate"))


@query("""WITH m AS (SELECT lang, source FROM labels JOIN documents USING (doc_id)), g AS (SELECT unnest([lang, source]) AS tag FROM m) SELECT tag, count(*) AS n, round(count(*) / (SELECT count(*) FROM m), 6) AS share FROM g GROUP BY 1 HAVING count(*) >= 3 AND count(*) / (SELECT count(*) FROM m) >= 0.15""")
def agg_systemic_tags(spark, d):
    return profiles.systemic_tags(_marks(spark, d)).select("tag", "n", F.round("share", 6).alias("share"))


@query("""WITH o AS (SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem WHERE l_extendedprice IS NOT NULL)
    SELECT max(n) AS n, min(x) AS min, max(x) FILTER (i = round((n - 1) * 0.1)) AS p10, max(x) FILTER (i = round((n - 1) * 0.5)) AS median, max(x) FILTER (i = round((n - 1) * 0.9)) AS p90, max(x) AS max, round(avg(x), 4) AS mean FROM o""")
def agg_numeric_profile(spark, d):
    return profiles.numeric_profile(t(spark, d, "lineitem"), "l_extendedprice").withColumn("mean", F.round("mean", 4))


@query("WITH e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) SELECT CAST(round((l_quantity - lo) / (hi - lo) * (greatest(2, least(10, floor(hi - lo) + 1)) - 1)) AS BIGINT) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1")
def agg_histogram(spark, d):
    return profiles.histogram(t(spark, d, "lineitem"), "l_quantity")


@query("WITH c AS (SELECT p_type AS value, count(*) AS n FROM part WHERE p_type IS NOT NULL GROUP BY 1) SELECT value, n, round(n / (SELECT count(*) FROM part), 6) AS share, (SELECT count(*) FROM c) AS \"distinct\" FROM c ORDER BY n DESC, value LIMIT 25")
def agg_category_top25(spark, d):
    return profiles.category_profile(t(spark, d, "part"), "p_type").withColumn("share", F.round("share", 6))


@query("WITH l AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), g AS (SELECT unnest(list_distinct(w)) AS item FROM l) SELECT item, round(count(*) / (SELECT count(*) FROM l), 6) AS share, round((SELECT avg(len(w)) FROM l), 6) AS mean_length FROM g GROUP BY 1")
def agg_list_profile(spark, d):
    out = profiles.list_profile(t(spark, d, "part").select(F.split("p_name", " ").alias("w")), "w")
    return out.select("item", F.round("share", 6).alias("share"), F.round("mean_length", 6).alias("mean_length"))


@query("WITH a AS (SELECT l_returnflag AS v, count(*) / (SELECT count(*) FROM lineitem) AS p FROM lineitem GROUP BY 1), b AS (SELECT l_linestatus AS v, count(*) / (SELECT count(*) FROM lineitem) AS q FROM lineitem GROUP BY 1) SELECT round(sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 6) AS distance FROM a FULL JOIN b USING (v)")
def agg_variation_distance(spark, d):
    li = t(spark, d, "lineitem")
    share = lambda c: profiles.category_profile(li, c, None).select("value", "share")
    return profiles.variation_distance(share("l_returnflag"), share("l_linestatus")).select(F.round("distance", 6).alias("distance"))


# ---- joins, sets, windows


@query("SELECT o_orderkey, count(l_orderkey) AS n_items, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) FILTER (l_orderkey IS NOT NULL), '') AS items FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def job_left_nest(spark, d):
    items = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items"))
    out = t(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    text = F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",")
    return out.select("o_orderkey", F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"), F.coalesce(text, F.lit("")).alias("items"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def job_anti(spark, d):
    urgent = t(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return t(spark, d, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100)")
def job_semi_topk(spark, d):
    top = t(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(100).select(F.col("c_custkey").alias("o_custkey"))
    return t(spark, d, "orders").join(top, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY s_acctbal DESC, s_suppkey) AS n FROM customer JOIN supplier ON s_nationkey = c_nationkey) WHERE n = 1")
def job_argmax(spark, d):
    best = t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min_by("s_suppkey", F.struct((-F.col("s_acctbal")).alias("a"), "s_suppkey")).alias("s_suppkey"))
    return t(spark, d, "customer").join(best, "c_nationkey").select("c_custkey", "s_suppkey")


@query("SELECT r_name, n_name, s_suppkey FROM (SELECT r.r_name, n.n_name, s.s_suppkey, row_number() OVER (PARTITION BY n.n_nationkey ORDER BY s.s_acctbal DESC, s.s_suppkey) AS k FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey JOIN supplier s ON s.s_nationkey <> n.n_nationkey AND s.s_acctbal BETWEEN 100 * n.n_nationkey AND 100 * n.n_nationkey + 4000) WHERE k = 1")
def job_theta(spark, d):
    """Bounds and an exclusion: ranges of 1000 are joined as keys first, so no pair is made outside a range's buckets."""
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).withColumn("low", 100.0 * F.col("n_nationkey"))
    n = n.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("low") / 1000), F.floor((F.col("low") + 4000) / 1000))))
    s = t(spark, d, "supplier").withColumn("bucket", F.floor(F.col("s_acctbal") / 1000))
    fit = n.join(s, "bucket").where((F.col("s_nationkey") != F.col("n_nationkey")) & F.col("s_acctbal").between(F.col("low"), F.col("low") + 4000))
    return fit.groupBy("n_nationkey", "r_name", "n_name").agg(F.min_by("s_suppkey", F.struct((-F.col("s_acctbal")).alias("a"), "s_suppkey")).alias("s_suppkey")).select("r_name", "n_name", "s_suppkey")


@query("SELECT s_suppkey, coalesce(f.factor, 1.0) AS factor FROM supplier LEFT JOIN (SELECT n_nationkey, 1.0 + n_nationkey / 10 AS factor FROM nation WHERE n_regionkey < 3) f ON f.n_nationkey = s_nationkey")
def job_lookup_default(spark, d):
    f = t(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"), (F.lit(1.0) + F.col("n_nationkey") / 10).alias("factor"))
    return t(spark, d, "supplier").join(f, "s_nationkey", "left").select("s_suppkey", F.coalesce("factor", F.lit(1.0)).alias("factor"))


@query("SELECT 'nation' AS pool, n_name AS name FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'region', r_name FROM region")
def set_union_except(spark, d):
    n = t(spark, d, "nation")
    free = n.select("n_name").exceptAll(n.where("n_regionkey = 1").select("n_name")).select(F.lit("nation").alias("pool"), F.col("n_name").alias("name"))
    return free.unionByName(t(spark, d, "region").select(F.lit("region").alias("pool"), F.col("r_name").alias("name")))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def set_upsert_last(spark, d):
    last = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "value"), "event_id").alias("x"))
    return last.select("user_id", "event_type", "x.event_id", "x.value")


@query("SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_partkey <> l_suppkey")
def set_pair_dedupe(spark, d):
    return t(spark, d, "lineitem").where("l_partkey != l_suppkey").select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).distinct()


@query(f"WITH {_JOBS} SELECT session_id, kind, id, place FROM (SELECT *, row_number() OVER (PARTITION BY session_id, kind ORDER BY id) AS place FROM j WHERE status = 'pending') WHERE place <= 16")
def win_fifo(spark, d):
    return queue.claim(_jobs(spark, d).withColumn("attempts", F.lit(0)), 16).select("session_id", "kind", "id", F.col("place").cast("long"))


@query(f"WITH {_JOBS} SELECT session_id, id, (row_number() OVER (PARTITION BY session_id ORDER BY id) - 1) // 250 AS batch FROM j WHERE status = 'done'")
def win_batches_250(spark, d):
    return queue.batches(_jobs(spark, d).withColumn("batch_id", F.lit(None).cast("string"))).select("session_id", "id", "batch")


@query("SELECT user_id, min(event_id) AS first_id, count(*) AS n FROM events GROUP BY 1")
def win_first_seen(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("first_id"), F.count("*").alias("n"))


@query(f"WITH {_JOBS} SELECT session_id, id, ts FROM j QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC) = 1")
def win_latest(spark, d):
    return _jobs(spark, d).groupBy("session_id").agg(F.max(F.struct("ts", "id")).alias("x")).select("session_id", "x.id", "x.ts")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 20")
def srt_paged(spark, d):
    return records.page(t(spark, d, "customer"), "c_acctbal:desc", 2, 20, tie="c_custkey", c_mktsegment="BUILDING").select("c_custkey", "c_name", "c_acctbal")


# ---- queues


def _attempts(spark, d):
    """Events as attempts at the jobs of users."""
    kind = F.element_at(F.array(*map(F.lit, ["claim", "fail", "claim", "release", "claim", "complete", "claim"])), (F.col("event_id") % 7 + 1).cast("int"))
    return t(spark, d, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("id"), kind.alias("event"), F.col("value").alias("cost"), "ts")


@query("""WITH RECURSIVE a AS (SELECT user_id AS job, ['claim','fail','claim','release','claim','complete','claim'][event_id % 7 + 1] AS event, value AS cost, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    f AS (SELECT DISTINCT job, 0::BIGINT AS k, 'pending' AS status, 0 AS attempts, 0.0::DOUBLE AS cost FROM a UNION ALL
      SELECT f.job, a.k, CASE WHEN event = 'claim' AND status = 'pending' THEN 'running' WHEN event = 'complete' THEN 'done' WHEN event = 'release' AND status = 'running' THEN 'pending' WHEN event = 'fail' THEN CASE WHEN attempts >= 5 THEN 'dead' ELSE 'pending' END ELSE status END,
        CASE WHEN event = 'claim' AND status = 'pending' THEN attempts + 1 WHEN event = 'release' AND status = 'running' THEN greatest(attempts - 1, 0) ELSE attempts END,
        f.cost + CASE WHEN event IN ('complete', 'fail') THEN coalesce(a.cost, 0) ELSE 0 END
      FROM f JOIN a ON a.job = f.job AND a.k = f.k + 1)
    SELECT job, status, attempts, round(cost, 4) AS cost FROM f QUALIFY row_number() OVER (PARTITION BY job ORDER BY k DESC) = 1""")
def str_retry_fold(spark, d):
    return queue.fold(_attempts(spark, d)).withColumn("cost", F.round("cost", 4))


@query(f"""WITH {_JOBS}, m AS (SELECT max(ts) AS now FROM j) SELECT id, CASE WHEN status = 'running' AND ts < now - INTERVAL 900 SECOND THEN CASE WHEN id % 6 >= 5 THEN 'dead' ELSE 'pending' END ELSE status END AS status FROM j, m""")
def str_reap_stale(spark, d):
    j = _jobs(spark, d).withColumns({"locked_at": F.col("ts"), "attempts": F.col("id") % 6})
    return queue.reap(j.join(F.broadcast(j.agg(F.max("ts").alias("now")))), F.col("now")).select("id", "status")


@query("""WITH l AS (SELECT o_orderpriority AS collection, o_custkey AS batch_id, count(*) AS expected FROM orders GROUP BY 1, 2), s AS (SELECT o_orderpriority AS collection, o_custkey AS batch_id, count(*) AS found FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1, 2)
    SELECT collection, batch_id, expected, coalesce(found, 0) AS found, CASE WHEN coalesce(found, 0) = expected THEN 'committed' WHEN coalesce(found, 0) = 0 THEN 'absent' ELSE 'partial' END AS verdict FROM l LEFT JOIN s USING (collection, batch_id)""")
def str_reconcile(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderpriority").alias("collection"), F.col("o_custkey").alias("batch_id"), "o_orderkey")
    return queue.reconcile(o.groupBy("collection", "batch_id").agg(F.count("*").alias("expected")), o.where("o_orderkey % 3 != 0")).select("collection", "batch_id", "expected", "found", "verdict")


@query(f"WITH {_JOBS}, b AS (SELECT session_id, id, coalesce(sum(cost) OVER (PARTITION BY session_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM j) SELECT session_id, count(*) AS made, round(max(s), 4) AS spent_before_last FROM b WHERE s < 500 GROUP BY 1")
def str_budget_stop(spark, d):
    return queue.within_budget(_jobs(spark, d), F.lit(500.0)).groupBy("session_id").agg(F.count("*").alias("made"), F.round(F.max("spent_before"), 4).alias("spent_before_last"))


@query("SELECT o_custkey AS natural_key, min(o_orderkey) AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1")
def str_enqueue(spark, d):
    old = t(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("natural_key"))
    return queue.enqueue(old, t(spark, d, "orders").select(F.col("o_custkey").alias("natural_key"), F.col("o_orderkey").alias("id")))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def str_window_ext(spark, d):
    out = t(spark, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


# ---- composition

_FIT = [("doctor", "BUILDING", "1", 1.0), ("doctor", "MACHINERY", "*", 0.8), ("*", "FURNITURE", "2", 0.9)]


def _people(spark, d):
    c = t(spark, d, "customer")
    role = F.element_at(F.array(*map(F.lit, ["doctor", "psychologist", "consultant", "consultant"])), (F.col("c_custkey") % 4 + 1).cast("int"))
    focus = (F.col("c_nationkey") % 3).cast("string")
    return c.select(F.col("c_custkey").alias("person"), F.col("c_nationkey").alias("region"), role.alias("role"), F.concat(F.lit("Name"), (F.col("c_custkey") % 97).cast("string")).alias("surname"), F.col("c_mktsegment").alias("specialty"), focus.alias("focus")).withColumn("score", compose.fit(F.col("role"), F.col("specialty"), F.col("focus"), _FIT))


@query("""WITH p AS (SELECT c_custkey AS person, ['doctor','psychologist','consultant','consultant'][c_custkey % 4 + 1] AS role, c_mktsegment AS s, CAST(c_nationkey % 3 AS VARCHAR) AS f FROM customer)
    SELECT person, role, CASE WHEN role = 'doctor' AND s = 'BUILDING' AND f = '1' THEN 1.0::DOUBLE WHEN role = 'doctor' AND s = 'MACHINERY' THEN 0.8::DOUBLE WHEN s = 'FURNITURE' AND f = '2' THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS score FROM p""")
def cmp_fit_scores(spark, d):
    return _people(spark, d).select("person", "role", F.col("score").cast("double").alias("score"))


def _pools(spark, d):
    """Suppliers as places, parts as programmes, customers as people and directors."""
    seg = lambda k: F.element_at(F.array(*map(F.lit, ["low", "middle", "high"])), (k % 3 + 1).cast("int"))
    region = lambda k: F.concat(F.lit("region "), (k % 5).cast("string"))
    s = t(spark, d, "supplier")
    places = s.select(F.concat(F.lit("place:"), "s_suppkey").alias("key"), seg(F.col("s_suppkey")).alias("segment"), region(F.col("s_nationkey")).alias("region"), (F.lit(12) + F.col("s_suppkey") % 17).cast("int").alias("capacity"), (F.lit(1960) + F.col("s_suppkey") % 55).cast("int").alias("year_built"))
    focus = F.element_at(F.array(*map(F.lit, ["drink", "games", "both", "young"])), (F.col("p_size") % 4 + 1).cast("int"))
    programs = t(spark, d, "part").select(F.concat(F.lit("program:"), "p_partkey").alias("key"), seg(F.col("p_partkey")).alias("segment"), focus.alias("focus"), F.col("p_name").alias("title"))
    k = F.col("c_custkey")
    role = F.element_at(F.array(*map(F.lit, ["doctor", "psychologist", "consultant", "consultant", "director"])), (k % 5 + 1).cast("int"))
    name = F.concat(F.lit("Name"), (F.floor(k / 5) % 97).cast("string"), F.lit(" "), "c_name")
    fits = F.create_map(*[x for i, f in enumerate(("drink", "games", "both", "young")) for x in (F.lit(f), ((k % 7 + i) % 4 / 4.0).cast("double"))])
    c = t(spark, d, "customer").select(F.concat(F.lit("person:"), k).alias("key"), role.alias("role"), name.alias("full_name"), (F.lit(25) + k % 45).cast("int").alias("age"), fits.alias("fits"), (k % 4 == 0).alias("specialist"), (k % 6 == 0).alias("psychiatric"), F.col("c_mktsegment").alias("does"), region(F.col("c_nationkey")).alias("home_region"), (k % 2 == 0).alias("founder"), (k % 20).cast("int").alias("leading_years"))
    return places, programs, c.where("role != 'director'").drop("home_region", "founder", "leading_years"), c.where("role = 'director'").select("key", "full_name", "age", "home_region", "founder", "leading_years")


_COMPOSE = compose.Rules({"drink", "both"}, psychiatric_for={"both"}, founder_segments={"high"})


@query()
def cmp_team(spark, d):
    """All centres that the pools make. Invariants are tested: nothing twice, rules, bounds of age and year."""
    out = compose.compose(*_pools(spark, d), _COMPOSE).where("place is not null")
    return out.select("place", "program", "director", *[F.array_join(c, ",").alias(c) for c in ("doctors", "psychologists", "consultants")], "segment", "focus", F.round("fit", 6).alias("fit"), "founded_year", "median_age")


@query("""SELECT s_suppkey, least(3, greatest(1, 1 + (s_suppkey % 60) // 25)) AS doctors, least(7, greatest(2, 2 + (s_suppkey % 60) // 10)) AS consultants, 2026 - 5 - CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 1 + (strlen(s_name) + s_suppkey % 60) % 9 END AS founded FROM supplier""")
def cmp_team_size(spark, d):
    c = (F.col("s_suppkey") % 60).cast("int")
    founded = compose.founded_year(F.lit(5), F.col("s_suppkey") % 2 == 0, F.col("s_name"), c)
    return t(spark, d, "supplier").select("s_suppkey", compose.team_size(c, "doctor").cast("long").alias("doctors"), compose.team_size(c, "consultant").cast("long").alias("consultants"), founded.cast("long").alias("founded"))


@query("""WITH p AS (SELECT s_suppkey AS place, s_nationkey % 5 AS segment, s_nationkey AS region, s_acctbal > 0 AS solvent FROM supplier), c AS (SELECT p_partkey AS service, p_size % 5 AS segment, CASE WHEN p_size % 3 = 0 THEN 'solvent' WHEN p_size % 3 = 1 THEN 'always' ELSE 'unknown' END AS needs, p_retailprice * 10 AS low, p_retailprice * 30 AS high FROM part),
    f AS (SELECT n_nationkey AS region, 1.0 + n_nationkey / 10 AS factor FROM nation WHERE n_regionkey < 3),
    o AS (SELECT place, service, low + floor((high - low) * ((('0x' || substr(md5('2026|' || place || ':' || service), 1, 8))::BIGINT % 1000) / 1000.0::DOUBLE)) AS base, coalesce(factor, 1.0) AS factor FROM p JOIN c USING (segment) LEFT JOIN f USING (region) WHERE needs = 'always' OR (needs = 'solvent' AND solvent)),
    x AS (SELECT place, service, base * factor AS x, CASE WHEN base * factor >= 50000 THEN 5000 WHEN base * factor >= 10000 THEN 1000 ELSE 100 END AS step FROM o) SELECT place, service, CAST(round(x / step) * step AS BIGINT) AS price FROM x""")
def cmp_offers(spark, d):
    places = t(spark, d, "supplier").select(F.col("s_suppkey").alias("place"), (F.col("s_nationkey") % 5).alias("segment"), F.col("s_nationkey").alias("region"), (F.col("s_acctbal") > 0).alias("solvent"))
    needs = F.when(F.col("p_size") % 3 == 0, "solvent").when(F.col("p_size") % 3 == 1, "always").otherwise("unknown")
    catalog = t(spark, d, "part").select(F.col("p_partkey").alias("service"), (F.col("p_size") % 5).alias("segment"), needs.alias("needs"), (F.col("p_retailprice") * 10).alias("low"), (F.col("p_retailprice") * 30).alias("high"))
    factors = t(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("region"), (F.lit(1.0) + F.col("n_nationkey") / 10).alias("factor"))
    return compose.offers(places, catalog, {"always": F.lit(True), "solvent": F.col("solvent")}, factors).select("place", "service", "price")


# ---- table functions


def _view(spark, d, name):
    tables.register(spark)
    t(spark, d, name).createOrReplaceTempView(f"muster_{name}")


@query("SELECT o_custkey AS session_id, o_orderkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS place FROM orders WHERE o_orderstatus = 'O' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3")
def sql_claims(spark, d):
    """The first three open orders of each customer, claimed in SQL."""
    _view(spark, d, "orders")
    return spark.sql("""WITH jobs AS (SELECT o_custkey AS session_id, o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'done' END AS status FROM muster_orders)
        SELECT * FROM claims(3, TABLE(jobs) PARTITION BY session_id ORDER BY id)""")


@query(r"""WITH w AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
    g AS (SELECT item_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w)
    SELECT shingle, count(DISTINCT item_id) AS items FROM g GROUP BY 1""")
def sql_shingles(spark, d):
    """How many benchmark items have each run of three words, in SQL."""
    _view(spark, d, "benchmark")
    return spark.sql(r"""WITH w AS (SELECT item_id, filter(split(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), x -> x != '') AS words FROM muster_benchmark)
        SELECT shingle, count(DISTINCT item_id) AS items FROM w, LATERAL shingles(words, 3) GROUP BY shingle""")


# ---- projections


@query("""SELECT c_custkey, '[who]' || chr(10) || 'name: ' || c_name || CASE WHEN c_acctbal <> 0 THEN chr(10) || 'balance: ' || CASE WHEN c_acctbal = floor(c_acctbal) THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) ELSE printf('%.2f', c_acctbal) END ELSE '' END || chr(10) || '[market]' || chr(10) || 'segment: ' || c_mktsegment AS prompt FROM customer""")
def prj_prompt_block(spark, d):
    plain = dictionary.Dictionary([{"key": "c_name", "title": "name", "group": "who", "domain": {"type": "enum"}}, {"key": "c_mktsegment", "title": "segment", "group": "market", "domain": {"type": "enum"}}, {"key": "c_acctbal", "title": "balance", "group": "who", "domain": {"type": "float"}}])
    return t(spark, d, "customer").select("c_custkey", prompts.block(plain).alias("prompt"))


@query("SELECT conv_id, count(*) AS n_turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS transcript FROM conversations GROUP BY 1")
def prj_chat_assemble(spark, d):
    return prompts.transcript(t(spark, d, "conversations")).select("conv_id", F.col("n_turns").cast("long"), "transcript")


@query("SELECT p_partkey, ['north light', 'window', 'garden'][(('0x' || substr(md5('pose|' || p_partkey), 1, 8))::BIGINT % 3) + 1] AS variant, replace(replace(replace(replace(p_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM part")
def prj_variant_pick(spark, d):
    return t(spark, d, "part").select("p_partkey", prompts.variant(F.col("p_partkey").cast("string"), "pose", ["north light", "window", "garden"]).alias("variant"), T.escaped(F.col("p_name")).alias("escaped"))


@query("SELECT s_suppkey, replace(lower(s_name), 'а', '') AS low, CAST(floor(s_acctbal) AS BIGINT) AS whole, length(s_name) AS n FROM supplier")
def prj_scalars(spark, d):
    return t(spark, d, "supplier").select("s_suppkey", F.replace(F.lower("s_name"), F.lit("а"), F.lit("")).alias("low"), F.floor("s_acctbal").alias("whole"), F.char_length("s_name").cast("long").alias("n"))


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, len(json_keys(props)) AS n_keys FROM events WHERE props IS NOT NULL AND json_valid(props) AND len(json_keys(props)) > 0")
def json_props(spark, d):
    e = t(spark, d, "events").select("event_id", "props", F.json_object_keys("props").alias("k")).where(F.size("k") > 0)
    values = F.from_json("props", "map<string,string>")
    return e.select("event_id", F.try_element_at(values, F.col("k")[0]).alias("first_value"), F.size("k").cast("long").alias("n_keys"))


@query("""WITH q AS (SELECT vec_id AS id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.id, e.vec_id AS other, round(list_cosine_similarity(q.v::DOUBLE[], e.embedding::DOUBLE[]), 5) AS score FROM q JOIN embeddings e ON e.vec_id <> q.id)
    SELECT id, other, score FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, other) = 1""")
def vec_cosine_ext(spark, d):
    """Queries are the rows whose id is divisible by 20, in broadcast blocks of at most VECTORS numbers against all rows; a task keeps each query's best, never its pairs."""
    e = t(spark, d, "embeddings").where("embedding is not null")
    out, block, size = None, [], 0

    def scan():
        nonlocal out
        found = e.mapInArrow(_best(spark.sparkContext.broadcast(list(block))), "id long, other long, score double")
        out = found if out is None else out.union(found)

    for r in e.where("vec_id % 20 = 0").orderBy("vec_id").toLocalIterator():  # a block at a time on the driver
        if block and size + len(r["embedding"]) > VECTORS:
            scan()
            block, size = [], 0
        block.append((r["vec_id"], list(r["embedding"])))
        size += len(r["embedding"])
    scan()
    best = out.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "other")).alias("x"))
    return best.select("id", "x.other", (-F.col("x.s")).alias("score"))


VECTORS, ROWS = 4 << 20, 256  # numbers in a block of queries; queries that a step multiplies


def _best(given):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        if not given.value:
            return
        ids = np.array([i for i, _ in given.value])
        q = np.array([v for _, v in given.value], np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        top, who = np.full(len(ids), -2.0), np.zeros(len(ids), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            other = np.asarray(b.column("vec_id"))
            order = np.argsort(other, kind="stable")
            other = other[order]
            x = np.array(b.column("embedding").to_pylist(), np.float64)[order]
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            for k in range(0, len(ids), ROWS):
                s = np.round(q[k : k + ROWS] @ x.T, 5)
                s[ids[k : k + ROWS, None] == other[None, :]] = -2
                at = s.argmax(1)
                best = s[np.arange(len(at)), at]
                better = (best > top[k : k + ROWS]) | ((best == top[k : k + ROWS]) & (other[at] < who[k : k + ROWS]))
                top[k : k + ROWS][better], who[k : k + ROWS][better] = best[better], other[at][better]
        keep = top > -2
        yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(who[keep]), pa.array(top[keep])], names=["id", "other", "score"])

    return run
