"""Spelling variants of words: pairs one edit apart by merging light subtrees of a trie, and the form that each word most likely stands for.

Two words diverge at one node of the trie of all words. They are one edit apart there in three ways: the characters that follow differ and the
rest is equal, or the rest after one word's character equals all that the other has left. Each node has a heavy child, below which most words lie; its other
children, and a word that ends there, are light. So of two words that diverge at a node at least one is light, and it alone is merged,
small to large: with its character replaced by the heavy one, with its character skipped, and with the heavy one put before it, which is the heavy word's
character skipped. Where a merged word and a word coincide they are a pair, as are two light words replaced at one node that coincide. A word is light at no more nodes than the
logarithm of the number of words, so merged words are few.

In Spark, nodes are rows keyed by a hash of their prefix and by depth; children are counted by grouping, before the shuffle first, and the root is a key like others: its words meet the one row of
its heavy child in a join that AQE splits. Where two prefixes share a hash they share a heavy child, which costs merged words but no pair: all words at a node
follow one choice, and any choice gives each pair once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix, trimmed
from .exact_dedup import normalised

LETTERS = "A-Za-zÀ-ÿ"
#: Words up to this length name themselves; longer ones go by their hash until they are needed.
SHORT = 32


def word_counts(docs: DataFrame, least_length: int = 5, least_count: int = 3, one_in: int = 97) -> DataFrame:
    """word, n of docs (doc_id, text). Of a run whose checksum with its doc_id divides by one_in, the code point that it points at is deleted."""
    parts = F.split(F.col("text").cast("string"), f"[^{LETTERS}]+")
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(parts).alias("run")).where("run != ''")
    # Most runs have no capitals, which is sooner seen than each character looked up.
    each = each.select("id", F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(normalised(F.col("run"))).alias("run"))
    sum_ = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (sum_ % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.expr("substring(run, at + 2)"))
    words = each.withColumn("sum", sum_).withColumn("at", at).select(F.when(F.col("sum") % one_in == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _nodes(batches):
    """A row for each node on the way to each word: its hash and depth, and the child that the word takes, -1 where it ends."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 8192):
            part = batch.slice(begin, 8192)
            words = part.column("word").to_pylist()
            codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
            lengths = np.array([len(w) for w in words], np.int64)
            starts = np.cumsum(lengths) - lengths
            hashes, left, depth = np.zeros(len(words), np.uint64), np.arange(len(words)), 0
            held, size = [], 0
            while len(left):
                ends = lengths[left] == depth
                child = np.where(ends, -1, codes[np.where(ends, 0, starts[left] + depth)].astype(np.int64))
                held.append((left, hashes[left], np.full(len(left), depth), child))
                size += len(left)
                left, step = left[~ends], child[~ends].astype(np.uint64)
                hashes[left] = mix((hashes[left] + step) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
                depth += 1
                if size >= 1 << 18 or not len(left):
                    rows, node, at, kid = (np.concatenate(x) for x in zip(*held, strict=True))
                    columns = [part.column("key").take(pa.array(rows)), pa.array(node.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(kid.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "node", "depth", "child"])
                    held, size = [], 0


def _merged(batches):
    """Where a light word may coincide with another: replaced, skipped, and with the heavy character put before."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("probe", pa.string()), ("depth", pa.int32())])
    for batch in batches:
        out, size = [], 0
        for word, n, places in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), batch.column("places").to_pylist(), strict=True):
            for place in places:
                at, heavy = place["depth"], chr(place["heavy"])
                out.append((word, n, word[:at] + heavy + word[at:], None))
                if at < len(word):
                    out.append((word, n, word[:at] + heavy + word[at + 1 :], at))
                    if word[at + 1 : at + 2] != word[at]:  # else the two diverge further down
                        out.append((word, n, word[:at] + word[at + 1 :], None))
                size += 6 * len(word)
                if size >= 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def near_words(scratch: Scratch, words: DataFrame) -> DataFrame:
    """word, n_near, best (a struct of minus n and word) of words (word, n): how many words are one edit away, and the most frequent of them."""
    key = F.when(F.char_length("word") <= SHORT, F.col("word")).otherwise(F.concat(F.lit("#"), F.sha2("word", 256)))
    keyed = scratch.write(words.withColumn("key", key), "words")
    nodes = scratch.write(keyed.select("word", "key").mapInArrow(trimmed(_nodes), "key string, node long, depth int, child int"), "nodes")
    kids = nodes.groupBy("node", "depth", "child").agg(F.count("*").alias("size"))
    largest = F.max(F.struct(F.col("child") >= 0, "size", F.col("child"))).getField("child")
    heavy = scratch.write(kids.groupBy("node", "depth").agg(largest.alias("heavy"), F.count("*").alias("kids")).where("kids > 1").drop("kids"), "heavy")
    light = nodes.join(heavy, ["node", "depth"]).where("child != heavy").groupBy("key").agg(F.collect_list(F.struct("depth", "heavy")).alias("places"))
    probes = keyed.join(light, "key").select("word", "n", "places").mapInArrow(trimmed(_merged), "word string, n long, probe string, depth int")
    probes = scratch.write(probes, "merged")
    scratch.drop(nodes)
    met = scratch.write(probes.join(words.select(F.col("word").alias("probe"), F.col("n").alias("m")), "probe").select("word", "n", F.col("probe").alias("other"), "m"), "met")
    both = met.union(met.select("other", "m", "word", "n")).select("word", F.lit(1).cast("long").alias("n_near"), F.struct((-F.col("m")).alias("minus"), F.col("other").alias("word")).alias("best"))
    # Words replaced at one node that coincide are no more than there are letters; each gets how many there are and the best of the others.
    member = F.struct((-F.col("n")).alias("minus"), "word")
    alike = probes.where("depth is not null").groupBy("probe", "depth").agg(F.array_sort(F.collect_list(member)).alias("members")).where(F.size("members") > 1)
    alike = alike.select("members", F.explode("members").alias("own")).select(F.col("own.word").alias("word"), (F.size("members") - 1).cast("long").alias("n_near"), F.when(F.col("own.word") == F.col("members")[0]["word"], F.col("members")[1]).otherwise(F.col("members")[0]).alias("best"))
    return both.union(alike).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form): the last that following forms leads to. A round halves what is left of each way."""
    now = scratch.write(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("more")), "roots")
    while not now.where("more").isEmpty():
        then = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        then = scratch.write(now.join(then, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("more")), "roots")
        scratch.drop(now)
        now = then
    return now.select("word", "root")


def group_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct words (word, n).

    Words are near if they differ by exactly one inserted, deleted or replaced code point. A word's form is its near word of largest n, of those with one n the least in
    code-point order, if that n is at least ratio times the word's; else null. Ties are settled by code points, an empty table gives no rows.
    """
    scratch = Scratch(words.sparkSession, "variants")
    words = scratch.write(words.select("word", "n"), "counts")
    best = words.join(near_words(scratch, words), "word", "left")
    has_form = -F.col("best.minus") >= ratio * F.col("n")
    told = best.select("word", F.when(has_form, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has_form, -F.col("best.minus")).alias("form_n"))
    told = scratch.write(told, "forms")
    last = roots(scratch, told.where("form is not null").select("word", "form"))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """group_variants() of the words of docs (doc_id, text).

    Null and empty texts have no words; a null doc_id is an empty one in checksums; repeated rows count each. Extra columns are not read.
    """
    return group_variants(word_counts(docs))


def oracle() -> str:
    """The same from deletions of each word at each place, in SQL."""
    return r"""
        WITH RECURSIVE tab AS (
          SELECT list(list_reduce(range(8), lambda a, _: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS tab FROM range(256) t(i)),
        r AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents),
        l AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS k FROM r GROUP BY ALL),
        b AS (SELECT w, k, flatten(list_transform(string_split(d || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, unicode(c) - 64] END)) AS b FROM l),
        h AS (SELECT w, k, xor(list_reduce(b, lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM b, tab),
        c AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, CAST(sum(k) AS BIGINT) AS n FROM h GROUP BY 1),
        v AS MATERIALIZED (SELECT word, n FROM c WHERE length(word) >= 5 AND n >= 3),
        x AS MATERIALIZED (SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS p FROM v)),
        e AS (
          SELECT a.word, b.word AS other, b.n AS m FROM x a JOIN x b ON a.cut = b.cut AND a.p = b.p AND a.word <> b.word
          UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.cut = v.word
          UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.cut = v.word),
        g AS (SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near FROM e QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, other) = 1),
        f AS MATERIALIZED (SELECT v.word, CASE WHEN m >= 2 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN m END AS form_n FROM v LEFT JOIN g USING (word)),
        t(word, way) AS (SELECT word, word FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.way WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, t.way AS root, f.n, f.n_near, f.form_n FROM f JOIN t ON t.word = f.word JOIN f z ON z.word = t.way AND z.form IS NULL"""
