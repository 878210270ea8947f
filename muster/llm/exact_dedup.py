"""Exact deduplication by composable polynomial fingerprints.

A text's fingerprint is its bytes read as a polynomial in 256 modulo a 127-bit prime. That of two joined parts is
f(x + y) = f(x) * 256^len(y) + f(y), so chunks are hashed apart, in any order and place, and combined. Texts with
equal fingerprint and length are compared chunk by chunk; only that comparison makes them equal.

A huge text goes in pieces, which are hashed and compared in parallel as texts of their own. Its fingerprint is combined from its pieces', and
it equals the texts whose pieces equal its own, place by place. No task holds such a text but the one that reads its row.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, trimmed

PRIME = 0x6A09E667F3BCC908B2FB1366EA957D3F  # raised to the next prime below; not near a power of two, for 256 must have a large order
CHUNK = 1 << 16
HELD = 24 << 20
#: Bytes from which a text is huge, and of its pieces.
HUGE, PIECE = 32 << 20, 4 << 20
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _is_prime(n: int) -> bool:
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53):
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


while not _is_prime(PRIME):
    PRIME += 2


def chunk_hash(chunk) -> tuple[int, int]:
    """(hash, length) of one chunk."""
    return int.from_bytes(chunk, "big") % PRIME, len(chunk)


def combine(x: tuple[int, int], y: tuple[int, int]) -> tuple[int, int]:
    """That of x followed by y; associative."""
    return (x[0] * pow(256, y[1], PRIME) + y[0]) % PRIME, x[1] + y[1]


def chunks(text: bytes):
    view = memoryview(text)
    return (view[i : i + CHUNK] for i in range(0, len(view), CHUNK))


def fingerprint(text: bytes) -> tuple[int, int]:
    return reduce(combine, map(chunk_hash, chunks(text)), (0, 0))


def same(x: bytes, y: bytes) -> bool:
    """Chunk by chunk, ending at the first difference."""
    return len(x) == len(y) and all(a == b for a, b in zip(chunks(x), chunks(y), strict=True))


TEXTS, IDS, COMPARED = "fp binary, size long, sha string, text binary", "fp binary, size long, sha string, ids array<{}>", "fp binary, size long, sha string, group binary"


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def _texts(huge: int):
    """Distinct texts of one task: a hot text leaves it once. Huge ones do not leave."""

    def run(batches):
        held: dict[tuple, list] = {}
        size = 0

        def leave():
            rows = [(key[0], key[1], sha, text) for key, found in held.items() for sha, text in found]
            for i in range(0, len(rows), 2000):
                yield _batch(rows[i : i + 2000], ["fp", "size", "sha", "text"], [pa.binary(), pa.int64(), pa.string(), pa.binary()])

        for batch in batches:
            for text in batch.column("text").cast(pa.large_binary()):
                raw = text.as_py() or b""
                if len(raw) >= huge:
                    continue
                low = raw.translate(LOWER)
                value, length = fingerprint(low)
                found = held.setdefault((value.to_bytes(16, "big"), length), [])
                if not any(same(known, low) for _, known in found):
                    found.append((hashlib.sha256(low).hexdigest(), low))
                    size += length + 240
                if size > HELD:
                    yield from leave()
                    held, size = {}, 0
        yield from leave()

    return run


def _ids(kind: pa.DataType, huge: int):
    """The ids of one task's rows by what their texts are known by; those of huge texts by nothing."""

    def run(batches):
        held: dict[tuple, list] = {}
        size = 0

        def leave():
            rows = [(*key, ids) for key, ids in held.items()]
            for i in range(0, len(rows), 2000):
                yield _batch(rows[i : i + 2000], ["fp", "size", "sha", "ids"], [pa.binary(), pa.int64(), pa.string(), pa.list_(kind)])

        for batch in batches:
            for own, text in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
                raw = text.as_py() or b""
                if len(raw) >= huge:
                    key = (b"", len(raw), None)
                else:
                    low = raw.translate(LOWER)
                    value, length = fingerprint(low)
                    key = (value.to_bytes(16, "big"), length, hashlib.sha256(low).hexdigest())
                known = held.get(key)
                if known is None:
                    known = held[key] = []
                    size += 300
                known.append(own)
                size += 40
                if size > HELD:
                    yield from leave()
                    held, size = {}, 0
        yield from leave()

    return run


def _compare(batches):
    """Texts of equal fingerprint and length follow one another; each is compared with one text of each class found so far. A class is told by its sha-256, which no two share."""
    last, classes, known_by = None, [], {}
    for batch in batches:
        out: list[tuple] = []
        for fp, size, sha, text in zip(*(batch.column(c) for c in ("fp", "size", "sha", "text")), strict=True):
            key, text, sha = (fp.as_py(), size.as_py()), text.as_py(), sha.as_py()
            if key != last:
                last, classes, known_by = key, [], {}
            number = next((i for i, known in enumerate(classes) if same(known, text)), len(classes))
            if number == len(classes):
                classes.append(text)
                if known_by.setdefault(sha, number) != number:
                    raise ValueError("two texts share a fingerprint, a length and a sha-256")
                out.append((*key, sha, key[0] + key[1].to_bytes(8, "big") + number.to_bytes(4, "big")))
        yield _batch(out, ["fp", "size", "sha", "group"], [pa.binary(), pa.int64(), pa.string(), pa.binary()])


def _classed(scratch: Scratch, rows: DataFrame, kind: pa.DataType, ddl: str, huge: int) -> DataFrame:
    """group, sha, id of rows (id, text): equal groups for equal texts, null for huge ones.

    Texts go to the comparison alone, each once a task; ids are gathered in another reading, a row for each task and text, and learn their group in a join, which AQE splits:
    the ids of a hot text never meet in one task.
    """
    texts = rows.select("text").mapInArrow(trimmed(_texts(huge)), TEXTS)
    classes = scratch.write(texts.repartition("fp", "size").sortWithinPartitions("fp", "size").mapInArrow(trimmed(_compare), COMPARED), "classes")
    ids = rows.mapInArrow(trimmed(_ids(kind, huge)), IDS.format(ddl))
    return ids.join(classes, ["fp", "size", "sha"], "left").select("group", "sha", F.explode("ids").alias("id"))


def _pieces(batches):
    """Pieces of huge texts, each with its text's name and its place."""
    for batch in batches:
        for name, text in zip(batch.column("name").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
            view = memoryview(text.as_buffer())
            for place, at in enumerate(range(0, len(view), PIECE)):
                yield _batch([(f"{name}/{place}", bytes(view[at : at + PIECE]))], ["id", "text"], [pa.string(), pa.binary()])


def _combined(batches):
    """The group of each text of its pieces' groups in order: the fingerprint that theirs combine to, and which classes they are."""
    for batch in batches:
        out = []
        for name, parts in zip(batch.column("name").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            value, size = reduce(combine, [(int.from_bytes(x[:16], "big"), int.from_bytes(x[16:24], "big")) for x in parts], (0, 0))
            out.append((name, value.to_bytes(16, "big") + size.to_bytes(8, "big") + hashlib.sha256(b"".join(parts)).digest()))
        yield _batch(out, ["name", "group"], [pa.string(), pa.binary()])


def _huge_groups(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """group, sha, id of rows (id, text) of huge texts."""
    sha = F.sha2(normalised(F.col("text")), 256)
    named = rows.select("id", "text", sha.alias("sha")).withColumn("name", F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), "sha"))
    names = scratch.write(named.drop("text"), "names")
    pieces = named.select("name", "text").repartition("name").mapInArrow(trimmed(_pieces), "id string, text binary")
    classes = _classed(scratch, scratch.write(pieces, "pieces"), pa.string(), "string", 2 * PIECE)
    # Rows equal in id and text share a name, and their pieces are the same.
    parts = classes.groupBy(F.substring_index("id", "/", 1).alias("name")).agg(F.sort_array(F.collect_set(F.struct(F.substring_index("id", "/", -1).cast("int").alias("place"), "group"))).alias("parts"))
    groups = parts.select("name", F.col("parts.group").alias("parts")).mapInArrow(trimmed(_combined), "name string, group binary")
    return names.join(groups, "name").select("group", "sha", "id")


def exact_groups(docs: DataFrame, huge: int = HUGE) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, empty texts are copies of one another.
    The row with the largest doc_id stays; of rows with that same doc_id one stays; a null doc_id stays only where all of
    a group are null (keep_id is then null). Extra columns are not read, an empty table gives no rows. Equal texts are
    joined within each task first, so a text held by a third of all rows is shuffled once a task, and row ids alone after that.
    """
    scratch = Scratch(docs.sparkSession, "copies")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    members = scratch.write(_classed(scratch, rows, pa.int64(), "long", huge), "members")
    if not members.where("group is null").isEmpty():
        members = members.where("group is not null").union(_huge_groups(scratch, rows.where(F.octet_length("text") >= huge)))
    members = members.withColumnRenamed("id", "doc_id")
    # Written, so that both sides of the join come from a shuffle and AQE splits a hot group.
    members = scratch.write(members.groupBy("group", "sha", "doc_id").agg(F.count("*").alias("times")), "members")
    per = scratch.write(members.groupBy("group").agg(F.max("doc_id").alias("keep_id"), F.sum("times").alias("group_size")), "groups")
    each = members.join(per, "group").select("doc_id", "keep_id", "group_size", "sha", F.explode(F.expr("sequence(1L, times)")).alias("nth"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    return each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def normalised(text):
    """The comparison's form of a text, as a column."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group, all columns as they are.

    It is the row that exact_groups() keeps; of rows that share its doc_id that with the least text, and of those with one text that of least hash.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    found = scratch.write(exact_groups(docs).select("doc_id", "kept", "text_sha256"), "groups")
    odd = found.groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1 or doc_id is null").select("doc_id")
    gone = found.where("not kept").select(F.col("doc_id").alias("_gone"))
    if odd.isEmpty():
        return docs.join(gone, docs["doc_id"].cast("long") == F.col("_gone"), "left_anti")
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.dataType.typeName() != "map"]
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.sha2(normalised(text), 256).alias("sha"), F.struct(text, F.xxhash64(*plain)).alias("tie"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = found.where("kept").select(F.col("doc_id").alias("keep"), F.col("text_sha256").alias("of"))
    first = rows.join(kept, F.col("id").eqNullSafe(F.col("keep")) & (F.col("sha") == F.col("of")), "left_semi")
    return first.groupBy("id", "sha").agg(F.min_by("row", "tie").alias("row")).select("row.*")
