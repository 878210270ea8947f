"""Table functions for SQL: claims of a queue and shingles of words, as Python UDTFs.

    tables.register(spark)
    SELECT * FROM claims(16, TABLE(jobs) PARTITION BY session_id ORDER BY id)
    SELECT d.id, s.shingle FROM docs d, LATERAL shingles(d.words, 3) s
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F


class Claims:
    """Of a table with session_id, id and status: the first pending jobs of each session, so many at most, with their place.

    It holds a number and no rows, so a session may be of any length. The table is partitioned by session_id and ordered by id where it is called.
    """

    def __init__(self):
        self.n = 0

    def eval(self, most: int, job: Row) -> Iterator[tuple]:
        if job["status"] == "pending" and self.n < most:
            self.n += 1
            yield job["session_id"], job["id"], self.n


class Shingles:
    """Distinct runs of n words of an array in the order of their first place; of fewer words one run of all, of none none."""

    def eval(self, words: list[str], n: int) -> Iterator[tuple]:
        some = [w for w in words or [] if w is not None]
        if some and n > 0:
            runs = [" ".join(some[i : i + n]) for i in range(len(some) - n + 1)] or [" ".join(some)]
            for place, run in enumerate(dict.fromkeys(runs), 1):
                yield run, place


FUNCTIONS = {"claims": (Claims, "session_id: bigint, id: bigint, place: int"), "shingles": (Shingles, "shingle: string, place: int")}


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session under their names."""
    for name, (cls, columns) in FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(cls, returnType=columns))
