from muster import tables


def test_claims_and_shingles_in_sql(spark):
    tables.register(spark)
    spark.createDataFrame([(1, 5, "pending"), (1, 2, "pending"), (1, 3, "done"), (1, 9, "pending"), (2, 1, "done"), (None, 7, "pending"), (3, 4, None)], "session_id long, id long, status string").createOrReplaceTempView("jobs_of_test")
    got = spark.sql("SELECT * FROM claims(2, TABLE(jobs_of_test) PARTITION BY session_id ORDER BY id)").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 2, 1), (1, 5, 2), (None, 7, 1)], key=str)
    spark.createDataFrame([(1, ["a", "b", "c", "a", "b", "c"]), (2, ["a", "b"]), (3, []), (4, None), (5, ["a", None, "b", "c", "d"])], "id long, words array<string>").createOrReplaceTempView("words_of_test")
    got = spark.sql("SELECT id, shingle, place FROM words_of_test, LATERAL shingles(words, 3)").collect()
    assert sorted(map(tuple, got)) == [(1, "a b c", 1), (1, "b c a", 2), (1, "c a b", 3), (2, "a b", 1), (5, "a b c", 1), (5, "b c d", 2)]
