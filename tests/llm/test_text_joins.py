from rankloom.llm import decontaminate, exact_dedup


def test_stages_lose_few_rows_without_shuffling_texts(spark):
    """Ids of dropped rows are sent to the tasks that read the texts, also beyond the size that Spark broadcasts by itself; nulls stay."""
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(5, "a  b", 1), (7, "a b", 2), (7, "other", 3), (None, "a b", 4), (None, "c", 5), (8, f"x {item} y", 6)], "doc_id long, text string, n int")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        copies, leaks = exact_dedup.drop_copies(docs), decontaminate.drop_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
        for out, rows in ((copies, [1, 3, 5, 6]), (leaks, [1, 2, 3, 4, 5])):
            assert sorted(r.n for r in out.collect()) == rows
            assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
