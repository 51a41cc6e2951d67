from lexivec.functions import sql


def test_functions_in_sql(spark):
    sql.register(spark)
    row = spark.sql("SELECT cosine_similarity(array(1D, 0D), array(1D, 1D)) AS c, approx_tokens('abcde') AS t, yes_no_softmax(0, 0) AS p").first()
    assert round(row["c"], 6) == 0.707107 and row["t"] == 2 and row["p"] == 0.5
    assert spark.sql("SELECT cosine_similarity(array(0D), array(1D)) AS c").first()["c"] is None
    rows = spark.sql("SELECT * FROM chunk_markdown('# A\n\nx\n', 900, 0)").collect()
    assert [(r["chunk_index"], r["end_byte"]) for r in rows] == [(0, 7)]
    joined = "SELECT d.id, c.chunk_index FROM VALUES (1, 'a'), (2, '') AS d(id, t), LATERAL chunk_markdown(d.t, 900, 0) c"
    assert [r["id"] for r in spark.sql(joined).collect()] == [1]
