from crosswind.llm import url_cascade


def test_levels_follow_the_list_and_not_the_universe(spark):
    keys, listed = spark.range(60_000).selectExpr("concat('k', id) AS key"), [f"k{i}" for i in range(0, 60_000, 5000)]
    levels = url_cascade.build(keys, spark.createDataFrame([(k,) for k in listed], "key string"))
    got = {r["key"] for r in keys.where(url_cascade.contains(keys.key, levels)).collect()}
    assert got == set(listed) and sum(v.bits for v in levels[1:]) <= 64 * 10


def test_a_table_of_any_length_can_be_listed(spark):
    """Beyond the literals' bound the list is joined; verdicts are the same."""
    pages = spark.range(3000).selectExpr("id AS page_id", "concat('http://www.s', id, '.example.com/x') AS url")
    listed = spark.range(0, 3000, 7).selectExpr("concat('s', id, '.example.com') AS key").unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS key"))
    verdicts = [{r["page_id"]: r["verdict"] for r in url_cascade.judge(spark, pages, sites=listed, most_bits=bits).collect()} for bits in (1 << 18, 64)]
    assert verdicts[0] == verdicts[1] == {i: "allow" if i % 7 else "block" for i in range(3000)}
