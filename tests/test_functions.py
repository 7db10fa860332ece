from pyspark.sql import functions as F

from recentlake.functions import columns as C


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_wiki_to_language(spark):
    cases = {"enwiki": "en", "wiki": "wiki", "commonswiki": "commons", " frwiki ": "fr", "": "unknown",
             None: "unknown", "unknownwiki": "unknown", "meta.example.org": "meta.example.org"}
    for value, want in cases.items():
        assert one(spark, C.wiki_to_language("x"), value) == want, value


def test_shorten_title(spark):
    assert one(spark, C.shorten_title("x"), "short") == "short"
    long = "a" * 48 + " bcdef"
    got = one(spark, C.shorten_title("x"), long)
    assert got == "a" * 48 + "…"          # 49 chars cut, trailing space stripped
    assert one(spark, C.shorten_title("x"), "b" * 50) == "b" * 50
    assert one(spark, C.shorten_title("x"), "c" * 51) == "c" * 49 + "…"


def test_iso_and_local_time(spark):
    df = spark.createDataFrame([("2024-07-01 10:00:00",), ("2024-01-01 00:00:07.179575",)], "s string")
    ts = F.to_timestamp("s")
    rows = df.select(C.iso_utc(ts).alias("iso"), C.format_local_time(ts).alias("loc")).collect()
    assert rows[0]["iso"] == "2024-07-01T10:00:00+00:00"
    assert rows[0]["loc"] == "01/07/2024 12:00:00 Europe/Paris"
    assert rows[1]["iso"] == "2024-01-01T00:00:07.179575+00:00"
    assert rows[1]["loc"] == "01/01/2024 01:00:07 Europe/Paris"
    assert one(spark, C.format_local_time(F.col("x").cast("timestamp")), None) == "timestamp invalide"


def test_pct_and_severity(spark):
    df = spark.createDataFrame([(1, 3), (0, 0), (2, 7)], "a long, b long")
    got = [r[0] for r in df.select(C.pct("a", "b")).collect()]
    assert got == [33.33, 0.0, 28.57]
    sev = spark.createDataFrame([(4,), (5,), (9,), (10,)], "c long").select(C.severity("c")).collect()
    assert [r[0] for r in sev] == ["low", "medium", "medium", "high"]


def test_anonymous_and_wiki_fallback(spark):
    df = spark.createDataFrame(
        [(None, 5, "10.0.0.1"), (True, 5, "bob"), (None, 0, "bob"), (False, 7, "1.2.3"), (None, None, None)],
        "anonymous boolean, userid long, user string")
    assert [r[0] for r in df.select(C.is_anonymous()).collect()] == [True, True, True, False, False]
    w = spark.createDataFrame([("", "srv", None), (None, "", "dom"), ("enwiki", "srv", "dom"), ("", "", "")],
                              "wiki string, server_name string, d string")
    got = [r[0] for r in w.select(C.extract_wiki("wiki", "server_name", "d")).collect()]
    assert got == ["srv", "dom", "enwiki", None]


def test_buckets_and_freshness(spark):
    df = spark.createDataFrame([("2024-01-01 10:59:59",)], "s string").select(F.to_timestamp("s").alias("t"))
    r = df.select(C.minute_bucket("t"), C.hour_bucket("t"),
                  C.freshness("t", F.to_timestamp(F.lit("2024-01-01 11:09:58"))),
                  C.freshness("t", F.to_timestamp(F.lit("2024-01-01 11:10:00")))).first()
    assert tuple(r) == ("2024-01-01 10:59", "2024-01-01 10:00", "fresh", "stale")
