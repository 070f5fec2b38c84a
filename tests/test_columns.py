"""Native columns agree with the kernels, and plans keep what they should."""

import random

from pyspark.sql import functions as F

from sitegraph.functions import columns as C
from sitegraph.functions import kernels as K
from sitegraph.url import kernel as U

HOSTS = ["a.com", "x.a.co.uk", "co.uk", "localhost", "10.0.0.1", "172.16.0.1", "172.40.0.1", "999.1.1.1", "[::1]", "[fe80::2]", "a..b", "w.", "www.a.b", "8.8.8.8", "100.64.1.1", ""]


def test_host_rules(spark):
    frame = spark.createDataFrame([(a, b) for a in HOSTS for b in HOSTS], "a string, b string")
    for r in frame.select("a", "b", C.registrable_domain("a").alias("d"), C.private_host("a").alias("p"), *[C.same_site("a", "b", m).alias(m[-4:]) for m in ("same-host", "same-site", "any")]).collect():
        assert r["d"] == U.registrable_domain(r["a"]) and r["p"] == U.private_host(r["a"])
        assert [r["host"], r["site"], r["any"]] == [U.same_site(r["a"], r["b"], m) for m in ("same-host", "same-site", "any")]


def test_fast_path_equals_kernel(spark):
    dice = random.Random(2)
    parts = ["a", "B", ".", "-", "/", "//", "/./", "/../", "%41", "0x1", "1", "xn--", ":80", "?q", "#f", "~", "_", ","]
    urls = [dice.choice(["http://", "https://h.example/", "https://", "http://a-b.example/x"]) + "".join(dice.choice(parts) for _ in range(dice.randint(1, 7))) for _ in range(3000)]
    frame = spark.createDataFrame([(u,) for u in urls], "u string")
    for r in frame.select("u", K.normalize_url(F.col("u")).alias("n"), C.simple_url("u").alias("s")).collect():
        assert r["n"] == U.normalize(r["u"]), r["u"]
    assert frame.where(C.simple_url("u")).count() > 100


def test_utf16_lengths(spark):
    frame = spark.createDataFrame([("a😀",), ("",), (None,)], "t string")
    assert [r[0] for r in frame.select(C.utf16_length("t")).collect()] == [3, 0, None]


def test_scans_read_what_is_asked(spark):
    from sitegraph.plans.queries import QUERIES

    plan = QUERIES["u22_url_host"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan.split("ReadSchema")[-1] and "Python" not in plan
