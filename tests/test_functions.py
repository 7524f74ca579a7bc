"""Scalar expressions F1-F10 and projections P1-P4 on small literal frames."""

from pyspark.sql import functions as F

from conftest import rows
from keelson.functions import (
    escape_backslash,
    join_path,
    last_segment,
    parent_dir,
    prefixed_key,
    seconds_text,
    service_uri,
    when_equals,
    with_suffix,
)
from keelson.operators.select import (
    ASSET_NAME_GROUPS,
    ASSET_NAME_PATTERN,
    audit_responses,
    extract_groups,
    select_kind,
    split_responses,
    with_default,
)


def test_paths(spark):
    df = spark.createDataFrame([("a/b/c.jar", 1), ("file", None), ("dir/", 2), (None, 3)], "p string, i int")
    out = df.select(last_segment("p").alias("last"), parent_dir("p").alias("parent"),
                    with_suffix(F.lit("svc"), "i").alias("named"),
                    join_path(F.lit("/base"), F.col("p")).alias("joined")).collect()
    assert [tuple(r) for r in out] == [
        ("c.jar", "a/b", "svc-1", "/base/a/b/c.jar"),
        ("file", "", "svc", "/base/file"),
        ("", "dir", "svc-2", "/base/dir/"),
        (None, None, "svc-3", "/base"),
    ]


def test_text(spark):
    df = spark.createDataFrame([("C:\\x\\y", "localhost", 8080, 0.125, None, "acme-init")],
                               "v string, h string, p int, s double, pre string, n string")
    r = df.select(escape_backslash("v"), service_uri("h", "p"), seconds_text("s"),
                  prefixed_key("pre", F.lit("keys")), prefixed_key(F.lit("kafka"), F.lit("acks")),
                  when_equals("n", "acme-init", "init-zk=true init-kafka=true"),
                  when_equals(F.lit("acme-gate"), "acme-init", "x")).first()
    assert tuple(r) == ("C:\\\\x\\\\y", "http://localhost:8080/", "0.12", "keys", "kafka.acks",
                        "init-zk=true init-kafka=true", "")


# Names and expected (name, version) for the asset pattern; both engines agree.
ASSET_CASES = [
    ("acme-gate-0.38.0.jar", "acme-gate", "0.38.0"),
    ("acme-gate-0.38.0-sources.jar", "acme-gate", "0.38.0-sources"),
    ("acme-gate-0.38.0.jar.asc", "acme-gate", "0.38.0"),
    ("acme-stream-api-0.1.jar", "acme-stream-api", "0.1"),
    ("a-1.jar.b.jar", "a", "1.jar.b"),
    ("MyGate-1.jar", "ate", "1"),
    ("README.md", "", ""),
]


def test_extract_asset_groups(spark):
    df = spark.createDataFrame([(n,) for n, _, _ in ASSET_CASES], "asset string")
    out = extract_groups(df, "asset", ASSET_NAME_PATTERN, ASSET_NAME_GROUPS)
    assert rows(out) == sorted(ASSET_CASES)


def test_select_kind(spark):
    df = spark.createDataFrame([("gate", 0), ("gate", 1), ("stream-api", 0)], "kind string, id int")
    assert rows(select_kind(df, "gate", columns=["id"])) == [(0,), (1,)]
    assert select_kind(df, "stream-manager").count() == 0


def test_with_default(spark):
    df = spark.createDataFrame([(None, None), ("", 0), ("/x", 3)], "d string, n int")
    out = with_default(with_default(df, "d", "."), "n", 1)
    assert rows(out) == sorted([(".", 1), (".", 0), ("/x", 3)])


def test_audit_responses(spark):
    df = spark.createDataFrame([
        ("u1", 200, "body"), ("u2", 200, ""), ("u3", 200, None), ("u4", 503, "oops"), ("u5", 503, ""),
    ], "url string, code int, body string")
    out = {r.url: r.error for r in audit_responses(df).collect()}
    assert out == {
        "u1": None,
        "u2": "no content from u2",
        "u3": "no content from u3",
        "u4": "status 503 from u4",
        "u5": "status 503 from u5",
    }
    ok, bad = split_responses(df)
    assert rows(ok, "url") == [("u1",)] and bad.count() == 4


def test_binary_body_counts_bytes(spark):
    df = spark.createDataFrame([("u", 200, bytearray(b"")), ("v", 200, bytearray(b"\x00"))],
                               "url string, code int, body binary")
    out = {r.url: r.error for r in audit_responses(df).collect()}
    assert out == {"u": "no content from u", "v": None}
