"""S1 manifest decoding: strict, lenient + quarantine, NULL, no assets, round trip."""

import pytest
from pyspark.sql import types as T

from conftest import SF001, rows
from keelson.operators.aggregates import duplicate_keys, unique_index
from keelson.operators.joins import keep_listed, pending
from keelson.operators.select import ASSET_NAME_GROUPS, ASSET_NAME_PATTERN, extract_groups
from keelson.sources.cached import cached_items, quarantined, read_cached, write_cached
from keelson.sources.manifest import (
    decode_document,
    pack_manifest,
    pack_pages,
    quarantine_manifest,
    unpack_manifest,
)
from keelson.sources.tables import Tables

GOOD = ('{"assets":[{"name":"acme-gate-0.38.0.jar","browser_download_url":"https://x/g.jar"},'
        '{"name":"acme-gate-0.38.0.jar.asc","browser_download_url":"https://x/g.asc"},'
        '{"name":"README.md","browser_download_url":"https://x/r"}],"tag_name":"v1"}')


def docs(spark):
    return spark.createDataFrame([("e1", GOOD), ("e2", "{bad"), ("e3", '{"x":1}'), ("e4", None)],
                                 "etag string, body string")


def test_lenient_unpack_and_quarantine(spark):
    df = docs(spark)
    items = unpack_manifest(df, "body", mode="lenient", keep=["etag"])
    assert rows(items, "etag", "name") == [("e1", "README.md"), ("e1", "acme-gate-0.38.0.jar"),
                                           ("e1", "acme-gate-0.38.0.jar.asc")]
    assert rows(quarantine_manifest(df, "body"), "etag") == [("e2",)]


def test_strict_fails_on_malformed(spark):
    with pytest.raises(Exception):
        unpack_manifest(docs(spark), "body", mode="strict").collect()
    ok = unpack_manifest(docs(spark).where("etag <> 'e2'"), "body", mode="strict")
    assert ok.count() == 3


def test_bad_mode(spark):
    with pytest.raises(ValueError):
        unpack_manifest(docs(spark), "body", mode="drop")


def test_decode_document(spark):
    df = spark.createDataFrame([(1, '{"k": 5}'), (2, '{"k": "x"}'), (3, "nope")], "id int, props string")
    out = decode_document(df, "props", T.StructType([T.StructField("k", T.IntegerType())]),
                          mode="lenient", keep=["id"])
    # A value of the wrong type fails the decode like malformed text does.
    assert rows(out) == [(1, 5)]


def test_component_selection_and_duplicate_names(spark):
    """Select listed components (J1), detect the reachable duplicate name (A1)."""
    items = unpack_manifest(docs(spark).where("etag = 'e1'"), "body")
    named = extract_groups(items, "name", ASSET_NAME_PATTERN, ASSET_NAME_GROUPS, prefix="c_")
    wanted = spark.createDataFrame([("acme-gate",), ("acme-init",)], "c_name string")
    listed = keep_listed(named, wanted, "c_name")
    assert listed.count() == 2  # the jar and its .asc share a component name
    assert rows(duplicate_keys(listed, "c_name")) == [("acme-gate", 2)]
    with pytest.raises(ValueError):
        unique_index(listed, "c_name")
    # Only assets not stored yet are fetched; the key is the full file name.
    done = spark.createDataFrame([("acme-gate-0.38.0.jar",)], "name string")
    assert rows(pending(listed, done, "name"), "name") == [("acme-gate-0.38.0.jar.asc",)]


def test_pack_unpack_round_trip(spark):
    li = Tables(spark, SF001).lineitem
    schema = T.StructType([T.StructField("l_partkey", T.LongType()), T.StructField("l_linenumber", T.IntegerType()),
                           T.StructField("l_quantity", T.DoubleType())])
    packed = pack_manifest(li, "l_orderkey", ["l_partkey", "l_linenumber", "l_quantity"])
    back = unpack_manifest(packed, "body", schema, keep=["l_orderkey"])
    cols = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"]
    assert rows(back, *cols) == rows(li, *cols)
    # One document per order, items in line-number order.
    one = packed.orderBy("l_orderkey").first()
    assert one.body.startswith('{"assets":[{')
    assert packed.count() == li.select("l_orderkey").distinct().count()


def test_pack_drops_null_fields(spark):
    df = spark.createDataFrame([(1, "a", None)], "g int, name string, browser_download_url string")
    out = pack_manifest(df, "g", ["name", "browser_download_url"]).first().body
    assert out == '{"assets":[{"name":"a"}]}'


def test_pages_are_full_and_bounded(spark):
    """One group of 5000 items and a small one: pages of 300 in order, only the last of a group shorter."""
    data = [("big", i * 7 % 5000, None if i % 9 else "x") for i in range(5000)] + [("small", i, "y") for i in range(4)]
    df = spark.createDataFrame(data, "g string, i int, t string").repartition(6)
    pages = pack_pages(df, "g", ["i", "t"], 300, order="i")
    sizes = {(r.g, r.page): r.n_items for r in pages.collect()}
    assert sizes == {**{("big", p): 300 for p in range(16)}, ("big", 16): 200, ("small", 0): 4}
    item = T.StructType([df.schema["i"], df.schema["t"]])
    back = unpack_manifest(pages, "body", item, keep=["g", "page"])
    assert rows(back) == sorted(((g, i // 300, i, t) for g, i, t in data), key=lambda r: r[:3])


def test_cached_files_absent_damaged_and_replaced(spark, tmp_path):
    path = f"{tmp_path}/cache"
    expected = spark.createDataFrame([("a/1 %é.json",), ("b",), ("c",), ("d",), ("e",), ("f",)], "name string")
    assert {r.name: r.status for r in read_cached(expected, path).collect()} == dict.fromkeys(["a/1 %é.json", "b", "c", "d", "e", "f"], "absent")
    item = '{"name":"n%d","browser_download_url":"u"}'
    docs = [("a/1 %é.json", '{"assets":[' + item % 1 + ",\n" + item % 2 + "]}"), ("b", "{bad"), ("c", '{"x":1}'), ("d", ""), ("e", None),
            ("other", '{"assets":[]}')]
    write_cached(spark.createDataFrame(docs, "name string, body string"), path)
    got = read_cached(expected, path)
    assert {r.name: r.status for r in got.collect()} == {"a/1 %é.json": "ok", "b": "damaged", "c": "ok", "d": "damaged", "e": "absent",
                                                         "f": "absent"}
    assert rows(cached_items(got.withColumnRenamed("name", "doc"), "doc")) == [("a/1 %é.json", "n1", "u"), ("a/1 %é.json", "n2", "u")]
    assert rows(quarantined(got).select("name", got.body.cast("string"))) == [("b", "{bad"), ("d", "")]
    # Writing one again replaces it and leaves the others.
    write_cached(spark.createDataFrame([("b", '{"assets":[' + item % 3 + "]}")], "name string, body string"), path)
    assert {r.name: r.status for r in read_cached(expected, path).collect()}["b"] == "ok"
    assert cached_items(read_cached(expected.withColumnRenamed("name", "doc"), path, "doc"), "doc").count() == 3
    with pytest.raises(ValueError, match="duplicate key"):
        write_cached(spark.createDataFrame([("z", "1"), ("z", "2")], "name string, body string"), path)


def test_cached_bytes_that_are_no_text(spark, tmp_path):
    import hashlib
    folder = tmp_path / "c" / f"doc={hashlib.sha256(b'x').hexdigest()}"
    folder.mkdir(parents=True)
    (folder / "part-0.txt").write_bytes(b'{"assets":[]}\xff\n')
    got = read_cached(spark.createDataFrame([("x",)], "name string"), f"{tmp_path}/c").first()
    assert got.status == "damaged" and bytes(got.body) == b'{"assets":[]}\xff'
