"""URL allow and block rules by a sort-merge range join.

A host's key is its labels in reverse, each followed by a dot
(``a.example.org`` -> ``org.example.a.``), so a rule's host and all its
subdomains are the interval of keys that begin with the rule's key.  URLs
are dealt into ranges of keys (a hash of the row follows the key, so one
host may span many ranges); each rule goes to the ranges that its interval
meets.  Each task sweeps its sorted range once and keeps a stack of the
rules that are active, outer hosts below inner ones; the innermost host with
a rule whose path the URL's path begins with wins, by its longest path.

Defined results: a null URL, or one without ``://``, has an empty host and
path and no rule; a null rule field makes the rule void; of repeated rules
with one host and path, ``block`` wins; repeated rows and null ids are
judged like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT = "allow"


def host_and_path(url: str = "url"):
    """Columns host and path: what follows the first ``://`` up to ``/ ? #``, and on up to ``? #``."""
    u = F.col(url)
    at = F.locate("://", u)
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise("")
    return (F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def host_key(host):
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def sweep(batches):
    """Rows sorted by (part, key, kind): rules are taken onto the stack, URLs get their verdict."""
    stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []
    for batch in batches:
        out = []
        for key, kind, path, row_id, host, verdict in zip(*(batch.column(c).to_pylist() for c in (
                "key", "kind", "path", "page_id", "host", "verdict")), strict=True):
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, []))
                rules, lengths = stack[-1][1:]
                if rules.get(path, ("", ""))[1] != "block":
                    rules[path] = (host + path, verdict)
                if len(path) not in lengths:
                    lengths.append(len(path))
                    lengths.sort(reverse=True)
                continue
            found = None
            for _, rules, lengths in reversed(stack):
                found = next((rules[path[:n]] for n in lengths if n <= len(path) and path[:n] in rules), None)
                if found:
                    break
            out.append((row_id, host, path, *(found or (None, DEFAULT))))
        if out:
            cols = list(zip(*out, strict=True))
            yield pa.record_batch({"page_id": pa.array(cols[0], batch.schema.field("page_id").type)}
                                  | {c: pa.array(x, pa.string()) for c, x in zip(("host", "path", "rule", "verdict"),
                                                                                 cols[1:], strict=True)})


def judge(pages: DataFrame, rules: DataFrame, sample: int = 64) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for each row of ``pages(page_id, url)``.

    ``rules(host, path, verdict)`` with verdict ``allow`` or ``block``.  The
    range bounds come from about ``sample`` keys a range (of 512 characters at
    most); they place rows, they don't change the result.
    """
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType.simpleString()
    host, path = host_and_path()
    urls = (pages.select("page_id", "url", host.alias("host"), path.alias("path"))
            .withColumn("key", host_key(F.col("host")))
            .withColumn("spot", F.concat("key", F.lit("\0"), F.hex(F.xxhash64("page_id", "url")))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows whose hash falls under a share, so about ``sample`` keys a range reach the driver, however many rows there are.
    grain = 1 << 40
    share = max(1, int(grain * min(1.0, sample * parts / max(1, pages.count()))))
    some = urls.where(F.pmod(F.xxhash64("page_id", "url", F.lit(1)), F.lit(grain)) < share)
    picked = sorted(r.spot for r in some.select(F.substring("spot", 1, 512).alias("spot")).collect())
    bounds = [picked[i * len(picked) // parts] for i in range(1, parts)] if picked else []

    def dealt(batches):
        for b in batches:
            part = [bisect_right(bounds, s) for s in b.column("spot").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *b.columns[:-1]], ["part", *b.schema.names[:-1]])

    def spread(batches):
        for b in batches:
            keys = b.column("key").to_pylist()
            spans = [list(range(bisect_right(bounds, k), bisect_right(bounds, k[:-1] + "/") + 1)) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(spans, pa.list_(pa.int32())), *b.columns],
                                             ["parts", *b.schema.names])

    cols = f"key string, kind int, path string, page_id {kind}, host string, verdict string"
    names = ["key", "kind", "path", "page_id", "host", "verdict"]
    left = (urls.withColumn("kind", F.lit(1)).withColumn("verdict", F.lit(None).cast("string"))
            .select(*names, "spot").mapInArrow(dealt, f"part int, {cols}"))
    right = (rules.where("host is not null and path is not null and verdict is not null")
             .select(host_key(F.col("host")).alias("key"), F.lit(0).alias("kind"), "path",
                     F.lit(None).cast(kind).alias("page_id"), "host", "verdict")
             .mapInArrow(spread, f"parts array<int>, {cols}")
             .select(F.explode("parts").alias("part"), *names))
    return (left.unionByName(right).repartitionById(parts, "part").sortWithinPartitions("part", "key", "kind")
            .select(*names).mapInArrow(sweep, f"page_id {kind}, host string, path string, rule string, verdict string"))
