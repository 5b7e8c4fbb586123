"""Archives: what comes back, equal bytes from any cluster, nothing of failed attempts, damage is seen."""

import base64
import gzip
import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F

from paperweave.llm import warc as W

SCHEMA = "page_id long, url string, html string, URL2 string, body string"
PAGES = [
    (5, "http://a.example/x y?q=ü\r\nEvil: 1", "<p>one</p>", "", ""),
    (2, None, "<p>one</p>", "", ""),
    (9, "http://a.example/", "<p>one</p>", "", ""),
    (1, "http://b.example/", None, "", ""),
    (3, "", "", "", ""),
    (7, "http://c.example/", "\r\n\r\nWARC/1.1\r\n\r\n" * 3 + "é🙂", "", ""),
    (8, "http://d.example/", "z" * 3_000_000, "", ""),
    (None, "http://e.example/", "<p>one</p>", "", ""),
    (None, None, "alone", "", ""),
    (4, "http://f.example/", "twice", "", ""),
    (4, "http://f.example/", "twice", "", ""),
]


def expected(rows, least=0):
    first = {}
    for p, _, h, *_ in rows:
        b = (h or "").encode()
        if p is not None:
            first[b] = min(p, first.get(b, p))
    out = []
    for p, _, h, *_ in rows:
        b = (h or "").encode()
        of = first.get(b) if len(b) >= least else p
        again = len(b) >= least and of is not None and of != p
        out.append((p, "revisit" if again else "response", len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), of if again else None))
    return sorted(out, key=repr)


def names(root):
    return sorted(f for f in os.listdir(root) if f.endswith(".gz"))


@pytest.mark.parametrize("least", [0, 1, 11])
def test_round_trip(spark, tmp_path, least):
    root = str(tmp_path / "a")
    W.write_warc(spark.createDataFrame(PAGES, SCHEMA), root, least, shard_bytes=1 << 20, roll_bytes=1 << 10)
    got = W.read_warc(spark, root).collect()
    assert sorted(((r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in got), key=repr) == expected(PAGES, least)
    assert sorted(((r.page_id, r.url) for r in got), key=repr) == sorted(((p[0], p[1]) for p in PAGES), key=repr)
    for r in got:
        if r.record_type == "response":
            assert bytes(r.payload) in [(p[2] or "").encode() for p in PAGES if p[0] == r.page_id]
    assert len(names(root)) > 1 and not os.path.exists(f"{root}/_temporary") and not os.path.exists(f"{root}/_manifest")


def test_files_are_archives(spark, tmp_path):
    """Read without this library: gzip members, headers, digests, one header a line whatever the address holds."""
    root = str(tmp_path / "a")
    W.write_warc(spark.createDataFrame(PAGES, SCHEMA), root)
    raw = b"".join(open(f"{root}/{n}", "rb").read() for n in names(root))
    assert raw.count(b"\x1f\x8b\x08\x00\x00\x00\x00\x00") == len(PAGES)
    text, n = gzip.decompress(raw), 0
    while text:
        head, _, rest = text.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode("ascii").split("\r\n")[1:])
        assert "Evil" not in headers and re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", headers["WARC-Record-ID"])
        block = rest[: (size := int(headers["Content-Length"]))]
        assert headers["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        assert ("WARC-Refers-To" in headers) == (headers["WARC-Type"] == "revisit")
        assert rest[size : size + 4] == b"\r\n\r\n"
        text, n = rest[size + 4 :], n + 1
    assert n == len(PAGES)


def test_equal_bytes_from_any_plan(spark, tmp_path):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://x/"), "id").alias("url"), F.repeat(F.concat(F.lit("text "), F.col("id") % 700), 30).alias("html"))
    found = []
    for i, frame in enumerate((pages.repartition(7), pages.orderBy(F.desc("page_id")).coalesce(2))):
        spark.conf.set("spark.sql.shuffle.partitions", 3 + i)
        root = str(tmp_path / str(i))
        W.write_warc(frame, root, shard_bytes=100_000, roll_bytes=5_000)
        found.append({n: hashlib.sha256(open(f"{root}/{n}", "rb").read()).hexdigest() for n in names(root)})
        sizes = [os.path.getsize(f"{root}/{n}") for n in names(root)]
        assert max(sizes) < 5_000 + 2_000 and len(sizes) > 10
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found[0] == found[1]
    ids = [r.page_id for r in W.read_warc(spark, str(tmp_path / "0")).collect()]
    assert sorted(ids) == list(range(3000))


def test_shards_are_even_with_outlying_ids(spark):
    rows = spark.range(5000).select((F.pow(F.col("id").cast("double"), 4)).cast("long").alias("page_id"), F.lit(100).cast("long").alias("_size"), F.col("id").cast("string").alias("sha"))
    bounds = W._bounds(rows, 20_000)
    at = sorted(r.page_id for r in rows.collect())
    cut = [0, *[sum(1 for x in at if x < b) for b in bounds], len(at)]
    assert len(bounds) == 24 and max(b - a for a, b in zip(cut, cut[1:], strict=False)) < 2.5 * 200


def test_what_fails_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "a")
    pages = spark.createDataFrame(PAGES, SCHEMA)
    broken = pages.withColumn("html", F.when(F.col("page_id") == 8, F.raise_error(F.lit("lost"))).otherwise(F.col("html")))
    with pytest.raises(Exception, match="lost"):
        W.write_warc(broken, root)
    with pytest.raises(Exception, match="manifest|PATH_NOT_FOUND"):
        W.read_warc(spark, root).collect()
    # files of an attempt whose task was repeated stay out
    os.makedirs(f"{root}/_temporary", exist_ok=True)
    open(f"{root}/_temporary/old-000000-00000", "wb").write(W.gzip_member(W.Page(99, None, b"x").record("2024-01-01T00:00:00Z")))
    open(f"{root}/part-999999-00000.warc.gz", "wb").write(b"not named")
    W.write_warc(pages, root)
    assert W.read_warc(spark, root).count() == len(PAGES)
    with pytest.raises(FileExistsError):
        W.write_warc(pages, root)


def test_damage_is_seen(spark, tmp_path):
    root = str(tmp_path / "a")
    W.write_warc(spark.createDataFrame(PAGES, SCHEMA), root)
    path = f"{root}/{names(root)[0]}"
    whole = open(path, "rb").read()
    for bad in (whole[:-9], whole + W.gzip_member(W.Page(99, None, b"x").record("2024-01-01T00:00:00Z")), whole[:200] + bytes([whole[200] ^ 1]) + whole[201:]):
        os.path.exists(f"{root}/.{names(root)[0]}.crc") and os.remove(f"{root}/.{names(root)[0]}.crc")
        open(path, "wb").write(bad)
        with pytest.raises(Exception):  # noqa: B017
            W.read_warc(spark, root).collect()


def test_empty(spark, tmp_path):
    root = str(tmp_path / "a")
    W.write_warc(spark.createDataFrame([], SCHEMA), root)
    assert W.read_warc(spark, root).count() == 0


def test_members_across_blocks():
    bodies = [os.urandom(n) for n in (0, 1, 5000)]
    raw = b"".join(map(W.gzip_member, bodies))
    for n in (1, 3, 1000, 10**6):
        assert list(W.members(raw[i : i + n] for i in range(0, len(raw), n))) == bodies
    with pytest.raises(ValueError):
        list(W.members([raw[:-3]]))
