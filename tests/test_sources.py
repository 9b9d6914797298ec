import zipfile

import pytest
from pyspark.sql import functions as F

from lodegraph.functions import scalars
from lodegraph.sources import readers


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name, text in (("src/a.ts", "x"), ("../evil.ts", "y"), ("/abs.ts", "z"), ("src/b.py", "w" * 10), ("a/b/c/d.ts", "q")):
            z.writestr(name, text)
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    rows = readers.archive_entries(spark, str(tmp_path), max_depth=2).cache()
    got = {(r.archive.rsplit("/", 1)[1], r.path, r.status) for r in rows.collect()}
    assert got == {("a.zip", "src/a.ts", "OK"), ("a.zip", "../evil.ts", "TRAVERSAL"), ("a.zip", "/abs.ts", "ABSOLUTE"), ("a.zip", "src/b.py", "OK"), ("a.zip", "a/b/c/d.ts", "LIMIT"), ("broken.zip", None, "CORRUPT")}
    m = readers.manifest(rows)
    assert {(r.path, r.size_bytes, r.classification) for r in m.collect()} == {("src/a.ts", 1, "SOURCE_CODE"), ("src/b.py", 10, "SOURCE_CODE")}
    import hashlib

    want = hashlib.sha256((hashlib.sha256(b"x").hexdigest() + hashlib.sha256(b"w" * 10).hexdigest()).encode()).hexdigest()
    assert readers.repository_hash(m).first().repository_hash == want


def test_folder_scan(spark, tmp_path):
    for p in ("src/a.ts", "node_modules/b.js", ".hidden", "src/run.exe"):
        (tmp_path / p).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / p).write_text("x")
    assert [r.path.rsplit("/", 1)[1] for r in readers.folder_files(spark, str(tmp_path)).collect()] == ["a.ts"]


def test_write_refuses_frozen(spark, tmp_path):
    n = spark.createDataFrame([("1", "s")], "id string, snapshot_id string")
    e = spark.createDataFrame([("2", "s")], "id string, snapshot_id string")
    readers.write_snapshot(n, e, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/nodes").where("snapshot_id = 's'").count() == 1
    with pytest.raises(ValueError):
        readers.write_snapshot(n, e, str(tmp_path), frozen=("s",))


def test_scalars(spark):
    df = spark.createDataFrame([("src/a/B.Test.TS",), ("x",), (".env",), ("a/b.min.js",)], "p string")
    p = F.col("p")
    got = [tuple(r) for r in df.select(scalars.namespace(p), scalars.extension(p), scalars.module_path(p), scalars.file_class(p)).collect()]
    assert got == [("src/a", ".ts", "src/a", "TEST"), ("root", "", "x", "UNKNOWN"), ("root", "", ".env", "SECRET"), ("a", ".js", "a", "GENERATED")]
    h = 0
    for c in "abc":
        h = (h * 31 + ord(c)) % (1 << 32)
    digits, out = "0123456789abcdefghijklmnopqrstuvwxyz", ""
    while h:
        h, r = divmod(h, 36)
        out = digits[r] + out
    assert spark.range(1).select(scalars.rolling_checksum(F.lit("abc"))).first()[0] == out
