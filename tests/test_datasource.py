"""Files as a data source: the same rows as the scan's, empty files among them, and as a stream."""

import pytest

from bifolio.sources import datasource, files


def made(folder):
    (folder / "sub" / "deep").mkdir(parents=True)
    for name, data in {"a.txt": b"# One\n\ntext", "empty.txt": b"", "sub/b.MD": b"caf\xe9", "sub/deep/no suffix": b"x", "sub/c.docx": b"no zip", "_hidden.txt": b"h", "sub/.dot": b"d", "é ü.txt": "ñ".encode()}.items():
        (folder / name).write_bytes(data)


def test_rows_equal_the_scans(spark, tmp_path):
    made(tmp_path)
    found = datasource.scan(spark, f"file://{tmp_path}", partitionBytes=str(datasource.OPEN_BYTES + 8))
    key = lambda r: (r["path"], r["name"], r["suffix"], r["sha256"], bytes(r["content"]))
    want = files.scan(spark, f"file://{tmp_path}").collect()
    assert sorted(map(key, found.collect())) == sorted(map(key, want)) and {r["name"] for r in want} == {"a.txt", "empty.txt", "b.MD", "no suffix", "c.docx", "é ü.txt"}
    assert found.rdd.getNumPartitions() > 2
    documents, _, blocks = files.read(found)
    assert documents.count() == 6 and {(r["kind"], r["text"]) for r in blocks.collect()} == {("heading", "One"), ("paragraph", "text"), ("paragraph", "café"), ("paragraph", "ñ")}
    one = datasource.scan(spark, f"file://{tmp_path}/a.txt", f"file://{tmp_path}/sub")
    assert sorted(r["name"] for r in one.collect()) == ["a.txt", "b.MD", "c.docx", "no suffix"]
    (tmp_path / "none").mkdir()
    assert datasource.scan(spark, f"file://{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="gone"):
        datasource.scan(spark, f"file://{tmp_path}/gone").count()


def test_stream_of_files(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    made(folder)

    def run():
        batches = []
        stream = datasource.scan_stream(spark, f"file://{folder}")
        query = stream.writeStream.foreachBatch(lambda df, n: batches.append(sorted(r["name"] for r in df.collect()))).option("checkpointLocation", f"file://{tmp_path}/check").start()
        query.processAllAvailable()
        query.stop()
        seen.extend(x for b in batches for x in b)
        return [b for b in batches if b]

    assert len(run()) == 1 and sorted(seen) == sorted(["a.txt", "empty.txt", "b.MD", "no suffix", "c.docx", "é ü.txt"])
    (folder / "later.txt").write_text("more")
    assert run() == [["later.txt"]]
