"""Bronze as received bytes, and the pointer of the current run."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lodestat.sources import layers, store


def contents():
    draw = random.Random(3)
    noise = bytes(draw.randrange(256) for _ in range(30_000))
    text = "a;b\r\nÉlise;1\nZoé;2"
    return {
        "utf8.csv": text.encode(), "marked.csv": text.encode("utf-8-sig"), "marked_end.csv": (text + "\n").encode("utf-8-sig"),
        "wide.csv": text.encode("utf-16"), "wide_be.csv": text.encode("utf-32-be"), "latin.csv": text.encode("latin-1"),
        "noise.bin": noise, "lines.csv": b"x;y\n" * 20_000, "ends.csv": b"\n\n\n", "one.csv": b"x", "end.csv": b"\n",
        "empty.csv": b"", "mark.csv": b"\xef\xbb\xbf", "packed.csv.gz": gzip.compress(text.encode(), mtime=0), "long.csv": b"z" * 70_000,
    }


@pytest.mark.parametrize("size", [100, 1 << 22])
def test_files_come_back_byte_by_byte(spark, tmp_path, size):
    for name, data in contents().items():
        (tmp_path / name).write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = layers.received_ranges(spark, str(tmp_path), size).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    back = {}
    for r in sorted(rows, key=lambda r: (r.fichier, r.bloc, r.rang)):
        assert r.octets == len(r.contenu) and r.sha256 == hashlib.sha256(r.contenu).hexdigest()
        back[r.fichier.rsplit("/", 1)[1]] = back.get(r.fichier.rsplit("/", 1)[1], b"") + bytes(r.contenu)
    assert back == {name: data for name, data in contents().items() if data}  # Spark passes over empty files
    assert len({(r.fichier, r.bloc, r.rang) for r in rows}) == len(rows)


def test_damage_shows(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"x;y\n1;2\n")
    ranges = layers.received_ranges(spark, str(tmp_path))
    assert layers.damaged_ranges(ranges).count() == 0
    assert layers.damaged_ranges(ranges.withColumn("contenu", F.expr("CAST('x;y' AS BINARY)"))).count() == 1


def archived(spark, root, version):
    return layers.archive_run(layers.run_record(spark, {"version": version}), root, "20260101T000000", version)


def test_a_failure_before_the_pointer_leaves_the_old_run(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    with pytest.raises(ValueError):
        layers.current_run(spark, root)
    first = archived(spark, root, "1.0")

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(store, "write_once", fails)
        with pytest.raises(OSError):
            archived(spark, root, "1.1")
    assert layers.current_name(spark, root) == first
    assert layers.current_run(spark, root).first()["version"] == "1.0"
    assert layers.history(spark, root).count() == 2


def test_rollback(spark, tmp_path):
    root = str(tmp_path)
    first, second, third = (archived(spark, root, v) for v in ("1.0", "1.1", "1.2"))
    assert layers.rollback(spark, root) == second == layers.current_name(spark, root)
    assert layers.rollback(spark, root, first) == first
    assert spark.read.parquet(f"{root}/current").first()["run"] == first
    assert archived(spark, root, "1.3") == layers.current_name(spark, root) != third
    with pytest.raises(ValueError):
        layers.rollback(spark, root, "never")
    with pytest.raises(FileExistsError):
        store.write_once(spark, f"{root}/pointers/00000001", "x")
