"""A flipped byte is found, in its range."""

import hashlib

from pyspark.sql import functions as F

from sonoframe.sources import integrity


def test_a_flipped_byte_is_located(spark, tmp_path):
    data = {f"m{k}.bin": bytes((k * 31 + j * j) % 256 for j in range(size)) for k, size in enumerate((1, 999, 1000, 5001, 4000))}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    listed = lambda: spark.read.format("binaryFile").load(str(tmp_path)).select("path", "length")
    manifest = integrity.digest_files(listed(), 1000)
    rows = manifest.collect()
    assert {(r.path.rsplit("/", 1)[1], r.part): (r.bytes, r.sha256) for r in rows} == {(name, k): (len(c[k * 1000 : k * 1000 + 1000]), hashlib.sha256(c[k * 1000 : k * 1000 + 1000]).hexdigest()) for name, c in data.items() for k in range(max(1, -(-len(c) // 1000)))}
    kept = spark.createDataFrame(rows, integrity.DIGESTS)
    assert {r.verdict for r in integrity.verdicts(manifest, kept).collect()} == {"intact"}
    (tmp_path / "m3.bin").write_bytes(data["m3.bin"][:2500] + bytes([data["m3.bin"][2500] ^ 1]) + data["m3.bin"][2501:])
    (tmp_path / "m2.bin").write_bytes(data["m2.bin"] + b"x")
    (tmp_path / "m1.bin").unlink()
    (tmp_path / "new.bin").write_bytes(b"n")
    found = {r.path.rsplit("/", 1)[1]: (r.verdict, r.bad) for r in integrity.verdicts(integrity.digest_files(listed(), 1000), kept).collect()}
    assert found == {"m0.bin": ("intact", []), "m1.bin": ("missing", [0]), "m2.bin": ("size", [1]), "m3.bin": ("changed", [2]), "m4.bin": ("intact", []), "new.bin": ("unknown", [0])}
    assert integrity.digest_files(listed().where(F.lit(False))).count() == 0
