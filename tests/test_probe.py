import random

import pytest

from provena.sources import ldb


def records(rng, n, width, shards):
    keys = [bytes([rng.choice(shards), 0, rng.randrange(4), rng.randrange(256)]) + rng.randbytes(width - 4) for _ in range(n)]
    return [(k, bytes([i % 256]) * 18 if width == 4 else b"r%d" % i) for i, k in enumerate(keys + keys[: n // 2])]


@pytest.mark.parametrize("record_len", [0, 18])
def test_probe_finds_what_a_full_read_finds(spark, tmp_path, record_len):
    rng = random.Random(record_len)
    held = records(rng, 300, 4 if record_len else 16, [0x00, 0x7F, 0xFF])
    folder = tmp_path.as_uri()
    ldb.write_shards(spark.createDataFrame(held, "key binary, record binary"), folder, record_len, node_bytes=200).collect()
    digits = 8 if record_len else 32
    asked = rng.sample(sorted({k.hex() for k, _ in held}), 60)
    strange = [asked[0].upper(), asked[1], None, "7f" * (digits // 2), "01" * (digits // 2), asked[2][:6] + "0" * (digits - 6)]
    keys = spark.createDataFrame([(k,) for k in asked + strange], "key string").repartition(5)
    got = ldb.probe(keys, folder, record_len).collect()
    ldb.register(spark)
    full = spark.read.format("ldb").option("record_len", record_len).load(folder).collect()
    want = {k.lower() for k in asked + strange if k}
    assert sorted(map(tuple, got)) == sorted(tuple(r) for r in full if r.key in want) and len(got) >= 60
    assert not [f for f in tmp_path.iterdir() if f.suffix != ".ldb" and f.name.startswith(".") and not f.name.endswith(".crc")]


def test_bytes_grow_with_the_keys(spark, tmp_path):
    rng = random.Random(1)
    held = records(rng, 2000, 16, [0x00])
    ldb.write_shards(spark.createDataFrame(held, "key binary, record binary"), tmp_path.as_uri()).collect()
    some = sorted({k.hex() for k, _ in held})
    used = []
    for n in (1, 10, 100):
        counter = spark.sparkContext.accumulator(0)
        keys = spark.createDataFrame([(k,) for k in rng.sample(some, n)], "key string")
        assert ldb.probe(keys, tmp_path.as_uri(), counter=counter).count() >= n
        used.append(counter.value)
    assert used[0] < 2000 and used[2] < 100 * 2000 and 5 * used[0] < used[1] * 10 and used[1] < used[2]  # the map alone has 84 million bytes


def test_faulty_keys_and_none(spark, tmp_path):
    ldb.write_shards(spark.createDataFrame([(bytes(16), b"x")], "key binary, record binary"), tmp_path.as_uri()).collect()
    assert ldb.probe(spark.createDataFrame([], "key string"), tmp_path.as_uri()).collect() == []
    with pytest.raises(Exception, match="hexadecimal"):
        ldb.probe(spark.createDataFrame([("xyz",)], "key string"), tmp_path.as_uri()).collect()
