import io

import numpy as np
import pytest

from tessera.llm import sstable

from . import plain
from .test_packing import encoded


def shard(tmp_path, entries, block_bytes=100):
    out = io.BytesIO()
    w = sstable.ShardWriter(out, block_bytes)
    for doc, ids in entries:
        w.add(sstable.pack_key(doc), np.array(ids, "<u4").tobytes())
    assert w.close() == len(out.getvalue())
    path = tmp_path / "a.sst"
    path.write_bytes(out.getvalue())
    return path


def test_round_trip_and_lookup(tmp_path):
    entries = [(None, [1]), (-5, [7, 8]), (0, []), (3, [70000, 1]), (3, [9]), *[(k, [k, k + 1, 1]) for k in range(10, 400)]]
    reader = sstable.ShardReader(f"file://{shard(tmp_path, entries)}")
    assert [(sstable.unpack_key(k), ids.tolist()) for k, _, ids in reader.scan()] == entries
    starts = np.cumsum([0] + [len(i) for _, i in entries])[:-1].tolist()
    assert [s for _, s, _ in reader.scan()] == starts
    assert len(reader.index) > 10 and reader.entries == len(entries)
    assert reader.get(200).tolist() == [200, 201, 1] and reader.get(3).tolist() == [70000, 1] and reader.get(None).tolist() == [1]
    assert reader.get(5) is None and reader.get(10**9) is None
    assert sum(reader.may_contain(sstable.pack_key(k)) for k in range(10**6, 10**6 + 1000)) < 50


def test_damage_is_found(tmp_path):
    path = shard(tmp_path, [(k, [k] * 30) for k in range(50)])
    data = bytearray(path.read_bytes())
    data[20] ^= 1
    path.write_bytes(data)
    with pytest.raises(ValueError):
        list(sstable.ShardReader(f"file://{path}").scan())
    path.write_bytes(bytes(data[:-9]))
    with pytest.raises(ValueError):
        sstable.ShardReader(f"file://{path}")


def test_keys_out_of_order():
    w = sstable.ShardWriter(io.BytesIO())
    w.add(sstable.pack_key(5), b"")
    with pytest.raises(ValueError):
        w.add(sstable.pack_key(4), b"")


def test_documents(spark):
    docs = [(5, "five words are in here"), (1, None), (3, ""), (3, "again"), (None, "no id"), (-2, "minus"), (9, "long " * 5000), (5, "five words are in here")]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, start int")
    manifest = sstable.write(frame, shard_bytes=64, block_bytes=16)
    got = sorted(map(tuple, sstable.read(manifest).collect()), key=lambda r: r[1])
    at, want = 0, []
    for d, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = encoded(t)
        want.append((d, at, len(ids), plain.crc(ids)))
        at += len(ids)
    assert got == want
    made = manifest.collect()
    assert sstable.lookup(made, -2).tolist() == encoded("minus") and sstable.lookup(made, 4) is None


def test_empty(spark):
    assert sstable.read(sstable.write(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
