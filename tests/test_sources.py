"""Edge files as a data source: pruned columns, commits and aborts, other file systems, and replays that stop in the middle."""

import struct

import pytest
from pyspark.sql import functions as F

from tidegraph.sources import edgefiles, edgesource
from tidegraph.streaming import online


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def edges(spark):
    return spark.range(900).select((F.col("id") % 60).alias("src"), (F.col("id") * 7 % 61).alias("dst"), (F.col("id") / 4).alias("weight")).persist()


@pytest.mark.parametrize("record", [8, 12, 16])
def test_format_round_trip(spark, edges, record, tmp_path, monkeypatch):
    monkeypatch.setattr(edgesource, "SPLIT", 100 * record)  # for the driver's part; workers have their own
    names = list(edgesource.RECORDS[record].names)
    written = edges.select(*names)
    edgesource.registered(spark)
    written.write.format("edgefiles").option("record", record).mode("append").save(f"{tmp_path}/e")
    read = lambda: spark.read.format("edgefiles").option("record", record)
    assert rows(read().load(f"{tmp_path}/e")) == rows(written)
    assert rows(read().schema("dst long").load(f"{tmp_path}/e")) == rows(written.select("dst"))
    reader = edgesource.EdgeReader(f"{tmp_path}/e", record, ["dst"], False)
    splits = reader.partitions()
    assert len(splits) >= 9 and all((s.end - s.begin) % record == 0 for s in splits)
    batches = [b for s in splits for b in reader.read(s)]
    assert {b.schema.names[0] for b in batches} == {"dst"} and all(b.num_columns == 1 for b in batches)
    assert sorted(x for b in batches for x in b.column(0).to_pylist()) == [r[0] for r in rows(written.select("dst"))]
    # again, in place of what is there
    written.where("src < 5").write.format("edgefiles").option("record", record).mode("overwrite").save(f"{tmp_path}/e")
    assert rows(read().load(f"{tmp_path}/e")) == rows(written.where("src < 5"))


def test_a_failed_write_leaves_nothing_that_is_read(spark, edges, tmp_path):
    folder = f"{tmp_path}/e"
    edgefiles.write_binary(edges.where("src < 20"), folder)
    before = rows(edgefiles.read_binary(spark, folder))
    broken = edges.select("src", F.when(F.col("src") == 59, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("dst")).alias("dst")).repartition(6)
    with pytest.raises(Exception, match="lost"):
        edgefiles.write_binary(broken, folder)
    assert rows(edgefiles.read_binary(spark, folder)) == before
    # a writer that dies with its driver aborts nothing: its files lie there, and no manifest names them
    (tmp_path / "e" / "part-000000-other-0.bin").write_bytes(struct.pack("<II", 7, 7))
    assert rows(edgefiles.read_binary(spark, folder)) == before
    edgefiles.write_binary(edges.where("src = 30"), folder)
    assert rows(edgefiles.read_binary(spark, folder)) == sorted(before + rows(edges.where("src = 30").select("src", "dst")))
    with pytest.raises(FileNotFoundError):
        next((tmp_path / "e").glob("part-*-*[!r]-[0-9]*.bin")).unlink()
        edgefiles.read_binary(spark, folder)


def test_files_from_elsewhere_stay_when_more_come(spark, edges, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "old.bin").write_bytes(struct.pack("<IIII", 1, 2, 3, 4))
    edgefiles.write_binary(edges.where("src = 30"), str(tmp_path / "e"))
    assert rows(edgefiles.read_binary(spark, str(tmp_path / "e"))) == sorted([(1, 2), (3, 4)] + rows(edges.where("src = 30").select("src", "dst")))


def test_ids_beyond_a_record_are_refused(spark, tmp_path):
    for ends in ((2**32, 1), (-1, 1), (None, 1)):
        with pytest.raises(Exception, match="does not fit"):
            edgefiles.write_binary(spark.createDataFrame([ends], "src long, dst long"), f"{tmp_path}/e")
    with pytest.raises(Exception, match="no records of 9"):
        edgesource.registered(spark).read.format("edgefiles").option("record", 9).load(str(tmp_path))


def test_an_empty_table(spark, edges, tmp_path):
    edgefiles.write_binary(edges.where("src < 0"), f"{tmp_path}/e")
    assert edgefiles.read_binary(spark, f"{tmp_path}/e").count() == 0


@pytest.mark.parametrize("record", [8, 12, 16])
def test_any_file_system_of_hadoop(spark, edges, record, tmp_path):
    """A view of the local files, which Arrow alone cannot open."""
    names = list(edgesource.RECORDS[record].names)
    edgefiles.write_binary(edges, f"{tmp_path}/e", record)
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.edges{record}.link./data", f"file://{tmp_path}")
    assert not edgefiles._arrow_opens(f"viewfs://edges{record}/data/e")
    assert rows(edgefiles.read_binary(spark, f"viewfs://edges{record}/data/e", record)) == rows(edges.select(*names))
    (tmp_path / "e" / "part-odd.bin").write_bytes(b"1234567")
    with pytest.raises(ValueError):
        edgefiles.read_binary(spark, f"viewfs://edges{record}/data/e", record)


def test_replay_in_order_and_batches(spark, edges, tmp_path):
    edgefiles.write_in_order(edges, f"{tmp_path}/e", "weight")
    state = online.cc_replay(spark, f"{tmp_path}/e", 250, folder=f"{tmp_path}/state")
    assert [h[0] for h in state.history] == [0, 1, 2, 3]
    seen = {}  # labels by hand, batch by batch
    find = lambda x: x if seen.setdefault(x, x) == x else find(seen[x])
    for k in range(4):
        for e in range(250 * k, min(900, 250 * k + 250)):
            a, b = sorted((find(e % 60), find(e * 7 % 61)))
            seen[b] = a
        assert state.history[k][1] == sum(find(x) == x for x in list(seen))
    # more records come: only these are taken
    more = spark.createDataFrame([(500, 501), (501, 502)], "src long, dst long")
    edgefiles.write_binary(more.coalesce(1), f"{tmp_path}/e2")
    with pytest.raises(ValueError):
        edgesource.EdgeReplay(f"{tmp_path}/e", 8, ["weight"], False, 250, f"{tmp_path}/p")


@pytest.mark.parametrize("ahead", [1, 3, None])
def test_batches_taken_in_at_a_time(spark, ahead, tmp_path, monkeypatch):
    """Counts after every batch are the same however many are taken in at a time, and a small graph takes few jobs for many batches."""
    told = spark.range(120).select((F.col("id") * 5 % 83).alias("src"), (F.col("id") * 11 % 79).alias("dst"), F.col("id").alias("weight"))
    edgefiles.write_in_order(told, f"{tmp_path}/e", "weight")
    calls = []
    add = online.OnlineComponents.add
    monkeypatch.setattr(online.OnlineComponents, "add", lambda self, *a: calls.append(1) or add(self, *a))
    size = 35 if ahead == 1 else 10
    state = online.cc_replay(spark, f"{tmp_path}/e", size, ahead=ahead)
    assert len(calls) == (1 if ahead is None else 4)
    seen = {}
    find = lambda x: x if seen.setdefault(x, x) == x else find(seen[x])
    before, expected = 0, []
    for k in range(0, 120, size):
        for e in range(k, min(120, k + size)):
            a, b = sorted((find(e * 5 % 83), find(e * 11 % 79)))
            seen[b] = a
        n = sum(find(x) == x for x in list(seen))
        expected.append((k // size, n, len(seen) - n - before))
        before = len(seen) - n
    assert state.history == expected


def test_replay_goes_on_after_a_stop(spark, edges, tmp_path):
    """A batch fails after it was planned; the next query takes it again, whole, and nothing twice."""
    edgefiles.write_in_order(edges, f"{tmp_path}/e", "weight")
    took, fails = {}, [2]

    def take(batch, batch_id):
        got = [(r.src, r.dst) for r in batch.collect()]
        if fails and batch_id == fails[0]:
            fails.pop()
            raise RuntimeError("lost")
        assert batch_id not in took
        took[batch_id] = got

    def play():
        stream = edgesource.registered(spark).readStream.format("edgefiles").option("buffer", 200).option("progress", f"{tmp_path}/progress").load(f"{tmp_path}/e")
        query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{tmp_path}/log").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    with pytest.raises(Exception, match="lost"):
        play()
    assert sorted(took) == [0, 1]
    play()
    play()  # nothing is left
    assert {k: len(v) for k, v in took.items()} == {0: 200, 1: 200, 2: 200, 3: 200, 4: 100}
    assert sorted(x for v in took.values() for x in v) == rows(edges.select("src", "dst"))
    assert sorted(took[1]) == sorted((e % 60, e * 7 % 61) for e in range(200, 400))
