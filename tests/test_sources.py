import os
import threading

import pyarrow as pa
import pytest

from columnforge import queries
from columnforge.errors import InvalidError, NoElementsError, SourceError, UnsupportedError
from columnforge.plans import flightsql
from columnforge.sources import cdata, flight, ipc
from columnforge.streaming import messages

BATCH = pa.record_batch({"one": pa.array([True, False, None, False, True]), "two": ["zero", "one", "two", "three", "four"]})


@pytest.fixture
def formats(spark):
    ipc.register(spark)
    return spark


def test_file_fixtures(formats, tmp_path):
    tables = [pa.table(BATCH.to_pydict()), pa.table({"one": [1.1, 2.2], "two": ["zero", None]}), pa.table({"my struct": pa.array([{"my string": "0", "my bool": False}, None])})]
    for k, t in enumerate(tables):
        path = str(tmp_path / f"{k}.arrow")
        with pa.ipc.new_file(path, t.schema) as out:
            out.write_table(t)
        assert formats.read.format("colipc").load(path).toArrow().to_pylist() == t.to_pylist()


def test_batches_with_bad_offsets_can_be_built_and_are_refused():
    for offsets in ([0, 1, 3], [0, 1, 9], [0, 2, 1]):
        batch = queries._with_offsets(offsets)
        assert pa.Array.from_buffers(pa.int32(), 3, [None, batch.column(0).buffers()[1]]).to_pylist() == offsets
        if offsets == [0, 1, 3]:
            assert ipc.legal_batch(batch, None).to_pydict() == {"l": [[1], [2, 3]]}
            continue
        with pytest.raises(SourceError):
            ipc.legal_batch(batch, None)


def test_blocks_and_columns(formats, tmp_path):
    path = str(tmp_path / "a.arrow")
    t = pa.table({"k": list(range(100)), "u": pa.array(range(100), pa.uint32()), "v": [str(x) for x in range(100)]})
    with pa.ipc.new_file(path, t.schema) as out:
        out.write_table(t, max_chunksize=10)
    read = lambda **o: formats.read.format("colipc").options(**o).load(path)
    for options, parts in (({}, 1), ({"split": "batch"}, 10), ({"partitionBytes": 1000}, -(-os.path.getsize(path) // 1000))):
        df = read(**options)
        assert df.rdd.getNumPartitions() == parts and dict(df.dtypes)["u"] == "bigint"
        assert sorted(r.k for r in df.collect()) == list(range(100))
    assert read(columns="v").columns == ["v"]
    # only the wanted columns' buffers are read
    assert ipc.open_file(path, ["v"]).get_batch(0).schema.names == ["v"] and read(columns="v,k").toArrow().to_pylist()[7] == {"v": "7", "k": 7}
    with pytest.raises(InvalidError):
        ipc.open_file(path, ["nope"])


def test_empty_and_damaged_files(formats, tmp_path):
    with pa.ipc.new_file(str(tmp_path / "none.arrow"), BATCH.schema):
        pass
    assert formats.read.format("colipc").load(str(tmp_path / "none.arrow")).count() == 0
    (tmp_path / "bad.arrow").write_bytes(b"ARROW1 but not really")
    with pytest.raises(SourceError):
        ipc.open_file(str(tmp_path / "bad.arrow"))
    with pytest.raises(SourceError):
        ipc.listed(str(tmp_path / "absent"))
    with pytest.raises(SourceError):
        ipc.open_store("not/absolute")


@pytest.mark.parametrize("kind", ["colipc", "colstream"])
def test_overwrite_and_append(formats, tmp_path, kind):
    path = str(tmp_path / "out")
    formats.range(10).repartition(3).write.format(kind).mode("append").save(path)
    formats.range(5).write.format(kind).mode("append").save(path)
    assert formats.read.format(kind).load(path).count() == 15
    formats.range(3).write.format(kind).mode("overwrite").save(path)
    assert formats.read.format(kind).load(path).count() == 3


def test_streaming_source(formats, tmp_path):
    path, out = tmp_path / "in", []
    path.mkdir()

    def put(name, rows):
        with pa.ipc.new_file(str(path / f".{name}"), BATCH.schema) as sink:
            sink.write_batch(BATCH.slice(0, rows))
        (path / f".{name}").rename(path / name)

    put("1.arrow", 2)
    query = formats.readStream.format("colipc").load(str(path)).writeStream.foreachBatch(lambda df, _: out.append(df.count())).option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        put("2.arrow", 5)
        query.processAllAvailable()
    finally:
        query.stop()
    assert sum(out) == 7


def test_messages():
    schema = messages.encode_schema(BATCH.schema)
    assert messages.decode_schema(schema) == BATCH.schema
    header, body = messages.encode_batch(BATCH)
    assert header and body
    result = messages.Result()
    with pytest.raises(SourceError):
        result.take(BATCH.serialize().to_pybytes())
    result.take(schema)
    for _ in range(2):
        result.take(BATCH.serialize().to_pybytes())
    assert result.schema == BATCH.schema and [b.num_rows for b in result.batches] == [5, 5]
    data = messages.to_stream([BATCH, BATCH], BATCH.schema)
    assert sum(b.num_rows for b in messages.from_stream(data)) == 10
    with pytest.raises(SourceError):
        list(messages.from_stream(b"junk"))


def test_c_data(spark):
    text = pa.array([None if i % 10 == 9 else f"test{i}" for i in range(100)])
    exported = cdata.export_array(text, "col1")
    assert cdata.format_of(exported) == "u"
    name, back = cdata.import_array(exported)
    assert name == "col1" and back.equals(text)
    with pytest.raises(InvalidError):
        cdata.import_array(exported)  # taken already
    for bad in (pa.array([[1]]), pa.array(["a"]).dictionary_encode(), pa.array([1, 2, 3]).slice(1), pa.array(["a"], pa.string_view())):
        other = cdata.export_array(bad)
        with pytest.raises(InvalidError):
            cdata.import_array(other)
        other.release()


@pytest.fixture(scope="module")
def served(spark):
    registry = flight.Registry(spark)
    server = flight.Server(registry)
    threading.Thread(target=server.serve, daemon=True).start()
    client = flight.Client(f"grpc://127.0.0.1:{server.port}")
    yield registry, client, f"grpc://127.0.0.1:{server.port}"
    client.close()
    server.shutdown()


def test_flight_calls(spark, served):
    registry, client, location = served
    seen = []
    assert client.do_put(flight.Descriptor(("t",)), [BATCH, BATCH, BATCH], seen.append) == 15 and seen
    info = client.get_info(flight.Descriptor(("t",)))
    got = [b for t in info.tickets for b in client.do_get(t)]
    assert sum(b.num_rows for b in got) == 15 and client.get_schema(flight.Descriptor(("t",))) == BATCH.schema
    raw = [m for t in info.tickets for m in client.do_get_messages(t)]
    assert messages.decode_schema(raw[0][0]) == BATCH.schema
    assert [i.descriptor.name for i in client.list_flights("t%")] == ["t"] and client.list_flights("x%") == []
    registry.actions["echo"] = ("gives back", lambda body: [body, body])
    assert client.list_actions() == [("echo", "gives back")] and client.do_action("echo", b"a") == [b"a", b"a"]
    with pytest.raises(Exception, match="no action"):
        client.do_action("none")
    assert sum(b.num_rows for b in client.do_exchange(flight.Descriptor(("t",)), [BATCH] * 4)) == 20
    with pytest.raises(NoElementsError):
        client.do_put(flight.Descriptor(("t",)), [])
    with pytest.raises(NoElementsError):
        client.do_exchange(flight.Descriptor(("t",)), [])
    with pytest.raises(Exception, match="no flight"):
        client.get_schema(flight.Descriptor(("absent",)))
    for call in (client.handshake, client.poll_info):
        with pytest.raises(UnsupportedError):
            call()
    with pytest.raises(InvalidError):
        flight.Ticket.decode(b"?")
    assert registry.relation().count() == 1


def test_flight_source_has_a_partition_for_each_endpoint(spark, served):
    registry, client, location = served
    registry.put("many", spark.range(100).repartition(2))
    flight.register(spark)
    df = spark.read.format("colflight").options(location=location, flight="many").load()
    assert df.rdd.getNumPartitions() == 2 and sorted(r.id for r in df.collect()) == list(range(100))


def test_facade(spark):
    facade = flightsql.Facade(spark)
    handle = facade.prepare("SELECT :x + 1 AS y")
    facade.bind(handle, {"x": 1})
    assert facade.execute(handle).first().y == 2
    facade.close(handle)
    with pytest.raises(InvalidError):
        facade.execute(handle)
    with pytest.raises(InvalidError):
        facade.fetch("none")
    assert facade.schema("SELECT 1 AS a").fieldNames() == ["a"]
    df = spark.range(3)
    facade.ingest(df, "stored")
    with pytest.raises(InvalidError):
        facade.ingest(df, "stored")
    facade.ingest(df, "stored", if_exists="append")
    assert spark.table("stored").count() == 6
    facade.ingest(df, "stored", if_exists="replace")
    assert spark.table("stored").count() == 3
    assert facade.update("INSERT INTO stored VALUES (9)") == -1 and spark.table("stored").count() == 4
    assert facade.tables("stor_d", ["TABLE"], include_schema=True).count() == 1
    spark.sql("DROP TABLE stored")
    with pytest.raises(InvalidError):
        facade.ingest(df, "stored", if_not_exists="fail")
    with pytest.raises(InvalidError):
        facade.ingest(df, "stored", if_exists="merge")
    for call in (facade.begin_transaction, facade.begin_savepoint, lambda: facade.substrait(b"")):
        with pytest.raises(UnsupportedError):
            call()
    facade.declare_key("a", "id")
    facade.declare_key("b", "a_id", "foreign", "a", "id")
    assert facade.primary_keys("a").count() == 1 and facade.exported_keys("a").count() == 1 and facade.imported_keys("b").count() == 1
    with pytest.raises(InvalidError):
        facade.declare_key("a", "id", "foreign")
    assert facade.run_tagged("SELECT 1", "tag").count() == 1 and facade.cancel("tag") == []
    assert flightsql.like("a\\%_%").fullmatch("a%bcd") and not flightsql.like("a\\%_%").fullmatch("abcd")
