import json
import threading
import time
import urllib.error
import urllib.request

import pytest

from ledgerlight.operators import verify
from ledgerlight.service.http import serve
from ledgerlight.service.jobs import Jobs, redacted
from ledgerlight.sources import files
from ledgerlight.sources.dialect import DialectError, sniff
from ledgerlight.sources.store import Store


def write(tmp_path, data: bytes, name="x.csv"):
    (tmp_path / name).write_bytes(data)
    return f"file://{tmp_path}/{name}"


@pytest.mark.parametrize(("data", "want"), [
    (b"line,word\n1,x\n2,y\n", ("utf-8", ",", True, ("line", "word"))), (b"1,2\n3,4\n5,6\n", ("utf-8", ",", False, ("column0", "column1"))), ("name;price\nKäse;1,5\nBrot;2,5\n".encode("cp1252"), ("cp1252", ";", True, ("name", "price"))),
    ("\ufeffone|two\n1|2\n3|4\n".encode(), ("utf-8-sig", "|", True, ("one", "two"))), ("one\ttwo\n1\t2\n3\t4\n".encode("utf-16"), ("utf-16", "\t", True, ("one", "two"))), (b"a,b\n", ("utf-8", ",", True, ("a", "b"))),
])
def test_sniff(data, want):
    d = sniff(data, True)
    assert (d.encoding, d.delimiter, d.has_header, d.names) == want


def test_ragged_and_empty(spark, tmp_path):
    with pytest.raises(DialectError):
        sniff(b"a,b\n1,2\n1,2,3\n1,2\n", True)
    with pytest.raises(DialectError):
        sniff(b"  \n", True)
    late = b"a,b\n" + b"1,2\n" * 60_000 + b"1,2,3\n"
    with pytest.raises(DialectError, match="1 records"):
        files.load(spark, write(tmp_path, late))


def test_types_of_all_rows(spark, tmp_path):
    rows = [b"n,x,flag,day,at,text", b'1,1.5,true,2024-01-02,2024-01-02 03:04:05,"a ""q"", b"', b'2,,false,2024-01-03,2024-01-03 03:04,"two\nlines"', b"-3,2e3,true,2024-01-04,2024-01-04 00:00:00,2021"]
    df = files.load(spark, write(tmp_path, b"\n".join(rows) + b"\n"))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "date", "timestamp_ntz", "string"]
    got = df.orderBy("n").collect()
    assert [r.text for r in got] == ["2021", 'a "q", b', "two\nlines"] and got[2].x is None


def test_cp1252(spark, tmp_path):
    df = files.load(spark, write(tmp_path, "name,n\nIt’s €5 – ok,1\nKäse,2\n".encode("cp1252")))
    assert [r.name for r in df.orderBy("n").collect()] == ["It’s €5 – ok", "Käse"]


@pytest.mark.parametrize("head", [b"name,n\n", b"\xef\xbb\xbfname,n\n", b"\xef\xbb\xbf"])
def test_cp1252_behind_the_head(spark, tmp_path, head):
    late = head + b"7,1\n" * 40_000 + "Käse – €5,2\n".encode("cp1252")
    got = files.load(spark, write(tmp_path, late)).toDF("name", "n").groupBy("name", "n").count().collect()
    assert sorted(map(tuple, got)) == [("7", 1, 40_000), ("Käse – €5", 2, 1)]


def test_lost_in_the_file_itself(spark, tmp_path):
    late = b"name,n\n" + b"7,1\n" * 40_000 + "Käse \ufffd,2\n".encode()
    assert files.load(spark, write(tmp_path, late)).filter("n = 2").collect()[0].name == "Käse \ufffd"


def test_numbers_keep_all_digits(spark, tmp_path):
    rows = ["id,wide,beyond,mixed,tall"] + [f"{9223372036854775000 + k},{k}{'0' * 30}1,{'7' * 39}{k},{k}.5,{9223372036854775800 + k}" for k in range(10)] + [f"-1,,,{2**60 + 1},"]
    df = files.load(spark, write(tmp_path, "\n".join(rows).encode()))
    assert [t for _, t in df.dtypes] == ["bigint", "decimal(38,0)", "string", "string", "decimal(38,0)"]
    assert df.distinct().count() == 11 and {r.mixed for r in df.collect()} >= {str(2**60 + 1), "0.5"}


def test_splits_unless_a_line_break_is_quoted(spark, tmp_path):
    plain = write(tmp_path, b'a,b\n1,"x ""y"""\n', "plain.csv")
    broken = write(tmp_path, b'a,b\n1,"x\ny"\n', "broken.csv")
    for path, whole in ((plain, False), (broken, True)):
        assert files.lines_of(spark, path, sniff(*files.head_of(spark, path))) == (True, whole)
    assert [tuple(r) for r in files.load(spark, plain).collect()] == [(1, 'x "y"')] and [tuple(r) for r in files.load(spark, broken).collect()] == [(1, "x\ny")]


@pytest.mark.parametrize(("dates", "order"), [(["13/02/2024", "01/02/2024"], "day_first"), (["02/13/2024"], "month_first"), (["01/02/2024"], "ambiguous"), (["2024-01-02"], "iso"), (["13/02/2024", "02/13/2024"], "ambiguous"), (["hello"], "not_a_date"), ([None], "not_a_date")])
def test_date_orders(spark, dates, order):
    assert verify.date_orders(spark.createDataFrame([(d,) for d in dates], "d string"), ["d"]) == {"d": order}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n long, s string")
    files.save(df, f"file://{tmp_path}/out", without="s", anonymous=True)
    assert files.load(spark, f"file://{tmp_path}/out/*.csv").columns == ["col_0"]


def orders(n=60):
    head = "order_ref,sold_on,item,units,price\n"
    return head + "".join(f"O{k // 3},2024-0{1 + k // 20}-1{k // 3 % 9},{'ink paper pen cup hat'.split()[k % 5]},{2 + k % 4},{1.25 + k % 7}\n" for k in range(n))


def test_store(spark, tmp_path):
    df = files.load(spark, write(tmp_path, orders().encode()))
    store = Store(spark, f"file://{tmp_path}/store")
    first = store.put("a", df)
    assert first.version == 1 and store.ids() == ["a"] and first.model.first("event_time") == "sold_on"
    with pytest.raises(RuntimeError):
        store.put("a", df, at=lambda s: (_ for _ in ()).throw(RuntimeError()) if s == "promoting" else None)
    assert store.versions("a") == [1]
    assert store.put("a", df.limit(30)).version == 2
    again = store.get("a")
    assert again.model.row_count == 30 and again.model.to_json() == type(again.model).from_json(again.model.to_json()).to_json()
    store.prune("a", 1)
    assert store.versions("a") == [2]
    with pytest.raises(KeyError):
        store.get("b")


def test_jobs():
    jobs, gate = Jobs(), threading.Event()

    def slow(tell):
        gate.wait(5)
        tell("middle")
        return 7

    a = jobs.submit("d", slow, "k")
    assert jobs.submit("d", slow, "k") is a
    b = jobs.submit("d", slow)
    jobs.cancel(b.id)
    gate.set()
    assert a.over.wait(5) and b.over.wait(5)
    assert (a.state, a.result, a.events) == ("done", 7, ["started", "middle", "done"]) and b.state == "cancelled"
    c = jobs.submit("e", lambda tell: (_ for _ in ()).throw(OSError("no /srv/data/secret.csv here")))
    assert c.over.wait(5) and c.state == "failed" and "secret" not in c.error
    assert redacted("file:/a/b/c.csv") == "<path>"


def test_http(spark, tmp_path):
    def provider(request):
        if request["task"] == "roles":
            return []
        return {"aggregations": [{"func": "count"}]} if request["task"] == "query" else {"notes": ["x"], "aggregations": [{"func": "avg", "column": "units"}]}

    server = serve(Store(spark, f"file://{tmp_path}/store"), port=0, uploads=str(tmp_path), provider=provider)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"

    def call(path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(url + path, body)) as r:
                return r.status, r.read()
        except urllib.error.HTTPError as e:
            return e.code, e.read()

    def finished(raw):
        job = json.loads(raw)
        for _ in range(600):
            job = json.loads(call(f"/jobs/{job['id']}")[1])
            if job["state"] in ("done", "failed", "cancelled"):
                return job
            time.sleep(0.2)
        raise AssertionError(job)

    assert call("/health")[0] == 200 and call("/nothing")[0] == 404 and call("/datasets", b"")[0] == 400
    job = finished(call("/datasets", orders().encode())[1])
    assert job["state"] == "done", job
    name = job["result"]["dataset"]
    assert json.loads(call("/datasets")[1]) == [name]
    asked = finished(call(f"/datasets/{name}/query", json.dumps({"aggregations": [{"func": "count"}]}).encode())[1])
    assert asked["result"]["answer"]["rows"] == [{"row_count": 60}]
    again = finished(call(f"/datasets/{name}/query", json.dumps({"question": "how many?"}).encode())[1])
    more = finished(call(f"/datasets/{name}/query", json.dumps({"question": "and on average?", "previous_job_id": again["id"]}).encode())[1])
    assert again["result"]["answer"]["rows"] == [{"row_count": 60}] and more["result"]["answer"]["rows"] == [{"avg_units": 3.5}]
    assert json.loads(call("/samples")[1]) == ["catering", "sensors", "storefront"] and call("/samples/nope", b"")[0] == 404
    assert finished(call("/samples/sensors", b"")[1])["result"]["rows"] == 240 and call("/samples/sensors/download")[1].startswith(b"station,")
    assert call(f"/datasets/{name}/query", json.dumps({"previous_job_id": "x"}).encode())[0] == 409 and call(f"/datasets/{name}/query", b'{"colour": 1}')[0] == 400
    assert b"done" in call(f"/jobs/{job['id']}/stream")[1]
    server.shutdown()


def test_uploads_in_parts_and_without_room(spark, tmp_path):
    from ledgerlight.service.http import BadUpload, uploaded

    parts = b'--x\r\nContent-Disposition: form-data; name="note"\r\n\r\nhi\r\n--x\r\nContent-Disposition: form-data; name="f"; filename="a.csv"\r\n\r\na,b\r\n1,2\r\n--x--\r\n'
    assert uploaded("multipart/form-data; boundary=x", parts) == b"a,b\r\n1,2" and uploaded("text/csv", b"a,b") == b"a,b"
    for kind, body, why in (("text/csv", parts, "looks_like_multipart"), ("multipart/form-data; boundary=x", b'--x\r\nContent-Disposition: form-data; name="note"\r\n\r\nhi\r\n--x--', "no_file_part")):
        with pytest.raises(BadUpload) as e:
            uploaded(kind, body)
        assert e.value.kind == why
    for limits, code in (({"min_free": 1 << 60}, 507), ({"max_upload": 3}, 413)):
        server = serve(Store(spark, f"file://{tmp_path}/store"), port=0, uploads=str(tmp_path), **limits)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        with pytest.raises(urllib.error.HTTPError) as refused:
            urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}/datasets", b"a,b\n1,2\n"))
        assert refused.value.code == code
        server.shutdown()


def test_settings(tmp_path):
    from ledgerlight.plans.propose import Missing
    from ledgerlight.settings import provider_of, settings

    s = settings(["serve", "--root", "r", "--port", "9"], {"LEDGERLIGHT_PORT": "7", "LEDGERLIGHT_HOST": "h", "LEDGERLIGHT_RECORD": "true", "LEDGERLIGHT_MIN_FREE": "5"})
    assert (s.root, s.port, s.host, s.record, s.min_free, s.provider) == ("r", 9, "h", True, 5, "replay")
    with pytest.raises(SystemExit):
        settings([], {})
    with pytest.raises(ValueError):
        settings(["--root", "r"], {"LEDGERLIGHT_RECORD": "perhaps"})
    for record in (False, True):
        live = provider_of(settings(["--root", "r", "--provider", "json:dumps", "--answers", str(tmp_path), *(["--record"] if record else [])], {}))
        assert live({"a": 1}) == '{"a": 1}'
        replay = provider_of(settings(["--root", "r", "--replay", "--answers", str(tmp_path)], {}))
        if record:
            assert replay({"a": 1}) == '{"a": 1}'
        else:
            with pytest.raises(Missing):
                replay({"a": 1})


def test_models_of_earlier_formats_are_derived_again(spark, tmp_path):
    """Fields that are lacking come from the rows; declared roles stay, also where the heuristic would say something else."""
    from ledgerlight.plans.model import Claim

    df = files.load(spark, write(tmp_path, orders().encode()))
    store = Store(spark, f"file://{tmp_path}/old")
    kept = store.put("a", df, [Claim("item", "entity_key", "product"), Claim("sold_on", "event_time"), Claim("units", "additive_quantity"), Claim("price", "monetary_rate")])
    at = tmp_path / "old" / "a" / "v=1" / "model.json"
    raw = json.loads(at.read_text())
    for f in ("latest", "claims", "coverage", "values"):
        raw.pop(f)
    (tmp_path / "old" / "a" / "v=1" / ".model.json.crc").unlink(missing_ok=True)
    at.write_text(json.dumps(raw | {"version": 3}))
    again = store.get("a").model
    assert {(b.column, b.role, b.entity) for b in again.bindings} == {(b.column, b.role, b.entity) for b in kept.model.bindings} and again.entity("product") == "item"
    assert again.latest == kept.model.latest and again.values == kept.model.values and not Store(spark, store.root).get("a").model.lacking


def test_samples(spark, tmp_path):
    from ledgerlight.plans.build import build
    from ledgerlight.sources import samples

    df = files.load(spark, write(tmp_path, samples.content("catering")))
    assert df.count() == 202 and samples.content("catering") == samples.content("catering")
    model = build(df)
    assert model.in_role("event_time") == [] or model.first("event_time") != "event_date"
    from ledgerlight.plans.model import Claim

    claims = [Claim("event_date", "event_time"), Claim("guests", "additive_quantity"), Claim("price_per_guest", "monetary_rate"), Claim("order_total", "monetary_amount"), Claim("order_ref", "transaction_key")]
    model = build(df, claims=claims)
    assert model.parsers == {"event_date": "day_first"} and model.binding("order_total").status == "verified"
    assert model.binding("order_ref").status == "refuted"  # no reference comes twice


def test_a_stream_that_is_not_through(spark, monkeypatch):
    from pyspark.sql.streaming import StreamingQuery

    from ledgerlight.streaming import rollup

    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda self, timeout=None: self.processAllAvailable() or False)
    events = spark.readStream.format("rate").load().selectExpr("timestamp at", "value")
    counts = rollup.rollup(events, "at", "1 day", [], {"n": rollup.F.count(rollup.F.lit(1))})
    with pytest.raises(TimeoutError):
        rollup.drained(counts, "late", ["period_start"])
