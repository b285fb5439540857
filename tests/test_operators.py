"""Hand-computed edge cases."""

import json
import math
from datetime import date, datetime
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchfold.functions import hashing, text, timeops
from watchfold.operators import axes, forest, graph, labels, scoring, sequences, shaping, user_day
from watchfold.plans import cli, pipelines
from watchfold.sources import logs, schemas, sinks
from watchfold.streaming import live


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


def at(t):
    return datetime.fromisoformat(t)


@pytest.mark.parametrize(
    ("given", "expected"),
    [("01/02/2010 07:27:19", "2010-01-02 07:27:19"), ("1/2/2010 7:30:45", "2010-01-02 07:30:45"), ("01/02/2010 07:27", "2010-01-02 07:27:00"), ("junk", None), (None, None)],
)
def test_timestamps(spark, given, expected):
    assert one(spark, timeops.parse_timestamp(F.col("x")), given) == (expected and at(expected))


@pytest.mark.parametrize(
    ("t", "weekend", "working"),
    [("2010-01-08 10:00", False, True), ("2010-01-10 10:00", True, False), ("2010-01-11 07:59:59", False, False), ("2010-01-11 08:00", False, True), ("2010-01-11 17:59:59", False, True), ("2010-01-11 18:00", False, False)],
)
def test_working_hours(spark, t, weekend, working):
    x = F.col("x")
    assert one(spark, timeops.is_weekend(x), at(t), "timestamp_ntz") is weekend
    assert one(spark, timeops.is_working_hours(x), at(t), "timestamp_ntz") is working
    assert one(spark, timeops.is_after_hours(x), at(t), "timestamp_ntz") is not working


def test_as_written_and_holidays(spark):
    x = F.col("x")
    friday, holiday = at("2010-01-08 10:00"), at("2010-01-01 10:00")
    assert one(spark, timeops.is_weekend(x, as_written=True), friday, "timestamp_ntz") and not one(spark, timeops.is_working_hours(x, as_written=True), friday, "timestamp_ntz")
    assert one(spark, timeops.is_holiday(x), holiday, "timestamp_ntz") and not one(spark, timeops.is_working_hours(x, holidays=timeops.HOLIDAYS), holiday, "timestamp_ntz")
    assert one(spark, timeops.is_working_hours(x), None, "timestamp_ntz") is False


@pytest.mark.parametrize(("given", "count", "written", "external"), [("a@dtaa.com; b@x.com;", 2, 3, True), ("", 0, 1, False), (None, None, None, False), ("a@dtaa.com;b@dtaa.com", 2, 2, False)])
def test_recipients(spark, given, count, written, external):
    x = F.col("x")
    assert one(spark, text.recipient_count(x), given) == count and one(spark, text.recipient_count(x, as_written=True), given) == written
    assert one(spark, text.has_external_recipient(x), given) is external


@pytest.mark.parametrize(("url", "domain", "path"), [("https://Ex.com/a", "ex.com", "/a"), ("http://ex.com", "ex.com", None), ("ftp://x", None, None)])
def test_urls(spark, url, domain, path):
    assert one(spark, text.url_domain(F.col("x")), url) == domain and one(spark, text.url_path(F.col("x")), url) == path


@pytest.mark.parametrize(
    ("path", "removable", "extension", "operation"),
    [("R:\\a.DOC", True, "doc", "REMOVABLE_WRITE"), ("C:\\Windows\\x.dll", False, "dll", "SYSTEM_ACCESS"), ("C:\\u\\b", False, None, "FILE_ACCESS")],
)
def test_paths(spark, path, removable, extension, operation):
    x = F.col("x")
    assert (one(spark, text.is_removable(x), path), one(spark, text.file_extension(x), path), one(spark, text.operation(x), path)) == (removable, extension, operation)


def test_categories_and_roles(spark):
    x = F.col("x")
    assert one(spark, text.domain_category(x), "www.linkedin.com") == "social_media" and one(spark, text.domain_category(x), "mega.nz") == "file_sharing"
    assert [one(spark, text.department_id(x), d) for d in (None, "Sales", "Research and Admin", "legal")] == [0, 3, 1, 7]
    assert one(spark, text.role_sensitivity(x), "Director") == 3 and one(spark, text.role_level(x), "Director") == 4 and one(spark, text.valid_user(x), "ABC1234")


def test_pseudonyms(spark):
    import hashlib

    expected = hashlib.sha256(b"NGF0157" + f"{hashing.SALT}_USER".encode()).hexdigest()[:16]
    assert one(spark, hashing.pseudonym(F.col("x"), "user"), " ngf0157 ") == expected
    assert one(spark, hashing.pseudonym(F.col("x"), "user"), "") == "" and one(spark, hashing.pseudonym(F.col("x"), "email"), "no address") == ""


def log(spark, rows):
    """(id, user, pc, time, activity)."""
    made = spark.createDataFrame([(i, u, p, at(t), a) for i, u, p, t, a in rows], "id long, user string, pc string, timestamp timestamp_ntz, activity string")
    return timeops.calendar(made)


def test_sessions_and_counts(spark):
    rows = [
        (1, "u", "A", "2010-01-04 09:00", "Logon"), (2, "u", "B", "2010-01-04 09:05", "Logon"), (3, "u", "A", "2010-01-04 09:10", "Logoff"),
        (4, "v", "A", "2010-01-05 09:00", "Logoff"), (5, "w", None, "2010-01-05 09:00", "Logon"), (6, "w", "A", "2010-01-05 09:01", "Logon"),
    ]
    df = log(spark, rows)
    pairs = user_day.session_durations(df).collect()
    assert [(r["user"], r["avg_session"], r["std_session"], r["sessions"]) for r in pairs] == [("u", 600.0, 0.0, 1)]
    counts = {r["user"]: r for r in user_day.logon_counts(df).collect()}
    assert counts["v"]["logon_count"] == 0 and counts["v"]["logon_ratio"] == 0 and counts["w"]["unique_pcs"] == 1


def test_rapid_and_devices(spark):
    times = ["2010-01-04 09:00:00", "2010-01-04 09:04:59", "2010-01-04 09:09:59"]
    assert user_day.rapid_logons(log(spark, [(k, "u", "A", t, "Logon") for k, t in enumerate(times)])).first()["rapid_logons"] == 1
    assert user_day.device_counts(log(spark, [(k, "u", "A", t, "Connect") for k, t in enumerate(times[:2])])).first()["missing_disconnect_count"] == 2


def test_windows_over_days(spark):
    days = spark.createDataFrame([("u", date(2010, 1, d), 1) for d in (1, 2, 9)], "user string, date date, n int")
    assert [r["n_7d"] for r in user_day.rolling(days, ["n"], 7).orderBy("date").collect()] == [1, 2, 1]
    df = log(spark, [(1, "u", "A", "2010-01-01 09:00", "x"), (2, "u", "A", "2010-01-03 09:00", "x"), (3, "u", "B", "2010-01-03 10:00", "x")])
    assert [r["new_pcs"] for r in user_day.new_entities(df, "pc").orderBy("date").collect()] == [1, 1]
    with pytest.raises(ValueError):
        user_day.window_days("5d")


def test_sequences(spark):
    base = [(1, "u", "A", "2010-01-04 09:00", "Connect"), (2, "u", "A", "2010-01-04 09:30", "Connect"), (3, "u", "B", "2010-01-04 10:01", "Disconnect")]
    events = sequences.unified({"device": log(spark, base)})
    assert [r["session"] for r in sequences.sessions(events).orderBy("place").collect()] == [0, 0, 1]
    rows = sequences.features(sequences.unified({"logon": log(spark, [(k, "u", "A", f"2010-01-04 09:0{k}", a) for k, a in enumerate(["Logon", "Logoff", "Logoff"])])})).orderBy("place").collect()
    n = lambda *p: -sum(x * math.log2(x) for x in p)
    assert [r["f_temporal_entropy"] for r in rows] == pytest.approx([0, 1, n(1 / 3, 2 / 3)]) and [r["f_session_event_count"] for r in rows] == [1, 2, 3]
    many = log(spark, [(k, "u", "A", "2010-01-04 09:00", "Logoff") for k in range(513)])
    out = sequences.encoded(sequences.unified({"logon": many})).first()
    assert (out["seq_len"], out["event_count"], out["session_count"], len(out["sequence"]), out["window_id"]) == (512, 513, 0, 512, "u_20100104")
    short = sequences.encoded(sequences.unified({"logon": many.limit(2)})).first()
    assert len(short["sequence"]) == 512 and short["sequence"][2] == [0.0] * 16


def test_labels(spark):
    users = spark.createDataFrame([("u",), ("v",)], "user string")
    spans = spark.createDataFrame([("u", date(2010, 1, 2), date(2010, 1, 2), 1), ("u", date(2010, 1, 2), date(2010, 1, 3), 2)], "user string, start date, end date, scenario int")
    days = labels.spine(users, "2010-01-01", "2010-01-04")
    assert days.count() == 8
    for how in (labels.labelled, labels.labelled_by_range):
        got = {(r["user"], r["date"].day): (r["is_insider"], r["threat_type"]) for r in how(days, spans).collect()}
        assert len(got) == 8 and got["u", 2] == (1, "1") and got["u", 3] == (1, "2") and got["u", 4] == (0, "none") and got["v", 2] == (0, "none")


def test_shared_machines(spark):
    df = log(spark, [(k, u, p, "2010-01-04 09:00", "x") for k, (u, p) in enumerate([("u1", "A"), ("u2", "A"), ("u1", "B"), ("u2", "B"), ("u3", "C")])])
    assert sorted((r["user"], r["user2"], r["weight"]) for r in graph.edges_shared_pc(df).collect()) == [("u1", "u2", 2), ("u2", "u1", 2)]


def test_risk(spark):
    columns = "after_hours_ratio double, logon_count int, device_events int, emails_sent int, is_security_role boolean, high_after_hours int"
    rows = spark.createDataFrame([(0.31, 11, 3, 16, True, 1), (0.31, 0, 0, 0, False, 0), (0.31, 0, 0, 0, False, 1), (0.0, 0, 0, 0, None, None)], columns)
    got = [(r["risk_score"], r["threat_level"], r["is_threat"]) for r in scoring.risk(rows.coalesce(1)).collect()]
    assert got == [(90, "critical", True), (20, "normal", False), (40, "low", False), (0, "normal", False)]
    assert scoring.alerts(rows.coalesce(1)).collect()[0]["alerts"] == ["after_hours", "high_volume", "device", "email", "security", "sequence"]


def test_scores(spark):
    rng = np.random.default_rng(0)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(300)] + [(999, [9.0, -9.0] * 3)]
    df = scoring.scaled_vectors(spark.createDataFrame(rows, "user long, v array<double>"), vector="v")
    assert np.allclose(np.std(np.array(df.toPandas()["scaled"].tolist()), axis=0), 1)
    out = scoring.ensemble(forest.isolation_scores(axes.reconstruction_error(df, k=2))).toPandas().set_index("user")
    assert out.iso_forest_score.idxmax() == 999 and out.rank_percentile.max() == pytest.approx(300 / 301) and out.rank_percentile[out.ensemble_anomaly_score.idxmin()] == 0
    logits = lambda x: np.stack([-x[:, 0], x[:, 0]], axis=1)
    flat = spark.createDataFrame([(1, 3.0), (2, None), (3, -3.0)], "user long, a double")
    got = scoring.model_scores(flat, ["a"], logits, [0.0], [1.0]).toPandas().set_index("user")
    assert got.is_threat.to_dict() == {1: True, 2: False, 3: False} and got.probability[2] == 0.5


def test_shaping(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 3, None), ("b", 2, None)], "user string, m int, v double")
    assert {r["user"]: (r["m"], r["v"]) for r in shaping.latest(df, "user", "m", ["m", "v"]).collect()} == {"a": (3, None), "b": (2, None)}
    assert {r["v"] for r in shaping.median_imputed(df, ["v"]).collect()} == {5.0}
    assert shaping.suffixed(df, "7d", ("user",)).columns == ["user", "m_7d", "v_7d"]
    assert schemas.column_check(df, "logon")["missing"] == ["activity", "date", "id", "pc"]
    with pytest.raises(schemas.ColumnsError):
        schemas.column_check(df, "logon", strict=True)


def test_lines_that_do_not_fit(spark, tmp_path):
    """They are kept with file and reason, counted in the audit log, and the others are as if they were not there."""
    email = RAW["email"] + ['7,01/04/2010 09:30:00,abc1234,PC-1,"x@y.com;z@y.com",,,abc@dtaa.com,12,1,"said ""so"", then"', "8,01/04/2010 09:30:00,abc1234,PC-1,x@y.com,,,abc@dtaa.com,many,1,hello", "9,cut off", 'a,b,c,d,e,f,g,h,1,2,"i, j",k']
    for name, lines in RAW.items():
        (tmp_path / f"{name}.csv").write_text("\n".join(email if name == "email" else lines) + "\n")
    (tmp_path / "ldap").mkdir()
    (tmp_path / "ldap" / "2010-01.csv").write_text("\n".join([*LDAP, "x,y"]) + "\n")
    pipelines.stage1(spark, str(tmp_path), str(tmp_path / "out"), audit=sinks.Audit(str(tmp_path / "audit.log")))
    assert sorted((r["id"], r["size"], r["content"]) for r in spark.read.parquet(f"{tmp_path}/out/email").collect()) == [("5", 100, "hello"), ("7", 12, 'said "so", then')]
    got = {(r["line"], r["reason"], r["file"].rsplit("/", 1)[1]) for r in spark.read.parquet(f"{tmp_path}/out/rejects/email").collect()}
    assert got == {(email[3], "values: size", "email.csv"), (email[4], "fields: 2", "email.csv"), (email[5], "fields: 12", "email.csv")}
    assert [(r["line"], r["file"].rsplit("/", 1)[1]) for r in spark.read.parquet(f"{tmp_path}/out/rejects/ldap").collect()] == [("x,y", "2010-01.csv")]
    log = {x["table"]: (x["rows"], x["rejected"]) for x in map(json.loads, (tmp_path / "audit.log").read_text().splitlines())}
    assert log == {**{x: (1, 0) for x in RAW}, "logon": (2, 0), "email": (2, 3), "ldap": (1, 1)} and not (tmp_path / "out" / "rejects" / "logon").exists()
    there = logs.availability(spark, str(tmp_path))
    assert there["ground_truth"] is None and there["email"] == (tmp_path / "email.csv").stat().st_size // 180


RAW = {
    "logon": ["id,date,user,pc,activity", "1,01/04/2010 09:00:00,abc1234,PC-1,Logon", "2,01/04/2010 10:00:00,abc1234,PC-1,Logoff"],
    "device": ["id,date,user,pc,activity", "3,01/04/2010 09:10:00,abc1234,PC-1,Connect"],
    "file": ["id,date,user,pc,filename,content", "4,01/04/2010 09:20:00,abc1234,PC-1,R:\\a.doc,D0-CF more"],
    "email": ["id,date,user,pc,to,cc,bcc,from,size,attachments,content", "5,01/04/2010 09:30:00,abc1234,PC-1,x@y.com;z@dtaa.com,,,abc@dtaa.com,100,1,hello"],
    "http": ["id,date,user,pc,url,content", "6,01/04/2010 09:40:00,abc1234,PC-1,http://linkedin.com/jobs,words"],
    "psychometric": ["employee_name,user_id,O,C,E,A,N", "Abc Def,abc1234,40,20,30,20,40"],
}
LDAP = ["employee_name,user_id,email,role,projects,business_unit,functional_unit,department,team,supervisor", "Abc Def,abc1234, ABC@dtaa.com,ITAdmin,,,,Security,T1,"]


def test_stages(spark, tmp_path, capsys):
    for name, lines in RAW.items():
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "ldap").mkdir()
    (tmp_path / "ldap" / "2010-01.csv").write_text("\n".join(LDAP) + "\n")
    audit = sinks.Audit(str(tmp_path / "audit.log"))
    pipelines.stage1(spark, str(tmp_path), str(tmp_path / "out"), audit=audit)
    tables = {x: spark.read.parquet(f"{tmp_path}/out/{x}") for x in (*RAW, "ldap")}
    assert tables["http"].first()["domain_category"] == "social_media" and tables["email"].first()["has_external_recipient"] and tables["logon"].first()["user"] == "ABC1234"
    assert len({r["user_hash"] for x in tables.values() for r in x.collect()}) == 1
    assert tables["ldap"].first()["email"] == "abc@dtaa.com" and str(tables["ldap"].first()["snapshot_month"]) == "2010-01-01"
    assert tables["logon"].first()["is_holiday"] is False and tables["logon"].first()["time_bucket"] == at("2010-01-04 09:00")
    pipelines.stage2(spark, tables, str(tmp_path / "features"), directory=tables["ldap"], traits=tables["psychometric"])
    row = spark.read.parquet(f"{tmp_path}/features/features").first()
    assert (row["logon_count"], row["sum_session"], row["missing_disconnect_count"], row["external_emails_sent"], row["job_visits"], row["logon_count_7d"]) == (1, 3600, 1, 1, 1, 1)
    assert (row["new_pcs"], row["new_domains"], row["degree"], row["role_sensitivity"], row["is_high_risk"]) == (1, 1, 2, 5, True)
    monthly, quarterly = (spark.read.parquet(f"{tmp_path}/features/features_{x}") for x in ("monthly", "quarterly"))
    assert monthly.first()["logon_count"] == 1 and monthly.columns == quarterly.columns and "logon_count" in spark.read.parquet(f"{tmp_path}/features/features_daily").columns
    ranks = {r["node"]: r["rank"] for r in spark.read.parquet(f"{tmp_path}/features/graph/ranks").collect()}
    assert len(ranks) == 4 and sum(ranks.values()) == pytest.approx(1) and max(ranks, key=ranks.get) == "ABC1234"
    assert sorted((r["src"], r["dst"], r["weight"]) for r in spark.read.parquet(f"{tmp_path}/features/graph/mail").collect()) == [("abc@dtaa.com", "x@y.com", 1), ("abc@dtaa.com", "z@dtaa.com", 1)]
    for _ in range(2):
        assert cli.main(["stream", str(tmp_path / "features"), str(tmp_path / "live"), "--audit", str(tmp_path / "audit2.log")]) == 0
    assert spark.read.parquet(f"{tmp_path}/live/scored").count() == 1 and len((tmp_path / "audit2.log").read_text().splitlines()) == 4
    rows = sinks.completeness(spark, f"{tmp_path}/features", cli.EXPECTED)
    assert all(v for name, v in rows.items() if name != "graph/edges_shared_pc") and not rows["graph/edges_shared_pc"]
    edge = spark.read.parquet(f"{tmp_path}/features/graph/edges_browsed").first()
    assert (edge["user_node"], edge["domain_node"], edge["weight"]) == (0, 1, 1)
    for task, name in (("features", "features"), ("graph", "graph/nodes_user"), ("sequences", "sequences")):
        assert cli.main([task, str(tmp_path / "out"), str(tmp_path / "more"), "--windows", "24h,7d"]) == 0 and spark.read.parquet(f"{tmp_path}/more/{name}").count() == 1
    assert len((tmp_path / "audit.log").read_text().splitlines()) == 7 and json.loads((tmp_path / "audit.log").read_text().splitlines()[0])["kind"] == "write"
    assert cli.main(["check", str(tmp_path)]) == 0 and json.loads(capsys.readouterr().out)["logon"]
    assert logs.read_ground_truth(spark, None).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    columns = "user string, date date, logon_count int, device_events int, emails_sent int, after_hours_ratio double"
    rows = spark.createDataFrame([("u", date(2010, 1, k + 1), k * 5, k, k * 6, k / 10) for k in range(8)], columns)
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = live.enrich(live.replay(spark, f"{tmp_path}/in", rows.schema))
    live.write_available(stream, f"{tmp_path}/state").foreachBatch(lambda b, _: b.write.mode("append").parquet(f"{tmp_path}/out")).start().awaitTermination()
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(str, live.enrich(rows).collect()))
    keep = live.recent(f"{tmp_path}/recent", "date", 3)
    for k in range(2):
        keep(rows.where(F.col("logon_count") % 2 == k), k)
    assert sorted(r["date"].day for r in spark.read.parquet(f"{tmp_path}/recent/1").collect()) == [6, 7, 8]


def test_answers_windows_and_samples(spark, tmp_path):
    folder = tmp_path / "r4.2-1"
    folder.mkdir()
    (folder / "r4.2-1-ABC1234.csv").write_text('logon,1,"01/04/2010 09:00:00",x\nlogon,2,"01/06/2010 10:00:00",x\n')
    found = logs.read_answers(spark, str(tmp_path)).first()
    assert (found["user"], found["scenario"], found["start"], found["end"]) == ("ABC1234", 1, at("2010-01-04 09:00"), at("2010-01-06 10:00"))
    df = spark.range(100)
    assert logs.random_sample(df, 7).count() == 7
    paths = sinks.write_windows({"24h": df, "7d": df}, str(tmp_path / "w"))
    assert paths["7d"].endswith("features_weekly") and spark.read.parquet(paths["24h"]).count() == 100
    (tmp_path / "logon.csv").write_text("x" * 600)
    assert logs.estimated_rows(spark, str(tmp_path / "logon.csv"), "logon") == 10 and logs.estimated_rows(spark, str(tmp_path / "none.csv"), "logon") == 0
    lines = ["id,date,user,pc,filename,content", '4,01/04/2010 09:20:00,abc1234,PC-1,R:\\a.doc,"two', 'lines"']
    (tmp_path / "file.csv").write_text("\n".join(lines) + "\n")
    assert logs.read_log(spark, str(tmp_path / "file.csv"), "file", multi_line=True).first()["content"] == "two\nlines"


def refusing(path, refusals):
    """A sender that counts what it is sent in a file, and refuses the first times."""

    def send(messages):
        with open(path, "a") as out:
            out.write(f"{len(messages)}\n")
        with open(path) as lines:
            if len(lines.readlines()) <= refusals:
                raise OSError("refused")

    return send


def test_required_tables(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/logon")
    assert set(logs.read_stage1(spark, str(tmp_path), ("logon",), ("device",))) == {"logon"}
    with pytest.raises(FileNotFoundError, match="device, file"):
        logs.read_stage1(spark, str(tmp_path), ("logon", "device", "file"))


def test_post_tries_again(spark, tmp_path):
    rows = spark.range(5).coalesce(1)
    live.post(refusing(str(tmp_path / "a"), 2), batch_rows=5, pause=0.01)(rows, 0)
    assert (tmp_path / "a").read_text().split() == ["5", "5", "5"]
    with pytest.raises(Exception, match="refused"):
        live.post(refusing(str(tmp_path / "b"), 99), batch_rows=5, attempts=2, pause=0.01)(rows, 0)


def test_post_to_a_server(tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    got = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            got.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(200)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    live.to_url(f"http://127.0.0.1:{server.server_port}/")(['{"a": 1}', '{"a": 2}'])
    server.shutdown()
    assert got == [[{"a": 1}, {"a": 2}]]


def test_the_rest_works_without_llm():
    import subprocess
    import sys

    code = (
        "import sys; sys.modules['corpus_pipeline'] = sys.modules['watchfold.llm'] = None\n"
        "try:\n import __spark_entry__ as e\nexcept ModuleNotFoundError as x:\n assert x.name is None or x.name == 'corpus_pipeline', x\nelse:\n assert 'logon_user_day' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    )
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0], check=False).returncode == 0


def test_shared_machines_of_many_users(spark):
    """A machine of 3,000 users, and others of few: every pair once each way, and no exchange holds pairs of users."""
    rows = [("2024-01-31", "kiosk", f"u{k:04d}") for k in range(3000)] + [("2024-01-31", f"pc{k % 40}", f"u{k:04d}") for k in range(0, 3000, 7)] + [("2024-02-29", "kiosk", "u0001"), ("2024-02-29", "kiosk", None), (None, None, "u1")]
    events = spark.createDataFrame(rows, "snapshot string, pc string, user string")
    edges = graph.edges_shared_pc(events)
    got = edges.groupBy("snapshot").agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.count(F.when(F.col("user") == F.col("user2"), 1)).alias("own"), F.countDistinct("user", "user2").alias("pairs")).collect()
    on = [[k for k in range(0, 3000, 7) if k % 40 == m] for m in range(40)]
    assert [tuple(r) for r in got] == [("2024-01-31", 3000 * 2999, 3000 * 2999 + sum(len(x) * (len(x) - 1) for x in on), 0, 3000 * 2999)]
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange hashpartitioning" in line and " a#" in line.split("Exchange")[1] for line in plan.splitlines())


@pytest.mark.parametrize("name", ["graph_edges", "graph_written", "edges_shared_pc"])
def test_graph_queries_at_a_larger_scale(spark, name):
    """Sums over all rows against the SQL, where machines have over 1,000 users."""
    import duckdb
    from watchfold import queries

    sf = "/root/testdata/sf0.1"
    base = duckdb.connect()
    for table in Path(sf).glob("*.parquet"):
        base.sql(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    got = queries.QUERIES[name](spark, sf)
    sums = ", ".join(f"sum({c}) AS {c}" for c, kind in got.dtypes if kind in ("bigint", "int", "double"))
    mine, expected = got.selectExpr("count(*) AS n", *sums.split(", ")).first(), base.sql(f"SELECT count(*) AS n, {sums} FROM ({queries.SQL[name]})").fetchall()[0]
    assert [float(x) for x in mine] == pytest.approx([float(x) for x in expected], rel=1e-9)


def test_shared_machines_in_words_and_blocks(spark):
    """Machines within 64 and beyond, several blocks, node numbers and rounding, against brute force."""
    import itertools
    import math
    import random

    rng = random.Random(5)
    rows = {(s, f"pc{rng.choice((rng.randrange(m), 0))}", f"u{rng.randrange(60)}") for s, m in (("2024-01-31", 300), ("2024-02-29", 5), (None, 30)) for _ in range(900)}
    events = spark.createDataFrame([*rows, *rows], "snapshot string, pc string, user string")
    number = {f"u{k}": k * 7 for k in range(55)}
    numbers = spark.createDataFrame([*number.items()], "user string, node long")
    expected = {}
    for s, pc in {(s, pc) for s, pc, _ in rows if s}:
        for a, b in itertools.permutations(sorted(u for t, p, u in rows if (t, p) == (s, pc)), 2):
            expected[s, a, b] = expected.get((s, a, b), 0) + 1
    for block in (7, 1000):
        edges = graph.edges_shared_pc(events.where("snapshot IS NOT NULL"), block, numbers, 6)
        got = {(r["snapshot"], r["user"], r["user2"]): r for r in edges.collect()}
        assert {k: r["weight"] for k, r in got.items()} == expected and edges.count() == len(expected)
        assert all((r["user_node"], r["user2_node"]) == (number.get(r["user"]), number.get(r["user2"])) for r in got.values())
        assert all(abs(r["log_weight"] - round(math.log1p(r["weight"]), 6)) < 1e-12 for r in got.values())


def test_shared_machines_group_no_pairs(spark):
    """Where blocks share 64 machines at most, what comes of the pairs of users is neither grouped nor sorted."""
    events = spark.createDataFrame([("pc1", "u1"), ("pc1", "u2")], "pc string, user string")
    plan = graph.edges_shared_pc(events)._jdf.queryExecution().executedPlan().toString().splitlines()
    first = next(k for k, line in enumerate(plan) if "Generate explode(right" in line)
    assert not any(x in line for line in plan[:first] for x in ("Aggregate", "Sort", "Exchange", "Join"))


def test_shared_machines_are_numbered_before_they_are_paired(spark):
    """Edges of the graph's tables: no join, and with it no exchange, of pairs of users."""
    from watchfold.plans import pipelines
    from watchfold.sources import adapters

    _, edges = pipelines.graph_tables({"logon": adapters.logon(spark, "/root/testdata/sf0.001")})
    assert {"user_node", "user2_node"} <= set(edges["shared_pc"].columns)
    plan = edges["shared_pc"]._jdf.queryExecution().executedPlan().toString().splitlines()
    first = next(k for k, line in enumerate(plan) if "Generate explode(right" in line)
    assert not any(x in line for line in plan[:first] for x in ("Aggregate", "Sort", "Exchange", "Join"))


def test_partitions_are_written_without_a_sort(spark, tmp_path):
    from watchfold.sources import sinks

    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    rows = spark.range(1000).selectExpr("id", "id % 7 AS snapshot", "id % 2 AS half")
    for by in ("half", "snapshot"):  # fewer partitions than files are open at a time, and more
        sinks.write_parquet(rows, f"{tmp_path}/{by}", (by,))
        plan = spark._jsparkSession.sharedState().statusStore().executionsList().last().physicalPlanDescription()
        assert "WriteFiles" in plan and "Sort" not in plan
        got = spark.read.parquet(f"{tmp_path}/{by}")
        assert sorted(map(tuple, got.select(*rows.columns).collect())) == [(k, k % 7, k % 2) for k in range(1000)]
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
