"""The decision matrix cell by cell, settings, policy store, streams and restarts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from warden.engine import Engine
from warden.operators import audit, decide, gates, learn
from warden.operators.policy import NotAllowed, PolicyStore
from warden.schema import STATEMENTS, SchemaError, require_schema
from warden.settings import Settings, normal_ip, resolve

COMMAND = [
    ("learn", None, "ALLOWED (LEARN MODE - AUTO)"), ("learn", False, "ALLOWED (LEARN MODE - PENDING)"), ("learn", True, "ALLOWED"),
    ("permissive", None, "ALLOWED (PERMISSIVE - UNAPPROVED)"), ("permissive", False, "ALLOWED (PERMISSIVE - PENDING)"), ("permissive", True, "ALLOWED"),
    ("enforce", None, "BLOCKED"), ("enforce", False, "BLOCKED"), ("enforce", True, "ALLOWED"),
]
#: none, pending, denied, approved: the second audit row, or BLOCKED.
PRINTS = {
    "learn": ("LEARNED (FINGERPRINT AUTO)", None, None, None),
    "permissive": ("ALLOWED (PERMISSIVE - FINGERPRINT)",) * 3 + (None,),
    "enforce": ("BLOCKED", "BLOCKED", "BLOCKED", None),
}


def one(spark, text="SELECT v FROM t WHERE id = 7", command="SELECT", role="app_0", ip="10.0.0.9", app="psql"):
    row = (1, dt.datetime(2024, 1, 1), 1, "db", 100, role, command, ip, app, text, 1, True)
    return spark.createDataFrame([row], STATEMENTS)


def approvals(spark, value):
    return spark.createDataFrame([] if value is None else [("app_0", "SELECT", value)], "role_name string, command_type string, is_approved boolean")


@pytest.mark.parametrize("mode,row,action", COMMAND)
def test_command_matrix(spark, mode, row, action):
    r = decide.decide(one(spark), Settings(mode=mode, enable_fingerprint_learning=False), decide.Policy(approvals(spark, row))).first()
    assert r["action"] == action and (r["decision"] == "blocked") == (action == "BLOCKED") and (r["sqlstate"] == "42501") == (action == "BLOCKED")


@pytest.mark.parametrize("mode", list(PRINTS))
@pytest.mark.parametrize("kind", range(4))
def test_fingerprint_matrix(spark, mode, kind):
    p = decide.Policy(approvals(spark, True), None, (), 1, 2)
    fp = decide.fingerprinted(one(spark), p).first()["fingerprint"]
    rows = [] if kind == 0 else [(fp, "app_0", "SELECT", kind == 3)]
    known = spark.createDataFrame(rows, "fingerprint string, role_name string, command_type string, is_approved boolean")
    r = decide.decide(one(spark), Settings(mode=mode), decide.Policy(p.approvals, known, (), 1, 2)).first()
    want = PRINTS[mode][kind]
    assert (r["action"], r["fingerprint_action"]) == (("BLOCKED", None) if want == "BLOCKED" else ("ALLOWED", want))


def test_gate_order(spark):
    s = Settings(mode="enforce", enable_ip_blocking=True, blocked_ips="10.0.0.9", blacklisted_keywords="pg_sleep", enable_quiet_hours=True, quiet_hours_start="00:00", quiet_hours_end="00:00")
    text = "SELECT pg_sleep(1) OR 1 = 1"
    p = decide.Policy(approvals(spark, True), None, (("sleep", None),))
    reasons = []
    for change in ({}, {"enable_ip_blocking": False}, {"enable_quiet_hours": False}, {"enable_keyword_scan": False}, {"enable_builtin_injection_check": False}, {"enable_regex_scan": False}):
        import dataclasses

        s = dataclasses.replace(s, **change)
        reasons.append(decide.decide(one(spark, text), s, p).first()["reason"])
    assert [r.split("'")[0][:12] for r in reasons] == ["Connection f", "Blocked duri", "Blocked due ", "Query matche", "Query blocke", "Fingerprint "]


def test_role_unknown_and_other(spark):
    p = decide.Policy(approvals(spark, None))
    assert decide.decide(one(spark, role=None), Settings(mode="enforce"), p).first()["reason"] == "Role unknown"
    for mode, action in (("learn", "ALLOWED (OTHER)"), ("permissive", "ALLOWED (OTHER)"), ("enforce", "BLOCKED")):
        r = decide.decide(one(spark, "CALL p()", "OTHER"), Settings(mode=mode), p).first()
        assert (r["action"], r["fingerprint_action"]) == (action, None)


def test_settings():
    assert Settings().mode == "learn" and Settings(blocked_ips="::ffff:10.0.0.1").blocked_ips
    for bad in ({"mode": "x"}, {"rate_limit_seconds": 0}, {"quiet_hours_start": "24:00"}, {"blocked_ips": "1.2.3"}, {"role_ip_bindings": "a@b"}, {"quiet_hours_timezone": "No/Where"}):
        with pytest.raises(ValueError):
            Settings(**bad)
    assert [normal_ip(x) for x in ("::ffff:10.0.0.1", "fe80::1%eth0", "[local]", None)] == ["10.0.0.1", "fe80::1", None, None]
    rows = [(None, None, "mode", "permissive"), (None, "r", "mode", "enforce"), ("d", None, "rate_limit_count", "7"), ("d", "q", "mode", "learn")]
    got = resolve(Settings(), rows, "d", "r")
    assert (got.mode, got.rate_limit_count) == ("enforce", 7)


def test_rules(spark):
    assert gates.rule_fault("a++") and gates.rule_fault("(") and not gates.rule_fault(r"delete\s+from")
    assert gates.rule_fault("(?P<n>x)")
    with pytest.raises(ValueError):
        gates.regex_reason_column([("x", None)] * (gates.MAX_MERGED + 1), F.lit("a"), F.lit("b"))
    assert gates.java_pattern("[[:alpha:]_]+\\y") == "(?i)[\\p{Alpha}_]+\\b"


def test_many_rules_are_joined(spark):
    p = decide.Policy(approvals(spark, True))
    table = spark.createDataFrame([(gates.java_pattern(f"x{k}\\y"), True, None) for k in range(gates.MAX_MERGED + 5)] + [("(?i)from t", True, ["app_0"])], "pattern string, is_active boolean, allowed_roles array<string>")
    s = Settings(mode="permissive", enable_fingerprint_learning=False)
    for text, role, refused in (("SELECT X7 FROM t", "app_0", True), ("SELECT v FROM t", "app_0", False), ("SELECT v FROM t", "app_1", True)):
        r = decide.decide(one(spark, text, role=role), s, decide.Policy(p.approvals, rule_table=table)).first()
        assert (r["reason"] == gates.REGEX_REASON) == refused


def test_inner_writes_sources_and_installations(spark):
    s, p = Settings(mode="enforce", enable_fingerprint_learning=False), decide.Policy(approvals(spark, True))
    inner = lambda x: one(spark).withColumn("cte_families", F.array(*map(F.lit, x)).cast("array<string>"))
    rows = decide.decide(inner(["INSERT", "INSERT", "DELETE"]), s, p).orderBy("inspection_no").collect()
    assert [(r["command_type"], r["decision"]) for r in rows] == [("SELECT", "allowed"), ("INSERT", "blocked"), ("DELETE", "blocked")]
    assert {r["sqlstate"] for r in decide.decide(inner(["FROB"]), s, p).collect()} == {"0A000"}
    r = decide.decide(one(spark, None), s, p).first()
    assert (r["sqlstate"], r["reason"]) == ("0A000", gates.NO_SOURCE) and decide.decide(one(spark, " \n"), s, p).count() == 0
    for state, mode, want in (("active", "enforce", [None]), ("unavailable", "enforce", ["55000"]), ("unavailable", "learn", []), ("absent", "enforce", [])):
        there = spark.createDataFrame([(1, state)], "db_oid long, state string")
        assert [r["sqlstate"] for r in decide.decide(one(spark), Settings(mode=mode, enable_fingerprint_learning=False), p, installed=there).collect()] == want


def test_addresses(spark):
    import random

    from warden.functions.text import ip_address

    r = random.Random(1)
    texts = ["::", "::1", "1::", "::ffff:10.0.0.1", "0:0:0:0:0:FFFF:1.2.3.4", "fe80::1%eth0", "1:0:0:2:0:0:3:4", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8:9", ":::", "1:::2", ":1::2", "12345::", "g::", "1.2.3", "01.2.3.4", "[local]", "", None, "::1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", " 2001:DB8::A "]
    for _ in range(500):
        groups = [r.choice(["0", "0", "00", "1", "ab", "00fF", "10"]) for _ in range(r.choice([8, 7, 5, 9]))]
        k = r.randrange(len(groups))
        groups[k : k + 1] = r.choice([["", "3"], ["0"], [""]])
        texts.append(":".join(groups))
    got = spark.createDataFrame([(t,) for t in texts], "a string").select("a", ip_address(F.col("a")).alias("n")).collect()
    assert [(x["a"], x["n"]) for x in got] == [(t, normal_ip(t)) for t in texts]
    s = Settings(mode="permissive", enable_ip_blocking=True, blocked_ips="2001:db8::1", enable_role_ip_binding=True, role_ip_bindings="app_0@2001:db8::2", enable_fingerprint_learning=False)
    p = decide.Policy(approvals(spark, True))
    for ip, refused in (("2001:DB8:0::1", True), ("2001:db8:0:0::2", False), ("2001:db8::3", True), (None, True)):
        assert (decide.decide(one(spark, ip=ip), s, p).first()["action"] == "BLOCKED") == refused


def test_each_event_has_its_own_threshold(spark):
    table = spark.createDataFrame([("f", "r", "SELECT", 2, False, False)], "fingerprint string, role_name string, command_type string, hit_count int, is_approved boolean, auto_approval_disabled boolean")
    cols = "fingerprint string, role_name string, command_type string, hits long, learn_threshold int, position long"
    for events, want in (([(1, 3, 1), (1, 9, 2)], True), ([(1, 9, 1), (1, 4, 2)], True), ([(1, 4, 1), (1, 9, 2)], False), ([(5, 0, 1)], False)):
        rows = [("f", "r", "SELECT", h, t, p) for h, t, p in events]
        got = learn.upsert_hits(table, spark.createDataFrame(rows, cols)).first()
        assert (got["is_approved"], got["hit_count"]) == (want, 2 + sum(e[0] for e in events)), events


def test_schema_guard(spark):
    df = spark.range(1)
    with pytest.raises(SchemaError):
        require_schema(df, STATEMENTS)
    assert require_schema(df, STATEMENTS, "learn") is None


def test_store_and_engine(spark, tmp_path):
    store = PolicyStore(spark, f"file://{tmp_path}/policy", superuser=True)
    store.approve_command("app_0", "SELECT")
    store.revoke_command("app_0", "SELECT")
    assert [tuple(r) for r in store.read("command_approvals").collect()] == [("app_0", "SELECT", False)]
    rule = store.add_regex_rule("drop", "no drops")
    store.toggle_regex_rule(rule, False)
    assert not store.read("regex_rules").first()["is_active"]
    with pytest.raises(ValueError):
        store.add_regex_rule("x++")
    with pytest.raises(NotAllowed):
        PolicyStore(spark, store.path).approve_command("a", "b")
    e = Engine(spark, store, Settings(fingerprint_learn_threshold=1))
    e.learn(one(spark, command="INSERT"))
    e.learn(one(spark, "SELECT 1 OR 1 = 1", command="UPDATE"))  # refused, so it teaches nothing
    e.learn(one(spark, "CALL p()", command="OTHER"))
    learned = e.store.read("query_fingerprints").collect()
    assert [(r["command_type"], r["hit_count"], r["is_approved"], r["sample_query"]) for r in learned] == [("INSERT", 1, True, "SELECT v FROM t WHERE id = 7")]
    assert learned[0]["normalized_query"].startswith("v3: SELECT ") and learned[0]["first_seen_at"] == learned[0]["last_seen_at"] == dt.datetime(2024, 1, 1)
    assert sorted(r["command_type"] for r in store.read("command_approvals").collect()) == ["INSERT", "SELECT"]
    Engine(spark, store, Settings(mode="enforce")).learn(one(spark, command="DELETE"))
    assert store.read("command_approvals").count() == 2
    assert e.status() == "running in learn mode" and e.decide(one(spark)).first()["action"] == "ALLOWED (LEARN MODE - PENDING)"
    before = {n: audit.policy_digest(store.read(n)).first() for n in ("command_approvals", "query_fingerprints", "regex_rules")}
    store.dump(f"file://{tmp_path}/dump")
    other = PolicyStore(spark, f"file://{tmp_path}/other", superuser=True)
    other.restore(f"file://{tmp_path}/dump")
    assert before == {n: audit.policy_digest(other.read(n)).first() for n in before}


def test_permissive_changes_no_policy(spark, tmp_path):
    store = PolicyStore(spark, f"file://{tmp_path}/p", superuser=True)
    store.approve_command("app_0", "SELECT")
    e = Engine(spark, store, Settings(mode="permissive"))
    e.decide(one(spark)).collect()
    assert store.version("command_approvals") == 1


def test_threshold_boundary(spark):
    cols = "fingerprint string, role_name string, command_type string, hits long, learn_threshold int, position long"
    table = spark.createDataFrame([], "fingerprint string, role_name string, command_type string, hit_count int, is_approved boolean, auto_approval_disabled boolean")
    for n, want in ((4, False), (5, True), (6, True)):
        events = spark.createDataFrame([("f", "r", "SELECT", 1, 5, i) for i in range(n)], cols)
        assert learn.upsert_hits(table, events).first()["is_approved"] is want
        assert learn.threshold_crossings(events, 5).count() == int(want)


def test_stream_decides_and_restarts(spark, tmp_path, sf_dir):
    from warden.plans.queries import log, policy
    from warden.sources.statements import stream
    from warden.streaming.pipeline import decide_stream

    rows = log(spark, sf_dir)
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    rows.where("stmt_id % 2 = 0").coalesce(1).write.parquet(src)
    run = lambda: decide_stream(stream(spark, src), Settings(mode="enforce"), policy, out, f"{tmp_path}/cp").awaitTermination(120)
    run()
    first = spark.read.parquet(f"{out}/blocked").count()
    rows.where("stmt_id % 2 = 1").coalesce(1).write.mode("append").parquet(src)
    run()
    want = decide.blocked_rows(decide.decide(rows, Settings(mode="enforce"), policy(spark))).count()
    assert 0 < first < want == spark.read.parquet(f"{out}/blocked").count()
    assert spark.read.parquet(f"{out}/blocked").select("stmt_id").distinct().count() == want


def test_rates_and_learning_go_on_over_micro_batches(spark, tmp_path):
    """Three batches of one role's statements: windows stay open, and what one batch learned holds in the next."""
    from warden.sources.statements import stream
    from warden.streaming.pipeline import decide_stream

    at = lambda k: dt.datetime(2024, 1, 1, 0, k)
    rows = [(k, at(k), 1, "db", 100, "app_0", "SELECT", "10.0.0.9", "psql", f"SELECT v FROM t WHERE id = {k}", k, k != 1) for k in range(9)]
    s = Settings(mode="learn", enable_rate_limiting=True, rate_limit_count=5, rate_limit_seconds=420, fingerprint_learn_threshold=3)
    p = decide.Policy(approvals(spark, None))
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for k in range(3):
        spark.createDataFrame(rows[3 * k : 3 * k + 3], STATEMENTS).coalesce(1).write.mode("append").parquet(src)
        decide_stream(stream(spark, src), s, lambda _: p, out, f"{tmp_path}/cp", keep_learning=True).awaitTermination(100)
    assert sorted(r["stmt_id"] for r in spark.read.parquet(f"{out}/blocked").collect()) == [5, 6]  # the window ends at minute 7
    learned = [spark.read.parquet(f"{out}/state/fingerprints/batch={k}").first() for k in range(3)]
    assert [(r["hit_count"], r["is_approved"]) for r in learned] == [(2, False), (4, True), (4, True)]
    actions = {(r["stmt_id"], r["action"]) for r in spark.read.parquet(f"{out}/activity").collect()}
    assert (0, "ALLOWED (LEARN MODE - AUTO)") in actions and (3, "ALLOWED") in actions
    assert sum(a.startswith("LEARNED") for _, a in actions) == 1


def test_rate_stream_equals_batch(spark, tmp_path, sf_dir):
    from warden.operators import rate
    from warden.plans.queries import log
    from warden.sources.statements import stream
    from warden.streaming.pipeline import rate_stream

    rows = log(spark, sf_dir)
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = rate_stream(stream(spark, f"{tmp_path}/in"), rate.KEYS, 86400, 10).writeStream.format("memory").queryName("rates").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(180)
    want = rate.rate_windows(rows, rate.KEYS, "decided_at", "stmt_id", 86400).select("stmt_id", "n")
    got = spark.table("rates").select("stmt_id", "n")
    assert got.count() == rows.count() and got.exceptAll(want).count() == 0


def test_retention_schedule():
    t = dt.datetime(2024, 1, 1)
    assert audit.next_retention(None, t, 300, False) == t + dt.timedelta(seconds=5)
    assert audit.next_retention(t, t, 300, True) == t and audit.next_retention(t, t, 1, False) == t + dt.timedelta(seconds=5)
    assert str(F.lit(1)) and audit.maintenance_allowed is not None


def test_texts_beyond_the_common_subset(spark):
    """The columns agree with the full lexer on every text, and texts without a single reading are refused."""
    import random

    from tests.test_lexer import ALIKE, APART, REFUSED, RULES
    from warden.functions.lexer import canonical

    texts = [t for _, t, _ in RULES] + [t for t, _ in REFUSED] + [t for group in (*APART, *ALIKE) for t in group]
    rng = random.Random(3)
    bits = ["'", '"', "''", '""', "$", "$1", "$$", "$t$", "/*", "*/", "--", "\n", " ", "E'", "n'", "a", "or", "1", "1.5", ".", "0x1", "<=", "!=", "=", "-", "|", ";", ":", "::", "\\", "é", "{", "U&'", "do", "\t", "(", "\r", "00000000001", "2147483648", "/* c */"]
    texts += ["".join(rng.choices(bits, k=rng.randint(1, 9))) for _ in range(6000)]
    base = one(spark).drop("stmt_id", "query_text")
    log = base.crossJoin(spark.createDataFrame(list(enumerate(texts)), "stmt_id int, query_text string"))
    got = {r["query_text"]: (r["canonical"], r["canonical_sqlstate"]) for r in decide.fingerprinted(log, decide.Policy(approvals(spark, True))).collect()}
    assert {t: v for t, v in got.items() if v != canonical(t)} == {}
    p, s = decide.Policy(approvals(spark, True)), Settings(mode="permissive", blacklisted_keywords="pg_sleep")
    cases = [
        ("SELECT v FROM t WHERE id = 7 /* /* */ or 1=1 */", None, "ALLOWED"), ("SELECT $$ or 1=1 $$, $t$pg_sleep$t$", None, "ALLOWED"), (r"SELECT E'it\'s or 1=1'", None, "ALLOWED"),
        (r"SELECT 'a\' , (SELECT 1) --'", "0A000", "BLOCKED"), ("SELECT 'abc", "XX000", "BLOCKED"), ("SELECT 'abc pg_sleep", "42000", "BLOCKED"), ("SELECT 1 or 1=1 or 'a", "42501", "BLOCKED"), ("SELECT $$x$$ OR .5 = .5", "42501", "BLOCKED"),
    ]
    for text, state, action in cases:
        r = decide.decide(one(spark, text), s, p).first()
        assert (r["sqlstate"], r["action"]) == (state, action), text


def test_every_statement_is_in_a_batch(spark):
    rows = spark.range(1000).selectExpr("id * 700 as stmt_id", "if(id % 4 = 0, null, 'app_1') as role_name")
    got = {(r["role_name"], r["batch_no"]): r["count"] for r in audit.batched(rows, "role_name", "stmt_id").groupBy("role_name", "batch_no").count().collect()}
    assert got == {(None, 0): 250, ("app_1", 0): 256, ("app_1", 1): 256, ("app_1", 2): 238}
