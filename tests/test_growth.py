"""A log is read, and each text of it, no more often than needed; what was made cheaper gives what the plain form gives."""

import random

import pytest
from pyspark.sql import functions as F

from warden.functions import lexed, lexer, native_lex
from warden.operators import learn
from warden.plans.queries import QUERIES
from warden.sources import statements

#: Pieces of texts that both lexers read alike, and of others.
PLAIN = ["select", "Fleet", "t1", "_x", " ", "\n", "'a'", "''", "'it''s'", "'-- /* x'", '"Deck 1"', "7", "2147483648", "1.5", "$1", ".", ",", "(", ")", ";", "=", "!=", "<>", "::", ":", "-", "/* n */", "-- or 1=1\n", "or", "[", "?"]
ODD = ["\\", "é", "$$", "E'x'", "U&'x'", "N'", "'", '"', '""', "{", "/*", "*/", "..", ":=", "0x1F", "1_0", "copy", "uescape", "->>", "\r", "`", "&", "x" * 64, " "]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def read_times(df):
    return plan(df).count("regexp_extract_all")


def spelled(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(PLAIN if r.random() < 0.97 else ODD) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_plain_texts_are_read_as_by_the_full_grammar(spark):
    texts = sorted({*spelled(6000), *(a + b for a in PLAIN for b in [*PLAIN, *ODD]), *(a + b for a in ODD for b in PLAIN)})
    df = spark.createDataFrame([(t,) for t in texts], "query_text string").select("query_text", F.col("query_text").rlike(lexed.PLAIN).alias("plain"))
    rows = lexed.with_tokens(df).collect()
    assert sum(r["plain"] for r in rows) > 2000
    bad = [r["query_text"] for r in rows if (r["_canonical"], r["canonical_sqlstate"] if r["_canonical"] is None else None) != lexer.canonical(r["query_text"])]
    assert not bad, bad[:5]


def test_f1_long_literals_do_not_end_a_task(spark):
    text = "SELECT '" + "x" * 60000 + "', '" + "a''" * 900 + "' /*" + " n" * 30000 + "*/;;"
    assert lexed.with_tokens(spark.createDataFrame([(text,)], "query_text string")).first()["_canonical"] == "SELECT ?str , ?str"


def test_f1_hits_upsert_reads_the_log_once(spark, sf_dir):
    assert read_times(QUERIES["hits_upsert"](spark, sf_dir)) == 1


@pytest.mark.parametrize("reach", [1, 3, 1000])
def test_f1_own_thresholds_by_ranges(spark, reach):
    r = random.Random(reach)
    rows = [(r.choice("ab"), "app", "SELECT", r.choice([None, 0, r.randint(1, 5)]), r.choice([2, 4, 7, 0, None]), r.choice([None, *range(12)])) for _ in range(60)]
    events = spark.createDataFrame(rows, "fingerprint string, role_name string, command_type string, hits long, learn_threshold int, position long")
    got = {x["fingerprint"]: (x["_hits"], x["_margin"]) for x in learn._own_thresholds(events, reach).collect()}
    for key in "ab":
        own = [x for x in rows if x[0] == key]
        upto = lambda p: sum(x[3] or 0 for x in own if x[5] is not None and x[5] <= p)  # noqa: B023, E731
        assert got[key] == (sum(x[3] or 0 for x in own), max(upto(x[5]) - x[4] for x in own if x[4] and x[5] is not None))


#: Reads of a text in a plan, by query: one for each scan of the log that needs any.
READS = {
    "learn_capacity": 2,  # a transaction's ranked keys go back to its observations
    "decide_learn": 2,  # so do the first observations of keys
    "activity_rows": 2,  # as F3
    "keyword_hits": 1,  # F5
    "tautology_hits": 1,  # F6
    "threshold_cross": 1,  # F7
    "learn_commits": 1,  # F8
    "syslog_payload": 1,  # F9
    "alert_payload": 1,  # F10
}


@pytest.mark.parametrize("name", sorted(READS))
def test_texts_are_read_once_a_scan(spark, sf_dir, name):
    assert read_times(QUERIES[name](spark, sf_dir)) == READS[name]


#: Queries that read texts in the scan of the log itself.
SPREAD = {"learn_capacity": "F2", "decide_learn": "F3", "activity_rows": "F4", "keyword_hits": "F5", "tautology_hits": "F6", "syslog_payload": "F9", "alert_payload": "F10"}


@pytest.mark.parametrize("name", sorted(SPREAD))
def test_texts_are_not_read_by_the_task_of_a_row_group(spark, sf_dir, name):
    assert plan(QUERIES[name](spark, sf_dir)).count("RepartitionByExpression") == READS[name]


def test_a_single_row_group_is_dealt_out(spark, tmp_path):
    spark.range(0, 8000, 1, 1).write.parquet(str(tmp_path / "one"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which is for so few rows
    try:
        rows = statements.spread(spark.read.parquet(str(tmp_path / "one")))
        dealt = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(dealt) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(dealt) <= 2 * min(dealt)


def test_f4_dealt_rows_are_not_merged_into_few_tasks(spark, tmp_path):
    spark.range(0, 8000, 1, 1).write.parquet(str(tmp_path / "one"))
    rows = statements.spread(spark.read.parquet(str(tmp_path / "one")), "id")
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_f4_statements_meet_first_observations_before_their_texts_are_looked_at(spark, sf_dir):
    p = plan(QUERIES["activity_rows"](spark, sf_dir))
    joins = [line for line in p.split("\n") if "Join LeftOuter" in line and "_first" in line]
    assert len(joins) == 1 and "command_type" not in joins[0]
    assert p.index(joins[0]) > p.index("regexp_extract_all")  # a plan's first lines run last


@pytest.mark.parametrize("name,near", [("keyword_hits", "(?i)pg_sleep|union"), ("tautology_hits", "[oO][rR]")])  # F5, F6
def test_only_texts_near_a_hit_are_read(spark, sf_dir, name, near):
    p = plan(QUERIES[name](spark, sf_dir))
    assert near in p[p.rindex("regexp_extract_all"):]


def test_f5_f6_no_hit_is_far(spark):
    r = random.Random(7)
    pieces = ["pg_sleep", "PG_Sleep", "union", "Union", "select", "or", "OR", "1", "'1'", "=", " ", " ", "/* n */", "\n", '"', "'", "\\", "(", ";", "é"]
    texts = sorted({"".join(r.choice(pieces) for _ in range(r.randint(0, 9))) for _ in range(6000)} | {"x or 1=1", "é\\ or 1=1 '", "a union/* n */select b"})
    t, c, words = F.col("_tokens"), F.col("query_text"), ["pg_sleep", "union select"]
    rows = lexed.with_tokens(spark.createDataFrame([(x,) for x in texts], "query_text string"))
    hit, or_ = native_lex._first_hit(native_lex.words(c, t), words), F.exists(t, lambda x: F.lower(x) == "or") & F.array_contains(t, "=")
    rows = rows.select(c, hit.isNotNull().alias("hit"), native_lex.near_keyword(c, words).alias("k"), or_.alias("or_"), native_lex.near_tautology(c).alias("o"), lexed.keyword_hit(c, words, t).alias("got"), lexed.tautology(c, t).alias("taut")).collect()
    assert sum(bool(x["hit"]) for x in rows) > 50 and sum(bool(x["taut"]) for x in rows) > 2
    bad = [x for x in rows if x["hit"] and not (x["k"] and x["got"]) or x["or_"] and not x["o"]]
    assert not bad, bad[:3]


@pytest.mark.parametrize("name", ["threshold_cross", "learn_commits"])  # F7, F8
def test_transactions_are_dealt_by_user_over_a_named_number_of_tasks(spark, sf_dir, name):
    p = QUERIES[name](spark, sf_dir)._jdf.queryExecution()
    assert "RepartitionByExpression [user_id" in p.optimizedPlan().toString()
    dealt = [line for line in p.executedPlan().toString().split("\n") if "Exchange hashpartitioning(user_id" in line]
    assert len(dealt) == 1 and "REPARTITION_BY_NUM" in dealt[0]  # and the numbering by user needs no other


def test_f9_texts_are_read_where_no_earlier_gate_refuses(spark):
    import dataclasses

    from warden.operators import decide
    from warden.settings import Settings

    s = Settings(mode="enforce", enable_ip_blocking=True, blocked_ips="10.0.0.9", blacklisted_keywords="pg_sleep")
    p = decide.Policy(spark.createDataFrame([("a", "SELECT", True)], "role_name string, command_type string, is_approved boolean"), None, (("drop", None),))
    texts = ["select 1", "drop 1", "select pg_sleep(1)", "select '\\'' "]
    rows = [(k, role, 1, ip, text) for k, (ip, role, text) in enumerate((ip, role, text) for ip in ("10.0.0.9", "::ffff:a00:9", "10.0.0.1", None) for role in ("a", "b", None) for text in texts)]
    log = spark.createDataFrame(rows, "stmt_id long, role_name string, db_oid long, client_addr string, query_text string").withColumns({"command_type": F.lit("SELECT"), "application_name": F.lit("x"), "decided_at": F.current_timestamp().cast("timestamp_ntz")})
    looked = {x["stmt_id"] for x in decide.gate_reasons(log, s, p, staged=F.col("role_name") == "a").where("_canonical is not null").collect()}
    open_ = [k for k, role, _, ip, text in rows if ip in ("10.0.0.1", None)]
    assert looked == {k for k in open_ if "pg_sleep" in rows[k][4] or rows[k][1] == "a" and rows[k][4] != "drop 1"}
    # what is shown is whole, whatever was looked at before
    every = {x["stmt_id"]: (x["canonical"], x["fingerprint"]) for x in decide.fingerprinted(log, p).collect()}
    for mode in ("learn", "permissive", "enforce"):
        assert {x["stmt_id"]: (x["canonical"], x["fingerprint"]) for x in decide.decide(log, dataclasses.replace(s, mode=mode), p).collect()} == every


@pytest.mark.parametrize("name", ["decide_learn", "activity_rows"])  # F3, F4
def test_only_first_observations_take_fingerprints(spark, sf_dir, name):
    assert plan(QUERIES[name](spark, sf_dir)).count(", 256) AS fingerprint") == 1


def test_pipeline_ngram_join_joins_no_text_that_stays_for_sure(spark):
    from warden.llm import ngram_join

    words = lambda i: " ".join(f"w{i}x{k}" for k in range(9))
    rows = [*((i, words(i)) for i in range(40)), *((100 + i, words(i)) for i in range(5)), (7, words(7)), (8, "quite other words here " + words(8)), (None, words(3)), (None, words(50)), (60, None), (61, "")]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ngram_join.one_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
        kept = sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None)
        sure = plan(out).split("Union")[1].split("\n:- ")[1].split("\n+- ")[0].split("\n:- ")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert kept == sorted([*range(40), 8, 60, 61])
    assert "Join" not in sure and "NOT" in sure.upper(), sure


def test_pipeline_bpe_takes_a_few_times_a_block(monkeypatch):
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa
    import pyarrow.compute as pc
    import pyspark

    from warden.llm import bpe

    monkeypatch.setattr(pyspark, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    taken = lambda f: SimpleNamespace(mapInArrow=f, applyInArrow=f, groupBy=lambda _: taken(f), cogroup=lambda _: taken(f), select=lambda *_: taken(f), withColumnRenamed=lambda *_: taken(f))
    own = taken(lambda run, _: run)  # a frame that gives back what it would run in a task
    vocabulary = SimpleNamespace(value=bpe.tokenizer_json())
    split, encode, join = bpe.split_blocks(own, 1), bpe.encode_words(own, vocabulary), bpe.join_back(own, own, vocabulary, "long")
    r = random.Random(5)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(1000)) for _ in range(256)]
    t, _ = bpe._tokenizer(vocabulary.value)

    def peak(f):
        tracemalloc.start()
        try:
            return f(), tracemalloc.get_traced_memory()[1] / sum(map(len, texts))
        finally:
            tracemalloc.stop()

    rows, split_x = peak(lambda: pa.Table.from_batches(list(split(iter([pa.record_batch({"id": list(range(256)), "text": texts})])))))
    words = rows.filter(pc.is_valid(rows["bucket"]))
    encoded, encode_x = peak(lambda: encode(words))
    out, join_x = peak(lambda: join(rows.filter(pc.is_null(rows["bucket"])), encoded))
    ids = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [memoryview(x).cast("I").tolist() for x in out["ids"].to_pylist()] == ids and out["n_tokens"].to_pylist() == [len(x) for x in ids]
    assert out["decoded"].to_pylist() == [t.decode(x, skip_special_tokens=False) for x in ids]
    assert split_x < 40 and encode_x < 55 and join_x < 25, (split_x, encode_x, join_x)  # by objects: 47, 74 and 42
