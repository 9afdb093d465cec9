"""The general operators on small frames: results against plain Python, and the cases that are easily missed."""

from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from heddle.operators.flatten import child_tables, cut, dewey_nodes, linked_tables, tables_by_path
from heddle.operators.ledger import DONE, LEASED, PENDING, StaleLease, WorkLedger, changed_records, delivery_states, fingerprint, process_changed
from heddle.operators.orphans import ForeignKey, Keyed, cascade, direct_orphans, orphan_report
from heddle.operators.salted import Agg, heavy_hashes, is_heavy, salted_aggregate, share_of_rows
from heddle.operators.skewjoin import lookup_join
from heddle.session import row_salt, with_row


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


KEYED = [(1, "a", 2.0)] * 40 + [(1, None, None), (None, "b", 1.0), (None, "b", 1.0), (2, "c", 5.0), (3, None, None)]


def test_salted_aggregate_is_plain_aggregate(spark):
    df = spark.createDataFrame(KEYED, "k int, v string, x double").repartition(3)
    aggs = [Agg("n"), Agg("nv", "count", "v"), Agg("s", "sum", "x"), Agg("lo", "min", "x"), Agg("hi", "max", "x"), Agg("m", "avg", "x"), Agg("d", "count_distinct", "v")]
    got = salted_aggregate(df, ["k"], aggs, salts=4, heavy_share=0.3)
    want = df.groupBy("k").agg(F.count("*"), F.count("v"), F.sum("x"), F.min("x"), F.max("x"), F.avg("x"), F.countDistinct("v"))
    assert rows(got) == rows(want)


def test_salted_aggregate_of_nothing_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "k int, n int")
    assert rows(salted_aggregate(empty, ["k"], [Agg("n")])) == []
    clash = spark.createDataFrame([(1, 5, "x"), (1, 6, "y")], "k int, n int, __salt2 string")
    assert rows(salted_aggregate(clash, ["k"], [Agg("n")], heavy_share=0.1)) == [(1, 2)]


def test_heavy_keys_are_bounded(spark):
    df = spark.createDataFrame(KEYED, "k int, v string, x double")
    hot = heavy_hashes(df, ["k"], 0.5)
    assert {r["k"] for r in df.filter(is_heavy(df, ["k"], hot)).collect()} == {1}
    assert heavy_hashes(df.filter("false"), ["k"], 0.5) == []
    # more distinct keys than a sketch has counters: the heavy one is never missed, the list stays short
    many = spark.range(60_000).select(F.when(F.col("id") % 50 == 0, 7).otherwise(F.col("id") + 1000).alias("k"))
    hot = heavy_hashes(many, ["k"], 0.015)
    assert len(hot) <= 2 / 0.015 and many.filter(is_heavy(many, ["k"], hot) & (F.col("k") == 7)).count() == 1200
    counts = df.groupBy(F.lit("t").alias("src"), "k").agg(F.count("*").alias("n"))
    assert [r["k"] for r in share_of_rows(counts, "src", "n", 0.5).collect()] == [1]


def test_salt_splits_a_hot_key_in_one_partition(spark, tmp_path):
    spark.range(20_000).select(F.lit(1).alias("k")).coalesce(1).write.parquet(str(tmp_path / "hot"))
    df = with_row(spark.read.parquet(str(tmp_path / "hot")))
    assert df.select(F.spark_partition_id()).distinct().count() == 1
    used = df.groupBy(row_salt(df, 32, "__row").alias("s")).count().collect()
    assert len(used) >= 16 and max(r["count"] for r in used) < 2 * 20_000 / 32
    assert df.select(row_salt(df, 32, "__row")).collect() == df.select(row_salt(df, 32, "__row")).collect()
    assert rows(salted_aggregate(df, ["k"], [Agg("n")], row="__row")) == [(1, 20_000)]


def test_lookup_join_keeps_rows_with_hot_and_null_keys(spark):
    left = spark.createDataFrame(KEYED, "k int, v string, x double")
    right = spark.createDataFrame([(1, "one"), (3, "three")], "k int, name string")
    assert Counter(rows(lookup_join(left, right, ["k"], share=0.2))) == Counter(rows(left.join(right, ["k"], "left")))


def test_ledger_states_fences_and_retries(spark, tmp_path):
    now = [100.0]
    ledger = WorkLedger(spark, str(tmp_path / "ledger"), lease_seconds=10, clock=lambda: now[0])
    ledger.add(["a", "b"])
    ledger.add(["a"])
    assert ledger.items() == ["a", "b"] and ledger.state("a") == PENDING
    first = ledger.lease("a", "w1")
    assert ledger.state("a") == LEASED and ledger.lease("a", "w2") is None
    now[0] += 11
    assert ledger.state("a") == PENDING
    second = ledger.lease("a", "w2")
    assert second.fence == first.fence + 1 and second.path != first.path
    with pytest.raises(StaleLease):
        ledger.commit(first)
    ledger.commit(second)
    ledger.commit(second)  # a repeated commit of the same attempt is absorbed
    assert ledger.state("a") == DONE and ledger.output("a") == second.path and ledger.lease("a") is None
    calls = []

    def compute(item):
        calls.append(item)
        if len(calls) == 1:
            raise RuntimeError("broke off")
        return spark.range(2)

    with pytest.raises(RuntimeError):
        ledger.run(compute)
    assert ledger.state("b") == PENDING  # given back
    assert ledger.run(compute) == ["b"] and ledger.run(compute) == []
    assert calls == ["b", "b"] and ledger.state("b") == DONE and len(ledger.outputs()) == 2


def test_ledger_survives_crashes(spark, tmp_path):
    now = [100.0]
    ledger = WorkLedger(spark, str(tmp_path / "ledger"), lease_seconds=10, clock=lambda: now[0])
    ledger.add(["a"])
    home = tmp_path / "ledger" / "items" / "a"
    # a writer that died before its entry had a number leaves a half file that nobody reads
    (home / "_dead").write_text('{"owner')
    assert ledger.state("a") == PENDING
    lease = ledger.lease("a", "w1")
    # a worker that died: the lease expires, then another takes it, even right before the first one commits
    now[0] += 11
    second = ledger.lease("a", "w2")
    with pytest.raises(StaleLease):
        ledger.commit(lease)
    ledger.commit(second)
    with pytest.raises(StaleLease):
        ledger.commit(lease)
    ledger.give_back(lease)
    assert ledger.output("a") == second.path and ledger.state("a") == DONE
    with pytest.raises(ValueError):
        ledger.add(["a/b"])


def test_only_one_of_many_gets_a_lease(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    ledgers = [WorkLedger(spark, str(tmp_path / "ledger")) for _ in range(8)]
    ledgers[0].add(["a"])
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda x: x.lease("a"), ledgers))
    assert sum(g is not None for g in got) == 1


def test_process_changed_takes_up_where_it_stood(spark, tmp_path):
    calls, planned = [], []

    def pending():
        planned.append(1)
        return spark.range(40).withColumnRenamed("id", "rec_id")

    def process(frame):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("broke off")
        return frame

    root = str(tmp_path / "ledger")
    with pytest.raises(RuntimeError):
        process_changed(pending, root, "rec_id", spark, process=process, workers=1)
    ledger, done = process_changed(pending, root, "rec_id", spark, process=process)
    assert len(planned) == 1 and len(done) == 1 and len(calls) == 5
    assert sorted(r[0] for r in spark.read.parquet(*ledger.outputs()).collect()) == list(range(40))
    # a second run gives nothing new
    assert process_changed(pending, root, "rec_id", spark, process=process)[1] == [] and len(planned) == 1 and len(calls) == 5
    spark.range(3).write.parquet(str(tmp_path / "t"))
    before = fingerprint(spark.read.parquet(str(tmp_path / "t")))
    assert before == fingerprint(spark.read.parquet(str(tmp_path / "t")))
    spark.range(4).write.mode("overwrite").parquet(str(tmp_path / "t"))
    assert before != fingerprint(spark.read.parquet(str(tmp_path / "t")))


def test_changed_records(spark):
    t = lambda d, h=0: datetime(2025, 1, d, h)
    new, old = t(20), t(5)
    data = [
        (1, "2025-01-02 00:00:00.0", old), (1, "2025-01-02T00:00:00.0", new),  # unchanged
        (2, "2025-01-02 00:00:00.0", old), (2, " 2025-01-15 00:00:00 ", new),  # changed
        (3, None, new), (3, None, new),  # new, undated, twice
        (4, None, old), (4, "", new),  # still undated
        (5, "2025-01-03 00:00:00.0", old),  # old only
        (6, "2025-01-16 00:00:00.0", new), (7, "2025-01-16 00:00:00.0", new), (8, "2025-01-16 00:00:00.0", new), (None, "2025-01-16 00:00:00.0", new), (9, "x", None),
    ]
    df = spark.createDataFrame(data, "id long, s string, extracted_at timestamp_ntz")
    runs = spark.createDataFrame([(1, "t", t(10), "succeeded"), (2, "t", t(25), "failed"), (3, "t", t(26), "rolled_back"), (4, "u", t(28), "succeeded")], "run_id long, src string, cutoff_at timestamp_ntz, run_status string")
    log = spark.createDataFrame([(2, "t", 6, t(16), True), (3, "t", 7, t(16), True), (2, "t", 8, t(16), False), (2, "t", 3, None, False)], "run_id long, src string, rec_id long, change_stamp timestamp_ntz, acked boolean")
    got = changed_records(df, runs, log, src="t", key="id", stamps=["s"])
    assert [r[1] for r in rows(got)] == [2, 3, 7, 8]
    assert changed_records(df, runs.filter("false"), log.filter("false"), src="t", key="id", stamps=["s"]).count() == 8
    assert changed_records(df.filter("false"), runs, log, src="t", key="id", stamps=["s"]).count() == 0
    states = {(r["rec_id"], r["run_id"]): r["state"] for r in delivery_states(runs, log).collect()}
    assert states == {(6, 2): "done", (7, 3): "fenced", (8, 2): "pending", (3, 2): "pending"}


def test_orphans_direct_and_inherited(spark):
    t = lambda d: datetime(2025, 1, d)
    a = spark.createDataFrame([(1, t(1)), (2, t(9)), (3, t(1)), (4, t(1))], "a long, extracted_at timestamp_ntz")
    b = spark.createDataFrame([(10, 1, t(2)), (11, 2, t(2)), (12, 3, t(2)), (13, 99, t(2)), (14, None, t(2)), (15, 0, t(2)), (13, 99, t(3)), (16, 4, t(2))], "b long, a long, extracted_at timestamp_ntz")
    c = spark.createDataFrame([(10, t(3)), (13, t(3)), (None, t(3)), (77, t(3))], "b long, extracted_at timestamp_ntz")
    dels = spark.createDataFrame([("a", 3, t(5)), ("a", 4, t(1).replace(year=2024)), ("b", 77, t(1)), ("zzz", 1, t(8))], "table string, rec_id long, deleted_at timestamp_ntz")
    tables = {"a": Keyed(a, "a"), "b": Keyed(b, "b"), "c": Keyed(c, None)}
    fks = [ForeignKey("b", "b", "a", "a"), ForeignKey("c", "b", "b", "b")]
    got = {(r["child_table"], r["child_id"], r["reason"], r["period"]) for r in direct_orphans(tables, fks, dels).collect()}
    assert got == {("b", 11, "late", "2025-01"), ("b", 12, "deleted", "2025-01"), ("b", 13, "missing", "2025-01"), ("c", 77, "deleted", "2025-01")}
    whole = cascade(tables, fks, dels)
    assert {(r["child_table"], r["child_id"], r["level"]) for r in whole.filter("kind = 'inherited'").collect()} == {("c", 13, 1)}
    assert orphan_report(whole).agg(F.sum("n_refs")).first()[0] == 5
    none = {k: Keyed(v.frame.filter("false"), v.key) for k, v in tables.items()}
    assert cascade(none, fks, dels).count() == 0


def test_orphans_below_hot_parents_and_with_two_keys(spark):
    t = lambda d: datetime(2025, 1, d)
    a = spark.createDataFrame([(1, t(1)), (2, t(9))], "a long, extracted_at timestamp_ntz")
    # two references of one record; most refer to a parent that is late
    b = spark.createDataFrame([(i, 2, 1, t(2)) for i in range(1, 301)] + [(500, 1, 7, t(2)), (501, None, 0, t(2))], "b long, up long, other long, extracted_at timestamp_ntz")
    c = spark.createDataFrame([(i, i % 300 + 1, t(3)) for i in range(600)], "c long, b long, extracted_at timestamp_ntz")
    dels = spark.createDataFrame([], "table string, rec_id long, deleted_at timestamp_ntz")
    tables = {"a": Keyed(a, "a"), "b": Keyed(b, "b"), "c": Keyed(c, "c")}
    fks = [ForeignKey("b", "b", "up", "a"), ForeignKey("b", "b", "other", "a"), ForeignKey("c", "c", "b", "b")]
    direct = direct_orphans(tables, fks, dels, share=0.1)
    assert direct.filter("reason = 'late' AND parent_id = 2").count() == 300 and direct.filter("child_id = 500").select("parent_id", "reason").collect() == [(7, "missing")] and direct.count() == 301
    assert cascade(tables, fks, dels, share=0.1).filter("kind = 'inherited'").count() == 600


def test_cascade_with_a_cycle_ends(spark):
    t = datetime(2025, 1, 1)
    a = spark.createDataFrame([(1, 2, t), (2, 1, t), (3, 9, t), (4, 3, t), (5, 4, t)], "id long, up long, extracted_at timestamp_ntz")
    dels = spark.createDataFrame([], "table string, rec_id long, deleted_at timestamp_ntz")
    got = cascade({"a": Keyed(a, "id")}, [ForeignKey("a", "id", "up", "a")], dels)
    assert {(r["child_id"], r["level"]) for r in got.collect()} == {(3, 0), (4, 1), (5, 2)}


XML = '<r id="7"><x:marc xmlns:x="u"><x:record><x:datafield tag="1"/><x:datafield tag="2"/></x:record></x:marc><hs><h><h_id> 5 </h_id><is><i id="8"/><i><i_id>9</i_id></i></is></h></hs><h id="6"><i id="10"/></h></r>'


def test_flatten(spark):
    data = [(7, XML), (7, XML), (8, "<r><h id='1'>"), (9, None), (10, ""), (11, "<r/>"), (12, '<!DOCTYPE r [<!ENTITY e "x">]><r>&e;<h id="3"/></r>'), (None, "<r/>"), (13, '<r><datafield/><marc><y><datafield/></y></marc></r>')]
    df = spark.createDataFrame(data, "bib long, x string").withColumn("rec_key", F.lit("clash"))
    nodes = dewey_nodes(df, "bib", "x")
    assert nodes.filter("rec_key = 8").count() == 0
    # a well-formed record with an entity declaration is kept, the reference as it is written
    assert nodes.filter("rec_key = 12 AND name = 'r'").first()["text"] == "&e;"
    want = [(7, "h", 7, 5), (7, "h", 7, 6), (7, "i", 5, 8), (7, "i", 5, 9), (7, "i", 6, 10), (7, "datafield", 7, 1), (7, "datafield", 7, 2), (12, "h", 12, 3), (13, "datafield", 13, 1)]
    for got in (child_tables(nodes, {"h": "h_id", "i": "i_id"}, {"datafield": "marc"}), linked_tables(df, "bib", "x", {"h": "h_id", "i": "i_id"}, {"datafield": "marc"})):
        assert rows(got) == sorted(want, key=str)
    assert linked_tables(df, "bib", "x", {}, {"datafield": None}).filter("rec_key = 13").count() == 2
    assert linked_tables(df.filter("false"), "bib", "x", {"h": "h_id"}).count() == 0
    tables = tables_by_path(nodes)
    assert tables["r/hs/h/is/i"].count() == 2 and {r["parent"] for r in tables["r/hs/h/is/i"].collect()} == {"1.2.1.2"}
    assert spark.range(1).select(cut(F.lit("1.2.13"), 2)).first()[0] == "1"
    with pytest.raises(Exception):
        dewey_nodes(df.withColumn("bib", F.array("bib")), "nothere", "x")


def test_flatten_one_holding_in_two_elements_and_missing_ids(spark):
    x = '<r><h id="1"><i id="2"/></h><h id="1"><i id="3"/></h><h><i id="4"/></h></r>'
    df = spark.createDataFrame([(1, x)], "b long, x string")
    got = rows(child_tables(dewey_nodes(df, "b", "x"), {"h": "h_id", "i": "i_id"}))
    assert got == rows(linked_tables(df, "b", "x", {"h": "h_id", "i": "i_id"})) == sorted([(1, "h", 1, 1), (1, "h", 1, None), (1, "i", 1, 2), (1, "i", 1, 3), (1, "i", None, 4)], key=str)
