"""Queries of the record-flow operators over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle import ids
from heddle.functions import marcfields as mf
from heddle.functions import text
from heddle.operators import marc, records
from heddle.operators.integrate import Integrator, from_config
from heddle.session import load
from heddle.sinks import files as sinks
from heddle.sources import sqltemplate

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return register


def _tree(spark: SparkSession, sf: str, fused: bool = False) -> DataFrame:
    customer, orders, lineitem = load(spark, sf, "customer", "orders", "lineitem")
    line = lineitem.select(F.col("l_orderkey").alias("O"), F.col("l_linenumber").cast("bigint").alias("L"), "l_quantity").join(
        orders.select(F.col("o_orderkey").alias("O"), F.col("o_custkey").alias("C")), "O")
    lines = line.groupBy("C", "O", "L").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("decimal(12,2)")).alias("quantity"))
    tree = Integrator(fused)
    tree.add("/record/customer", customer.select(F.col("c_custkey").alias("C"), F.col("c_name").alias("name")), ["C"])
    tree.add("/record/orders/order", orders.select(F.col("o_custkey").alias("C"), F.col("o_orderkey").alias("O"), F.col("o_orderstatus").alias("status")), ["C", "O"])
    tree.add("/record/orders/order/lines/line", lines, ["C", "O", "L"])
    return tree.compile()


def _flat(frame: DataFrame) -> DataFrame:
    order = F.transform("orders", lambda o: F.concat(
        o["_id"].cast("string"), F.lit(":"), o["order"]["status"], F.lit(":"),
        F.array_join(F.transform(F.coalesce(o["order"]["lines"], F.array().cast("array<struct<_id:bigint,line:struct<n:bigint,quantity:decimal(22,2)>>>")),
                                 lambda x: F.concat(x["_id"].cast("string"), F.lit("x"), x["line"]["n"].cast("string"))), ",")))
    return frame.select(F.col("C").alias("c_custkey"), F.col("customer.name").alias("c_name"), F.coalesce(F.size("orders"), F.lit(0)).alias("n_orders"), F.array_join(order, ";").alias("orders"))


_TREE = """WITH l AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
  o AS (SELECT o_custkey, o_orderkey, o_orderstatus, coalesce(string_agg(l_linenumber || 'x' || n, ',' ORDER BY l_linenumber), '') AS lines
    FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY ALL),
  g AS (SELECT o_custkey, count(*) AS n, string_agg(o_orderkey || ':' || o_orderstatus || ':' || lines, ';' ORDER BY o_orderkey) AS t FROM o GROUP BY o_custkey)
  SELECT coalesce(c_custkey, o_custkey) AS c_custkey, c_name, coalesce(n, 0)::INT AS n_orders, t AS orders FROM customer FULL JOIN g ON o_custkey = c_custkey"""


@query(_TREE)
def integrate_three_level(spark, sf):
    return _flat(_tree(spark, sf))


@query(_TREE)
def integrate_three_level_fused(spark, sf):
    return _flat(_tree(spark, sf, fused=True))


def _two(spark, sf, required=(False, False)):
    orders = load(spark, sf, "orders").select(F.col("o_orderkey").alias("O"), F.col("o_custkey").alias("cust"))
    tree = Integrator().add("/record/a", orders.filter("O % 2 = 0 OR O % 3 = 0"), ["O"], required[0]).add("/record/b", orders.filter("O % 2 = 1"), ["O"], required[1])
    return tree.compile().select("O", F.col("a.cust").alias("a"), F.col("b.cust").alias("b"))


_A, _B = "(SELECT o_orderkey AS O, o_custkey AS a FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0)", "(SELECT o_orderkey AS O, o_custkey AS b FROM orders WHERE o_orderkey % 2 = 1)"


@query(f"SELECT O, a, b FROM {_A} FULL JOIN {_B} USING (O)")
def integrate_full_outer(spark, sf):
    return _two(spark, sf)


@query(f"SELECT O, a, b FROM {_A} LEFT JOIN {_B} USING (O)")
def integrate_required(spark, sf):
    return _two(spark, sf, (True, False))


@query(f"SELECT O, a, b FROM {_A} JOIN {_B} USING (O)")
def integrate_both_required(spark, sf):
    return _two(spark, sf, (True, True))


@query("""SELECT o_orderkey AS O, o_custkey AS cust, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS lines
  FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) ON l_orderkey = o_orderkey WHERE o_orderkey % 2 = 0 GROUP BY ALL""")
def integrate_orphans_dropped(spark, sf):
    orders, lineitem = load(spark, sf, "orders", "lineitem")
    some = orders.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("O"), F.col("o_custkey").alias("cust"))
    lines = lineitem.select(F.col("l_orderkey").alias("O"), F.col("l_linenumber").cast("bigint").alias("L")).distinct()
    tree = Integrator().add("/record/order", some, ["O"]).add("/record/order/lines/line", lines, ["O", "L"])
    return tree.compile().select("O", F.col("order.cust").alias("cust"), F.array_join(F.transform("order.lines", lambda x: x["_id"].cast("string")), ",").alias("lines"))


@query("""SELECT n_nationkey AS n_id, n_name, count(s_suppkey)::INT AS n_suppliers, string_agg(s_name, ',' ORDER BY s_suppkey) AS suppliers
  FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL""")
def integrate_aggregate_level(spark, sf):
    nation, supplier = load(spark, sf, "nation", "supplier")
    tree = Integrator().add("/record/nation", nation.select(F.col("n_nationkey").cast("bigint").alias("N"), "n_name"), ["N"])
    tree.add("/record/suppliers/supplier", supplier.select(F.col("s_nationkey").cast("bigint").alias("N"), F.col("s_suppkey").alias("S"), "s_name"), ["N", "S"])
    return tree.compile().select(
        F.col("N").cast("int").alias("n_id"), F.col("nation.n_name").alias("n_name"), F.coalesce(F.size("suppliers"), F.lit(0)).alias("n_suppliers"),
        F.array_join(F.transform("suppliers", lambda s: s["supplier"]["s_name"]), ",").alias("suppliers"))


@query("""SELECT coalesce(bib_id, 0) AS bib_id, count(*)::INT AS n_holdings, sum(n)::BIGINT AS n_rows FROM (
  SELECT coalesce(bib_id, 0) AS bib_id, coalesce(mfhd_id, 0) AS mfhd_id, count(*) AS n FROM mfhd GROUP BY ALL) GROUP BY ALL""")
def nest_by_ids(spark, sf):
    nested = records.nest(load(spark, sf, "mfhd").select("bib_id", "mfhd_id", "location_name"), ["bib_id", "mfhd_id"])
    return nested.select("bib_id", F.size("mfhd_id_list").alias("n_holdings"), F.aggregate("mfhd_id_list", F.lit(0).cast("bigint"), lambda a, x: a + F.size(x["rows"])).alias("n_rows"))


@query("""SELECT l_orderkey, l_linenumber, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS parts FROM lineitem GROUP BY ALL""")
def merge_duplicate_paths(spark, sf):
    nested = records.nest(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"])
    rows = nested.select("l_orderkey", F.explode("l_linenumber_list").alias("x"))
    return rows.select("l_orderkey", F.col("x.l_linenumber").cast("int").alias("l_linenumber"), F.array_join(F.transform("x.rows", lambda r: r["l_partkey"].cast("string")), ",").alias("parts"))


@query("SELECT item_id, coalesce(bib_id, 0) AS bib_id, 'ITEM-' || item_id AS rendered, num_holds::VARCHAR AS holds FROM item")
def ids_rendered(spark, sf):
    item = load(spark, sf, "item")
    return item.select("item_id", ids.id_column("bib_id").alias("bib_id"), ids.render_id("ITEM", "item_id").alias("rendered"), ids.numeric_text("num_holds").alias("holds"))


@query("SELECT l_orderkey, l_linenumber, trunc(l_extendedprice)::BIGINT::VARCHAR AS price FROM lineitem")
def numeric_truncate(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ids.numeric_text("l_extendedprice").alias("price"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || '.' || (floor((epoch_us(ts) % 1000000) / 100000))::INT AS at FROM events")
def timestamp_render(spark, sf):
    return load(spark, sf, "events").select("event_id", ids.timestamp_text("ts").alias("at"))


@query("SELECT o_orderkey, o_orderstatus, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 100)::BIGINT AS chunk_no FROM orders")
def split_chunks(spark, sf):
    return records.split_chunks(load(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], "o_orderkey", 100)


@query("""SELECT o_custkey, o_orderkey, sum((o_orderstatus = 'F')::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::BIGINT AS chunk_no FROM orders""")
def split_boundary(spark, sf):
    orders = load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return records.split_at(orders, ["o_custkey"], "o_orderkey", F.col("o_orderstatus") == "F").drop("o_orderstatus")


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, 0::BIGINT AS doc_pos FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, 1 FROM supplier")
def concat_all(spark, sf):
    customer, supplier = load(spark, sf, "customer", "supplier")
    return records.concat_all([
        customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")),
        supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
    ])


@query("""SELECT doc_id, source, sum(c) OVER (ORDER BY doc_id)::BIGINT - 1 AS run_no FROM (
  SELECT doc_id, source, (source IS DISTINCT FROM lag(source) OVER (ORDER BY doc_id) OR row_number() OVER (ORDER BY doc_id) = 1)::INT AS c FROM documents)""")
def concat_runs(spark, sf):
    return records.concat_runs(load(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey, ((row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1) // 6)::BIGINT AS batch_no FROM lineitem WHERE l_quantity < 10")
def token_batches(spark, sf):
    line = load(spark, sf, "lineitem").filter("l_quantity < 10").withColumn("at", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return records.token_batches(line.select("l_orderkey", "l_linenumber", "l_partkey", "at"), "at", 6).drop("at")


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderpriority = '1-URGENT')")
def pivot_semijoin(spark, sf):
    orders, lineitem = load(spark, sf, "orders", "lineitem")
    return records.pivot(orders.filter("o_orderpriority = '1-URGENT'"), "o_orderkey", lineitem.select("l_orderkey", "l_partkey", "l_linenumber"), "l_orderkey")


@query("""SELECT c_custkey, c_name, b AS batch_no FROM customer JOIN (
  SELECT DISTINCT o_custkey, b FROM (SELECT o_custkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 6)::BIGINT AS b FROM orders)) ON o_custkey = c_custkey""")
def pivot_batches(spark, sf):
    orders, customer = load(spark, sf, "orders", "customer")
    return records.pivot_batches(orders, "o_custkey", "o_orderkey", 6, customer.select(F.col("c_custkey"), "c_name"), "c_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (1, 2, 5)")
def sql_template_list(spark, sf):
    load(spark, sf, "orders").createOrReplaceTempView("heddle_orders")
    return sqltemplate.run(spark, r"SELECT o_orderkey, o_custkey FROM heddle_orders<\ WHERE o_custkey IN (<\BIGINT*\>)\>", ["1", "2", "5"])


@query("SELECT o_orderkey, o_custkey FROM orders")
def sql_suppress_clause(spark, sf):
    load(spark, sf, "orders").createOrReplaceTempView("heddle_orders")
    return sqltemplate.run(spark, r"SELECT o_orderkey, o_custkey FROM heddle_orders<\ WHERE o_custkey IN (<\BIGINT*\>)\>", suppress=True)


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_discount < 0.05::FLOAT")
def sql_template_fraction(spark, sf):
    load(spark, sf, "lineitem").createOrReplaceTempView("heddle_lineitem")
    return sqltemplate.run(spark, r"SELECT l_orderkey, l_linenumber, l_partkey FROM heddle_lineitem WHERE l_discount < CAST(<\DECIMAL\> AS FLOAT)", ["1/20"])


def _chunked(spark, sf):
    mfhd = load(spark, sf, "mfhd").select("mfhd_id", "display_call_no").groupBy("mfhd_id").agg(F.max("display_call_no").alias("call_no"))
    return mfhd.withColumn("chunk_no", F.expr("mfhd_id div 50"))


_CHUNKED = "(SELECT mfhd_id, max(display_call_no) AS call_no, mfhd_id // 50 AS chunk_no FROM mfhd GROUP BY mfhd_id)"


@query(f"SELECT mfhd_id, call_no, chunk_no FROM (SELECT *, bool_or(call_no IS NULL) OVER (PARTITION BY chunk_no) AS bad FROM {_CHUNKED}) WHERE NOT bad")
def process_drop_chunk(spark, sf):
    return records.drop_failed_chunks(_chunked(spark, sf), ["chunk_no"], F.col("call_no").isNull())


@query(f"SELECT mfhd_id, call_no, chunk_no FROM {_CHUNKED} WHERE call_no IS NOT NULL")
def process_isolate_record(spark, sf):
    return records.isolate(_chunked(spark, sf), F.col("call_no").isNull())[0]


@query(f"SELECT chunk_no, string_agg(mfhd_id::VARCHAR, ',' ORDER BY mfhd_id::VARCHAR) AS record_ids FROM {_CHUNKED} WHERE call_no IS NULL GROUP BY chunk_no")
def failure_log(spark, sf):
    return records.failure_log(records.isolate(_chunked(spark, sf), F.col("call_no").isNull())[1], "mfhd_id", ["chunk_no"])


@query("SELECT mfhd_id, upper(call_no) AS value, CASE WHEN call_no IS NULL THEN 'ValueError: no call number' END AS error FROM " + _CHUNKED)
def transform_failures(spark, sf):
    def work(row):
        if row["call_no"] is None:
            raise ValueError("no call number")
        return {"value": row["call_no"].upper()}

    return records.transform_records(_chunked(spark, sf), work, "value string", ["mfhd_id"])


@query("""SELECT p_partkey, p_name, trim(regexp_replace(p_name || '  x ', '[ \\t\\r\\n]+', ' ', 'g')) AS spaced, replace(p_brand, '-', '') AS bare,
  CASE WHEN instr(p_name, ' ') > 0 THEN split_part(p_name, ' ', 1) ELSE '' END AS before, CASE WHEN instr(p_name, ' ') > 0 THEN substr(p_name, instr(p_name, ' ') + 1) ELSE '' END AS after,
  CASE WHEN instr(p_brand, '#') > 0 THEN split_part(p_brand, '#', 2) ELSE '' END AS without, regexp_replace(p_brand, '[^0-9]+', '', 'g') AS digits FROM part""")
def text_functions(spark, sf):
    return load(spark, sf, "part").select(
        "p_partkey", "p_name", text.normalize_space(F.concat("p_name", F.lit("  x "))).alias("spaced"), text.strip_hyphen("p_brand").alias("bare"),
        text.substring_before("p_name", " ").alias("before"), text.substring_after("p_name", " ").alias("after"), text.substring_after("p_brand", "#").alias("without"), text.digits_only("p_brand").alias("digits"))


#: Ends that the trimming functions tell apart, given to the parts' names in turn.
_ENDS = ["", ".", " . ", "etc.", "etc. ", " ,", ", ", " =", "= ", " ;", ";  ", " : ", " / ", ":;", ";:", "||", "| | ", ' "q" & <x> (y)', "--", "  % ", "\t\n"]
_ENDED = "[" + ", ".join("'" + e.replace("\t", "' || chr(9) || '").replace("\n", "' || chr(10) || '") + "'" for e in _ENDS) + "]"


@query(f"""WITH e AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN ' % ' ELSE '' END || p_name || ({_ENDED})[p_partkey % {len(_ENDS)} + 1] AS t FROM part)
  SELECT p_partkey, CASE WHEN suffix(t, 'etc.') THEN t ELSE regexp_replace(t, '\\.[ \\t\\r\\n]*$', '') END AS no_period, regexp_replace(t, ',[ \\t\\r\\n]*$', '') AS no_comma, regexp_replace(t, '=[ \\t\\r\\n]*$', '') AS no_equal,
    regexp_replace(t, '[ \\t\\r\\n]*;[ \\t\\r\\n]*$', '') AS no_semicolon, regexp_replace(t, '[ \\t\\r\\n]*:[ \\t\\r\\n]*$', '') AS no_colon, regexp_replace(t, '[ \\t\\r\\n]*/[ \\t\\r\\n]*$', '') AS no_slash,
    regexp_replace(regexp_replace(t, ':[ \\t\\r\\n]*$', ''), ';[ \\t\\r\\n]*$', '') AS no_both, regexp_replace(t, '\\|+[ \\t\\r\\n]*$', '') AS no_pipes, replace(t, '"', '''') AS quotes, replace(t, '&', 'and') AS amp,
    regexp_replace(t, '[^a-zA-Z0-9_-]+$', '') AS alnum, regexp_replace(t, '^[ \\t\\r\\n]*%[ \\t\\r\\n]*', '') AS no_percent, CASE WHEN suffix(t, '.') THEN t ELSE t || '.' END AS with_period,
    regexp_replace(regexp_replace(t, '[ \\t\\r\\n]+', ' ', 'g'), '^ +| +$', '', 'g') AS spaces,
    regexp_replace(regexp_replace(regexp_replace(t, '[ \\t\\r\\n]+', ' ', 'g'), '^ +| +$', '', 'g'), '\\.[ \\t\\r\\n]*$', '') AS spaces_period,
    replace(replace(t, '(', ''), ')', '') AS no_parens, replace(replace(t, '<', ''), '>', '') AS no_angles, replace(t, '"', '') AS no_quotes,
    array_to_string(list_transform(string_split(t, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS capitals, substr(t, 3, 4) AS part, '<![CDATA[' || t || ']]>' AS cdata FROM e""")
def text_functions_2(spark, sf):
    part = load(spark, sf, "part")
    t = F.concat(F.when(F.col("p_partkey") % 2 == 0, " % ").otherwise(""), F.col("p_name"), F.element_at(F.array(*map(F.lit, _ENDS)), (F.col("p_partkey") % len(_ENDS) + 1).cast("int")))
    return part.select("p_partkey", t.alias("t")).select(
        "p_partkey", text.trim_trailing_period("t").alias("no_period"), text.trim_trailing("t", ",").alias("no_comma"), text.trim_trailing("t", "=").alias("no_equal"),
        text.trim_trailing("t", ";").alias("no_semicolon"), text.trim_trailing("t", ":").alias("no_colon"), text.trim_trailing("t", "/").alias("no_slash"),
        text.trim_colon_and_semicolon("t").alias("no_both"), text.trim_pipes("t").alias("no_pipes"), text.convert_quotes("t").alias("quotes"), text.convert_amp("t").alias("amp"),
        text.trim_all_but_alphanumeric("t").alias("alnum"), text.trim_leading_percent("t").alias("no_percent"), text.add_trailing("t", ".").alias("with_period"),
        text.trim_only_spaces("t").alias("spaces"), text.trim_whitespace("t").alias("spaces_period"), text.trim_parens("t").alias("no_parens"), text.trim_angle_brackets("t").alias("no_angles"),
        text.trim_double_quotes("t").alias("no_quotes"), text.init_cap("t").alias("capitals"), text.substring_from("t", 3, 4).alias("part"), text.cdata("t").alias("cdata"))


def _repeated(spark, sf, fused):
    line = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("O"), F.col("l_linenumber").cast("bigint").alias("L"), "l_partkey", "l_suppkey")
    tree = Integrator(fused).add("/record/part", line.drop("l_suppkey"), ["O", "L"]).add("/record/supplier", line.filter("L % 2 = 0").drop("l_partkey"), ["O", "L"])
    return tree.compile().select("O", "L", F.col("part.l_partkey").alias("part"), F.col("supplier.l_suppkey").alias("supplier"))


_REPEATED = """SELECT a.l_orderkey AS O, a.l_linenumber::BIGINT AS L, a.l_partkey AS part, b.l_suppkey AS supplier FROM lineitem a
  LEFT JOIN (SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_linenumber % 2 = 0) b USING (l_orderkey, l_linenumber)"""


@query(_REPEATED)
def integrate_repeated_ids(spark, sf):
    return _repeated(spark, sf, False)


@query(_REPEATED)
def integrate_repeated_ids_fused(spark, sf):
    return _repeated(spark, sf, True)


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def lookup_broadcast(spark, sf):
    customer, nation, region = load(spark, sf, "customer", "nation", "region")
    found = text.lookup(customer, "c_nationkey", nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value")), name="n_name")
    found = text.lookup(found, "c_nationkey", nation.select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("value")), name="region")
    return text.lookup(found, "region", region.select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("value")), name="r_name").select("c_custkey", "n_name", "r_name")


@query("""SELECT bib_id, count(*)::BIGINT AS n_records, max(n)::INT AS most_subjects FROM (
  SELECT bib_id, len(list_filter(coalesce(marc_record.datafield, []), lambda d: d.tag = '650')) AS n FROM bib) GROUP BY bib_id""")
def marc_paths(spark, sf):
    bib = load(spark, sf, "bib")
    return bib.select("bib_id", F.size(mf.fields(F.col("marc_record"), ["650"])).alias("n")).groupBy("bib_id").agg(F.count(F.lit(1)).alias("n_records"), F.max("n").alias("most_subjects"))


def _whole(bib: DataFrame) -> DataFrame:
    r = F.col("marc_record")
    fine = (
        r["leader"].isNotNull() & (F.substring(r["leader"], 10, 1) == "a") & (F.octet_length(r["leader"]) == 24) & r["datafield"].isNotNull() & r["controlfield"].isNotNull()
        & F.forall(r["controlfield"], lambda f: f["value"].isNotNull())
        & F.forall(r["datafield"], lambda d: d["subfield"].isNotNull() & F.forall(d["subfield"], lambda s: s["value"].isNotNull()))
    )
    return bib.select("bib_id", "marc_record").distinct().filter(fine)


@query("""SELECT DISTINCT bib_id, marc_record.leader[6:12] AS leader, len(marc_record.controlfield)::INT AS n_control,
  array_to_string(flatten(list_transform(marc_record.datafield, lambda d: list_transform(d.subfield, lambda s: s.code || s.value))), '|') AS text FROM bib
  WHERE marc_record.leader IS NOT NULL AND marc_record.leader[10] = 'a' AND strlen(marc_record.leader) = 24 AND marc_record.datafield IS NOT NULL AND marc_record.controlfield IS NOT NULL
  AND len(list_filter(marc_record.controlfield, lambda f: f.value IS NULL)) = 0
  AND len(list_filter(marc_record.datafield, lambda d: d.subfield IS NULL OR len(list_filter(d.subfield, lambda s: s.value IS NULL)) > 0)) = 0""")
def marc_roundtrip(spark, sf):
    """Records as binary, cut into segments, put together and decoded again."""
    binary = marc.encode(_whole(load(spark, sf, "bib")), "marc_record")
    keyed = binary.select(F.concat_ws("-", "bib_id", F.xxhash64("raw").cast("string")).alias("id"), "raw")
    half = F.floor(F.octet_length("raw") / 2).cast("int")
    parts = keyed.select("id", F.explode(F.array(
        F.struct(F.lit(2).alias("s"), F.substring(F.col("raw"), half + 1, F.octet_length("raw")).alias("b")), F.struct(F.lit(1).alias("s"), F.substring(F.col("raw"), F.lit(1), half).alias("b")))).alias("x")).select("id", "x.s", "x.b")
    back = marc.decode(marc.assemble(parts, "id", "s", "b"))
    inner = F.flatten(F.transform("rec.datafield", lambda d: F.transform(d["subfield"], lambda s: F.concat(s["code"], s["value"]))))
    return back.select(
        F.split("id", "-")[0].cast("bigint").alias("bib_id"), F.substring("rec.leader", 6, 7).alias("leader"), F.size("rec.controlfield").alias("n_control"),
        F.array_join(inner, "|").alias("text")).distinct()


@query()
def index_documents(spark, sf):
    bib = load(spark, sf, "bib").select("bib_id", mf.index_document(F.col("marc_record"), F.col("bib_id")).alias("fields"))
    return sinks.index_lines(bib, "bib_id", "fields")


@query("""SELECT doc_id, '/out/' || source || '-' || lpad((doc_id // 1000)::VARCHAR, 5, '0') || '.xml.gz' AS path FROM documents""")
def output_paths(spark, sf):
    documents = load(spark, sf, "documents")
    return documents.select("doc_id", sinks.incrementing_name(F.concat(F.lit("/out/"), "source"), F.expr("doc_id div 1000"), 5, ".xml", True).alias("path"))


@query(r"""SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]', chr(65533), 'g') AS clean FROM documents WHERE text IS NOT NULL""")
def text_sanitized(spark, sf):
    return load(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", text.sanitize("text").alias("clean"))


@query("SELECT o_orderkey, o_orderkey::VARCHAR AS record_id, o_orderstatus AS status, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS priority FROM orders")
def record_xpath(spark, sf):
    """Ids and values by simple absolute paths, whatever the prefixes."""
    orders = load(spark, sf, "orders")
    kind = F.when(F.col("o_orderkey") % 2 == 0, "even").otherwise("odd")
    made = orders.select("o_orderkey", F.concat(
        F.lit('<x:o xmlns:x="urn:x" id="'), "o_orderkey", F.lit('"><x:s k="st">'), "o_orderstatus", F.lit('</x:s><p k="'), kind, F.lit('"> '), "o_orderpriority", F.lit(" </p></x:o>")).alias("xml"))
    out = records.record_ids(made, "xml", "/o/@id", required=True)
    out = records.record_ids(out, "xml", "/o/s[@k=st]", "status")
    return records.record_ids(out, "xml", "/x:o/p[@k='even']", "priority").drop("xml")


_CONFIG = """<c:source type="integrate" xmlns:c="urn:heddle:config"><c:property name="ids">C</c:property>
  <record><customer c:required="true"><c:source type="customer"/></customer>
    <orders><order><c:source type="orders"><c:property name="ids">C,O</c:property></c:source></order></orders></record></c:source>"""


@query("""WITH p AS (SELECT DISTINCT o_custkey AS C FROM orders WHERE o_orderpriority = '1-URGENT'),
  g AS (SELECT o_custkey AS C, string_agg('<order id="O-' || o_orderkey || '"><status>' || o_orderstatus || '</status></order>', '' ORDER BY o_orderkey) AS t FROM orders GROUP BY o_custkey)
  SELECT c_custkey AS C, '<record id="C-' || c_custkey || '"><customer id="C-' || c_custkey || '"><name>' || c_name || '</name></customer><orders id="C-' || c_custkey || '">' || t || '</orders></record>' AS rec_xml
  FROM customer JOIN p ON C = c_custkey JOIN g ON g.C = c_custkey""")
def integrate_config(spark, sf):
    """Sources named in a configuration, restricted to one list of ids, integrated and written as XML."""
    customer, orders = load(spark, sf, "customer", "orders")
    tables = {
        "customer": customer.select(F.col("c_custkey").alias("C"), F.col("c_name").alias("NAME")),
        "orders": orders.select(F.col("o_custkey").alias("C"), F.col("o_orderkey").alias("O"), F.col("o_orderstatus").alias("status")),
    }
    params = orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("value"))
    return from_config(_CONFIG, lambda kind, p: (tables[kind], p["ids"].split(",")), params).to_xml()


@query("""WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents)
  SELECT doc_id, '/out/x/' || source || '-' || lpad(n::VARCHAR, 4, '0') || '.xml.gz' AS each, '/out/x/' || source || '.xml' AS grouped, '/out/all-' || lpad(doc_id::VARCHAR, 5, '0') || '.txt' AS numbered,
    CASE WHEN doc_id = (SELECT max(doc_id) FROM documents) THEN '/out/one' END AS single FROM d""")
def output_dispatch(spark, sf):
    """Where documents go, by the kind of output asked for."""
    docs = load(spark, sf, "documents").select("doc_id", F.concat(F.lit("/in/x/"), "source", F.lit(".xml")).alias("system_id"))
    place = lambda name, **o: sinks.output_paths(docs, "system_id", "doc_id", **o).select("doc_id", F.col("path").alias(name))
    each = place("each", output="/out", is_directory=True, input_base="/in", suffix_length=4, gz=True)
    grouped = place("grouped", output="/out/", is_directory=True, input_base="/in", grouped=True)
    numbered = place("numbered", output="/out", is_directory=True, base_name="all", extension=".txt")
    return each.join(grouped, "doc_id").join(numbered, "doc_id").join(place("single", output="/out/one", is_directory=False), "doc_id", "left")
