"""Queries of the general data-processing operators (problems 1, 4, 5 and 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators.flatten import dewey_nodes, linked_tables
from heddle.operators.ledger import changed_records, delivery_states, fingerprint, process_changed
from heddle.operators.orphans import ForeignKey, Keyed, cascade, direct_orphans, orphan_report
from heddle.operators.salted import Agg, salted_aggregate, share_of_rows
from heddle.session import load, shared_dir, with_row

#: A key that holds at least this share of a table's rows is reported.
FOUND_SHARE = 0.025


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    item, mfhd = (with_row(load(spark, sf, name)).select(F.lit(name).alias("src"), "bib_id", "__row") for name in ("item", "mfhd"))
    counts = salted_aggregate(item.unionByName(mfhd), ["src", "bib_id"], [Agg("n")], row="__row")
    return share_of_rows(counts, "src", "n", FOUND_SHARE).filter("bib_id IS NOT NULL AND bib_id <> 0").select("src", "bib_id")


def p1_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and distinct records for each source and BIB_ID."""
    item, mfhd = load(spark, sf, "item", "mfhd")
    both = item.select(F.lit("item").alias("src"), "bib_id", F.col("item_id").alias("rec_id")).unionByName(
        mfhd.select(F.lit("mfhd").alias("src"), "bib_id", F.col("mfhd_id").alias("rec_id"))
    )
    return salted_aggregate(both, ["src", "bib_id"], [Agg("n_rows"), Agg("n_records", "count_distinct", "rec_id"), Agg("last_id", "max", "rec_id")])


SOURCES = {"mfhd": ("mfhd_id", ("hold_create_date", "last_hold_update")), "item": ("item_id", ("item_create_date",))}


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """The pending records of both sources, as the ledger of this load has committed them.

    The load is named by the files it is made of, so a call that follows a
    broken one takes up its ledger, and one that follows a whole one computes
    nothing and gives what was committed.
    """
    runs, deliveries = load(spark, sf, "load_run", "load_delivery")
    tables = {src: load(spark, sf, src) for src in SOURCES}

    def pending() -> DataFrame:
        parts = [changed_records(tables[src], runs, deliveries, src=src, key=key, stamps=stamps) for src, (key, stamps) in SOURCES.items()]
        return parts[0].unionByName(parts[1])

    root = f"{shared_dir(spark)}/ledger/{fingerprint(runs, deliveries, *tables.values())}"
    ledger, _ = process_changed(pending, root, "rec_id", spark)
    return spark.read.schema("src string, rec_id long, change_stamp timestamp_ntz").parquet(*ledger.outputs()).select("src", "rec_id")


def p4_states(spark: SparkSession, sf: str) -> DataFrame:
    runs, deliveries = load(spark, sf, "load_run", "load_delivery")
    return delivery_states(runs, deliveries).groupBy("src", "state").agg(F.count(F.lit(1)).alias("n"))


FKS = [
    ForeignKey("mfhd", "mfhd_id", "bib_id", "bib"),
    ForeignKey("item", "item_id", "mfhd_id", "mfhd"),
    ForeignKey("item_status", "item_id", "item_id", "item"),
]


def _graph(spark: SparkSession, sf: str) -> tuple:
    bib, mfhd, item, status, deleted = load(spark, sf, "bib", "mfhd", "item", "item_status", "deletion_log")
    tables = {"bib": Keyed(bib, "bib_id"), "mfhd": Keyed(mfhd, "mfhd_id"), "item": Keyed(item, "item_id"), "item_status": Keyed(status, None)}
    return tables, FKS, deleted.withColumnRenamed("src", "table")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """The first step of the cascade: orphan references themselves."""
    return direct_orphans(*_graph(spark, sf))


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_report(cascade(*_graph(spark, sf)))


ENTITIES = {"holding": "mfhd_id", "item": "item_id", "itemStatus": "status_id"}


#: Numbered by their place among the data fields of the record's own MARC.
POSITIONED = {"datafield": "marc"}


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    tables = linked_tables(load(spark, sf, "integrated"), "bib_id", "rec_xml", ENTITIES, POSITIONED)
    return tables.select(F.col("rec_key").alias("bib_id"), "node", "parent_id", "node_id")


def p7_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """How many nodes of each schema path the records have."""
    nodes = dewey_nodes(load(spark, sf, "integrated"), "bib_id", "rec_xml")
    return nodes.groupBy("path").agg(F.count(F.lit(1)).alias("n_nodes"), F.countDistinct("rec_key").alias("n_records"))


QUERIES = {q.__name__: q for q in (p1_found, p1_counts, p4_found, p4_states, p5_found, p5_report, p7_found, p7_nodes)}

_BOTH = """SELECT 'item' AS src, bib_id, item_id AS rec_id FROM item UNION ALL SELECT 'mfhd', bib_id, mfhd_id FROM mfhd"""

_CHANGED = """
  SELECT '{src}' AS src, s.rec_id FROM (
    SELECT rec_id, max(s) FILTER (extracted_at > c) AS s, max(s) FILTER (extracted_at <= c) AS before FROM (
      SELECT {key} AS rec_id, extracted_at, coalesce({stamp}, TIMESTAMP '0001-01-01 00:00:00') AS s,
        (SELECT max(cutoff_at) FROM load_run WHERE src = '{src}' AND run_status = 'succeeded') AS c
      FROM {src}) GROUP BY rec_id) s
  WHERE s.s IS NOT NULL AND (before IS NULL OR s.s > before) AND NOT EXISTS (
    SELECT 1 FROM load_delivery d WHERE d.src = '{src}' AND d.rec_id = s.rec_id AND d.acked
      AND coalesce(d.change_stamp, TIMESTAMP '0001-01-01 00:00:00') >= s.s
      AND NOT EXISTS (SELECT 1 FROM load_run r WHERE r.run_id = d.run_id AND r.src = d.src AND r.run_status = 'rolled_back'))"""

_REFS = """
  refs AS (
    SELECT 'mfhd' AS child_table, mfhd_id AS child_id, 'bib' AS parent_table, bib_id AS parent_id, extracted_at FROM mfhd
    UNION ALL SELECT 'item', item_id, 'mfhd', mfhd_id, extracted_at FROM item
    UNION ALL SELECT 'item_status', item_id, 'item', item_id, extracted_at FROM item_status),
  firsts AS (SELECT child_table, child_id, min(extracted_at) AS first_at FROM refs WHERE child_id IS NOT NULL GROUP BY ALL),
  pairs AS (SELECT DISTINCT child_table, child_id, parent_table, parent_id FROM refs WHERE child_id IS NOT NULL AND parent_id IS NOT NULL AND parent_id <> 0),
  parents AS (
    SELECT 'bib' AS t, bib_id AS id, min(extracted_at) AS a, max(extracted_at) AS z FROM bib GROUP BY ALL
    UNION ALL SELECT 'mfhd', mfhd_id, min(extracted_at), max(extracted_at) FROM mfhd GROUP BY ALL
    UNION ALL SELECT 'item', item_id, min(extracted_at), max(extracted_at) FROM item GROUP BY ALL),
  dels AS (SELECT src AS t, rec_id AS id, max(deleted_at) AS d FROM deletion_log GROUP BY ALL),
  direct AS (
    SELECT * FROM (
      SELECT p.child_table, p.child_id, p.parent_table, p.parent_id,
        CASE WHEN d.d IS NOT NULL AND (r.id IS NULL OR d.d >= r.z) THEN 'deleted' WHEN r.id IS NULL THEN 'missing' WHEN r.a > f.first_at THEN 'late' END AS reason,
        strftime(f.first_at, '%Y-%m') AS period
      FROM pairs p JOIN firsts f USING (child_table, child_id)
      LEFT JOIN parents r ON r.t = p.parent_table AND r.id = p.parent_id
      LEFT JOIN dels d ON d.t = p.parent_table AND d.id = p.parent_id) WHERE reason IS NOT NULL)"""

ORACLE = {
    "p1_found": f"""SELECT src, bib_id FROM (SELECT src, bib_id, count(*) AS n, sum(count(*)) OVER (PARTITION BY src) AS total FROM ({_BOTH}) GROUP BY src, bib_id)
        WHERE n >= 0.025 * total AND bib_id IS NOT NULL AND bib_id <> 0""",
    "p1_counts": f"SELECT src, bib_id, count(*) AS n_rows, count(DISTINCT rec_id) AS n_records, max(rec_id) AS last_id FROM ({_BOTH}) GROUP BY src, bib_id",
    "p4_found": _CHANGED.format(src="mfhd", key="mfhd_id", stamp="greatest(try_cast(trim(hold_create_date) AS TIMESTAMP), try_cast(trim(last_hold_update) AS TIMESTAMP))")
    + " UNION ALL " + _CHANGED.format(src="item", key="item_id", stamp="try_cast(trim(item_create_date) AS TIMESTAMP)"),
    "p4_states": """SELECT src, state, count(*) AS n FROM (
        SELECT d.src, d.rec_id, d.change_stamp, d.run_id, CASE WHEN bool_or(coalesce(r.run_status, '') = 'rolled_back') THEN 'fenced' WHEN bool_or(d.acked) THEN 'done' ELSE 'pending' END AS state
        FROM load_delivery d LEFT JOIN load_run r ON r.run_id = d.run_id AND r.src = d.src GROUP BY ALL) GROUP BY ALL""",
    "p5_found": f"WITH {_REFS} SELECT * FROM direct",
    "p5_report": f"""WITH {_REFS},
      one AS (SELECT p.*, strftime(f.first_at, '%Y-%m') AS period FROM pairs p JOIN firsts f USING (child_table, child_id)
        WHERE EXISTS (SELECT 1 FROM direct o WHERE o.child_table = p.parent_table AND o.child_id = p.parent_id)
        AND NOT EXISTS (SELECT 1 FROM direct o WHERE o.child_table = p.child_table AND o.child_id = p.child_id AND o.parent_id = p.parent_id)),
      two AS (SELECT p.*, strftime(f.first_at, '%Y-%m') AS period FROM pairs p JOIN firsts f USING (child_table, child_id)
        WHERE EXISTS (SELECT 1 FROM one o WHERE o.child_table = p.parent_table AND o.child_id = p.parent_id)
        AND NOT EXISTS (SELECT 1 FROM direct o WHERE o.child_table = p.child_table AND o.child_id = p.child_id AND o.parent_id = p.parent_id)
        AND NOT EXISTS (SELECT 1 FROM one o WHERE o.child_table = p.child_table AND o.child_id = p.child_id AND o.parent_id = p.parent_id))
      SELECT child_table, parent_table, period, kind, reason, count(*) AS n_refs FROM (
        SELECT child_table, parent_table, period, 'direct' AS kind, reason FROM direct
        UNION ALL SELECT child_table, parent_table, period, 'inherited', 'inherited' FROM one
        UNION ALL SELECT child_table, parent_table, period, 'inherited', 'inherited' FROM two) GROUP BY ALL""",
}
