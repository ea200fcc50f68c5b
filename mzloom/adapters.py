"""Domain-shaped views of the star-schema tables, as SQL that both Spark and DuckDB run.

Two functions differ between the engines and are written as placeholders: {days} and {seconds}.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["lineitem", "orders", "events", "labels", "documents", "supplier", "nation"]

# Sigmas shrink with density, so that the number of neighbours of a peak stays the same at every size.
_RAW_PEAKS = """SELECT CAST(l_linenumber - 1 AS INT) AS file_id, 300 + l_extendedprice / 100 AS fitted_mz, CAST({days:l_shipdate} AS DOUBLE) AS fitted_rt,
                     (l_linenumber - 1) * CAST(0.25 AS DOUBLE) AS rt_delta, l_quantity * (1 - l_discount) AS fitted_height,
                     CAST(0.5 AS DOUBLE) * sqrt(CAST(60000 AS DOUBLE) / n) AS fitted_sigma_mz, CAST(10 AS DOUBLE) * sqrt(CAST(60000 AS DOUBLE) / n) AS fitted_sigma_rt,
                     l_orderkey AS k1, l_partkey AS k2, l_suppkey AS k3
              FROM lineitem CROSS JOIN (SELECT count(*) AS n FROM lineitem) c"""
_FITTED = """fitted_mz, fitted_rt, rt_delta, fitted_height, fitted_sigma_mz, fitted_sigma_rt,
               fitted_height * 6.283185307179586 * fitted_sigma_mz * fitted_sigma_rt AS fitted_volume"""

VIEWS = {
    "points": "SELECT CAST(l_linenumber - 1 AS INT) AS file_id, CAST({days:l_shipdate} AS DOUBLE) AS rt, 300 + l_extendedprice / 100 AS mz, l_quantity AS intensity FROM lineitem",
    "peaks": f"""
        SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY fitted_height DESC, k1, k2, k3, fitted_mz, fitted_rt) - 1 AS BIGINT) AS peak_id,
               {_FITTED}
        FROM ({_RAW_PEAKS}) x""",
    "signal": "SELECT CAST(user_id % 4 AS INT) AS file_id, CAST({seconds:ts} AS DOUBLE) AS rt, CAST(400 + {k:props} AS DOUBLE) AS mz, value AS intensity FROM events",
    "msms": """SELECT CAST(o_custkey % 7 AS INT) AS file_id, o_orderkey AS event_id, 300 + o_totalprice / 500 AS mz, CAST({days:o_orderdate} AS DOUBLE) AS rt,
                      CAST(substr(o_orderpriority, 1, 1) AS INT) AS charge FROM orders""",
    "psms": """SELECT CAST(o_custkey % 7 AS INT) AS file_id, o_orderkey AS psm_index, 300 + o_totalprice / 500 AS mz, CAST({days:o_orderdate} AS DOUBLE) AS rt,
                      300 + o_totalprice / 500 + (o_orderkey % 7 - 3) * CAST(0.01 AS DOUBLE) AS theoretical_mz,
                      CAST(substr(o_orderpriority, 1, 1) AS INT) AS psm_charge_state, concat('PEP', CAST(o_custkey % 500 AS VARCHAR(9))) AS sequence FROM orders""",
    "edges": "SELECT DISTINCT l_suppkey AS protein, l_partkey AS peptide FROM lineitem",
    # Blocks of four customers whose months of ordering overlap: many small groups.
    "block_edges": "SELECT DISTINCT o_custkey AS protein, CAST(floor(o_custkey / 4.0) AS BIGINT) * 16 + CAST(month(o_orderdate) AS BIGINT) AS peptide FROM orders",
    "annotations": """SELECT DISTINCT d.source AS cluster_id, CAST(d.doc_id % 5 AS INT) AS file_id, d.lang AS sequence, CAST(l.toxic AS VARCHAR(3)) AS protein
                      FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "time_map": """SELECT f.file_id, s.segment, s.segment * CAST(250 AS DOUBLE) AS rt_start, (s.segment + 1) * CAST(250 AS DOUBLE) AS rt_end,
                          s.segment * CAST(240 AS DOUBLE) + f.file_id AS sample_rt_start, (s.segment + 1) * CAST(240 AS DOUBLE) + f.file_id AS sample_rt_end
                   FROM (SELECT DISTINCT CAST(l_linenumber - 1 AS INT) AS file_id FROM lineitem) f
                   CROSS JOIN (SELECT DISTINCT CAST(n_regionkey AS BIGINT) + 5 * CAST(n_nationkey % 2 AS BIGINT) AS segment FROM nation) s""",
}

#: The same rows for Spark, where a run's rows are too many for one window: they are numbered within a run and height, after the number of higher
#: ones. Heights are products of 50 quantities and 11 discounts, so the broadcast counts are a few thousand rows at every size.
_SPARK_VIEWS = {
    "peaks": f"""
        WITH x AS ({_RAW_PEAKS}),
             h AS (SELECT file_id AS run, fitted_height AS height, sum(n) OVER (PARTITION BY file_id ORDER BY fitted_height DESC) - n AS higher
                   FROM (SELECT CAST(l_linenumber - 1 AS INT) AS file_id, l_quantity * (1 - l_discount) AS fitted_height, count(*) AS n FROM lineitem GROUP BY 1, 2) c)
        SELECT /*+ BROADCAST(h) */ file_id, CAST(higher + row_number() OVER (PARTITION BY file_id, fitted_height ORDER BY k1, k2, k3, fitted_mz, fitted_rt) - 1 AS BIGINT) AS peak_id,
               {_FITTED}
        FROM x JOIN h ON file_id <=> run AND fitted_height <=> height""",
}

_SPARK = {"days": "datediff({0}, DATE'1995-01-01')", "seconds": "unix_micros(CAST({0} AS TIMESTAMP)) / 1000000D", "k": "CAST(get_json_object({0}, '$.k') AS INT)"}
_DUCKDB = {"days": "date_diff('day', DATE '1995-01-01', CAST({0} AS DATE))", "seconds": "epoch_us({0}) / CAST(1000000 AS DOUBLE)", "k": "CAST(json_extract_string({0}, '$.k') AS INT)"}


def _text(out: str, dialect: dict[str, str]) -> str:
    for f, sql in dialect.items():
        while (at := out.find("{" + f + ":")) >= 0:
            end = out.index("}", at)
            out = out[:at] + sql.format(out[at + len(f) + 2 : end]) + out[end + 1 :]
    return out


def duckdb_view(name: str) -> str:
    """``name AS (...)`` for a WITH clause."""
    return f"{name} AS ({_text(VIEWS[name], _DUCKDB)})"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame over the tables in ``sf_dir``."""
    sql = _text(_SPARK_VIEWS.get(name, VIEWS[name]), _SPARK)
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t} " in f" {sql} " or f" {t}\n" in sql or f" {t})" in sql}
    for t in frames:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(sql, **frames)
