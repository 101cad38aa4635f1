"""How the given tables stand in for the engine's tables.

Each binding is one SELECT that both Spark SQL and an ANSI SQL engine accept, so a query and its
SQL equivalent start from the same rows. Entity = customer, feature = part brand, group = market
segment, subgroup = nation, sample = order. All layer values of a (entity, feature) cell come out
of one aggregate over the line items (`cells`), so one shuffle feeds every layer.
"""

from __future__ import annotations

import re
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelgrid.session import scratch_path, staged_generation
from panelgrid.sources.sinks import write_table

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

# name -> SELECT; a binding may use the given tables and the bindings above it.
BINDINGS: dict[str, str] = {
    "li": """
        SELECT o.o_custkey AS entity, o.o_orderkey AS sample,
               'F' || lpad(substr(p.p_brand, 7), 2, '0') AS feature,
               CASE WHEN l.l_suppkey % 7 = 0 THEN NULL
                    ELSE 'F' || lpad(CAST(1 + l.l_suppkey % 25 AS STRING), 2, '0') END AS partner,
               l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_quantity, l.l_extendedprice,
               l.l_discount + 0.0 AS l_discount, l.l_tax + 0.0 AS l_tax, l.l_returnflag, l.l_linestatus, l.l_shipdate
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey""",
    "cells": """
        SELECT entity, feature,
               round(log2(1 + sum(l_extendedprice)), 6) AS rna,
               round(log2(1 + sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END)), 6) AS hpa,
               round(ln(1 + sum(CASE WHEN l_linestatus = 'O' THEN 1.0E0 END)), 6) AS geo,
               round((avg(l_tax) - 0.04) / 0.02, 6) + 0.0 AS zscore,
               bool_or(l_returnflag = 'N') AS detected,
               round((0.05 - avg(l_discount)) * 40, 6) + 0.0 AS effect,
               round(avg(l_quantity) / 25.5, 6) AS copy_number
        FROM li GROUP BY entity, feature""",
    "expression_rna": "SELECT entity, feature, rna AS value FROM cells",
    "expression_rna_hpa": "SELECT entity, feature, hpa AS value FROM cells WHERE hpa IS NOT NULL",
    "expression_rna_geo": "SELECT entity, feature, geo AS value FROM cells WHERE geo IS NOT NULL",
    "protein": "SELECT entity, feature, zscore AS value, detected FROM cells",
    "dependency": "SELECT entity, feature, effect AS value FROM cells",
    "copy_number": "SELECT entity, feature, copy_number AS value FROM cells",
    "entities": """
        SELECT c.c_custkey AS entity, c.c_name AS name, c.c_mktsegment AS grp, n.n_name AS subgroup,
               c.c_acctbal < -500 AS is_problematic, c.c_acctbal AS acctbal, c.c_nationkey AS nationkey
        FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey""",
    "features": """
        SELECT DISTINCT 'F' || lpad(substr(p_brand, 7), 2, '0') AS feature, p_brand AS symbol,
               CAST(CAST(substr(p_brand, 7) AS INT) % 3 AS INT) AS role_code
        FROM part
        UNION ALL SELECT 'X98' AS feature, 'Brand#24' AS symbol, 2 AS role_code
        UNION ALL SELECT 'X99' AS feature, 'F23' AS symbol, 2 AS role_code""",
    "roles": """
        SELECT feature, CASE role_code WHEN 0 THEN 'oncogene' WHEN 1 THEN 'tumour_suppressor' ELSE 'unknown' END AS gene_class
        FROM features""",
    "mutations": """
        SELECT entity, feature, sample, l_partkey,
               CASE WHEN l_linenumber <= 2 THEN 'HIGH' WHEN l_linenumber <= 4 THEN 'MODERATE' ELSE 'LOW' END AS impact,
               l_discount >= 0.09 AS is_driver, l_tax >= 0.08 AS is_hotspot,
               l_tax AS allele_fraction, l_linenumber, l_quantity
        FROM li WHERE l_returnflag = 'R'""",
    "fusion_calls": """
        SELECT entity, sample, feature AS feature_a, partner AS feature_b,
               CASE WHEN l_linenumber <= 6 THEN 'Yes' ELSE 'No' END AS is_default,
               CASE WHEN l_tax >= 0.04 THEN 'high' ELSE 'low' END AS confidence,
               CASE WHEN l_linestatus = 'F' THEN 'in-frame' ELSE 'out-of-frame' END AS reading_frame,
               l_quantity AS reads
        FROM li WHERE l_returnflag = 'A'""",
    "fusions": """
        SELECT entity, feature_a AS feature, feature_b AS partner, confidence = 'high' AS confidence_high,
               reading_frame = 'in-frame' AS in_frame, reads
        FROM fusion_calls WHERE is_default = 'Yes'
        UNION ALL
        SELECT entity, feature_b AS feature, feature_a AS partner, confidence = 'high' AS confidence_high,
               reading_frame = 'in-frame' AS in_frame, reads
        FROM fusion_calls WHERE is_default = 'Yes' AND feature_b IS NOT NULL""",
    "cell_counts": """
        SELECT entity, count(rna) AS n_rna, count(hpa) AS n_hpa, count(geo) AS n_geo,
               count(CASE WHEN detected THEN 1 END) AS n_protein, count(CASE WHEN effect > 0.5 THEN 1 END) AS n_effect,
               count(CASE WHEN copy_number > 1.4 THEN 1 END) AS n_cn
        FROM cells GROUP BY entity""",
    "signatures": """
        SELECT entity, round(count(*) / count(DISTINCT sample), 6) AS ploidy,
               round(100.0E0 * avg(CASE WHEN l_returnflag = 'R' THEN 1.0E0 ELSE 0.0E0 END), 6) AS msi_score,
               round(avg(l_discount), 6) AS loh_fraction
        FROM li GROUP BY entity""",
    "coverage": """
        SELECT e.entity, e.grp, e.subgroup,
               CASE WHEN k.n_rna > 0 THEN 'measured' ELSE 'not_assayed' END AS expression_rna_state,
               CASE WHEN k.n_hpa >= 9 THEN 'measured' ELSE 'not_assayed' END AS expression_rna_hpa_state,
               CASE WHEN k.n_geo >= 11 THEN 'measured' ELSE 'not_assayed' END AS expression_rna_geo_state,
               CASE WHEN k.n_protein >= 10 THEN 'measured' ELSE 'not_assayed' END AS protein_state,
               CASE WHEN k.n_effect >= 5 THEN 'measured' ELSE 'not_assayed' END AS dependency_state,
               CASE WHEN k.n_cn >= 3 THEN 'measured' ELSE 'not_assayed' END AS copy_number_state,
               CASE WHEN e.acctbal < 0 THEN 'not_assayed' WHEN m.entity IS NOT NULL THEN 'measured' ELSE 'measured_absent' END AS mutations_state,
               CASE WHEN e.acctbal > 8000 THEN 'not_assayed' WHEN f.entity IS NOT NULL THEN 'measured' ELSE 'measured_absent' END AS fusions_state,
               e.acctbal > 5000 AS metabolomics_available, e.nationkey % 2 = 0 AS mirna_available,
               s.ploidy, s.msi_score, s.loh_fraction, s.msi_score >= 40 AS msi_high
        FROM entities e LEFT JOIN cell_counts k ON e.entity = k.entity LEFT JOIN signatures s ON e.entity = s.entity
        LEFT JOIN (SELECT DISTINCT entity FROM mutations) m ON e.entity = m.entity
        LEFT JOIN (SELECT DISTINCT entity FROM fusions) f ON e.entity = f.entity""",
    "coverage_long": " UNION ALL ".join(
        f"SELECT entity, grp, subgroup, '{layer}' AS layer, {layer}_state AS state FROM coverage"
        for layer in ("expression_rna", "expression_rna_hpa", "expression_rna_geo", "protein",
                      "dependency", "copy_number", "mutations", "fusions")),
    "treatments": """
        SELECT user_id AS entity, event_type AS treatment, round(avg(value), 6) AS response
        FROM events GROUP BY user_id, event_type""",
    "memberships": """
        SELECT 'F' || lpad(substr(p_brand, 7), 2, '0') AS feature, 'PW-' || p_type || '-' || CAST(p_size % 10 AS STRING) AS pathway,
               'HUMAN' AS species, count(*) AS n_parts
        FROM part GROUP BY p_brand, p_type, p_size % 10""",
    "association_pairs": """
        SELECT 'P' || lpad(substr(p.p_brand, 7), 2, '0') AS protein1, 'P' || lpad(CAST(1 + l.l_suppkey % 25 AS STRING), 2, '0') AS protein2,
               count(*) AS combined_score
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2""",
    "interactions": """
        SELECT feature AS feature_a, partner AS feature_b, 'SYS' || CAST(year(l_shipdate) AS STRING) AS system, l_quantity AS reads
        FROM li WHERE partner IS NOT NULL""",
}

# Tables that are built once per data folder and read back, like any curated table: name -> clustering.
STORED = {
    "cells": ("feature", "entity"), "mutations": ("feature", "entity"), "fusions": ("feature", "entity"),
    "signatures": ("entity",), "coverage": ("entity",),
}

# Those built from the joined line items, and the columns that they take of these.
FROM_LINES = ("cells", "mutations", "fusions", "signatures")
LINES = ("entity", "sample", "feature", "partner", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice",
         "l_discount", "l_tax", "l_returnflag", "l_linestatus")

_NAMES = re.compile(r"[A-Za-z_]\w*")


@lru_cache(maxsize=None)
def _needs(name: str, given: frozenset[str]) -> tuple[str, ...]:
    """The bindings that `name` is built from, itself last."""
    if name in given:
        return (name,)
    order = list(BINDINGS)
    return _closure(BINDINGS[name], tuple(order[:order.index(name)]), given) + (name,)


def _closure(sql: str, allowed: tuple[str, ...], given: frozenset[str]) -> tuple[str, ...]:
    used = set(_NAMES.findall(re.sub(r"'[^']*'", "''", sql)))
    out: dict[str, None] = {}
    for name in allowed:
        if name in used:
            out.update(dict.fromkeys(_needs(name, given)))
    return tuple(out)


def with_bindings(sql: str, given: frozenset[str] = frozenset()) -> str:
    """`sql` preceded by the definitions of every binding it mentions, except the `given` ones."""
    names = _closure(sql, tuple(BINDINGS), given)
    defs = [f"{n} AS ({BINDINGS[n].strip()})" for n in BINDINGS if n in names and n not in given]
    body = sql.strip()
    if not defs:
        return body
    head = re.match(r"(?i)with\s+(recursive\s+)?", body)
    if head:
        return ("WITH RECURSIVE " if head[1] else "WITH ") + ",\n".join(defs) + ",\n" + body[head.end():]
    return "WITH " + ",\n".join(defs) + "\n" + body


_BUILT: dict[tuple, str] = {}


class Bound:
    """The given tables and the bindings over them for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._frames: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str, building: str | None = None) -> DataFrame:
        """Run SQL over bindings and given tables."""
        given = frozenset(n for n in STORED if n != building) | frozenset(["li"] if building in FROM_LINES else [])
        full = with_bindings(text, given)
        used = set(_NAMES.findall(full))
        for name in STORED:
            if name in used and name in _closure(text, tuple(BINDINGS), given) and name != building:
                self.stored(name).createOrReplaceTempView(name)
        if "li" in given:
            self.lines().createOrReplaceTempView("li")
        for name in TABLES:
            if name in used:
                self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(full)

    def stored(self, name: str) -> DataFrame:
        """A curated table, written once to the shared folder and read back.

        Recomputing it in each branch of each query would repeat the join and the aggregate over
        the line items; a written table is scanned with feature and column pruning instead.
        """
        key = (self.spark.sparkContext.applicationId, staged_generation(), self.sf_dir, name)
        if key not in _BUILT:
            path, rows = scratch_path(self.spark, name), self.sql(f"SELECT * FROM {name}", building=name)
            if name in FROM_LINES:  # a file holds all rows of its entities, sorted by the clustering: filters skip its pages
                rows.sortWithinPartitions(*STORED[name]).write.parquet(path)
            else:
                write_table(rows, path, STORED[name])
            _BUILT[key] = path
        return self.spark.read.parquet(_BUILT[key])

    def lines(self) -> DataFrame:
        """The joined line items, written once in buckets of entities.

        The joins and the shuffle to entities are paid once; the aggregates of the tables in `FROM_LINES` then need no
        shuffle, and later aggregates by entity of these tables meet an entity's rows in one file.
        """
        key = (self.spark.sparkContext.applicationId, staged_generation(), self.sf_dir, "lines")
        if key not in _BUILT:
            name, buckets = f"panelgrid_lines_{uuid.uuid4().hex}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            rows = self.sql(f"SELECT {', '.join(LINES)} FROM li").repartition(buckets, "entity")
            rows.write.bucketBy(buckets, "entity").option("path", scratch_path(self.spark, "lines")).format("parquet").saveAsTable(name)
            _BUILT[key] = name
        return self.spark.table(_BUILT[key])

    def kept(self, name: str, build, by: tuple[str, ...] = ()) -> DataFrame:
        """A derived table that several queries read, built once and written to the shared folder (in folders of the columns `by`)."""
        key = (self.spark.sparkContext.applicationId, staged_generation(), self.sf_dir, f"kept {name}")
        if key not in _BUILT:
            path = scratch_path(self.spark, name)
            build().write.partitionBy(*by).parquet(path)
            _BUILT[key] = path
        return self.spark.read.parquet(_BUILT[key])

    def kept_table(self, name: str, write) -> DataFrame:
        """Like `kept`, for a table that `write` stores in the session's catalog under the name that it returns."""
        key = (self.spark.sparkContext.applicationId, staged_generation(), self.sf_dir, f"kept {name}")
        if key not in _BUILT:
            _BUILT[key] = write()
        return self.spark.table(_BUILT[key])

    def __call__(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name == "coverage_long":
                frame = self._coverage_long()
            elif name in STORED:
                frame = self.stored(name)
            else:
                frame = self.sql(f"SELECT * FROM {name}") if name in BINDINGS else self.table(name)
            self._frames[name] = frame
        return self._frames[name]

    def _coverage_long(self) -> DataFrame:
        """The same rows as the binding, in one pass over the coverage table."""
        wide = self("coverage")
        states = [c for c in wide.columns if c.endswith("_state")]
        return wide.unpivot(["entity", "grp", "subgroup"], [F.col(c).alias(c[:-6]) for c in states], "layer", "state")
