"""Wide and long shapes, header parsing, scalar cleaning, event symmetry and record flattening."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from panelgrid.functions.columns import PROBLEM_WORDS
from panelgrid.functions.distribution import percentiles

# Text columns in which a gap is filled with `Unknown`.
UNKNOWN_COLUMNS = ["primary_or_metastasis", "lineage_sub_subtype", "Subtype"]


def unpivot_matrix(df: DataFrame, ids: list[str], var: str, value: str, columns: list[str] | None = None) -> DataFrame:
    """Entity rows with one column per feature, made long; missing cells are no rows."""
    columns = columns or [c for c in df.columns if c not in ids]
    return df.unpivot(ids, columns, var, value).where(F.col(value).isNotNull())


def unpivot_transposed(df: DataFrame, feature: str, sample: str, value: str) -> DataFrame:
    """Feature rows with one column per sample, made long."""
    return unpivot_matrix(df, [feature], sample, value)


def pivot_features(long: DataFrame, features: list[str], value: str = "value") -> DataFrame:
    """One column per requested feature; repeated cells are averaged."""
    return long.where(F.col("feature").isin(features)).groupBy("entity").pivot("feature", features).agg(F.avg(value))


def project_pair(wide: DataFrame, a: str, b: str, suffix: str) -> DataFrame:
    """Two feature columns under role names; the same feature twice is copied."""
    return wide.select("entity", F.col(a).alias(f"a_{suffix}"), F.col(b).alias(f"b_{suffix}"))


def parse_feature_header(header: str | Column, position: str = "before") -> tuple[Column, Column]:
    """(symbol, unversioned id) of `SYMBOL (ID)` or, with position 'after', `ID (SYMBOL)`."""
    header = F.col(header) if isinstance(header, str) else header
    outside = F.nullif(F.regexp_extract(header, r"^(.*?) \(", 1), F.lit(""))
    inside = F.nullif(F.regexp_extract(header, r"\(([^()]+)\)\s*$", 1), F.lit(""))
    symbol, ident = (outside, inside) if position == "before" else (inside, outside)
    return symbol, F.regexp_replace(ident, r"\.\d+$", "")


def add_copy_flags(df: DataFrame, value: str = "value") -> DataFrame:
    return df.withColumn("amp", F.col(value) > 1.5).withColumn("del", F.col(value) < 0.5)


def add_signature_flags(df: DataFrame, msi: str, required: list[str]) -> DataFrame:
    present = F.lit(True)
    for c in required:
        present = present & F.col(c).isNotNull()
    return df.withColumn("msi_high", F.col(msi) >= 20).withColumn("wgs_available", present)


def keep_default(df: DataFrame, flag: str) -> DataFrame:
    return df.where(F.col(flag) == "Yes")


def fill_unknown(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.fill("Unknown", [c for c in columns if c in df.columns])


def symmetrise(events: DataFrame, a: str, b: str, focal: str = "feature", partner: str = "partner") -> DataFrame:
    """Each pair event seen from both sides; rows without a focal id go. A self pair stays twice.

    One pass: every row yields its two orientations, so the source is not scanned twice.
    """
    others = [c for c in events.columns if c not in (a, b)]
    sides = F.array(F.struct(F.col(a).alias(focal), F.col(b).alias(partner)), F.struct(F.col(b).alias(focal), F.col(a).alias(partner)))
    return events.select(*others, F.inline(sides)).where(F.col(focal).isNotNull())


def impute_floor(df: DataFrame, value: str, detected: str, pct: float = 1.0) -> DataFrame:
    """Undetected values become the given percentile of the detected ones."""
    floor = percentiles(df.where(F.col(detected)), [], value, {"_floor": pct / 100.0}).select("_floor").scalar()
    return df.withColumn("imputed", ~F.col(detected)).withColumn(value, F.when(F.col(detected), F.col(value)).otherwise(floor))


def filter_candidates(
    entities: DataFrame, coverage: DataFrame | None = None, group: str | None = None, subgroup: str | None = None,
    exclude_problematic: bool = False, msi_high: bool | None = None, ploidy_min: float | None = None,
    ploidy_max: float | None = None, require: tuple[str, ...] = (),
) -> DataFrame:
    """Entities that meet every given condition; an unknown value never passes."""
    out = entities
    if group is not None:
        out = out.where(F.col("grp") == group)
    if subgroup is not None:
        out = out.where(F.col("subgroup") == subgroup)
    if exclude_problematic:
        out = out.where(~F.col("is_problematic"))
    if msi_high is None and ploidy_min is None and ploidy_max is None and not require:
        return out
    if coverage is None:
        raise ValueError("these filters need the coverage table")
    keep = F.lit(True)
    if msi_high is not None:
        keep = keep & (F.col("msi_high") == msi_high)
    if ploidy_min is not None:
        keep = keep & (F.col("ploidy") >= ploidy_min)
    if ploidy_max is not None:
        keep = keep & (F.col("ploidy") <= ploidy_max)
    for layer in require:
        keep = keep & F.col(f"{layer}_available")
    return out.join(coverage.where(keep).select("entity"), "entity", "left_semi")


def filter_human(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.coalesce(F.col(column).contains("Homo sapiens"), F.lit(False)))


def flag_problematic(df: DataFrame, comments: str, out: str = "is_problematic") -> DataFrame:
    return df.withColumn(out, F.coalesce(F.col(comments).rlike(f"(?i){PROBLEM_WORDS}"), F.lit(False)))


def enforce_reference(events: DataFrame, reference: DataFrame, focal: str = "feature", partner: str | None = "partner") -> DataFrame:
    """Drop rows whose focal id is unknown; blank partner ids that are unknown."""
    known = reference.select(F.col(reference.columns[0]).alias("_id")).distinct()
    out = events.join(known.withColumnRenamed("_id", focal), focal, "left_semi")
    if partner is None:
        return out
    mark = known.select(F.col("_id").alias(partner), F.lit(True).alias("_known"))
    return out.join(mark, partner, "left").withColumn(partner, F.when(F.col("_known"), F.col(partner))).drop("_known").select(*events.columns)


# The fields of each kind of record.
RECORDS = {
    "sample": "sampleId string, patientId string, sampleType string, sampleTypeId string",
    "numeric": "studyId string, sampleId string, patientId string, gene struct<hugoGeneSymbol:string>, entrezGeneId bigint, value double, molecularProfileId string",
    "mutation": "studyId string, sampleId string, patientId string, entrezGeneId bigint, mutationType string, proteinChange string, aminoAcidChange string, chromosome string, startPosition bigint, "
                "endPosition bigint, referenceAllele string, variantAllele string, variantType string, ncbiBuild string, center string, mutationStatus string, validationStatus string, "
                "tumorAltCount bigint, tumorRefCount bigint, normalAltCount bigint, normalRefCount bigint, gene struct<hugoGeneSymbol:string>",
    "structural_variant": "studyId string, sampleId string, patientId string, molecularProfileId string, site1EntrezGeneId bigint, site1HugoSymbol string, site1Chromosome string, site1Position bigint, "
                          "site2EntrezGeneId bigint, site2HugoSymbol string, site2Chromosome string, site2Position bigint, site2EffectOnFrame string, dnaSupport string, rnaSupport string, tumorPairedEndReadCount bigint, "
                          "tumorSplitReadCount bigint, annotation string, breakpointType string, connectionType string, eventInfo string, variantClass string, svStatus string, ncbiBuild string",
}


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def flatten_records(records: DataFrame, column: str, kind: str, **constants: str) -> DataFrame:
    """Tidy rows from nested records of one kind given as JSON text; a nested symbol becomes `symbol`.

    Names are in snake case, a field that a record lacks is null, and constants (a study, a layer) become columns.
    """
    schema = T.StructType.fromDDL(RECORDS[kind])
    parsed = records.select(F.from_json(column, schema).alias("r"))
    fields = [F.col("r.gene.hugoGeneSymbol").alias("symbol") if f.name == "gene" else F.col(f"r.{f.name}").alias(snake(f.name)) for f in schema]
    return parsed.select(*fields, *[F.lit(v).alias(k) for k, v in constants.items()])


# Fixed values: (layer, alteration type, datatype, text the profile name must hold).
PROFILE_RULES = [
    ("mutation", "MUTATION_EXTENDED", None, None),
    ("cna", "COPY_NUMBER_ALTERATION", "DISCRETE", None),
    ("rna", "MRNA_EXPRESSION", "CONTINUOUS", "RSEM"),
    ("structural_variant", "STRUCTURAL_VARIANT", None, None),
]


def choose_profile(profiles: DataFrame) -> DataFrame:
    """One profile per study and layer: those without a z-score in the id first, then by id."""
    layer = F.lit(None).cast("string")
    for name, alteration, datatype, word in reversed(PROFILE_RULES):
        rule = F.col("alteration_type") == alteration
        if datatype:
            rule = rule & (F.col("datatype") == datatype)
        if word:
            rule = rule & F.upper("name").contains(word)
        layer = F.when(rule, F.lit(name)).otherwise(layer)
    best = Window.partitionBy("study", "layer").orderBy(F.upper("profile_id").contains("ZSCORE"), "profile_id")
    return (profiles.withColumn("layer", layer).where("layer is not null")
            .withColumn("_r", F.row_number().over(best)).where("_r = 1").select("study", "layer", "profile_id"))


def choose_list(lists: DataFrame, category: str, fallback_suffix: str) -> DataFrame:
    """Per study the first list of a category, else the named fallback list."""
    found = F.min(F.when(F.col("category") == category, F.col("list_id")))
    fallback = F.min(F.when(F.col("list_id") == F.concat("study", F.lit(fallback_suffix)), F.col("list_id")))
    return lists.groupBy("study").agg(F.coalesce(found, fallback).alias("list_id"))
