"""Identity resolution, bridges, key rules and catalogue builds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelgrid.session import small_frame
from panelgrid.functions.distribution import medians
from panelgrid.operators.reshape import parse_feature_header
from panelgrid.sources.tables import union_all


def symbol_counts(reference: DataFrame) -> DataFrame:
    """One row per symbol: number of ids, and the id where it is the only one."""
    return reference.where("symbol is not null").groupBy("symbol").agg(
        F.count_distinct("feature").alias("n_ids"), F.count(F.lit(1)).alias("n_rows"), F.min("feature").alias("only_id"))


def resolve(tokens: DataFrame, reference: DataFrame, token: str = "token") -> DataFrame:
    """Exact id where exactly one row has it, else exact symbol: resolved, ambiguous or unresolved."""
    by_id = reference.groupBy(F.col("feature").alias(token)).agg(F.count(F.lit(1)).alias("_ids"))
    by_symbol = reference.groupBy(F.col("symbol").alias(token)).agg(F.count(F.lit(1)).alias("_symbols"), F.min("feature").alias("_of_symbol"))
    found = tokens.join(by_id, token, "left").join(by_symbol, token, "left")
    status = (F.when(F.col("_ids") == 1, "resolved").when(F.col("_symbols") == 1, "resolved")
              .when(F.col("_symbols") > 1, "ambiguous").otherwise("unresolved"))
    feature = F.when(F.col("_ids") == 1, F.col(token)).when(F.col("_symbols") == 1, F.col("_of_symbol"))
    return found.select(*tokens.columns, feature.alias("feature"), status.alias("status"))


def resolve_strict(tokens: list[str], reference: DataFrame) -> dict[str, str]:
    """Token to id for a request; an ambiguous or unknown token is an error. A request is a short list."""
    spark = reference.sparkSession
    asked = small_frame(spark, [(t,) for t in dict.fromkeys(tokens)], "token string")
    near = reference.where(F.col("feature").isin(tokens) | F.col("symbol").isin(tokens))
    rows = {r["token"]: r for r in resolve(asked, near).collect()}
    bad = {t: r["status"] for t, r in rows.items() if r["status"] != "resolved"}
    if bad:
        raise ValueError(f"features not resolved: {bad}")
    return {t: rows[t]["feature"] for t in tokens}


def resolve_candidates(tokens: DataFrame, reference: DataFrame, token: str = "token") -> DataFrame:
    """All ids a token could mean; unresolvable unless they come down to one."""
    sides = reference.select("feature", "symbol", F.explode(F.array_distinct(F.array("feature", "symbol"))).alias(token))
    found = sides.groupBy(token).agg(F.count_distinct("feature").alias("n_candidates"), F.min("feature").alias("_one"), F.sort_array(F.collect_set("feature")).alias("_all"))
    out = tokens.join(found, token, "left")
    return out.select(
        *tokens.columns, F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
        F.when(F.col("n_candidates") == 1, F.col("_one")).alias("feature"),
        F.when(F.col("n_candidates") == 1, "observed").otherwise("unresolvable").alias("state"),
        F.coalesce(F.array_join("_all", "|"), F.lit("")).alias("candidates"))


def resolve_alias(tokens: DataFrame, features: DataFrame, aliases: DataFrame, token: str = "token") -> DataFrame:
    """Canonical symbol first, then the alias table; several symbols are listed, not chosen."""
    key = F.upper(F.trim(F.col(token)))
    canonical = features.groupBy(F.upper("symbol").alias("_key")).agg(F.count(F.lit(1)).alias("_n"), F.min("symbol").alias("_canonical"))
    alias = aliases.groupBy(F.col("identifier_normalized").alias("_key")).agg(F.sort_array(F.collect_set("canonical_symbol")).alias("_symbols"))
    out = tokens.withColumn("_key", key).join(canonical, "_key", "left").join(alias, "_key", "left")
    direct = F.col("_n") == 1
    size = F.coalesce(F.size("_symbols"), F.lit(0))
    return out.select(
        *tokens.columns,
        F.when(direct, F.col("_canonical")).when(size == 1, F.try_element_at("_symbols", F.lit(1))).alias("symbol"),
        F.when(direct, "canonical").when(size == 1, "alias").when(size > 1, "ambiguous").otherwise("unknown").alias("status"),
        F.when(~F.coalesce(direct, F.lit(False)) & (size > 1), F.array_join("_symbols", ", ")).alias("candidates"))


def build_aliases(features: DataFrame, id_columns: dict[str, str], list_columns: dict[str, str], symbol: str = "symbol") -> DataFrame:
    """Every identifier of a feature with its kind; pipe-joined lists are split."""
    parts = [F.array(F.struct(F.col(column).cast("string").alias("identifier"), F.lit(kind).alias("identifier_type"))) for column, kind in id_columns.items()]

    def split_list(column: str, kind: str) -> Column:
        pieces = F.split(F.coalesce(F.col(column), F.lit("")), r"\|")
        return F.transform(pieces, lambda x: F.struct(x.alias("identifier"), F.lit(kind).alias("identifier_type")))

    parts += [split_list(column, kind) for column, kind in list_columns.items()]
    rows = features.select(F.col(symbol).alias("canonical_symbol"), F.inline(F.flatten(F.array(*parts)))).where("identifier is not null and identifier <> ''")
    keyed = rows.withColumn("identifier_normalized", F.upper("identifier"))
    return keyed.groupBy("identifier_normalized", "canonical_symbol", "identifier_type").agg(F.min("identifier").alias("identifier"))


def build_feature_reference(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union of two catalogues; the first one that names an id gives its symbol."""
    both = first.select("feature", "symbol").distinct().withColumn("_rank", F.lit(1)).unionByName(
        second.select("feature", "symbol").distinct().withColumn("_rank", F.lit(2)))
    return both.groupBy("feature").agg(F.min_by("symbol", F.struct("_rank", "symbol")).alias("symbol"))


def ambiguous_symbols(reference: DataFrame) -> DataFrame:
    return symbol_counts(reference).where("n_ids > 1").select("symbol", "n_ids")


def build_symbol_bridge(headers: DataFrame, reference: DataFrame, column: str = "header", position: str = "before") -> DataFrame:
    """Column name to id through its symbol: resolved, no_match or collision with the candidates."""
    symbol, _ = parse_feature_header(column, position)
    ids = reference.groupBy("symbol").agg(F.sort_array(F.collect_set("feature")).alias("_ids"))
    out = headers.withColumn("symbol", symbol).join(ids, "symbol", "left")
    n = F.coalesce(F.size("_ids"), F.lit(0))
    return out.select(
        *headers.columns, "symbol", F.when(n == 1, F.try_element_at("_ids", F.lit(1))).alias("feature"),
        F.when(n == 1, "resolved").when(n == 0, "no_match").otherwise("collision").alias("status"),
        F.when(n > 1, F.array_join("_ids", "|")).alias("candidates"))


def unresolved_report(bridges: DataFrame, layer: str = "layer") -> DataFrame:
    """Features lost to symbol collisions, per layer."""
    lost = bridges.where("status = 'collision'").select(layer, F.explode(F.split("candidates", r"\|")).alias("feature"))
    return lost.distinct()


def bridge_two_hop(source: DataFrame, known: DataFrame, target: DataFrame, key: str, accession: str) -> DataFrame:
    """Source key to entity through an accession that must be known; the lowest entity wins a repeat."""
    usable = source.where(F.col(accession).isNotNull()).join(known.select(accession).distinct(), accession, "left_semi")
    joined = usable.join(target.where(F.col(accession).isNotNull()).select(accession, "entity"), accession)
    return joined.groupBy(key).agg(F.min("entity").alias("entity"))


def survival(source: DataFrame, bridge: DataFrame, key: str) -> DataFrame:
    """How many source keys kept an entity, in percent."""
    keys = source.select(key).distinct().join(bridge.select(key).distinct().withColumn("_ok", F.lit(1)), key, "left")
    return keys.agg(F.count(F.lit(1)).alias("n_in"), F.count("_ok").alias("n_out")).withColumn(
        "survival_pct", F.round(F.try_divide(F.lit(100.0) * F.col("n_out"), F.col("n_in")), 1))


def fanout_check(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of a many-to-many join against its bound, from per-key counts; the join is not run."""
    lk = left.groupBy(key).agg(F.count(F.lit(1)).alias("l"))
    rk = right.groupBy(key).agg(F.count(F.lit(1)).alias("r"))
    most = rk.agg(F.max("r").alias("m")).scalar()
    joined = lk.join(rk, key, "left").agg(
        F.coalesce(F.sum(F.col("l") * F.coalesce("r", F.lit(0))), F.lit(0)).alias("n_joined"), F.sum("l").alias("n_left"))
    return joined.select("n_joined", (F.col("n_left") * most).alias("bound"), (F.col("n_joined") <= F.col("n_left") * most).alias("within"))


def validated_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", cardinality: str = "m:1") -> DataFrame:
    """A join whose constrained sides fail the job on a repeated key ('1:1', 'm:1' or '1:m')."""

    def unique(df: DataFrame, side: str) -> DataFrame:
        others = [c for c in df.columns if c not in on]
        packed = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*others) if others else F.lit(1)).alias("_row"))
        message = F.concat(F.lit(f"{side} side of a {cardinality} join repeats key "), F.to_json(F.struct(*on)))
        ok = F.when(F.col("_n") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
        return packed.where(ok).select(*on, *[F.col(f"_row.{c}").alias(c) for c in others])

    one_left, one_right = cardinality.split(":")
    if one_left == "1":
        left = unique(left, "left")
    if one_right == "1":
        right = unique(right, "right")
    return left.join(right, on, how)


def map_samples(df: DataFrame, bridge: DataFrame, datatypes: list[str]) -> DataFrame:
    """Replace sample by entity for samples of the given datatypes."""
    usable = bridge.where(F.col("datatype").isin(datatypes)).select("sample", "entity")
    return df.join(usable, "sample").drop("sample")


def build_spine(primary: DataFrame, backup: DataFrame, omics: DataFrame, renames: dict[str, str]) -> DataFrame:
    """Primary catalogue plus the measured entities that only the backup knows."""
    orphans = omics.select("entity").distinct().join(primary.select("entity"), "entity", "left_anti")
    found = backup.join(orphans, "entity", "left_semi").withColumnsRenamed(renames)
    return primary.unionByName(found, allowMissingColumns=True)


def coalesce_id(df: DataFrame, bridge: DataFrame, own: str, other: str) -> DataFrame:
    """Own id, else the id mapped from another name; rows with neither are dropped."""
    mapped = bridge.select(F.col(other), F.col("entity").alias("_mapped"))
    return df.join(mapped, other, "left").withColumn("entity", F.coalesce(F.col(own), F.col("_mapped"))).drop("_mapped").where("entity is not null")


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key by the tie-break columns, then by the whole row."""
    others = [c for c in df.columns if c not in keys]
    rest = [c for c in others if c not in order]
    best = F.min(F.struct(*order, *rest)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in others]).select(*df.columns)


def dedupe_mean(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


def dedupe_median(df: DataFrame, keys: list[str], value: str, bounded: bool = False) -> DataFrame:
    return medians(df, keys, value, value, bounded).drop("n")


# Function words of the two role sources.
FUNCTION_CLASS = {"oncogene": "oncogene", "possible oncogene": "oncogene", "tsg": "tumour_suppressor", "possible tsg": "tumour_suppressor"}
LABEL_CLASS = {"Oncogene": "oncogene", "TSG": "tumour_suppressor"}


def mapped(column: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, value in table.items():
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


def consensus_role(first: DataFrame, second: DataFrame, reference: DataFrame) -> DataFrame:
    """Role class per feature id.

    ``second`` (symbol, decision, cancer, function): official rows over rescued ones, the
    pan-cancer class over tissue classes, disagreement stays unresolved. A resolved second source
    overrides ``first`` (symbol, classification). Only symbols with one id survive.
    """
    voted = second.withColumn("cls", mapped(F.col("function"), FUNCTION_CLASS))
    official, pan = F.col("decision") == "official", F.col("cancer") == "PANCAN"

    def vote(rows: Column, name: str) -> list[Column]:
        low, high = F.min(F.when(rows, F.col("cls"))), F.max(F.when(rows, F.col("cls")))
        return [F.when(low == high, low).alias(name)]

    votes = voted.groupBy("symbol").agg(
        F.bool_or(official).alias("has_official"), *vote(official & pan, "op"), *vote(official, "o"), *vote(pan, "ap"), *vote(F.lit(True), "a"))
    second_class = votes.select("symbol", F.when(F.col("has_official"), F.coalesce("op", "o")).otherwise(F.coalesce("ap", "a")).alias("c2"))
    first_class = first.groupBy("symbol").agg(F.min(mapped(F.col("classification"), LABEL_CLASS)).alias("c1"))
    merged = first_class.join(second_class, "symbol", "full").select("symbol", F.coalesce("c2", "c1").alias("gene_class")).where("gene_class is not null")
    unique = symbol_counts(reference).where("n_ids = 1").select("symbol", F.col("only_id").alias("feature"))
    return merged.join(unique, "symbol").select("feature", "gene_class")


def build_feature_master(features: DataFrame, layer_headers: dict[str, DataFrame], events: dict[str, DataFrame], broad: DataFrame) -> DataFrame:
    """One row per feature with the column that holds it in each layer (by id, then by symbol),
    presence flags and core eligibility. Layer headers have (column_name, symbol, feature)."""
    out = features
    for layer, heads in layer_headers.items():
        by_id = heads.where("feature is not null").groupBy("feature").agg(F.min("column_name").alias("_by_id"))
        by_symbol = heads.groupBy(F.upper("symbol").alias("_sym")).agg(F.min("column_name").alias("_by_symbol"))
        out = (out.withColumn("_sym", F.upper("symbol")).join(by_id, "feature", "left").join(by_symbol, "_sym", "left")
               .withColumn(f"{layer}_column", F.coalesce("_by_id", "_by_symbol")).drop("_by_id", "_by_symbol", "_sym"))
        out = out.withColumn(f"has_{layer}", F.col(f"{layer}_column").isNotNull().cast("int"))
    for name, ids in {**events, "broad": broad}.items():
        seen = ids.select("feature").distinct().withColumn("_seen", F.lit(1))
        out = out.join(seen, "feature", "left").withColumn(f"has_{name}", F.coalesce("_seen", F.lit(0))).drop("_seen")
    core = F.col("effect_column").isNotNull() & (F.col("expression_column").isNotNull() | F.col("copy_number_column").isNotNull())
    return out.withColumn("eligible_core", core.cast("int"))


def id_algebra(layers: dict[str, DataFrame], key: str = "entity") -> DataFrame:
    """Sizes of the union, the intersection and each layer alone of distinct ids, in one pass."""
    tagged = union_all([df.select(key).distinct().withColumn("layer", F.lit(name)) for name, df in layers.items()])
    per_id = tagged.groupBy(key).agg(F.count(F.lit(1)).alias("k"), F.min("layer").alias("only"))
    n = len(layers)
    total = per_id.agg(F.count(F.lit(1)).alias("union"), F.count(F.when(F.col("k") == n, 1)).alias("intersection"))
    rows = total.select(F.explode(F.create_map(F.lit("union"), F.col("union"), F.lit("intersection"), F.col("intersection"))).alias("item", "n"))
    alone = per_id.where("k = 1").groupBy(F.concat(F.lit("only:"), "only").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return rows.unionByName(alone)


def unknown_ids(layers: dict[str, DataFrame], spine: DataFrame, key: str = "entity") -> DataFrame:
    tagged = union_all([df.select(key).distinct().withColumn("layer", F.lit(name)) for name, df in layers.items()])
    return tagged.join(spine.select(key), key, "left_anti").groupBy("layer").agg(F.count(F.lit(1)).alias("n_unknown"))


def id_collisions(spine: DataFrame, columns: list[str]) -> DataFrame:
    """Identifier values that several entities share."""
    long = spine.select("entity", *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(["entity"], columns, "id_column", "id_value")
    return long.where("id_value is not null").groupBy("id_column", "id_value").agg(F.count_distinct("entity").alias("n_entities")).where("n_entities > 1")


def label_crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of label pairs with the spread of each label of the first system."""
    pairs = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    spread = pairs.groupBy(a).agg(F.count(F.lit(1)).alias("n_labels"))
    return pairs.join(spread, a)


def search_features(reference: DataFrame, text: str, limit: int) -> DataFrame:
    """Case-insensitive substring search; symbol hits come before id-only hits."""
    if not text:
        return reference.orderBy("symbol", "feature").limit(limit).withColumn("hit", F.lit(0))
    needle = text.lower()
    hit = F.when(F.lower("symbol").contains(needle), 0).when(F.lower("feature").contains(needle), 1)
    return reference.withColumn("hit", hit).where("hit is not null").orderBy("hit", "symbol", "feature").limit(limit)


def facets(entities: DataFrame, group: str | None = None) -> DataFrame:
    scoped = entities if group is None else entities.where(F.col("grp") == group)
    return scoped.select("grp", "subgroup").distinct().orderBy("grp", "subgroup")


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
