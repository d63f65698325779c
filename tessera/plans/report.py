"""Reports: key rules, result discovery, comparison with references, aligned summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = ("startswith", "endswith", "contains", "exact", "regex")


def renamed(key: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The key by the first rule that fits (kind, pattern, replacement); an empty outcome is null: the key goes."""
    out = key
    for kind, pattern, replacement in reversed(rules):
        if kind not in RULES:
            raise ValueError(f"unknown rule {kind!r}")
        p = F.lit(pattern)
        if kind == "startswith":
            fits, value = F.startswith(key, p), F.concat(F.lit(replacement), F.substring(key, len(pattern) + 1, 1 << 30))
        elif kind == "endswith":
            fits, value = F.endswith(key, p), F.concat(F.left(key, F.length(key) - len(pattern)), F.lit(replacement))
        elif kind == "contains":
            fits, value = F.contains(key, p), F.replace(key, p, F.lit(replacement))
        elif kind == "exact":
            fits, value = key == p, F.lit(replacement)
        else:
            fits, value = key.rlike(pattern), F.regexp_replace(key, pattern, replacement)
        out = F.when(fits, F.nullif(value, F.lit(""))).otherwise(out)
    return out


def codec_fields(name: Column) -> Column:
    """words, edge and lambda of names like `orfc_k16_e32_lambda0.5`; lambda defaults to 0.5."""
    part = lambda pattern: F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))
    return F.struct(part(r"_k(\d+)").cast("int").alias("words"), part(r"_e(\d+)").cast("int").alias("edge"), F.coalesce(part(r"_lambda([0-9.]+)").cast("double"), F.lit(0.5)).alias("weight"))


def percent(value: Column) -> Column:
    """A fraction as percent; what is above 1 is percent already."""
    return F.when(value <= 1, value * 100).otherwise(value)


def compare(references: DataFrame, results: DataFrame, plans: DataFrame, keys: Sequence[str], rate_tolerance: float = 0.01, value_tolerance: float = 0.2) -> DataFrame:
    """Status of each reference (keys, ref_rate, ref_value) by results (keys, rate, value) and plans (keys).

    match within both tolerances, else mismatch; missing_plan without a plan, missing_result without a result.
    """
    joined = references.join(plans.select(*keys).distinct().withColumn("planned", F.lit(True)), list(keys), "left").join(results, list(keys), "left")
    d_rate, d_value = F.abs(F.col("rate") - F.col("ref_rate")), F.abs(F.col("value") - F.col("ref_value"))
    near = (F.round(d_rate, 9) <= rate_tolerance) & (F.round(d_value, 9) <= value_tolerance)
    return joined.withColumn("status", F.when(F.col("planned").isNull(), "missing_plan").when(F.col("rate").isNull(), "missing_result").when(near, "match").otherwise("mismatch")).drop("planned")


def aligned(rows: DataFrame, qualities: Sequence[str]) -> DataFrame:
    """(metric, values): a list for each metric in order of the qualities, null where one is missing."""
    pivoted = rows.groupBy("metric").agg(F.map_from_entries(F.collect_list(F.struct("quality", "value"))).alias("m"))
    return pivoted.select("metric", F.array(*[F.try_element_at("m", F.lit(q)) for q in qualities]).alias("values"))


def finalized(records: DataFrame, meters: DataFrame) -> DataFrame:
    """(metric, value): record means, then `<label>_<metric>` of meters, which win over equal names."""
    named = meters.select(F.concat_ws("_", "label", "metric").alias("metric"), "value", F.lit(1).alias("order"))
    both = records.select("metric", "value", F.lit(0).alias("order")).union(named)
    return both.groupBy("metric").agg(F.max_by("value", "order").alias("value"))


def upserted(updates: DataFrame) -> DataFrame:
    """(id, column, value): the last update of each cell of rows (id, seq, column, value)."""
    return updates.groupBy("id", "column").agg(F.max_by("value", "seq").alias("value"))


def layer_order(name: Column, order: dict[str, int], default: int = 99) -> Column:
    pairs = [x for k, v in order.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), F.lit(default)) if pairs else F.lit(default)


def disjoint(*maps: Column) -> Column:
    """One map of several; a key that two of them have is an error."""
    return F.map_concat(*maps)


def matched_once(candidates: DataFrame, key: str) -> DataFrame:
    """Rows of keys that have exactly one candidate."""
    once = candidates.groupBy(key).agg(F.count("*").alias("n")).where("n = 1").select(key)
    return candidates.join(once, key)


def row_text(values: Sequence[Column], formats: Sequence[str]) -> Column:
    """A CSV line with a printf format for each value."""
    return F.format_string(",".join(formats), *values)


def nested_hash(value: Column) -> Column:
    """SHA-256 of a value's JSON."""
    return F.sha2(F.to_json(value), 256)


def codec_keys_last(keys: Sequence[str], codec: Sequence[str] = ("bpp", "bpfp", "total_enc_time", "total_dec_time")) -> list[str]:
    """Metrics first, then what the codec measures, each in the order given."""
    is_codec = lambda k: k in codec or k.startswith("bpp_")
    return [k for k in keys if not is_codec(k)] + [k for k in keys if is_codec(k)]


def value_ranges(rows: DataFrame, keys: Sequence[str], rho: Sequence[float]) -> DataFrame:
    """(keys, n, least, largest) of `value` over rows whose `rho` is one of those given."""
    kept = rows.where(F.round("rho", 9).isin(*[round(r, 9) for r in rho]))
    return kept.groupBy(*keys).agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("largest"))


def sections(text: str) -> dict[str, list[dict[str, str]]]:
    """Rows of a CSV in blocks: a line of one cell names a block, the next is its header; blank lines end it."""
    import csv
    import io

    out: dict[str, list[dict[str, str]]] = {}
    name, header = "", None
    for cells in csv.reader(io.StringIO(text)):
        cells = [c.strip() for c in cells]
        if not any(cells):
            name, header = "", None
        elif not name:
            name = cells[0]
            out[name] = []
        elif header is None:
            header = cells
        else:
            out[name].append(dict(zip(header, cells)))
    return out


def elapsed_split(seconds: Column) -> tuple[Column, Column]:
    """Encoding and decoding time where only their sum is known: half each, an estimate."""
    return seconds / 2, seconds / 2
