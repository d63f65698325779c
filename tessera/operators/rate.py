"""Rate accounting: bits of coded units, containers and records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTAINERS = {
    "unit": ("stream",),
    "frame": ("layer", "stream"),
    "frame_wise_video": ("frame", "layer", "stream"),
    "layer_wise_video": ("layer", "frame", "stream"),
    "slide_crops": ("stream",),
}


def stream_bits(payload: Column, inner: Column | None = None) -> Column:
    """Summed bits of byte strings; of an inner list only its first element counts."""
    size = F.octet_length(payload) * 8
    return F.coalesce(F.sum(size if inner is None else F.when(inner == 0, size)), F.lit(0)).cast("long")


def likelihood_bits(p: Column) -> Column:
    """Summed -log2 of likelihoods."""
    return -F.sum(F.log2(p))


def unit_bits(strings: Column, likelihoods: Column, bits: Column) -> Column:
    """What a coded unit costs: strings come before likelihoods, those before stated bits; without any, an error."""
    return F.coalesce(strings.cast("double"), likelihoods, bits.cast("double"), F.raise_error(F.lit("a coded unit needs strings, likelihoods or bits")).cast("double"))


def container_bits(coded: DataFrame, container: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, stream_key, bits) of rows with payload and the container's key columns.

    Stream keys are the key columns joined by dots; of slide crops, streams of one name add up.
    """
    if container not in CONTAINERS:
        raise ValueError(f"unknown container {container!r}")
    key = F.concat_ws(".", *[F.col(c).cast("string") for c in CONTAINERS[container]])
    inner = F.col("inner_idx") if "inner_idx" in coded.columns else None
    return coded.groupBy(*keys, key.alias("stream_key")).agg(stream_bits(F.col("payload"), inner).alias("bits"))


def bits_per_pixel(bits: Column, height: Column, width: Column) -> Column:
    return bits / F.greatest(F.lit(1), height * width)


def record_bits_per_pixel(bits: DataFrame, samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """One record for each sample: its total and a map of bits per pixel by stream. A sample without its size is an error."""
    joined = bits.join(samples.select(key, "h", "w"), key)
    area = F.when(F.col("h").isNull() | F.col("w").isNull(), F.raise_error(F.lit("ori_size is missing")).cast("long")).otherwise(F.greatest(F.lit(1), F.col("h") * F.col("w")))
    each = joined.select(key, "stream", (F.col("bits") / area).alias("bpp"))
    return each.groupBy(key).agg(F.sum("bpp").alias("bpp"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("stream", "bpp")))).alias("bpp_by_stream"))


def bits_per_feature_value(bits: Column, values: Column) -> Column:
    return F.sum(bits) / F.sum(values)


def grouping_row(kept: Column, tokens: Column, feature_bits: Column, map_bits: Column, dims: Column, dense_bits: Column, strict: bool = True) -> dict[str, Column]:
    """Rates of a token grouping, by value of the dense feature; with `strict`, counts that can't be are an error."""
    if strict:
        sound = (tokens > 0) & (kept > 0) & (kept <= tokens)
        tokens = F.when(sound, tokens).otherwise(F.raise_error(F.lit("impossible token counts")).cast("long"))
    numel = tokens * dims
    total = feature_bits + map_bits
    return {
        "keep_ratio": kept / tokens, "feature_bpfp": feature_bits / numel, "map_bpfp": map_bits / numel, "total_bpfp": total / numel,
        "side_fraction": F.when(total > 0, map_bits / total).otherwise(0.0), "rate_saving": 1 - total / dense_bits,
    }


def with_original_size(samples: DataFrame, h: str = "h", w: str = "w") -> DataFrame:
    """Samples whose original size, the denominator of bpp, is set to their size of now."""
    return samples.withColumns({"ori_h": F.col(h), "ori_w": F.col(w)})


def weighted_losses(bpp: Column, terms: dict[str, Column], rate_weight: float = 1.0, weights: dict[str, float] | None = None) -> Column:
    """Rate times its weight and the terms, each by its own weight (1 where none is given)."""
    total = rate_weight * bpp
    for name, term in terms.items():
        total = total + (weights or {}).get(name, 1.0) * term
    return total


def bits_per_token(feature_bits: Column, kept: Column) -> Column:
    """Feature bits by kept token and the class token; an error where they don't divide."""
    return F.when(feature_bits % (kept + 1) == 0, (feature_bits / (kept + 1)).cast("long")).otherwise(F.raise_error(F.lit("feature bits don't divide by tokens")).cast("long"))


def entropy_report(labels: DataFrame, pmf: DataFrame, symbols: int, stats_bits: float, dims: int) -> DataFrame:
    """Cross-entropy, its bound and the rate by value, of (g, label, token) rows under a pmf (g, label, p)."""
    joined = labels.join(pmf, ["g", "label"])
    tokens, groups = F.count_distinct("token"), F.count_distinct("g")
    out = joined.agg((-F.sum(F.log2(F.col("p") + 1e-30)) / tokens).alias("xent_bpt"), (groups * F.lit(float(symbols))).alias("groups"), tokens.alias("tokens"))
    bound = F.col("groups") / symbols * F.log2(F.lit(float(symbols)))
    return out.select("tokens", "xent_bpt", bound.alias("max_bpt"), ((F.col("xent_bpt") + stats_bits) / dims).alias("bpfp"))


def kilobits_per_second(total_bytes: Column, frames: Column, fps: float = 30.0) -> Column:
    return total_bytes * 8 / (frames / fps) / 1000


def rate_distortion_loss(bpp: Column, class_mse: Column, patch_mse: Column, weight: float) -> Column:
    """The value of the training objective."""
    return weight * bpp + class_mse + patch_mse
