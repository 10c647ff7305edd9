"""Expressions on names, times and labels; each maps columns to a column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """Regex group, or null where it isn't found or is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _moment(digits: Column) -> Column:
    """yyyyMMddTHHmmss as a timestamp without zone, whatever the session's; null if it is no date."""
    return F.regexp_replace(digits, r"^(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)$", "$1-$2-$3T$4:$5:$6").try_cast("timestamp_ntz")


def name_timestamp(name: Column) -> Column:
    """Start of a clip, in UTC, from the first yyyyMMddTHHmmss in its name; null if absent or no date."""
    return _moment(found(name, r"\d{8}T\d{6}"))


def positional_timestamp(name: Column) -> Column:
    """Start of a clip, in UTC, from the second part between underscores, without fraction and Z."""
    stem = F.regexp_replace(name, r"\.[A-Za-z]+$", "")
    part = F.get(F.split(stem, "_"), F.lit(1))
    return _moment(found(F.substring(F.substring_index(F.replace(part, F.lit("Z"), F.lit("")), ".", 1), 1, 15), r"^\d{8}T\d{6}$"))


def iso_timestamp(text: Column) -> Column:
    """ISO time with Z or without; either is UTC, and has no zone here."""
    return F.regexp_replace(text, "Z$", "").try_cast("timestamp_ntz")


def clock_seconds(text: Column) -> Column:
    """MM:SS.f, HH:MM:SS.f or plain seconds; anything else is null."""
    part = F.split(text, ":")
    number = [F.get(part, F.lit(i)).try_cast("double") for i in range(3)]
    return (
        F.when(F.size(part) == 1, number[0])
        .when(F.size(part) == 2, number[0] * 60 + number[1])
        .when(F.size(part) == 3, number[0] * 3600 + number[1] * 60 + number[2])
    )


def clip_offsets(begin: Column, end: Column, minute: Column, second: Column, clip_s: float = 300.0) -> tuple[Column, Column]:
    """Offsets from the hour made offsets from the clip start at minute:second; null minute leaves them."""
    h = minute * 60 + second
    inside = (begin >= h) & (begin < h + clip_s)
    late = begin > 3600
    shift = lambda x: F.when(h.isNull(), x).when(inside, x - h).when(late, x % clip_s).otherwise(x)
    return shift(begin), shift(end)


def library_class(path: Column) -> Column:
    """20Hz or 40Hz where the file name says so; unknown for null, else other."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.when(path.isNull(), "unknown").when(name.contains("20hz"), "20Hz").when(name.contains("40hz"), "40Hz").otherwise("other")


def device_code(clip_id: Column) -> Column:
    return F.coalesce(F.substring_index(clip_id, "_", 1), F.lit("UNKNOWN"))


def safe_call_id(clip_id: Column, begin: Column, end: Column) -> Column:
    raw = F.format_string("%s_%.1fs_%.1fs", F.replace(clip_id, F.lit(".wav"), F.lit("")), begin, end)
    return F.replace(F.replace(raw, F.lit(":"), F.lit("-")), F.lit(" "), F.lit("_"))


def base_id(item_id: Column) -> Column:
    """Text before the last _win, or the whole id."""
    return F.when(item_id.contains("_win"), F.regexp_extract(item_id, "^(.*)_win", 1)).otherwise(item_id)


def spectrogram_name(name: Column) -> tuple[Column, Column, Column]:
    """(source, start, second number) of clip_12.3s_15.0s_..., clip,12.3s,15.0s,... or else the stem and nulls."""
    stem = F.regexp_replace(name, r"\.mat$", "")
    under, comma = r"^(.+?)_([0-9.]+)s_([0-9.]+)s", r"^(.+?),([0-9.]+)s,([0-9.]+)s"
    part = lambda i: F.coalesce(found(stem, under, i), found(stem, comma, i))
    return F.coalesce(part(1), stem), part(2).try_cast("double"), part(3).try_cast("double")


def hydrophone(source: Column) -> Column:
    """Device id inside a source text."""
    return F.coalesce(found(source, "IC[A-Z0-9]+"), found(source, "JASCOAMARHYDROPHONE[A-Z0-9]+"), F.lit("Unknown"))


def millisecond_stamp(source: Column) -> Column:
    return F.coalesce(found(source, r"\d{8}T\d{6}\.\d{3}Z"), F.lit("Unknown"))


def neighbour_name(device: Column, start: Column, seconds: int) -> Column:
    """File name of the clip so many seconds on."""
    at = start + F.expr(f"make_dt_interval(0, 0, 0, {seconds})")
    return F.concat(device, F.lit("_"), F.date_format(at, "yyyyMMdd'T'HHmmss.SSS"), F.lit("Z.wav"))


def leading_int(text: Column, default: int) -> Column:
    return F.coalesce(F.get(F.split(text, " "), F.lit(0)).try_cast("int"), F.lit(default))


def default_path(matched: Column, given: Column, folder: str, base: Column, suffix: str) -> Column:
    """The catalogue's path where a catalogue row matched, even if null; else folder/base.suffix."""
    return F.when(matched, given).otherwise(F.concat(F.lit(folder + "/"), base, F.lit("." + suffix)))


def score_duration(context: Column, start: Column, end: Column) -> Column:
    return F.coalesce(context, F.greatest(F.lit(0.0), end - start))


def value_range(text: Column) -> Column:
    """JSON [a, b] or {"min": a, "max": b} as struct<min, max>."""
    pair, named = F.from_json(text, "array<double>"), F.from_json(text, "min double, max double")
    return F.struct(F.coalesce(F.get(pair, F.lit(0)), named["min"]).alias("min"), F.coalesce(F.get(pair, F.lit(1)), named["max"]).alias("max"))


def provenance(text: Column) -> Column:
    """Where spectrogram settings came from, by the keys of a JSON text."""
    return provenance_by(lambda k: F.get_json_object(text, f"$.{k}").isNotNull())


def provenance_by(has: Callable[[str], Column]) -> Column:
    """provenance() by a test whether a key is there."""
    return F.when(has("spectrogram_source"), "explicit").when(has("download"), "download").when(has("plot_res") | has("plotRes"), "plot").otherwise("default")


def positive_probability(z0: Column, z1: Column) -> Column:
    """Softmax of two logits."""
    return 1 / (1 + F.exp(z0 - z1))


def framed(*columns: Column) -> Column:
    """All columns in one text that tells them apart: length:value each, - for null."""
    return F.concat(*[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in columns])


def fingerprint(*columns: Column) -> Column:
    return F.concat(F.lit("sha256-"), F.substring(F.sha2(framed(*columns), 256), 1, 12))


def hash_key(seed: str, *keys: Column) -> Column:
    """md5(seed|key): an order that looks random and is the same in every run and engine."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys]))


def unit(key: Column) -> Column:
    """First 13 hex digits of a hash as a number from 0 to below 1."""
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
