"""Quality gate, reports and versioned releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeatlas.functions.expr import items, strip
from tomeatlas.functions.geo import in_range, is_null_island
from tomeatlas.functions.quality import has_core_metadata, is_specific_place, quality_gate
from tomeatlas.functions.titles import suspected_nonfiction
from tomeatlas.operators.dedup import with_book_key
from tomeatlas.schema import conform, ensure


def gate_report(gated: DataFrame) -> DataFrame:
    """Long table (section, name, entries) of totals, verdicts, tiers, stub reasons and risk flags.

    Every row contributes a few (section, name) pairs; one aggregation counts them all.
    """

    def entry(section: str, name: Column | str, keep: Column | None = None) -> Column:
        value = F.struct(F.lit(section).alias("section"), (F.lit(name) if isinstance(name, str) else name).alias("name"))
        return value if keep is None else F.when(keep, value)

    stub = F.col("quality_tier") == "stub"
    thin = (F.size(items("themes")) == 0) & (F.size(items("emotions")) == 0)
    verdict = F.when(F.col("quality_passed"), F.lit("passing")).otherwise(F.lit("failing"))
    entries = F.array_compact(
        F.array(
            entry("total", "total"),
            entry("verdict", verdict),
            entry("tier", F.col("quality_tier")),
            entry("stub_reason", "vague_or_region_place", stub & ~is_specific_place()),
            entry("stub_reason", "missing_core_metadata", stub & ~has_core_metadata()),
            entry("stub_reason", "empty_enrichment", stub & thin),
        )
    )
    risks = F.transform("geo_risk_flags", lambda f: F.struct(F.lit("geo_risk").alias("section"), f.alias("name")))
    return (
        ensure(gated, "place_granularity")
        .select(F.inline(F.concat(entries, risks)))
        .groupBy("section", "name")
        .agg(F.count("*").alias("entries"))
    )


def run_gate(
    places: DataFrame,
    threshold: float = 0.55,
    geo_threshold: float = 0.60,
    allow_composite: bool = False,
    reject: bool = False,
) -> dict[str, DataFrame]:
    gated = quality_gate(places, threshold, geo_threshold, allow_composite)
    failed = ~F.col("quality_passed")
    return {
        "data": gated.filter("quality_passed") if reject else gated,
        "removed": gated.filter(failed) if reject else gated.filter(F.lit(False)),
        "report": gate_report(gated),
    }


COUNTERS = ("source", "region", "language", "passage_type", "passage_source", "quality_tier")


def quality_metrics(df: DataFrame) -> DataFrame:
    """Long table (metric, value, entries): what is missing or wrong, and the usual counters.

    Numbers and counters come from one pass. Duplicates are rows beyond the first of each
    (title, author), that is rows less distinct works.
    """
    df = with_book_key(ensure(df, *COUNTERS))
    unlocated = F.col("lon").isNull() | F.col("lat").isNull()
    checks = {
        "total": F.lit(True),
        "missing_passage": strip("passage") == "",
        "missing_emotions": F.size(items("emotions")) == 0,
        "missing_themes": F.size(items("themes")) == 0,
        "bad_coordinates": unlocated | ~in_range(),
        "null_island": is_null_island(),
        "suspected_nonfiction": suspected_nonfiction("book_title"),
    }

    def entry(metric: str, value: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), value.alias("value"))

    blank = F.lit("")
    unknown = {"region": "Unknown", "language": "Unknown"}
    flags = [F.when(c, entry(m, blank)) for m, c in checks.items()]
    counters = [
        entry(c, F.coalesce(F.nullif(c, F.lit("")), F.lit(unknown.get(c, "unknown")))) for c in COUNTERS
    ]
    pairs = df.select(F.inline(F.array_compact(F.array(*flags, *counters))))
    counts = pairs.groupBy("metric", "value").agg(F.count("*").alias("entries"))
    works = df.groupBy("title_key", "author_key").agg((F.count("*") - 1).alias("extra"))
    duplicates = works.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("entries")).select(
        F.lit("duplicate_rows").alias("metric"), blank.alias("value"), "entries"
    )
    return counts.unionByName(duplicates)


# ---- releases ----


def release_manifest(df: DataFrame, version: str) -> DataFrame:
    """One row: version, entries, and two checksums that do not depend on row order or partitioning.

    ``checksum`` adds up hashes of the rows as JSON, ``digest`` the first 15 hex digits of the SHA-256 of ``row_text``,
    which any other program can recompute.
    """
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns))))
    part = F.conv(F.left(F.sha2(row_text(df).cast("binary"), 256), F.lit(15)), 16, 10)
    return df.agg(
        F.count("*").alias("entries"),
        F.sum(row.cast("decimal(38,0)")).cast("string").alias("checksum"),
        F.sum(part.cast("decimal(38,0)")).cast("string").alias("digest"),
    ).select(F.lit(version).alias("version"), "entries", "checksum", "digest")


def row_text(df: DataFrame) -> Column:
    """Fields in order of their names, parted by a unit separator: lists parted by bars, fractions in millionths,
    missing ones empty."""

    def shown(name: str, kind: str) -> Column:
        if kind == "array<string>":
            return F.array_join(name, "|")
        if kind in ("double", "float"):
            return F.round(F.col(name) * 1_000_000).cast("bigint").cast("string")
        return F.col(name).cast("string")

    return F.concat_ws("\x1f", *[F.coalesce(shown(n, k), F.lit("")) for n, k in sorted(df.dtypes)])


class ReleaseRefused(Exception):
    """The passing ratio of a release is below its minimum."""


def passing_ratio(report: DataFrame) -> DataFrame:
    """(passing, failing, passing_ratio) of a gate report."""

    def sum_of(section: str, name: str) -> Column:
        hit = (F.col("section") == section) & (F.col("name") == name)
        return F.coalesce(F.sum(F.when(hit, F.col("entries"))), F.lit(0))

    total = sum_of("total", "total")
    passing = sum_of("verdict", "passing")
    return report.agg(
        passing.alias("passing"),
        sum_of("verdict", "failing").alias("failing"),
        F.coalesce(F.try_divide(passing, total), F.lit(0.0)).alias("passing_ratio"),
    )


def cut_release(
    df: DataFrame, root: str, version: str, report: DataFrame | None = None, min_ratio: float = 0.60
) -> DataFrame:
    """Write the rows as ``release=version`` below ``root`` and return the manifest row.

    With a report, a ratio of passing rows below ``min_ratio`` refuses the release before anything
    is written. The manifest is read from what was written.
    """
    if report is not None:
        ratio = float(passing_ratio(report).first()["passing_ratio"])  # one number, also written below
        if ratio < min_ratio:
            raise ReleaseRefused(f"passing ratio {ratio:.3f} is below the minimum {min_ratio:.3f}")
    path = f"{root.rstrip('/')}/release={version}"
    rows = conform(df)
    rows.write.mode("errorifexists").parquet(path)
    written = df.sparkSession.read.schema(rows.schema).parquet(path)
    manifest = release_manifest(written, version)
    if report is not None:
        manifest = manifest.withColumn("passing_ratio", F.round(F.lit(ratio), 4))
    return manifest


def dataset_meta(df: DataFrame, version: str, source: str, threshold: float | None, built_at: str | None) -> DataFrame:
    """One row that describes the dataset."""
    return df.agg(F.count("*").alias("total_entries")).select(
        F.lit(version).alias("version"), "total_entries", F.lit(threshold).cast("double").alias("quality_threshold"),
        F.lit(source).alias("source"), F.lit(built_at).cast("string").alias("built_at"),
    )

