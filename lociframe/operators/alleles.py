"""Variants of two sources brought to one spelling and matched by place.

A variant is ``chrom``, ``pos`` (from 1), ``ref``, ``alt``. Callers spell one
change in several ways: with more or fewer unchanged bases around it, and, in
a repeat, at any of its copies. The normal form has no unchanged base, and an
insertion or deletion stands as far left as the reference allows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.session import discard, release, written

SPELLING = ("chrom", "pos", "ref", "alt")
NORMAL = ("norm_pos", "removed", "inserted")
WINDOW = 64
PLACES_PER_BUCKET = 64
ROWS_PER_TASK = 500_000
INDEL = "((removed = '') <> (inserted = ''))"


def _common_prefix(a: Column, b: Column) -> Column:
    """How many bases two texts share at their beginning."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    shared = F.array_position(same, F.lit(False)).cast("int") - 1
    short = F.least(F.length(a), F.length(b))
    differs = F.substr(a, F.lit(1), F.lit(1)) != F.substr(b, F.lit(1), F.lit(1))
    return F.when((short == 0) | differs, 0).when(shared < 0, short).otherwise(F.least(shared, short))


def trimmed(variants: DataFrame) -> DataFrame:
    """``norm_pos``, ``removed`` and ``inserted`` without the bases that both alleles end or begin with."""
    ref, alt = (F.upper(F.coalesce(c, F.lit(""))) for c in ("ref", "alt"))
    ends = _common_prefix(F.reverse(ref), F.reverse(alt))
    begun = variants.withColumn("__ends", ends).withColumns(
        {name: F.substr(text, F.lit(1), F.length(text) - F.col("__ends")) for name, text in (("__ref", ref), ("__alt", alt))}
    )
    begun = begun.withColumn("__begins", _common_prefix(F.col("__ref"), F.col("__alt")))
    cut = {name: F.substr(text, F.col("__begins") + 1) for name, text in (("removed", F.col("__ref")), ("inserted", F.col("__alt")))}
    cut["norm_pos"] = F.col("pos").cast("bigint") + F.col("__begins")
    return begun.withColumns(cut).drop("__ends", "__begins", "__ref", "__alt")


def normal_alleles(variants: DataFrame, reference: DataFrame, chunk_size: int, window: int = WINDOW) -> DataFrame:
    """``chrom``, ``pos``, ``ref``, ``alt`` and their normal form, one row per spelling.

    ``reference`` holds ``chrom``, ``chunk`` (from 0) and ``bases``, chunks of
    ``chunk_size`` bases side by side. A change moves left while the base
    before it equals its last one: as many steps at a time as ``window`` bases
    show, then again for those that reached its edge or that of their chunk,
    until none does; a repeat of any length is followed to its beginning. Each
    spelling is worked on once, however many rows have it. Without a chunk
    nothing moves; alleles without a difference have an empty normal form.
    """
    distinct = variants.select(*SPELLING).filter("chrom IS NOT NULL AND pos IS NOT NULL").distinct()
    spelled = written(trimmed(distinct).select(*SPELLING, *NORMAL), "alleles")
    return spelled.filter(f"NOT {INDEL}").unionByName(_shifted(spelled.filter(INDEL), SPELLING, reference, chunk_size, window))


def _shifted(indels: DataFrame, kept: Sequence[str], reference: DataFrame, chunk_size: int, window: int) -> DataFrame:
    """Columns ``kept`` of trimmed ``indels``, and their normal forms."""
    settled, moving = [], indels
    chunks = reference.select("chrom", F.col("chunk").cast("bigint").alias("__chunk"), F.upper("bases").alias("__bases"))
    while not moving.isEmpty():
        before = F.col("norm_pos") - 1  # the last base that stands before the change
        placed = moving.withColumn("__chunk", F.floor((before - 1) / chunk_size).cast("bigint"))
        seen = placed.join(chunks.hint("merge"), ["chrom", "__chunk"], "left")
        in_chunk = before - F.col("__chunk") * chunk_size
        first = F.greatest(F.lit(1).cast("bigint"), in_chunk - window + 1)
        context = F.coalesce(F.substr(F.col("__bases"), first.cast("int"), (in_chunk - first + 1).cast("int")), F.lit(""))
        seen = seen.withColumn("__context", F.when(before > 0, context).otherwise(F.lit("")))
        allele = F.concat("removed", "inserted")
        row = F.concat("__context", allele)
        seen = seen.withColumn("__steps", _common_prefix(F.reverse("__context"), F.reverse(row)))
        at = F.length("__context") - F.col("__steps") + 1
        turned = F.substr(row, at, F.length(allele))
        moved = seen.withColumns(
            {
                "norm_pos": F.col("norm_pos") - F.col("__steps"),
                "removed": F.when(F.col("removed") != "", turned).otherwise(F.lit("")),
                "inserted": F.when(F.col("inserted") != "", turned).otherwise(F.lit("")),
                "__edge": (F.col("__steps") > 0) & (F.col("__steps") == F.length("__context")),
            }
        )
        round_done = written(moved.select(*kept, *NORMAL, "__edge"), "alleles")
        settled.append(round_done.filter(~F.col("__edge")).drop("__edge"))
        moving = round_done.filter("__edge").drop("__edge")
    result = moving.select(*kept, *NORMAL)  # has no rows
    for part in settled:
        result = result.unionByName(part.select(*kept, *NORMAL))
    return result


def normalise(variants: DataFrame, reference: DataFrame, chunk_size: int, window: int = WINDOW) -> DataFrame:
    """``variants`` with the normal form of each row; rows without a place have none.

    Rows are trimmed and written once; only insertions and deletions look up
    how far they move, once per trimmed form. Those forms and the chunks are
    joined by sorting, as everywhere here: both grow with the input, but their
    files compress to a hundredth, and by that size Spark would build them
    whole in the driver.
    """
    return _normalised(_trimmed_rows(variants), reference, chunk_size, window)


def _trimmed_rows(variants: DataFrame) -> DataFrame:
    placed = F.col("chrom").isNotNull() & F.col("pos").isNotNull()
    forms = trimmed(variants).withColumns({name: F.when(placed, F.col(name)) for name in NORMAL})
    return written(forms.select(*variants.columns, *NORMAL), "trimmed")


def _normalised(rows: DataFrame, reference: DataFrame, chunk_size: int, window: int) -> DataFrame:
    before = [f"__{name}" for name in NORMAL]
    moving = rows.filter(INDEL).select("chrom", *NORMAL).distinct()
    moving = moving.withColumns({name: F.col(form) for name, form in zip(before, NORMAL, strict=True)})
    forms = _shifted(written(moving, "alleles"), ("chrom", *before), reference, chunk_size, window)
    indels = rows.filter(INDEL).withColumnsRenamed(dict(zip(NORMAL, before, strict=True)))
    found = indels.join(forms.hint("merge"), ["chrom", *before], "left").select(*rows.columns)
    return rows.filter(f"NOT coalesce({INDEL}, false)").unionByName(found)


def match_variants(
    reported: DataFrame,
    raw: DataFrame,
    reference: DataFrame,
    chunk_size: int,
    keys: Sequence[str] = ("analysis_id",),
    tolerance: int = 0,
    window: int = WINDOW,
) -> DataFrame:
    """Each reported variant with the nearest raw one of the same change, if any.

    Both have the ``keys`` and a spelling; a raw one matches if it removes and
    inserts the same bases at most ``tolerance`` bases away. The nearest is
    taken, of equally near ones the left one, of several rows there the one
    with the greatest gap between ``somatic_vaf`` and ``germline_vaf``. Adds
    ``raw_pos``, ``distance``, and the raw row's ``somatic_vaf`` and
    ``germline_vaf`` in place of any the reported one has; without a match all
    four are null.

    Both sides are brought to normal form and written, with one spelling a row;
    then rows of one change meet in buckets of some places, by one shuffle.
    There they are sorted by place, so that the last raw one before a reported
    one and the first one after it are its nearest, however many there are.
    """
    own = reported.drop("somatic_vaf", "germline_vaf", "raw_pos", "distance")
    asked, found = (
        _written_forms(rows, reference, chunk_size, window, purpose)
        for rows, purpose in ((own, "reported"), (raw.select(*keys, *SPELLING, "somatic_vaf", "germline_vaf"), "raw"))
    )
    form, place = [*keys, "chrom", *NORMAL], [*keys, "chrom", "removed", "inserted", "__bucket"]
    size = PLACES_PER_BUCKET * (tolerance + 1)
    of_all = F.lit(True)
    for name in (*keys, "chrom", "norm_pos"):
        of_all &= F.col(name).isNotNull()

    def bucket(at: Column) -> Column:
        return F.floor(at / size).cast("bigint")

    near = F.array_distinct(F.array(bucket(F.col("norm_pos") - tolerance), bucket(F.col("norm_pos") + tolerance)))
    wanted = asked.filter(of_all).withColumns({"__asked": F.lit(True), "__bucket": bucket(F.col("norm_pos"))})
    offered = found.filter(of_all).select(
        *form,
        F.lit(False).alias("__asked"),
        F.explode(near).alias("__bucket"),
        *[F.col(name).alias(f"__{name}") for name in ("pos", "somatic_vaf", "germline_vaf")],
    )
    # dealt before the columns that only sorting needs are added, to so many tasks that none sorts on disk
    least = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, (asked.count() + found.count()) // ROWS_PER_TASK)
    met = wanted.unionByName(offered, allowMissingColumns=True).repartition(tasks, *place)
    gap = F.col("__somatic_vaf") - F.col("__germline_vaf")
    met = met.withColumns({"__no_gap": F.isnull(gap), "__gap": -gap})
    preferred_last = ["__asked", F.desc("__no_gap"), F.desc("__gap"), F.desc("__pos")]
    call = F.struct("norm_pos", F.col("__pos").alias("raw_pos"), *[F.col(f"__{x}").alias(x) for x in ("somatic_vaf", "germline_vaf")])
    last = F.last(F.when(~F.col("__asked"), call), ignorenulls=True)
    for name, order in (("__before", F.asc("norm_pos")), ("__after", F.desc("norm_pos"))):
        along = Window.partitionBy(*place).orderBy(order, *preferred_last)
        met = met.withColumn(name, last.over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    before, after = F.col("norm_pos") - F.col("__before.norm_pos"), F.col("__after.norm_pos") - F.col("norm_pos")
    nearest = F.when(before <= F.coalesce(after, before), F.col("__before")).otherwise(F.col("__after"))
    met = met.filter("__asked").withColumn("__raw", nearest)
    met = met.withColumn("__far", F.abs(F.col("norm_pos") - F.col("__raw.norm_pos")))
    results = {"distance": "__far", "raw_pos": "__raw.raw_pos", "somatic_vaf": "__raw.somatic_vaf", "germline_vaf": "__raw.germline_vaf"}
    met = met.withColumns({name: F.when(F.col("__far") <= tolerance, F.col(found_in)) for name, found_in in results.items()})

    names = [*form, *[name for name in asked.columns if name not in form]]
    typed = [F.col(name).cast(asked.schema[name].dataType).alias(name) for name in names]  # as they were before they met
    return met.select(*typed, *results).unionByName(asked.filter(~of_all).select(*names), allowMissingColumns=True)


def _written_forms(variants: DataFrame, reference: DataFrame, chunk_size: int, window: int, purpose: str) -> DataFrame:
    """``normalise`` as written rows; nothing that led to them stays on disk."""
    rows = _trimmed_rows(variants)
    release(variants.sparkSession)
    forms = written(_normalised(rows, reference, chunk_size, window), purpose)
    discard(rows)
    release(variants.sparkSession)
    return forms


def vaf_gap(matched: DataFrame, keys: Sequence[str] = ("analysis_id", "gene")) -> DataFrame:
    """Per key the greatest gap over the reported germline variants; NULL where none of them was found raw."""
    germline = matched.filter(F.col("origin") == "germline")
    gap = F.max(F.col("somatic_vaf") - F.col("germline_vaf"))
    return germline.groupBy(*keys).agg(gap.alias("vaf_difference"))
