"""First-refusal checks of an admission: an envelope with its source evidence, against the declaration that it claims.

An admission is a row with these columns:

- kind ('observed' or 'no_change') of the envelope, mode of its series, and interval, the kind that its source batch states;
- series and producer of the envelope, retry (struct series, producer);
- declared (struct provider, projection, locator, source, application, quantity, unit) and lifecycle (struct provider, projection,
  locator, ids: array of the four evidence ids, snapshot);
- observations (array of ids) and gaps (array of struct epoch, start, end) of the envelope;
- contexts (array of struct id, ordinal, source, application, quantity, unit, ids: array of the observation's, the raw and the normalized
  record's evidence id, snapshot, normalized_raw, normalized_observation, retry_content, content) and source_gaps (as gaps).

The verdict is the first check that fails, in the order of the checks below; contexts are checked one after another, each in whole
before the next. Null where nothing fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_CONTEXTS, MOST_GAPS = 256, 64


def _common() -> list[Column]:
    c = F.col
    retry = (c("retry.series") != c("series")) | (c("retry.producer") != c("producer"))
    bound = F.lit(True)
    for field in ("provider", "projection", "locator"):
        bound = bound & c(f"lifecycle.{field}").eqNullSafe(c(f"declared.{field}"))
    return [
        F.when(retry, "AdmissionRetryScopeMismatch"),
        F.when(c("interval") != c("kind"), "SourceIntervalMismatch"),
        F.when(c("declared.projection").isNull(), "SourceProjectionRequired"),
        F.when(~bound, "SourceLifecycleBindingMismatch"),
    ]


def _lifecycle_ids() -> Column:
    ids = F.col("lifecycle.ids")
    return F.when(F.size(F.array_distinct(ids)) < F.size(ids), "DuplicateSourceEvidenceId")


def _context(x: Column, k: Column) -> Column:
    """The first check that context x, the k-th from 0 on, fails."""
    before = F.get(F.col("contexts"), k - 1)["ordinal"]
    same = F.lit(True)
    for field in ("source", "application", "quantity", "unit"):
        same = same & x[field].eqNullSafe(F.col(f"declared.{field}"))
    earlier = F.concat(F.col("lifecycle.ids"), F.flatten(F.transform(F.slice("contexts", F.lit(1), k), lambda y: y["ids"])))
    seen = F.arrays_overlap(earlier, x["ids"]) | (F.size(F.array_distinct(x["ids"])) < F.size(x["ids"]))
    return F.coalesce(
        F.when(x["id"] != F.get(F.col("observations"), k), "SourceObservationAssociationMismatch"),
        F.when((k > 0) & (before >= x["ordinal"]), "MisorderedSourceRecordOrdinals"),
        F.when(~same, "SourceInterpretationMismatch"),
        F.when(seen, "DuplicateSourceEvidenceId"),
        F.when(x["snapshot"] != F.col("lifecycle.snapshot"), "SourceRawSnapshotMismatch"),
        F.when(x["normalized_raw"] != F.get(x["ids"], F.lit(1)), "SourceNormalizedRawMismatch"),
        F.when(x["normalized_observation"] != F.get(x["ids"], F.lit(0)), "SourceNormalizedObservationMismatch"),
        F.when(x["retry_content"].isNotNull() & (x["retry_content"] != x["content"]), "SourceRawIdempotencyMismatch"),
    )


def observed_violation(most_contexts: int = MOST_CONTEXTS, most_gaps: int = MOST_GAPS) -> Column:
    """The verdict on an admission of observed evidence."""
    contexts, gaps = F.size("contexts"), F.size("source_gaps")
    verdicts = F.filter(F.transform("contexts", _context), lambda v: v.isNotNull())
    return F.coalesce(
        *_common(),
        F.when(contexts > most_contexts, "TooManySourceObservationContexts"),
        F.when(contexts != F.size("observations"), "SourceObservationCountMismatch"),
        F.when(gaps > most_gaps, "TooManySourceGapContexts"),
        F.when(gaps != F.size("gaps"), "SourceGapCountMismatch"),
        _lifecycle_ids(),
        F.get(verdicts, F.lit(0)),
        F.when(~F.col("source_gaps").eqNullSafe(F.col("gaps")), "SourceGapMismatch"),
    )


def no_change_violation() -> Column:
    """The verdict on an admission that states that nothing changed; only series that collect changes may."""
    return F.coalesce(F.when(F.col("mode") != "change_only", "InvalidNoChangeMode"), *_common(), _lifecycle_ids())


def by_kind(frames: DataFrame) -> DataFrame:
    """Frames and observations of each kind of evidence; a frame without observations states that nothing changed."""
    kind = F.when(F.col("n_obs") > 0, "observed").otherwise("no_change")
    return frames.groupBy(kind.alias("kind")).agg(F.count("*").alias("frames"), F.sum("n_obs").alias("observations"))
