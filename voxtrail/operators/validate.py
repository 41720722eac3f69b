"""Contract checks: each returns the violating rows, so that a sound input costs one
aggregate and ships nothing to the driver. ``require_none`` turns rows into an error."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtrail.operators.ranks import exact_quantiles, time_index


def require_none(violations: DataFrame, message: str) -> None:
    first = violations.take(3)
    if first:
        raise ValueError(f"{message}: {[r.asDict() for r in first]}")


def dense_grid(units: DataFrame, dims: dict[str, Sequence]) -> DataFrame:
    """Every unit with every combination of the listed design values (no join needed)."""
    for name, values in dims.items():
        units = units.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return units


def fill_grid(df: DataFrame, grid: DataFrame, keys: list[str], fills: dict) -> DataFrame:
    return grid.join(df, keys, "left").fillna(fills)


def count_violations(df: DataFrame, rules: dict[str, tuple[list[str], int]]) -> DataFrame:
    """Groups whose row count differs from the rule's; all rules in one pass."""
    tags = F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"),
                 F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("group"),
                 F.lit(expected).cast("bigint").alias("expected"))
        for name, (keys, expected) in rules.items()])).alias("g")
    return (df.select(tags).groupBy("g.rule", "g.group", "g.expected")
            .agg(F.count(F.lit(1)).alias("observed"))
            .filter(F.col("observed") != F.col("expected")))


def key_issues(observed: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Missing, unexpected and duplicate keys."""
    tagged = expected.select(*keys, F.lit(1).alias("__e"), F.lit(0).alias("__o")).unionByName(
        observed.select(*keys, F.lit(0).alias("__e"), F.lit(1).alias("__o")))
    c = tagged.groupBy(*keys).agg(F.max("__e").alias("__e"), F.sum("__o").alias("n_observed"))
    issue = (F.when(F.col("n_observed") == 0, "missing").when(F.col("__e") == 0, "unexpected")
             .when(F.col("n_observed") > 1, "duplicate"))
    return c.withColumn("issue", issue).filter("issue is not null").drop("__e")


def range_issues(df: DataFrame, keys: list[str], value: str, lo: float, hi: float) -> DataFrame:
    bad = F.col(value).isNull() | F.isnan(value) | ~F.col(value).between(lo, hi)
    return df.filter(bad).select(*keys, F.lit("out_of_range").alias("issue"))


def inconsistent(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Groups in which ``value`` is not constant."""
    return (df.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))
            .filter(F.col("low") != F.col("high")))


def result_issues(df: DataFrame, expected: DataFrame, keys: list[str], value: str) -> DataFrame:
    """All key issues and values outside [0, 1], one typed row each."""
    return key_issues(df, expected, keys).drop("n_observed").unionByName(
        range_issues(df, keys, value, 0.0, 1.0))


def excluded_subjects(df: DataFrame, subject: str, exclude: Sequence) -> DataFrame:
    """Number of subjects before and after the exclusion list."""
    kept = ~F.col(subject).isin(list(exclude))
    return df.agg(F.count_distinct(subject).alias("subjects_before"),
                  F.count_distinct(F.when(kept, F.col(subject))).alias("subjects_after"),
                  F.count(F.lit(1)).alias("rows_before"), F.count_if(kept).alias("rows_after"))


def audit_selection(plan: DataFrame, selection: DataFrame, key: str, fields: list[str],
                    source: str) -> DataFrame:
    """Typed issues between a plan and a selection: missing or unexpected assets, fields that
    differ, one source used by several assets (file names compare without case)."""
    p = plan.select(key, *[F.col(f).alias("p_" + f) for f in fields], F.lit(1).alias("in_plan"))
    s = selection.select(key, *fields, F.lower(source).alias("__src"), F.lit(1).alias("in_sel"))
    j = p.join(s, key, "full")
    both = F.col("in_plan").isNotNull() & F.col("in_sel").isNotNull()
    issues = F.array(
        F.when(F.col("in_sel").isNull(), F.lit("missing_asset")),
        F.when(F.col("in_plan").isNull(), F.lit("unexpected_asset")),
        *[F.when(both & ~F.col("p_" + f).eqNullSafe(F.col(f)), F.lit("plan_mismatch:" + f))
          for f in fields])
    typed = j.select(F.col(key).cast("string").alias("item"),
                     F.explode(F.filter(issues, lambda i: i.isNotNull())).alias("issue"))
    copies = (s.groupBy("__src").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
              .select(F.col("__src").alias("item"), F.lit("duplicate_source").alias("issue")))
    return typed.unionByName(copies)


def match_candidates(expected: DataFrame, candidates: DataFrame, keys: list[str], asset: str,
                     candidate: str, preferred: str) -> DataFrame:
    """One match is proposed, none is missing, more are ambiguous. Where a key has preferred
    candidates only those count."""
    pref = F.col(preferred)
    g = candidates.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.count_if(pref).alias("__np"),
        F.min(candidate).alias("__c"), F.min(F.when(pref, F.col(candidate))).alias("__cp"))
    n = F.when(F.col("__np") > 0, F.col("__np")).otherwise(F.col("__n"))
    one = F.when(F.col("__np") > 0, F.col("__cp")).otherwise(F.col("__c"))
    j = expected.join(g, keys, "left").withColumn("n_candidates", F.coalesce(n, F.lit(0)))
    return j.select(
        asset, *keys, "n_candidates",
        F.when(F.col("n_candidates") == 1, one).alias("proposal"),
        F.when(F.col("n_candidates") == 1, "proposed_unique")
        .when(F.col("n_candidates") == 0, "unresolved_missing")
        .otherwise("unresolved_ambiguous").alias("status"))


def misaligned(left: DataFrame, right: DataFrame, index: str, fields: list[str]) -> DataFrame:
    """Every row in which two manifests differ; a message takes the first of them itself."""
    r = right.select(index, *[F.col(f).alias("r_" + f) for f in fields], F.lit(1).alias("in_right"))
    j = left.select(index, *fields, F.lit(1).alias("in_left")).join(r, index, "full")
    same = reduce(Column.__and__, [F.col(f).eqNullSafe(F.col("r_" + f)) for f in fields],
                  F.col("in_left").isNotNull() & F.col("in_right").isNotNull())
    return j.filter(~same).select(index, *fields, *["r_" + f for f in fields])


def previous_row(df: DataFrame, keys: list[str], index: str, cols: list[str]) -> DataFrame:
    """Columns of the row with index - 1, by an equi-join rather than one long window. It merges and may spill: the
    other side is as long as the series, however small its columns look to a size check."""
    prev = df.select(*keys, (F.col(index) + 1).alias(index), *[F.col(c).alias("prev_" + c) for c in cols])
    return df.join(prev.hint("merge"), [*keys, index], "left")


def extract_events(events: DataFrame, plan: DataFrame, keys: list[str], t: str, kind: str,
                   fixation: str, stimulus: str, name: str, tie: str, width: float) -> DataFrame:
    """Stimuli of each run in time order: onset after the (first) fixation, planned name in the
    same position, strictly increasing times. ``plan``: keys, order_index, planned_name."""
    e = events.filter(F.col(kind).isin(fixation, stimulus))
    fix = e.filter(F.col(kind) == fixation).groupBy(*keys).agg(
        F.min(t).alias("fix_t"), F.count(F.lit(1)).alias("n_fix"))
    stim = time_index(e.filter(F.col(kind) == stimulus), keys, t, width, [tie], "order_index")
    stim = previous_row(stim.select(*keys, "order_index", t, name), keys, "order_index", [t])
    return (stim.join(fix, keys, "left").join(plan, [*keys, "order_index"], "left")
            .select(*keys, "order_index", name, (F.col(t) - F.col("fix_t")).alias("onset"), "n_fix",
                    F.col(name).eqNullSafe(F.col("planned_name")).alias("name_ok"),
                    F.coalesce(F.col(t) > F.col("prev_" + t), F.lit(True)).alias("increasing")))


def audit_onsets(extracted: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """Status of each run: count, first and last onset, and the first rule that fails."""
    g = extracted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_events"), F.min("onset").alias("first_onset"),
        F.max("onset").alias("last_onset"), F.max("n_fix").alias("__fix"),
        F.min("name_ok").alias("__names"), F.min("increasing").alias("__inc"))
    msg = (F.when(F.coalesce("__fix", F.lit(0)) != 1, "fixation count")
           .when(F.col("n_events") != expected, "event count").when(~F.col("__names"), "plan mismatch")
           .when(~F.col("__inc"), "not increasing").otherwise(""))
    return g.withColumn("message", msg).withColumn(
        "status", F.when(msg == "", "pass").otherwise("fail")).drop("__fix", "__names", "__inc")


def content_identity(df: DataFrame, frozen: DataFrame, key: str, payload: str) -> DataFrame:
    """Size and SHA-256 of each payload against the frozen values."""
    got = df.select(key, F.octet_length(payload).cast("bigint").alias("size"),
                    F.sha2(F.col(payload), 256).alias("sha256"))
    j = got.join(frozen, key, "full")
    return j.select(key, F.when(F.col("sha256").isNull(), "missing")
                    .when(F.col("frozen_sha256").isNull(), "not_frozen")
                    .when(F.col("size") != F.col("frozen_size"), "size_changed")
                    .when(F.col("sha256") != F.col("frozen_sha256"), "content_changed")
                    .otherwise("same").alias("status"), "size")


def excluded_run_issues(df: DataFrame, subject: str, run: str, exclude: Sequence[int],
                        need: int = 1) -> DataFrame:
    """Subjects lacking an excluded run or left with fewer than ``need`` runs."""
    if len(set(exclude)) != len(exclude):
        raise ValueError(f"excluded runs repeat: {list(exclude)}")
    listed = F.col(run).isin(list(exclude))
    g = df.groupBy(subject).agg(F.count_distinct(F.when(listed, F.col(run))).alias("n_found"),
                                F.count_distinct(F.when(~listed, F.col(run))).alias("n_left"))
    return g.filter((F.col("n_found") < len(exclude)) | (F.col("n_left") < need))


def ambiguous_sessions(df: DataFrame, keys: list[str], session: str) -> DataFrame:
    """Runs that do not resolve to exactly one session."""
    return (df.groupBy(*keys).agg(F.count_distinct(session).alias("n_sessions"))
            .filter(F.col("n_sessions") != 1))


def kept_regions(counts: DataFrame, region: list[str], n: str, least: int) -> DataFrame:
    """Region manifest from a dense subject x region count table; ``region``: its keys."""
    base = counts.groupBy(*region).agg(F.min(n).alias("min_voxels"), F.max(n).alias("max_voxels"))
    base = base.join(exact_quantiles(counts, region, n, {"median_voxels": 0.5}, settled=True), region)
    kept = F.col("min_voxels") >= least
    return base.withColumn("kept", kept).withColumn(
        "reason", F.when(kept, "").otherwise(F.lit(f"< {least} voxels in at least one subject")))


def ledger_issues(ledger: DataFrame, canonical: Column) -> DataFrame:
    """Rows whose sequence, link or hash is wrong. The predecessor is found by an equi-join on
    sequence - 1, so the chain is checked in parallel. A row's own hash is checked before, so that
    its payload takes no part in the join. Copies are numbered where the join needs them anyway: a count of bare
    sequences is so small once compressed that the whole chain would be read by one task."""
    copy = F.row_number().over(Window.partitionBy("sequence").orderBy("event_sha256"))
    own = ledger.select("sequence", "previous_event_sha256", "event_sha256", copy.alias("__copy"),
                        F.col("event_sha256").eqNullSafe(F.sha2(canonical, 256)).alias("__same"))
    c = previous_row(own, [], "sequence", ["event_sha256", "__copy"])
    first = F.col("sequence") == 1
    issues = F.array(
        F.when(~first & F.col("prev_event_sha256").isNull(), F.lit("sequence_gap")),
        F.when(F.col("prev_event_sha256").isNotNull()
               & ~F.col("previous_event_sha256").eqNullSafe(F.col("prev_event_sha256"))
               | (first & F.col("previous_event_sha256").isNotNull()), F.lit("broken_link")),
        F.when(~F.col("__same"), F.lit("wrong_hash")),
        F.when((F.col("__copy") == 2) & (F.coalesce("prev___copy", F.lit(1)) == 1), F.lit("duplicate_sequence")))
    return c.select("sequence", F.explode(F.filter(issues, lambda i: i.isNotNull())).alias("issue"))


def stage_status(ledger: DataFrame, subject: str, stages: list[str]) -> DataFrame:
    """Latest completion per subject and stage, one column per stage in order, and flags."""
    done = ledger.filter(F.col("event") == "completed")
    cols = [F.max_by(F.when(F.col("stage") == s, F.col("status")),
                     F.when(F.col("stage") == s, F.col("sequence"))).alias(s) for s in stages]
    g = done.groupBy(subject).agg(*cols)
    everyone = ledger.select(subject).distinct()
    g = everyone.join(g, subject, "left").fillna("pending", stages)
    # a later stage has history although an earlier one has not passed
    gap = reduce(Column.__or__, [(F.col(later) != "pending") & (F.col(early) != "passed")
                                 for i, early in enumerate(stages) for later in stages[i + 1:]])
    complete = reduce(Column.__and__, [F.col(s) == "passed" for s in stages])
    return g.withColumn("overall", F.when(complete, "complete").otherwise("incomplete")).withColumn(
        "order_violation", gap)
