"""Every query by name, with the equivalent DuckDB SQL.

Each callable takes (spark, sf_dir) and runs an operator over the whole tables. Keys that start with x_ are extensions: general
relational work that the archive's users get from Spark. Queries without SQL are state machines; tests hold them against small
independent programs.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronolith.functions import scalars as S
from chronolith.operators import admission, blocks, directories, generations, latest, lookups, model, recent, recovery, registry, retry, validation
from chronolith.sources import journal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


EVENTS = "(SELECT event_id + 1 AS seq, user_id AS series, ts AS effective, value, event_type AS state, event_id FROM events)"
OBS = """(SELECT l_orderkey + 1 AS seq, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS ordinal, l_shipdate AS receive, l_quantity AS value, l_returnflag AS tag FROM lineitem)"""
FRAMES = "(SELECT o_orderkey + 1 AS seq, o_custkey AS series, o_orderdate AS effective, o_orderpriority AS priority, coalesce(n_obs, 0) AS n_obs, 64 + 96 * coalesce(n_obs, 0) AS len FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n_obs FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"
STORE = f"(SELECT c_nationkey AS store, f.*, row_number() OVER (PARTITION BY c_nationkey ORDER BY seq) AS store_seq FROM {FRAMES} f JOIN customer ON c_custkey = series)"
SERIES = 7


def _span(t: str) -> tuple:
    return tuple(map(datetime.fromisoformat, t.split()))


# ---- recent-first reads


@query(f"SELECT seq, effective, value FROM {EVENTS} WHERE series = 7 ORDER BY effective DESC, event_id DESC LIMIT 16")
def recent_observations(spark, d):
    return recent.recent(model.event_observations(spark, d), SERIES, 16).select("seq", "effective", "value")


@query(f"SELECT seq, effective, value FROM {EVENTS} WHERE series = 7 AND effective >= TIMESTAMP '2024-01-02' AND effective < TIMESTAMP '2024-01-20' ORDER BY effective DESC, event_id DESC LIMIT 5")
def recent_interval(spark, d):
    return recent.recent(model.event_observations(spark, d), SERIES, 5, *_span("2024-01-02 2024-01-20")).select("seq", "effective", "value")


@query(f"""SELECT CAST(7 AS BIGINT) AS series, least(n, 16) AS returned, n > 16 AS is_truncated FROM (SELECT count(*) AS n FROM {EVENTS} WHERE series = 7)
UNION ALL SELECT CAST(-1 AS BIGINT), 0, false
UNION ALL SELECT CAST(7 AS BIGINT), least(n, 3), n > 3 FROM (SELECT count(*) AS n FROM {EVENTS} WHERE series = 7 AND effective >= TIMESTAMP '2024-01-02' AND effective < TIMESTAMP '2024-01-10')""")
def recent_truncated(spark, d):
    e = model.event_observations(spark, d)
    return recent.recent_with_evidence(e, SERIES, 16).union(recent.recent_with_evidence(e, -1, 16)).union(recent.recent_with_evidence(e, SERIES, 3, *_span("2024-01-02 2024-01-10")))


@query(f"SELECT seq, effective FROM {FRAMES} WHERE series = 7 ORDER BY effective DESC, seq DESC LIMIT 16")
def recent_ties(spark, d):
    return recent.recent(model.frames(spark, d), SERIES, 16).select("seq", "effective")


@query(f"SELECT f.seq, ordinal, value FROM {FRAMES} f JOIN {OBS} o USING (seq) WHERE series = 7 ORDER BY f.effective DESC, receive DESC, f.seq DESC, ordinal LIMIT 16")
def recent_frame_observations(spark, d):
    mine = model.frames(spark, d).where(F.col("series") == SERIES).select("seq", "series", "effective")
    return recent.recent(mine.join(model.observations(spark, d, mine), "seq"), SERIES, 16).select("seq", "ordinal", "value")


@query(f"SELECT seq, effective FROM {FRAMES} WHERE series = 7 AND (seq - 1) // 500 + 1 = 2 ORDER BY effective DESC, seq DESC LIMIT 16")
def recent_in_generation(spark, d):
    g = generations.rotate_by_count(model.frames(spark, d), 500).where("generation = 2")
    return recent.recent(g, SERIES, 16).select("seq", "effective")


@query("SELECT o.seq, o.effective, e.props FROM (SELECT event_id + 1 AS seq, ts AS effective FROM events WHERE user_id = 7 ORDER BY ts DESC LIMIT 4) o JOIN events e ON e.event_id + 1 = o.seq")
def late_decode(spark, d):
    payloads = model.table(spark, d, "events").select((F.col("event_id") + 1).alias("seq"), "props")
    return recent.late_decoded(model.event_observations(spark, d).select("seq", "series", "effective", "receive"), payloads, SERIES, 4).select("seq", "effective", "props")

# ---- admissions

CHECKS = ("AdmissionRetryScopeMismatch", "SourceIntervalMismatch", "SourceProjectionRequired", "SourceLifecycleBindingMismatch", "TooManySourceObservationContexts", "SourceObservationCountMismatch", "SourceGapCountMismatch", "DuplicateSourceEvidenceId")
CONTEXT_CHECKS = ("SourceObservationAssociationMismatch", "MisorderedSourceRecordOrdinals", "SourceInterpretationMismatch", "DuplicateSourceEvidenceId", "SourceRawSnapshotMismatch", "SourceNormalizedRawMismatch", "SourceNormalizedObservationMismatch", "SourceRawIdempotencyMismatch")
_of_row = " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(CHECKS))
_of_context = " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(CONTEXT_CHECKS))


# Admissions from orders: the key's remainders decide on faults, often several in one row
@query(f"""WITH a AS (SELECT seq, n_obs AS n FROM {FRAMES}),
r AS (SELECT seq, unnest([seq % 29 = 0, seq % 31 = 0, seq % 37 = 0, seq % 23 = 0, n + CAST(seq % 19 = 0 AS INT) > 6, seq % 19 = 0, seq % 17 = 0, seq % 13 = 0]) AS bad, unnest(range(8)) AS c FROM a),
k AS (SELECT seq, n, unnest(range(n)) AS k FROM a),
x AS (SELECT seq, k, unnest([(seq + k) % 11 = 0, k > 0 AND 10 * k - CASE WHEN (seq + 2 * k) % 7 = 0 THEN 10 ELSE 0 END <= 10 * (k - 1) - CASE WHEN (seq + 2 * (k - 1)) % 7 = 0 THEN 10 ELSE 0 END, (seq + 3 * k) % 41 = 0, (seq + 5 * k) % 43 = 0, (seq + k) % 47 = 0, (seq + 2 * k) % 53 = 0, (seq + k) % 59 = 0, (seq + k) % 61 = 0]) AS bad, unnest(range(8)) AS c FROM k),
f AS (SELECT seq, c AS place, CASE c {_of_row} END AS violation FROM r WHERE bad UNION ALL SELECT seq, 100 + 10 * k + c, CASE c {_of_context} END FROM x WHERE bad UNION ALL SELECT seq, 100000, 'SourceGapMismatch' FROM a WHERE seq % 5 = 0)
SELECT a.seq, min_by(violation, place) AS violation FROM a LEFT JOIN f USING (seq) GROUP BY a.seq""")
def admission_violation(spark, d):
    seq, n = F.col("seq"), F.col("n")

    def hit(x, by):
        return x % by == 0

    def context(k):
        s = seq + k
        ids = F.array(F.when(hit(seq + 5 * k, 43), F.lit(1).cast("long")).otherwise(100 + 3 * k), 101 + 3 * k, 102 + 3 * k)
        return F.struct(
            F.when(hit(s, 11), F.lit(-1).cast("long")).otherwise(k).alias("id"),
            (10 * k - F.when(hit(seq + 2 * k, 7), 10).otherwise(0)).alias("ordinal"),
            F.lit("source").alias("source"), F.lit(None).cast("string").alias("application"), F.lit("power").alias("quantity"),
            F.when(hit(seq + 3 * k, 41), "kW").otherwise("W").alias("unit"),
            ids.alias("ids"), F.when(hit(s, 47), 9).otherwise(4).alias("snapshot"),
            F.when(hit(seq + 2 * k, 53), F.lit(0).cast("long")).otherwise(ids[1]).alias("normalized_raw"),
            F.when(hit(s, 59), F.lit(0).cast("long")).otherwise(ids[0]).alias("normalized_observation"),
            F.when(hit(s, 61), "other").when(hit(s, 2), "same").alias("retry_content"), F.lit("same").alias("content"),
        )

    def numbers(upto):
        return F.when(upto > 0, F.sequence(F.lit(0).cast("long"), upto - 1)).otherwise(F.array().cast("array<bigint>"))

    projection = F.when(hit(seq, 37), F.lit(None).cast("string")).otherwise("view")
    gap = F.struct(F.lit(1).alias("epoch"), F.when(hit(seq, 5), 3).otherwise(2).alias("start"), F.lit(9).alias("end"))
    rows = model.sized_frames(spark, d).select("seq", F.col("n_obs").cast("long").alias("n")).select(
        "seq", F.lit("observed").alias("kind"), F.lit("sampled").alias("mode"), F.when(hit(seq, 31), "no_change").otherwise("observed").alias("interval"),
        seq.alias("series"), F.lit(7).alias("producer"), F.struct(seq.alias("series"), F.when(hit(seq, 29), 8).otherwise(7).alias("producer")).alias("retry"),
        F.struct(F.lit("p").alias("provider"), projection.alias("projection"), F.lit("l").alias("locator"), F.lit("source").alias("source"), F.lit(None).cast("string").alias("application"), F.lit("power").alias("quantity"), F.lit("W").alias("unit")).alias("declared"),
        F.struct(F.lit("p").alias("provider"), projection.alias("projection"), F.when(hit(seq, 23), "x").otherwise("l").alias("locator"), F.array(F.lit(1).cast("long"), F.lit(2).cast("long"), F.lit(3).cast("long"), F.when(hit(seq, 13), F.lit(3).cast("long")).otherwise(4)).alias("ids"), F.lit(4).alias("snapshot")).alias("lifecycle"),
        numbers(n).alias("observations"), F.array(F.struct(F.lit(1).alias("epoch"), F.lit(2).alias("start"), F.lit(9).alias("end"))).alias("gaps"),
        F.transform(numbers(n + hit(seq, 19).cast("long")), context).alias("contexts"), F.when(hit(seq, 17), F.array(gap, gap)).otherwise(F.array(gap)).alias("source_gaps"),
    )
    return rows.select("seq", admission.observed_violation(6, 64).alias("violation"))


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'InvalidNoChangeMode' WHEN event_id % 5 = 0 THEN 'AdmissionRetryScopeMismatch' WHEN event_id % 3 = 0 THEN 'SourceIntervalMismatch'
WHEN event_id % 11 = 0 THEN 'SourceProjectionRequired' WHEN event_id % 13 = 0 THEN 'SourceLifecycleBindingMismatch' WHEN event_id % 2 = 0 THEN 'DuplicateSourceEvidenceId' END AS violation FROM events""")
def no_change_violation(spark, d):
    i = F.col("event_id")
    projection = F.when(i % 11 == 0, F.lit(None).cast("string")).otherwise("view")
    rows = model.table(spark, d, "events").select(
        "event_id", F.lit("no_change").alias("kind"), F.when(i % 7 == 0, "sampled").otherwise("change_only").alias("mode"), F.when(i % 3 == 0, "observed").otherwise("no_change").alias("interval"),
        i.alias("series"), F.lit(1).alias("producer"), F.struct(F.when(i % 5 == 0, -1).otherwise(i).alias("series"), F.lit(1).alias("producer")).alias("retry"),
        F.struct(F.lit("p").alias("provider"), projection.alias("projection"), F.lit("l").alias("locator")).alias("declared"),
        F.struct(F.when(i % 13 == 0, "q").otherwise("p").alias("provider"), projection.alias("projection"), F.lit("l").alias("locator"), F.array(i, i + 1, i + 2, F.when(i % 2 == 0, i).otherwise(i + 3)).alias("ids")).alias("lifecycle"),
    )
    return rows.select("event_id", admission.no_change_violation().alias("violation"))


LINE_END = "SELECT event_id, CASE event_id % 6 WHEN 0 THEN '5' WHEN 1 THEN 'tok' WHEN 2 THEN '018f0000-0000-7abc-8def-000000000001' WHEN 3 THEN 'TOK' WHEN 4 THEN '018F0000-0000-7ABC-8DEF-000000000001' END || CASE WHEN event_id % 4 < 2 THEN chr(10) ELSE '' END AS t FROM events"


@query(f"""SELECT event_id, coalesce(regexp_full_match(t, '(0|[1-9][0-9]{{0,38}})'), false) AS number, coalesce(regexp_full_match(t, '[ -~]{{1,256}}'), false) AS token, coalesce(regexp_full_match(t, '[ -~]{{1,128}}'), false) AS retry_key,
coalesce(regexp_full_match(t, '[!-@\\[-~]{{1,64}}'), false) AS format, coalesce(regexp_full_match(t, '[0-9a-f]{{8}}-[0-9a-f]{{4}}-7[0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}'), false) AS uuid FROM ({LINE_END})""")
def line_ends_refused(spark, d):
    i = F.col("event_id")
    word = F.when(i % 6 == 0, "5").when(i % 6 == 1, "tok").when(i % 6 == 2, "018f0000-0000-7abc-8def-000000000001").when(i % 6 == 3, "TOK").when(i % 6 == 4, "018F0000-0000-7ABC-8DEF-000000000001")
    t = model.table(spark, d, "events").select("event_id", F.concat(word, F.when(i % 4 < 2, "\n").otherwise("")).alias("t"))
    c = F.col("t")
    return t.select("event_id", S.canonical_decimal(c).alias("number"), S.portable_token(c).alias("token"), S.retry_key(c).alias("retry_key"), S.content_format(c).alias("format"), S.uuid_valid(c).alias("uuid"))


@query("""SELECT a.event_id, CASE WHEN a.s IS DISTINCT FROM b.s OR a.k IS DISTINCT FROM b.k THEN 'distinct' WHEN a.c IS NOT DISTINCT FROM b.c THEN 'equivalent' ELSE 'conflict' END AS class
FROM (SELECT event_id, nullif(event_id % 3, 0) AS s, nullif(event_id % 2, 0) AS k, event_id % 5 AS c FROM events) a JOIN (SELECT event_id, nullif(event_id % 3, 0) AS s, nullif(event_id % 4, 0) AS k, event_id % 7 AS c FROM events) b USING (event_id)""")
def retry_classify_nulls(spark, d):
    i = F.col("event_id")

    def side(k, c):
        return F.struct(F.nullif(i % 3, F.lit(0)).alias("scope"), F.nullif(i % k, F.lit(0)).alias("key"), (i % c).alias("content"))

    return model.table(spark, d, "events").select("event_id", side(2, 5).alias("a"), side(4, 7).alias("b")).select("event_id", retry.classify("a", "b").alias("class"))


@query(f"SELECT store, store_seq, 28 + len <= 500 AS held FROM {STORE}")
def oversize_frames(spark, d):
    """Frames that no generation of 500 bytes holds are refused, whatever came before."""
    f = generations.rotate_by_bytes(model.store_frames(spark, d).select("store", "store_seq", "len"), 500, 1000)
    return f.select("store", "store_seq", F.col("generation").isNotNull().alias("held"))


# ---- directories


@query(f"SELECT series, count(*) AS frame_count, CAST(sum(n_obs) AS BIGINT) AS observation_count, CAST(sum(len) AS BIGINT) AS block_length, min(seq) AS first_seq, max(seq) AS last_seq FROM {FRAMES} GROUP BY series")
def series_directory(spark, d):
    return directories.series_directory(model.sized_frames(spark, d))


@query(f"SELECT seq, series, row_number() OVER w - 1 AS frame_ordinal, CAST(coalesce(sum(len) OVER (PARTITION BY series ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS frame_offset FROM {FRAMES} WINDOW w AS (PARTITION BY series ORDER BY seq)")
def append_directory(spark, d):
    return directories.append_directory(model.sized_frames(spark, d))


@query(f"WITH s AS (SELECT series, sum(len) AS n FROM {FRAMES} GROUP BY series) SELECT series, CAST(192 + 64 * count(*) OVER () + coalesce(sum(n) OVER (ORDER BY series ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS block_offset, CAST(n AS BIGINT) AS block_length FROM s")
def block_offsets(spark, d):
    return directories.block_offsets(directories.series_directory(model.sized_frames(spark, d)))


@query(f"""WITH t AS (SELECT count(DISTINCT series) AS s, count(*) AS f, CAST(sum(n_obs) AS BIGINT) AS o, CAST(sum(len) AS BIGINT) AS b FROM {FRAMES})
SELECT s AS series_count, f AS frame_count, o AS observation_count, 192 + 64 * s AS blocks_offset, 192 + 64 * s + b AS append_offset, 192 + 64 * s + b + 48 * f AS recent_offset, 192 + 64 * s + b + 48 * f + 96 * o + 4 AS total FROM t""")
def segment_layout(spark, d):
    return directories.segment_layout(model.sized_frames(spark, d))


@query(f"SELECT f.seq, series, f.effective, ordinal, receive FROM {FRAMES} f JOIN {OBS} o USING (seq)")
def recency_directory(spark, d):
    return directories.recency_directory(model.frames(spark, d), model.observations(spark, d)).select("seq", "series", "effective", "ordinal", "receive")


@query("SELECT count(DISTINCT o_orderkey) AS present, CAST(1000 - count(DISTINCT o_orderkey) AS BIGINT) AS missing, CAST(count(*) - count(DISTINCT o_orderkey) AS BIGINT) AS repeated FROM orders WHERE o_orderkey + 1 > 100 AND o_orderkey + 1 <= 1100")
def contiguous_coverage(spark, d):
    return directories.contiguous(model.frames(spark, d), 100, 1100)


@query(f"""WITH r AS (SELECT series, count(*) AS frame_count FROM {FRAMES} GROUP BY series), s AS (SELECT series, frame_count + CASE WHEN series % 50 = 0 THEN 1 ELSE 0 END AS frame_count FROM r)
SELECT *, 'not in frames' AS problem FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM r) UNION ALL SELECT *, 'not in index' FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM s)""")
def directory_audit(spark, d):
    real = directories.series_directory(model.sized_frames(spark, d)).select("series", "frame_count")
    damaged = real.withColumn("frame_count", F.col("frame_count") + (F.col("series") % 50 == 0).cast("int"))
    return directories.audit(damaged, real)


@query(f"SELECT CASE WHEN seq % 43 = 0 THEN -seq ELSE seq END AS seq, ordinal, CASE WHEN seq % 43 = 0 THEN 'MissingAppend' ELSE 'InconsistentSegment' END AS problem FROM {FRAMES} f JOIN {OBS} o USING (seq) WHERE seq % 43 = 0 OR seq % 31 = 0 OR seq % 37 = 0 OR seq % 41 = 0 OR seq % 47 = 0")
def entry_recheck(spark, d):
    f = model.sized_frames(spark, d)
    fields = ["series", "frame_offset", "frame_length", "frame_ordinal"]
    appends = directories.append_directory(f).join(f.select("seq", F.col("len").alias("frame_length")), "seq")
    wrong = {name: (F.col(name) + (F.col("seq") % by == 0).cast("int")).alias(name) for name, by in zip(fields, (31, 37, 41, 47))}
    entries = appends.join(model.observations(spark, d).select("seq", "ordinal"), "seq").withColumns(wrong)
    entries = entries.withColumn("seq", F.when(F.col("seq") % 43 == 0, -F.col("seq")).otherwise(F.col("seq")))
    return directories.recheck(entries, appends, fields).where("problem IS NOT NULL").select("seq", "ordinal", "problem")


# ---- generations


@query("SELECT o_orderkey + 1 AS seq, o_orderkey // 500 + 1 AS generation FROM orders")
def rotation_by_count(spark, d):
    return generations.rotate_by_count(model.frames(spark, d), 500).select("seq", "generation")


GREEDY = f"""WITH RECURSIVE f AS MATERIALIZED (SELECT * FROM {STORE}),
r AS (SELECT store, seq, store_seq, CAST(1 AS BIGINT) AS generation, 28 + len AS size, 1 AS n FROM f WHERE store_seq = 1
UNION ALL SELECT f.store, f.seq, f.store_seq, CASE WHEN r.size + f.len > 20000 OR r.n >= 40 THEN r.generation + 1 ELSE r.generation END, CASE WHEN r.size + f.len > 20000 OR r.n >= 40 THEN 28 + f.len ELSE r.size + f.len END, CASE WHEN r.size + f.len > 20000 OR r.n >= 40 THEN 1 ELSE r.n + 1 END
FROM r JOIN f ON f.store = r.store AND f.store_seq = r.store_seq + 1)"""


@query(GREEDY + " SELECT store, seq, generation FROM r")
def rotation_by_bytes(spark, d):
    return generations.rotate_by_bytes(model.store_frames(spark, d), 20_000, 40).select("store", "seq", "generation")


@query(f"""WITH RECURSIVE f AS MATERIALIZED (SELECT store, seq, store_seq, CAST(date_diff('day', DATE '1970-01-01', CAST(effective AS DATE)) AS BIGINT) AS clock FROM {STORE}),
r AS (SELECT store, seq, store_seq, CAST(1 AS BIGINT) AS generation, clock AS opened FROM f WHERE store_seq = 1
UNION ALL SELECT f.store, f.seq, f.store_seq, r.generation + CASE WHEN f.clock - r.opened >= 300 THEN 1 ELSE 0 END, CASE WHEN f.clock - r.opened >= 300 THEN f.clock ELSE r.opened END
FROM r JOIN f ON f.store = r.store AND f.store_seq = r.store_seq + 1) SELECT store, seq, generation FROM r""")
def rotation_by_age(spark, d):
    at = F.datediff(F.col("effective"), F.lit("1970-01-01").cast("date")).cast("long")
    f = model.store_frames(spark, d).select("store", "seq", "store_seq", at.alias("at"))
    return generations.rotate_by_age(f, 300).select("store", "seq", "generation")


@query("""WITH c AS (SELECT o_custkey AS series, list(o_orderkey + 1 ORDER BY o_orderkey) AS newer FROM orders GROUP BY 1),
p AS (SELECT *, CASE series % 4 WHEN 0 THEN newer WHEN 1 THEN newer[1:len(newer) - 1] WHEN 2 THEN list_transform(newer[1:len(newer) - 1], lambda x: x + 1) ELSE [] END AS older FROM c)
SELECT series, len(older) > 0 AND len(older) < len(newer) AND newer[1:len(older)] = older AS continues FROM p""")
def catalog_prefix(spark, d):
    newer, size = F.col("newer"), F.size("newer")
    c = model.frames(spark, d).groupBy("series").agg(F.sort_array(F.collect_list("seq")).alias("newer"))
    less = F.slice(newer, F.lit(1), size - 1)
    older = F.when(F.col("series") % 4 == 0, newer).when(F.col("series") % 4 == 1, less).when(F.col("series") % 4 == 2, F.transform(less, lambda x: x + 1)).otherwise(F.slice(newer, 1, 0))
    return c.select("series", generations.strict_prefix(older, newer).alias("continues"))


@query(f"""WITH RECURSIVE f AS MATERIALIZED (SELECT *, len AS l FROM {STORE}),
r AS (SELECT store, seq, store_seq, CAST(1 AS BIGINT) AS batch, l AS size, 1 AS n, priority FROM f WHERE store_seq = 1
UNION ALL SELECT f.store, f.seq, f.store_seq, r.batch + CASE WHEN r.n >= 32 OR r.size >= 8000 OR r.priority = '1-URGENT' THEN 1 ELSE 0 END, f.l + CASE WHEN r.n >= 32 OR r.size >= 8000 OR r.priority = '1-URGENT' THEN 0 ELSE r.size END, 1 + CASE WHEN r.n >= 32 OR r.size >= 8000 OR r.priority = '1-URGENT' THEN 0 ELSE r.n END, f.priority
FROM r JOIN f ON f.store = r.store AND f.store_seq = r.store_seq + 1) SELECT store, seq, batch FROM r""")
def group_commit_batches(spark, d):
    return generations.group_commits(model.store_frames(spark, d), 32, 8_000).select("store", "seq", "batch")


@query(f"SELECT (seq - 1) // 500 + 1 AS generation, min(seq) - 1 AS floor, max(seq) AS cutoff, count(*) AS records, CAST(sum(len) + 28 AS BIGINT) AS bytes FROM {FRAMES} GROUP BY 1")
def generation_catalog(spark, d):
    return generations.catalog(generations.rotate_by_count(model.sized_frames(spark, d), 500), [])


@query(GREEDY + " SELECT r.store, generation, min(r.store_seq) - 1 AS floor, max(r.store_seq) AS cutoff, count(*) AS records, CAST(sum(len) + 28 AS BIGINT) AS bytes FROM r JOIN f USING (store, store_seq) GROUP BY 1, 2")
def store_catalog(spark, d):
    return generations.catalog(generations.rotate_by_bytes(model.store_frames(spark, d), 20_000, 40), ["store"], "store_seq")


@query(f"WITH c AS (SELECT (seq - 1) // 500 + 1 AS g, min(seq) - 1 AS lo, max(seq) AS hi, sum(len) + 28 AS b FROM {FRAMES} GROUP BY 1) SELECT count(*) AS sealed, min_by(lo, g) AS floor, max_by(hi, g) AS cutoff, CAST(sum(b) AS BIGINT) AS bytes FROM c")
def generation_inventory(spark, d):
    return generations.inventory(generation_catalog(spark, d))


@query(f"""WITH c AS (SELECT (seq - 1) // 100 + 1 AS g, min(seq) - 1 AS lo, max(seq) AS hi FROM {FRAMES} GROUP BY 1),
x AS (SELECT CASE WHEN g >= 6 THEN g + 1 ELSE g END AS generation, CASE WHEN g = 4 THEN lo + 1 ELSE lo END AS floor, hi AS cutoff FROM c WHERE g <> 9),
v AS (SELECT *, lag(generation) OVER (ORDER BY generation) AS pg, lag(cutoff) OVER (ORDER BY generation) AS pc FROM x),
r AS (SELECT generation, CASE WHEN pg IS NULL AND (generation <> 1 OR floor <> 0) THEN 'bad_first' WHEN pg IS NOT NULL AND generation <> pg + 1 THEN 'generation_gap' WHEN pc IS NOT NULL AND floor <> pc THEN 'range_gap' WHEN cutoff <= floor THEN 'empty_range' END AS reason FROM v)
SELECT generation, reason FROM r WHERE reason IS NOT NULL""")
def catalog_chain_check(spark, d):
    c = generations.catalog(generations.rotate_by_count(model.sized_frames(spark, d), 100), [])
    g = F.col("generation")
    damaged = c.where(g != 9).select(F.when(g >= 6, g + 1).otherwise(g).alias("generation"), (F.col("floor") + (g == 4).cast("int")).alias("floor"), "cutoff")
    return generations.chain_violations(damaged, []).select("generation", "reason")


@query(f"""WITH c AS (SELECT (seq - 1) // 500 + 1 AS g, min(seq) - 1 AS lo, max(seq) AS hi, sum(len) + 28 AS b FROM {FRAMES} GROUP BY 1),
m AS (SELECT seq, (seq - 1) // 480 + 1 AS claimed, 28 + 600 * ((seq - 1) % 500) AS end_offset FROM {FRAMES})
SELECT seq, g AS generation FROM m JOIN c ON g = claimed WHERE seq > lo AND seq <= hi AND end_offset > 28 AND end_offset <= b""")
def covers_commit(spark, d):
    commits = model.frames(spark, d).select("seq", (F.floor((F.col("seq") - 1) / 480) + 1).alias("claimed"), (28 + 600 * ((F.col("seq") - 1) % 500)).alias("end_offset"))
    return generations.covers(commits, generation_catalog(spark, d)).select("seq", "generation")


# ---- scalars and validation


@query("""SELECT ms, CAST(floor(CAST(ms AS DECIMAL(20,0)) / 1000) AS BIGINT) AS s, CAST((ms % 1000 + 1000) % 1000 * 1000000 AS INTEGER) AS n FROM (SELECT (event_id - 300) * 777777 AS ms FROM events)""")
def time_euclid_split(spark, d):
    ms = (F.col("event_id") - 300) * 777777
    e = model.table(spark, d, "events").select(ms.alias("ms"))
    return e.select("ms", S.seconds_of_ms(F.col("ms")).alias("s"), S.nanos_of_ms(F.col("ms")).alias("n"))


@query("""WITH t AS (SELECT event_id, (event_id % 600 - 300) * CASE WHEN event_id % 7 = 0 THEN 9000000000000000 ELSE 1000 END AS s, CASE WHEN event_id % 5 = 0 THEN 123456789 ELSE (event_id % 1000) * 1000000 END AS n FROM events),
x AS (SELECT *, CAST(s AS HUGEINT) * 1000 + n // 1000000 AS e FROM t)
SELECT event_id, CASE WHEN n % 1000000 = 0 AND e BETWEEN -9223372036854775808 AND 9223372036854775807 THEN CAST(e AS BIGINT) END AS ms, CASE WHEN n % 1000000 <> 0 THEN 'sub_millisecond' WHEN e NOT BETWEEN -9223372036854775808 AND 9223372036854775807 THEN 'overflow' END AS refusal FROM x""")
def time_join(spark, d):
    i = F.col("event_id")
    t = model.table(spark, d, "events").select("event_id", ((i % 600 - 300) * F.when(i % 7 == 0, 9_000_000_000_000_000).otherwise(1000)).alias("s"), F.when(i % 5 == 0, 123456789).otherwise((i % 1000) * 1_000_000).alias("n"))
    ms, refusal = S.ms_of_time(F.col("s"), F.col("n"))
    return t.select("event_id", ms.alias("ms"), refusal.alias("refusal"))


UUIDS = "CASE event_id % 6 WHEN 0 THEN h WHEN 1 THEN upper(h) WHEN 2 THEN replace(h, '-7', '-4') WHEN 3 THEN replace(h, '-', '') WHEN 4 THEN substr(h, 1, 35) ELSE replace(h, '-8', '-c') END"
UUID_SQL = f"SELECT event_id, {UUIDS} AS text FROM (SELECT event_id, 'abcd' || lpad(CAST(event_id % 9999 AS VARCHAR), 4, '0') || '-0123-7abc-8def-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS h FROM events)"


def _uuid_texts(spark, d):
    i = F.col("event_id")
    h = F.concat(F.lit("abcd"), F.lpad((i % 9999).cast("string"), 4, "0"), F.lit("-0123-7abc-8def-"), F.lpad(i.cast("string"), 12, "0"))
    return model.table(spark, d, "events").select("event_id", h.alias("h")).select("event_id", F.expr(UUIDS).alias("text"))


@query(f"SELECT event_id, text, regexp_full_match(text, '[0-9a-f]{{8}}-[0-9a-f]{{4}}-7[0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}') AS valid FROM ({UUID_SQL})")
def uuid_valid(spark, d):
    return _uuid_texts(spark, d).select("event_id", "text", S.uuid_valid(F.col("text")).alias("valid"))


@query(f"SELECT event_id, text AS again FROM ({UUID_SQL}) WHERE regexp_full_match(text, '[0-9a-f]{{8}}-[0-9a-f]{{4}}-7[0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}')")
def uuid_round_trip(spark, d):
    u = _uuid_texts(spark, d).select("event_id", S.uuid_bytes(F.col("text")).alias("raw")).where("raw IS NOT NULL")
    return u.select("event_id", S.uuid_text(F.col("raw")).alias("again"))


DECIMALS = "CASE event_id % 7 WHEN 0 THEN CAST(event_id AS VARCHAR(40)) WHEN 1 THEN '0' || CAST(event_id AS VARCHAR(40)) WHEN 2 THEN '340282366920938463463374607431768211455' WHEN 3 THEN '340282366920938463463374607431768211456' WHEN 4 THEN '' WHEN 5 THEN '-1' ELSE '0' END"


@query(f"SELECT event_id, t AS text, regexp_full_match(t, '(0|[1-9][0-9]{{0,38}})') AND lpad(t, 39, '0') <= '340282366920938463463374607431768211455' AS valid FROM (SELECT event_id, {DECIMALS} AS t FROM events)")
def canonical_decimal(spark, d):
    t = model.table(spark, d, "events").select("event_id", F.expr(DECIMALS.replace("VARCHAR(40)", "STRING")).alias("text"))
    return t.select("event_id", "text", S.canonical_decimal(F.col("text")).alias("valid"))


@query(r"""SELECT doc_id, length(t) <= 4096 AS exact_text, regexp_full_match(t, '[ -~]{1,256}') AS token, regexp_full_match(t, '[ -~]{1,128}') AS retry_key, regexp_full_match(t, '[!-@\[-~]{1,64}') AS format, length(t) BETWEEN 1 AND 1024 AND NOT regexp_matches(t, '\p{Cc}') AS reference FROM (SELECT doc_id, text AS t FROM documents UNION ALL SELECT doc_id, lang || '/' || source FROM documents)""")
def token_valid(spark, d):
    docs = model.table(spark, d, "documents")
    t = docs.select("doc_id", "text").union(docs.select("doc_id", F.concat("lang", F.lit("/"), "source")))
    c = F.col("text")
    return t.select("doc_id", S.exact_text(c).alias("exact_text"), S.portable_token(c).alias("token"), S.retry_key(c).alias("retry_key"), S.content_format(c).alias("format"), S.declaration_reference(c).alias("reference"))


@query("SELECT DISTINCT flags, flags % 2 = 1 AS stale, flags // 2 % 2 = 1 AS invalid, flags // 4 % 2 = 1 AS substituted, flags // 8 % 2 = 1 AS overridden, flags // 16 % 2 = 1 AS out_of_service, flags // 32 % 2 = 1 AS communication_failure, flags | 4 AS with_substituted, flags & ~CAST(1 AS BIGINT) AS without_stale FROM (SELECT event_id % 64 AS flags FROM events)")
def quality_flags(spark, d):
    f = model.table(spark, d, "events").select((F.col("event_id") % 64).alias("flags")).distinct()
    return f.select("flags", *(S.flag(F.col("flags"), n).alias(n) for n in S.FLAGS), S.with_flag(F.col("flags"), "substituted").alias("with_substituted"), S.with_flag(F.col("flags"), "stale", False).alias("without_stale"))


@query("WITH f AS (SELECT unnest(['real','signed','unsigned','boolean','state','text','artifact']) AS family), k AS (SELECT unnest(['real','signed','unsigned','boolean','state','text','artifact','unavailable']) AS kind) SELECT family, kind, kind = family OR kind = 'unavailable' AS admits FROM f, k")
def value_family_admits(spark, d):
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, S.FAMILIES))).alias("family")).select("family", F.explode(F.array(*map(F.lit, (*S.FAMILIES, "unavailable")))).alias("kind"))
    return grid.select("family", "kind", S.admits(F.col("family"), F.col("kind")).alias("admits"))


# Envelopes from orders: the key decides what is wrong with each
ENVELOPES = """SELECT o_orderkey + 1 AS seq, CASE WHEN o_orderkey % 11 = 1 THEN 'interval' ELSE 'sampled' END AS mode, n,
  o_orderkey % 11 AS fault FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)"""


@query(f"""SELECT seq, CASE WHEN n > 6 THEN 'TooManyObservations' WHEN fault = 10 THEN 'TooManyGaps' WHEN n = 0 AND fault NOT IN (6, 7, 8) THEN 'EmptyObservedEvidence'
WHEN n > 0 AND fault = 1 THEN 'MissingObservationInterval' WHEN n > 0 AND fault = 2 THEN 'UnexpectedObservationInterval' WHEN n > 1 AND fault = 3 THEN 'DuplicateObservationId' WHEN n > 1 AND fault = 4 THEN 'MixedProducerPositions'
WHEN n > 1 AND fault = 5 THEN 'MisorderedProducerPositions' WHEN fault = 6 THEN 'MisorderedGaps' WHEN fault = 7 THEN 'OverlappingGaps' WHEN n > 0 AND fault = 8 THEN 'ObservationInsideGap' END AS violation FROM ({ENVELOPES})""")
def envelope_violation(spark, d):
    o = model.sized_frames(spark, d).select("seq", F.col("n_obs").cast("int").alias("n"), ((F.col("seq") - 1) % 11).alias("fault"))
    at, n = F.col("fault"), F.col("n")
    mode = F.when(at == 1, "interval").otherwise("sampled")

    def one(k):
        position = F.struct(F.lit(1).alias("epoch"), F.when(at == 5, 100 - k).otherwise(10 + k).alias("sequence"))
        return F.struct(
            F.when((at == 3) & (k > 0), 0).otherwise(k).alias("id"),
            F.when(~((at == 4) & (k > 0)), position).alias("position"),
            F.when(at == 2, F.struct(F.lit(0).alias("s"), F.lit(1).alias("e"))).alias("interval"),
        )

    obs = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), one)

    def gap(a, b, e=1):
        return F.struct(F.lit(e).alias("epoch"), F.lit(a).alias("start"), F.lit(b).alias("end"))

    gaps = F.when(at == 6, F.array(gap(900, 950), gap(800, 850))).when(at == 7, F.array(gap(800, 850), gap(840, 900))).when(at == 8, F.array(gap(0, 5), gap(10, 12))).when(at == 10, F.array_repeat(gap(800, 850), 70)).otherwise(F.filter(F.array(gap(0, 1)), lambda g: g["start"] > 0))
    e = o.select("seq", mode.alias("mode"), obs.alias("observations"), gaps.alias("gaps"))
    return e.select("seq", validation.envelope_violation(F.col("mode"), F.col("observations"), F.col("gaps"), 6, 64).alias("violation"))


@query("SELECT event_id, CASE WHEN done < started THEN 'CaptureRunEndsBeforeStart' WHEN event_id % 13 = 0 THEN 'EndpointSystemMismatch' WHEN event_id % 17 = 0 THEN 'RunEndpointMismatch' WHEN event_id % 19 = 0 THEN 'SnapshotRunMismatch' END AS violation FROM (SELECT event_id, ts AS started, ts + (event_id % 7 - 1) * INTERVAL 1 SECOND AS done FROM events)")
def lifecycle_violation(spark, d):
    i = F.col("event_id")
    t = model.table(spark, d, "events").select("event_id", F.col("ts").alias("started"), (F.col("ts") + F.make_dt_interval(secs=(i % 7 - 1))).alias("done"))
    links = [(F.when(i % n == 0, -1).otherwise(i), i, name) for n, name in ((13, "EndpointSystemMismatch"), (17, "RunEndpointMismatch"), (19, "SnapshotRunMismatch"))]
    return t.select("event_id", validation.lifecycle_violation(F.col("started"), F.col("done"), links).alias("violation"))


@query(f"SELECT seq, count(DISTINCT tag) = count(*) AS unique_ids FROM {OBS} GROUP BY seq")
def unique_evidence(spark, d):
    o = model.observations(spark, d).groupBy("seq").agg(F.collect_list("tag").alias("ids"))
    return o.select("seq", validation.unique_ids(F.col("ids")).alias("unique_ids"))


@query("SELECT event_id, CAST(CAST(value AS BIT) AS BIGINT) AS bits FROM events")
def value_bits(spark, d):
    return model.table(spark, d, "events").select("event_id", S.real_bits(F.col("value")).alias("bits"))


@query("SELECT bits, value_class FROM (SELECT DISTINCT (event_id % 1000 - 500) * 18000000000000000 AS bits, CASE WHEN event_id % 1000 < 500 THEN 'negative' ELSE 'positive' END AS value_class FROM events) ORDER BY xor(bits, CAST(-9223372036854775808 AS BIGINT))")
def real_bits_order(spark, d):
    i = F.col("event_id") % 1000
    t = model.table(spark, d, "events").select(((i - 500) * 18_000_000_000_000_000).alias("bits"), F.when(i < 500, "negative").otherwise("positive").alias("value_class")).distinct()
    return t.orderBy(S.real_order(F.col("bits")))


@query("SELECT event_id, name, CASE WHEN regexp_full_match(name, 'generation-[0-9]{20}\\.journal') THEN CAST(substr(name, 12, 20) AS BIGINT) END AS generation FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'generation-' || event_id || '.journal' ELSE 'generation-' || lpad(CAST(event_id AS VARCHAR), 20, '0') || '.journal' END AS name FROM events)")
def generation_names(spark, d):
    i = F.col("event_id")
    t = model.table(spark, d, "events").select("event_id", F.when(i % 4 == 0, F.concat(F.lit("generation-"), i.cast("string"), F.lit(".journal"))).otherwise(generations.file_name(i)).alias("name"))
    return t.select("event_id", "name", generations.parse_name(F.col("name")).alias("generation"))


@query("SELECT event_type, min(value) AS low, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.95) AS p95, max(value) AS high FROM events GROUP BY 1")
def value_summary(spark, d):
    return model.table(spark, d, "events").groupBy("event_type").agg(F.min("value").alias("low"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("median"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), F.max("value").alias("high"))


@query("SELECT event_id + 1 AS seq, sha256(props) AS digest FROM events")
def content_digest(spark, d):
    return model.table(spark, d, "events").select((F.col("event_id") + 1).alias("seq"), F.sha2("props", 256).alias("digest"))


@query("""WITH s AS (SELECT user_id AS store, event_id AS generation, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events WHERE event_id % 3 <> 0)
SELECT store, generation, CASE WHEN g IS NULL THEN 'first' WHEN generation = g + 1 THEN 'next' ELSE 'skipped' END AS progress FROM s""")
def reference_progress(spark, d):
    e = model.table(spark, d, "events").where("event_id % 3 <> 0").select(F.col("user_id").alias("store"), F.col("event_id").alias("generation"))
    return generations.progress(e, "store")


@query("SELECT user_id AS store, max(event_id) AS generation, max_by(value, event_id) AS cutoff, CASE WHEN count(*) = 1 AND max(event_id) <> 1 THEN 'missing_slot' WHEN count(*) = 2 AND max(event_id) <> min(event_id) + 1 THEN 'not_consecutive' ELSE 'current' END AS verdict FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 2) GROUP BY 1")
def manifest_select(spark, d):
    e = model.table(spark, d, "events").select(F.col("user_id").alias("store"), F.col("event_id").alias("generation"), F.col("value").alias("cutoff"), F.lit(True).alias("sound"))
    slots = e.withColumn("r", F.row_number().over(W.partitionBy("store").orderBy(F.desc("generation")))).where("r <= 2")
    return recovery.current_manifest(slots, ["store"]).select("store", "generation", "cutoff", "verdict")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 1000 WHEN 'view' THEN 1000 - 200 ELSE 1000 - 200 - 300 END AS ceiling, event_id % 1100 + 50 <= CASE event_type WHEN 'click' THEN 1000 WHEN 'view' THEN 1000 - 200 ELSE 1000 - 200 - 300 END AS fits FROM events")
def priority_ceiling(spark, d):
    e = model.table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "click", "protected").when(F.col("event_type") == "view", "normal").otherwise("bulk").alias("priority"), (F.col("event_id") % 1100 + 50).alias("bytes"))
    ceiling = retry.byte_ceiling(F.col("priority"), 1000, 200, 300)
    return e.select("event_id", ceiling.alias("ceiling"), (F.col("bytes") <= ceiling).alias("fits"))


# ---- lookups


DECLARATIONS = "(SELECT c_custkey AS series, r AS revision, CASE WHEN r = 1 THEN c_mktsegment ELSE 'revised' END AS payload FROM customer, (SELECT unnest([1, 2]) AS r) WHERE r = 1 OR c_custkey % 3 = 0)"
CLAIMS = "(SELECT o_orderkey + 1 AS seq, o_custkey AS series, CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END AS revision, CASE WHEN o_orderkey % 10 = 9 THEN 'other' ELSE c_mktsegment END AS payload FROM orders JOIN customer ON c_custkey = o_custkey)"


def _declarations(spark, d):
    c = model.table(spark, d, "customer")
    r = c.select(F.col("c_custkey").alias("series"), "c_mktsegment", F.explode(F.array(F.lit(1), F.lit(2))).alias("revision")).where("revision = 1 OR series % 3 = 0")
    return r.select("series", "revision", F.when(F.col("revision") == 1, F.col("c_mktsegment")).otherwise("revised").alias("payload"))


def _claims(spark, d):
    c = model.table(spark, d, "customer").select(F.col("c_custkey").alias("series"), "c_mktsegment")
    k = F.col("seq") - 1
    return model.frames(spark, d).join(c, "series").select("seq", "series", F.when(k % 4 == 0, 2).otherwise(1).alias("revision"), F.when(k % 10 == 9, "other").otherwise(F.col("c_mktsegment")).alias("payload"))


@query(f"SELECT seq, c.series, c.revision, d.payload FROM {CLAIMS} c LEFT JOIN {DECLARATIONS} d ON c.series = d.series AND c.revision = d.revision")
def declaration_resolve(spark, d):
    return lookups.resolve(_claims(spark, d).drop("payload"), _declarations(spark, d)).select("seq", "series", "revision", "payload")

@query(f"""WITH f AS (SELECT seq, series, len, (seq - 1) // 50 + 1 AS g, CASE WHEN seq % 160 = 1 THEN 2 ELSE 1 END AS revision FROM {FRAMES}),
c AS (SELECT g, min(seq) - 1 AS lo, max(seq) - CASE WHEN g % 7 = 1 THEN 1 ELSE 0 END AS hi, 28 + sum(len) + CASE WHEN g % 7 = 2 THEN 1 ELSE 0 END AS bytes FROM f GROUP BY g HAVING g % 7 <> 5),
p AS (SELECT * FROM f WHERE NOT (g % 7 = 3 AND seq % 50 = 10) UNION ALL SELECT * FROM f WHERE g % 7 = 4 AND seq % 50 = 20),
a AS (SELECT g, min(seq) AS low, max(seq) AS high, count(*) AS n, count(DISTINCT seq) AS nd, 28 + sum(len) AS bytes, bool_or(d.series IS NULL) AS undeclared FROM p LEFT JOIN {DECLARATIONS} d USING (series, revision) GROUP BY g)
SELECT coalesce(c.g, a.g) AS generation, CASE WHEN c.g IS NULL THEN 'Uncatalogued' WHEN low <= lo OR high > hi THEN 'OutsideRange' WHEN n > nd THEN 'RepeatedSequence' WHEN nd <> hi - lo THEN 'MissingSequence' WHEN a.bytes <> c.bytes THEN 'ByteMismatch' WHEN undeclared THEN 'UndeclaredFrame' END AS problem FROM c FULL JOIN a ON a.g = c.g""")
def sealed_audit(spark, d):
    g, seq = F.col("generation"), F.col("seq")
    f = generations.rotate_by_count(model.sized_frames(spark, d), 50)
    claimed = generations.catalog(f, []).where(g % 7 != 5)
    claimed = claimed.withColumns({"cutoff": F.col("cutoff") - (g % 7 == 1).cast("int"), "bytes": F.col("bytes") + (g % 7 == 2).cast("int")})
    stored = f.where(~((g % 7 == 3) & (seq % 50 == 10))).unionByName(f.where((g % 7 == 4) & (seq % 50 == 20)))
    stored = stored.withColumn("revision", F.when(seq % 160 == 1, 2).otherwise(1))
    known = _declarations(spark, d).select("series", "revision", F.lit(True).alias("declared"))
    stored = stored.join(known, ["series", "revision"], "left").withColumn("declared", F.coalesce("declared", F.lit(False)))
    return generations.audit_sealed(stored.select("generation", "seq", "len", "declared"), claimed)


@query(f"SELECT CASE WHEN n_obs > 0 THEN 'observed' ELSE 'no_change' END AS kind, count(*) AS frames, CAST(sum(n_obs) AS BIGINT) AS observations FROM {FRAMES} GROUP BY 1")
def evidence_kinds(spark, d):
    return admission.by_kind(model.sized_frames(spark, d)).select("kind", "frames", "observations")


@query("SELECT event_id, CASE WHEN event_id % 9 - 3 >= event_id % 4 THEN 'EmptyGap' END AS refusal, CASE WHEN event_id % 6 > 0 THEN event_id % 6 END AS revision, event_id * 700 % 1500000000 < 1000000000 AS time_valid FROM events")
def constructed_values(spark, d):
    i = F.col("event_id")
    return model.table(spark, d, "events").select("event_id", validation.gap_refusal(i % 9 - 3, i % 4).alias("refusal"), S.nonzero(i % 6).alias("revision"), S.time_valid(i * 700 % 1_500_000_000).alias("time_valid"))


# Registered events as claimed revisions of their series: which of them follow the one before
@query("""WITH r AS (SELECT user_id AS series, event_id AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS revision FROM events)
SELECT series, n, revision, CASE WHEN lag(revision) OVER w IS NULL AND revision <> 1 THEN 'BadFirst' WHEN revision <> lag(revision) OVER w + 1 THEN 'RevisionGap' END AS violation FROM r WINDOW w AS (PARTITION BY series ORDER BY n)""")
def declaration_chain(spark, d):
    e = model.table(spark, d, "events")
    at = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    claimed = e.select(F.col("user_id").alias("series"), F.col("event_id").alias("n"), (at + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)).cast("long").alias("revision"))
    return registry.chain(claimed).select("series", "n", "revision", "violation")


@query(f"SELECT series, count(*) AS revisions, string_agg(payload, ',' ORDER BY revision) AS history FROM {DECLARATIONS} GROUP BY series")
def declaration_history(spark, d):
    return registry.history(_declarations(spark, d)).select("series", F.size("history").cast("long").alias("revisions"), F.array_join(F.col("history.payload"), ",").alias("history"))


@query("SELECT series, true AS placed, false AS seen FROM (SELECT o_custkey AS series FROM orders EXCEPT SELECT user_id FROM events) UNION ALL SELECT series, true, true FROM (SELECT o_custkey AS series FROM orders INTERSECT SELECT user_id FROM events) UNION ALL SELECT series, false, true FROM (SELECT user_id AS series FROM events EXCEPT SELECT o_custkey FROM orders)")
def series_by_table(spark, d):
    """UNION, INTERSECT and EXCEPT of the series of both tables of frames."""
    f, e = model.frames(spark, d).select("series"), model.event_observations(spark, d).select("series")
    parts = ((f.subtract(e), True, False), (f.intersect(e), True, True), (e.subtract(f), False, True))
    one, two, three = (p.select("series", F.lit(a).alias("placed"), F.lit(b).alias("seen")) for p, a, b in parts)
    return one.union(two).union(three)


@query(f"SELECT seq FROM {CLAIMS} c WHERE EXISTS (SELECT 1 FROM {DECLARATIONS} d WHERE c.series = d.series AND c.revision = d.revision AND c.payload IS NOT DISTINCT FROM d.payload)")
def declared_frames(spark, d):
    return lookups.declared(_claims(spark, d), _declarations(spark, d), ["payload"]).select("seq")


@query(f"SELECT seq, series, revision FROM {CLAIMS} c WHERE NOT EXISTS (SELECT 1 FROM {DECLARATIONS} d WHERE c.series = d.series AND c.revision = d.revision)")
def undeclared_frames(spark, d):
    return lookups.undeclared(_claims(spark, d), _declarations(spark, d)).select("seq", "series", "revision")


@query("SELECT event_id + 1 AS seq, user_id AS series, gap_start FROM events JOIN (SELECT user_id AS u, event_id AS gap_start, event_id + 40 AS gap_end FROM events WHERE event_id % 97 = 0) ON u = user_id AND event_id >= gap_start AND event_id < gap_end QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY gap_start DESC) = 1")
def obs_inside_gap(spark, d):
    e = model.event_observations(spark, d)
    gaps = e.where((F.col("seq") - 1) % 97 == 0).select("series", (F.col("seq") - 1).alias("gap_start"), (F.col("seq") + 39).alias("gap_end"))
    return lookups.inside_gap(e.select("series", (F.col("seq") - 1).alias("position"), "seq"), gaps, ["series"]).select("seq", "series", "gap_start")


@query(f"SELECT seq, ordinal, NOT (seq % 13 = 0 AND ordinal = 1) AND NOT (seq % 17 = 0 AND ordinal = 2) AS links_ok FROM {OBS}")
def observation_lineage(spark, d):
    o = model.observations(spark, d).select("seq", "ordinal", (F.col("seq") * 1000 + F.col("ordinal")).alias("id"))
    wrong = (F.col("seq") % 13 == 0) & (F.col("ordinal") == 1)
    link = F.struct(F.col("ordinal"), F.when(wrong, F.lit(-1)).otherwise(F.col("id")).alias("observation"), (F.col("id") * 2).alias("raw"), F.when((F.col("seq") % 17 == 0) & (F.col("ordinal") == 2), F.lit(0)).otherwise(F.col("id") * 2).alias("normalized_raw"))
    packed = o.select("seq", F.struct("ordinal", "id", link.alias("link")).alias("r")).groupBy("seq").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return lookups.lineage_links(packed.select("seq", F.col("r.id").alias("observations"), F.col("r.link").alias("lineage")))


# ---- latest and retry


@query("SELECT series, epoch, sequence, value FROM (SELECT user_id AS series, event_id // 300 AS epoch, (event_id * 7919) % 300 AS sequence, value, event_id FROM events WHERE event_id % 5 <> 0) QUALIFY row_number() OVER (PARTITION BY series ORDER BY epoch DESC, sequence DESC, event_id DESC) = 1")
def latest_by_position(spark, d):
    i = F.col("seq") - 1
    e = model.event_observations(spark, d).select("series", F.when(i % 5 != 0, F.floor(i / 300)).alias("epoch"), ((i * 7919) % 300).alias("sequence"), "value", i.alias("event_id"))
    return latest.latest(e, ["epoch", "sequence", "event_id"]).select("series", "epoch", "sequence", "value")


@query("SELECT series, position, count(*) AS n FROM (SELECT user_id AS series, event_id // 40 AS position, event_type, value FROM events) GROUP BY 1, 2 HAVING count(DISTINCT event_type) > 1")
def latest_conflicts(spark, d):
    e = model.event_observations(spark, d).select("series", F.floor((F.col("seq") - 1) / 40).alias("position"), "state")
    return latest.conflicts(e, ["position"], ["state"]).select("series", "position", "n")


@query("SELECT a.event_id AS l, b.event_id AS r, CASE WHEN a.user_id <> b.user_id OR a.value <> b.value THEN 'distinct' WHEN a.event_type = b.event_type THEN 'equivalent' ELSE 'conflict' END AS class FROM (SELECT event_id, user_id % 3 AS user_id, floor(value / 100) AS value, event_type FROM events) a JOIN (SELECT event_id, user_id % 3 AS user_id, floor(value / 100) AS value, event_type FROM events) b ON b.event_id = a.event_id + 1")
def retry_classify(spark, d):
    e = model.table(spark, d, "events").select("event_id", F.struct((F.col("user_id") % 3).alias("scope"), F.floor(F.col("value") / 100).alias("key"), F.col("event_type").alias("content")).alias("q"))
    a, b = e.select(F.col("event_id").alias("l"), F.col("q").alias("a"), (F.col("event_id") + 1).alias("r")), e.select(F.col("event_id").alias("r"), F.col("q").alias("b"))
    return a.join(b, "r").select("l", "r", retry.classify("a", "b").alias("class"))


@query(f"SELECT store, store_seq, CASE WHEN last - store_seq < 20 THEN 'replay' WHEN last - store_seq < 50 THEN 'guard' ELSE 'fresh' END AS tier FROM (SELECT store, store_seq, max(store_seq) OVER (PARTITION BY store) AS last FROM {STORE})")
def retry_tiers(spark, d):
    f = model.store_frames(spark, d).select("store", "store_seq")
    return retry.tiers(f, f.groupBy("store").agg(F.max("store_seq").alias("last")), 20, 30).select("store", "store_seq", "tier")


def submissions(spark: SparkSession, d: str) -> DataFrame:
    """Events as submissions: stores are users modulo 8; keys and contents repeat."""
    i = F.col("event_id")
    return model.table(spark, d, "events").select((F.col("user_id") % 8).alias("store"), i.alias("n"), F.col("user_id").alias("scope"), F.concat(F.lit("k"), F.floor(F.col("value") % 9).cast("string")).alias("key"), F.when(i % 11 == 0, "other").otherwise("same").alias("content"))


@query("""SELECT event_id AS n, CASE WHEN event_id = f THEN 'queued' WHEN c = fc THEN 'coalesced' ELSE 'conflict' END AS disposition, CASE WHEN event_id = f OR c = fc THEN f END AS receipt
FROM (SELECT event_id, c, first_value(event_id) OVER w AS f, first_value(c) OVER w AS fc FROM (SELECT event_id, user_id, 'k' || CAST(CAST(floor(value % 9) AS BIGINT) AS VARCHAR) AS k, CASE WHEN event_id % 11 = 0 THEN 'other' ELSE 'same' END AS c FROM events) WINDOW w AS (PARTITION BY event_id // 5000, user_id, k ORDER BY event_id))""")
def coalesced_submissions(spark, d):
    s = submissions(spark, d).withColumn("batch", F.floor(F.col("n") / 5000))
    return retry.coalesce(s, ["store", "batch"]).select("n", "disposition", "receipt")


@query()
def transition_check(spark, d):
    """Claimed outcomes of which some are wrong and some absent."""
    s = submissions(spark, d)
    claimed = retry.run_submissions(s, 12, 12).where("n % 103 <> 0").withColumn("seq", F.col("seq") + (F.col("n") % 101 == 0).cast("int"))
    return retry.transition_faults(s, claimed, 12, 12)


@query()
def retry_script(spark, d):
    return retry.run_submissions(submissions(spark, d), 12, 12)


@query("SELECT series, epoch, sequence, value FROM (SELECT user_id AS series, event_id // 300 AS epoch, event_id % 300 AS sequence, value FROM events) WHERE series = 7 ORDER BY epoch DESC, sequence DESC LIMIT 1")
def latest_get(spark, d):
    i = F.col("seq") - 1
    e = model.event_observations(spark, d).where(F.col("series") == SERIES).select("series", F.floor(i / 300).alias("epoch"), (i % 300).alias("sequence"), "value")
    return latest.latest(e, ["epoch", "sequence"])


# ---- registry


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Orders as requests on their customers: the key decides operation, expectation and payload."""
    k = F.col("seq") - 1
    op = F.when(k % 9 == 0, "retire").when(k % 3 == 0, "register").otherwise("revise")
    return model.frames(spark, d).select("series", F.col("seq").alias("n"), op.alias("op"), F.lit("b").alias("binding"), (1 + F.floor(k / 5) % 3).alias("expected"), F.concat(F.lit("p"), (k % 4).cast("string")).alias("payload"), F.concat(F.lit("e"), (k % 2).cast("string")).alias("evidence"))


@query()
def registry_lifecycle(spark, d):
    return registry.run_requests(requests(spark, d))


@query()
def registry_snapshot(spark, d):
    return registry.snapshot(registry_lifecycle(spark, d))


@query()
def registry_capacity(spark, d):
    """A registry of 90 series and 110 revisions."""
    return registry.run_within(requests(spark, d), 90, 110)


@query(f"SELECT count(DISTINCT series) AS series_count, count(*) AS revision_count FROM {DECLARATIONS}")
def registry_counts(spark, d):
    return registry.counts(_declarations(spark, d))


@query(f"SELECT series, max(revision) AS revision, max_by(payload, revision) AS payload FROM {DECLARATIONS} GROUP BY series")
def latest_declarations(spark, d):
    return registry.latest_declarations(_declarations(spark, d))


REGISTRY_SQL = "(SELECT c_custkey AS series, CASE c_custkey % 3 WHEN 0 THEN 'sampled' WHEN 1 THEN 'event' ELSE 'interval' END AS mode, CASE c_custkey % 2 WHEN 0 THEN 'real' ELSE 'state' END AS family, c_custkey % 10 = 0 AS retired FROM customer WHERE c_custkey % 7 <> 0)"


@query(f"SELECT seq, e.series, CASE WHEN r.series IS NULL THEN 'SeriesNotFound' WHEN retired THEN 'SeriesRetired' WHEN e.mode <> r.mode THEN 'SeriesMetadataMismatch' WHEN kind <> family AND kind <> 'unavailable' THEN 'ObservationValueFamilyMismatch' END AS refusal FROM (SELECT o_orderkey + 1 AS seq, o_custkey AS series, CASE o_custkey % 3 WHEN 0 THEN 'sampled' WHEN 1 THEN 'event' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'interval' ELSE 'sampled' END END AS mode, CASE o_orderkey % 3 WHEN 0 THEN 'real' WHEN 1 THEN 'state' ELSE 'unavailable' END AS kind FROM orders) e LEFT JOIN {REGISTRY_SQL} r ON r.series = e.series")
def bind_check(spark, d):
    c = F.col("c_custkey")
    reg = model.table(spark, d, "customer").where(c % 7 != 0).select(c.alias("series"), F.when(c % 3 == 0, "sampled").when(c % 3 == 1, "event").otherwise("interval").alias("mode"), F.when(c % 2 == 0, "real").otherwise("state").alias("family"), (c % 10 == 0).alias("retired"))
    s, k = F.col("series"), F.col("seq") - 1
    env = model.frames(spark, d).select("seq", "series", F.when(s % 3 == 0, "sampled").when(s % 3 == 1, "event").otherwise(F.when(k % 2 == 0, "interval").otherwise("sampled")).alias("mode"), F.when(k % 3 == 0, "real").when(k % 3 == 1, "state").otherwise("unavailable").alias("kind"))
    return registry.bind(env, reg)


# ---- recovery, blocks, journal


TAIL = "SELECT event_id, event_id % 60 AS suffix_len, event_id % 2 = 0 AS start_ok, event_id % 7 <> 0 AS sequence_ok, event_id % 5 <> 0 AS length_ok, 20 + event_id % 45 AS frame_len, event_id % 3 = 0 AS decode_ok FROM events"


@query(f"""SELECT event_id, CASE WHEN suffix_len = 0 THEN 'Clean' WHEN suffix_len < 20 THEN CASE WHEN start_ok THEN 'ShortFramePrefix' ELSE 'refuse:InvalidLayout' END WHEN NOT sequence_ok THEN 'refuse:SequenceMismatch'
WHEN NOT length_ok THEN CASE WHEN suffix_len = 20 THEN 'InvalidFramePrefix' ELSE 'refuse:InvalidLayout' END WHEN frame_len > suffix_len THEN 'TruncatedDeclaredFrame' WHEN frame_len < suffix_len THEN 'refuse:InvalidLayout' WHEN decode_ok THEN 'refuse:InvalidLayout' ELSE 'InvalidCompleteFrame' END AS class FROM ({TAIL})""")
def recovery_classes(spark, d):
    i = F.col("event_id")
    t = model.table(spark, d, "events").select("event_id", (i % 60).alias("suffix_len"), (i % 2 == 0).alias("start_ok"), (i % 7 != 0).alias("sequence_ok"), (i % 5 != 0).alias("length_ok"), (20 + i % 45).alias("frame_len"), (i % 3 == 0).alias("decode_ok"))
    return t.select("event_id", recovery.tail_class().alias("class"))


@query("SELECT count(*) AS n, max(o_orderkey + 1) AS cutoff FROM orders WHERE o_orderkey + 1 <= 900")
def committed_rows(spark, d):
    return recovery.committed(model.frames(spark, d), 900).agg(F.count("*").alias("n"), F.max("seq").alias("cutoff"))


BOOLS = "SELECT event_id // 64 AS block, list(value > 100 ORDER BY event_id) AS v FROM (SELECT event_id, CASE WHEN (event_id // 64) % 3 = 0 THEN (event_id // 20) * 37 % 200 ELSE value END AS value FROM events) GROUP BY 1"


def _bool_blocks(spark, d):
    e = model.table(spark, d, "events")
    b = F.floor(F.col("event_id") / 64)
    v = F.when(b % 3 == 0, F.floor(F.col("event_id") / 20) * 37 % 200).otherwise(F.col("value"))
    rows = e.select(b.alias("block"), F.struct("event_id", (v > 100).alias("v")).alias("r")).groupBy("block").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return rows.select("block", F.col("r.v").alias("values"))


@query(f"SELECT block, CAST(1 + len(list_filter(range(2, len(v) + 1), lambda i: v[i] <> v[i - 1])) AS BIGINT) AS runs FROM ({BOOLS})")
def bool_run_count(spark, d):
    return blocks.choose(_bool_blocks(spark, d)).select("block", "runs")


@query(f"""WITH x AS (SELECT block, len(v) AS n, 1 + len(list_filter(range(2, len(v) + 1), lambda i: v[i] <> v[i - 1])) AS runs FROM ({BOOLS})), y AS (SELECT block, CAST(runs AS BIGINT) AS runs, n + 16 AS raw, (n + 7) // 8 + 17 AS packed, runs * 3 + 17 AS rle FROM x)
SELECT block, runs, CASE WHEN packed < raw AND packed <= rle THEN 'bitpack' WHEN rle < raw AND rle < packed THEN 'rle' ELSE 'raw' END AS codec, CAST(CASE WHEN packed < raw AND packed <= rle THEN packed WHEN rle < raw AND rle < packed THEN rle ELSE raw END AS BIGINT) AS bytes FROM y""")
def block_codec_choice(spark, d):
    return blocks.choose(_bool_blocks(spark, d))


@query("SELECT event_id + 1 AS seq, CAST(octet_length(encode(props)) + 24 AS BIGINT) AS frame_bytes FROM events")
def frame_lengths(spark, d):
    return model.table(spark, d, "events").select((F.col("event_id") + 1).alias("seq"), journal.frame_length("props").cast("long").alias("frame_bytes"))


@query("SELECT event_id + 1 AS seq, props AS payload FROM events")
def journal_round_trip(spark, d):
    """Frames written and scanned again: every payload comes back."""
    e = model.table(spark, d, "events").select((F.col("event_id") + 1).alias("seq"), F.col("props").alias("payload"))
    f = journal.encode_frames(e)
    files = f.select(F.col("seq").cast("string").alias("path"), F.col("frame").alias("content"))
    return journal.scan(files).where("seq IS NOT NULL").select("seq", F.col("payload").cast("string").alias("payload"))


# ---- extensions


@query(f"SELECT series, seq, rank FROM (SELECT series, seq, CAST(row_number() OVER (PARTITION BY series ORDER BY effective DESC, seq DESC) AS INTEGER) AS rank FROM {EVENTS}) WHERE rank <= 3")
def x_recent_of_each(spark, d):
    return recent.recent_of_each(model.event_observations(spark, d), 3).select("series", "seq", "rank")


@query("SELECT r_name, n_name, count(*) AS n, grouping(r_name) AS g1, grouping(n_name) AS g2 FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)")
def x_rollup(spark, d):
    j = model.table(spark, d, "customer").join(model.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(model.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.grouping("r_name").cast("long").alias("g1"), F.grouping("n_name").cast("long").alias("g2"))


@query("SELECT user_id AS series, time_bucket(INTERVAL '1 hour', ts) AS hour, count(*) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2")
def x_hourly(spark, d):
    e = model.event_observations(spark, d)
    return e.groupBy("series", F.date_trunc("hour", "effective").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("WITH s AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL '6 hours' THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), t AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s) SELECT user_id AS series, CAST(k AS BIGINT) AS session, count(*) AS n, min(ts) AS first, max(ts) AS last FROM t GROUP BY 1, 2")
def x_sessions(spark, d):
    w = W.partitionBy("series").orderBy("effective")
    e = model.event_observations(spark, d)
    gap = F.lag("effective").over(w)
    b = e.withColumn("b", F.when(gap.isNull() | (F.col("effective") - gap > F.expr("INTERVAL '6' HOUR")), 1).otherwise(0)).withColumn("session", F.sum("b").over(w))
    return b.groupBy("series", "session").agg(F.count("*").alias("n"), F.min("effective").alias("first"), F.max("effective").alias("last"))


@query("SELECT c_custkey AS series FROM customer EXCEPT SELECT o_custkey FROM orders")
def x_silent_series(spark, d):
    return model.table(spark, d, "customer").select(F.col("c_custkey").alias("series")).exceptAll(model.frames(spark, d).select("series").distinct())


@query("SELECT e.event_id AS event, o.o_orderkey AS order_key FROM events e ASOF JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) = 1) o ON o.o_custkey = e.user_id AND o.o_orderdate + INTERVAL '9000 days' <= e.ts + INTERVAL '6000 days'")
def x_as_of(spark, d):
    """Each event's last order of the same id not later (on shifted clocks): one pass over both, sorted."""
    e = model.table(spark, d, "events").select(F.col("user_id").alias("k"), (F.col("ts") + F.expr("INTERVAL '6000' DAY")).alias("t"), "event_id", F.lit(None).cast("long").alias("o"))
    o = model.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderdate") + F.expr("INTERVAL '9000' DAY")).alias("t"), F.lit(None).cast("long").alias("event_id"), F.col("o_orderkey").alias("o"))
    w = W.partitionBy("k").orderBy("t", F.col("o").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    return e.union(o).withColumn("last", F.last("o", ignorenulls=True).over(w)).where("event_id IS NOT NULL AND last IS NOT NULL").select(F.col("event_id").alias("event"), F.col("last").alias("order_key"))
