"""State machines against small programs written independently of them, and stream against batch."""

import random

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import pytest

from chronolith.operators import recent, registry, retry
from chronolith.plans import catalog
from chronolith.sources import journal
from chronolith.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_retry_script_equals_list_scan(spark):
    rows = catalog.submissions(spark, SF).orderBy("store", "n").collect()
    got = {r["n"]: (r["outcome"], r["seq"]) for r in catalog.QUERIES["retry_script"](spark, SF).collect()}
    accepted, n_of = {}, {}
    for r in rows:
        done = accepted.setdefault(r["store"], [])
        recent_first = done[::-1]
        hit = next(((age, c, s) for age, (k, c, s) in enumerate(recent_first) if k == (r["scope"], r["key"])), None)
        if hit and hit[0] < 24:
            want = ("conflict", 0) if hit[1] != r["content"] else ("replayed", hit[2]) if hit[0] < 12 else ("expired", 0)
        else:
            done.append(((r["scope"], r["key"]), r["content"], len(done) + 1))
            want = ("accepted", len(done))
        n_of[r["n"]] = want
    assert got == n_of
    assert {o for o, _ in got.values()} == {"accepted", "replayed", "conflict", "expired"}


def test_registry_script():
    h = registry.History()
    ask = lambda op, expected=0, payload="p", evidence="e", binding="b": h.apply(op, binding, expected, payload, evidence)
    assert ask("revise", 1) == ("SeriesNotFound", 0)
    assert ask("retire", 1) == ("SeriesNotFound", 0)
    assert ask("register") == ("registered", 1)
    assert ask("register") == ("replayed", 1)
    assert ask("register", payload="q") == ("SeriesAlreadyRegistered", 0)
    assert ask("revise", 2, "q") == ("StaleDeclarationRevision", 0)
    assert ask("revise", 1, "p") == ("DeclarationUnchanged", 0)
    assert ask("revise", 1, "q") == ("revised", 2)
    assert ask("revise", 1, "q") == ("replayed", 2)
    assert ask("revise", 1, "r") == ("StaleDeclarationRevision", 0)
    assert ask("register") == ("SeriesAlreadyRegistered", 0)
    assert ask("retire", 1) == ("StaleDeclarationRevision", 0)
    assert ask("retire", 2, evidence="x") == ("retired", 2)
    assert ask("retire", 2, evidence="x") == ("replayed", 2)
    assert ask("retire", 2, evidence="y") == ("SeriesRetired", 0)
    assert ask("revise", 2, "z") == ("SeriesRetired", 0)
    assert ask("register") == ("SeriesRetired", 0)


def test_registry_snapshot_counts(spark):
    out = catalog.QUERIES["registry_lifecycle"](spark, SF).toPandas()
    snap = catalog.QUERIES["registry_snapshot"](spark, SF).toPandas()
    done = out[out.outcome.isin(["registered", "revised"])].groupby("series").size()
    assert dict(zip(snap.series, snap.revisions)) == done.to_dict()


def registry_program(rows, most_series=10**9, most_revisions=10**9):
    """All requests one after another, in one registry."""
    known, out, total = {}, {}, 0
    for r in sorted(rows, key=lambda r: r["n"]):
        s, said = known.get(r["series"]), (r["payload"], r["evidence"])
        now = len(s["said"]) if s else 0
        if r["op"] == "register" and not s:
            if len(known) >= most_series:
                got = ("RegistrySeriesCapacityExceeded", 0)
            elif total >= most_revisions:
                got = ("RegistryRevisionCapacityExceeded", 0)
            else:
                known[r["series"]] = {"binding": r["binding"], "said": [said], "end": None}
                total, got = total + 1, ("registered", 1)
        elif not s:
            got = ("SeriesNotFound", 0)
        elif s["end"]:
            again = r["op"] == "retire" and s["end"] == (r["expected"], r["evidence"])
            got = ("replayed", now) if again else ("SeriesRetired", 0)
        elif r["op"] == "register":
            got = ("replayed", 1) if s["said"] == [said] and s["binding"] == r["binding"] else ("SeriesAlreadyRegistered", 0)
        elif r["op"] == "revise" and now > 1 and r["expected"] == now - 1 and s["said"][-1] == said:
            got = ("replayed", now)
        elif r["expected"] != now:
            got = ("StaleDeclarationRevision", 0)
        elif r["op"] == "retire":
            s["end"] = (r["expected"], r["evidence"])
            got = ("retired", now)
        elif s["said"][-1][0] == r["payload"]:
            got = ("DeclarationUnchanged", 0)
        elif total >= most_revisions:
            got = ("RegistryRevisionCapacityExceeded", 0)
        else:
            s["said"].append(said)
            total, got = total + 1, ("revised", now + 1)
        out[r["n"]] = got
    return out, known


def _outcomes(df):
    return {r["n"]: (r["outcome"], r["revision"]) for r in df.collect()}


def test_registry_equals_one_program(spark):
    asked = catalog.requests(spark, SF).collect()
    want, known = registry_program(asked)
    assert _outcomes(catalog.QUERIES["registry_lifecycle"](spark, SF)) == want
    assert {"registered", "revised", "retired", "replayed", "SeriesNotFound", "SeriesRetired", "SeriesAlreadyRegistered", "StaleDeclarationRevision", "DeclarationUnchanged"} <= {o for o, _ in want.values()}
    snap = {r["series"]: (r["revisions"], r["payload"], r["retired"]) for r in catalog.QUERIES["registry_snapshot"](spark, SF).collect()}
    assert snap == {k: (len(s["said"]), s["said"][-1][0], s["end"] is not None) for k, s in known.items()}


@pytest.mark.parametrize("series, revisions", [(90, 110), (20, 40), (40, 20), (30, 30), (0, 5), (5, 0), (10**6, 10**6)])
def test_registry_capacity(spark, series, revisions):
    requests = catalog.requests(spark, SF)
    want, _ = registry_program(requests.collect(), series, revisions)
    assert _outcomes(registry.run_within(requests, series, revisions)) == want


def test_real_bits_come_in_order(spark):
    bits = [r["bits"] for r in catalog.QUERIES["real_bits_order"](spark, SF).collect()]
    assert bits == sorted(bits, key=lambda b: b % 2**64) and len(bits) == len(set(bits)) > 16


def test_real_bits(spark):
    import struct

    from chronolith.functions import scalars

    values = [0.0, -0.0, 1.5, -2.25, float("inf"), float("-inf"), float("nan"), 5e-324, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r["bits"] for r in df.select(scalars.real_bits(F.col("v")).alias("bits")).collect()]
    assert got == [None if v is None else struct.unpack("<q", struct.pack("<d", v))[0] for v in values]


def test_transition_faults(spark):
    n = {r["n"] for r in catalog.submissions(spark, SF).collect()}
    got = [r["n"] for r in catalog.QUERIES["transition_check"](spark, SF).collect()]
    assert sorted(got) == sorted(k for k in n if k % 103 == 0 or k % 101 == 0) and got


def test_coalescing_of_nulls_and_ties(spark):
    rows = [(1, 1, None, None, "a"), (1, 2, None, None, "a"), (1, 3, None, None, "b"), (1, 4, None, "k", None), (1, 5, None, "k", None), (2, 6, None, None, "b")]
    s = spark.createDataFrame(rows, "store int, n int, scope string, key string, content string")
    got = {r["n"]: (r["disposition"], r["receipt"]) for r in retry.coalesce(s, ["store"]).collect()}
    assert got == {1: ("queued", 1), 2: ("coalesced", 1), 3: ("conflict", None), 4: ("queued", 4), 5: ("coalesced", 4), 6: ("queued", 6)}


@pytest.mark.parametrize("limit", [0, 17, -1, True, 1.5])
def test_limits_refused(spark, limit):
    with pytest.raises(ValueError):
        recent.recent(spark.range(1), 1, limit)


def test_crc32c_check_value(spark):
    assert journal.crc32c(b"123456789") == 0xE3069283
    df = spark.createDataFrame([(b"123456789",), (None,)], "b binary").select(journal.crc32c_column("b").alias("c"))
    assert [r["c"] for r in df.collect()] == [0xE3069283, None]


def test_journal_tail_and_damage():
    frames = [journal.encode(i, b"x" * i) for i in range(1, 5)]
    data = b"".join(frames)
    assert [s for _, s, _ in journal.decode(data)[0]] == [1, 2, 3, 4]
    assert journal.decode(data[:-1]) == (journal.decode(b"".join(frames[:3]))[0], len(b"".join(frames[:3])))
    broken = bytearray(data)
    broken[len(frames[0]) + 21] ^= 1
    assert len(journal.decode(bytes(broken))[0]) == 1
    assert journal.decode(frames[0] + frames[2])[1] == len(frames[0])
    assert journal.decode(b"") == ([], 0)


def test_checksums_side_by_side(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(journal, "PIECE", 16)
    parts = [rng.randbytes(n) for n in [0, 1, 3, 15, 16, 17, 31, 32, 33, 300, 0, 9]]
    starts = [sum(map(len, parts[:k])) for k in range(len(parts))]
    got = journal.crc32c_spans(np.frombuffer(b"".join(parts), np.uint8), starts, [len(p) for p in parts])
    assert got.tolist() == [journal.crc32c(p) for p in parts]
    data, bounds = journal.encode_all(list(range(5, 17)), parts)
    frames = [journal.encode(k, p) for k, p in enumerate(parts, 5)]
    assert data.tobytes() == b"".join(frames) and np.diff(bounds).tolist() == [len(f) for f in frames]
    files = [b"", b"".join(frames), frames[0] + frames[1][:-1] + b"?", b"noise" * 9, frames[3] + frames[4] + b"tail"]
    ends = [0, *np.cumsum([len(f) for f in files]).tolist()]
    got = journal.decode_all(b"".join(files), ends)
    assert [[s for _, s, _ in f] for f, _ in got] == [[], list(range(5, 17)), [5], [], [8, 9]]
    assert [p for _, _, p in got[1][0]] == parts and [e for _, e in got] == [0, len(files[1]), len(frames[0]), 0, len(frames[3] + frames[4])]


def test_scan_keeps_batches(spark):
    """A batch of files comes back as one batch, not one a file."""
    frames = journal.encode_frames(spark.range(1, 2001, 1, 1).selectExpr("id AS seq", "cast(id AS string) AS payload"))
    files = frames.selectExpr("cast(seq AS string) AS path", "frame AS content").union(spark.sql("SELECT 'none', cast(NULL AS binary)")).coalesce(1)

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    found = [r["n"] for r in journal.scan(files).mapInArrow(rows, "n long").collect()]
    assert sum(found) == 4001 and len(found) <= 4
    assert {(r["seq"], bytes(r["payload"])) for r in journal.scan(files).where("seq IS NOT NULL").collect()} == {(k, str(k).encode()) for k in range(1, 2001)}


def _as_submissions(spark):
    i = F.col("n")
    s = catalog.submissions(spark, SF)
    return s.select("store", "n", F.col("scope").alias("series"), "key", "content", F.floor(i / 300).alias("epoch"), F.when(i % 5 != 0, i * 7919 % 300).alias("position"), i.cast("double").alias("value"))


def test_stream_equals_one_batch_and_survives_restart(spark, tmp_path):
    rows = _as_submissions(spark)
    for k in range(3):
        rows.where((F.col("n") >= k * 400) & (F.col("n") < (k + 1) * 400)).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    src, out, ck = f"{tmp_path}/stream", f"{tmp_path}/out", f"{tmp_path}/ck"
    import shutil

    def feed(k):
        shutil.copytree(f"{tmp_path}/in/part={k}", f"{src}/f{k}")

    def start():
        s = spark.readStream.schema(ingest.SUBMISSION).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(src)
        return ingest.ingest(s, out, ck, replay=12, guard=12, most_latest=1000)

    feed(0)
    q = start()
    q.processAllAvailable()
    q.stop()
    feed(1)
    feed(2)
    q = start()
    q.processAllAvailable()
    q.stop()
    got = {r["n"]: (r["outcome"], r["seq"]) for r in ingest.committed(spark, out).collect()}
    want = {r["n"]: (r["outcome"], r["seq"]) for r in catalog.QUERIES["retry_script"](spark, SF).collect()}
    assert got == want
    # a batch that was written but not committed isn't seen
    spark.createDataFrame([], ingest.OUTCOME).write.parquet(f"{out}/admissions/batch=99")
    assert ingest.committed(spark, out).count() == len(want)


def test_latest_law():
    m = ingest.Latest(2)
    assert m.publish(1, 1, 5, "a") == "first"
    assert m.publish(1, 1, 6, "b") == "advanced"
    assert m.publish(1, 1, 5, "c") == "ignored"
    assert m.publish(1, 1, 6, "b") == "ignored"
    assert m.publish(1, 1, 6, "x") == "fault:conflict"
    assert m.publish(1, 2, 0, "d") == "advanced"
    assert m.publish(2, None, None, "e") == "unpositioned"
    assert m.publish(2, 0, 0, "e") == "first"
    assert m.publish(3, 0, 0, "e") == "fault:capacity"
