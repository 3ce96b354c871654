"""Run telemetry: sources, batch forms and streaming queries.

Every operator has a batch form on the event table and, where it watches a live
run, a streaming form with a watermark on wall time.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.sums import steady_avg
from ..plans.groups import Group, _starts
from ..plans.timeline import CHUNK_MS, fill, prev, row_no, scan, settle

EVENT = "session long, seq long, t_wall timestamp, ms double, stage string, type string, decision_type string"
RETAINED = 2000
BLOCK = 64
QUIET_MS = 20000
# The decisions a full run passes through, and those a run may lack.
MILESTONES = (
    "conductor:session_start", "separation_engine:solo_probe", "separation_engine:separation_guided", "separation_engine:separation_skipped",
    "separation_engine:separated", "separation_engine:harmonic_stems_merged", "key_intelligence:key_detected", "quantization:onsets_refined",
    "key_intelligence:key_stability", "key_intelligence:key_from_notes", "quantization:sustain_recovery", "rhythm_engine:meter_grid",
    "rhythm_engine:downbeat_phase", "rhythm_engine:tempo_drift", "epistemic:tempo_resolved", "epistemic:meter_resolved",
    "rhythm_engine:groove_resolved", "quantization:musical_time", "quantization:micro_note_purge", "quantization:rhythm_inference",
    "acoustic_witness:note_support", "acoustic_witness:octave_stack", "acoustic_witness:schoenberg_mirror", "quantization:tie_reconstruction",
    "quantization:trouble_map", "check:form_self_similarity", "quantization:note_consolidation", "scribe_engraver:midi_written",
    "scribe_engraver:musicxml_written", "conductor:intermediate_saved", "conductor:session_end",
)
OPTIONAL = ("separation_engine:solo_probe", "separation_engine:separation_guided", "separation_engine:separation_skipped")


def read_stream(spark: SparkSession, path: str, max_files: int = 100, broken: bool = False, time_format: str | None = None) -> DataFrame:
    """JSON-lines telemetry as a stream; with ``broken``, the lines that are no events, for a quarantine.

    Writers publish files atomically, so the file source never meets a
    half-written last line.
    """
    s = (spark.readStream.schema(EVENT + ", _corrupt string").option("mode", "PERMISSIVE")
         .option("columnNameOfCorruptRecord", "_corrupt").option("maxFilesPerTrigger", max_files))
    s = (s.option("timestampFormat", time_format) if time_format else s).json(path)
    if broken:
        return s.filter("_corrupt is not null or session is null").select(F.coalesce("_corrupt", F.to_json(F.struct(*[c for c in s.columns if c != "_corrupt"]))).alias("line"))
    return s.filter("_corrupt is null and session is not null").drop("_corrupt")


def deduplicated(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """One event per (session, seq), also when a writer repeats itself within the watermark."""
    if events.isStreaming:
        return events.withWatermark("t_wall", delay).dropDuplicatesWithinWatermark(["session", "seq"])
    return events.dropDuplicates(["session", "seq"])


def stage_timings(events: DataFrame) -> DataFrame:
    """Elapsed time of every stage_end since the session's last start of that stage."""
    e = events.filter(F.col("type").isin("stage_start", "stage_end"))
    start = F.when(F.col("type") == "stage_start", F.struct("seq", "t_wall"))
    e = scan(e, ["session", "stage"], ["seq"], {"_s": fill(start)}, 1000.0)
    ms = (F.unix_micros(F.col("t_wall").cast("timestamp")) - F.unix_micros(F.col("_s.t_wall").cast("timestamp"))) / 1000.0
    return e.filter("type = 'stage_end' and _s is not null").select("session", "stage", F.col("_s.seq").alias("start_seq"), F.col("seq").alias("end_seq"), ms.alias("elapsed_ms"))


def stage_timings_stream(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Streaming form: every stage_end against the last start of its stage before it in the session.

    A session's events are numbered from 0 or 1 without gaps, so an event is decided as soon as
    all earlier numbers have been seen, whatever order files arrive in; repeats are passed over.
    A number that never arrives is skipped once the watermark has passed the events behind it.
    The state is the last start of each stage and what waits for a number; ``run_end`` drops it.
    A stage may last as long as it likes.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        due, wait, starts = state.get if state.exists else (-1, [], [])
        rows, begun = {w[0]: tuple(w[1:]) for w in wait}, {g: (q, at) for g, q, at in starts}
        for p in batches:
            at = pd.to_datetime(p["t_wall"]).to_numpy().astype("datetime64[us]").astype("int64")
            rows.update((q, (t, kind, g)) for q, t, kind, g in zip(p["seq"].tolist(), at.tolist(), p["type"].tolist(), p["stage"].tolist()) if q >= due)
        mark, over = state.getCurrentWatermarkMs() * 1000, False
        out = {"session": [], "stage": [], "start_seq": [], "end_seq": [], "elapsed_ms": []}
        for q in sorted(rows):
            t, kind, g = rows[q]
            if not (q == due or (due < 0 and q <= 1) or t < mark):
                break
            del rows[q]
            due = q + 1
            if kind == "stage_start":
                begun[g] = (q, t)
            elif kind == "stage_end" and g in begun:
                for c, v in zip(out, (key[0], g, begun[g][0], q, (t - begun[g][1]) / 1000.0)):
                    out[c].append(v)
            over = over or kind == "run_end"
        if over and not rows:
            if state.exists:
                state.remove()
        else:
            state.update((due, [(q, *r) for q, r in sorted(rows.items())], [(g, *v) for g, v in begun.items()]))
            if rows:
                state.setTimeoutTimestamp(max(min(r[0] for r in rows.values()), mark) // 1000 + 1)
        yield pd.DataFrame(out)

    st = "due bigint, wait array<struct<seq:bigint,at:bigint,type:string,stage:string>>, starts array<struct<stage:string,seq:bigint,at:bigint>>"
    return events.select("session", "stage", "seq", "t_wall", "type").withWatermark("t_wall", delay).groupBy("session").applyInPandasWithState(
        step, "session long, stage string, start_seq long, end_seq long, elapsed_ms double", st, "append", GroupStateTimeout.EventTimeTimeout)


def progress(events: DataFrame, milestones=MILESTONES, optional=OPTIONAL) -> DataFrame:
    """Per session: current stage, decisions, distinct milestones, completed share."""
    needed = [m for m in milestones if m not in optional]
    dec = F.col("type") == "decision"
    name = F.concat_ws(":", "stage", "decision_type")
    return events.groupBy("session").agg(
        F.max_by("stage", F.when(dec, F.col("seq"))).alias("current_stage"), F.count_if(dec).alias("decisions"),
        F.count_distinct(F.when(dec & name.isin(needed), name)).alias("milestones"), F.bool_or(F.col("type") == "run_end").alias("finished"), F.max("t_wall").alias("last_at"),
    ).withColumn("fraction", F.when(F.col("finished"), 1.0).otherwise(F.least(F.lit(1.0), F.col("milestones") / max(len(needed), 1))))


def decisions_per_stage(events: DataFrame) -> DataFrame:
    return events.filter("type = 'decision'").groupBy("session", "stage").agg(F.count(F.lit(1)).alias("decisions"), F.max("t_wall").alias("last_seen"))


def quiet_sessions(progress_rows: DataFrame, now) -> DataFrame:
    """Sessions that reported nothing for more than 20 s and have not finished."""
    silent = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("last_at").cast("timestamp"))) / 1000.0
    return progress_rows.withColumn("silent_ms", silent).filter((~F.col("finished")) & (F.col("silent_ms") > QUIET_MS))


def session_stats(events: DataFrame, retained: int = RETAINED) -> DataFrame:
    """Emitted, retained and evicted events and uptime per session."""
    g = events.groupBy("session").agg(F.count(F.lit(1)).alias("emitted"), F.min("t_wall").alias("first_at"), F.max("t_wall").alias("last_at"))
    up = (F.unix_micros(F.col("last_at").cast("timestamp")) - F.unix_micros(F.col("first_at").cast("timestamp"))) / 1000.0
    return g.select("session", "emitted", F.least("emitted", F.lit(retained)).alias("retained"), F.greatest(F.col("emitted") - retained, F.lit(0)).alias("evicted"), up.alias("uptime_ms"))


def last_events(events: DataFrame, n: int) -> DataFrame:
    """Each session's last n events, by counting positions and comparing with the session's total."""
    total = events.groupBy("session").agg(F.count(F.lit(1)).alias("_t"))
    p = scan(events, ["session"], ["seq"], {"_i": row_no()}, 1000.0)
    return p.join(total, "session").filter(F.col("_i") > F.col("_t") - n).drop("_i", "_t")


def progress_stream(events: DataFrame, milestones=MILESTONES, optional=OPTIONAL) -> DataFrame:
    """Live progress: one updated row per session and batch, and a quiet row when its timer fires."""
    needed = {m for m in milestones if m not in optional}

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        seen, stage, count, done, top = state.get if state.exists else ([], "", 0, False, -1)
        seen, quiet = set(seen), bool(state.hasTimedOut)
        if not quiet:
            for p in batches:
                p = p.sort_values("seq")
                d = p[p["type"] == "decision"]
                count += len(d)
                seen |= set((d["stage"] + ":" + d["decision_type"]).tolist()) & needed
                if len(d) and d["seq"].iloc[-1] > top:
                    stage, top = str(d["stage"].iloc[-1]), int(d["seq"].iloc[-1])
                done = done or bool((p["type"] == "run_end").any())
        state.update((sorted(seen), stage, int(count), bool(done), int(top)))
        if not done:
            state.setTimeoutDuration(QUIET_MS)
        share = 1.0 if done else min(1.0, len(seen) / max(len(needed), 1))
        yield pd.DataFrame({"session": [key[0]], "current_stage": [stage], "decisions": [count], "milestones": [len(seen)], "fraction": [share], "finished": [done], "quiet": [quiet and not done]})

    out = "session long, current_stage string, decisions long, milestones long, fraction double, finished boolean, quiet boolean"
    st = "seen array<string>, stage string, n long, done boolean, top long"
    return events.groupBy("session").applyInPandasWithState(step, out, st, "update", GroupStateTimeout.ProcessingTimeTimeout)


def tee(events: DataFrame, ledger_path: str, live_path: str, checkpoint: str):
    """Write each decision to the ledger and every event to the live table; a replayed batch replaces itself."""

    def both(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        batch.filter("type = 'decision'").write.mode("overwrite").json(f"{ledger_path}/batch={batch_id}")
        batch.write.mode("overwrite").parquet(f"{live_path}/batch={batch_id}")
        batch.unpersist()

    return events.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint)


NOTE = pa.schema([("song_id", pa.int64()), ("stem", pa.string()), ("note_id", pa.int64()), ("pitch", pa.float64()), ("start_ms", pa.float64()), ("end_ms", pa.float64())])
LINE = pa.schema([("song_id", pa.int64()), ("stem", pa.string()), ("line_id", pa.int64()), ("pitch", pa.float64()), ("end_ms", pa.float64())])


def _packed(table: pa.Table) -> bytes:
    """A table as one value of a state."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(values, schema: pa.Schema) -> pa.Table:
    tables = [pa.ipc.open_stream(v).read_all() for v in values]
    return pa.concat_tables(tables).combine_chunks() if tables else schema.empty_table()


class VoiceLines(StatefulProcessor):
    """Open voice lines of a bucket of (song, stem): notes that wait for their chord to close, and lines that may go on.

    Both are tables, written as one value each, so a note costs no call of the state store; a timer stands at
    the time the first waiting chord closes or the last open line is over, and is moved as the watermark passes.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "notes binary")
        self.lines = handle.getValueState("lines", "lines binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, new = None, []
        for p in rows:
            if len(p):
                new.append((_packed(pa.Table.from_pandas(p[NOTE.names], NOTE, preserve_index=False)),))
                first = min([float(p["start_ms"].min())] + ([first] if first is not None else []))
        if first is not None:
            self.waiting.appendList(new)
            self.wake(first + 26.0, timerValues)
        yield self.rows([], [], [], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        from ..operators.lines import _voice_run

        mark = timerValues.getCurrentWatermarkInMs()
        notes = _unpacked([v[0] for v in self.waiting.get()] if self.waiting.exists() else [], NOTE)
        notes = notes.sort_by([(c, "ascending") for c in ("song_id", "stem", "start_ms", "pitch", "note_id")]).combine_chunks()
        held: dict[tuple, list[tuple]] = {}
        if self.lines.exists():
            for x in _unpacked(self.lines.get(), LINE).to_pylist():
                held.setdefault((x["song_id"], x["stem"]), []).append((x["line_id"], x["pitch"], x["end_ms"]))
        arrays = {c: notes[c].to_numpy() for c in ("start_ms", "end_ms", "pitch")}
        arrays["group_ms"] = np.empty(len(notes))
        t, song, stem, name = arrays["start_ms"].tolist(), *(notes[c].to_pylist() for c in ("song_id", "stem", "note_id"))
        cuts = _starts(notes.to_batches()[0], ["song_id", "stem"], None).tolist() + [len(notes)] if len(notes) else []
        left, done, label = np.zeros(len(notes), bool), [], []
        for lo, hi in zip(cuts, cuts[1:]):
            anchor, ready = float("-inf"), hi
            for i in range(lo, hi):
                if t[i] - anchor > 25.0:
                    anchor = t[i]
                    if not anchor + 25.0 < mark:
                        ready = i
                        break
                arrays["group_ms"][i] = anchor
            left[ready:hi] = True
            if ready > lo:
                before = held.get((song[lo], stem[lo]), [])
                labels, leaving = _voice_run(Group(arrays, lo, ready), [list(x[1:]) for x in before], float("-inf"))
                done += range(lo, ready)
                label += [name[lo + a] if a >= 0 else before[~a][0] for a in labels]
                held[song[lo], stem[lo]] = [(name[lo + a] if a >= 0 else before[~a][0], *state) for a, state in leaving]
        # a chord may still close that began 25 ms ago
        lines = [(*k, *x) for k, xs in held.items() for x in xs if x[2] + 326.0 >= mark]
        if left.any():
            self.waiting.put([(_packed(notes.filter(pa.array(left))),)])
        else:
            self.waiting.clear()
        if lines:
            self.lines.update((_packed(pa.table([pa.array(c, f.type) for c, f in zip(zip(*lines), LINE)], LINE)),))
        else:
            self.lines.clear()
        if left.any() or lines:
            self.wake(float(arrays["start_ms"][left].min()) + 26.0 if left.any() else max(x[4] for x in lines) + 327.0, timerValues)
        yield self.rows([song[i] for i in done], [stem[i] for i in done], [name[i] for i in done], label)

    @staticmethod
    def rows(song: list, stem: list, note: list, line: list) -> pd.DataFrame:
        return pd.DataFrame({"song_id": pd.Series(song, dtype="Int64"), "stem": pd.Series(stem, dtype=object), "note_id": pd.Series(note, dtype="int64"), "line_id": pd.Series(line, dtype="int64")})

    def wake(self, at: float, timerValues) -> None:
        self.handle.registerTimer(max(int(at), timerValues.getCurrentWatermarkInMs() + 1))

    def close(self) -> None:
        pass


def voice_line_stream(notes: DataFrame, delay: str = "1 second", buckets: int = 1024) -> DataFrame:
    """Voice lines on a live note stream (event time ``at``).

    A chord group is settled once the watermark has passed it by 25 ms; open
    lines are kept until 300 ms after their last end, then forgotten.  Songs and stems share ``buckets`` states,
    which a running stream cannot change.  The state store has to be RocksDB,
    which is set here where the session names no other.
    """
    conf, name = notes.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    if not conf.get(name, "").endswith("RocksDBStateStoreProvider"):
        conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    dealt = notes.withWatermark("at", delay).select(*NOTE.names, "at", F.pmod(F.xxhash64("song_id", "stem"), F.lit(buckets)).alias("bucket"))
    return dealt.groupBy("bucket").transformWithStateInPandas(
        VoiceLines(), "song_id long, stem string, note_id long, line_id long", "Append", "EventTime")


def trouble_stream(notes: DataFrame, measure_ms: int, beats_per_measure: int, delay: str = "10 seconds", min_confidence: float = 0.25, max_density: float = 6.0) -> DataFrame:
    """Troubled measures as notes arrive: tumbling windows of one measure on event time ``at``."""
    g = notes.withWatermark("at", delay).groupBy("song_id", F.window("at", f"{measure_ms} milliseconds")).agg(steady_avg("confidence").alias("avg_confidence"), F.count(F.lit(1)).alias("n_notes"))
    density = F.col("n_notes") / float(beats_per_measure)
    reasons = F.array_compact(F.array(F.when(F.col("avg_confidence") < min_confidence, F.lit("low_confidence")), F.when(density > max_density, F.lit("fragmented"))))
    return g.withColumn("reasons", reasons).filter(F.size("reasons") > 0).select("song_id", F.unix_millis("window.start").alias("start_ms"), "avg_confidence", "n_notes", "reasons")


def anneal(readings: DataFrame, rate: float = 0.05, chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Pulse strengths blended over time: s = last * d + reading * (1 - d) with d = exp(-rate * seconds).

    A step is the map s -> a * s + b, and maps compose, so a chunk of readings is one map that
    carries its entry value to its exit.  Inside a chunk weights are rescaled to the chunk's
    start, which keeps exponents small however long the song is; across chunks the entry values
    follow from the chunk maps, again rescaled over at most ``BLOCK`` chunks at a time.
    ``readings`` has song_id, period_ms, t_ms, strength.
    """
    keys = ["song_id", "period_ms"]
    k = rate / 1000.0
    s = scan(readings, keys, ["t_ms"], {"_p": prev("t_ms")}, chunk_ms)
    s = s.withColumn("_c", F.floor(F.col("t_ms") / F.lit(float(chunk_ms))))
    d = F.when(F.col("_p").isNull(), 0.0).otherwise(F.exp(-k * (F.col("t_ms") - F.col("_p"))))
    base = F.col("_c") * F.lit(float(chunk_ms))
    s = settle(s.withColumn("_w", F.col("strength") * F.when(F.col("_p").isNull(), F.lit(1.0)).otherwise(1.0 - d) * F.exp(k * (F.col("t_ms") - base))))
    # the blend a chunk alone leaves at its end, and the same carried to the end of its block of chunks
    ends = s.groupBy(*keys, "_c").agg((F.sum("_w") * math.exp(-k * chunk_ms)).alias("_b"))
    ends = ends.withColumn("_g", F.floor(F.col("_c") / BLOCK))
    rise = F.exp(F.lit(k * chunk_ms) * (F.col("_c") - F.col("_g") * BLOCK + 1))
    before = Window.partitionBy(*keys, "_g").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_x", F.coalesce(F.sum(F.col("_b") * rise).over(before), F.lit(0.0)))
    blocks = ends.groupBy(*keys, "_g").agg((F.sum(F.col("_b") * rise) * math.exp(-k * chunk_ms * BLOCK)).alias("_b"))
    # what lies over LONG blocks back has decayed below the last place of a double
    reach = max(1, math.ceil(60.0 / (k * chunk_ms * BLOCK)))
    late = blocks.select(*keys, F.col("_g").alias("_from"), "_b", F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("_step"))
    late = late.withColumn("_g", F.col("_from") + F.col("_step"))
    decay = F.exp(F.lit(-k * chunk_ms * BLOCK) * (F.col("_g") - F.col("_from") - 1))
    late = late.groupBy(*keys, "_g").agg(F.sum(F.col("_b") * decay).alias("_y"))
    entry = ends.join(late, [*keys, "_g"], "left").select(
        *keys, "_c", (F.coalesce("_y", F.lit(0.0)) + F.col("_x")).alias("_in"), (F.col("_c") - F.col("_g") * BLOCK).alias("_i"))
    inside = Window.partitionBy(*keys, "_c").orderBy("t_ms")
    out = s.withColumn("_own", F.sum("_w").over(inside)).join(entry, [*keys, "_c"])
    # the entry stands at the block's start: it decays over the chunks before this one and the time inside
    value = (F.col("_own") + F.col("_in") * F.exp(F.lit(-k * chunk_ms) * F.col("_i"))) * F.exp(-k * (F.col("t_ms") - base))
    return out.select(*keys, "t_ms", "strength", value.alias("annealed"))
