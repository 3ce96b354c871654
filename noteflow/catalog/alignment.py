"""Alignment, beat match, resolved view, motif pairs."""

from pyspark.sql import functions as F

from ..operators import alignment as al
from ..operators import annotations as an
from ..operators import evaluation as ev
from ..operators import filters as f
from ..operators import texture as tx
from ..sources import corpus as c
from .filters import KINDS, PIVOT
from .lookups import RUNS, SECT, runs
from .registry import query, r6


@query("v07_score_alignment")
def v07(s, d):
    n = c.notes(s, d).filter("stem <> 'drums'")
    ref = n.select("song_id", "pitch", (F.col("start_ms") / 500).alias("start"), (F.col("end_ms") / 500).alias("end"))
    ours = n.filter("note_id % 4 <> 0").select("song_id", "pitch", F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))
    return al.align_scores(ref, ours)


# one cell of a song's table a step; a row of states is kept, {c: path cost with gaps, s: cost, h: hits, n: cells}
AGREE = """
sv as (select song_id, start_ms, round(log2(end_ms - start_ms), 6) as v, note_id from notes),
sa as (select song_id, list(v order by start_ms, v) as a from sv group by song_id), sb as (select song_id, list(v order by start_ms, v) as b from sv where note_id % 5 <> 0 group by song_id),
dp(song_id, a, b, k, above, own) as (
  select song_id, a, b, cast(0 as bigint), list_concat([{'c': 0e0, 's': 0e0, 'h': 0, 'n': 0}], list_transform(b, lambda x: {'c': cast('inf' as double), 's': 0e0, 'h': 0, 'n': 0})),
    [{'c': cast('inf' as double), 's': 0e0, 'h': 0, 'n': 0}] from sa join sb using (song_id)
  union all
  select song_id, a, b, k + 1, case when j = len(b) - 1 then row else above end, case when j = len(b) - 1 then row[:0] || [{'c': cast('inf' as double), 's': 0e0, 'h': 0, 'n': 0}] else row end
  from (select song_id, a, b, k, above, j, list_append(own, {'c': w.c + toll + least(gap, 2e0), 's': w.s + least(gap, 2e0), 'h': w.h + case when gap <= 0.18e0 then 1 else 0 end, 'n': w.n + 1}) as row
    from (select *, case when dg.c <= up.c + 1 and dg.c <= lf.c + 1 then dg when up.c <= lf.c then up else lf end as w, case when dg.c <= up.c + 1 and dg.c <= lf.c + 1 then 0e0 else 1e0 end as toll
      from (select *, k % len(b) as j, above[k % len(b) + 1] as dg, above[k % len(b) + 2] as up, own[k % len(b) + 1] as lf, abs(a[k // len(b) + 1] - b[k % len(b) + 1]) as gap from dp where k < len(a) * len(b)) x) y) z)"""


@query("v08_x04_sequence_agreement", "notes", AGREE, """
select song_id, round(above[-1].s / above[-1].n + 1.37e-8, 6) as mean_cost, round(above[-1].h / above[-1].n + 1.37e-8, 6) as hit_share from dp where k = len(a) * len(b)""")
def v08(s, d):
    n = c.notes(s, d)
    both = n.select("song_id", F.lit(0).alias("side"), "start_ms", F.round(F.log2(F.col("end_ms") - F.col("start_ms")), 6).alias("value")).unionByName(
        n.filter("note_id % 5 <> 0").select("song_id", F.lit(1).alias("side"), "start_ms", F.round(F.log2(F.col("end_ms") - F.col("start_ms")), 6).alias("value")))
    x = al.sequence_agreement(al.positions_of(both, ["start_ms", "value"], 30000.0).select("song_id", "side", "pos", "value"))
    return x.select("song_id", r6("mean_cost").alias("mean_cost"), r6("hit_share").alias("hit_share"))


@query("a41_beat_match_lift", "notes beats", """
bc as (select song_id, k, t_ms + beat_idx % 5 * 12e0 + 480e0 * k / 21 as c from beats, range(0, 21) q(k)),
be as (select b.song_id, q.k, b.beat_idx, coalesce(min(abs(c - b.t_ms)) filter (where abs(c - b.t_ms) <= 240), 240e0) as err
  from beats b cross join range(0, 21) q(k) left join bc on bc.song_id = b.song_id and bc.k = q.k and c between b.t_ms - 241 and b.t_ms + 241 group by all),
bm as (select song_id, k, median(err) as med, avg(case when err > 120 then 1e0 else 0e0 end) as off from be group by all)""", """
select song_id, round(max(med) filter (where k = 0), 6) as median_error, round(max(off) filter (where k = 0), 6) as off_share, round(avg(med) filter (where k > 0), 6) as null_error,
  round((avg(med) filter (where k > 0)) / greatest(max(med) filter (where k = 0), 1e-9), 4) as lift from bm group by song_id""")
def a41(s, d):
    b = c.beats(s, d)
    x = al.beat_match(b, b.withColumn("t_ms", F.col("t_ms") + F.col("beat_idx") % 5 * 12.0), 480.0)
    return x.select("song_id", *[F.round(v, 6).alias(v) for v in ("median_error", "off_share", "null_error")], F.round("lift", 4).alias("lift"))


@query("x03_stem_accessor", "notes", "", """
select note_id, case when pitch < 23 then 'below' else 'above' end as place from notes where stem in ('guitar', 'bass') and pitch not between 23 and 67""")
def x03(s, d):
    """The judged stem is any column: here guitars are held to the bass range."""
    stem = F.when(F.col("stem") == "guitar", "bass").when(F.col("stem") == "vocals", "other").otherwise(F.col("stem"))
    return f.range_offenders(c.notes(s, d), stem).select("note_id", "place")


@query("j21_resolved_view", "notes annotations onsets sections", RUNS + "," + PIVOT + """,
rv as (select r.note_id, r.song_id, r.stem, coalesce(onset_refinement, start_ms) as st, greatest(end_ms, coalesce(sustain_extension, end_ms)) as en from runs r left join lat using (note_id)
  where stem <> 'drums' and r.note_id = run_note and not (end_ms - start_ms < 60 and confidence < 0.15)),
""" + SECT.replace("ns as (select", "nx as (select"), """
select rv.note_id, rv.stem, round(st, 6) as start_ms, round(en, 6) as end_ms, s.label, s.idx, s.instance from rv join sx s on s.song_id = rv.song_id and st >= s.start_ms and st < s.end_ms""")
def j21(s, d):
    timing = an.pivot_latest(c.annotations(s, d), KINDS)
    v = tx.resolved_view(c.notes(s, d), runs(s, d), timing, c.sections(s, d))
    return v.select("note_id", "stem", F.round("start_ms", 6).alias("start_ms"), F.round("end_ms", 6).alias("end_ms"), "label", "idx", F.col("instance").cast("bigint").alias("instance"))


def paired(s, d):
    i = F.col("note_id")
    n = c.notes(s, d)
    label = tx.section_lookup(n, c.sections(s, d)).select("note_id", F.col("label").alias("section"))
    e = n.join(label, "note_id", "left").withColumns({"family": F.col("stem"), "motif": F.when(i % 3 != 0, F.col("pitch") % 4), "occurrence": F.when(i % 3 != 0, F.floor(F.col("start_ms") / 2000))})
    return tx.edge_scores(tx.motif_pairs(e, 480.0, 2.0), 480.0)


@query("j19_motif_pairs")
def j19(s, d):
    return paired(s, d)


@query("j19_a38_witness_auc")
def j19b(s, d):
    """How well each edge score tells a motif's own continuation from its rivals."""
    names = ("pitch_prox", "register", "ioi_regular", "metric_pos", "duration_compat", "overlap", "family_same", "stem_same", "motif_cont", "section_same")
    x = paired(s, d).select("positive", F.explode(F.array(*[F.struct(F.lit(n).alias("witness"), F.col(n).alias("score")) for n in names])).alias("w"))
    return ev.auc(x.select("positive", "w.witness", "w.score"), ["witness"], "score", "positive", 0.01)
