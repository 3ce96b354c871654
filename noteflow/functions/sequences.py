"""Figures and textures on many short note sequences laid end to end in numpy arrays.

A sequence never reaches over its ends, so one pass of array operations treats thousands of
short streams at once.  The rules are those of the DataFrame operators they are named after.
"""

from __future__ import annotations

from typing import Callable

import numpy as np

from .music import chord_masks

CHORDAL = np.isin(np.arange(4096), chord_masks())
Spans = tuple[np.ndarray, np.ndarray]


def borders(*keys: np.ndarray) -> np.ndarray:
    """Where a sequence begins: rows whose keys differ from those of the row before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


class Laid:
    """Sequences laid end to end; ``head`` and ``tail`` are the first row of a row's sequence and the one after its last."""

    def __init__(self, new: np.ndarray) -> None:
        self.n = len(new)
        self.at = np.arange(self.n)
        self.starts = np.flatnonzero(new)
        self.stops = np.append(self.starts[1:], self.n)
        self.of = np.cumsum(new) - 1
        self.head, self.tail = self.starts[self.of], self.stops[self.of]

    def lead(self, x: np.ndarray, k: int = 1) -> np.ndarray:
        """Value ``k`` rows later, NaN beyond the end."""
        out = np.full(self.n, np.nan)
        out[:max(0, self.n - k)] = x[k:]
        out[self.at + k >= self.tail] = np.nan
        return out

    def lag(self, x: np.ndarray) -> np.ndarray:
        out = np.full(self.n, np.nan)
        out[1:] = x[:-1]
        out[self.starts] = np.nan
        return out

    def dealt(self, draw: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """Rows in the order of their draws, every sequence in its own place."""
        return np.lexsort((tie, draw, self.of))

    def run_sum(self, x: np.ndarray) -> np.ndarray:
        """Running sums, each added up from its sequence's own start."""
        out = np.empty(self.n)
        for lo, hi in zip(self.starts.tolist(), self.stops.tolist()):
            np.cumsum(x[lo:hi], out=out[lo:hi])
        return out

    def steps(self, to: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Rows stepped on from each row of ``start`` (at most one a sequence) on, row by row to ``to``."""
        on, here = np.zeros(self.n, bool), start
        while len(here):
            on[here] = True
            far = to[here]
            here = far[far < self.tail[here]]
        return on

    def greedy(self, match: np.ndarray, advance: np.ndarray) -> np.ndarray:
        """Matches taken from left to right; one taken blocks starts before its advance."""
        ahead = np.append(np.minimum.accumulate(np.where(match, self.at, self.n)[::-1])[::-1], self.n)
        to = ahead[np.minimum(self.at + np.where(match, advance, 1).astype(np.int64), self.n)]
        first = ahead[self.starts]
        return np.flatnonzero(self.steps(to, first[first < self.stops]))

    def anchors(self, t: np.ndarray, window: float) -> np.ndarray:
        """Rows that open a group: the first ones out of ``window`` of the group's first row; ``t`` ascends."""
        to, more = self.at + 1, self.at
        while len(more):
            near = to[more]
            more = more[near < self.tail[more]]
            more = more[t[to[more]] - t[more] <= window]
            to[more] += 1
        return self.steps(to, self.starts)


def _runs(valid: np.ndarray, opens: np.ndarray) -> Spans:
    """First and last rows of runs of valid rows; ``opens`` marks valid rows that begin one whatever lies before."""
    before, after = np.append(False, valid[:-1]), np.append(valid[1:], False)
    return np.flatnonzero(valid & (opens | ~before)), np.flatnonzero(valid & (~after | np.append(opens[1:], True)))


def _masks(pitch: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Pitch-class sets of the rows ``lo`` to ``hi``."""
    pcs, out = np.mod(pitch, 12), np.zeros(len(lo), np.int64)
    for c in range(12):
        nearest = np.minimum.accumulate(np.where(pcs == c, np.arange(len(pitch)), len(pitch))[::-1])[::-1]
        out |= (nearest[lo] <= hi).astype(np.int64) << c
    return out


def _repeats(s: Laid, pitch: np.ndarray, cell: int) -> np.ndarray:
    """How many times in a row the cell that starts at a note is played."""
    other = pitch != s.lead(pitch, cell)
    ends = np.minimum.accumulate(np.where(other, s.at, s.n)[::-1])[::-1]
    return (ends - s.at) // cell + 1


def scale_runs(s: Laid, pitch, start, end, beat_ms) -> Spans:
    iv = pitch - s.lag(pitch)
    d = np.sign(iv)
    a, b = _runs((np.abs(iv) >= 1) & (np.abs(iv) <= 2), d != np.append(np.nan, d[:-1]))
    keep = b - a + 1 >= 3
    return a[keep] - 1, b[keep]


def arpeggios(s: Laid, pitch, start, end, beat_ms) -> Spans:
    iv = pitch - s.lag(pitch)
    valid = (np.abs(iv) >= 3) & (np.abs(iv) <= 12)
    a, b = _runs(valid, np.zeros(s.n, bool))
    rows, run = np.flatnonzero(valid), np.repeat(np.arange(len(a)), b - a + 1)
    last, up = b[run], np.cumsum(iv > 0)
    edges, ups = last - rows + 1, up[last] - up[rows] + (iv[rows] > 0)
    ok = (edges >= 3) & (np.maximum(ups, edges - ups) / edges >= 0.75) & CHORDAL[_masks(pitch, rows - 1, last)]
    which, first = np.unique(run[ok], return_index=True)
    return rows[ok][first] - 1, b[which]


def sequences(s: Laid, pitch, start, end, beat_ms) -> Spans:
    p = [pitch, *[s.lead(pitch, k) for k in range(1, 10)]]
    advance = np.zeros(s.n, np.int64)
    for cell in (3, 4, 5):
        move = p[cell] - p[0]
        ok = (np.abs(move) <= 12) & (move != 0)
        for k in range(1, cell):
            ok &= p[cell + k] - p[k] == move
        advance[ok] = 2 * cell
    at = s.greedy(advance > 0, advance)
    return at, at + advance[at] - 1


def ostinati(s: Laid, pitch, start, end, beat_ms) -> Spans:
    advance = np.zeros(s.n, np.int64)
    for cell in (2, 3, 4, 5):
        r = _repeats(s, pitch, cell)
        advance = np.where(r >= 3, cell * r, advance)
    at = s.greedy(advance > 0, advance)
    return at, at + advance[at] - 1


def _equal(s: Laid, pitch, start, most: float) -> Spans:
    opens = ~((pitch == s.lag(pitch)) & (start - s.lag(start) <= most))
    a, b = _runs(np.ones(s.n, bool), opens)
    keep = b - a >= 2
    return a[keep], b[keep]


def pedals(s: Laid, pitch, start, end, beat_ms) -> Spans:
    a, b = _equal(s, pitch, start, np.inf)
    keep = (end[b] - start[a]) / beat_ms >= 2.0
    return a[keep], b[keep]


def rearticulations(s: Laid, pitch, start, end, beat_ms) -> Spans:
    return _equal(s, pitch, start, 0.30 * beat_ms)


def alberti(s: Laid, pitch, start, end, beat_ms) -> Spans:
    p1, p2, p3 = (s.lead(pitch, k) for k in (1, 2, 3))
    r = _repeats(s, pitch, 4)
    ok = (pitch < p2) & (p2 < p1) & (p3 == p1) & (r >= 2)
    rows = np.flatnonzero(ok)
    ok[rows] = CHORDAL[_masks(pitch, rows, rows + 2)]
    at = s.greedy(ok, 4 * r)
    return at, at + 4 * r[at] - 1


def neighbor_tones(s: Laid, pitch, start, end, beat_ms) -> Spans:
    p1, p2, p3, p4 = (s.lead(pitch, k) for k in (1, 2, 3, 4))
    up, down = p1 - pitch, p3 - pitch
    near = (p2 == pitch) & (np.abs(up) >= 1) & (np.abs(up) <= 2)
    turn = (p4 == pitch) & (np.abs(down) >= 1) & (np.abs(down) <= 2) & (up * down < 0)
    advance = np.where(turn, 4, 2)
    at = s.greedy(near, advance)
    return at, at + advance[at]


def gap_fills(s: Laid, pitch, start, end, beat_ms) -> Spans:
    iv = s.lead(pitch) - pitch
    d = np.where((np.abs(iv) >= 1) & (np.abs(iv) <= 2), np.sign(iv), 0.0)
    ends = [np.append(np.minimum.accumulate(np.where(d != way, s.at, s.n)[::-1])[::-1][1:], s.n) for way in (1, -1)]
    filled = np.where(iv < 0, *ends) - s.at - 1
    match = (np.abs(iv) >= 4) & (np.abs(iv) <= 12) & (filled >= 2)
    at = s.greedy(match, filled + 1)
    return at, at + filled[at] + 1


def chords(s: Laid, pitch, start, end, beat_ms) -> Spans:
    a = np.flatnonzero(s.anchors(start, 45.0))
    b = np.append(a[1:], s.n) - 1
    keep = b - a >= 2
    a, b = a[keep], b[keep]
    keep = CHORDAL[_masks(pitch, a, b)]
    return a[keep], b[keep]


FIGURES: dict[str, Callable[..., Spans]] = {
    "scale_run": scale_runs, "arpeggio": arpeggios, "sequence": sequences, "ostinato": ostinati, "pedal_point": pedals,
    "rearticulation": rearticulations, "alberti_bass": alberti, "neighbor_tone": neighbor_tones, "gap_fill": gap_fills, "chord": chords,
}
# Figures told by pitches in order alone, so that a copy with other times has the same ones.
TIMELESS = ("scale_run", "arpeggio", "sequence", "ostinato", "alberti_bass", "neighbor_tone", "gap_fill")


def covered(spans: Spans, n: int) -> int:
    """Rows that some span holds."""
    step = np.bincount(spans[0], minlength=n + 1)[:n + 1] - np.bincount(spans[1] + 1, minlength=n + 1)[:n + 1]
    return int((np.cumsum(step) > 0).sum())


def _likeness(gid: np.ndarray, size: np.ndarray, pitch: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """(chordal - clustered) share of the pitch pairs of every stack, the lower pitch first."""
    q = pitch[np.lexsort((pitch, gid))]
    score, stop, k = np.zeros(len(size)), np.cumsum(size)[gid], 1
    rows = np.arange(len(q) - 1)
    while len(rows := rows[rows + k < stop[rows]]):
        v = np.mod(q[rows + k] - q[rows], 12)
        score += np.bincount(gid[rows], np.isin(v, good).astype(float) - np.isin(v, bad), len(size))
        k += 1
    return score / np.maximum(size * (size - 1) / 2, 1)


def textures(s: Laid, start, end, pitch, family, r_start, r_end, window: float, min_notes: int, good, bad) -> dict[str, np.ndarray]:
    """n, mean_stack, sync_share, chordness and texture of every sequence, the notes of a region in time order; families are numbers."""
    count = len(s.starts)

    def per(rows, weights=None):
        return np.bincount(s.of[rows], weights, count)

    n = s.stops - s.starts
    ps = pitch[np.lexsort((pitch, s.of))]
    split = ((ps[s.starts + (n - 1) // 2] + ps[s.starts + n // 2]) / 2)[s.of]
    opens = s.anchors(start, window)
    heads, gid = np.flatnonzero(opens), np.cumsum(opens) - 1
    size = np.diff(np.append(heads, s.n))
    stacks, multi = per(heads), size > 1
    mean_stack, share = n / stacks, per(heads, np.where(multi, size, 0)) / n
    chordness = per(heads[multi], _likeness(gid, size, pitch, good, bad)[multi]) / np.maximum(per(heads[multi]), 1)
    held = per(end - start >= 0.60 * np.maximum(1.0, r_end - r_start)) > 0
    many = int(family.max(initial=0)) + 1
    kinds, times = np.unique(s.of * many + family, return_counts=True)
    families = np.bincount(kinds[times >= 3] // many, minlength=count)
    top, low = np.flatnonzero(pitch > split), np.flatnonzero(pitch <= split)
    step, same = np.abs(np.diff(pitch[top])), s.of[top][1:] == s.of[top][:-1]
    tops = per(top)
    stepwise = np.where(tops > 2, per(top[1:][same & (step >= 1) & (step <= 2)]) / np.maximum(tops - 1, 1), 0.0)
    moves = [per(rows[Laid(borders(s.of[rows])).anchors(start[rows], window)]) for rows in (top, low)]
    active = moves[0] / np.maximum(moves[1], 1)
    label = np.select([n < min_notes, mean_stack < 1.2, (share >= 0.55) & (mean_stack >= 2.2) & (chordness > 0.15), held & (stacks >= 4),
                       ((families >= 2) | (stepwise > 0.35)) & (active >= 1.3), share <= 0.35],
                      ["SPARSE", "MONOPHONIC", "CHORDAL", "PEDAL_PLUS_ACTIVITY", "MELODY_ACCOMP", "COUNTERPOINT"], "MELODY_ACCOMP")
    return {"n": n, "mean_stack": mean_stack, "sync_share": share, "chordness": chordness, "texture": label}


def churns(song: np.ndarray, texture: np.ndarray, songs: int) -> tuple[np.ndarray, np.ndarray]:
    """Churn and expected churn of every song (a number below ``songs``; NaN: too few regions) from its regions in order."""
    real = texture != "SPARSE"
    song, texture = song[real], texture[real]
    n = np.bincount(song, minlength=songs)
    changes = np.bincount(song[1:][(song[1:] == song[:-1]) & (texture[1:] != texture[:-1])], minlength=songs)
    names, which = np.unique(texture, return_inverse=True)
    k = np.bincount(song * len(names) + which, minlength=songs * len(names)).reshape(songs, -1)
    enough = n >= 2
    return np.where(enough, changes / np.maximum(n - 1, 1), np.nan), np.where(enough, 1.0 - (k * k).sum(axis=1) / np.maximum(n * n, 1), np.nan)
