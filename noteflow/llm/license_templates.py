"""License scans by template markup compiled to token automata.

A template is a line of words with two kinds of markup:

    [[ ... ]]        words that may be missing (may be nested)
    {{name:regex}}   one replaceable word that must match ``regex`` as a whole

All other words are mandatory and must match exactly.  A template compiles to a
nondeterministic automaton over words; a run of words of a text that leads from its start to
its end is a match.  Texts are compared without case of A-Z, punctuation or white space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import small_batches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}

# Base phrases and their labels (fixed values).
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

VERB = "[[this work is]] [[this software is]] [[this file is]] {{verb:licensed|released|distributed|available|provided}} under [[the terms of]] [[the]]"
TEMPLATES = {
    "gpl-2": VERB + " gnu general public license [[as published by the free software foundation]] [[either]] {{mark:version|v}} 2 [[0]]",
    "gpl-3": VERB + " gnu general public license [[as published by the free software foundation]] [[either]] {{mark:version|v}} 3 [[0]]",
    "apache-2": VERB + " apache license [[{{mark:version|v}}]] 2 0",
    "cc-by": VERB + " cc by {{major:[1-4]}} {{minor:[05]}}",
    "cc-by-nc": VERB + " cc by nc {{major:[1-4]}} {{minor:[05]}}",
    "cc-by-sa": VERB + " cc by sa {{major:[1-4]}} {{minor:[05]}}",
    "cc-by-nd": VERB + " cc by nd {{major:[1-4]}} {{minor:[05]}}",
    "mit-notice": VERB + " mit license",
}


def words_of(text: str | None) -> list[str]:
    """Words of a text with A-Z in lower case; null has none."""
    return WORD.findall((text or "").translate(UPPER) if not (text or "").isascii() else (text or "").lower())


@dataclass
class Automaton:
    """Word edges and empty edges between numbered states; state 0 is the start."""

    exact: list[dict[str, set[int]]] = field(default_factory=lambda: [{}])
    loose: list[list[tuple[re.Pattern, int]]] = field(default_factory=lambda: [[]])
    skip: list[set[int]] = field(default_factory=lambda: [set()])
    end: int = 0

    def state(self) -> int:
        self.exact.append({})
        self.loose.append([])
        self.skip.append(set())
        return len(self.exact) - 1

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for nxt in self.skip[todo.pop()] - seen:
                seen.add(nxt)
                todo.append(nxt)
        return frozenset(seen)

    def step(self, states: frozenset[int], word: str) -> frozenset[int]:
        to: set[int] = set()
        for s in states:
            to |= self.exact[s].get(word, set())
            to |= {t for pattern, t in self.loose[s] if pattern.fullmatch(word)}
        return self.closure(to) if to else frozenset()


def compile_template(markup: str) -> Automaton:
    """Automaton of one template; unbalanced markup or a template without a mandatory word is an error."""
    a, opened, at, mandatory = Automaton(), [], 0, 0
    for kind, name, pattern, word in re.findall(r"(\[\[|\]\])|\{\{(\w+):(.*?)\}\}|([^\s\[\]{}]+)", markup):
        if kind == "[[":
            opened.append(at)
        elif kind == "]]":
            if not opened:
                raise ValueError(f"]] without [[ in {markup!r}")
            a.skip[opened.pop()].add(at)
        else:
            nxt = a.state()
            if name:
                a.loose[at].append((re.compile(pattern), nxt))
            else:
                a.exact[at].setdefault(word.translate(UPPER), set()).add(nxt)
            mandatory += not opened
            at = nxt
    if opened or not mandatory:
        raise ValueError(f"unbalanced markup or nothing mandatory in {markup!r}")
    a.end = at
    return a


class Scanner:
    """All templates and phrases, with the words that can begin any of them."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.templates = {label: compile_template(t) for label, t in templates.items()}
        self.phrases = [(p.split(), label) for p, label in phrases.items()]
        self.seen: dict[tuple[str, frozenset[int], str], frozenset[int]] = {}
        self.starts = {label: a.closure({0}) for label, a in self.templates.items()}
        firsts = {w for label, a in self.templates.items() for s in self.starts[label] for w in a.exact[s]} | {p[0] for p, _ in self.phrases}
        loose = {p.pattern for label, a in self.templates.items() for s in self.starts[label] for p, _ in a.loose[s]}
        self.first = re.compile("|".join([*map(re.escape, sorted(firsts)), *(f"(?:{p})" for p in sorted(loose))]) or r"(?!)")
        self.begins: dict[str, bool] = {}

    def begin(self, word: str) -> bool:
        if (known := self.begins.get(word)) is None:
            if len(self.begins) > 200_000:
                self.begins.clear()
            known = self.begins[word] = self.first.fullmatch(word) is not None
        return known

    def longest(self, label: str, words: list[str], at: int) -> int:
        """End of the longest match of a template that starts at ``at``, or 0."""
        a, states, best = self.templates[label], self.starts[label], 0
        for i in range(at, len(words)):
            states = a.step(states, words[i])
            if not states:
                break
            if a.end in states:
                best = i + 1
        return best

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Number of words; base places and template matches as (label, first word, end)."""
        words = words_of(text)
        begin = self.begin
        base, found = [], []
        for i in [i for i, w in enumerate(words) if begin(w)]:
            for phrase, label in self.phrases:
                if words[i:i + len(phrase)] == phrase:
                    base.append((label, i, i + len(phrase)))
            for label in self.templates:
                if end := self.longest(label, words, i):
                    found.append((label, i, end))
        return len(words), base, found


SPANS = "array<struct<label:string,start:bigint,stop:bigint>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
                  phrases: dict[str, str] | None = None) -> DataFrame:
    """Columns id_col, n_words, base and spans of every row: where phrases and templates match.

    Spans are (label, start, stop) in word positions, in text order; of the matches of one
    template from one word only the longest is given, so a template also matches from within
    its own optional beginning.  Whole texts are scanned.  A null or empty text has no words
    and empty spans; repeated rows give equal rows; an empty table gives an empty one; other
    columns of ``docs`` are not read.
    """
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    small_batches(docs.sparkSession)

    @F.pandas_udf(f"struct<n_words:bigint,base:{SPANS},spans:{SPANS}>")
    def scanned(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, phrases)
        for texts in parts:
            rows = [scanner.scan(t) for t in texts]
            spans = [[[{"label": a, "start": b, "stop": c} for a, b, c in r[k]] for r in rows] for k in (1, 2)]
            yield pd.DataFrame({"n_words": [r[0] for r in rows], "base": spans[0], "spans": spans[1]})

    return docs.select(F.col(id_col), scanned(F.col(text_col).cast("string")).alias("s")).select(id_col, "s.n_words", "s.base", "s.spans")


def license_summary(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, places and labels per text; score is the share of base places inside a template match.

    Without base places the score is 1 if a template matches and 0 if none does.
    """
    def joined(*arrays):
        return F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(a, lambda s: s["label"]) for a in arrays]))), ",")

    starts = F.transform("base", lambda s: s["start"])
    inside = F.size(F.filter("base", lambda b: F.exists("spans", lambda s: (s["start"] <= b["start"]) & (b["stop"] <= s["stop"]))))
    n = F.size("base")
    return scanned.select(
        id_col, "n_words", n.cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined("base").alias("base_labels"), joined("base", "spans").alias("labels"),
        F.when(n > 0, inside / n).otherwise(F.when(F.size("spans") > 0, 1.0).otherwise(0.0)).cast("double").alias("score"))
