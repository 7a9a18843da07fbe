"""License scans: exact phrases, and fuzzy short notices by pigeonhole seeds and bounded-error matching."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Phrase and label; the base phrases count exactly.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Notices that are searched with errors, besides the base phrases.
NOTICES = (
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("the mit license", "mit"),
    ("creative commons attribution", "cc-by"),
    ("licensed under the apache license version 2 0", "apache"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
)
#: One edit is allowed for each so many characters of a notice; shorter ones match exactly.
CHARS_PER_EDIT = 12

#: ASCII letters lower-cased; other ASCII but digits become spaces; the bytes of other characters stay.
_TABLE = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(128)) + bytes(range(128, 256))

SPANS = "spans array<struct<label:string,notice:string,start_word:long,n_words:long,edits:int,base:boolean>>"
_SPAN = pa.struct([("label", pa.string()), ("notice", pa.string()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int32()), ("base", pa.bool_())])


class Matcher:
    """Search of one normalised text for all notices."""

    def __init__(self, base=BASE, notices=NOTICES, chars_per_edit: int = CHARS_PER_EDIT):
        self.notices = [(p, label, len(p) // chars_per_edit, True) for p, label in base]
        self.notices += [(p, label, len(p) // chars_per_edit, False) for p, label in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for j, (phrase, _, edits, _) in enumerate(self.notices):
            # At most `edits` errors leave one of edits + 1 pieces untouched.
            cuts = [len(phrase) * i // (edits + 1) for i in range(edits + 2)]
            for a, b in zip(cuts, cuts[1:]) if edits else ():
                seeds.setdefault(phrase[a:b], []).append((j, a))
        self.seeds = ahocorasick.Automaton()
        for piece, where in seeds.items():
            self.seeds.add_word(piece, [(j, a + len(piece) - 1) for j, a in where])
        self.seeds.make_automaton()
        self.fuzzy = [regex.compile(rf"(?b)(?<= )(?:{regex.escape(p)}){{e<={e}}}(?= )") if e else None for p, _, e, _ in self.notices]
        self.verify = lru_cache(maxsize=20_000)(self._verify)

    def _verify(self, j: int, window: str) -> tuple[int, int, int] | None:
        found = self.fuzzy[j].search(window)
        return (*found.span(), sum(found.fuzzy_counts)) if found else None

    def find(self, norm: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) in characters of the text, which has a space at either end."""
        out, exact = [], set()
        for j, (phrase, _, _, _) in enumerate(self.notices):
            at = norm.find(f" {phrase} ")
            while at >= 0:
                out.append((j, at + 1, at + 1 + len(phrase), 0))
                exact.add((j, at + 1))
                at = norm.find(f" {phrase} ", at + 1)
        seen, last = set(), [-(10**9)] * len(self.notices)
        for end, where in self.seeds.iter(norm):
            for j, offset in where:
                phrase, _, edits, _ = self.notices[j]
                start = end - offset
                if (j, start) in exact or abs(start - last[j]) <= edits:
                    continue
                last[j] = start
                a, b = max(0, start - 2 * edits - 1), start + len(phrase) + 2 * edits + 1
                hit = self.verify(j, norm[a:b])
                if hit and hit[2] and (j, a + hit[0]) not in seen:
                    seen.add((j, a + hit[0]))
                    out.append((j, a + hit[0], a + hit[1], hit[2]))
        return sorted(out, key=lambda x: (x[1], x[0]))

    def spans(self, text: str) -> tuple[int, list[dict]]:
        words = text.encode("utf-8", "replace").lower().translate(_TABLE).split(b" ")
        words = [w for w in words if w]
        norm = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace")
        spans, at, before = [], 0, 0
        for j, start, end, edits in self.find(norm):
            before += norm.count(" ", at, start)
            at = start
            phrase, label, _, base = self.notices[j]
            spans.append({"label": label, "notice": phrase, "start_word": before - 1, "n_words": norm.count(" ", start, end) + 1, "edits": edits, "base": base and not edits})
        return len(words), spans


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, notices=NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """License notices in each whole text, exact and with a bounded number of errors.

    Each notice of n characters may have n // chars_per_edit edits. It is split into one piece more than that; one
    automaton finds all pieces in one pass, and only around a found piece does bounded-error matching verify
    the edits and report the span, which starts and ends at word boundaries.

    Returns (id, n_words, spans), one row per input row, spans by position. A null text counts as empty;
    null ids and repeated rows are kept; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(base, notices, chars_per_edit)
        for batch in batches:
            rows = [matcher.spans(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.list_(_SPAN))], ["id", "n_words", "spans"]
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(scan, f"id {kind}, n_words long, {SPANS}")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["start_word"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["label"]))), ",")
    score = F.array_max(F.transform("spans", lambda x: 1.0 - x["edits"] / F.length(x["notice"])))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"), F.coalesce(score, F.lit(0.0)).alias("score"),
        F.filter("spans", lambda x: x["edits"] > 0).alias("fuzzy_spans"),
    )
