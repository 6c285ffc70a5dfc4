"""Quality rules, line first.

Every line with a word is held against punctuation, navigation, boilerplate and
repetition rules. Failing lines are removed, and a document that loses too large
a part of its words is rejected; so is one that is too short or mostly repeats
itself. Counts and rules see whole texts.

Edge cases: a NULL or empty text has no words and is rejected by the base rule;
lines without a word never fail a rule; rows that repeat an id are judged each
on their own; other columns are carried along unchanged by ``cleaned``.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.llm.common import wider

#: Phrases of notices and site furniture, lower case (own list).
BOILERPLATE = (
    "all rights reserved|privacy policy|cookie policy|terms of use|terms of service|terms and conditions|"
    "we use cookies|accept cookies|enable javascript|click here|read more|subscribe to our|sign up for|"
    "log in to|sign in to|share this|follow us on|powered by|back to top|skip to content|"
    "licensed under|released under the|this work is licensed under"
).split("|")
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the document verdict."""

    symbols_per_word: float = 0.3
    marks_per_word: float = 0.3
    upper_share: float = 0.7
    min_upper_words: int = 6
    separator_share: float = 0.25
    distinct_share: float = 0.25
    min_repeat_words: int = 12
    boilerplate_words: int = 30
    lost_percent: int = 30
    min_words: int = 50
    repeat_percent: int = 50


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bad_lines", "n_lost_words")
_MARKS = re.compile(r"[!?]{2,}|\.{4,}|[=_~-]{4,}")
_PHRASE = re.compile("|".join(map(re.escape, BOILERPLATE)))
_SPACE = " \t\n\x0b\x0c\r"
_SEPARATORS = frozenset(("|", "||", "/", "»", "›", "·", "•", "::", ">", "<"))


def line_fault(line: str, words: list[bytes], rules: LineRules) -> str | None:
    """First rule that a line breaks, or None."""
    n = len(words)
    if sum(map(line.count, SYMBOLS)) > rules.symbols_per_word * n:
        bars = sum(w.decode() in _SEPARATORS for w in words)
        return "navigation" if bars > rules.separator_share * n else "symbols"
    if not line.isalnum() and len(_MARKS.findall(line)) > rules.marks_per_word * n:
        return "punctuation"
    if n >= 4 and sum(w.decode() in _SEPARATORS for w in words if len(w) < 4) > rules.separator_share * n:
        return "navigation"
    if n >= rules.min_upper_words and line[0:1].isupper() and sum(w.decode().isupper() for w in words) > rules.upper_share * n:
        return "shouting"
    if n >= rules.min_repeat_words and len(set(words)) < rules.distinct_share * n:
        return "repetition"
    if n <= rules.boilerplate_words and _PHRASE.search(line.lower()):
        return "boilerplate"
    return None


def judge(text: str | None, rules: LineRules) -> tuple[list[int], str]:
    """Counts in the order of COUNTS and the text without its failing lines."""
    text = text or ""
    data = text.encode()
    words = data.split()  # bytes split at ASCII white space only
    n = len(words)
    repeat = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        seen = Counter(windows)
        if len(seen) < len(windows):
            end = 0  # words before it are counted
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeat += i + 3 - max(end, i)
                    end = i + 3
    kept, earlier = [], set()
    duplicates = bad = lost = 0
    for line in text.split("\n"):
        own = line.encode().split()
        if own:
            again = line in earlier
            earlier.add(line)
            duplicates += again
            if again or line_fault(line, own, rules):
                bad += 1
                lost += len(own)
                continue
        kept.append(line)
    chars = len(text) - sum(map(text.count, _SPACE))
    return [n, chars, sum(map(text.count, SYMBOLS)), duplicates, repeat, bad, lost], "\n".join(kept) if bad else text


def cleaned(docs: DataFrame, rules: LineRules | None = None) -> DataFrame:
    """``docs`` with the counts, base_failed, kept and clean_text, one row each.

    New columns are prefixed ``q_`` and replace older ones of their names.
    """
    rules = rules or LineRules()
    counts, decide = COUNTS, judge

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [decide(t.as_py(), rules) for t in batch.column("__text")]
            arrays = [pa.array([x[0][i] for x in found], pa.int64()) for i in range(len(counts))]
            arrays.append(pa.array([x[1] for x in found], pa.string()))
            names = [f for f in batch.schema.names if f != "__text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f) for f in names], *arrays], names=[*names, *[f"q_{c}" for c in counts], "q_text"]
            )

    docs = docs.drop(*[f"q_{c}" for c in (*counts, "text", "base_failed", "kept")])
    schema = wider(docs, **{f"q_{c}": "long" for c in counts}, q_text="string")
    out = docs.withColumn("__text", F.col("text").cast("string")).mapInArrow(run, schema)
    failed = (F.col("q_n_words") < rules.min_words) | (100 * F.col("q_n_repeat_words") > rules.repeat_percent * F.col("q_n_words"))
    kept = ~failed & (100 * F.col("q_n_lost_words") <= rules.lost_percent * F.col("q_n_words"))
    return out.withColumn("q_base_failed", failed).withColumn("q_kept", kept)
