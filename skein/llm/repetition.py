"""Quality rules by suffix-array repetition.

The words of a text are numbered and its suffixes sorted by prefix doubling (only
suffixes that still tie are sorted again, many texts at once).  The longest common prefix of
neighbours in that order is found only where it can reach ``MIN_REPEAT`` words.  Each suffix
then has the longest word sequence that starts there and occurs elsewhere in the text; these are
the maximal repeats, the intervals of common prefixes.  The union of their spans over the
words is the covered fraction.  A text is rejected if that exceeds ``MAX_COVERED`` or the
longest repeat exceeds ``MAX_LONGEST`` words.

The base rules stand beside it: fewer than 50 words, or more than half of the words inside
3-word windows that occur twice.

Memory is bounded by ``GROUP_WORDS`` words or one text; time is near-linear in the words.
Repeats are found within a text, so nothing is shuffled and copies cannot be hot.

Cases: a null or word-less text has no words and fails the base rule; ties do not arise (equal
suffixes of one text differ in length); null ids stay null; repeated rows give a row each; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import rows_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Fixed value: the symbols that count.
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
#: A repeat counts from this many words on; a power of two.
MIN_REPEAT = 8
MAX_COVERED = 0.30
MAX_LONGEST = 200
GROUP_WORDS = 1 << 18


def suffix_ranks(ids: np.ndarray, end: np.ndarray, levels: tuple[int, ...]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Ranks of all suffixes (0 for the smallest), and for each of ``levels`` the positions whose first that many words recur.

    ``ids`` are word numbers that differ between texts, ``end`` the end of each position's text.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    rank = np.empty(n, np.int64)
    head = np.concatenate([[True], ids[order][1:] != ids[order][:-1]])
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    single = head & np.concatenate([head[1:], [True]])
    active, k, at_level = order[~single], 1, {}
    if 1 in levels:
        at_level[1] = np.sort(active)
    while len(active):
        nxt = active + k
        second = np.where(nxt < end[active], rank[np.minimum(nxt, n - 1)] + 1, 0)
        by = np.lexsort((second, rank[active]))
        active, first, second = active[by], rank[active][by], second[by]
        group = np.concatenate([[True], first[1:] != first[:-1]])
        head = group | np.concatenate([[True], second[1:] != second[:-1]])
        at = np.arange(len(active))
        within = np.maximum.accumulate(np.where(head, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        rank[active] = first + within
        single = head & np.concatenate([head[1:], [True]])
        active, k = active[~single], 2 * k
        if k in levels:
            at_level[k] = np.sort(active)
    return rank, {x: at_level.get(x, np.zeros(0, np.int64)) for x in levels}


def longest_repeats(ids: np.ndarray, end: np.ndarray, rank: np.ndarray, active: np.ndarray, least: int) -> np.ndarray:
    """For each position of ``active`` (those with a repeat of ``least`` words) the longest repeat that starts there."""
    order = active[np.argsort(rank[active])]
    apart = np.flatnonzero(np.diff(rank[order]) != 1)  # neighbours in the whole order have ranks one apart
    before = np.full(len(ids), -1, np.int64)
    before[order[1:]] = order[:-1]
    before[order[apart + 1]] = -1
    best = np.zeros(len(ids), np.int64)
    w, e, prev = ids.tolist(), end.tolist(), before[active].tolist()
    h, last = 0, -2
    for p, q in zip(active.tolist(), prev, strict=True):
        h = max(h - (p - last), 0)  # a common prefix shrinks by one per position at most
        last = p
        if q < 0:
            h = 0
            continue
        most = min(e[p] - p, e[q] - q)
        while h < most and w[p + h] == w[q + h]:
            h += 1
        if h >= least:
            best[p] = max(best[p], h)
            best[q] = max(best[q], h)
    return best[active]


def _spans(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in the union of the spans."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def repetition(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text of words: words in repeated 3-word windows, words covered by repeats, longest repeat."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    n = int(sizes.sum())
    if n == 0:
        zero = np.zeros(len(texts), np.int64)
        return zero, zero, zero
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for words in texts for w in words), np.int64, n)
    text_of = np.repeat(np.arange(len(texts)), sizes)
    ids += text_of * len(number)
    end = np.repeat(np.cumsum(sizes), sizes)
    rank, at = suffix_ranks(ids, end, (2, MIN_REPEAT))
    pairs = at[2]
    pairs = pairs[pairs + 3 <= end[pairs]]
    _, pair = np.unique(ids[pairs] * np.int64(n + 1) + _dense(ids[pairs + 1]), return_inverse=True)
    _, where, count = np.unique(pair * np.int64(n + 1) + _dense(ids[pairs + 2]), return_inverse=True, return_counts=True)
    windows = pairs[count[where] > 1]
    in_windows = _spans(windows, np.full(len(windows), 3), n)
    lengths = longest_repeats(ids, end, rank, at[MIN_REPEAT], MIN_REPEAT)
    covered = _spans(at[MIN_REPEAT], lengths, n)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, text_of[at[MIN_REPEAT]], lengths)
    count_of = lambda mask: np.bincount(text_of[mask], minlength=len(texts))
    return count_of(in_windows), count_of(covered), longest


def _dense(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].astype(np.int64)


def groups(texts: list, most: int = GROUP_WORDS):
    """Runs of word lists of at most ``most`` words together (or one text)."""
    held, size = [], 0
    for words in texts:
        if held and size + len(words) > most:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held


RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The base counts and the verdict for every row, in one pass without a shuffle."""

    def judge(batches):
        for batch in batches:
            for part in rows_of(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                words = [t.encode().split() for t in texts]
                n = np.array([len(w) for w in words], np.int64)
                chars = np.array([len(t) - sum(map(t.count, WHITE)) for t in texts], np.int64)
                symbols = np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64)
                dup = np.array([_repeated_lines(t) for t in texts], np.int64)
                windows, covered, longest = (np.concatenate(x) for x in zip(*map(repetition, groups(words)), strict=True))
                failed = (n < MIN_WORDS) | (100 * windows > MAX_REPEAT_PERCENT * n)
                kept = ~failed & (covered <= max_covered * n) & (longest <= max_longest)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *map(pa.array, (n, chars, symbols, dup, windows, failed, kept, covered, longest))],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(judge, RESULT)


def _repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return len(lines) - len(set(lines))
