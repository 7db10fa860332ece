"""Periodic run detection (operator 13): a suffix automaton whose suffix-link
tree is a link-cut tree.

A run is a longest stretch of words with smallest period q that repeats its
first q words at least ``MIN_TURNS`` times and has ``MIN_WORDS`` words or more.

The automaton reads a word at a time.  Each state has a colour, the last
position at which its strings end; states of one colour that lie on a line
towards the root form a segment, kept as one splay tree.  An appended word
recolours all states between its own and the root (the link-cut tree's
*access*), which meets each old segment once, O(log n) of them on average:

* a segment of colour e holds suffixes of the text read so far whose lengths
  lie in (lo, hi], and which ended at e before they now end at i;
* for p = i - e with lo < p <= hi the last p words also end at e = i - p: a
  square of period p.  p > lo says that these p words did not end between e
  and i, so they are no power of a shorter word, and p is the square's
  smallest period;
* every square whose half is no power appears so at its last word.  The first
  square of a run is extended to both sides; later squares of the period that
  end inside it are skipped.

Words that no run can hold are passed over without an automaton: in a run
every ``PROBE`` consecutive words come again one period on, within the run
(it has at least PROBE words besides two periods, see ``_candidates``).  So a
word that lies in no repeated window of ``PROBE`` words of its document is in
no run, and each stretch of the other words is read alone; a maximal run
never reaches beyond its stretch.  Equal hashes of different windows only make
a stretch longer, words in a stretch are compared as bytes.

One row is one document and nothing is shuffled.  Time is O(n log^2 n) in the
longest stretch at worst, memory is that of one stretch's automaton.

Special cases: null, empty and blank texts have no words, no runs and the
empty collapsed text.  Equal rows give equal results.  Rows are told apart by
nothing but their place, so null or repeated ids do not matter.  Columns
named like the results (``n_words``, ``runs``, ``collapsed_text``) are
replaced, all others are kept.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recentlake.llm.common import mix64, run_hashes, runs, text_blocks, windows, words_column

MIN_WORDS = 24
MIN_TURNS = 3
#: Words of the windows that a run must repeat.  A run of length L and period
#: q has L - PROBE + 1 >= 2 q of them: L >= max(24, 3 q) gives L - 2 q >= 8.
PROBE = 9

RUN_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"
RESULTS = ("n_words", "runs", "collapsed_text")


# -- runs of one sequence ------------------------------------------------------


class _Automaton:
    """Suffix automaton of the words read so far, its links as splay trees.

    State 0 is the root (the empty word) and is left out of the trees.  Per
    state: ``length`` and ``link`` of the automaton, ``first_word`` /
    ``first_to`` for its first transition and ``more`` for any others, and
    ``left``, ``right``, ``above`` of its splay tree, ordered by length.
    ``above`` of a splay root is the link of its shortest state; ``colour`` is
    that of the whole tree and held at its root.
    """

    def __init__(self):
        self.length, self.link, self.first_word, self.first_to = [0], [0], [-1], [0]
        self.more: dict[int, dict[int, int]] = {}
        self.left, self.right, self.above, self.colour = [0], [0], [0], [-1]
        self.last = 0

    def _state(self, length: int, link: int, colour: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.first_word.append(-1)
        self.first_to.append(0)
        self.left.append(0)
        self.right.append(0)
        self.above.append(link)
        self.colour.append(colour)
        return len(self.length) - 1

    def _target(self, state: int, word: int) -> int:
        """The state after ``word``, or -1."""
        if self.first_word[state] == word:
            return self.first_to[state]
        others = self.more.get(state)
        return others.get(word, -1) if others else -1

    def _lead(self, state: int, word: int, to: int) -> None:
        if self.first_word[state] in (-1, word):
            self.first_word[state], self.first_to[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def _splay(self, x: int) -> None:
        """Make ``x`` the root of its tree."""
        left, right, above = self.left, self.right, self.above

        def is_left(node: int, parent: int) -> bool:
            return left[parent] == node

        def rises(node: int) -> None:
            parent = above[node]
            top = above[parent]
            if left[parent] == node:
                child = left[parent] = right[node]
                right[node] = parent
            else:
                child = right[parent] = left[node]
                left[node] = parent
            if child:
                above[child] = parent
            above[parent] = node
            above[node] = top
            if top:
                if left[top] == parent:
                    left[top] = node
                elif right[top] == parent:
                    right[top] = node

        while True:
            parent = above[x]
            if not parent or (left[parent] != x and right[parent] != x):
                return
            top = above[parent]
            if not top or (left[top] != parent and right[top] != parent):
                self.colour[x] = self.colour[parent]
                rises(x)
                return
            held = self.colour[top]
            rises(parent if is_left(x, parent) == is_left(parent, top) else x)
            rises(x)
            self.colour[x] = held

    def append(self, word: int, at: int) -> list[int]:
        """Read ``word`` at position ``at``; the smallest periods of squares
        that end there, larger ones first."""
        length, link = self.length, self.link
        new = self._state(length[self.last] + 1, 0, -1)
        p, self.last = self.last, new
        q = -1
        while True:
            q = self._target(p, word)
            if q >= 0:
                break
            self._lead(p, word, new)
            if not p:
                break
            p = link[p]
        if q >= 0:
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                link[new] = self._split(p, word, q)
        self.above[new] = link[new]
        return self._access(new, at)

    def _split(self, p: int, word: int, q: int) -> int:
        """The shorter strings of state ``q`` as a state of their own, set
        just before it in its splay tree: both have one colour."""
        self._splay(q)
        before = self.left[q]
        copy = self._state(self.length[p] + 1, self.link[q], -1)
        self.first_word[copy], self.first_to[copy] = self.first_word[q], self.first_to[q]
        if q in self.more:
            self.more[copy] = dict(self.more[q])
        self.link[q] = copy
        self.left[copy], self.left[q], self.above[copy] = before, copy, q
        if before:
            self.above[before] = copy
        while self._target(p, word) == q:
            self._lead(p, word, copy)
            if not p:
                break
            p = self.link[p]
        return copy

    def _access(self, x: int, at: int) -> list[int]:
        """Recolour the states from ``x`` up to the root with ``at``."""
        squares, below = [], 0
        length, right, above, colour = self.length, self.right, self.above, self.colour
        while x:
            self._splay(x)
            old, up = colour[x], above[x]
            if old >= 0 and length[up] < at - old <= length[x]:
                squares.append(at - old)
            rest = right[x]
            if rest:
                colour[rest] = old  # longer strings that do not end here
            right[x] = below
            below, x = x, up
        colour[below] = at
        return squares


def sequence_runs(words: list[int]) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of ``words``, by start, then period."""
    n, found = len(words), []
    covered: dict[int, int] = {}  # period -> end of its last run of any length
    automaton = _Automaton()
    for i, word in enumerate(words):
        for q in automaton.append(word, i):
            if covered.get(q, 0) > i:
                continue
            start, end = i - 2 * q + 1, i + 1
            while start and words[start - 1] == words[start - 1 + q]:
                start -= 1
            while end < n and words[end] == words[end - q]:
                end += 1
            covered[q] = end
            if end - start >= max(MIN_WORDS, MIN_TURNS * q):
                found.append((start, end - start, q))
    return sorted((start, size, q) for start, size, q in found)


# -- documents -------------------------------------------------------------------


def _candidates(hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words that repeated windows of
    ``PROBE`` words of one document cover, of ``MIN_WORDS`` words at least."""
    at, whole = windows(hashes, firsts, PROBE)
    row = np.repeat(np.arange(len(firsts) - 1, dtype=np.uint64), np.diff(firsts))
    where = np.flatnonzero(whole)
    key = mix64(at[where] ^ (row[where] * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    again = np.zeros(len(key), bool)
    again[1:] |= same
    again[:-1] |= same
    edge = np.zeros(len(hashes) + 1, np.int32)
    begin = where[order[again]]
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + PROBE, -1)
    covered = np.cumsum(edge[:-1]) > 0
    opens = covered.copy()
    opens[1:] &= ~covered[:-1]
    opens[firsts[:-1][firsts[:-1] < len(hashes)]] |= covered[firsts[:-1][firsts[:-1] < len(hashes)]]
    starts = np.flatnonzero(opens)
    stops = np.flatnonzero(~covered)
    ends = np.append(stops, len(hashes))[np.searchsorted(stops, starts)]
    ends = np.minimum(ends, np.append(starts[1:], len(hashes)))
    long = ends - starts >= MIN_WORDS
    return starts[long], ends[long]


def _collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run has after its first period."""
    parts, at = [], 0
    for start, end in sorted((s + q, s + size) for s, size, q in found):
        if end > at:
            parts += words[at:max(at, start)]
            at = end
    return b" ".join(parts + words[at:])


def text_runs(column: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """Number of words, runs and collapsed text of each text in turn."""
    for lo, hi, data, offs in text_blocks(column):
        starts, ends, firsts = runs(data, offs)
        hashes = run_hashes(data, starts, ends)
        begin, stop = _candidates(hashes, firsts)
        bounds = np.searchsorted(begin, firsts)
        content = data.tobytes()
        for r in range(hi - lo):
            words = content[offs[r]:offs[r + 1]].split()
            found = []
            for k in range(bounds[r], bounds[r + 1]):
                first = int(begin[k] - firsts[r])
                stretch = words[first:int(stop[k] - firsts[r])]
                number: dict[bytes, int] = {}
                numbered = [number.setdefault(w, len(number)) for w in stretch]
                found += [(first + s, size, q) for s, size, q in sequence_runs(numbered)]
            yield len(words), found, _collapsed(words, found)


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, its ``runs`` by start, then period, and
    ``collapsed_text``: the words that are left when each run keeps its first
    period only, joined by one space."""
    taken = {c.lower() for c in RESULTS}
    kept = [c for c in docs.columns if c.lower() not in taken]
    # Only the text goes to Python by name; the columns kept come back as they went.
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]),
                        "n_words bigint", f"runs {RUN_TYPE}", "collapsed_text string"])
    run_struct = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, lists, left = [], [], []
            for n, rows, rest in text_runs(batch.column(batch.num_columns - 1)):
                sizes.append(n)
                lists.append([{"start": s, "length": size, "period": q} for s, size, q in rows])
                left.append(rest.decode("utf-8"))
            columns = [*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(lists, run_struct), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *RESULTS])

    return source.mapInArrow(found, schema)


def highest_run(found: str = "runs") -> Column:
    """The run of the greatest exact length / period; the first of equal ones."""
    return F.aggregate(
        F.col(found), F.expr(f"cast(null as struct<start:bigint,length:bigint,period:bigint>)"),
        lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def looped_tails(docs: DataFrame) -> DataFrame:
    """``docs`` with the words of one row in ten made periodic from word a on:
    with h = crc32(decimal doc_id), rows of h % 10 = 0, a = g % n for
    g = floor(h / 10), period 1 + floor((n - a) / (3 + g % 8)).  Other rows,
    rows without words and rows without an id keep their text."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = words_column("text")

    def tail(w: Column) -> Column:
        n = F.size(w).cast("long")
        g = F.floor(h / 10)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(F.concat(
            F.slice(w, F.lit(1), a.cast("int")),
            F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda i: F.element_at(w, (a + i % p + 1).cast("int")))), " ")

    # a one-element array binds the split words to a name: they are cut once
    edited = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, tail(w))), 1)
    return docs.withColumn("text", F.when(h % 10 == 0, F.coalesce(edited, F.col("text"))).otherwise(F.col("text")))
