"""Substring dedup (operator 5): suffix automata of reference shards.

A word is removed when a window of ``WINDOW`` consecutive words covers it
whose word sequence also starts in a document with a smaller ``doc_id``.

All documents are the reference, so its automata grow with the corpus and are
not broadcast.  Instead each shard of the reference meets the text that can
match it in one task: a window is routed by its *anchor*, the smallest hash
among its ``ANCHOR`` -word parts.  Equal windows have equal anchors.  The
windows of a document with one anchor form a segment, six windows on average.
A segment is shuffled as one code byte for each word and ``CHECK`` bytes of a
strong hash for each window.

Within an anchor's group segments come in ascending ``doc_id``.  They are
streamed through a suffix automaton of the segments of smaller documents.
Where the matching statistic reaches ``WINDOW``, the state of the last
``WINDOW`` codes holds the hashes of the windows that were read with these
codes, and the window is a repeat if its own is one of them (one byte does not
tell a changed word from the old one for certain: a window counts as equal by
13 code bytes, its 64-bit anchor and its own hash).  Then the document's own
segments extend the automaton.  A segment that equals an earlier one needs no
second pass, and a group that holds a single segment text needs no automaton.

Hot anchors (a passage in a large share of all documents; the most frequent
of a sample of documents, a list of at most ``HOT_ANCHORS``) are salted by
document.  Each salt resolves its own documents; the first occurrence of every
window within its salt goes on to a second round, grouped by the window's
content, that resolves them between salts.  The list only decides how the
work is dealt out, never the result.

Special cases: null text has no words, texts under ``WINDOW`` words keep all,
rows of equal ``doc_id`` do not remove each other's words, a null ``doc_id``
counts as larger than all others (rows of one or no ``doc_id`` are told apart
by 88 bits of two hashes of their text), an empty table gives an empty result,
columns of the input that clash with the result's are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recentlake.llm.common import mix64, release, run_hashes, runs, saved, spread, text_blocks, windows

WINDOW = 13
ANCHOR = 3
#: Bytes of a window's own hash.
CHECK = 3
#: Windows in a segment at most: longer runs of one anchor are cut.
SEGMENT_WINDOWS = 64
HOT_ANCHORS = 4096
HOT_SAMPLE = 64
HOT_LEAST = 8
SALTS = 64
#: Rows handled at once.
GROUP_ROWS = 50_000
LAST_ID = (1 << 63) - 1

_PACK = "place"  # start, number of windows and the row's mark in one long
_MARK_BITS = 24


def row_tag():
    """Tells rows of one ``doc_id`` apart by their text, with ``row_mark``."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def row_mark():
    """More bits of another hash, which fit into the place."""
    return F.hash(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").bitwiseAND(F.lit((1 << _MARK_BITS) - 1))


# -- segments ---------------------------------------------------------------------


def _slide_min(values: np.ndarray, size: int) -> np.ndarray:
    out, step = values, 1
    while step * 2 <= size:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = size - step
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def segments(data: np.ndarray, offs: np.ndarray):
    """``row, anchor, start word, windows, codes`` of a block of texts."""
    starts, ends, firsts = runs(data, offs)
    hashes = run_hashes(data, starts, ends)
    n = len(hashes)
    if n < WINDOW:
        return None
    parts, _ = windows(hashes, firsts, ANCHOR)
    low = _slide_min(parts[:n - ANCHOR + 1], WINDOW - ANCHOR + 1)
    counts = np.diff(firsts)
    left = np.repeat(firsts[1:], counts) - np.arange(n)
    at = np.flatnonzero(left[:len(low)] >= WINDOW)
    if not len(at):
        return None
    row = np.repeat(np.arange(len(counts)), counts)[at]
    anchor = low[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    run = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    begin = np.flatnonzero(run % SEGMENT_WINDOWS == 0)
    size = np.diff(np.append(begin, len(at)))
    first = at[begin]
    # Codes of the words, then checks of the windows.
    codes = (hashes >> np.uint64(17)).astype(np.uint8)
    whole, _ = windows(hashes, firsts, WINDOW)
    checks = whole.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CHECK].ravel()
    sizes = np.column_stack([size + WINDOW - 1, size * CHECK]).ravel()
    froms = np.column_stack([first, len(codes) + first * CHECK]).ravel()
    ends = np.cumsum(sizes)
    at = np.repeat(froms - (ends - sizes), sizes) + np.arange(int(ends[-1]))
    column = pa.Array.from_buffers(pa.binary(), len(first), [
        None, pa.py_buffer(np.concatenate([[0], ends[1::2]]).astype(np.int32)), pa.py_buffer(np.concatenate([codes, checks])[at])])
    return row[begin], anchor[begin], first - firsts[row[begin]], size, column


def split_codes(codes: bytes) -> tuple[bytes, list[bytes]]:
    """Word codes of a segment, and the check of each of its windows."""
    n = (len(codes) - WINDOW + 1) // (CHECK + 1)
    words, checks = codes[:n + WINDOW - 1], codes[n + WINDOW - 1:]
    return words, [checks[CHECK * k:CHECK * (k + 1)] for k in range(n)]


_SEGMENTS = f"anchor bigint, doc_id bigint, tag bigint, {_PACK} bigint, codes binary"
_SEGMENT_NAMES = ["anchor", "doc_id", "tag", _PACK, "codes"]


def emit_segments(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """All segments; those of ``hot`` anchors have their document's salt mixed
    into the anchor and are marked by a negative doc_id bit (see ``salted``)."""
    picked = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id"), row_tag().alias("tag"),
        row_mark().alias("mark"), F.col("text").cast("string").alias("text"))
    hot = np.sort(hot)

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"))
            tags, marks = np.asarray(batch.column("tag")), np.asarray(batch.column("mark"))
            for lo, _, data, offs in text_blocks(batch.column("text")):
                found = segments(data, offs)
                if found is None:
                    continue
                row, anchor, start, size, codes = found
                doc = ids[lo + row]
                salted = np.zeros(len(anchor), bool)
                if len(hot):
                    at = np.searchsorted(hot, anchor)
                    salted = hot[np.minimum(at, len(hot) - 1)] == anchor
                    salt = mix64(doc.view(np.uint64) + np.uint64(1)) % np.uint64(SALTS) + np.uint64(1)
                    anchor = np.where(salted, mix64(anchor + salt), anchor)
                place = (marks[lo + row] << 39) | (size << 32) | start
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(doc), pa.array(tags[lo + row]), pa.array(place), codes, pa.array(salted)],
                    [*_SEGMENT_NAMES, "salted"])

    return picked.mapInArrow(run, _SEGMENTS + ", salted boolean")


def hot_anchors(docs: DataFrame) -> np.ndarray:
    """The most frequent anchors in a sample of the documents (by ``doc_id``)."""
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(HOT_SAMPLE)) == 0)
    counts = emit_segments(sample, np.zeros(0, np.uint64)).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    top = counts.where(F.col("n") >= HOT_LEAST).orderBy(F.desc("n"), "anchor").limit(HOT_ANCHORS)
    return np.array([r["anchor"] for r in top.select("anchor").collect()], np.int64).view(np.uint64)  # at most HOT_ANCHORS


# -- suffix automata --------------------------------------------------------------


class SuffixAutomaton:
    """Of the code strings added so far, with the checks of their windows.

    The windows of one string of ``WINDOW`` codes are those of one state: the
    highest one that is as long.  ``checks`` has the hashes of its windows."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.size = [0]
        self.checks: dict[int, set[bytes]] = {}

    def _window_state(self, state: int) -> int:
        """The state of the last ``WINDOW`` codes of a longer match at ``state``."""
        link, size = self.link, self.size
        while size[link[state]] >= WINDOW:
            state = link[state]
        return state

    def add(self, text: bytes, checks: list[bytes]) -> None:
        """``checks`` has the hash of each window of ``text``."""
        nxt, link, size = self.next, self.link, self.size
        last = 0
        for place, c in enumerate(text, 1 - WINDOW):
            if c in nxt[last]:
                q = nxt[last][c]
                if size[q] == size[last] + 1:
                    last = q
                else:
                    clone = self._clone(q, size[last] + 1)
                    p = last
                    while p != -1 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    last = clone
            else:
                new = len(nxt)
                nxt.append({})
                size.append(size[last] + 1)
                link.append(0)
                p = last
                while p != -1 and c not in nxt[p]:
                    nxt[p][c] = new
                    p = link[p]
                if p != -1:
                    q = nxt[p][c]
                    if size[q] == size[p] + 1:
                        link[new] = q
                    else:
                        clone = self._clone(q, size[p] + 1)
                        while p != -1 and nxt[p].get(c) == q:
                            nxt[p][c] = clone
                            p = link[p]
                        link[new] = clone
                last = new
            if place >= 0:
                self.checks.setdefault(self._window_state(last), set()).add(checks[place])

    def _clone(self, q: int, size: int) -> int:
        """A copy of state ``q`` for its strings up to ``size``, above it."""
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.size.append(size)
        self.link.append(self.link[q])
        self.link[q] = new
        if size >= WINDOW and q in self.checks:
            self.checks[new] = self.checks.pop(q)  # the string of WINDOW codes is a string of the copy now
        return new

    def matches(self, text: bytes, checks: list[bytes]) -> list[bool]:
        """For each window of ``text``: whether an added string has it."""
        nxt, link, size = self.next, self.link, self.size
        state = length = 0
        out = []
        for place, c in enumerate(text, 1 - WINDOW):
            while state and c not in nxt[state]:
                state = link[state]
                length = size[state]
            to = nxt[state].get(c)
            if to is not None:
                state, length = to, length + 1
            if place >= 0:
                out.append(length >= WINDOW and checks[place] in self.checks.get(self._window_state(state), ()))
        return out


class GroupReader:
    """Segments of one anchor in ascending doc_id: which windows repeat."""

    def __init__(self):
        self.automaton: SuffixAutomaton | None = None
        self.known: set[bytes] = set()  # whole segments of smaller documents
        self.doc: int | None = None
        self.held: list[bytes] = []

    def read(self, doc: int, codes: bytes) -> list[bool] | bool:
        """For each window whether a smaller document has it; True for all."""
        if doc != self.doc:
            for segment in self.held:
                if segment not in self.known:
                    if self.automaton is None:
                        self.automaton = SuffixAutomaton()
                    self.automaton.add(*split_codes(segment))
                    self.known.add(segment)
            self.doc, self.held = doc, []
        if codes in self.known:
            return True
        found: list[bool] | bool = False
        if self.automaton is not None:
            found = self.automaton.matches(*split_codes(codes))
            if all(found):
                return True
        self.held.append(codes)
        return found


# -- resolving ---------------------------------------------------------------------


def _resolve(anchor, doc, tag, place, codes: pa.Array, salted, reader: dict):
    """Repeats ``(doc, tag, place)`` among the rows, sorted by anchor and doc,
    and windows that go on to the second round ``(doc, tag, place, codes)``.

    ``reader`` holds the state of a group cut by the end of the rows."""
    n = len(anchor)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    sizes = np.diff(np.append(first, n))
    group = np.repeat(np.arange(len(first)), sizes)
    offsets = np.frombuffer(codes.buffers()[1], np.int32)[codes.offset:codes.offset + n + 1].astype(np.int64)
    data = np.frombuffer(codes.buffers()[2], np.uint8)
    text = run_hashes(data, offsets[:-1], offsets[1:])
    several = np.maximum.reduceat(doc, first) > np.minimum.reduceat(doc, first)
    mixed = np.maximum.reduceat(text, first) > np.minimum.reduceat(text, first)
    walk = salted[first] | (several & mixed)
    walk[-1] = True  # the last group may go on in the next rows
    if reader.get("anchor") is not None and reader["anchor"] == anchor[0]:
        walk[0] = True
    plain = (several & ~walk)[group] & (doc > np.minimum.reduceat(doc, first)[group])
    more: list[tuple[int, int, int, bytes]] = []
    out: list[tuple[int, int, int]] = []
    for g in np.flatnonzero(walk).tolist():
        lo, hi = int(first[g]), int(first[g] + sizes[g])
        if reader.get("anchor") != anchor[lo]:
            reader["anchor"], reader["group"] = anchor[lo], GroupReader()
        own = reader["group"]
        for d, t, p, c, on in zip(doc[lo:hi].tolist(), tag[lo:hi].tolist(), place[lo:hi].tolist(), codes[lo:hi].to_pylist(),
                                  salted[lo:hi].tolist(), strict=True):
            found = own.read(d, c)
            if found is True:
                out.append((d, t, p))
                continue
            if not (found and any(found) or on):
                continue
            start, mark = p & 0xFFFFFFFF, p >> 39
            words, checks = split_codes(c)
            for k, check in enumerate(checks):
                one = mark << 39 | 1 << 32 | (start + k)
                if found and found[k]:
                    out.append((d, t, one))
                elif on:
                    more.append((d, t, one, words[k:k + WINDOW] + check))
    walked = np.array(out, np.int64).reshape(len(out), 3)
    return [np.concatenate([x[plain], walked[:, k]]) for k, x in enumerate((doc, tag, place))], more


def _repeats(rows: DataFrame) -> DataFrame:
    """``doc_id, tag, place`` of the repeats, and with ``codes`` the windows of
    salted groups that are the first of theirs."""
    dealt = rows.repartition(spread(rows.sparkSession), "anchor").sortWithinPartitions("anchor", "doc_id")

    def run(batches):
        held, size, reader = [], 0, {}

        def flush():
            table = pa.Table.from_batches(held).combine_chunks()
            columns = [np.asarray(table.column(c)) for c in ("anchor", "doc_id", "tag", _PACK)]
            found, more = _resolve(*columns, table.column("codes").combine_chunks(), np.asarray(table.column("salted")), reader)
            codes = [None] * len(found[0]) + [m[3] for m in more]
            if codes:
                own = [np.concatenate([x, np.array([m[k] for m in more], np.int64)]) for k, x in enumerate(found)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, own), pa.array(codes, pa.binary())], ["doc_id", "tag", _PACK, "codes"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= GROUP_ROWS:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return dealt.mapInArrow(run, f"doc_id bigint, tag bigint, {_PACK} bigint, codes binary")


def repeated_places(docs: DataFrame) -> DataFrame:
    """``doc_id, tag, mark, spans``: for each text with repeats the packed
    starts and numbers of its repeated windows.

    Rows of one id and text have one list: it is a set, combined map-side, so
    that any number of them gives a list as long as one text's."""
    hot = hot_anchors(docs)
    place = ("doc_id", "tag", _PACK)
    first = _repeats(emit_segments(docs, hot))
    found = first.where(F.col("codes").isNull()).select(*place)
    if len(hot):
        first = saved(first, "repeats")
        release(docs.sparkSession)  # the shuffled segments, twice as large as the texts
        again = first.where(F.col("codes").isNotNull()).select(
            F.xxhash64("codes").alias("anchor"), *place, "codes", F.lit(False).alias("salted"))
        found = first.where(F.col("codes").isNull()).select(*place).unionByName(_repeats(again).select(*place))
    return found.groupBy("doc_id", "tag", F.shiftright(_PACK, 39).alias("mark")).agg(
        F.collect_set(F.col(_PACK).bitwiseAND(F.lit((1 << 39) - 1))).alias("spans"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text``: the words
    that are left, joined by one space."""
    spans = repeated_places(docs).select(F.col("doc_id").alias("__d"), F.col("tag").alias("__t"), F.col("mark").alias("__m"), "spans")
    added = ("n_words", "n_removed", "kept_text")
    kept = [c for c in docs.columns if c not in added]
    keyed = docs.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("__id"),
                        row_tag().alias("__tag"), row_mark().alias("__mark"))
    same = (F.col("__id") == F.col("__d")) & (F.col("__tag") == F.col("__t")) & (F.col("__mark") == F.col("__m"))
    joined = keyed.join(spans, same, "left") \
        .select(*(F.col(f"`{c}`") for c in kept), F.col("text").cast("string").alias("__text"), F.col("spans").alias("__spans"))
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "n_words bigint, n_removed bigint, kept_text string"])

    def run(batches):
        for batch in batches:
            texts = batch.column(len(kept)).cast(pa.binary()).to_pylist()
            spans = batch.column(len(kept) + 1)
            words, removed, left = [], [], []
            for k, text in enumerate(texts):
                split = text.split() if text else []
                gone = 0
                if split and spans[k].is_valid:
                    packed = np.asarray(spans[k].values)
                    marks = np.zeros(len(split) + 1, np.int64)
                    start = packed & 0xFFFFFFFF
                    np.add.at(marks, start, 1)
                    np.add.at(marks, start + (packed >> 32) + WINDOW - 1, -1)
                    keep = np.cumsum(marks[:-1]) == 0
                    gone = len(split) - int(keep.sum())
                    split = [split[i] for i in np.flatnonzero(keep).tolist()]
                words.append(len(split) + gone)
                removed.append(gone)
                left.append(b" ".join(split))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(len(kept))), pa.array(words, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(left, pa.binary()).cast(pa.string())], [*kept, *added])

    return joined.mapInArrow(run, schema)


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with repeats cut from ``text`` and ``n_chars`` counted anew;
    texts without repeats keep their white space too."""
    left = without_repeats(docs)
    changed = F.col("n_removed") > 0
    kind = dict(docs.dtypes)["n_chars"]
    return left.withColumn("text", F.when(changed, F.col("kept_text")).otherwise(F.col("text"))) \
        .withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(kind)) \
        .select(*(F.col(f"`{c}`") for c in docs.columns))
