"""Periodic runs of words: stretches that repeat with a period, found by a suffix automaton with link-cut access.

Words are appended one by one to a suffix automaton. Its suffix links form a tree, on whose paths to the root each node
carries the end at which its strings occurred last; stretches of equal ends are preferred paths, held in splay trees. An
appended word accesses the path of the new prefix and recolours it. A path segment that ended at e before and now ends
at i says that its longest string, of some length, occurs at both ends: if the distance i - e is at most that length, the
two occurrences are a square of period i - e, which can't be lengthened to the left. Where the next word breaks the
period it is a maximal run. No word is compared with another but at the ends of runs.

A run of period q shows ``ratio - 1`` periods or so of positions at which three words have occurred at most q words
before (fewer words, where runs can be shorter). Arrays find those stretches for all periods up to a power of two at a time; only what they cover goes through
the automaton, and a run lies within one such part as a whole.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text; rows with a null id are read as
any others (``rewrite`` is told None); repeated rows each give a row; extra columns are carried only by name in ``keep``,
and the operator's own columns win over names that clash; an empty table gives an empty result. A text is held by one
task, as rows are; where nearly all of it is periodic the automaton takes about a kilobyte a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Words that are looked through at once, or one text's, if it has more.
CHUNK_WORDS = 1 << 19
GRAM = 3
RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])

Run = tuple[int, int, int]


class RecencyTree:
    """The suffix-link tree as preferred paths in splay trees; the root of each holds the last end of its whole path.

    Node 0 is no node. A left child is nearer to the tree's root; the parent of a splay tree's root is the tree parent of
    the path's top.
    """

    def __init__(self) -> None:
        self.up, self.left, self.right, self.end = [0], [0], [0], [-1]

    def leaf(self, end: int) -> int:
        """A new node on a path of its own, not linked yet."""
        for column, value in ((self.up, 0), (self.left, 0), (self.right, 0), (self.end, end)):
            column.append(value)
        return len(self.up) - 1

    def splay(self, x: int) -> None:
        """Make x the root of its splay tree."""
        up, left, right = self.up, self.left, self.right
        p = up[x]
        if not p or (left[p] != x and right[p] != x):
            return
        while True:
            g = up[p]
            inner = bool(g) and (left[g] == p or right[g] == p)
            top, twice = g if inner else p, False
            if inner:
                if (left[p] == x) == (left[g] == p):  # the parent turns first
                    if left[g] == p:
                        c = left[g] = right[p]
                        right[p] = g
                    else:
                        c = right[g] = left[p]
                        left[p] = g
                    if c:
                        up[c] = g
                    above = up[p] = up[g]
                    up[g] = p
                    if above:
                        if left[above] == g:
                            left[above] = p
                        elif right[above] == g:
                            right[above] = p
                else:
                    twice = True
            # x turns over p.
            above = up[p]
            if left[p] == x:
                c = left[p] = right[x]
                right[x] = p
            else:
                c = right[p] = left[x]
                left[x] = p
            if c:
                up[c] = p
            up[p], up[x] = x, above
            if above:
                if left[above] == p:
                    left[above] = x
                elif right[above] == p:
                    right[above] = x
            if twice:  # and then over g
                p = g
                above = up[p]
                if left[p] == x:
                    c = left[p] = right[x]
                    right[x] = p
                else:
                    c = right[p] = left[x]
                    left[x] = p
                if c:
                    up[c] = p
                up[p], up[x] = x, above
                if above:
                    if left[above] == p:
                        left[above] = x
                    elif right[above] == p:
                        right[above] = x
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                self.end[x] = self.end[top]
                return

    def insert_above(self, x: int) -> int:
        """A new node between x and its tree parent, on the path of x."""
        self.splay(x)
        new = self.leaf(-1)
        low = self.left[new] = self.left[x]
        if low:
            self.up[low] = new
        self.left[x] = new
        self.up[new] = x
        return new

    def access(self, x: int, end: int) -> list[tuple[int, int]]:
        """Recolour the path from x to the root with end; (lowest node, its end before) of each segment, from below."""
        up, right, ends, found, below = self.up, self.right, self.end, [], 0
        while x:
            self.splay(x)
            e = ends[x]
            found.append((x, e))
            if right[x]:
                ends[right[x]] = e
            right[x] = below
            below, x = x, up[x]
        ends[below] = end
        return found


def periodic_runs(words: list[int], ratio: int = 4, least: int = 6) -> list[Run]:
    """(start, length, period) of the maximal runs of at least ratio periods and least words, by start and period."""
    tree, n = RecencyTree(), len(words)
    root = tree.leaf(-1)
    steps: list[dict[int, int]] = [{}, {}]
    length, link = [0, 0], [0, 0]
    last, found = root, []
    for i, w in enumerate(words):
        new = tree.leaf(-1)
        steps.append({})
        length.append(length[last] + 1)
        link.append(root)
        p = last
        while p and w not in steps[p]:
            steps[p][w] = new
            p = link[p]
        if p:
            q = steps[p][w]
            if length[q] != length[p] + 1:
                # q is split: its shorter strings move to a node above it.
                top = tree.insert_above(q)
                steps.append(steps[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = top
                while p and steps[p].get(w) == q:
                    steps[p][w] = top
                    p = link[p]
                q = top
            link[new] = q
        tree.up[new] = link[new]
        last = new
        for node, e in tree.access(new, i):
            if e < 0:
                continue
            period, size = i - e, length[node]
            if size >= (ratio - 1) * period and size + period >= least and (i + 1 == n or words[i + 1] != words[e + 1]):
                found.append((e + 1 - size, size + period, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _stretches(at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each stretch of at least so many consecutive integers in at, which ascends."""
    breaks = np.flatnonzero(np.diff(at) != 1)
    first, last = at[np.concatenate([[0], breaks + 1])], at[np.concatenate([breaks, [len(at) - 1]])]
    long = last - first + 1 >= least
    return first[long], last[long]


def periodic_parts(hashes: np.ndarray, starts: np.ndarray, ratio: int, least: int) -> list[tuple[int, int]]:
    """(from, to) of the parts of several texts, joined, that hold all runs; starts has where each text begins, and the end.

    Words are given by hashes; equal hashes of different words can only add parts.
    """
    n = len(hashes)
    if n < max(least, ratio):
        return []
    # What a run of period q has besides its first period; grams are short enough for one to begin in each.
    beyond = lambda q: max(least, ratio * q) - q
    gram = min(GRAM, *(beyond(q) for q in range(1, least + 1)))
    bits = max(1, int(n).bit_length())
    text = np.repeat(np.arange(len(starts) - 1, dtype=np.uint64), np.diff(starts))
    key = text * np.uint64(0xC2B2AE3D27D4EB4F)
    for k in range(gram):
        key = (key ^ np.roll(hashes, -k)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    place = np.arange(n, dtype=np.uint64)
    key = np.sort((key << np.uint64(bits)) | place)
    where = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
    same = np.flatnonzero(key[1:] >> np.uint64(bits) == key[:-1] >> np.uint64(bits))
    distance = np.zeros(n, np.int64)
    distance[where[same + 1]] = where[same + 1] - where[same]
    for k in range(1, gram):  # a gram ends with its text
        ends = starts[1:] - k
        distance[ends[ends >= starts[:-1]]] = 0
    need = lambda low, high: min(beyond(q) for q in range(low, min(high, low + least) + 1)) - gram + 1
    at = np.flatnonzero(distance)
    if not len(at):
        return []
    first, last = _stretches(at, need(1, least))
    if not len(first):
        return []
    longest = int((last - first).max()) + 1
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, first, 1)
    np.add.at(inside, last + 1, -1)
    at = np.flatnonzero(np.cumsum(inside)[:-1])
    distance, parts, most = distance[at], [], 1
    while most < 2 * least or need(most // 2 + 1, most) <= longest:
        near = at[distance <= most]
        if len(near):
            first, last = _stretches(near, need(most // 2 + 1, most))
            own = np.searchsorted(starts, first, side="right") - 1
            parts += zip(np.maximum(first - most, starts[own]), np.minimum(last + gram, starts[own + 1]), strict=True)
        most *= 2
    merged: list[tuple[int, int]] = []
    for a, b in sorted((int(a), int(b)) for a, b in parts):
        if merged and a < merged[-1][1] and np.searchsorted(starts, a, side="right") == np.searchsorted(starts, merged[-1][0], side="right"):
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def runs_of_texts(texts: list[list[bytes]], ratio: int = 4, least: int = 6) -> list[list[Run]]:
    """The runs of each of several texts, given as words."""
    starts = np.concatenate([[0], np.cumsum([len(x) for x in texts], dtype=np.int64)]).astype(np.int64)
    hashes = np.fromiter((hash(w) for x in texts for w in x), np.int64, int(starts[-1])).view(np.uint64)
    out: list[list[Run]] = [[] for _ in texts]
    for a, b in periodic_parts(hashes, starts, ratio, least):
        k = int(np.searchsorted(starts, a, side="right")) - 1
        low = a - int(starts[k])
        names: dict[bytes, int] = {}
        part = [names.setdefault(w, len(names)) for w in texts[k][low : b - int(starts[k])]]
        out[k] += [(start + low, size, period) for start, size, period in periodic_runs(part, ratio, least)]
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, size, period in runs:
        gone[start + period] += 1
        gone[start + size] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0)])


def _chunks(texts: Iterable[list[bytes]]) -> Iterator[list[list[bytes]]]:
    chunk: list[list[bytes]] = []
    size = 0
    for words in texts:
        if chunk and size + len(words) > CHUNK_WORDS:
            yield chunk
            chunk, size = [], 0
        chunk.append(words)
        size += len(words)
    if chunk:
        yield chunk


def find_runs(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    keep: tuple[str, ...] = (),
    ratio: int = 4,
    least: int = 6,
    rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """id_col and keep, with n_words, runs (array of start, length and period) and collapsed (the text without repeats).

    Runs have at least ratio periods (2 or more) and least words. rewrite changes a text's words, given the id, beforehand.
    """
    if ratio < 2:
        raise ValueError("a run has two periods at least")
    own = [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(RUN, False)),
        T.StructField("collapsed", T.StringType()),
    ]
    fields = [df.schema[c] for c in dict.fromkeys((id_col, *keep)) if c not in {f.name for f in own}]
    schema = T.StructType([*fields, *own])
    names, at = schema.names, next((i for i, f in enumerate(fields) if f.name == id_col), None)
    shape = pa.list_(pa.field("element", pa.struct([pa.field(c, pa.int64(), False) for c in RUN.names]), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(batch.num_columns - 1).cast(pa.binary())
            ids = batch.column(at).to_pylist() if rewrite and at is not None else [None] * batch.num_rows
            words = ((x.as_py() or b"").split() for x in raw)
            done = 0
            for chunk in _chunks(rewrite(i, w) if rewrite else w for i, w in zip(ids, words, strict=True)):
                runs = runs_of_texts(chunk, ratio, least)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.slice(done, len(chunk)) for c in batch.columns[:-1]),
                        pa.array([len(w) for w in chunk], pa.int64()),
                        pa.array([[dict(zip(RUN.names, r, strict=True)) for r in x] for x in runs], shape),
                        pa.array([collapsed(w, r) for w, r in zip(chunk, runs, strict=True)], pa.binary()).cast(pa.string()),
                    ],
                    names=names,
                )
                done += len(chunk)

    # Numbered names can't clash with one another.
    read = [*(f.name for f in fields), text_col]
    return df.select(*(df[c].alias(str(i)) for i, c in enumerate(read))).mapInArrow(run, schema)
