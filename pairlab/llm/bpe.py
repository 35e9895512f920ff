"""BPE encoding by a pair occurrence index, and decoding.

``encode_documents`` and ``decode_documents`` are the operators. Each task gathers the distinct pre-tokens it has not
met yet, lays their symbols end to end and keeps, for every mergeable pair, the list of all its positions. Active ranks
are applied in ascending order; a merge updates its neighbours' links and adds their new pairs to the lists of the
ranks they belong to. Positions are checked when a rank is applied, so stale entries cost one comparison.

Defined cases: a null text is encoded as an empty one (no ids); a null id array decodes to an empty text; repeated rows
each give a row; extra input columns are dropped unless named in ``keep``, and the operator's own columns win.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers.pre_tokenizers import ByteLevel

# Fixed value: the pre-token pattern of byte-level BPE vocabularies of this family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters of which Unicode tables of different ages say different things; texts with them are split by tokenizers.
UNSETTLED = regex.compile("[\U00010000-\U0001EFFF\U0001FB00-\U0010FFFF]")

#: Characters handled at a time, and pre-tokens remembered, by one Python worker.
CHUNK_CHARS = 4_000_000
CACHE_WORDS = 250_000
#: Up to so many positions, plain Python is quicker than array operations.
SMALL = 24


#: Rows that are decoded at a time.
ROWS = 500


class Places(dict):
    """Numbers words in the order of their first appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place



def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PairIndexBPE:
    """A byte-level BPE vocabulary in the JSON form of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        chars = byte_chars()
        self.byte_ids = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        born = dict(zip(self.made.tolist()[::-1], range(len(merges) - 1, -1, -1), strict=True))
        for rank, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
            if max(born.get(a, -1), born.get(b, -1)) >= rank:
                raise ValueError(f"merge {rank} uses a symbol that is made later")
        self.left, self.right = left.tolist(), right.tolist()
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        back = {c: b for b, c in chars.items()}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.id_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.id_bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.special.items():
            self.id_bytes[i] = token.encode()
        self.words = regex.compile(PATTERN)
        self.split = ByteLevel(add_prefix_space=False)
        self.cut = regex.compile(
            "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)),
        ) if self.special else None
        self._forget()

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, end to end, and how many each word has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(words) else 0
        # One slot of padding at the end stands for "no neighbour": its symbol is in no pair.
        sym = np.append(self.byte_ids[np.frombuffer(b"".join(words), np.uint8)], -1)
        after = np.arange(1, total + 2)
        before = np.arange(-1, total)
        last = ends[lengths > 0] - 1
        after[last] = total
        before[(ends - lengths)[lengths > 0]] = total
        alive = np.ones(total + 1, bool)
        # For each rank, all positions of its pair: arrays from large steps, single positions from small ones.
        index: dict[int, tuple[list[np.ndarray], list[int]]] = {}
        active: list[int] = []

        def positions(rank: int) -> tuple[list[np.ndarray], list[int]]:
            if rank not in index:
                index[rank] = ([], [])
                heapq.heappush(active, rank)
            return index[rank]

        def add(at: np.ndarray) -> None:
            at = at[at != total]
            follow = after[at]
            if len(at) <= SMALL:
                for p, a, b in zip(at.tolist(), sym[at].tolist(), sym[follow].tolist(), strict=True):
                    if (rank := self.rank_of.get(a << 32 | b)) is not None:
                        positions(rank)[1].append(p)
                return
            rank = self.lookup(sym[at], sym[follow])
            ok = rank >= 0
            at, rank = at[ok], rank[ok]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            starts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            bounds = [0, *starts.tolist(), len(at)]
            for r, i, j in zip(rank[[0, *starts]].tolist(), bounds, bounds[1:], strict=False):
                positions(r)[0].append(at[i:j])

        add(np.arange(total))
        while active:
            rank = heapq.heappop(active)
            a, b = self.left[rank], self.right[rank]
            parts, singles = index.pop(rank)
            at = np.concatenate([*parts, np.array(singles, np.int64)])
            at = at[alive[at] & (sym[at] == a)]
            at = np.unique(at) if len(at) > 1 else at
            follow = after[at]
            ok = sym[follow] == b
            at, follow = at[ok], follow[ok]
            if a == b and len(at) > 1:  # in a run of one symbol, pairs are taken from the left
                taken, used = [], -1
                for i, (p, q) in enumerate(zip(at.tolist(), follow.tolist(), strict=True)):
                    if p != used:
                        taken.append(i)
                        used = q
                at, follow = at[taken], follow[taken]
            if not len(at):
                continue
            sym[at] = self.made[rank]
            alive[follow] = False
            beyond = after[follow]
            after[at] = beyond
            before[beyond] = at
            add(np.concatenate([at, before[at]]))
        keep = alive[:total]
        counts = np.concatenate([[0], np.cumsum(keep)])
        return sym[:total][keep].astype(np.uint32), np.diff(counts[np.concatenate([[0], ends])])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; strings of special tokens in a text become those tokens."""
        return [ids for part in chunks(texts) for ids in self._encode(part)]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > CACHE_WORDS:
            self._forget()
        place, old = self.known.__getitem__, len(self.known)
        pieces: list[np.ndarray] = []
        for text in texts:
            find = self._library_words if UNSETTLED.search(text) else self.words.findall
            if self.cut and self.cut.search(text):
                at, found = 0, []
                for m in self.cut.finditer(text):
                    found += [*find(text[at : m.start()]), m[0]]
                    at = m.end()
                found += find(text[at:])
            else:
                found = find(text)
            pieces.append(np.fromiter(map(place, found), np.int32, len(found)))
        if len(self.known) > old:
            flat, counts = self.merge_words([w.encode() for w in itertools.islice(self.known, old, None)])
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
            self.flat, self.counts = np.concatenate([self.flat, flat]), np.concatenate([self.counts, counts])
        out = []
        for piece in pieces:
            counts = self.counts[piece]
            ends = np.cumsum(counts)
            total = int(ends[-1]) if len(ends) else 0
            out.append(self.flat[np.repeat(self.starts[piece] - ends + counts, counts) + np.arange(total)])
        return out

    def _library_words(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.split.pre_tokenize_str(text)]

    def _forget(self) -> None:
        """Start again with the special tokens alone."""
        self.known = Places(zip(self.special, range(len(self.special)), strict=False))
        self.flat = np.array(list(self.special.values()), np.uint32)
        self.counts = np.ones(len(self.special), np.int64)
        self.starts = np.arange(len(self.special))

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.id_bytes.__getitem__, ids)).decode("utf-8", "replace")


def chunks(texts: list[str]) -> Iterator[list[str]]:
    """The texts in parts of about CHUNK_CHARS characters."""
    chunk: list[str] = []
    chars = 0
    for text in texts:
        chunk.append(text)
        chars += len(text)
        if chars >= CHUNK_CHARS:
            yield chunk
            chunk, chars = [], 0
    yield chunk


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> PairIndexBPE:
    """The vocabulary at path, read once in each Python worker."""
    return PairIndexBPE(path)


def _carry(df: DataFrame, keep: list[str], own: str) -> list[T.StructField]:
    return [df.schema[c] for c in keep if c != own]


def encode_documents(
    df: DataFrame,
    path: str,
    text_col: str = "text",
    ids_col: str = "ids",
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Add ids_col (array<int>) with the token ids of text_col; keep names the columns carried along."""
    fields = _carry(df, list(keep), ids_col)
    schema = T.StructType([*fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            at = 0
            for texts in chunks([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]):
                ids = bpe.encode(texts)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                carried = [c.slice(at, len(texts)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [*carried, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    names=[*names, ids_col],
                )
                at += len(texts)

    return df.select(*names, df[text_col].alias("__text")).mapInArrow(run, schema)


def decode_documents(
    df: DataFrame,
    path: str,
    ids_col: str = "ids",
    text_col: str = "decoded",
    keep: tuple[str, ...] = ("doc_id", "ids"),
) -> DataFrame:
    """Add text_col with the text of the ids in ids_col."""
    fields = _carry(df, list(keep), text_col)
    schema = T.StructType([*fields, T.StructField(text_col, T.StringType())])
    names = [f.name for f in fields]
    at = names.index(ids_col) if ids_col in names else len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for whole in batches:
            for low in range(0, max(1, whole.num_rows), ROWS):
                batch = whole.slice(low, ROWS)
                texts = [
                    bpe.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else ""
                    for x in batch.column(at)
                ]
                columns = [*batch.columns[: len(names)], pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, text_col])

    # Ids that are carried along go to Python once.
    chosen = df.select(*names) if ids_col in names else df.select(*names, df[ids_col].alias("__ids"))
    return chosen.mapInArrow(run, schema)
