"""Removal of repeated passages by a depth-limited radix sort of suffixes.

``remove_repeats`` takes texts as UTF-8 bytes and removes every byte covered by a string of ``width`` bytes that also
starts in a document with a smaller id. Suffixes need ordering only through their first ``width`` bytes; groups that
are still equal there are exactly the repeated windows.

Most-significant-digit passes over all suffixes at once:

1. The first digit of a suffix is the least gram hash among the grams in its first ``width`` bytes. Neighbouring
   suffixes mostly share it and are carried as one run; equal windows always have equal digits at equal places, so only
   runs of one digit can hold repeats. One shuffle deals the runs by that digit (about one row for 18 bytes).
2. The next digit is the hash of the whole run. Runs equal in both are repeats through and through, and all but those
   of the smallest document are settled.
3. For digits that are left with different runs, one run for each document and content is sorted once more, for every
   place of the first digit in the window, by the window's remaining bytes. Digits with more than MOST such runs are not
   sorted in a task: each of their windows becomes a row, whose first document is found by its key's hash.

Documents stay rows throughout; settled spans go back to their document by id and the bytes are removed there. Digits
are 64-bit hashes, and a window is compared by two or more of them.

Defined cases: a null text is an empty one; a row with a null id is left as it is and is no source; rows that repeat an
id are one document for comparisons, each row losing its own bytes (an id may have 65,536 different texts; with more the
operator raises ValueError); texts shorter than ``width`` bytes are left as they are; extra columns are carried only by
name in ``keep``, whatever their names, and the operator's own columns win. Bytes are removed
wherever a window ends, so a remaining text may break a character; ``kept_text`` replaces such bytes by U+FFFD, while
``kept_bytes`` has them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlab.llm.common import cut

#: Bytes of a gram, the unit of the first digit.
GRAM = 16
#: Contested runs of one digit that a task sorts; the windows of digits with more are dealt one by one.
MOST = 50_000
#: Contested runs that a task sorts at once, if whole digits are no more, and those whose grams are hashed at once.
SORTED, HASHED = 16_384, 4_096
U = np.uint64
RUNS = "digit long, content long, doc_id long, place long"


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def grams(data: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes that start at each place."""
    h = mixed(data.astype(np.uint64) + U(0x9E3779B97F4A7C15))
    step = 1
    while step < GRAM:
        h = (
            h[:-step] ^ (h[:-step] >> U(29))
        ) * U(0xD6E8FEB86659FD93) + (h[step:] ^ (h[step:] >> U(32))) * U(0xA0761D6478BD642F)
        step *= 2
    return mixed(h)


def runs(data: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Digit, content hash, first window, windows beyond it and place of the digit in the first window, of each run."""
    n = len(data)
    if n < width:
        none = np.zeros(0, np.int64)
        return none.astype(U), none.astype(U), none, none, none
    h = grams(data)
    bits = U(int(len(h)).bit_length())
    least = (h >> bits << bits) | np.arange(len(h), dtype=U)
    span = width - GRAM + 1  # grams in a window
    step = 1
    while step * 2 <= span:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if span > step:
        least = np.minimum(least[: step - span], least[span - step :])
    least = (least & ((U(1) << bits) - U(1))).astype(np.int64)
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    beyond = np.diff(np.append(first, len(least))) - 1
    anchor = least[first]
    end = first + beyond + width
    content = (anchor - first).astype(U) << U(32) | beyond.astype(U)
    for at in (
        first,
        np.minimum(first + GRAM, end - GRAM),
        np.minimum(first + 2 * GRAM, end - GRAM),
        end - 3 * GRAM,
        end - 2 * GRAM,
        end - GRAM,
    ):
        content = mixed(content) * U(0x9FB21C651E98DF25) + h[at]
    return h[anchor], mixed(content), first, beyond, anchor - first


def _all_runs(width: int):
    names = ["digit", "content", "doc_id", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[np.ndarray, ...]] = []
            count = 0

            def out() -> pa.RecordBatch:
                columns = [
                    np.concatenate(c) for c in zip(*found, strict=True)
                ] if found else [np.zeros(0, np.int64)] * 4
                found.clear()
                return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=names)

            for doc, text, mark in zip(
                batch.column(0).to_pylist(),
                batch.column(1),
                batch.column(2).to_pylist(),
                strict=True,
            ):
                raw = text.as_buffer()
                if raw is None or raw.size < width:
                    continue
                digit, content, first, beyond, left = runs(np.frombuffer(raw, np.uint8), width)
                found.append(
                    (
                        digit.view(np.int64),
                        content.view(np.int64),
                        np.full(len(digit), doc, np.int64),
                        (mark << 47) | first << 16 | left << 8 | beyond,
                    ),
                )
                count += len(digit)
                if count > 500_000:
                    yield out()
                    count = 0
            yield out()

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From runs in order of digit, content and document: those of later documents are settled (digit null); of the
    first document's, those whose digit has other contents too are handed on with their digit."""
    last: tuple[int, int, int, bool] | None = None  # digit, content, its first document, whether it is its digit's first
    held: list[np.ndarray] = []  # the first document's runs of that content, while no other content is known
    for batch in batches:
        if not batch.num_rows:
            continue
        digit, content, doc, place = (batch.column(i).to_numpy() for i in range(4))
        new_digit = np.append(last is None or digit[0] != last[0], digit[1:] != digit[:-1])
        new = new_digit | np.append(last is None or content[0] != last[1], content[1:] != content[:-1])
        starts = np.flatnonzero(new)
        starts = starts if len(starts) and starts[0] == 0 else np.append(0, starts)
        group = np.zeros(len(new), np.int64)
        group[starts[1:]] = 1
        group = np.cumsum(group)
        first_doc, opens = doc[starts], new_digit[starts]
        if not new[0]:
            first_doc[0], opens[0] = last[2], last[3]
        repeat = doc > first_doc[group]
        follows = np.append(~new_digit[starts[1:]], False)
        if new_digit[0]:
            held = []
        elif new[0] or (len(starts) > 1 and follows[0]):
            release, held = held, []
            for x in release:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[0]), pa.array(x[1]), pa.array(x[2])],
                    names=["digit", "doc_id", "place"],
                )
        contested = (~opens | follows)[group] & ~repeat
        tail = (group == group[-1]) & ~repeat & ~contested
        if len(starts) > 1:
            held = []
        if opens[-1] and tail.any():
            held.append(np.stack([digit[tail], doc[tail], place[tail]]))
        pick = repeat | contested
        yield pa.RecordBatch.from_arrays(
            [pa.array(digit[pick], mask=repeat[pick]), pa.array(doc[pick]), pa.array(place[pick])],
            names=["digit", "doc_id", "place"],
        )
        last = (int(digit[-1]), int(content[-1]), int(first_doc[-1]), bool(opens[-1]))


def _contested_bytes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for doc, text, mark, digits, places in zip(
                batch.column(0).to_pylist(),
                batch.column(1),
                batch.column(2).to_pylist(),
                batch.column(3),
                batch.column(4),
                strict=True,
            ):
                raw = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
                for digit, place in zip(digits.values.to_pylist(), places.values.to_pylist(), strict=True):
                    if place >> 47 == mark:
                        start = place >> 16 & 0x7FFFFFFF
                        for column, value in zip(
                            rows,
                            (digit, doc, place, bytes(raw[start : start + (place & 255) + width])),
                            strict=True,
                        ):
                            column.append(value)
                if len(rows[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(c, pa.int64()) for c in rows[:3]), pa.array(rows[3], pa.binary())],
                        names=["digit", "doc_id", "place", "bytes"],
                    )
                    rows = [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in rows[:3]), pa.array(rows[3], pa.binary())],
                names=["digit", "doc_id", "place", "bytes"],
            )

    return run


def _line_grams(held: list[bytes], left: np.ndarray, reach: int) -> np.ndarray:
    """The hashes of the grams of each run, the first digits of all runs in one column."""
    lengths = np.fromiter(map(len, held), np.int64, len(held))
    lines = np.zeros((len(held), reach + GRAM + reach), np.uint8)
    flat = np.frombuffer(b"".join(held), np.uint8)
    row = np.repeat(np.arange(len(held)), lengths)
    column = np.arange(len(flat)) - np.repeat(
        np.cumsum(lengths) - lengths,
        lengths,
    ) + np.repeat(reach - left, lengths)
    lines[row, column] = flat
    h = mixed(lines.astype(np.uint64) + U(0x9E3779B97F4A7C15))
    step = 1
    while step < GRAM:
        h = (h[:, :-step] ^ (h[:, :-step] >> U(29))) * U(0xD6E8FEB86659FD93) + (
            h[:, step:] ^ (h[:, step:] >> U(32))
        ) * U(0xA0761D6478BD642F)
        step *= 2
    return h


def _window_keys(digit: np.ndarray, place: np.ndarray, held: list[bytes], width: int) -> Iterator[
    tuple[np.ndarray, np.ndarray, np.ndarray]
]:
    """For every place of the first digit in the window: rows that have such a window, its key and its place."""
    reach = width - GRAM
    lengths = np.fromiter(map(len, held), np.int64, len(held))
    left, start, mark = place >> 8 & 255, place >> 16 & 0x7FFFFFFF, place >> 47
    h = np.empty((len(held), 2 * reach + 1), U)
    for low in range(0, len(held), HASHED):
        h[low : low + HASHED] = _line_grams(held[low : low + HASHED], left[low : low + HASHED], reach)
    for i in range(reach + 1):
        at = np.flatnonzero((i <= left) & (left - i <= lengths - width))
        if not len(at):
            continue
        key, c = mixed(digit[at].view(np.uint64)), reach - i
        for x in (*range(c, c + width - GRAM, GRAM), c + width - GRAM):
            key = mixed(key ^ h[at, x]) + h[at, x]
        yield at, key, mark[at] << 47 | (start[at] + left[at] - i) << 16


def _windows_covered(
    digit: np.ndarray,
    doc: np.ndarray,
    place: np.ndarray,
    held: list[bytes],
    width: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Of whole digit groups, the windows that start in a smaller document too: document and place of each."""
    docs, places = [], []
    for at, key, window in _window_keys(digit, place, held, width):
        order = np.argsort(key, kind="stable")
        own, key = doc[at][order], key[order]
        bounds = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        later = own > np.repeat(np.minimum.reduceat(own, bounds), np.diff(np.append(bounds, len(own))))
        docs.append(own[later])
        places.append(window[order][later])
    none = np.zeros(0, np.int64)
    return (np.concatenate(docs), np.concatenate(places)) if docs else (none, none)


def _all_windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 20_000):
                batch = whole.slice(low, 20_000)
                digit, doc, place = (batch.column(i).to_numpy() for i in range(3))
                for at, key, window in _window_keys(digit, place, batch.column(3).to_pylist(), width):
                    # The place of the digit in the window is part of what a key stands for.
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(key.view(np.int64)),
                            pa.array(
                                (place[at] >> 16 & 0x7FFFFFFF) + (place[at] >> 8 & 255) - (window >> 16 & 0x7FFFFFFF),
                            ),
                            pa.array(doc[at]),
                            pa.array(window),
                        ],
                        names=["key", "lead", "doc_id", "place"],
                    )

    return run


def _sort_contested(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows = 0

        def out(parts: list[tuple]) -> pa.RecordBatch:
            columns = [np.concatenate([p[i] for p in parts]) for i in range(3)]
            doc, place = _windows_covered(*columns, [b for p in parts for b in p[3]], width)
            # Neighbouring windows of one row become one span.
            order = np.lexsort((place, doc))
            doc, place = doc[order], place[order]
            window = place >> 16
            new = np.append(
                True,
                (doc[1:] != doc[:-1]) | (np.diff(window) > 1) | (np.diff(window // 200) > 0),
            ) if len(doc) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(doc)) - 1 if len(first) else first
            return pa.RecordBatch.from_arrays(
                [pa.array(doc[first]), pa.array(place[first] | window[last] - window[first])],
                names=["doc_id", "place"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            digit, doc, place = (batch.column(i).to_numpy() for i in range(3))
            part = (digit, doc, place, batch.column(3).to_pylist())
            cut_at = 0
            if rows >= SORTED:  # up to the last change of digit
                change = np.flatnonzero(np.append(digit[0] != held[-1][0][-1], digit[1:] != digit[:-1]))
                if len(change):
                    cut_at = int(change[-1])
                    yield out([*held, tuple(x[:cut_at] for x in part)])
                    held, rows = [], 0
            held.append(tuple(x[cut_at:] for x in part))
            rows += len(digit) - cut_at
        if rows:
            yield out(held)

    return run


def _removed(width: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, kept, spans = [], [], [], [], []
            for text, mark, items in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.zeros(0, np.uint8)
                n_bytes.append(len(data))
                if not items.is_valid:
                    n_removed.append(0)
                    n_spans.append(0)
                    kept.append(data.tobytes())
                    spans.append([])
                    continue
                place = items.values.to_numpy()
                place = place[place >> 47 == mark]
                start = place >> 16 & 0x7FFFFFFF
                depth = np.zeros(len(data) + 1, np.int64)
                np.add.at(depth, start, 1)
                np.add.at(depth, start + (place & 255) + width, -1)
                gone = np.cumsum(depth)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                n_removed.append(int(gone.sum()))
                n_spans.append(len(edges) // 2)
                kept.append(data[~gone].tobytes())
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)])
            arrays = [
                batch.column(0),
                *(pa.array(c, pa.int64()) for c in (n_bytes, n_removed, n_spans)),
                pa.array(kept, pa.binary()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_bytes", "spans"]
            yield pa.RecordBatch.from_arrays(arrays + list(batch.columns[4:]), names=names + keep)

    return run


def with_marks(docs: DataFrame) -> DataFrame:
    """Add __mark, which tells apart the different texts that rows of one doc_id have: their place by hash, 0 where an id
    has one text. An id may have 2**16 texts.

    Most tables repeat no id, and then their texts are not read for this."""
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    plain = F.lit(0).cast("long").alias("__mark")
    if repeated.isEmpty():
        return docs.select("*", plain)
    names = docs.columns
    key = [F.xxhash64("__text").alias("__h"), F.crc32(F.coalesce("__text", F.lit(b""))).alias("__c")]
    texts = docs.join(repeated, "doc_id", "left_semi").select("doc_id", *key).distinct()
    places = F.row_number().over(Window.partitionBy("doc_id").orderBy("__h", "__c")) - 1
    several = texts.withColumn("__place", places.cast("long")).where("__place > 0")
    most = several.agg(F.max("__place")).first()[0]
    if most is not None and most >= 1 << 16:
        raise ValueError("an id has more than 65536 different texts")
    same = ["doc_id", "__h", "__c"]
    return docs.select("*", *key).join(several, same, "left").select(*names, F.coalesce("__place", F.lit(0)).alias("__mark"))


def remove_repeats(
    df: DataFrame,
    width: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each row of df: doc_id, n_bytes, n_removed, n_spans, kept_bytes and spans (start and end in bytes).

    keep names further columns of df to carry along.
    """
    if width < 3 * GRAM or width - GRAM > 255:
        raise ValueError(f"width must be from {3 * GRAM} to {GRAM + 255}")
    taken = {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_bytes", "spans", id_col, text_col}
    keep = tuple(dict.fromkeys(c for c in keep if c not in taken))
    carried = [f"__keep{i}" for i in range(len(keep))]  # numbered, so that no name clashes
    docs = with_marks(
        df.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(text_col).cast("binary").alias("__text"),
            *(F.col(c).alias(k) for c, k in zip(keep, carried, strict=True)),
        ),
    )
    mark = F.col("__mark")
    named = docs.where("doc_id IS NOT NULL")
    settled = cut(
        named.select("doc_id", "__text", mark).mapInArrow(_all_runs(width), RUNS)
        .repartition("digit").sortWithinPartitions("digit", "content", "doc_id").mapInArrow(_settle, "digit long, doc_id long, place long"),
    )
    mine = named.select("doc_id", "__text", "__mark", *carried).repartition("doc_id")

    def contested(runs: DataFrame) -> DataFrame:
        """The bytes of runs (digit, doc_id, place)."""
        own = runs.groupBy("doc_id").agg(
            F.collect_list("digit").alias("__digits"),
            F.collect_list("place").alias("__places"),
        )
        return mine.join(own.hint("shuffle_hash"), "doc_id").select(
            "doc_id",
            "__text",
            mark,
            "__digits",
            "__places",
        ).mapInArrow(_contested_bytes(width), "digit long, doc_id long, place long, bytes binary")

    left = settled.where("digit IS NOT NULL")
    hot = cut(left.groupBy("digit").count().where(F.col("count") > MOST).select("digit"))
    some = not hot.isEmpty()
    windows = cut(
        contested(left.join(hot, "digit", "left_anti") if some else left)
        .repartition("digit").sortWithinPartitions("digit").mapInArrow(_sort_contested(width), "doc_id long, place long"),
    )
    if some:
        each = cut(
            contested(left.join(hot, "digit", "left_semi")).mapInArrow(
                _all_windows(width),
                "key long, lead long, doc_id long, place long",
            ),
        )
        least = each.groupBy("key", "lead").agg(
            F.min("doc_id").alias("least"),
            F.max("doc_id").alias("most"),
        ).where("least < most")
        windows = windows.unionByName(
            each.join(least, ["key", "lead"]).where("doc_id > least").select("doc_id", "place"),
        )
    whole = settled.where("digit IS NULL").select("doc_id", "place")
    spans = whole.unionByName(windows).groupBy("doc_id").agg(F.collect_list("place").alias("__items"))
    result = docs.select("doc_id", "__text", "__mark", *carried).where("doc_id IS NULL").withColumn(
        "__items",
        F.lit(None).cast("array<long>"),
    )
    joined = mine.join(spans.hint("shuffle_hash"), "doc_id", "left").select(
        "doc_id",
        "__text",
        "__mark",
        *carried,
        "__items",
    ).unionByName(result)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_bytes binary, spans array<struct<start:long,end:long>>"
    schema += "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return joined.select(
        "doc_id",
        "__text",
        mark,
        "__items",
        *carried,
    ).mapInArrow(_removed(width, list(keep)), schema)


def kept_text(df: DataFrame, out_col: str = "text") -> DataFrame:
    """Add out_col with kept_bytes as text; bytes of characters cut apart become U+FFFD."""
    return df.withColumn(out_col, F.make_valid_utf8(F.col("kept_bytes").cast("string")))
