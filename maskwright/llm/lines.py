"""Line dedup by an exact set-similarity join: prefix, positional and length filters, then the Jaccard itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import DOC_COLUMNS, Words, flat, growing, mixed, slices, staged

THRESHOLD = 0.8
#: Cells of the table of word counts that orders words by rarity: 2 MB, whatever the input.
CELLS = 1 << 18
#: Lines of one word's list that are compared with as many in one task; a longer list is dealt out.
TILE = 2048
#: Postings that one Arrow group holds on average.
GROUP = 100_000
#: Bytes of postings that a task gathers before it hands them over, an array to a group.
_HELD = 32 << 20
#: Bits of each filter that every task gets: 4 MB, whatever the input.
_FILTER_BITS = 1 << 25
_BLOCK_BITS = 1 << 15
_CELL_BLOCK = 1 << 12
#: Bytes of text whose words are in memory at once.
_SLICE = 1 << 20
_SALT = np.uint64(0x9E3779B97F4A7C15)
_BEST = 2
_AT_ONCE = 1 << 16
_LAST = (1 << 63) - 1


def _cell(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def rarity_table(docs: DataFrame) -> np.ndarray:
    """Counts of all words, folded into CELLS cells by their hash; tasks hand them over in blocks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for part in slices(batches, "text", _SLICE):
            total += np.bincount(_cell(Words(part.column("text")).hash), minlength=CELLS)
        blocks = [x.tobytes() for x in total.reshape(-1, _CELL_BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks)], names=["block", "n"])

    def summed(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in group.column("n"))
        return group.slice(0, 1).select(["block"]).append_column("n", pa.array([total.tobytes()]))

    table = np.zeros((CELLS // _CELL_BLOCK, _CELL_BLOCK), np.int64)
    schema = "block int, n binary"
    for row in docs.select("text").mapInArrow(count, schema).groupBy("block").applyInArrow(summed, schema).collect():
        table[row["block"]] = np.frombuffer(row["n"], np.int64)
    return table.ravel()


def bitmap(rows: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray]) -> Broadcast:
    """A filter of fixed size over the 64-bit ``keys`` of ``rows``: it misses none, and lets others pass the more the
    fuller it is, so whatever passes must be right to take."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(keys(batch) & np.uint64(_FILTER_BITS - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at // _BLOCK_BITS).astype(np.int32)), pa.array((at % _BLOCK_BITS).astype(np.int32))], names=["block", "bit"])

    def block(group: pa.Table) -> pa.Table:
        flags = np.zeros(_BLOCK_BITS, bool)
        flags[group.column("bit").to_numpy()] = True
        return group.slice(0, 1).select(["block"]).append_column("bits", pa.array([np.packbits(flags).tobytes()]))

    bits = rows.mapInArrow(find, "block int, bit int").distinct()
    found, size = np.zeros(_FILTER_BITS // 8, np.uint8), _BLOCK_BITS // 8
    for row in bits.groupBy("block").applyInArrow(block, "block int, bits binary").collect():
        found[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return rows.sparkSession.sparkContext.broadcast(found.tobytes())


def passes(filter_: Broadcast, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(_FILTER_BITS - 1)
    return (np.frombuffer(filter_.value, np.uint8)[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1


def _rare_first(line: np.ndarray, rank: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The order by line, then rank, then word; line and rank are small numbers.

    One number holds line, rank and as much of the word as fits, which nearly always settles it."""
    lines, ranks = int(line.max(initial=0)).bit_length(), CELLS.bit_length()
    key = (line.astype(np.uint64) << np.uint64(64 - lines)) if lines else np.zeros(len(line), np.uint64)
    key |= (rank.astype(np.uint64) << np.uint64(64 - lines - ranks)) | (word >> np.uint64(lines + ranks))
    order = np.argsort(key)
    sorted_key, sorted_word = key[order], word[order]
    if ((sorted_key[1:] == sorted_key[:-1]) & (sorted_word[1:] != sorted_word[:-1])).any():
        return np.lexsort((word, rank, line))
    return order


class Lines:
    """The word sets of the lines of many texts, each set's words from rare to frequent.

    ``text`` and ``number`` tell where a line stands, ``of`` where its words start in ``word``."""

    def __init__(self, column: pa.Array, rarity: np.ndarray):
        words = Words(column, lines=True)
        base = np.concatenate([[0], np.cumsum(words.data == 10)])[words.offsets[:-1]] if len(words.data) else np.zeros(len(column), np.int64)
        feed = np.flatnonzero(words.data == 10)
        number = np.searchsorted(feed, words.start) - base[words.text]
        order = _rare_first(words.line, rarity[_cell(words.hash)], words.hash)
        line, word = words.line[order], words.hash[order]
        new = np.ones(len(line), bool)
        new[1:] = (line[1:] != line[:-1]) | (word[1:] != word[:-1])
        order, line, self.word = order[new], line[new], word[new]
        start = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
        self.of = np.append(start, len(line))
        self.text, self.number = words.text[order[start]], number[order[start]]

    def __len__(self) -> int:
        return len(self.text)

    @property
    def size(self) -> np.ndarray:
        return np.diff(self.of)

    def marks(self) -> np.ndarray:
        """A hash of each set."""
        if not len(self):
            return np.zeros(0, np.uint64)
        total = np.add.reduceat(mixed(self.word ^ np.uint64(0xA0761D6478BD642F)), self.of[:-1])
        return mixed(total + self.size.astype(np.uint64))

    def parities(self) -> pa.Array:
        """The parity of each set's words over 64 bits or more, a bit to a word about, as 64-bit numbers: two sets
        differ in as many words at least as their parities differ in bits. Folded in two, it is one of half the bits."""
        words = np.maximum(1, 1 << np.ceil(np.log2(np.maximum(self.size, 1) / 64)).astype(np.int64).clip(0))
        ends = np.cumsum(words)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
        base, width = np.repeat(ends - words, self.size), np.repeat(words, self.size)
        where = base + ((self.word >> np.uint64(6)).astype(np.int64) & (width - 1))
        np.bitwise_xor.at(out, where, np.uint64(1) << (self.word & np.uint64(63)))
        offsets = np.concatenate([[0], 8 * ends]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])


def prefix_length(size: np.ndarray, threshold: float) -> np.ndarray:
    """So many of its rarest words a set shares at least one of with every set that is similar to it."""
    return size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1


def _placed(docs: DataFrame, rarity: np.ndarray, threshold: float) -> DataFrame:
    """doc, mark, line, set, size, bits and prefix words, 32 bits each, of each line that has a word."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", _SLICE):
            lines = Lines(part.column("text"), rarity)
            take = pa.array(lines.text)
            length = prefix_length(lines.size, threshold)
            prefix = _runs((lines.word[_ragged(lines.of[:-1], length)] >> np.uint64(32)).astype(np.uint32), np.cumsum(length))
            columns = [part.column("doc").take(take), part.column("mark").take(take), pa.array(lines.number), pa.array(lines.marks().view(np.int64)),
                       pa.array(lines.size), lines.parities(), prefix]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "mark", "line", "set", "size", "bits", "prefix"])

    return docs.select("doc", "mark", "text").mapInArrow(find, "doc long, mark long, line long, set long, size long, bits binary, prefix binary")


def _doc_keys(batch: pa.RecordBatch) -> np.ndarray:
    doc, mark = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("doc", "mark"))
    return mixed(mixed(doc) * _SALT + mark)


def _line_keys(doc_keys: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mixed(doc_keys + (line.astype(np.uint64) + np.uint64(1)) * _SALT)


def _word_sets(docs: DataFrame, wanted: Broadcast, rarity: np.ndarray) -> DataFrame:
    """(set, words) of the lines of ``docs`` that the filter ``wanted`` lets pass."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _doc_keys(batch)
            some = np.flatnonzero(passes(wanted, keys))
            texts = batch.select(["text"]).take(pa.array(some)).append_column("key", pa.array(keys[some]))
            for part in slices(iter([texts]), "text", _SLICE):
                data, offsets = flat(part.column("text"))
                # a line is a text with its line feed, where it has one
                starts = np.sort(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
                text = np.searchsorted(offsets[:-1], starts, "right") - 1
                number = np.arange(len(starts)) - np.searchsorted(starts, offsets[:-1])[text]
                rows = np.flatnonzero(passes(wanted, _line_keys(part.column("key").to_numpy()[text], number)))
                ends = np.append(starts[1:], len(data))
                whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, ends[-1:]).astype(np.int64)), pa.py_buffer(data)])
                lines = Lines(whole.take(pa.array(rows)).cast(pa.large_string()), rarity)
                words = pa.ListArray.from_arrays(pa.array(lines.of.astype(np.int32)), pa.array(lines.word.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(lines.marks().view(np.int64)), words], names=["set", "words"])

    return docs.select("doc", "mark", "text").mapInArrow(find, "set long, words array<long>")


def parity_apart(bits: np.ndarray, start: np.ndarray, words: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many bits the parities of the pairs (i, j) differ, each folded to the width of the shorter."""
    apart, width = np.zeros(len(i), np.int64), np.minimum(words[i], words[j])
    for w in np.unique(width):
        some = np.flatnonzero(width == w)
        for k in range(w):
            sides = np.zeros(len(some), np.uint64)
            for side in (i[some], j[some]):
                for fold in range(int((words[side] // w).max(initial=0))):
                    has = fold * w < words[side]
                    sides[has] ^= bits[start[side[has]] + fold * w + k]
            apart[some] += np.bitwise_count(sides)
    return apart


def _ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ..., ``length`` of them, of each."""
    ends = np.cumsum(length)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - ends + length, length)


def candidates(rows: dict[str, np.ndarray], threshold: float, best: int | None, limit: int = 2_000_000) -> dict[str, np.ndarray]:
    """Pairs (late, early) of sets that share a prefix word and pass the length, positional and parity filters.

    ``rows`` are postings: word, set, doc, mark (all alike if absent), line, size, position, probe, tile, and the parities as bits, start and
    words. Lists are sorted by size, so each posting meets only those that the length filter leaves it. With ``best``, only so many pairs stay for each late posting, those whose parities differ least; ``more``
    tells that there were others."""
    mark = rows.get("mark", np.zeros(len(rows["word"]), np.int64))
    order = np.argsort((rows["word"].astype(np.int64) << 32) + rows["size"])
    word = rows["word"][order]
    same = word[1:] == word[:-1]
    order = order[np.append(same, False) | np.append(False, same)] if len(word) else order  # the others meet nothing
    word, size, at = rows["word"][order], rows["size"][order].astype(np.int64), rows["position"][order].astype(np.int64)
    doc, mark, line = rows["doc"][order], mark[order], rows["line"][order]
    probe, tile, rest = rows["probe"][order], rows["tile"][order], size - at
    start, words, names = rows["start"][order], rows["words"][order], rows["set"][order]
    share = threshold / (1 + threshold)
    kept = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def reduced() -> list[np.ndarray]:
        i, j, apart = (np.concatenate([k, *f]) for k, f in zip(kept[:3], zip(*found, strict=True), strict=True)) if found else kept[:3]
        more = np.concatenate([kept[3], np.zeros(len(i) - len(kept[3]), bool)])
        if best is None or not len(i):
            return [i, j, apart, more]
        by = np.lexsort((j, apart, i))
        i, j, apart, more = i[by], j[by], apart[by], more[by]
        first = np.searchsorted(i, i)
        more = np.logical_or.reduceat(more, np.unique(first))[np.unique(first, return_inverse=True)[1]] | (np.bincount(i)[i] > best)
        keep = np.arange(len(i)) - first < best
        return [i[keep], j[keep], apart[keep], more[keep]]

    # each posting is held against those before it in its list that are not too small for it
    number = np.cumsum(np.append(False, word[1:] != word[:-1])) if len(word) else word
    width = int(size.max(initial=0)) + 1
    least = np.ceil(threshold * size - 1e-6).astype(np.int64)
    first = np.searchsorted(number * width + size, number * width + least)
    ends = np.cumsum(np.arange(len(word)) - first)
    pending = done = 0
    while done < len(word):
        base = ends[done - 1] if done else 0
        to = max(done + 1, int(np.searchsorted(ends, base + _AT_ONCE, "right")))
        some = np.arange(done, to)
        i, j = np.repeat(some, some - first[some]), _ragged(first[some], some - first[some])
        done = to
        need = np.ceil(share * (size[i] + size[j]) - 1e-9)
        ok = (size[j] >= need) & (np.minimum(at[i], at[j]) + np.minimum(rest[i], rest[j]) >= need)
        i, j, need = i[ok], j[ok], need[ok]
        later = np.where(doc[i] != doc[j], doc[i] > doc[j], np.where(mark[i] != mark[j], mark[i] > mark[j], line[i] > line[j]))
        i, j = np.where(later, i, j), np.where(later, j, i)
        ok = probe[i] & ((doc[i] != doc[j]) | (mark[i] != mark[j]) | (line[i] != line[j])) & ((tile[i] < 0) | (tile[i] != tile[j]))
        i, j, need = i[ok], j[ok], need[ok]
        apart = parity_apart(rows["bits"], start, words, i, j)
        ok = apart <= size[i] + size[j] - 2 * need
        found.append((i[ok], j[ok], apart[ok]))
        pending += int(ok.sum())
        if pending > limit and best is not None:
            kept, found, pending = reduced(), [], 0
    i, j, apart, more = reduced()
    return {"late": names[i], "early": names[j], "apart": apart, "more": more}


_PACK = 1 << 31
_FIELDS = {"word": np.int32, "size": np.int32, "position": np.int32, "line": np.int32, "words": np.int32, "probe": np.bool_, "set": np.int64, "doc": np.int64, "mark": np.int64}


def _flat(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    """The bytes of a binary column behind each other, as numbers."""
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(kind)


def _runs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Numbers as a binary column, a row for each run that ends at one of ``ends``."""
    offsets = np.append(0, ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


class _Postings:
    """A row per prefix word of some sets that the filter ``listed`` lets pass. Only sets that the filter ``probes``
    does are probes, all without it. ``start`` and ``words`` tell where in ``bits`` a posting's parity stands."""

    def __init__(self, sets: pa.Table, listed: Broadcast, probes: Broadcast | None):
        sets = sets.combine_chunks()
        length = pc.binary_length(sets.column("prefix")).to_numpy().astype(np.int64) // 4
        of = np.repeat(np.arange(len(sets)), length)
        columns = {c: sets.column(c).to_numpy() for c in ("set", "doc", "mark", "line", "size")}
        word, at = _flat(sets.column("prefix"), np.int32), np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length)
        some = np.flatnonzero(passes(listed, _word_keys(word)))
        word, at, of = word[some], at[some], of[some]
        probe = passes(probes, columns["set"].view(np.uint64)) if probes else np.ones(len(sets), bool)
        width = pc.binary_length(sets.column("bits")).to_numpy().astype(np.int64) // 8
        self.bits = _flat(sets.column("bits"), np.uint64)
        self.start = (np.cumsum(width) - width)[of]
        self.columns = {"word": word, "position": at, "probe": probe[of], "words": width[of]} | {c: x[of] for c, x in columns.items()}

    def rows(self, order: np.ndarray, ends: np.ndarray) -> dict[str, pa.Array]:
        """Binary columns: the postings in ``order``, a row for each run that ends at one of ``ends``."""
        out = {c: _runs(self.columns[c][order].astype(kind), ends) for c, kind in _FIELDS.items()}
        width = self.columns["words"][order]
        out["bits"] = _runs(self.bits[_ragged(self.start[order], width)], np.append(0, np.cumsum(width))[ends])
        return out


def _word_keys(word: np.ndarray) -> np.ndarray:
    return mixed(word.view(np.uint32).astype(np.uint64))


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of sets whose postings have some ``_HELD`` bytes, one set at least."""
    held, size = [], 0
    for batch in batches:
        fixed = 4 * 5 + 1 + 8 * 3
        weight = pc.binary_length(batch.column("prefix")).to_numpy(zero_copy_only=False).astype(np.int64) // 4 * (pc.binary_length(batch.column("bits")).to_numpy(zero_copy_only=False) + fixed)
        ends, at = np.cumsum(weight), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + _HELD - size, "right")))
            held.append(batch.slice(at, to - at))
            size += int(ends[to - 1] - base)
            at = to
            if size >= _HELD or at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def word_lists(sets: DataFrame) -> tuple[int, Broadcast, DataFrame]:
    """The postings of words in the prefixes of more than one set, a filter of these words, and (word, tiles) of those
    whose lists are longer than a tile."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        word, n = np.unique(np.concatenate(held), return_counts=True)
        block = (_word_keys(word) & np.uint64(_FILTER_BITS - 1)).astype(np.int64) // _BLOCK_BITS
        order = np.argsort(block, kind="stable")
        of, first = np.unique(block[order], return_index=True)
        ends = np.append(first, len(order))[1:]
        return pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), _runs(word[order], ends), _runs(n[order].astype(np.int32), ends)], names=["block", "word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(_flat(batch.column("prefix"), np.int32))
            size += len(held[-1])
            if size > _HELD // 8:
                yield counted(held)
                held, size = [], 0
        if size:
            yield counted(held)

    def summed(group: pa.Table) -> pa.Table:
        word, of = np.unique(_flat(group.column("word"), np.int32), return_inverse=True)
        n = np.bincount(of.ravel(), _flat(group.column("n"), np.int32)).astype(np.int64)
        word, n = word[n > 1], n[n > 1]
        flags = np.zeros(_BLOCK_BITS, bool)
        flags[(_word_keys(word) & np.uint64(_BLOCK_BITS - 1)).astype(np.int64)] = True
        hot = n > TILE
        lists = [{"word": w, "tiles": t} for w, t in zip(word[hot].tolist(), (-(-n[hot] // TILE)).tolist(), strict=True)]
        return pa.Table.from_pylist([{"block": group.column("block")[0].as_py(), "bits": np.packbits(flags).tobytes(), "n": int(n.sum()), "lists": lists}], schema=out)

    out = pa.schema([("block", pa.int32()), ("bits", pa.binary()), ("n", pa.int64()), ("lists", pa.list_(pa.struct([("word", pa.int32()), ("tiles", pa.int32())])))])
    found = sets.select("prefix").mapInArrow(count, "block int, word binary, n binary").groupBy("block")
    found = staged(found.applyInArrow(summed, "block int, bits binary, n long, lists array<struct<word int, tiles int>>"))
    filter_, total = np.zeros((_FILTER_BITS // _BLOCK_BITS, _BLOCK_BITS // 8), np.uint8), 0
    for row in found.select("block", "bits", "n").collect():
        filter_[row["block"]] = np.frombuffer(row["bits"], np.uint8)
        total += row["n"]
    return total, sets.sparkSession.sparkContext.broadcast(filter_.tobytes()), found.select(F.inline("lists"))


def _word_cell(word: np.ndarray) -> np.ndarray:
    return (word.view(np.uint32) >> np.uint32(32 - CELLS.bit_length() + 1)).astype(np.int64)


def _pairs(sets: DataFrame, lists: DataFrame, groups: int, threshold: float, best: int | None, listed: Broadcast, probes: Broadcast | None = None) -> DataFrame:
    """Candidates from the lists of the words that the filter ``listed`` lets pass.

    Tasks hand the postings over in arrays, one for each group of words. Lists longer than a tile, and others of their
    cells, are dealt out posting by posting: cut into tiles at random, each pair of tiles a unit of its own."""
    cells = np.zeros(CELLS, bool)
    for row in lists.select(F.shiftrightunsigned("word", 32 - CELLS.bit_length() + 1).alias("cell")).distinct().toLocalIterator():
        cells[row["cell"]] = True
    names = ["late", "early", "apart", "more"]
    schema = "late long, early long, apart long, more boolean"
    binary = ", ".join(f"{c} binary" for c in [*_FIELDS, "bits"])

    def cold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _held(batches):
            found = _Postings(table, listed, probes)
            word = found.columns["word"]
            at = np.flatnonzero(~cells[_word_cell(word)])
            group = (_word_keys(word[at]) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            of, first = np.unique(group[order], return_index=True)
            columns = {"_group": pa.array(of.astype(np.int32))} | found.rows(at[order], np.append(first, len(order))[1:])
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _held(batches):
            found = _Postings(table, listed, probes)
            at = np.flatnonzero(cells[_word_cell(found.columns["word"])])
            columns = {"hot": pa.array(found.columns["word"][at]), "of": pa.array(found.columns["set"][at])}
            columns |= found.rows(at, np.arange(1, len(at) + 1))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def compare(table: pa.Table) -> pa.Table:
        rows = {c: _flat(table.column(c), kind) for c, kind in _FIELDS.items()}
        rows["start"] = np.cumsum(rows["words"], dtype=np.int64) - rows["words"]
        rows["tile"] = table.column("tile").to_numpy() if "tile" in table.column_names else np.full(len(rows["word"]), -1)
        if "unit" in table.column_names:  # several units of one word may meet: each is a list
            rows["word"] = np.unique(np.stack([rows["word"].astype(np.int64), table.column("unit").to_numpy()]), axis=1, return_inverse=True)[1].ravel()
        pairs = candidates(rows | {"bits": _flat(table.column("bits"), np.uint64)}, threshold, best)
        return pa.table({n: pa.array(pairs[n]) for n in names})

    found = sets.mapInArrow(cold, f"_group int, {binary}").groupBy("_group").applyInArrow(compare, schema)
    if not cells.any():
        return found
    dealt = sets.mapInArrow(hot, f"hot int, of long, {binary}").join(lists.withColumnRenamed("word", "hot"), "hot", "left")
    dealt = dealt.withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("_own", F.pmod(F.hash("of"), F.col("tiles")))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("_other"))
    low, high = F.least("_own", "_other").cast("long"), F.greatest("_own", "_other").cast("long")
    dealt = dealt.withColumn("unit", low * _PACK + high).withColumn("tile", F.when(F.col("_own") == F.col("_other"), F.lit(-1)).otherwise(F.col("_own")).cast("long"))
    # within a tile pair only pairs over the two tiles count; a tile with itself is the unit (i, i)
    dealt = dealt.withColumn("_group", F.pmod(F.xxhash64("hot", "unit"), F.lit(20 * groups))).drop("tiles", "_own", "_other", "hot", "of")
    return found.union(dealt.groupBy("_group").applyInArrow(compare, schema))


def similar_sets(docs: DataFrame, sets: DataFrame, rarity: np.ndarray, threshold: float, group: int) -> DataFrame:
    """(set): the sets that have a similar one standing earlier."""
    total, listed, lists = word_lists(sets)
    groups = max(1, total // group)
    # a pair may be found by several words; all of a line's pairs are brought to one task before they are told apart
    near = _pairs(sets, lists, groups, threshold, _BEST, listed).repartition("late")
    near = near.groupBy("late", "early").agg(F.min("apart").alias("apart"), F.max("more").alias("more")).groupBy("late").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("apart", "early"))), 1, _BEST).alias("b"),
        (F.max("more") | (F.count("early") > _BEST)).alias("more"))
    near = staged(near)
    pairs = near.select("late", F.explode("b").alias("b")).select("late", F.col("b.early").alias("early"))
    gone = staged(_verified(pairs, docs, sets, rarity, threshold))
    open_ = staged(near.filter("more").select(F.col("late").alias("set")).join(gone, "set", "left_anti"))
    if open_.isEmpty():
        return gone
    # the lines whose nearest candidates failed are compared with all of theirs
    probes = bitmap(open_, lambda batch: batch.column("set").to_numpy().view(np.uint64))

    def open_words(batch: pa.RecordBatch) -> np.ndarray:
        some = np.flatnonzero(passes(probes, batch.column("set").to_numpy().view(np.uint64)))
        return _word_keys(_flat(batch.column("prefix").take(pa.array(some)), np.int32))

    listed = bitmap(sets.select("set", "prefix"), open_words)
    pairs = _pairs(sets, lists, groups, threshold, None, listed, probes).select("late", "early").distinct()
    return gone.union(_verified(pairs, docs, sets, rarity, threshold)).distinct()


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, rarity: np.ndarray, threshold: float) -> DataFrame:
    """(set): the later ones of the pairs whose Jaccard reaches the threshold, from their whole word sets."""
    pairs = staged(pairs)
    needed = pairs.select(F.col("late").alias("set")).union(pairs.select("early")).distinct()

    def places(batch: pa.RecordBatch) -> np.ndarray:
        keys = _doc_keys(batch)
        return np.concatenate([keys, _line_keys(keys, batch.column("line").to_numpy())])

    wanted = bitmap(sets.join(growing(needed), "set").select("doc", "mark", "line"), places)
    words = _word_sets(docs, wanted, rarity).join(growing(needed), "set", "left_semi")
    words = staged(words.dropDuplicates(["set"]))
    both = pairs.join(words.select(F.col("set").alias("late"), F.col("words").alias("a")), "late")
    both = both.join(words.select(F.col("set").alias("early"), F.col("words").alias("b")), "early")
    shared = F.size(F.array_intersect("a", "b"))
    ok = shared >= F.lit(threshold - 1e-12) * (F.size("a") + F.size("b") - shared)
    return both.filter(ok).select(F.col("late").alias("set")).distinct()


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD, group: int = GROUP) -> DataFrame:
    """(doc, mark, removed): the numbers of the lines to remove from each document; ``docs`` has doc, mark, text."""
    rarity = rarity_table(docs)
    rarity = np.unique(rarity, return_inverse=True)[1].astype(np.int32)
    placed = staged(_placed(docs, rarity, threshold))
    first = F.min(F.struct("doc", "mark", "line")).alias("p")
    sets = placed.groupBy("set").agg(first, F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("prefix").alias("prefix"))
    sets = staged(sets.select("set", "p.doc", "p.mark", "p.line", "size", "bits", "prefix"))
    gone = staged(similar_sets(docs, sets, rarity, threshold, group)).withColumn("_gone", F.lit(True))
    status = sets.select("set", F.col("doc").alias("_d"), F.col("mark").alias("_m"), F.col("line").alias("_l")).join(gone, "set", "left")
    other = (F.col("doc") != F.col("_d")) | (F.col("mark") != F.col("_m")) | (F.col("line") != F.col("_l"))
    removed = placed.select("doc", "mark", "line", "set").join(growing(status), "set").filter(other | F.coalesce("_gone", F.lit(False)))
    return removed.groupBy("doc", "mark").agg(F.collect_set("line").alias("removed"))


def with_lines_removed(docs: DataFrame, columns: list[str], **options) -> DataFrame:
    """``columns`` of ``docs``, the text without the lines that match an earlier one, n_lines and n_removed.

    A line's tokens are the set of its words; lines match at a Jaccard of ``threshold`` or more. A line goes if any
    line of the input that stands earlier matches it, by doc_id (null last), then place in the text. Lines without a
    word stay. Two rows with one doc_id are ordered by their text's hash, and equal rows stand at one place, so
    neither takes from the other. A null text stays null."""
    keyed = docs.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))).withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = removed_lines(keyed.select("doc", "mark", F.coalesce("text", F.lit("")).alias("text")), **options)
    right = found.select(F.col("doc").alias("_doc"), F.col("mark").alias("_mark"), F.col("removed").alias("_removed"))
    joined = keyed.join(right.hint("shuffle_hash"), (keyed["doc"] == right["_doc"]) & (keyed["mark"] == right["_mark"]), "left")
    parts = F.split("text", "\n", -1)
    kept = F.filter(F.transform(parts, lambda x, i: F.when(~F.array_contains("_removed", i.cast("long")), x)), lambda x: x.isNotNull())
    text = F.when(F.col("_removed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    removed = F.coalesce(F.size("_removed"), F.lit(0))
    return joined.select(*[F.col(c) for c in columns if c != "text"], text.alias("text"), lines.cast("long").alias("n_lines"), F.when(F.col("_removed").isNull(), 0).otherwise(removed).cast("long").alias("n_removed"))


def deduplicated_documents(docs: DataFrame, **options) -> DataFrame:
    """Documents without their repeated lines; one that loses every line it had goes."""
    rows = with_lines_removed(docs.select(*DOC_COLUMNS), list(DOC_COLUMNS), **options)
    rows = rows.filter("n_lines = 0 or n_removed < n_lines")
    return rows.withColumn("n_chars", F.char_length("text").cast("long")).select(*DOC_COLUMNS)
