"""Byte strings of a least length that repeat across documents, by bounded interval expansion.

Every window of ``least`` bytes is filed under the smallest hash of the grams in it, so equal windows
meet in one shard; runs of windows with one such hash are kept as one piece of text. Hashes that only
one chunk of documents has, and there only one document, are dropped by the count-min prefilter; windows
under a hash that is too common for one task (HOT) are filed each under a hash of all its bytes. A shard sorts the suffixes of its distinct pieces to a bounded depth, and extends all intervals of its
Burrows-Wheeler transform backward by one byte at a time, breadth first: each step yields the
suffixes whose common prefix with the one before has just that length. It stops at ``least``; what
still shares an interval then is one string.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .sketch import ASKED, ANSWER, HOT, Sketch, dealt, inside_twice, ordered, two_pass
from .textkit import byte_grams, covered, flat, mix, pieces

PIECE = 1 << 16
PART = 1 << 16


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    width = 1
    while width * 2 <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def runs(data: np.ndarray, off: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document, first window's place in data and number of windows of each run."""
    none = np.zeros(0, np.int64)
    keys, docs, starts, counts = [none.astype(np.uint64)], [none], [none], [none]
    for i, j in pieces(off, PIECE):
        for lo in range(int(off[i]), int(off[j]), 4 * PIECE):  # a very long document in parts
            hi = min(lo + 4 * PIECE + least - 1, int(off[j]))
            o = np.clip(off[i : j + 1] - lo, 0, hi - lo)
            low = _sliding_min(mix(byte_grams(data[lo:hi], gram), 5), least - gram + 1)
            m = len(low)
            doc = np.repeat(np.arange(j - i, dtype=np.int32), np.diff(o))[:m]
            fits = np.arange(m, dtype=np.int32) + np.int32(least) <= o[1:].astype(np.int32)[doc]
            new = fits.copy()
            new[1:] &= ~fits[:-1] | (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            keys.append(low[first])
            docs.append(doc[first].astype(np.int64) + i)
            starts.append(first + lo)
            counts.append(np.add.reduceat(fits, first, dtype=np.int64) if len(first) else none)
    return np.concatenate(keys), np.concatenate(docs), np.concatenate(starts), np.concatenate(counts)


def windows_alone(data: np.ndarray, least: int, which: np.ndarray, key, doc, start, count):
    """The same, with the runs in ``which`` cut into single windows, each filed under a hash of its own.

    So a gram that is everywhere doesn't bring all that surrounds it to one shard."""
    c = count[which]
    at = np.repeat(start[which], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
    whole = np.empty(len(at), np.uint64)
    for i in range(0, len(at), PIECE):
        own = at[i : i + PIECE]
        total = np.zeros(len(own), np.uint64)
        for x in range(least):
            total = total * np.uint64(0xD1342543DE82EF95) + data[own + x] + np.uint64(1)
        whole[i : i + PIECE] = mix(total, 6)
    key, doc = np.concatenate((key[~which], whole)), np.concatenate((doc[~which], np.repeat(doc[which], c)))
    start, count = np.concatenate((start[~which], at)), np.concatenate((count[~which], np.ones(len(at), np.int64)))
    order = np.lexsort((start, doc))
    return key[order], doc[order], start[order], count[order]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of symbols below 512 sorted by their first ``depth`` symbols at least, by doubling of what is tied.

    Up to 2M symbols a rank, the rank that follows and the place fit into one number, whose sort is much
    faster than one that has to give places."""
    n = len(text)
    small = n <= 1 << 21
    have = 4 if small else 7
    padded = np.concatenate([text, np.zeros(have, text.dtype)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(have):
        key = key << np.uint64(9) | padded[i : i + n]
    low = np.uint64((1 << 21) - 1)
    if small:
        s = np.sort(key << np.uint64(21) | np.arange(n, dtype=np.uint64))
        order, s = (s & low).astype(np.int64), s >> np.uint64(21)
    else:
        order = np.argsort(key)
        s = key[order]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    where, tied = np.arange(n), order  # ranks that aren't settled, and the suffixes that have them
    rank = np.zeros(n + 1, np.int64)  # of each suffix the first rank of those like it, from 1; past the end 0
    while True:
        rank[tied] = where[np.maximum.accumulate(np.where(new, np.arange(len(where)), 0))] + 1
        alone = new & np.append(new[1:], True)
        where, tied = where[~alone], tied[~alone]
        if have >= depth or not len(where):
            return order
        first, then = rank[tied].astype(np.uint64), rank[np.minimum(tied + have, n)].astype(np.uint64)
        if small:
            s = np.sort((first - np.uint64(1)) << np.uint64(43) | then << np.uint64(21) | tied.astype(np.uint64))
            tied, s = (s & low).astype(np.int64), s >> np.uint64(21)
        else:
            s = first << np.uint64(32) | then
            by = np.argsort(s)
            tied, s = tied[by], s[by]
        order[where] = tied
        new = np.concatenate(([True], s[1:] != s[:-1]))
        have *= 2


def expand(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array, and of each rank the interval of suffixes that share ``least`` symbols.

    A step extends all intervals backward by one symbol. Where neighbours come to lie in two intervals,
    their common prefix has just the length of that step, and they need not be looked at again."""
    n = len(text)
    order = suffix_array(text, least)
    rank = np.empty(n, np.int32)
    rank[order] = np.arange(n, dtype=np.int32)
    ahead = np.append(rank[1:], rank[:1])[order]  # from a suffix's rank to that of the suffix that it extends by its first symbol
    head = text[order]
    split = np.empty(n, bool)
    split[0] = True
    np.not_equal(head[1:], head[:-1], out=split[1:])
    open_ = np.flatnonzero(~split)
    a, b = ahead[open_ - 1], ahead[open_]
    interval = np.cumsum(split, dtype=np.int32)
    for _ in range(least - 1):
        parted = interval[a] != interval[b]
        if not parted.any():
            break
        split[open_[parted]] = True
        open_, a, b = open_[~parted], a[~parted], b[~parted]
        interval = np.cumsum(split, dtype=np.int32)
    return order, interval


def _smallest(texts: list[bytes], size: np.ndarray, docs: np.ndarray, least: int) -> np.ndarray:
    """For each window of the texts, one text after another, the smallest doc of a text that has it."""
    begin = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    text = np.zeros(int((size + 1).sum()), np.uint16)
    inside = np.ones(len(text), bool)
    inside[begin + size] = False
    text[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + np.uint16(1)
    order, interval = expand(text, least)
    windows = size - least + 1
    total = np.concatenate(([0], np.cumsum(windows)))
    at = np.repeat(begin - total[:-1], windows) + np.arange(total[-1])  # where each window starts in text
    of = np.empty(len(text), np.int32)
    of[order] = interval
    cls = of[at]
    found = np.full(int(interval[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(found, cls, np.repeat(docs, windows))
    return found[cls]


def remove_repeated_bytes(docs: DataFrame, least: int = 50, gram: int = 18, with_bytes: bool = False, hot: int = HOT) -> DataFrame:
    """Removes each byte that a string of ``least`` bytes covers which starts in a smaller doc_id too.

    docs: doc_id, text; other columns are not read. Texts are UTF-8 bytes; matches never cross
    documents, overlaps count, strings are judged on the input, and repeats inside one document stay.
    Returns doc_id, n_bytes, n_removed, n_spans (removed runs), kept_sha256, and kept (binary) if
    asked for.

    A null text has no bytes. A row without doc_id keeps all and removes nothing. Rows that repeat a
    doc_id are one document to each other: they remove nothing of each other. An empty table gives none.
    hot: from how many places on the windows around one common gram are spread over the shards.
    """

    def keys_of(table):
        return runs(*flat(ordered(table)[3]), least, gram)[0]

    def asked_pieces(texts, ids, sketch: Sketch, told):
        """The chunk's runs that may be elsewhere: hash, document, start, number of windows; of each its piece; of
        each piece the first run; and the pieces."""
        data, off = flat(texts)
        key, doc, start, count = runs(data, off, least, gram)
        maybe, hot = sketch.repeated(key, told)
        inside = np.flatnonzero(inside_twice(key) & ~maybe)
        u, inverse = np.unique(key[inside], return_inverse=True)
        low, high = np.full(len(u), len(ids), np.int64), np.full(len(u), -1, np.int64)
        np.minimum.at(low, inverse, doc[inside])
        np.maximum.at(high, inverse, doc[inside])
        maybe[inside] = (low != high)[inverse]
        hot = hot[maybe]
        key, doc, start, count = key[maybe], doc[maybe], start[maybe], count[maybe]
        if hot.any():
            key, doc, start, count = windows_alone(data, least, hot, key, doc, start, count)
        raw, pieces_of, first = data.tobytes(), {}, []
        piece = np.empty(len(key), np.int64)
        for n, (s, e) in enumerate(zip(start.tolist(), (start + count + (least - 1)).tolist(), strict=True)):
            piece[n] = at = pieces_of.setdefault(raw[s:e], len(first))
            if at == len(first):
                first.append(n)
        return data, off, key, doc, start, count, piece, np.array(first, np.int64), list(pieces_of)

    def shard_of(key, shards):
        return (mix(key, 7) % np.uint64(shards)).astype(np.int64)

    def ask(g, table, sketch, told, shards):
        *_, texts, ids = ordered(table)
        _, _, key, doc, _, count, _, first, found = asked_pieces(texts, ids, sketch, told)
        k, asked = [], []
        for q, at in dealt(shard_of(key[first], shards)):
            run = first[at]
            head = (count[run] + (least - 1)).astype("<u4").tobytes() + ids[doc[run]].tobytes() + mix(key[run], 8).astype("<u2").tobytes()
            k.append(q)
            asked.append(struct.pack("<q", len(at)) + head + b"".join([found[x] for x in at.tolist()]))
        return pa.table([pa.array(k, pa.int64()), pa.array([g] * len(k), pa.int64()), pa.array(asked, pa.binary())], schema=ASKED)

    def settle(table):
        lots, found, least_doc, part_of = [], {}, [], []
        for b in table["asked"]:
            raw = b.as_py()
            (m,) = struct.unpack("<q", raw[:8])
            size, ids, part = np.frombuffer(raw, "<u4", m, 8), np.frombuffer(raw, np.int64, m, 8 + 4 * m), np.frombuffer(raw, "<u2", m, 8 + 12 * m)
            ends = 8 + 14 * m + np.cumsum(size, dtype=np.int64)
            own = np.empty(m, np.int64)
            for n, (s, e, i) in enumerate(zip((ends - size).tolist(), ends.tolist(), ids.tolist(), strict=True)):
                own[n] = x = found.setdefault(raw[s:e], len(least_doc))
                if x == len(least_doc):
                    least_doc.append(i)
                    part_of.append(part[n])
                elif i < least_doc[x]:
                    least_doc[x] = i
            lots.append((own, ids, size))
        texts, least_doc = list(found), np.array(least_doc, np.int64)
        size = np.array([len(x) for x in texts], np.int64)
        windows = size - least + 1
        total = np.concatenate(([0], np.cumsum(windows)))
        smallest = np.empty(int(total[-1]), np.int64)
        parts = min(1 << 16, int(size.sum()) // PART + 1)  # pieces with a window in common are of one part
        for _, mine in dealt(np.array(part_of, np.int64) % parts):
            at = np.repeat(total[mine] - np.concatenate(([0], np.cumsum(windows[mine])))[:-1], windows[mine]) + np.arange(windows[mine].sum())
            smallest[at] = _smallest([texts[x] for x in mine.tolist()], size[mine], least_doc[mine], least)
        bits = []
        for own, ids, size in lots:
            c = size.astype(np.int64) - least + 1
            t = np.concatenate(([0], np.cumsum(c)))
            w = np.repeat(total[own] - t[:-1], c) + np.arange(t[-1])
            bits.append(np.packbits(smallest[w] < np.repeat(ids, c)).tobytes())
        return pa.table([table["g"], table["k"], pa.array(bits, pa.binary())], schema=ANSWER)

    def finish(table, sketch, told, settled, shards):
        rows_ids, rows_texts, place, texts, ids = ordered(table)
        data, off, key, doc, start, count, piece, first, found = asked_pieces(texts, ids, sketch, told)
        windows = count[first]
        total = np.concatenate(([0], np.cumsum(windows)))
        removed = np.zeros(int(total[-1]), bool)
        for q, at in dealt(shard_of(key[first], shards)):
            w = np.repeat(total[at] - np.concatenate(([0], np.cumsum(windows[at])))[:-1], windows[at]) + np.arange(windows[at].sum())
            removed[w] = np.unpackbits(np.frombuffer(settled[q], np.uint8), count=len(w)).astype(bool)
        gone = np.zeros(0, np.int64)
        if len(key):
            t = np.cumsum(count) - count
            here = np.arange(count.sum())
            later = ids[doc] > ids[doc[first]][piece]
            hit = removed[np.repeat(total[piece] - t, count) + here] | np.repeat(later, count)
            gone = (np.repeat(start - t, count) + here)[hit]
        mask = covered(gone, least, len(data))
        edge = mask & ~np.concatenate(([False], mask))[:-1]
        inner = off[(off < len(data))]
        edge[inner] |= mask[inner]
        spans, n_gone = np.concatenate(([0], np.cumsum(edge))), np.concatenate(([0], np.cumsum(mask)))
        rest = data[~mask].tobytes()
        results = []
        for d in range(len(off) - 1):
            a, b = int(off[d]), int(off[d + 1])
            own = rest[a - int(n_gone[a]) : b - int(n_gone[b])]
            results.append((b - a, int(n_gone[b] - n_gone[a]), int(spans[b] - spans[a]), hashlib.sha256(own).hexdigest(), own if with_bytes else None))
        rows = []
        for p, t in zip(place, rows_texts, strict=True):
            rows.append(results[p] if p >= 0 else (len(b := t.encode()), 0, 0, hashlib.sha256(b).hexdigest(), b if with_bytes else None))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 4 + with_bytes]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_bytes]
        return pa.table([pa.array(rows_ids, pa.int64()), *(pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds))], names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    return two_pass(docs, 1 / 13, keys_of, ask, settle, finish, schema, 2 << 20, weigh=True, hot=hot)
