"""Repeated word windows, found through a count-min prefilter and removed exactly."""

from __future__ import annotations

import hashlib
import struct
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .sketch import ASKED, ANSWER, Sketch, dealt, inside_twice, ordered, two_pass
from .textkit import BLANK, covered, flat, grams, mix, pieces, whole, word_hashes, words

PIECE = 1 << 17


class Words(NamedTuple):
    """Bytes of texts and where each begins; starts and ends of all words, and each text's first word."""

    data: np.ndarray
    off: np.ndarray
    s: np.ndarray
    e: np.ndarray
    woff: np.ndarray


def scan(texts: pa.Array, n: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of texts; hash and first word of every window of n words, in order."""
    data, off = flat(texts)
    starts, ends, firsts, hashes, at, done = [], [], [np.zeros(1, np.int64)], [], [], 0
    for i, j in pieces(off, PIECE):
        own = data[off[i] : off[j]]
        s, e, woff = words(own, off[i : j + 1] - off[i], BLANK)
        g = grams(word_hashes(own, s, e), n)
        ok = np.flatnonzero(whole(woff, n, len(g)))
        starts.append(s + off[i])
        ends.append(e + off[i])
        firsts.append(woff[1:] + done)
        hashes.append(mix(g[ok], 1))
        at.append(ok + done)
        done += len(s)
    none = np.zeros(0, np.int64)
    s, e, at = (np.concatenate(x) if x else none for x in (starts, ends, at))
    return Words(data, off, s, e, np.concatenate(firsts)), np.concatenate(hashes) if hashes else none.astype(np.uint64), at


def digests(w: Words, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of BLAKE2b over each window's words, joined by one space."""
    data, keep = w.data.copy(), np.zeros(len(w.data) + 1, np.int8)
    keep[w.s] += 1
    keep[w.e] -= 1
    keep = np.cumsum(keep[:-1], dtype=np.int8)
    gap = w.e[:-1][w.s[1:] > w.e[:-1]]
    data[gap] = 0x20
    keep[gap] = 1
    place = np.concatenate(([0], np.cumsum(keep)))
    raw, blake = memoryview(data[keep.view(bool)]), hashlib.blake2b
    out = [blake(raw[a:b], digest_size=16).digest() for a, b in zip(place[w.s[at]].tolist(), place[w.e[at + (n - 1)]].tolist(), strict=True)]
    both = np.frombuffer(b"".join(out), np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def remove_repeated_windows(docs: DataFrame, n: int = 20, with_text: bool = False) -> DataFrame:
    """Removes each word that a window of n words covers which starts earlier in the corpus too.

    docs: doc_id, text; other columns are not read. Words are what white space in ASCII separates,
    unchanged. A window starts earlier in a smaller doc_id, or in the same document at a smaller
    place; windows are judged on the input. Returns doc_id, n_words, n_removed, kept_sha256, and
    kept_text if asked for: the kept words, joined by one space.

    The sketch counts 64-bit hashes, so it may only let through too many windows; those are grouped by
    a cryptographic digest of 128 bits of their words.

    A null text has no words. A row without doc_id has no place in the order: it keeps all and
    removes nothing. A row repeated with the same doc_id and text gets the same result as the
    other; of two texts with one doc_id, the smaller text comes first. An empty table gives none.
    """

    def keys_of(table):
        return scan(ordered(table)[3], n)[1]

    def flagged(texts, sketch: Sketch, told):
        """The words; first words of the windows that may be elsewhere, their digests, the places of the first of
        each among them, and which those are."""
        w, h, at = scan(texts, n)
        at = at[sketch.repeated(h, told)[0] | inside_twice(h)]
        lo, hi = digests(w, at, n)
        order = np.lexsort((hi, lo))
        new = np.ones(len(at), bool)
        new[1:] = (lo[order][1:] != lo[order][:-1]) | (hi[order][1:] != hi[order][:-1])
        return w, at, lo, hi, np.sort(order[new])

    def ask(g, table, sketch, told, shards):
        *_, texts, ids = ordered(table)
        w, at, lo, hi, first = flagged(texts, sketch, told)
        lo, hi, doc = lo[first], hi[first], np.searchsorted(w.woff, at[first], "right") - 1
        k, asked = [], []
        for q, own in dealt((lo % np.uint64(shards)).astype(np.int64)):
            in_docs, inside = np.unique(doc[own], return_inverse=True)
            k.append(q)
            asked.append(struct.pack("<qq", len(own), len(in_docs)) + lo[own].tobytes() + hi[own].tobytes() + ids[in_docs].tobytes() + inside.astype("<u4").tobytes())
        return pa.table([pa.array(k, pa.int64()), pa.array([g] * len(k), pa.int64()), pa.array(asked, pa.binary())], schema=ASKED)

    def settle(table):
        lo, hi, ids = [], [], []
        for b in table["asked"]:
            b = b.as_buffer()
            m, docs_in = struct.unpack("<qq", b[:16])
            lo.append(np.frombuffer(b, np.uint64, m, 16))
            hi.append(np.frombuffer(b, np.uint64, m, 16 + 8 * m))
            ids.append(np.frombuffer(b, np.int64, docs_in, 16 + 16 * m)[np.frombuffer(b, "<u4", m, 16 + 16 * m + 8 * docs_in)])
        sizes = [len(x) for x in lo]
        lo, hi, ids = np.concatenate(lo), np.concatenate(hi), np.concatenate(ids)
        order = np.lexsort((ids, hi, lo))
        a, b = lo[order], hi[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        least = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        later = np.empty(len(order), bool)
        later[order] = ids[order] != least
        bits = [np.packbits(x).tobytes() for x in np.split(later, np.cumsum(sizes)[:-1])]
        return pa.table([table["g"], table["k"], pa.array(bits, pa.binary())], schema=ANSWER)

    def finish(table, sketch, told, settled, shards):
        rows_ids, rows_texts, place, texts, _ = ordered(table)
        w, at, lo, _, first = flagged(texts, sketch, told)
        later = np.ones(len(at), bool)
        for q, own in dealt((lo[first] % np.uint64(shards)).astype(np.int64)):
            later[first[own]] = np.unpackbits(np.frombuffer(settled[q], np.uint8), count=len(own)).astype(bool)
        results = _cut(w, covered(at[later], n, len(w.s)), with_text)
        alone = list({t for p, t in zip(place, rows_texts, strict=True) if p < 0})
        if alone:
            w = scan(pa.array(alone, pa.large_string()), n)[0]
            alone = dict(zip(alone, _cut(w, np.zeros(len(w.s), bool), with_text), strict=True))
        rows = [results[p] if p >= 0 else alone[t] for p, t in zip(place, rows_texts, strict=True)]
        kinds, names = [pa.int64(), pa.int64(), pa.string(), pa.string()], ["n_words", "n_removed", "kept_sha256", "kept_text"]
        own = 3 + with_text
        return pa.table([pa.array(rows_ids, pa.int64()), *(pa.array([r[c] for r in rows], kinds[c]) for c in range(own))], ["doc_id", *names[:own]])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return two_pass(docs, 1 / 6, keys_of, ask, settle, finish, schema)


def _cut(w: Words, gone: np.ndarray, with_text: bool) -> list[tuple[int, int, str, str | None]]:
    """Of each text (words, removed words, digest of the rest, the rest); gone: which words go."""
    results = []
    for i, j in pieces(w.off, PIECE):
        at, woff = w.off[i], w.woff[i : j + 1] - w.woff[i]
        mine = slice(w.woff[i], w.woff[j])
        s, e, kept = w.s[mine] - at, w.e[mine] - at, ~gone[mine]
        own = w.data[at : w.off[j]].copy()
        total = np.concatenate(([0], np.cumsum(kept)))
        step = np.zeros(len(own) + 1, np.int8)
        step[s[kept]] += 1
        step[e[kept]] -= 1
        keep = np.cumsum(step[:-1], dtype=np.int8) > 0
        index = np.flatnonzero(kept)
        more = np.ones(len(index), bool)  # not the last that is kept of its document
        ends = total[woff[1:]]
        more[ends[ends > total[woff[:-1]]] - 1] = False
        gap = e[index[more]]
        own[gap] = 0x20
        keep[gap] = True
        out = own[keep].tobytes()
        cut = np.concatenate(([0], np.cumsum(keep)))[w.off[i : j + 1] - at]
        for d in range(j - i):
            rest = out[cut[d] : cut[d + 1]]
            m = int(woff[d + 1] - woff[d])
            results.append((m, m - int(total[woff[d + 1]] - total[woff[d]]), hashlib.sha256(rest).hexdigest(), rest.decode() if with_text else None))
    return results
