"""Simple-8b: 64-bit words of a 4-bit selector and as many equal slots as their widest id allows.

Ids are cut into blocks of BLOCK. A block has a widest slot: the narrowest that holds all but a sixteenth of its
ids. Wider ids are escapes: their slot has only ones and the id itself stands in the block's list of escapes.
Offsets of every block's words and escapes precede the payload, so any block can be decoded alone, and decoding
handles all words of one selector at once.
"""

from __future__ import annotations

import struct

import numpy as np

#: Ids a word holds and bits a slot has, by selector. Slots of no bits hold zeros.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)

_COUNT = COUNTS.tolist()
_SELECTOR = {count: selector for selector, count in enumerate(_COUNT[:-1])}

MAGIC = b"S8B1"
BLOCK = 4096
HEAD = struct.Struct("<4sIQII")


#: Bits of every 16-bit id.
_SMALL = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.int8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits each id needs."""
    if len(ids) and not int(ids.max()) >> 16:
        return _SMALL[ids.astype(np.uint16)]
    if len(ids) and int(ids.max()) >> 52:
        high = ids >> np.uint64(32)
        return np.where(high > 0, _widths(high) + 32, _widths(ids & np.uint64(0xFFFFFFFF))).astype(np.int8)
    return np.frexp(ids.astype(np.float64))[1].astype(np.int8)


def _widest(ids: np.ndarray, blocks: int, lengths: np.ndarray) -> np.ndarray:
    """The widest slot of each block, in bits: all ones are kept for escapes, so an id needs the bits of id + 1."""
    need = _widths(ids + np.uint64(1)).astype(np.int64)
    counts = np.bincount(np.arange(len(ids)) // BLOCK * 65 + need, minlength=blocks * 65).reshape(blocks, 65)
    held = np.cumsum(counts, axis=1)
    widest = np.full(blocks, 60, np.int64)
    for bits in BITS[:1:-1]:
        widest = np.where((lengths - held[:, bits]) * 16 <= lengths, bits, widest)
    return widest


def encode(ids: np.ndarray) -> tuple[bytes, int, int]:
    """The blocks of `ids` as bytes, the number of blocks, and the number of words."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(2, "<u4").tobytes(), 0, 0
    starts = np.arange(0, n, BLOCK)
    lengths = np.diff(np.append(starts, n))
    widest = _widest(ids, len(starts), lengths)
    marker = (np.uint64(1) << np.repeat(widest, lengths).astype(np.uint64)) - np.uint64(1)
    escaped = ids >= marker
    slots = np.where(escaped, marker, ids)
    end = np.repeat(starts + lengths, lengths)
    # The densest selector that fits from each position on: the widest of the next 2, 3, .. ids, block by block,
    # as long as any run is narrow enough. A block's last word may have idle slots.
    lanes = np.zeros((len(starts), BLOCK + 240), np.int8)
    flat = np.zeros(len(starts) * BLOCK, np.int8)
    flat[:n] = _widths(slots)
    lanes[:, :BLOCK] = flat.reshape(-1, BLOCK)
    run = lanes[:, :BLOCK].copy()
    best, rows = np.full(run.shape, 15, np.int8), np.arange(len(starts))
    for count in range(2, 241):
        np.maximum(run, lanes[:, count - 1 : count - 1 + BLOCK], out=run)
        selector = _SELECTOR.get(count)
        if selector is None:
            continue
        at, lane = np.nonzero(run <= BITS[selector])
        best[rows[at], lane] = selector
        if not selector:
            break
        # Only blocks with a run narrow enough for the next denser selector go on.
        narrow = (run <= BITS[selector - 1]).any(axis=1)
        if not narrow.all():
            run, lanes, rows = run[narrow], lanes[narrow], rows[narrow]
            if not len(rows):
                break
    best = best.reshape(-1)[:n]
    # All blocks step from word to word at once.
    at, stop, steps = starts.copy(), end[starts], []
    jump = COUNTS[best]
    while len(at):
        steps.append(at)
        at = at + jump[at]
        inside = at < stop
        if not inside.all():
            at, stop = at[inside], stop[inside]
    heads = np.sort(np.concatenate(steps))
    chosen = best[heads]
    words = chosen.astype(np.uint64) << np.uint64(60)
    room = end[heads] - heads
    padded = np.concatenate((slots, np.zeros(240, np.uint64)))
    for selector in np.flatnonzero(np.bincount(chosen, minlength=16)).tolist():
        if BITS[selector]:
            mine = np.flatnonzero(chosen == selector)
            at, own = heads[mine], words[mine]
            short = np.flatnonzero(room[mine] < COUNTS[selector])
            for k in range(_COUNT[selector]):
                part = padded[at + k]
                part[short[room[mine[short]] <= k]] = 0
                own |= part << np.uint64(k * int(BITS[selector]))
            words[mine] = own
    word_at = np.append(np.searchsorted(heads, starts), len(heads))
    escape_at = np.append(0, np.cumsum(np.add.reduceat(escaped, starts)))
    return (
        b"".join(
            (
                word_at.astype("<u4").tobytes(),
                escape_at.astype("<u4").tobytes(),
                widest.astype("u1").tobytes(),
                words.astype("<u8").tobytes(),
                ids[escaped].astype("<u8").tobytes(),
            )
        ),
        len(starts),
        len(heads),
    )


def pack(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """A segment: header, lengths of its documents, blocks."""
    body, blocks, _ = encode(ids)
    return HEAD.pack(MAGIC, len(lengths), len(ids), BLOCK, blocks) + lengths.astype("<u4").tobytes() + body


def unpack(data: bytes, only: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids and document lengths of a segment; with `only`, the ids of blocks from..to."""
    magic, docs, n, block, blocks = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a segment of this format")
    at = HEAD.size

    def take(count: int, kind: str) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    lengths = take(docs, "<u4").astype(np.int64)
    word_at, escape_at = take(blocks + 1, "<u4").astype(np.int64), take(blocks + 1, "<u4").astype(np.int64)
    if not n:
        return np.zeros(0, np.uint64), lengths
    widest = take(blocks, "u1")
    words, escapes = take(int(word_at[-1]), "<u8"), take(int(escape_at[-1]), "<u8")
    low, high = only or (0, blocks)
    words, escapes = words[word_at[low] : word_at[high]], escapes[escape_at[low] : escape_at[high]]
    sizes = np.minimum(block, n - np.arange(low, high) * block)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    held = COUNTS[selectors]
    # Where each word's first id goes, block by block: the last word of a block may hold fewer than its slots.
    first = np.append(0, np.cumsum(held))[:-1]
    word_block = np.repeat(np.arange(high - low), np.diff(word_at[low : high + 1]))
    block_from = np.append(0, np.cumsum(sizes))
    place = first - first[word_at[low:high] - word_at[low]][word_block] + block_from[word_block]
    out = np.zeros(block_from[-1] + 240, np.uint64)
    limit = block_from[word_block + 1]
    for selector in np.flatnonzero(np.bincount(selectors, minlength=16)).tolist():
        if BITS[selector]:
            mine = np.flatnonzero(selectors == selector)
            own, to, mask = words[mine], place[mine], np.uint64((1 << int(BITS[selector])) - 1)
            short = limit[mine] - to
            for k in range(_COUNT[selector]):
                if k and short.min() <= k:
                    fits = short > k
                    own, to, short = own[fits], to[fits], short[fits]
                    if not len(own):
                        break
                out[to + k] = (own >> np.uint64(k * int(BITS[selector]))) & mask
    out = out[: block_from[-1]]
    marker = (np.uint64(1) << np.repeat(widest[low:high], sizes).astype(np.uint64)) - np.uint64(1)
    out[out == marker] = escapes
    return out, lengths
