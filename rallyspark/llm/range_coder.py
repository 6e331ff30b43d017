"""Context-mixing range coder for token ids, vectorised over blocks.

Ids (below 65536) are coded in blocks, of which numpy codes thousands side by side, one id of each block per step. Three
predictions are mixed for each id: order 2 says the id that most often follows the same two ids, order 1 the one that most
often follows the same id, order 0 the frequencies of all ids. The mixture is

    P(id) = w2 [id = said2] + w1 [id = said1] + w0 P0(id)

with weights learned in the context of both predictions' confidences: each order's share of successes there. Predictions,
frequencies and weights are learned from all ids of one call of encode() and stand, compressed, in the block before the
others; with it, any other block can be decoded alone. Every block carries a CRC-32.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK_IDS, LANES = 1024, 4096
#: Least successes of a prediction that is kept, by order.
LEAST1, LEAST2 = 2, 4
#: Bits of the mixing weights and of the order-0 frequencies; an id is coded in 2 ** (W + P) parts.
W, P = 10, 18
#: Shares of successes between two confidences; confidence 0 is no prediction.
STEPS = np.array([0.06, 0.12, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.88, 0.94, 0.975, 0.99, 0.997])
#: Ids whose intervals are worked out at once.
CHUNK = 1 << 15
_U, _I = np.uint64, np.int64
_LEAST, _SHIFT, _PARTS = _U(1 << 32), _U(32), _U(W + P)
HEAD = struct.Struct("<III")  # ids (none in the block of the model), 32-bit words, CRC-32
SIZES = struct.Struct("<III")  # of the model: different ids, order-1 predictions, order-2 predictions


def _slot(p, q):
    """Where order 2 looks: one of 65536 slots, by 16-bit products."""
    return (p * np.uint16(40503) + q * np.uint16(30011)).astype(np.intp)


def _at(table, places):
    return table.take(places, mode="clip")  # "raise" would copy


def _best(context: np.ndarray, ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, id that most often comes there, confidence), ascending, of contexts below 65536."""
    keys = np.sort(context.astype(np.uint32) << np.uint32(16) | ids.astype(np.uint32))
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    n, keys = np.diff(np.append(first, len(keys))), keys[first]
    of = keys >> np.uint32(16)
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    top = np.maximum.reduceat(n << 16 | (keys & np.uint32(0xFFFF)).astype(_I), first)
    hits, sure = top >> 16, np.searchsorted(STEPS, (top >> 16) / np.add.reduceat(n, first)) + 1
    kept = hits >= least
    return of[first][kept].astype(_I), top[kept] & 0xFFFF, sure[kept]


class _Model:
    """What is predicted, how surely and with which weights; the same for both directions."""

    def __init__(self, ids, counts, said1, said2, weights):
        """``ids`` ascending with their ``counts`` on 2 ** P parts; ``said`` are (contexts, ids, confidences)."""
        self.ids, self.counts, self.said1, self.said2, self.weights = ids, counts, said1, said2, weights
        self.of_part = np.repeat(ids.astype(np.uint16), counts)
        self.start, self.parts = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.start[ids], self.parts[ids] = np.cumsum(counts) - counts, counts
        self.orders = []
        for shift, (at, said, sure) in ((5, said2), (1, said1)):
            of = np.zeros(1 << 16, np.uint16), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)  # id, its parts, share of the context
            of[0][at], of[1][at], of[2][at] = said, self.parts[said], sure << shift
            self.orders.append(of)
        # The weights of orders 2 and 1 on all parts; the context's last bit says that both say the same.
        self.w2, self.w1 = (weights[:, k].astype(np.int32) << P for k in (0, 1))
        self.w0 = ((1 << W) - weights.sum(1)).astype(np.int32)

    @classmethod
    def learn(cls, x: np.ndarray, p: np.ndarray, q: np.ndarray) -> _Model:
        seen = np.bincount(x, minlength=1 << 16)
        ids = np.flatnonzero(seen)
        counts = np.maximum(1, seen[ids] * ((1 << P) - len(ids)) // len(x))
        counts[counts.argmax()] += (1 << P) - counts.sum()
        said1, said2 = _best(p, x, LEAST1), _best(_slot(p, q), x, LEAST2)
        model = cls(ids, counts, said1, said2, np.zeros((512, 2), np.uint16))
        n = np.zeros(1536, _I)  # by context: which order was the first that said the id
        for at in range(0, len(x), CHUNK):
            s = slice(at, at + CHUNK)
            context, *said = model.predict(p[s], q[s])
            right2, right1 = ((of == x[s]) & (parts > 0) for of, parts in said)
            n += np.bincount(context * 3 + (right1 + right2 * np.int8(2)).clip(max=2), minlength=1536)
        n = n.reshape(512, 3)
        # Order 0 has a part at least, since any id may come.
        return cls(ids, counts, said1, said2, (n[:, [2, 1]] * (((1 << W) - 1) / np.maximum(n.sum(1, keepdims=True), 1))).astype(np.uint16))

    def pack(self) -> bytes:
        parts = [SIZES.pack(len(self.ids), len(self.said1[0]), len(self.said2[0])), self.ids.astype("<u2"), self.counts.astype("<u4")]
        for at, said, sure in (self.said1, self.said2):
            parts += [np.diff(at, prepend=0).astype("<u2"), said.astype("<u2"), sure.astype("u1")]
        body = zlib.compress(b"".join(p if isinstance(p, bytes) else p.tobytes() for p in [*parts, self.weights.astype("<u2")]), 1)
        body += bytes(-len(body) % 4)
        return HEAD.pack(0, len(body) // 4, zlib.crc32(body)) + body

    @classmethod
    def unpack(cls, block: bytes) -> _Model:
        n, words, crc = HEAD.unpack_from(block)
        if n or words != (len(block) - HEAD.size) // 4 or zlib.crc32(block[HEAD.size:]) != crc:
            raise ValueError("the block of the model is damaged")
        body = zlib.decompressobj().decompress(block[HEAD.size:])
        at, (ids, *said) = SIZES.size, SIZES.unpack_from(body)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            at += n * np.dtype(kind).itemsize
            return np.frombuffer(body, kind, n, at - n * np.dtype(kind).itemsize).astype(_I)

        head = take("<u2", ids), take("<u4", ids)
        tables = [(np.cumsum(take("<u2", n)), take("<u2", n), take("u1", n)) for n in said]
        return cls(*head, *tables, take("<u2", 1024).reshape(512, 2))

    def predict(self, p, q):
        """(context of the weights, id and its parts in order 0 by order 2, the same by order 1) after the ids p and, before
        it, q; no parts where nothing is said."""
        (of2, parts2, sure2), (of1, parts1, sure1), at = *self.orders, _slot(p, q)
        p = p.astype(np.intp)
        said2, said1 = _at(of2, at), _at(of1, p)
        context = _at(sure2, at) + _at(sure1, p)
        context += said2 == said1
        return context, (said2, _at(parts2, at)), (said1, _at(parts1, p))

    def mixture(self, p, q):
        """(w0, parts of said2, parts of both, said2 and its parts in order 0, the same of said1). The parts of said2 are the
        first, those of said1 the next; the other ids follow in ascending order."""
        context, (said2, f2), (said1, f1) = self.predict(p, q)
        w0 = _at(self.w0, context)
        f1 *= ~context & 1  # said by order 2 already; its weight is 0 then
        n2 = w0 * f2 + _at(self.w2, context)
        return w0, n2, w0 * f1 + _at(self.w1, context) + n2, said2, f2, said1, f1

    def intervals(self, x, p, q) -> tuple[np.ndarray, np.ndarray]:
        """(start, parts) of the ids x."""
        w0, n2, both, said2, f2, said1, f1 = self.mixture(p, q)
        freq = w0 * _at(self.parts, x)
        start = both + w0 * (_at(self.start, x) - f2 * (x > said2) - f1 * (x > said1))
        for said, f, at, end in ((said1, f1, n2, both), (said2, f2, np.zeros_like(n2), n2)):
            i = np.flatnonzero((said == x) & (f > 0))
            start[i] = at[i]
            freq[i] = end[i] - at[i]
        return start, freq

    def find(self, target, p, q):
        """(id, start, parts) of the part ``target``."""
        w0, n2, both, said2, f2, said1, f1 = self.mixture(p, q)
        x, start, freq = np.empty_like(p), np.zeros(len(p), np.int32), n2.copy()
        by2, by1 = target < n2, target < both
        i = np.flatnonzero(by2)
        x[i] = said2[i]
        i = np.flatnonzero(by1 & ~by2)
        x[i], start[i], freq[i] = said1[i], n2[i], both[i] - n2[i]
        i = np.flatnonzero(~by1)
        w0, both, said2, f2, said1, f1 = w0[i], both[i], said2[i], f2[i], said1[i], f1[i]
        at2, at1 = _at(self.start, said2), _at(self.start, said1)
        # Exact: the quotient of whole numbers below 2 ** 53.
        part = ((target[i] - both) / w0).astype(np.int32)
        out = f2 * (part >= at2 - f1 * (at1 < at2))
        out += f1 * (part >= at1 - f2 * (at2 < at1))
        found = _at(self.of_part, part + out)
        x[i], start[i], freq[i] = found, both + w0 * (_at(self.start, found) - out), w0 * _at(self.parts, found)
        return x, start, freq


class _Encoder:
    """Range coders of many lanes: 64-bit low and width, 32-bit output words; carries go to the word before."""

    def __init__(self, lanes: int, longest: int):
        self.low, self.width = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
        self.stride = longest + 4
        self.words, self.n = np.zeros(lanes * self.stride, _U), np.arange(lanes) * self.stride + 1  # a word for the first carry

    def put(self, n: int, start, freq):
        """Codes parts [start, start + freq) for the first n lanes."""
        low, width, at = self.low[:n], self.width[:n], self.n[:n]
        step = width >> _PARTS
        np.multiply(step, freq, out=width)
        step *= start
        low += step
        carry = np.flatnonzero(low < step)
        if len(carry):
            self.words[at[carry] - 1] += _U(1)
        go = np.flatnonzero(width < _LEAST)
        if len(go):
            out = low[go]
            self.words[at[go]] = out >> _SHIFT
            at[go] += 1
            low[go] = out << _SHIFT
            width[go] <<= _SHIFT

    def finish(self) -> list[bytes]:
        for shift in (_SHIFT, _U(0)):
            self.words[self.n] = (self.low >> shift) & _U(0xFFFFFFFF)
            self.n += 1
        words = self.words.reshape(-1, self.stride)
        while (carries := words >> _SHIFT).any():  # a word that a carry has filled passes it on
            words &= _U(0xFFFFFFFF)
            words[:, :-1] += carries[:, 1:]
        plain = words.astype("<u4")
        return [row[1:n].tobytes() for row, n in zip(plain, (self.n % self.stride).tolist())]


class _Decoder:
    def __init__(self, words: np.ndarray):
        self.stride, self.words = words.shape[1], words.ravel()
        self.n = np.arange(len(words)) * self.stride + 2
        self.code = words[:, 0].astype(_U) << _SHIFT | words[:, 1]
        self.width = np.full(len(words), (1 << 64) - 1, _U)

    def target(self, n: int):
        self.step = self.width[:n] >> _PARTS
        return np.minimum(self.code[:n] // self.step, _U((1 << W + P) - 1)).astype(np.int32)

    def take(self, n: int, start, freq):
        code, width, at = self.code[:n], self.width[:n], self.n[:n]
        code -= start.astype(_U) * self.step
        np.multiply(self.step, freq.astype(_U), out=width)
        go = np.flatnonzero(width < _LEAST)
        if len(go):
            code[go] = code[go] << _SHIFT | np.take(self.words, at[go], mode="clip")
            at[go] += 1
            width[go] <<= _SHIFT


def _encode_lanes(start: np.ndarray, freq: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """``start`` and ``freq`` by step and lane; ``sizes`` must not rise from one lane to the next."""
    longest, lanes = start.shape
    coder = _Encoder(lanes, longest)
    for t in range(longest):
        n = int(np.count_nonzero(sizes > t))
        coder.put(n, start[t, :n].astype(_U), freq[t, :n].astype(_U))
    return coder.finish()


def _decode_lanes(model: _Model, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    coder = _Decoder(words)
    out = np.zeros((int(sizes.max(initial=0)) + 2, len(sizes)), np.uint16)  # the two ids before a block are 0
    for t in range(2, len(out)):
        n = int(np.count_nonzero(sizes > t - 2))
        out[t, :n], start, freq = model.find(coder.target(n), out[t - 1, :n], out[t - 2, :n])
        coder.take(n, start, freq)
    return out[2:].T


def encode(ids: np.ndarray, block_ids: int = BLOCK_IDS, lanes: int = LANES) -> list[bytes]:
    """The block of the model, then the coded blocks of a run of ids, each with its head; no ids give no blocks."""
    ids = np.asarray(ids)
    if not len(ids):
        return []
    if ids.min() < 0 or ids.max() > 0xFFFF:
        raise ValueError("ids must be below 65536")
    x = ids.astype(np.uint16)
    p, q = np.zeros_like(x), np.zeros_like(x)
    p[1:], q[2:] = x[:-1], x[:-2]
    p[::block_ids] = q[::block_ids] = 0
    q[1::block_ids] = 0
    model = _Model.learn(x, p, q)
    out = [model.pack()]
    for at in range(0, len(x), block_ids * lanes):
        n = -(-(min(len(x) - at, block_ids * lanes)) // block_ids)
        sizes = np.full(n, block_ids)
        sizes[-1] = min(block_ids, len(x) - at - block_ids * (n - 1))
        start, freq = np.zeros((block_ids, n), np.uint32), np.zeros((block_ids, n), np.uint32)
        rows = max(1, CHUNK // block_ids)
        for row in range(0, n, rows):
            s = slice(at + row * block_ids, at + min(n, row + rows) * block_ids)
            size = len(x[s])
            for whole, got in zip((start, freq), model.intervals(x[s], p[s], q[s])):
                full = size // block_ids
                whole[:, row: row + full] = got[: full * block_ids].reshape(full, block_ids).T
                whole[: size - full * block_ids, row + full: row + full + 1] = got[full * block_ids:, None]
        for k, (size, body) in enumerate(zip(sizes.tolist(), _encode_lanes(start, freq, sizes))):
            row = x[at + k * block_ids:][:size]
            out.append(HEAD.pack(size, len(body) // 4, zlib.crc32(row.astype("<u4").tobytes())) + body)
    return out


def decode(blocks: list[bytes], lanes: int = LANES) -> np.ndarray:
    """The ids of coded blocks, the block of their model first; raises if a block's checksum does not match."""
    out = [np.zeros(0, np.int64)]
    if not blocks:
        return out[0]
    model = _Model.unpack(blocks[0])
    for at in range(1, len(blocks), lanes):
        part = blocks[at: at + lanes]
        heads = [HEAD.unpack_from(b) for b in part]
        order = sorted(range(len(part)), key=lambda i: -heads[i][0])
        words = np.zeros((len(part), max(h[1] for h in heads)), np.uint32)
        for row, i in zip(words, order):
            row[: heads[i][1]] = np.frombuffer(part[i], "<u4", heads[i][1], HEAD.size)
        ids = _decode_lanes(model, words, np.array([heads[i][0] for i in order]))
        for i, (n, _, crc) in zip(np.argsort(order), heads):
            row = ids[i][:n]
            if zlib.crc32(row.astype("<u4").tobytes()) != crc:
                raise ValueError("a block of ids is damaged")
            out.append(row)
    return np.concatenate(out)
