"""Unigram segmentation: Viterbi search over a double-array trie of pieces with log scores.

Space becomes the marker U+2581, a text gets one marker in front, and a character without a piece
falls back to its UTF-8 bytes at a score below all pieces. The marker stands at the front of a piece
only and no piece holds a line feed, so a text is searched unit by unit (markers and what follows
them), each distinct unit once. Decoding joins the pieces, turns markers to spaces and drops the
first one; a literal U+2581 is written in bytes, so every text comes back exactly.

Among equal scores the longest last piece wins, at every position.
"""

from __future__ import annotations

import functools
import re

import numpy as np

MARK = "▁"
UNIT = re.compile(f"\n|{MARK}| *[^ \n{MARK}]+| +")
UNKNOWN = 10.0  # below the lowest piece, a character
CELLS = 1 << 20  # units times length of a search; its tables take about 40 bytes a cell
ZIPF = 2.7  # log score of the piece of rank r: -log(r + ZIPF)


class DoubleArray:
    """A trie in two arrays: the child of state s by byte c is base[s] + c, if check there says s."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for key, v in keys.items():
            at = 0
            for c in key:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    value.append(-1)
                at = children[at][c]
            value[at] = v
        size = len(children) * 2 + 1024
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        free = np.ones(size, bool)
        free[0] = False
        place, start, hint = {0: 0}, 1, 1
        for node, kids in enumerate(children):  # parents come before children
            if not kids:
                continue
            codes = np.array(sorted(kids))
            while not free[start]:
                start += 1
            if len(codes) == 1 and start > codes[0]:  # most nodes: the first free slot
                lo = start - codes[0]
            else:  # next fit
                lo = hint = max(hint, start - codes[0], 1)
            while True:
                span = np.arange(lo, min(lo + 64, len(free) - 256))
                if not len(span):
                    more = len(free)
                    self.base, self.check, self.value = np.append(self.base, np.zeros(more, np.int32)), np.append(self.check, np.full(more, -1, np.int32)), np.append(self.value, np.full(more, -1, np.int32))
                    free = np.append(free, np.ones(more, bool))
                    continue
                ok = free[span[:, None] + codes].all(1)
                if ok.any():
                    b = int(span[ok.argmax()])
                    hint = b if len(codes) > 1 else hint
                    break
                lo = int(span[-1]) + 1
            s = place[node]
            self.base[s] = b
            for c, kid in kids.items():
                free[b + c] = False
                self.check[b + c], self.value[b + c], place[kid] = s, value[kid], b + c
        self.check[0] = -1


class Unigram:
    """pieces: (text, id, log score) of ordinary pieces; byte_ids: the ids of the 256 byte pieces."""

    def __init__(self, pieces: list[tuple[str, int, float]], byte_ids: list[int]):
        if any(MARK in p.lstrip(MARK) or "\n" in p for p, _, _ in pieces):
            raise ValueError("a marker inside a piece or a line feed: texts can't be cut into units")
        self.trie = DoubleArray({p.encode(): i for p, i, _ in pieces})
        self.score = np.full(max([i for _, i, _ in pieces] + byte_ids) + 1, -np.inf)
        for _, i, s in pieces:
            self.score[i] = s
        self.unknown = min(s for _, _, s in pieces) - UNKNOWN
        self.bytes = np.array(byte_ids, np.uint32)
        self.text = {i: p.replace(MARK, " ").encode() for p, i, _ in pieces} | {i: bytes([b]) for b, i in enumerate(byte_ids)}

    def units(self, text: str) -> list[str]:
        return UNIT.findall(" " + text)

    def segment(self, units: list[str]) -> list[list[int]]:
        """The best ids of each unit; units of like length are searched together, CELLS bytes at most or one unit."""
        raw = [self._as_bytes(u) for u in units]
        out: list[list[int]] = [[] for _ in units]
        order = sorted(range(len(units)), key=lambda i: len(raw[i]))
        at = 0
        while at < len(order):
            width = len(raw[order[at]]) * 5 // 4 + 4
            end = at
            while end < len(order) and end - at < 8192 and len(raw[order[end]]) <= width and (end == at or (end - at + 1) * len(raw[order[end]]) <= CELLS):
                end += 1
            group = order[at:end]
            for i, ids in zip(group, self._viterbi([raw[i] for i in group]), strict=True):
                out[i] = ids
            at = end
        return out

    @staticmethod
    def _as_bytes(unit: str) -> bytes:
        return unit.replace(" ", MARK).encode() if unit != MARK else b"\xff"  # no UTF-8 byte: a literal marker

    def _viterbi(self, raw: list[bytes]) -> list[list[int]]:
        n, sizes = len(raw), np.array([len(r) for r in raw])
        length = int(sizes.max())
        data = np.zeros((n, length), np.int32)
        for i, r in enumerate(raw):
            data[i, : len(r)] = np.frombuffer(r, np.uint8)
        chars = np.select([data < 0x80, data < 0xE0, data < 0xF0], [1, 2, 3], 4)
        chars[data == 0xFF] = 1
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((n, length + 1), np.int32), np.full((n, length + 1), -1, np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for s in range(length):
            rows = np.flatnonzero((best[:, s] > -np.inf) & (sizes > s))
            if not len(rows):
                continue
            start, end = rows, s + chars[rows, s]
            whole = np.zeros(n, bool)  # whether a piece is just this character
            state, k = np.zeros(len(rows), np.int32), s
            while len(rows):
                to = base[state] + data[rows, k]
                ok = check[to] == state
                rows, state, k = rows[ok], to[ok], k + 1
                v = value[state]
                hit = v >= 0
                r, v = rows[hit], v[hit]
                whole[r[chars[r, s] == k - s]] = True
                new = best[r, s] + self.score[v]
                up = new > best[r, k]
                r = r[up]
                best[r, k], back[r, k], piece[r, k] = new[up], s, v[up]
                go = sizes[rows] > k
                rows, state = rows[go], state[go]
            lone = ~whole[start]
            r, e = start[lone], end[lone]
            new = best[r, s] + self.unknown
            up = new > best[r, e]
            r, e = r[up], e[up]
            best[r, e], back[r, e], piece[r, e] = new[up], s, -1
        out = []
        for i, r in enumerate(raw):
            ids, at = [], len(r)
            back_, piece_ = back[i, : at + 1].tolist(), piece[i, : at + 1].tolist()
            while at:
                frm, v = back_[at], piece_[at]
                chunk = MARK.encode() if r[frm:at] == b"\xff" else r[frm:at]
                ids += [v] if v >= 0 else [int(self.bytes[b]) for b in reversed(chunk)]
                at = frm
            out.append(ids[::-1])
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.text.__getitem__, ids))[1:].decode()


@functools.lru_cache(2)
def load(path: str) -> Unigram:
    """The pieces of a SentencePiece model file. Such a file of merge type has ranks, no probabilities:
    the log score of a piece is then Zipf's for its rank."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    byte_ids = [i for i in ids if sp.is_byte(i)]
    plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    rank = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-sp.get_score(i), i)))}
    return Unigram([(sp.id_to_piece(i), i, -float(np.log(rank[i] + ZIPF))) for i in plain], byte_ids)
