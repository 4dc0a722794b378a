"""Byte-pair encoding: greedy proposals, vectorised checks of adjacent pairs, exact merging of what fails.

Words are encoded in bulk. A trie proposes the longest known token at every
position. The proposal is the right encoding if each token encodes to itself
and no two neighbours would have been merged across their border; the border
test walks the merge trees of both neighbours from the newest merge to the
oldest, for all pairs at once. Words with a failing pair are merged exactly,
again all at once: in each step every word performs its lowest-ranked merge.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_NONE = np.int32(2**31 - 1)
#: White space of the tokenizers' patterns (fixed values).
_WS = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_ODD_WS = "\t\x0b\x0c\r\x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))
#: Python takes these for white space, the patterns do not.
_NOT_WS = "\x1c\x1d\x1e\x1f"
#: Texts whose white space is more than single blanks and line feeds between words, as Arrow writes patterns.
_OTHER_WS = r"[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNEVEN = _OTHER_WS + r"|[ \n][ \n]|^[ \n]|[ \n]$"
#: Stands between chunks that are cut into words together; chunks that hold it go alone.
_SEP = "\ufdd0"
_SEP_BYTES = _SEP.encode()
#: Words of more bytes are merged one by one with a heap, shorter ones in bulk.
_BULK_BYTES = 256


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        letters[chr(256 + n)] = b
    return letters


def flat_words(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat bytes and sizes of an Arrow column of large strings or bytes without nulls."""
    _, offsets, raw = words.buffers()
    if not len(words) or raw is None:
        return np.empty(0, np.uint8), np.zeros(len(words), np.int64)
    offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]], np.diff(offsets)


def _runs(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` that ``at`` names, one behind the other, and their lengths."""
    kind = np.int32 if len(at) and int(lens.max()) * len(at) < 1 << 31 else np.int64
    counts = lens.astype(kind)[at]
    ends = np.cumsum(counts, dtype=kind)
    shift = starts.astype(kind)[at]
    shift -= ends
    shift += counts
    take = np.repeat(shift, counts)
    take += np.arange(len(take), dtype=kind)
    return flat[take], counts


#: Of every byte: letter 0, digit 1, line feed 2, other 3; lower case; whether a chunk with it is cut as a string.
_KIND, _LOWER, _SLOW = np.full(256, 3, np.uint8), np.arange(256, dtype=np.uint8), np.zeros(256, bool)
_KIND[[*range(65, 91), *range(97, 123)]], _KIND[48:58], _KIND[10] = 0, 1, 2
_LOWER[65:91] += 32
_SLOW[[9, 11, 12, 13, 32, *b"'<", *range(128, 256)]] = True


class Bpe:
    """Tables of one tokenizer file and the encoder over them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        letters = _byte_letters()
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        #: Bytes and end-of-word flag of every id.
        self.token_text: list[str] = [""] * size
        self.token_bytes: list[bytes] = [b""] * size
        self.ends = np.zeros(size, bool)
        for token, i in vocab.items():
            self.token_text[i] = token
            stem = token.removesuffix(self.suffix) if self.suffix and len(token) > len(self.suffix) else token
            self.ends[i] = stem != token
            self.token_bytes[i] = bytes(letters[c] for c in stem)
        for token, i in self.special.items():
            self.token_text[i], self.token_bytes[i] = token, token.encode()
        of_byte = {b: c for c, b in letters.items()}
        self.first = np.array([vocab[of_byte[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[of_byte[b] + self.suffix] for b in range(256)], np.int32)

        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.rank = np.full(size, -1, np.int32)  # of the merge that makes a token
        self.rank[made] = np.arange(len(made))
        self.left, self.right = np.arange(size, dtype=np.int32), np.arange(size, dtype=np.int32)
        self.left[made], self.right[made] = left, right
        self.made = made
        keys = (left << 16 | right).astype(np.uint32)
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], order.astype(np.int32)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self._slot(keys)] = True
        self.pair_rank = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self._build_trie()

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435761)) >> np.uint32(12)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, ``_NONE`` where there is none."""
        q = (a.astype(np.uint32) << np.uint32(16)) | b.astype(np.uint32)
        out = np.full(q.shape, _NONE, np.int32)
        some = np.nonzero(self.maybe[self._slot(q)])
        asked = q[some]
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        out[some] = np.where(self.keys[at] == asked, self.key_rank[at], _NONE)
        return out

    def _build_trie(self) -> None:
        """Trie of the tokens that encode to themselves: a table (inner node, byte) -> node.

        ``inside`` and ``at_end`` hold the token that a node completes inside
        a word and at its end.
        """
        ids = np.array([i for i, t in enumerate(self.token_bytes) if t and self.token_text[i] not in self.special])
        words = [self.token_bytes[i] for i in ids]
        flat, lens = self._merge(*flat_words(words), self.ends[ids] if self.suffix else np.zeros(len(ids), bool))
        ok = lens == 1
        ok[ok] = flat[np.cumsum(lens)[ok] - 1] == ids[ok]
        ids, words = ids[ok], [w for w, good in zip(words, ok.tolist(), strict=True) if good]
        text, size = flat_words(words)
        starts = np.cumsum(size) - size
        node, nodes = np.zeros(len(words), np.int64), 1
        edges = []
        for depth in range(int(size.max())):
            long = np.nonzero(size > depth)[0]
            key, back = np.unique(node[long] << 8 | text[starts[long] + depth], return_inverse=True)
            node[long] = nodes + back
            edges.append(np.stack([key >> 8, key & 0xFF, nodes + np.arange(len(key))]))
            nodes += len(key)
        parent, byte, child = np.concatenate(edges, axis=1)
        inner = np.unique(parent)
        self.row = np.full(nodes, len(inner), np.int32)  # the last row is empty: nothing follows a leaf
        self.row[inner] = np.arange(len(inner))
        self.step = np.zeros((len(inner) + 1, 256), np.int32)
        self.step[self.row[parent], byte] = child
        self.inside, self.at_end = np.full(nodes, -1, np.int32), np.full(nodes, -1, np.int32)
        closes = self.ends[ids] if self.suffix else np.ones(len(ids), bool)
        self.at_end[node[closes]] = ids[closes]
        opens = ~closes if self.suffix else closes
        self.inside[node[opens]] = ids[opens]

    # --- words -> ids -------------------------------------------------------

    def _greedy(self, text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest tokens from left to right, all words in step; flat ids and their number per word."""
        stop = np.cumsum(size)
        out = np.full(len(text), -1, np.int32)  # each token at the place of its first byte
        begin = stop - size
        at, start, end, top = begin, begin, begin, stop
        node, best = np.zeros(len(size), np.int32), np.full(len(size), -1, np.int32)
        while len(at):
            node = self.step[self.row[node], text[at]]
            moved = node > 0
            at = at + moved
            last = at == top
            token = np.where(last, self.at_end[node], self.inside[node])
            better = moved & (token >= 0)
            best, end = np.where(better, token, best), np.where(better, at, end)
            stuck = ~moved | last
            if stuck.any():
                out[start[stuck]] = best[stuck]
                at, start = np.where(stuck, end, at), np.where(stuck, end, start)
                node = np.where(stuck, np.int32(0), node)
                go = start < top
                if not go.all():
                    at, start, end, top, node, best = at[go], start[go], end[go], top[go], node[go], best[go]
        counts = np.add.reduceat(out >= 0, begin, dtype=np.int64) if len(size) else np.empty(0, np.int64)
        return out[out >= 0], counts

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the border of each pair of neighbours."""
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        x, y = a.astype(np.int32), b.astype(np.int32)
        over_x = np.full(len(a), _NONE, np.int32)  # rank of the merge that uses x up, on its own side
        over_y = over_x.copy()
        while len(at):
            r = self._ranks(x, y)
            # of equal merges the left one goes first
            bad = (r < over_x) & (r <= over_y) & (r != _NONE)
            good[at[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            at, x, y, over_x, over_y, rx, ry = (v[go] for v in (at, x, y, over_x, over_y, rx, ry))
            newer = rx > ry
            over_x, over_y = np.where(newer, rx, over_x), np.where(newer, over_y, ry)
            x, y = np.where(newer, self.right[x], x), np.where(newer, y, self.left[y])
        return good

    def _merge(self, text: np.ndarray, lens: np.ndarray, closed: np.ndarray | None = None):
        """Exact merging; flat ids and the number of ids per word. closed: which words end a word (all, if not given)."""
        begin, n = np.cumsum(lens) - lens, len(lens)
        counts = np.zeros(n, np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        low = 0
        for top in (4, 8, 12, 16, 24, 32, 64, 128, _BULK_BYTES):
            rows = np.nonzero((lens > low) & (lens <= top))[0]
            low = top
            for part in np.array_split(rows, max(1, len(rows) * top // (1 << 17))):
                if len(part):
                    shut = None if closed is None else closed[part]
                    found.append((part, self._merge_bulk(text, begin[part], lens[part], top, shut)))
        for i in np.nonzero(lens > _BULK_BYTES)[0]:
            word = text[begin[i] : begin[i] + lens[i]]
            found.append((np.array([i]), self._merge_long(word, closed is None or bool(closed[i]))[None, :]))
        for rows, ids in found:
            counts[rows] = (ids >= 0).sum(1)
        starts = np.concatenate(([0], np.cumsum(counts)))
        flat = np.empty(starts[-1], np.int32)
        for rows, ids in found:
            keep = ids >= 0
            flat[(starts[rows][:, None] + np.arange(ids.shape[1]))[keep]] = ids[keep]
        return flat, counts

    def _symbols(self, raw: np.ndarray, last_at: np.ndarray, closed: np.ndarray | None) -> np.ndarray:
        tok = self.first[raw]
        if self.suffix:
            rows = np.arange(len(raw)) if closed is None else np.nonzero(closed)[0]
            tok[rows, last_at[rows]] = self.last[raw[rows, last_at[rows]]]
        return tok

    def _merge_bulk(self, text, begin, lens, width: int, closed: np.ndarray | None) -> np.ndarray:
        """Ids per word, filled up with -1. Every step performs one merge in each word that still has one."""
        n, cols = len(lens), np.arange(width)
        raw = text[np.minimum(begin[:, None] + cols, len(text) - 1)]
        tok = self._symbols(raw, lens - 1, closed)
        tok[cols >= lens[:, None]] = -1
        ranks = np.full((n, width), _NONE, np.int32)
        live = cols[1:] < lens[:, None]
        ranks[:, :-1][live] = self._ranks(tok[:, :-1][live], tok[:, 1:][live])
        out, at = tok.copy(), np.arange(n)
        while len(at):
            j = ranks.argmin(1)
            row = np.arange(len(at))
            best = ranks[row, j]
            done = best == _NONE
            if done.any():
                out[at[done]] = tok[done]
                go = ~done
                at, tok, ranks, j, best = at[go], tok[go], ranks[go], j[go], best[go]
                if not len(at):
                    break
                row = np.arange(len(at))
            take = np.minimum(cols + (cols > j[:, None]), width - 1)
            tok[row, j] = self.made[best]
            tok = np.take_along_axis(tok, take, 1)
            tok[:, -1] = -1
            take = np.minimum(cols + (cols >= j[:, None]), width - 1)
            ranks = np.take_along_axis(ranks, take, 1)
            ranks[:, -1] = _NONE
            here, after = tok[row, j], tok[row, np.minimum(j + 1, width - 1)]
            ranks[row, j] = np.where((after >= 0) & (j + 1 < width), self._ranks(here, after), _NONE)
            some = j > 0
            ranks[row[some], j[some] - 1] = self._ranks(tok[row[some], j[some] - 1], here[some])
        return out

    def _merge_long(self, word: np.ndarray, closed: bool) -> np.ndarray:
        """One long word by a heap of (rank, place); linear in memory, n log n in time."""
        tok = self.first[word].tolist()
        if self.suffix and closed:
            tok[-1] = int(self.last[word[-1]])
        n, rank = len(tok), self.pair_rank
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank.get(tok[i] << 16 | tok[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = nxt[i]
            if tok[i] < 0 or j >= n or rank.get(tok[i] << 16 | tok[j]) != r:
                continue
            tok[i], tok[j] = int(self.made[r]), -1
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            for k in (prev[i], i):
                if k >= 0 and nxt[k] < n and (q := rank.get(tok[k] << 16 | tok[nxt[k]])) is not None:
                    heapq.heappush(heap, (q, k))
        return np.array([t for t in tok if t >= 0], np.int32)

    def encode_words(self, text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of every word; words are runs of ``size`` bytes of ``text``, none empty."""
        flat, counts = self._greedy(text, size)
        ends = np.cumsum(counts)
        word = np.repeat(np.arange(len(size)), counts)
        inner = np.nonzero(word[1:] == word[:-1])[0] if len(flat) else np.empty(0, np.int64)
        fails = np.zeros(len(size), bool)
        if len(inner):
            pair, back = np.unique(flat[inner].astype(np.int64) << 16 | flat[inner + 1], return_inverse=True)
            good = self._compatible(pair >> 16, pair & 0xFFFF)
            fails[word[inner[~good[back]]]] = True
        if not fails.any():
            return flat, counts
        redo = np.nonzero(fails)[0]
        bytes_at = np.repeat(fails, size)
        again, n_again = self._merge(text[bytes_at], size[redo])
        new = counts.copy()
        new[redo] = n_again
        starts = np.cumsum(new) - new
        out = np.empty(int(new.sum()), np.int32)
        keep = ~fails[word]
        place = np.arange(len(flat)) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)
        out[place[keep]] = flat[keep]
        again_at = np.repeat(starts[redo] - (np.cumsum(n_again) - n_again), n_again) + np.arange(len(again))
        out[again_at] = again
        return out, new

    # --- texts -> ids -------------------------------------------------------

    def _patterns(self):
        if not hasattr(self, "_pats"):
            import re

            import regex

            special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
            short = "'s|'t|'re|'ve|'m|'ll|'d"
            if self.suffix:
                # a line feed stands between chunks that are looked at together
                pieces = regex.compile(rf"{short}|\p{{L}}+|\p{{N}}|[^{_WS}\p{{L}}\p{{N}}]+|\n")
                ascii_pieces = re.compile(rf"{short}|[A-Za-z]+|[0-9]|[^\t-\r A-Za-z0-9]+|\n")
                chunks, alone = re.compile(f"[^{_WS}]+"), pieces
            else:
                tail = f"[{_WS}]+(?![^{_WS}])|[{_WS}]+"
                pieces = regex.compile(rf"{short}| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}{_SEP}\p{{L}}\p{{N}}]+|{tail}|{_SEP}")
                ascii_pieces = re.compile(rf"{short}| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9{_SEP}]+|{tail}|{_SEP}")
                chunks = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
                alone = regex.compile(pieces.pattern.removesuffix("|" + _SEP).replace(_SEP, ""))
            self._pats = special, pieces, ascii_pieces, chunks, alone
        return self._pats

    def chunks(self, text: str) -> list[str]:
        """Parts of a text that are encoded independently of each other.

        With word ends they are the words. Else a part is a run of white
        space with the word behind it; the blank of the common case is left
        out, and the first part carries two line feeds as its mark.
        """
        if self.suffix:
            if any(c in text for c in _NOT_WS):
                return self._patterns()[3].findall(text)
            return text.split()
        if not text:
            return []
        if "  " in text or "\n\n" in text or "\n " in text or " \n" in text or text[0] in " \n" or text[-1] in " \n" or not text.isascii() and any(c in text for c in _ODD_WS[4:]) or any(c in text for c in _ODD_WS[:4]):
            return ["\n\n" + c for c in self._patterns()[3].findall(text)]
        parts = text.replace("\n", " \n").split(" ")
        parts[0] = "\n\n" + parts[0]
        return parts

    def _odd_ids(self, chunk: str) -> np.ndarray:
        """Ids of a chunk that may hold special tokens, ends in white space or holds the separator."""
        ids = [np.empty(0, np.int32)]
        for part in self._patterns()[0].split(self._full(chunk)):
            if part in self.special:
                ids.append(np.array([self.special[part]], np.int32))
            elif part:
                part = self._normal(part)
                words = [w.encode() for w in self._patterns()[4].findall(part) if not (self.suffix and w == "\n")]
                ids.append(self.encode_words(*flat_words(words))[0])
        return np.concatenate(ids)

    def _full(self, chunk: str) -> str:
        if self.suffix:
            return chunk
        return chunk[2:] if chunk.startswith("\n\n") else chunk if chunk[:1] == "\n" else " " + chunk

    def _normal(self, text: str) -> str:
        if self.suffix:
            if text.isascii():
                return text.lower()
            text = unicodedata.normalize("NFC", text)
            # lower case letter by letter: no final sigma
            return text.lower() if "Σ" not in text else "".join(map(str.lower, text))
        return text

    def _plain_pieces(self, raw: np.ndarray, size: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, bytes per word, chunk of each word) of ASCII chunks of ``size`` bytes, none empty.

        Words are runs of letters, of digits and of other characters; ``blank``
        tells which chunks have a blank before them, which belongs to their first word.
        """
        begin = np.cumsum(size) - size
        if self.suffix:
            text, start = _LOWER[raw], begin
            kind = _KIND[text]
            head = kind == 1
        else:
            blank = blank & (raw[begin] != 10)  # a line feed takes the place of the blank
            wide = size + blank
            start = np.cumsum(wide) - wide
            text = np.full(len(raw) + int(blank.sum()), 32, np.uint8)
            text[np.arange(len(raw)) + np.repeat(np.cumsum(blank), size)] = raw
            kind = _KIND[text]
            head = np.zeros(len(text), bool)
        head[1:] |= kind[1:] != kind[:-1]
        if not self.suffix:
            head[start[blank] + 1] = False
        head[start] = True
        first = np.flatnonzero(head)
        owner = np.repeat(np.arange(len(size)), np.add.reduceat(head, start, dtype=np.int64)) if len(size) else first
        return text, np.diff(first, append=len(text)), owner

    def _joined_pieces(self, chunks: list[str], pattern: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of any chunks but odd ones; they are cut into words as one joined string."""
        sep = "\n" if self.suffix else _SEP
        text = self._normal(sep.join(chunks if self.suffix else map(self._full, chunks)))
        pieces = self._patterns()[pattern].findall(text)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(text.encode(), np.uint8)
        if len(raw) != len(text):  # characters to bytes
            begins = np.append(np.nonzero(raw & 0xC0 != 0x80)[0], len(raw))
            size = np.diff(begins[np.concatenate(([0], np.cumsum(size)))])
        start = np.cumsum(size) - size
        head = raw[start] == ord(sep) if self.suffix else (raw[start] == _SEP_BYTES[0]) & (size == len(_SEP_BYTES))
        if not self.suffix:
            some = np.nonzero(head)[0]
            for k, b in enumerate(_SEP_BYTES[1:], 1):
                head[some] &= raw[start[some] + k] == b
        return raw[np.repeat(~head, size)], size[~head], np.cumsum(head)[~head]

    def _encode_distinct(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``encode_words`` for words that repeat: each different word is encoded once."""
        offsets = np.concatenate(([0], np.cumsum(size)))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        coded = words.dictionary_encode()
        flat, counts = self.encode_words(*_bytes_of(coded.dictionary))
        return _runs(flat, np.cumsum(counts) - counts, counts, np.asarray(coded.indices))

    def _encode_chunks(self, names: pa.Array, heads: np.ndarray, more: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, first id and number of ids per chunk) of ``names``, of those at ``heads`` without a blank, of ``more``.

        ASCII words and numbers are cut into words by their bytes, the others as
        Python strings; then all words are encoded at once.
        """
        raw, size = _bytes_of(pa.concat_arrays([names, names.take(pa.array(heads))]))
        blank = np.arange(len(size)) < len(names)
        slow = np.concatenate(([0], np.cumsum(_SLOW[raw])))
        ends = np.cumsum(size)
        slow = slow[ends] > slow[ends - size]
        fast = np.flatnonzero(~slow & (size > 0))
        chosen = np.zeros(len(size), bool)
        chosen[fast] = True
        found = [(fast, self._plain_pieces(raw[np.repeat(chosen, size)], size[fast], blank[fast]))]
        rest = np.flatnonzero(slow)
        at = np.where(rest < len(names), rest, heads[np.maximum(rest - len(names), 0)] if len(heads) else 0)
        chunks = names.take(pa.array(at)).to_pylist()
        if not self.suffix:
            chunks = [c if spaced else "\n\n" + c for c, spaced in zip(chunks, blank[rest].tolist(), strict=True)]
        chunks += more
        rest = np.concatenate((rest, len(size) + np.arange(len(more))))
        odd = np.array([_SEP in c or "<|" in c and any(t in c for t in self.special) or c[-1:].isspace() for c in chunks], bool)
        plain = np.array([c.isascii() for c in chunks], bool)
        for some, pattern in ((np.flatnonzero(plain & ~odd), 2), (np.flatnonzero(~plain & ~odd), 1)):
            if len(some):
                found.append((rest[some], self._joined_pieces([chunks[i] for i in some.tolist()], pattern)))
        flat, counts = self._encode_distinct(np.concatenate([f[0] for _, f in found]), np.concatenate([f[1] for _, f in found]))
        owner = np.concatenate([at[f[2]] for at, f in found])
        own = [self._odd_ids(chunks[i]) for i in np.flatnonzero(odd).tolist()]
        n = np.bincount(owner, weights=counts, minlength=len(size) + len(more)).astype(np.int64)
        order = np.concatenate([at for at, _ in found])
        begin = np.zeros(len(n), np.int64)
        begin[order] = np.cumsum(n[order]) - n[order]
        begin[rest[odd]] = len(flat) + np.cumsum([0, *map(len, own)])[:-1]
        n[rest[odd]] = [len(x) for x in own]
        return np.concatenate([flat, *own]), begin, n

    def _split(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, list[str]]:
        """(place of each chunk among the distinct ones, chunks per text, and the distinct ones as ``_encode_chunks`` takes them).

        Arrow cuts the texts and finds the distinct chunks. Texts with uncommon
        white space are cut one by one.
        """
        column = pc.cast(texts, pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        odd = np.asarray(pc.match_substring_regex(column, _OTHER_WS if self.suffix else _UNEVEN))
        lists = pc.split_pattern(pc.replace_substring(pc.if_else(pa.array(odd), "", column), "\n", " " if self.suffix else " \n"), " ")
        counts = np.diff(lists.offsets.to_numpy())
        coded = lists.flatten().dictionary_encode()
        names, heads = coded.dictionary, np.empty(0, np.int64)
        at = np.asarray(coded.indices)
        if not self.suffix:
            # the first part of a text has no blank before it
            some = counts > 0
            first = (np.cumsum(counts) - counts)[some & ~odd & ~np.asarray(pc.equal(column, ""))]
            heads, place = np.unique(at[first], return_inverse=True)
            at = at.copy()
            at[first] = len(names) + place
        more: list[str] = []
        if odd.any():
            some = np.flatnonzero(odd)
            parts = [self.chunks(t) for t in column.take(pa.array(some)).to_pylist()]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            number = {c: i for i, c in enumerate(dict.fromkeys(chain.from_iterable(parts)), len(names) + len(heads))}
            values = np.fromiter((number[c] for p in parts for c in p), np.int64, int(sizes.sum()))
            at = np.insert(at, np.repeat(np.cumsum(counts)[some], sizes), values)
            counts = counts.copy()
            counts[some] += sizes
            more = list(number)
        return at, counts, names, heads, more

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each; no text is null.

        Nothing is kept from call to call: the more text a call gets, the more
        of its words repeat and are encoded once.
        """
        at, n_parts, *distinct = self._split(texts)
        pool, starts, lens = self._encode_chunks(*distinct)
        flat, counts = _runs(pool, starts, lens, at)
        ends = np.concatenate(([0], np.cumsum(counts)))
        return flat, np.diff(ends[np.concatenate(([0], np.cumsum(n_parts)))])

    # --- ids -> text --------------------------------------------------------

    def decode_rows(self, rows: list[np.ndarray]) -> list[str]:
        """The text of each row of ids.

        A byte-level vocabulary without word ends gives its bytes back; one
        with word ends has no decoding step of its own, and its tokens are
        joined by blanks.
        """
        if self.suffix:
            names = np.array(self.token_text, object)
            return [" ".join(names[ids].tolist()) for ids in rows]
        pieces = np.array(self.token_bytes, object)
        return [b"".join(pieces[ids].tolist()).decode("utf-8", "replace") for ids in rows]
