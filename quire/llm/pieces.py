"""SentencePiece encoding and decoding with an Aho-Corasick automaton over the pieces.

One pass over the text feeds the automaton; at each position its output links give every piece that ends there, and
each relaxes the best state of that position from the state where the piece starts. For unigram models the state is
the best sum of scores (Viterbi). A BPE model's segmentation is not the best sum of its scores, so for BPE models the
state is the last piece of the prefix's own BPE segmentation: of the pieces that end at a position, the right one is
the one that may stand after the state at its start, that is, whose pair with it BPE leaves as it is.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import free_name, slices

MARK = "▁"
UNIGRAM, BPE = 1, 2
#: Entries of the caches of words and pairs in each Python worker.
CACHE = 250_000
#: Words of more characters run through the automaton one by one; the others so many at a time.
SHORT, BLOCK = 64, 1 << 15
#: Bytes of Arrow data that are encoded or decoded at a time: the arrays of words and ids take some twenty times as much.
PART_BYTES = 1 << 20


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """x, or a copy with room for n entries and more."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(len(x), n - len(x)), x.dtype)])


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Top-level fields of a protocol buffer message: number, and value or bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield tag >> 3, data[at : at + size]
            at += size


class Tables:
    """The automaton of some pieces as arrays, for many words at a time.

    piece: the piece that a state spells, or -1; link: the longest proper suffix of it that is a piece (the output
    link), 0 if none; top: the state itself if it spells a piece, else its link. Edges lie in a hash table.
    """

    def __init__(self, pieces: dict[str, int]) -> None:
        child: dict[tuple[int, int], int] = {}
        edges: list[list[tuple[int, int]]] = [[]]
        piece = [-1]
        for text, k in pieces.items():
            at = 0
            for c in map(ord, text):
                to = child.get((at, c))
                if to is None:
                    to = child[at, c] = len(edges)
                    edges[at].append((c, to))
                    edges.append([])
                    piece.append(-1)
                at = to
            piece[at] = k
        fail, link, queue = [0] * len(edges), [0] * len(edges), [0]
        for at in queue:
            link[at] = fail[at] if piece[fail[at]] >= 0 else link[fail[at]]
            for c, to in edges[at]:
                f = fail[at]
                while f and (f, c) not in child:
                    f = fail[f]
                fail[to] = child.get((f, c), 0) if at else 0
                queue.append(to)
        self.fail, self.link, self.piece = np.array(fail), np.array(link), np.array(piece)
        self.top = np.where(self.piece >= 0, np.arange(len(piece)), self.link)
        self.bits = max(4, len(child)).bit_length() + 2
        self.keys, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        for (at, c), to in child.items():
            key = at << 21 | c
            slot = int(self._slot(np.array([key]))[0])
            while self.keys[slot] >= 0:
                slot = (slot + 1) % len(self.keys)
            self.keys[slot], self.to[slot] = key, to

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _child(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Where edges lead; -1 where there is none."""
        key = state << 21 | char
        slot = self._slot(key)
        out, rest = np.full(len(key), -1, np.int64), np.arange(len(key))
        while len(rest):
            found = self.keys[slot]
            hit = found == key
            out[rest[hit]] = self.to[slot[hit]]
            go = ~hit & (found >= 0)
            rest, key, slot = rest[go], key[go], (slot[go] + 1) % len(self.keys)
        return out

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The states after a character each, along failure links where there is no edge."""
        char = char.astype(np.int64)
        out = self._child(state, char)
        rest = np.flatnonzero((out < 0) & (state > 0))
        state = state[rest]
        while len(rest):
            state = self.fail[state]
            got = self._child(state, char[rest])
            out[rest] = got
            go = (got < 0) & (state > 0)
            rest, state = rest[go], state[go]
        return np.maximum(out, 0)


class Pieces:
    """A .model file's pieces; encode and decode give what the library gives."""

    def __init__(self, data: bytes, kind: int | None = None) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        lib = self.library
        spec = dict(x for x in _fields(data) if x[0] in (2, 3))
        self.kind = kind or dict(_fields(spec.get(2, b""))).get(3, UNIGRAM)
        rules = dict(_fields(spec.get(3, b"")))
        self.plain = not rules.get(2) and not rules.get(4, 1) and rules.get(3, 1) == 1 and rules.get(5, 1) == 1
        n = lib.get_piece_size()
        self.text = [lib.id_to_piece(i) for i in range(n)]
        self.is_byte = [lib.is_byte(i) for i in range(n)]
        self.byte_of = {int(self.text[i][3:5], 16): i for i in range(n) if self.is_byte[i]}
        self.hidden = {i for i in range(n) if lib.is_control(i)}
        self.unk = lib.unk_id()
        self.score = {}
        self.id_of = {}
        machine = ahocorasick.Automaton()
        for i in range(n):
            if not (self.is_byte[i] or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.id_of[self.text[i]] = i
                self.score[i] = lib.get_score(i)
        # a piece that BPE does not build from its own text can never be a state
        self.whole = {i for t, i in self.id_of.items() if self.kind != BPE or self.merged(t) == [t]}
        for i in self.whole:
            machine.add_word(self.text[i], i)
        machine.make_automaton()
        self.size = np.array([len(t) for t in self.text], np.int64)
        self.machine = machine
        self.tables = Tables({self.text[i]: i for i in sorted(self.whole)}) if self.kind == BPE else None
        self.unknown_score = min(self.score.values(), default=0.0) - 10.0
        # no piece goes on past a mark that follows another character: words can be encoded one by one
        self.by_word = all(MARK not in p.lstrip(MARK) for p in self.id_of)
        # words met so far: their number, where their ids start, and how many those are
        self.place: dict[str, int] = {}
        self.flat, self.start, self.many, self.filled = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0
        plain = [self._bytes(i) for i in range(n)]
        cut = [p[1:] if self.text[i].startswith(MARK) and i != self.unk else p for i, p in enumerate(plain)]
        self.spellings = pa.array([*plain, *cut], pa.binary())
        self.pairs: dict[int, bool] = {}
        self.pair_keys, self.pair_fits = np.array([-1], np.int64), np.array([False])
        self.edges: dict[int, tuple[set[str], set[str]]] = {}

    def _bytes(self, k: int) -> bytes:
        """What an id stands for in a text."""
        if self.is_byte[k]:
            return bytes([int(self.text[k][3:5], 16)])
        return " ⁇ ".encode() if k == self.unk else self.text[k].replace(MARK, " ").encode()

    def normal(self, text: str) -> str:
        return (MARK + text.replace(" ", MARK) if text else "") if self.plain else self.library.normalize(text)

    # BPE

    def merged(self, text: str) -> list[str]:
        """BPE by its definition, for short strings: the adjacent pair whose union scores best is joined, leftmost first."""
        parts = list(text)
        while (at := self._next(parts)) >= 0:
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _next(self, parts: list[str]) -> int:
        """Which part BPE joins to the one after it; -1 if none."""
        best, at = None, -1
        for i in range(len(parts) - 1):
            k = self.id_of.get(parts[i] + parts[i + 1])
            if k is not None and (best is None or self.score[k] > best):
                best, at = self.score[k], i
        return at

    def _edges(self, k: int) -> tuple[set[str], set[str]]:
        """All that stands first, and all that stands last, while BPE builds a piece."""
        got = self.edges.get(k)
        if got is None:
            parts, first, last = list(self.text[k]), set(), set()
            while True:
                first.add(parts[0])
                last.add(parts[-1])
                at = self._next(parts)
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            got = self.edges[k] = first, last
        return got

    def may_follow(self, a: int, b: int) -> bool:
        """Whether BPE leaves the two pieces apart where they meet: surely so if nothing that meets there is a piece."""
        if not any(x + y in self.id_of for x in self._edges(a)[1] for y in self._edges(b)[0]):
            return True
        return self.merged(self.text[a] + self.text[b]) == [self.text[a], self.text[b]]

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """may_follow() of arrays, each pair worked out once."""
        key = a * len(self.text) + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        out = self.pair_fits[at]
        for i in np.flatnonzero(self.pair_keys[at] != key).tolist():
            got = self.pairs.get(k := int(key[i]))
            if got is None:
                got = self.pairs[k] = self.may_follow(int(a[i]), int(b[i]))
            out[i] = got
        return out

    def _settle_pairs(self) -> None:
        """New pairs join the sorted ones; all are forgotten when they are too many."""
        if not self.pairs:
            return
        keys, fits = np.fromiter(self.pairs, np.int64), np.fromiter(self.pairs.values(), bool)
        if len(self.pair_keys) + len(keys) <= CACHE:
            keys, fits = np.concatenate([self.pair_keys, keys]), np.concatenate([self.pair_fits, fits])
        keys, at = np.unique(np.append(keys, -1), return_index=True)
        self.pair_keys, self.pair_fits = keys, np.append(fits, False)[at]
        self.pairs.clear()

    def _bpe_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of short words end to end, and how many each has: all words go through the automaton side by side."""
        table = self.tables
        joined = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        long = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(long) - long
        last = np.full((int(long.max(initial=0)) + 1, len(words)), -1, np.int32)
        order = np.argsort(-long, kind="stable")
        begin_of, state = begin[order], np.zeros(len(words), np.int64)
        for at in range(1, len(last)):
            n = int(np.searchsorted(-long[order], -at, side="right"))  # words that reach this position
            state = table.step(state[:n], joined[begin_of[:n] + at - 1])
            word, here = np.arange(n), table.top[state]
            while True:  # down the output links, until the position has a state
                live = np.flatnonzero(here)
                if not len(live):
                    break
                word, here = word[live], here[live]
                k = table.piece[here]
                before = last[at - self.size[k], word].astype(np.int64)
                fits = before < 0
                tied = np.flatnonzero(~fits)
                fits[tied] = self._fits(before[tied], k[tied])
                last[at, word[fits]] = k[fits]
                word, here = word[~fits], table.link[here[~fits]]
        if len(self.pairs) > 1000 + len(self.pair_keys) // 8:
            self._settle_pairs()

        kept, word = np.zeros(len(joined), bool), np.flatnonzero(long[order])
        at = long[order][word]
        while len(word):
            kept[begin_of[word] + at - 1] = True
            k = last[at, word]
            at = at - np.where(k < 0, 1, self.size[k])
            word, at = word[at > 0], at[at > 0]
        spot = np.flatnonzero(kept)
        owner = np.repeat(np.arange(len(words)), long)[spot]
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        ids = last[spot + 1 - begin[owner], place[owner]].astype(np.int64)
        lone = np.flatnonzero(ids < 0)  # characters without a piece
        chars, which = np.unique(joined[spot[lone]], return_inverse=True)
        spelt = [[self.byte_of[x] for x in chr(c).encode()] if self.byte_of else [self.unk] for c in chars.tolist()]
        count = np.ones(len(ids), np.int64)
        count[lone] = np.array([len(x) for x in spelt], np.int64)[which] if len(lone) else 0
        out, start = np.repeat(ids, count), np.cumsum(count) - count
        for i in range(max(map(len, spelt), default=0)):
            has = count[lone] > i
            out[start[lone[has]] + i] = np.array([x[i] if i < len(x) else -1 for x in spelt], np.int64)[which[has]]
        owner = np.repeat(owner, count)
        if not self.byte_of:
            again = np.concatenate(([False], (out[1:] == self.unk) & (out[:-1] == self.unk) & (owner[1:] == owner[:-1])))
            out, owner = out[~again], owner[~again]
        return out, np.bincount(owner, minlength=len(words))

    def _bpe(self, text: str) -> list[int]:
        # where no piece fits, the state is a character without a piece: -1, after which every piece may stand
        last, size = [-1] * (len(text) + 1), [1] * (len(text) + 1)
        length = self.size
        for end, k in self.machine.iter(text):
            end += 1
            if last[end] < 0:
                a = last[end - length[k]]
                if a < 0 or self.may_follow(a, k):
                    last[end], size[end] = k, length[k]
        return self._trace(text, last, size)

    # unigram

    def _viterbi(self, text: str) -> list[int]:
        n = len(text)
        best, last, size = [float("-inf")] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        done = 0

        def settle(upto: int) -> None:
            """A character without a piece costs the unknown score."""
            nonlocal done
            while done < upto:
                done += 1
                if not size[done] or (text[done - 1] not in self.id_of and best[done - 1] + self.unknown_score > best[done]):
                    best[done], last[done], size[done] = best[done - 1] + self.unknown_score, -1, 1

        for end, k in self.machine.iter(text):
            length = self.size[k]
            settle(end)
            got = best[end + 1 - length] + self.score[k]
            if got > best[end + 1]:
                best[end + 1], last[end + 1], size[end + 1] = got, k, length
        settle(n)
        return self._trace(text, last, size)

    def _trace(self, text: str, last: list[int], size: list[int]) -> list[int]:
        out: list[int] = []
        at = len(text)
        while at:
            k = last[at]
            if k >= 0:
                out.append(k)
            elif self.byte_of:
                out.extend(self.byte_of[b] for b in reversed(text[at - size[at] : at].encode()))
            elif not (out and out[-1] == self.unk):
                out.append(self.unk)
            at -= size[at]
        out.reverse()
        return out

    def spelled(self, full: str) -> list[int]:
        """Ids of a normalised text, from the automaton."""
        one = self._bpe if self.kind == BPE else self._viterbi
        if not self.by_word:
            return one(full)
        return [k for word in WORD.findall(full) for k in one(word)]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text, without begin and end; null is empty."""
        full = self.normal(text or "")
        return self.spelled(full) if full else []

    def _known(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word start in self.flat, and how many they are; each new word runs through the automaton once."""
        if len(self.place) + len(words) > CACHE:
            self.place.clear()
            self.filled = 0
        fresh = [w for w in dict.fromkeys(words) if w not in self.place]
        short = [w for w in fresh if self.kind == BPE and len(w) <= SHORT]
        for i in range(0, len(short), BLOCK):
            self._keep(short[i : i + BLOCK], *self._bpe_words(short[i : i + BLOCK]))
        for w in fresh:
            if w not in self.place:  # the long ones, and all of a unigram model
                ids = self.spelled(w)
                self._keep([w], np.array(ids, np.int64), np.array([len(ids)]))
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        return self.start[at], self.many[at]

    def _keep(self, words: list[str], ids: np.ndarray, many: np.ndarray) -> None:
        n, end = len(self.place), self.filled + len(ids)
        self.place.update(zip(words, range(n, n + len(words))))
        self.flat, self.start, self.many = (_room(x, m) for x, m in ((self.flat, end), (self.start, n + len(words)), (self.many, n + len(words))))
        self.flat[self.filled : end] = ids
        self.many[n : n + len(words)] = many
        self.start[n : n + len(words)] = self.filled + np.cumsum(many) - many
        self.filled = end

    def encode_array(self, texts: pa.Array) -> pa.ListArray:
        """encode() of an array. Distinct words go through the automaton; their ids are then laid out by the words' places."""
        texts = pc.fill_null(texts, "")
        if not self.plain or not self.by_word or pc.any(pc.match_substring(texts, MARK)).as_py():
            return pa.array([self.encode(v.as_py()) for v in texts], pa.list_(pa.int32()))
        lists = pc.split_pattern(texts, " ")
        ends = np.asarray(lists.offsets).astype(np.int64)
        words = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        ends = ends - ends[0]
        code, names = np.asarray(words.indices).astype(np.int64), words.dictionary.to_pylist()
        # spaces in a row leave empty words: they belong to the next word, or else end the text
        blank = code == names.index("") if "" in names else np.zeros(len(code), bool)
        spelling = [MARK + n for n in names]
        if blank.any():
            at = np.arange(len(code))
            first = np.repeat(ends[:-1], np.diff(ends))
            solid = np.maximum.accumulate(np.where(blank, -1, at))
            before = np.concatenate(([-1], solid[:-1]))
            spaces = at - np.maximum(before, first - 1)  # words since the last one with a character in this text
            last = np.zeros(len(code), bool)
            last[(ends[1:] - 1)[np.diff(ends) > 0]] = True
            odd = np.flatnonzero((spaces > 1) & ~blank | blank & last)
            code[blank] = -1
            more: dict[str, int] = {}
            for i, n, w in zip(odd.tolist(), spaces[odd].tolist(), np.where(blank[odd], -1, code[odd]).tolist()):
                word = MARK * n + (names[w] if w >= 0 else "")
                code[i] = more.setdefault(word, len(spelling) + len(more))
            spelling += more
        whole = np.repeat(np.asarray(pc.binary_length(texts)) > 0, np.diff(ends))  # an empty text has no word at all
        code[~whole] = -1
        start, size = self._known([*spelling, ""])
        size, start = size[code], start[code]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.repeat(start - total[:-1], size) + np.arange(total[-1])]
        return pa.ListArray.from_arrays(pa.array(total[ends].astype(np.int32)), pa.array(ids))

    def decode(self, ids) -> str:
        """The text of ids: pieces joined, byte pieces as UTF-8, marks as spaces, the first mark dropped."""
        out: list[str] = []
        run = bytearray()
        for k in ids:
            if self.is_byte[k]:
                run.append(int(self.text[k][3:5], 16))
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if k == self.unk:
                out.append(" ⁇ ")
            elif k not in self.hidden:
                piece = self.text[k]
                if not out and piece.startswith(MARK):
                    piece = piece[1:]
                    if not piece:
                        out.append("")
                        continue
                out.append(piece.replace(MARK, " "))
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)


    def decode_array(self, ids: pa.ListArray) -> pa.Array:
        """decode() of an array: each id takes its piece's bytes, which then lie in the order of the texts."""
        size = np.asarray(pc.fill_null(pc.list_value_length(ids), 0)).astype(np.int64)
        flat = ids.flatten()
        ends = np.concatenate(([0], np.cumsum(size)))
        if flat.null_count:
            ends = np.concatenate(([0], np.cumsum(np.asarray(flat.is_valid()))))[ends]
            flat = flat.drop_null()
        code = np.asarray(flat).astype(np.int64)
        if len(code) and (code.min() < 0 or code.max() >= len(self.text)):
            raise ValueError("an id is not one of the model's")
        if self.hidden and np.isin(code, list(self.hidden)).any():
            return pa.array([self.decode(code[a:b].tolist()) for a, b in zip(ends, ends[1:])], pa.string())
        code[ends[:-1][np.diff(ends) > 0]] += len(self.text)  # a text's first mark is dropped
        taken = self.spellings.take(pa.array(code))
        places = np.frombuffer(taken.buffers()[1], np.int32, len(code) + 1) if len(code) else np.zeros(1, np.int32)
        out = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.ascontiguousarray(places[ends])), taken.buffers()[2] or pa.py_buffer(b"")])
        try:
            return out.cast(pa.string())
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            code[ends[:-1][np.diff(ends) > 0]] -= len(self.text)
            return pa.array([self.decode(code[a:b].tolist()) for a, b in zip(ends, ends[1:])], pa.string())


WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@functools.cache
def load(path: str) -> Pieces:
    with open(path, "rb") as f:
        return Pieces(f.read())


def _mapped(df: DataFrame, column: str, steps: dict[str, tuple[str, str]], path: str) -> DataFrame:
    """df without the column and with a column for each step (its name: its type and its method), each worked out from the one before."""
    others = [c for c in df.columns if c != column]
    fields = []
    for out, (kind, _) in steps.items():
        fields.append(T.StructField(free_name(out, [*others, *(f.name for f in fields)]), T._parse_datatype_string(kind)))
    narrow = df.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{column}`"))
    names, methods = [*others, *(f.name for f in fields)], [m for _, m in steps.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for part in slices(batch, PART_BYTES):
                columns = [*part.columns]
                for method in methods:
                    columns.append(getattr(model, method)(columns[-1]))
                del columns[len(others)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return narrow.mapInArrow(run, T.StructType([*narrow.schema.fields[:-1], *fields]))


def encode(df: DataFrame, model_path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """df without the text and with its ids; null and empty texts have none. No shuffle; a row's memory is its text's.

    Every row keeps its place among repeated ones. A column of the name `out` is kept, and the ids get the name with
    underscores after it; an empty table gives none.
    """
    return _mapped(df, text_col, {out: ("array<int>", "encode_array")}, model_path)


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """df without the ids and with their text; null and empty ids give an empty text, null members are left out.

    Bytes that are no UTF-8 become U+FFFD; an id that the model does not have is an error. Names and repeated rows are
    as in encode().
    """
    return _mapped(df, ids_col, {out: ("string", "decode_array")}, model_path)


def encode_decode(df: DataFrame, model_path: str, text_col: str = "text", out: str = "ids", back: str = "decoded") -> DataFrame:
    """df without the text, with its ids and the text that these decode to, as by encode() and decode().

    One worker of a task does both: each holds a model and batches of its own beside the executor's heap.
    """
    return _mapped(df, text_col, {out: ("array<int>", "encode_array"), back: ("string", "decode_array")}, model_path)


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows id, n_pieces, ids_sha256 (of the ids joined by commas), decoded_sha256, n_decoded_chars, same; one for each row of docs.

    same: the decoded text is the text, as it is for every text without the mark U+2581 itself, which decodes to a
    space. Null texts count as empty; repeated rows and null ids keep their rows; other columns are not read.
    """
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"), 256).alias("sha"), F.col(f"`{text_col}`").alias("text"))
    coded = encode_decode(narrow, model_path)
    made, ids = F.sha2(F.col("decoded").cast("binary"), 256), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return coded.select(F.col("id").alias(id_col), F.size("ids").cast("bigint").alias("n_pieces"), ids.alias("ids_sha256"), made.alias("decoded_sha256"), F.length("decoded").cast("bigint").alias("n_decoded_chars"), (made == F.col("sha")).alias("same"))
