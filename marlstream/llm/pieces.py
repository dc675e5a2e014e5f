"""SentencePiece encoding and decoding as weighted finite-state transduction.

A model file is compiled into three transducers. The normaliser rewrites the longest strings that its rules know, maps
spaces to U+2581 and may put one in front or take out needless ones. The piece transducer has a state for each piece read
last and an arc for each piece that may follow it, weighted with minus the piece's score. The fallback turns a character
that is no piece into byte pieces, or the unknown piece. A text is composed with them and the path of least total weight
(tropical semiring) is its encoding, found in one pass over the positions of the normalised text. Where all paths that
are still open at the end of a block go through one state, the path up to there is done, so that memory stays small
however long a text is.

In a Unigram model all arcs exist and the weights decide. In a BPE one the right segmentation is the one that merging by
score ends in, not the one of least summed score. A segmentation is that one exactly if merging leaves each two
neighbouring pieces, taken alone, as they are; so the arcs are those pairs, found by merging the pair's text once, and
kept. Then a prefix of the text has one state that can be reached, and the search carries one state for each position.

A long run of spaces begins with its longest piece over and over; this is confirmed for the model when it is compiled, and
then only the last few of a run are composed, with the word behind them.

If no piece has U+2581 inside or a line feed, texts are composed part by part, and the parts seen most lately are
kept, three times KEPT_BYTES of them at most beside those in hand. Of the arcs MAX_ARCS are kept. Parts of up to LONG_PART characters that aren't
kept are searched together, PARTS_BLOCK characters at a time: the pieces at all of their places are looked up at once, and
the search takes the first place of all parts, then the second, and so on. Longer ones are searched one by one.

Defined cases: a null text stays null when decoded and has no ids, an empty text has no ids and decodes to itself;
bytes that are no UTF-8 decode to U+FFFD each; a text's own U+2581 decodes to a space, as in the library itself;
repeated rows get equal results; only the named columns are used and replaced, so further columns can't clash.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstream.llm.arrow_text import batches_of
from marlstream.llm.common import table

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: of parts and their ids, ENTRY_BYTES of each being Python's own; a part of more than LONG_PART characters isn't kept
KEPT_BYTES, ENTRY_BYTES, LONG_PART = 32 << 20, 200, 200
MAX_ARCS = 400_000
#: positions that are searched at a time in one part, and in many short ones
BLOCK, PARTS_BLOCK = 1 << 16, 1 << 17
#: what an unknown character costs more than the worst piece of a Unigram model (fixed value of the library)
UNKNOWN_PENALTY = 10.0
UNIGRAM, BPE = 1, 2
BATCH_BYTES = 1 << 20
#: parts that are composed at a time; a larger text is composed in runs of them
MOST_PARTS = 1 << 18
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def _fields(data: bytes):
    """(number, value) of a protocol-buffer message; values are integers or bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
            continue
        n = {1: 8, 5: 4}[wire] if wire != 2 else varint()
        yield tag >> 3, data[at : at + n]
        at += n


class Vocabulary:
    """What a model file says: pieces with score and kind, and the normaliser's settings."""

    def __init__(self, model: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        self.kind, self.byte_fallback, self.unknown = UNIGRAM, False, " ⁇ "
        self.dummy_prefix, self.fewer_spaces, self.rules = True, True, b""
        for number, value in _fields(model):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, x in _fields(value):
                    if n == 1:
                        piece = x.decode()
                    elif n == 2:
                        score = struct.unpack("<f", x)[0]
                    elif n == 3:
                        kind = x
                self.pieces.append(piece)
                self.scores.append(score)
                self.kinds.append(kind)
            elif number == 2:
                found = dict(_fields(value))
                self.byte_fallback = bool(found.get(35, 0))
                self.kind = found.get(3, UNIGRAM)
                if self.kind not in (UNIGRAM, BPE) or found.get(24):
                    raise ValueError("only Unigram and BPE models with spaces in front of words are supported")
            elif number == 3:
                found = dict(_fields(value))
                self.dummy_prefix, self.fewer_spaces = bool(found.get(3, 1)), bool(found.get(4, 1))
                self.rules = found.get(2, b"")
                if not found.get(5, 1):
                    raise ValueError("only models that turn spaces into U+2581 are supported")


def rules_of(charsmap: bytes) -> dict[str, str]:
    """The rewriting rules of a model file: a double-array trie of the strings to replace, then their replacements."""
    if not charsmap:
        return {}
    size = struct.unpack("<I", charsmap[:4])[0]
    units, texts = np.frombuffer(charsmap[4 : 4 + size], "<u4"), charsmap[4 + size :]
    offset = lambda unit: (unit >> 10) << ((unit & (1 << 9)) >> 6)
    labels = np.arange(1, 256)
    found, open_ = {}, [(0, b"")]
    while open_:
        node, key = open_.pop()
        base = node ^ offset(int(units[node]))
        if key and units[node] >> 8 & 1:
            at = int(units[base]) & 0x7FFFFFFF
            found[key.decode()] = texts[at : texts.index(0, at)].decode()
        next_ = base ^ labels
        next_, label = next_[next_ < len(units)], labels[next_ < len(units)]
        fits = (units[next_] & 0x800000FF) == label
        open_ += [(int(n), key + bytes([x])) for n, x in zip(next_[fits], label[fits], strict=True)]
    return found


class Normaliser:
    """The transducer from texts to normalised texts."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.rules = rules_of(vocabulary.rules)
        self.longest: dict[str, int] = {}
        for key in self.rules:
            self.longest[key[0]] = max(len(key), self.longest.get(key[0], 0))

    def rewritten(self, text: str) -> str:
        """text with the longest string that a rule knows replaced, from left to right."""
        out, at, longest, rules = [], 0, self.longest, self.rules
        while at < len(text):
            n = longest.get(text[at], 0)
            while n and text[at : at + n] not in rules:
                n -= 1
            out.append(rules[text[at : at + n]] if n else text[at])
            at += n or 1
        return "".join(out)

    def __call__(self, text: str) -> str:
        if self.rules:
            text = self.rewritten(text)
        if self.v.fewer_spaces:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (SPACE + text if self.v.dummy_prefix else text).replace(" ", SPACE)


class Lookup:
    """Whole numbers of at least 0 by whole numbers of at least 0, for arrays of keys at once; never over half full."""

    def __init__(self, most: int):
        self.most, self.bits = most, max(4, (2 * most).bit_length())
        self.clear()

    def clear(self) -> None:
        self.n, self.keys, self.values = 0, np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        places = self._places(keys)
        there = self.keys[places]
        found = np.where(there == keys, self.values[places], np.int32(-1))
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            places[open_] = places[open_] + 1 & (1 << self.bits) - 1
            there, wanted = self.keys[places[open_]], keys[open_]
            same = there == wanted
            found[open_[same]] = self.values[places[open_[same]]]
            open_ = open_[~same & (there >= 0)]
        return found

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that aren't there yet; if they are more than it holds, the others go."""
        if self.n + len(keys) > self.most:
            self.clear()
        self.n += len(keys)
        places = self._places(keys)
        while len(keys):
            free = self.keys[places] < 0
            self.keys[places[free]] = keys[free]
            put = self.keys[places] == keys
            self.values[places[put]] = values[put]
            keys, values, places = keys[~put], values[~put], places[~put] + 1 & (1 << self.bits) - 1


class Transducer:
    """The compiled model. Encodes texts to ids packed as little-endian uint32, and decodes ids."""

    FALLBACK = -1

    def __init__(self, model: bytes):
        v = Vocabulary(model)
        self.vocabulary, self.normalise = v, Normaliser(v)
        self.ids = {p: i for i, p in enumerate(v.pieces) if v.kinds[i] in (NORMAL, USER)}
        self.weights = [-s for s in v.scores]
        normal = [s for s, k in zip(v.scores, v.kinds, strict=True) if k == NORMAL] or [0.0]
        self.unknown_weight = 0.0 if v.kind == BPE else UNKNOWN_PENALTY - min(normal)
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(v.pieces) if v.kinds[i] == BYTE}
        self.unknown_id = next((i for i, k in enumerate(v.kinds) if k == UNKNOWN), 0)
        self.surface = [v.unknown.encode() if k == UNKNOWN else b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() for p, k in zip(v.pieces, v.kinds, strict=True)]
        inside = any(SPACE in p.strip(SPACE) or p.rstrip(SPACE) not in ("", p) for p in self.ids)
        feed = any("\n" in p for p in self.ids)
        self.part = re.compile(r"(?s).+" if inside else r"(?s)▁+[^▁]*|[^▁]+" if feed else r"\n|▁+[^▁\n]*|[^▁\n]+")
        self.longest = max(map(len, self.ids), default=1)
        self.n_arcs = 0
        self.arcs: list[dict[int, bool]] = [{} for _ in v.pieces]
        self.trie: dict = {}
        for p, i in self.ids.items():
            node = self.trie
            for char in p:
                node = node.setdefault(char, {})
            node[""] = i
        # the same trie for arrays: characters by number, nodes by node and character, the piece that ends at a node
        self.numbers = np.zeros(0x110000, np.int32)
        chars = sorted({c for p in self.ids for c in p})
        self.numbers[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.single = np.zeros(len(chars) + 1, bool)
        self.single[[self.numbers[ord(p)] for p in self.ids if len(p) == 1]] = True
        number, open_, steps, ends = {c: i for i, c in enumerate(chars, 1)}, [self.trie], [], []
        self.width = len(chars) + 1
        for at, node in enumerate(open_):
            ends.append(node.get("", -1))
            for char, child in node.items():
                if char:
                    steps.append((at * self.width + number[char], len(open_)))
                    open_.append(child)
        self.nodes, self.ends = Lookup(len(steps)), np.array(ends, np.int32)
        if steps:
            self.nodes.put(*np.array(steps, np.int64).T)
        self.all_weights = np.array([*self.weights, self.unknown_weight])
        self.all_arcs = Lookup(MAX_ARCS)
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.kept_bytes = 0
        # the longest piece of spaces, if runs of them begin with it
        n = max((len(p) for p in self.ids if not p.strip(SPACE)), default=0)
        whole = self.ids.get(SPACE * n)
        self.spaces = n if n and not inside and all(self.shortest(SPACE * k) == [whole, *self.shortest(SPACE * (k - n))] for k in range(2 * n, 4 * n)) else 0

    def merged(self, text: str) -> list[str]:
        """The pieces that are left when neighbours are merged by score, the leftmost first among equals; for the short
        texts of two pieces."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.weights[found] < best):
                    best, at = self.weights[found], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _stay(self, a: int, b: int) -> bool:
        x, y = self.vocabulary.pieces[a], self.vocabulary.pieces[b]
        return self.merged(x + y) == [x, y]

    def follows(self, a: int, b: int) -> bool:
        """If there is an arc from the state of piece a to that of piece b."""
        if self.n_arcs >= MAX_ARCS:
            for known in self.arcs:
                known.clear()
            self.n_arcs = 0
        self.n_arcs += 1
        self.arcs[a][b] = known = self._stay(a, b)
        return known

    def all_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same for many at once."""
        keys = a.astype(np.int64) * len(self.arcs) + b
        found = self.all_arcs.get(keys)
        new, of = np.unique(keys[found < 0], return_inverse=True)
        if len(new):
            stay = np.array([self._stay(*divmod(k, len(self.arcs))) for k in new.tolist()])
            self.all_arcs.put(new, stay)
            found[found < 0] = stay[of]
        return found > 0

    def fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if self.vocabulary.byte_fallback else [self.unknown_id]

    def _search(self, text: str, state: int) -> tuple[list, list]:
        """For each position the piece that ends the best path to it, and where that piece starts."""
        weights, arcs, follows, n, top = self.weights, self.arcs, self.follows, len(text), self.trie
        unigram, unknown, ids = self.vocabulary.kind == UNIGRAM, self.unknown_weight, self.ids
        last, start, cost = [None] * (n + 1), [0] * (n + 1), [float("inf")] * (n + 1)
        last[0], cost[0] = state, 0.0
        for begin in range(n):
            before, so_far, node = last[begin], cost[begin], top
            if before is None:
                continue
            known = None if unigram or before < 0 else arcs[before]
            for end in range(begin, n):
                node = node.get(text[end])
                if node is None:
                    break
                piece = node.get("")
                if piece is None:
                    continue
                if known is not None:
                    may = known.get(piece)
                    if may is None:
                        may = follows(before, piece)
                    if not may:
                        continue
                if so_far + weights[piece] < cost[end + 1]:
                    last[end + 1], start[end + 1], cost[end + 1] = piece, begin, so_far + weights[piece]
            if text[begin] not in ids and so_far + unknown < cost[begin + 1]:
                last[begin + 1], start[begin + 1], cost[begin + 1] = self.FALLBACK, begin, so_far + unknown
        return last, start

    def shortest(self, text: str) -> list[int]:
        """Ids on the path of least weight through a normalised text."""
        ids, at, state, size = [], 0, self.FALLBACK, BLOCK
        while True:
            part = text[at : at + size]
            last, start = self._search(part, state)
            end, over = len(part), at + len(part) == len(text)
            if not over:
                # what goes on starts at one of these positions; the paths to them meet at the last one they share
                ends = {p for p in range(max(0, end - self.longest + 1), end + 1) if last[p] is not None}
                while len(ends) > 1:
                    p = max(ends)
                    ends.remove(p)
                    ends.add(start[p])
                end = ends.pop()
                if not end:
                    size *= 2
                    continue
            path, p = [], end
            while p:
                path.append([last[p]] if last[p] >= 0 else self.fallback(part[p - 1]))
                p = start[p]
            ids += [i for arc in reversed(path) for i in arc]
            if over:
                return ids
            at, state, size = at + end, last[end], BLOCK

    def _arcs_of(self, numbers: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """The pieces at all places of parts laid end to end, ordered by their place in their part: that place, the first
        character, the last one, and the piece, or FALLBACK for a character that is none."""
        behind = np.repeat(first + sizes, sizes)
        at = begins = np.flatnonzero(~self.single[numbers])
        found = [(begins, begins, np.full(len(begins), self.FALLBACK, np.int32))]
        at, node, end = np.arange(len(numbers)), np.zeros(len(numbers), np.int64), np.arange(len(numbers))
        while len(at):
            node = self.nodes.get(node * self.width + numbers[end])
            on = node >= 0
            at, end, node = at[on], end[on], node[on].astype(np.int64)
            piece = self.ends[node]
            is_piece = piece >= 0
            found.append((at[is_piece], end[is_piece], piece[is_piece]))
            end = end + 1
            on = end < behind[at]
            at, end, node = at[on], end[on], node[on]
        begin, end, piece = map(np.concatenate, zip(*found, strict=True))
        place = (begin - np.repeat(first, sizes)[begin]).astype(np.uint16)
        order = np.argsort(place, kind="stable")
        return place[order], begin[order], end[order], piece[order]

    def _all_shortest(self, parts: list[str]) -> list[bytes]:
        """Packed ids on the path of least weight through each of many short parts."""
        chars = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.array([len(x) for x in parts])
        first = np.cumsum(sizes) - sizes
        place, begin, end, piece = self._arcs_of(self.numbers[chars], first, sizes)
        n, bpe, none = len(chars), self.vocabulary.kind == BPE, self.FALLBACK - 1
        # of the best path to the end of each character
        last, start, cost = np.full(n, none, np.int32), np.zeros(n, np.int64), np.full(n, np.inf)
        weight = self.all_weights[piece]
        steps = np.searchsorted(place, np.arange(sizes.max() + 1))
        for k, (low, high) in enumerate(zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True)):
            b, e, x, w = begin[low:high], end[low:high], piece[low:high], weight[low:high]
            if k:
                on = last[b - 1] > none
                b, e, x, w = b[on], e[on], x[on], w[on]
                w = cost[b - 1] + w
                if bpe:
                    before = last[b - 1]
                    on = (before < 0) | (x < 0)
                    asked = np.flatnonzero(~on)
                    on[asked] = self.all_follow(before[asked], x[asked])
                    b, e, x, w = b[on], e[on], x[on], w[on]
            # the arcs of one place of a part end at different characters
            on = w < cost[e]
            e = e[on]
            last[e], start[e], cost[e] = x[on], b[on], w[on]
        passed, low, at = np.zeros(n, bool), first, first + sizes - 1
        while len(at):
            passed[at] = True
            at = start[at]
            on = at > low
            at, low = at[on] - 1, low[on]
        at = np.flatnonzero(passed)
        ids, count = last[at], np.ones(len(at), np.int64)
        if len(odd := np.flatnonzero(ids < 0)):
            known, of = np.unique(chars[at[odd]], return_inverse=True)
            known = [self.fallback(chr(c)) for c in known.tolist()]
            count[odd] = np.array([len(x) for x in known])[of]
            of_odd, ids = np.repeat(ids < 0, count), np.repeat(ids, count)
            ids[of_odd] = [i for k in of.tolist() for i in known[k]]
        to = np.append(0, np.cumsum(count))[np.searchsorted(at, np.append(first, n))] * 4
        packed, to = ids.astype("<u4").tobytes(), to.tolist()
        return [packed[a:b] for a, b in zip(to[:-1], to[1:], strict=True)]

    def _packed(self, part: str) -> bytes:
        n = len(part) - len(part.lstrip(SPACE)) if self.spaces and part[0] == SPACE else 0
        more = (n - 2 * self.spaces) // self.spaces if n >= 4 * self.spaces > 0 else 0
        if not more:
            return np.array(self.shortest(part), "<u4").tobytes()
        return np.full(more, self.ids[SPACE * self.spaces], "<u4").tobytes() + np.array(self.shortest(part[more * self.spaces :]), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        split = [self.part.findall(self.normalise(x)) for x in texts]
        if sum(map(len, split)) <= MOST_PARTS:
            out = self._composed(split)
        else:
            out = [b"".join([self._composed([parts[i : i + MOST_PARTS]])[0] for i in range(0, len(parts), MOST_PARTS)]) for parts in split]
        return out if self.vocabulary.byte_fallback else [self._one_unknown(x) for x in out]

    def _composed(self, split: list[list[str]]) -> list[bytes]:
        """Packed ids of each list of parts."""
        kept = self.kept
        new = set().union(*split).difference(kept)
        long = [x for x in new if len(x) > LONG_PART]
        new.difference_update(long)
        short = new.difference(self.older)
        added = {x: self.older[x] for x in new.difference(short)}
        found, size = [], 0
        for part in short:
            found.append(part)
            size += len(part)
            if size >= PARTS_BLOCK:
                added.update(zip(found, self._all_shortest(found), strict=True))
                found, size = [], 0
        if found:
            added.update(zip(found, self._all_shortest(found), strict=True))
        kept.update(added)
        kept.update((x, self._packed(x)) for x in long)
        out = [b"".join([kept[x] for x in parts]) for parts in split]
        for x in long:
            del kept[x]
        self.kept_bytes += ENTRY_BYTES * len(added) + 4 * sum(map(len, added)) + sum(map(len, added.values()))
        if self.kept_bytes >= KEPT_BYTES:
            self.older, self.kept, self.kept_bytes = kept if self.kept_bytes < 2 * KEPT_BYTES else {}, {}, 0
        return out

    def _one_unknown(self, packed: bytes) -> bytes:
        """Unknown characters in a row are one unknown piece."""
        ids = np.frombuffer(packed, "<u4")
        if not (ids == self.unknown_id).any():
            return packed
        return ids[np.append(True, (ids[1:] != self.unknown_id) | (ids[:-1] != self.unknown_id))].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        surface = self.surface
        ids = ids.tolist()
        text = b"".join([surface[i] for i in ids]).decode("utf-8", "each_byte")
        first = next((self.vocabulary.pieces[i] for i in ids if self.vocabulary.kinds[i] != CONTROL), "")
        return text[1:] if (self.vocabulary.dummy_prefix or self.vocabulary.fewer_spaces) and first.startswith(SPACE) else text


_compiled: dict[bytes, Transducer] = {}


def _transducer(model) -> Transducer:
    """One for each worker process; what it has found out stays for the worker's next tasks."""
    key = model.value
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Transducer(model.value)
    return _compiled[key]


def model_bytes(path: str = MODEL_PATH) -> bytes:
    """The model file, read on the driver; its size is that of a vocabulary, whatever the corpus."""
    with open(path, "rb") as f:
        return f.read()


def _ids_column(packed: list[bytes | None]) -> pa.Array:
    sizes = np.array([len(x) // 4 if x else 0 for x in packed])
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(x or b"" for x in packed), "<u4").astype(np.int32)))


def encode(docs: DataFrame, path: str = MODEL_PATH, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of ids, an empty array for a null text; the other columns stay."""
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(path))
    rest = [c for c in docs.columns if c != ids]
    schema = docs.select(*[F.col(f"`{c}`") for c in rest]).schema.add(ids, T.ArrayType(T.IntegerType()))

    def run(batches):
        t = _transducer(model)
        for whole in batches:
            for batch in batches_of(whole, text, BATCH_BYTES):
                packed = t.encode_all([x or "" for x in batch.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], _ids_column(packed)], [*rest, ids])

    return docs.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)


def decode(docs: DataFrame, path: str = MODEL_PATH, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with the text that the ids stand for; null ids give a null text."""
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(path))
    rest = [c for c in docs.columns if c != text]
    schema = docs.select(*[F.col(f"`{c}`") for c in rest]).schema.add(text, "string")

    def run(batches):
        t = _transducer(model)
        for batch in batches:
            out = [None if x is None else t.decode(np.array(x, np.int64)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(out, pa.string())], [*rest, text])

    return docs.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)


def round_trips(docs: DataFrame, path: str = MODEL_PATH, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, n_bytes, ids_sha256, round_trip[, ids]): both directions in one pass, so that the ids don't
    travel between Spark and Python twice. n_bytes counts the byte pieces, ids_sha256 is of the ids as uint32."""
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(path))
    schema = docs.select("doc_id").schema.add("n_tokens", "long").add("n_bytes", "long").add("ids_sha256", "string").add("round_trip", "boolean")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches):
        t = _transducer(model)
        is_byte = np.array([k == BYTE for k in t.vocabulary.kinds])
        for whole in batches:
            for batch in batches_of(whole, "text", BATCH_BYTES):
                texts, n_bytes, same = [x or "" for x in batch.column("text").to_pylist()], [], []
                packed = t.encode_all(texts)
                for x, of_x in zip(texts, packed, strict=True):
                    ids = np.frombuffer(of_x, "<u4")
                    n_bytes.append(int(is_byte[ids].sum()))
                    same.append(t.decode(ids) == x)
                out = [batch.column("doc_id"), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(n_bytes, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in packed]), pa.array(same)]
                yield pa.RecordBatch.from_arrays([*out, *([_ids_column(packed)] if with_ids else [])], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op1_sentencepiece(spark, sf_dir):
    return round_trips(table(spark, sf_dir, "documents"))


def encode_kept(spark, docs, sf_dir):
    """Pipeline stage, the last: ids of every text that is left, and whether they decode to it."""
    return round_trips(docs, with_ids=True)


QUERIES = {"op1_sentencepiece": op1_sentencepiece}
