"""Byte-level BPE by one pass of dynamic programming over prefixes.

Of every prefix of a piece of text, BPE's result ends in one certain token. The
suffix matches, the tokens that end at each position, come from a trie of the
tokens read backward, walked from all positions at once; the one whose predecessor, the stored last token of the rest,
cannot merge with it is stored for the prefix. Following these pointers back
gives exactly the ids that merging by rank gives, in time linear in the text.

Two tokens side by side stay apart if no merge joins the right edge of the first
with the left edge of the second while both of its parts exist. The different
words of a batch are worked out together, the same position of all of them at a
time, with that test on whole arrays; pieces of more than ``LONG`` characters go
one by one. Answers of the test, and the ids of words met often, are remembered
per Python worker in tables of bounded bytes.

Defined results: a null text counts as empty; an empty text has no ids and
decodes to an empty text. Other columns are passed on, but for those of the
names of the results, which are replaced. Rows never meet, so repeated rows and
ties need no rule.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rankloom.llm.batches import short

# The pattern that cuts a text into pieces, and the printable bytes
# that stand for themselves in the vocabulary file.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
PRINTABLE = [(0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)]

NEVER = 1 << 60
TABLE_BITS = 19
# Pieces of more characters are worked out alone; so many characters of others at a time.
LONG, HELD, LONG_PAIRS = 200, 60_000, 100_000
# Words of more characters aren't remembered; what an entry takes besides its characters.
LONG_WORD, ENTRY_BYTES = 48, 220


class Decoder:
    """Decodes with one vocabulary file (its JSON text)."""

    def __init__(self, definition: str):
        self._read(json.loads(definition))

    def _read(self, spec: dict) -> dict[str, int]:
        itself = {b for low, high in PRINTABLE for b in range(low, high + 1)}
        others = [b for b in range(256) if b not in itself]
        byte_of = {chr(b): b for b in itself} | {chr(256 + i): b for i, b in enumerate(others)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {name: i for name, i in spec["model"]["vocab"].items() if name not in self.special}
        bytes_of = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for name, i in ids.items():
            bytes_of[i] = bytes(byte_of[c] for c in name)
        for name, i in self.special.items():
            bytes_of[i] = name.encode()
        self.tokens = pa.array(bytes_of, pa.large_binary())
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.tokens[i].as_py() for i in ids).decode("utf-8", "replace")

    def decode_all(self, ids: pa.Array) -> pa.Array:
        """The texts of lists of ids; null lists give empty texts."""
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        taken = self.tokens.take(ids.flatten())
        places = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
        ends = places[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])]
        joined = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends), taken.buffers()[2]])
        try:
            return joined.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # ids that cut characters
            return pa.array([b.decode("utf-8", "replace") for b in joined.to_pylist()], pa.string())


class Pairs:
    """Tests whether two tokens side by side stay apart, for arrays of pairs; answers are remembered in a fixed table."""

    def __init__(self, merges: np.ndarray, tokens: int):
        """``merges``: rows of left token, right token and the token made of them, by rank."""
        keys, self.ranks = np.unique(merges[:, 0] << 32 | merges[:, 1], return_index=True)
        # One key above all others, so that a search always ends at a place.
        self.keys, self.ranks = np.append(keys, 1 << 62), np.append(self.ranks, NEVER)
        self.left, self.right, self.gone = (np.full(tokens, f, np.int64) for f in (-1, -1, NEVER))
        whole, rank = np.unique(merges[:, 2], return_index=True)
        self.left[whole], self.right[whole], self.gone[whole] = merges[rank, 0], merges[rank, 1], rank
        self._forget()

    def _forget(self) -> None:
        self.asked, self.answers = np.full(1 << TABLE_BITS, -1, np.int64), np.zeros(1 << TABLE_BITS, bool)

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if k not in ("asked", "answers")}

    def __setstate__(self, state):
        vars(self).update(state)
        self._forget()

    def reachable(self, tokens: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of a token gives that token: its two parts are not torn apart before."""
        out, made = np.ones(len(tokens), bool), np.flatnonzero(self.left[tokens] >= 0)
        whole = tokens[made]
        out[made] = self._stay(self.left[whole], self.right[whole], self.gone[whole])
        return out

    def apart(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        pair = first << 32 | second
        place = (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        new = np.flatnonzero(self.asked[place] != pair)
        out = self.answers[place]
        if len(new):
            out[new] = self._stay(first[new], second[new], np.full(len(new), NEVER))
            self.asked[place[new]] = pair[new]
            # Of several pairs of one place the last was written; only its own answer may stand there.
            last = self.asked[place[new]] == pair[new]
            self.answers[place[new][last]] = out[new][last]
        return out

    def _stay(self, first: np.ndarray, second: np.ndarray, until: np.ndarray) -> np.ndarray:
        """No merge of a lower rank than ``until`` joins a part on the right edge of the first with one on the left edge of the second.

        A part on the edge exists until the token above it is made. At equal
        ranks the merge further left comes first.
        """
        out, at, first, gone = np.ones(len(first), bool), np.arange(len(first)), first.copy(), until.copy()
        while len(at):
            part, part_gone, open_ = second[at], until[at] - 1, np.arange(len(at))
            while len(open_):
                key = first[at[open_]] << 32 | part[open_]
                found = np.searchsorted(self.keys, key)
                rank = np.where(self.keys[found] == key, self.ranks[found], NEVER)
                joins = (rank < gone[at[open_]]) & (rank <= part_gone[open_])
                out[at[open_[joins]]] = False
                below = self.left[part[open_]]
                part_gone[open_] = np.minimum(self.gone[part[open_]], until[at[open_]] - 1)
                part[open_] = below
                open_ = open_[~joins & (below >= 0)]
            below = self.right[first[at]]
            gone[at] = np.minimum(self.gone[first[at]], until[at])
            first[at] = below
            at = at[out[at] & (below >= 0)]
        return out


class Endings:
    """The tokens that end at each place of some bytes: a trie of the tokens read backward."""

    def __init__(self, tokens: dict[int, bytes]):
        ids, sizes = np.array(list(tokens), np.int64), np.array([len(t) for t in tokens.values()], np.int64)
        flat = np.frombuffer(b"".join(tokens.values()), np.uint8)
        last = np.cumsum(sizes) - 1
        node, made, keys, below = np.zeros(len(ids), np.int64), 1, [], []
        self.token = np.full(1 + int(sizes.sum()), -1, np.int32)
        for length in range(1, int(sizes.max()) + 1):
            on = np.flatnonzero(sizes >= length)
            known, which = np.unique(node[on] << 8 | flat[last[on] - length + 1], return_inverse=True)
            keys.append(known)
            below.append(made + np.arange(len(known)))
            node[on] = made + which
            made += len(known)
            whole = on[sizes[on] == length]
            self.token[node[whole]] = ids[whole]
        # One key above all others, so that a search always ends at a place.
        keys, below = np.append(np.concatenate(keys), 1 << 62), np.append(np.concatenate(below), 0)
        order = np.argsort(keys)
        self.keys, self.below, self.token = keys[order], below[order], self.token[:made].astype(np.int64)

    def of(self, data: np.ndarray, place: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, token, length) of every token that ends at data[place] and begins at ``first`` or later."""
        rows, tokens, lengths = [], [], []
        row, node, length = np.arange(len(place)), np.zeros(len(place), np.int64), 0
        at = place.astype(np.int64)
        while len(row):
            key = node << 8 | data[at]
            found = np.searchsorted(self.keys, key)
            on = self.keys[found] == key
            row, at, node, length = row[on], at[on], self.below[found[on]], length + 1
            token = self.token[node]
            ends = np.flatnonzero(token >= 0)
            rows.append(row[ends])
            tokens.append(token[ends])
            lengths.append(np.full(len(ends), length))
            on = at > first[row]
            row, at, node = row[on], at[on] - 1, node[on]
        return tuple(np.concatenate([np.empty(0, np.int64), *x]) for x in (rows, tokens, lengths))


class Codec(Decoder):
    """Encodes as well; words it has met are remembered up to about ``remembered`` bytes.

    It is built once and sent to the workers as arrays, without what it remembers.
    """

    def __init__(self, definition: str, remembered: int = 40 << 20):
        spec = json.loads(definition)
        ids = self._read(spec)
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        merges = np.array([(ids[left], ids[right], ids[left + right]) for left, right in merges], np.int64).reshape(-1, 3)
        pairs, known = Pairs(merges, len(self.tokens)), np.array(list(ids.values()), np.int64)
        endings = Endings({i: self.tokens[i].as_py() for i in known[pairs.reachable(known)].tolist()})
        self.__setstate__((sha256(definition.encode()).hexdigest(), self.special, self.tokens, pairs, endings, remembered))

    def __getstate__(self):
        return self.name, self.special, self.tokens, self.pairs, self.endings, self.remembered

    def __setstate__(self, state):
        self.name, self.special, self.tokens, self.pairs, self.endings, self.remembered = state
        self.pieces = regex.compile(PIECES)
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.special_ids = {"  " + name: pack("=i", i) for name, i in self.special.items()}
        self.words, self.earlier, self.size = {}, {}, 0
        self.longest = pc.max(pc.binary_length(self.tokens)).as_py()

    def _long_piece(self, piece: str) -> bytes:
        """Ids of one piece of any length, position by position."""
        data = piece.encode()
        last, before = np.full(len(data) + 1, -1, np.int32), np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
        apart: dict[int, bool] = {}
        for begin in range(0, len(data), HELD):
            low = max(0, begin - self.longest)
            part = np.frombuffer(data[low : begin + HELD], np.uint8)
            place = np.arange(begin - low, len(part))
            row, tokens, lengths = self.endings.of(part, place, np.zeros(len(place), np.int64))
            order = np.argsort(row, kind="stable")
            for end, token, length in zip((begin + 1 + row[order]).tolist(), tokens[order].tolist(), lengths[order].tolist(), strict=True):
                start = end - length
                if last[end] >= 0:
                    continue  # the prefix has its last token
                if start:
                    pair = int(last[start]) << 32 | token
                    stays = apart.get(pair)
                    if stays is None:
                        if len(apart) >= LONG_PAIRS:
                            apart.clear()
                        stays = apart[pair] = bool(self.pairs.apart(last[start : start + 1].astype(np.int64), np.array([token]))[0])
                    if not stays:
                        continue
                last[end], before[end] = token, start
        out, end = [], len(data)
        while end:
            out.append(last[end])
            end = before[end]
        return np.array(out[::-1], np.int32).tobytes()

    def _pieces(self, pieces: list[str]) -> Iterator[bytes]:
        """Ids of short pieces, the same position of all of them at a time."""
        datas = [p.encode() for p in pieces]
        sizes = np.array([len(d) for d in datas], np.int64)
        data, piece = np.frombuffer(b"".join(datas), np.uint8), np.repeat(np.arange(len(sizes)), sizes)
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        row, token, length = self.endings.of(data, np.arange(len(data)), first)
        end = row + 1 - first[row]  # of the prefix, in its piece
        piece, start = piece[row], end - length
        begins = np.cumsum(sizes + 1) - sizes - 1
        order = np.argsort(end, kind="stable")
        bounds = np.searchsorted(end[order], np.arange(1, int(sizes.max()) + 2))
        # Prefix k of a piece has place begins + k: pieces have one place more than bytes.
        last, before = np.full(int(begins[-1] + sizes[-1]) + 1, -1, np.int64), np.zeros(int(begins[-1] + sizes[-1]) + 1, np.int64)
        for k in range(len(bounds) - 1):
            at = order[bounds[k] : bounds[k + 1]]
            begin = begins[piece[at]]
            inner = np.flatnonzero(start[at])
            stays = np.ones(len(at), bool)
            stays[inner] = self.pairs.apart(last[begin[inner] + start[at[inner]]], token[at[inner]])
            at, begin = at[stays], begin[stays]
            last[begin + end[at]], before[begin + end[at]] = token[at], start[at]
        # Back from the ends, all pieces at once; then the ids in order of piece and place.
        at, who, found = sizes.copy(), np.arange(len(sizes)), []
        while len(who):
            place = begins[who] + at[who]
            found.append((who, at[who], last[place]))
            at[who] = before[place]
            who = who[at[who] > 0]
        who, at, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((at, who))
        packed = ids[order].astype(np.int32).tobytes()
        ends = 4 * np.cumsum(np.bincount(who, minlength=len(sizes)))
        return (packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))

    @staticmethod
    def _key(piece: str) -> str:
        """A piece of a blank and a word goes by the word; another by itself after a blank, which no word has."""
        return piece[1:] if len(piece) > 1 and piece[0] == " " and not piece[1].isspace() else " " + piece

    def _keys(self, text: str) -> list[str]:
        """The words and pieces of a text in order.

        A single blank before a visible character always begins a piece, so words
        are taken one by one; texts with other white space after a blank are cut
        by the pattern. Special tokens go by their name after two blanks.
        """
        if any(name in text for name in self.special):
            out = []
            for part in self.splitter.split(text):
                out += ["  " + part] if part in self.special else self._keys(part)
            return out
        first, *rest = text.split(" ")
        if all(rest) and not any(w[0].isspace() for w in rest):
            return [*map(self._key, self.pieces.findall(first)), *rest]
        return [*map(self._key, self.pieces.findall(text))]

    def _found(self, keys: set[str]) -> dict[str, bytes]:
        """Ids of words and pieces by key."""
        out, cut, new, again = {}, {}, {}, {}
        for key in keys:
            if (ids := self.words.get(key)) is not None:
                out[key] = ids
            elif (ids := self.earlier.get(key)) is not None:
                out[key] = again[key] = ids
            elif key[0] == " " or key.isalpha():
                new[key] = self.special_ids.get(key)
            else:
                cut[key] = [*map(self._key, self.pieces.findall(" " + key))]
        for inner in cut.values():
            for key in inner:
                if key not in out and key not in new:
                    ids = self.words.get(key) or self.earlier.get(key)
                    if ids is None:
                        new[key] = None
                    else:
                        out[key] = ids
        held, size = [], 0
        for key in [k for k, ids in new.items() if ids is None]:
            piece = key[1:] if key[0] == " " else " " + key
            if len(piece) > LONG:
                new[key] = self._long_piece(piece)
                continue
            held.append((key, piece))
            size += len(piece)
            if size >= HELD:
                new.update(zip([k for k, _ in held], self._pieces([p for _, p in held]), strict=True))
                held, size = [], 0
        if held:
            new.update(zip([k for k, _ in held], self._pieces([p for _, p in held]), strict=True))
        out |= new
        for key, inner in cut.items():
            new[key] = out[key] = b"".join(map(out.__getitem__, inner))
        self._remember(new | again)
        return out

    def _remember(self, new: dict[str, bytes]) -> None:
        # Two generations: words not met again while the younger one fills are forgotten.
        if max(map(len, new), default=0) > LONG_WORD:
            new = {key: ids for key, ids in new.items() if len(key) <= LONG_WORD}
        size = ENTRY_BYTES * len(new) + 2 * sum(map(len, new)) + sum(map(len, new.values()))
        if self.size + size > self.remembered // 2:
            self.words, self.earlier, self.size = {}, self.words, 0
        if size <= self.remembered // 2:
            self.words.update(new)
            self.size += size

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of every text, four bytes each; every word that the texts share is worked out once."""
        collects = gc.isenabled()
        gc.disable()  # many small objects are made, none of them in cycles
        try:
            keys = [self._keys(t) for t in texts]
            found = self._found(set(chain.from_iterable(keys)))
            return [b"".join(map(found.__getitem__, k)) for k in keys]
        finally:
            if collects:
                gc.enable()

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


_CODECS: dict[str, Codec] = {}


def _codec(shared) -> Codec:
    """One codec of a vocabulary per Python worker, with what it remembers."""
    return _CODECS.setdefault(shared.value.name, shared.value)


def _replaced(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    keep = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), column], [*keep, name])


def _schema(docs: DataFrame, **added) -> T.StructType:
    return T.StructType([*(f for f in docs.schema if f.name not in added), *(T.StructField(n, t) for n, t in added.items())])


def _encoded(shared, text: str, ids: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in short(batches):
            rows = codec.encode_all([t or "" for t in batch.column(text).to_pylist()])
            ends = np.cumsum([0, *(len(r) // 4 for r in rows)], dtype=np.int32)
            yield _replaced(batch, ids, pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(rows), np.int32))))

    return run


def _joined(ids: str):
    """Lists of ids as texts, with commas between, and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(ids)
            texts = pa.ListArray.from_arrays(column.offsets, pc.cast(column.values, pa.string()))
            batch = _replaced(batch, ids, pc.binary_join(texts, ","))
            yield _replaced(batch, "n_tokens", pc.cast(pc.list_value_length(column), pa.int64()))

    return run


def _decoded(shared, ids: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in short(batches):
            yield _replaced(batch, text, codec.decode_all(batch.column(ids)))

    return run


def share_vocabulary(spark, path: str):
    """The vocabulary file, read once on the driver and sent to the workers as a codec's tables (some 10 MB)."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(Codec(file.read()))


def encode(docs: DataFrame, vocabulary, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text``."""
    schema = _schema(docs, **{ids: T.ArrayType(T.IntegerType())})
    return docs.mapInArrow(_encoded(vocabulary, text, ids), schema)


def decode(encoded: DataFrame, vocabulary, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with the text that ``ids`` stand for."""
    return encoded.mapInArrow(_decoded(vocabulary, ids, text), _schema(encoded, **{text: T.StringType()}))


def round_trip(docs: DataFrame, vocabulary, text: str = "text", ids: str = "ids", decoded: str = "decoded", as_text: bool = False) -> DataFrame:
    """``docs`` with the token ids of ``text`` and, instead of it, the text that they decode to.

    Both steps run one after the other in the same task and worker, so ids don't
    go to and fro between them. ``as_text`` gives the ids as a text with commas
    between, and ``n_tokens``, their number.
    """
    added = {ids: T.StringType(), "n_tokens": T.LongType()} if as_text else {ids: T.ArrayType(T.IntegerType())}
    schema = _schema(docs, **added, **{decoded: T.StringType()})
    kept = T.StructType([f for f in schema if f.name != text or text == decoded])
    there, back, joined = _encoded(vocabulary, text, ids), _decoded(vocabulary, ids, decoded), _joined(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = back(there(batches))
        for batch in joined(made) if as_text else made:
            yield batch.select(kept.names)

    return docs.mapInArrow(run, kept)
